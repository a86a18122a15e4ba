"""The same results in plain SQL, written against the tables and not against the library.

Joins, windows and rules are spelled out the simple way: a self-join where the library uses frames,
one condition per element where the library compiles a mapping.
"""

from __future__ import annotations

from snaplevel.registry.tables import (
    CHANGED_ID_SQL, CONTINENTS, DUMP_FILES, KINGDOM_OF, LAST_YEAR, MEDIA_COLUMNS, RECORD_COLUMNS, WITHHELD,
    YEARLY_COLUMNS, YEARS, turned,
)

ORACLES: dict[str, str] = {}


def _p(column: str, *more: str) -> str:
    """Column is present: not NULL, not empty, not a sentinel."""
    values = ", ".join(f"'{v}'" for v in ("", "unknown:undigitized", *more))
    return f"({column} IS NOT NULL AND {column} NOT IN ({values}))"


def _clean(column: str, *more: str) -> str:
    return f"CASE WHEN {_p(column, *more)} THEN {column} END"


_LAT_LON = f"{_p('decimalLatitude')} AND {_p('decimalLongitude')}"
FLAGS = {
    "mids:MIDS0PhysicalSpecimenID": _p("catalogNumber"),
    "mids:MIDS0Organization": f"{_p('ownerInstitutionCode')} OR {_p('institutionID')}"
    f" OR {_p('institutionCode')}",
    "mids:MIDS1Name": f"{_p('scientificName', 'incertae sedis')} OR {_p('taxonKey', '0')}",
    "mids:MIDS1ObjectType": _p("preparations"),
    "mids:MIDS1License": _p("license"),
    "mids:MIDS1Modified": _p("modified"),
    "mids:MIDS2QualitativeLocation": f"{_p('locality')} OR {_p('countryCode')}",
    "mids:MIDS2QuantitativeLocation": _LAT_LON,
    "mids:MIDS2CollectingAgent": f"{_p('recordedBy')} OR {_p('recordedByID')}",
    "mids:MIDS2DateCollected": _p("year"),
    "mids:MIDS2CollectingNumber": f"{_p('fieldNumber')} OR {_p('recordNumber')}",
    "mids:MIDS2Media": _p("multimediaIdentifier"),
    "mids:MIDS3GeographicalLocalityID": f"{_LAT_LON} AND {_p('coordinatePrecision')}"
    f" AND {_p('coordinateUncertaintyInMeters')} AND {_p('geodeticDatum')}",
    "mids:MIDS3OrganizationID": _p("institutionID"),
    "mids:MIDS3CollectingAgentID": _p("recordedByID"),
    "mids:MIDS3IdentifiedAsID": _p("taxonKey", "0"),
    "mids:MIDS3IdentifiedByID": _p("identifiedByID"),
    "mids:MIDS3MediaID": _p("multimediaIdentifier"),
}


def _all(top: int) -> str:
    return " AND ".join(f'"{f}"' for f in FLAGS if int(f[len("mids:MIDS")]) <= top)


_YEAR_TEXT = _clean("year")
_YEAR = (
    f"TRY_CAST(CASE WHEN regexp_full_match({_YEAR_TEXT}, '-?[0-9]+') THEN {_YEAR_TEXT} END"
    " AS SMALLINT)"
)
_RECORDS = f"""
records AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
    {", ".join(f"{sql} AS {c}" for c, sql in RECORD_COLUMNS.items())}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
media AS (SELECT {", ".join(f"{sql} AS {c}" for c, sql in MEDIA_COLUMNS.items())} FROM lineitem),
one_media AS (
  SELECT gbifID, min(identifier) AS multimediaIdentifier FROM media
  WHERE identifier IS NOT NULL GROUP BY gbifID),
years AS (SELECT * FROM (VALUES {", ".join(f"({y}, {i})" for i, y in enumerate(YEARS))})
  AS t(snapshot_year, idx)),
raw AS (
  SELECT r.* REPLACE (
      {", ".join(f"{sql.format(Y='y.snapshot_year')} AS {c}"
                 for c, sql in YEARLY_COLUMNS.items() if c in RECORD_COLUMNS)}),
    {", ".join(f"{sql.format(Y='y.snapshot_year')} AS {c}"
               for c, sql in YEARLY_COLUMNS.items() if c not in RECORD_COLUMNS)},
    m.multimediaIdentifier, y.snapshot_year, y.idx
  FROM records r JOIN years y ON year(o_orderdate) < y.snapshot_year
  LEFT JOIN one_media m ON r.gbifID = m.gbifID
  WHERE NOT ({WITHHELD.format(Y="y.snapshot_year")}))"""

_SCORED = f"""{_RECORDS},
flagged AS (
  SELECT CAST(gbifID AS BIGINT) AS gbifID, datasetKey,
    {", ".join(f'({sql}) AS "{f}"' for f, sql in FLAGS.items())},
    {_YEAR} AS year, {_clean("countryCode")} AS countryCode, phylum,
    CAST(snapshot_year AS INTEGER) AS snapshot_year, idx
  FROM raw),
scored_idx AS (
  SELECT gbifID, datasetKey,
    CAST(CASE WHEN {_all(3)} THEN 3 WHEN {_all(2)} THEN 2 WHEN {_all(1)} THEN 1 WHEN {_all(0)} THEN 0
         ELSE -1 END AS TINYINT) AS MIDS_level,
    {", ".join(f'"{f}"' for f in FLAGS)}, year, countryCode, phylum, snapshot_year, idx
  FROM flagged),
scored AS (SELECT * EXCLUDE (idx) FROM scored_idx),
kingdoms AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{k}')" for p, k in KINGDOM_OF)})
  AS t(phylum, kingdom)),
continents AS (
  SELECT n_name AS countryCode, r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey),
with_new AS (
  SELECT cur.*, py.snapshot_year AS previous_year,
    NOT EXISTS (SELECT 1 FROM scored_idx prev
                WHERE prev.gbifID IS NOT DISTINCT FROM cur.gbifID AND prev.idx = cur.idx - 1)
      AS is_new
  FROM scored_idx cur LEFT JOIN years py ON py.idx = cur.idx - 1),
newcomers AS (SELECT * FROM with_new WHERE idx > 0 AND is_new),
sql_newcomers AS (
  SELECT * FROM scored_idx cur WHERE idx > 0 AND NOT EXISTS (
    SELECT 1 FROM scored_idx prev WHERE prev.gbifID = cur.gbifID AND prev.idx = cur.idx - 1)),
pairs AS (
  SELECT o.gbifID, o.datasetKey, o.idx, o.snapshot_year AS from_year, n.snapshot_year AS to_year,
    o.MIDS_level AS MIDS_level_old, n.MIDS_level AS MIDS_level_new
  FROM scored_idx o JOIN scored_idx n
    ON o.gbifID IS NOT DISTINCT FROM n.gbifID AND n.idx = o.idx + 1),
counted AS (
  SELECT concat(from_year, '-', to_year) AS interval, MIDS_level_old, MIDS_level_new,
    count(*) AS n_records
  FROM pairs GROUP BY ALL),
cohorts AS (
  SELECT c.snapshot_year AS cohort_year, s.snapshot_year, s.MIDS_level, count(*) AS n
  FROM newcomers c JOIN scored_idx s
    ON c.gbifID IS NOT DISTINCT FROM s.gbifID AND s.idx >= c.idx GROUP BY ALL)"""


def _element_rows(source: str, by: str = "", where: str = "") -> str:
    """One row per element of ``source``: total rows and true count, grouped by ``by``."""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{f}' AS flag, count(*) AS total_rows,"
        f' count(*) FILTER (WHERE "{f}") AS true_count FROM {source}{where}{group}'
        for f in FLAGS
    )


def _summary(source: str, by: str = "", where: str = "") -> str:
    lead = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    group = f" GROUP BY {lead}MIDS_level"
    return f"""
  SELECT {lead}total_rows, replace(flag, 'mids:MIDS', '') AS column_name, true_count,
    total_rows - true_count AS false_count,
    (CAST(true_count AS DOUBLE) / total_rows) * 100.0 AS true_percentage
  FROM ({_element_rows(source, by, where)})
  UNION ALL
  SELECT {lead}CAST(sum(n) OVER ({over}) AS BIGINT), CAST(MIDS_level AS VARCHAR), n, NULL,
    100.0::DOUBLE * n / sum(n) OVER ({over})
  FROM (SELECT {lead}MIDS_level, count(*) AS n FROM {source}{where}{group})"""


def oracle(name: str, select: str, scored: bool = True) -> None:
    ORACLES[name] = f"WITH {_SCORED if scored else _RECORDS} {select}"


def _pct(part: str, over: str) -> str:
    return f"100.0::DOUBLE * {part} / sum({part}) OVER ({over})"


# --- sources and sinks ------------------------------------------------------------------------

_QUOTED = (
    "CASE WHEN phylum = '2-HIGH' AND locality IS NOT NULL THEN '\"' || locality ELSE locality END"
)
_SHORT = "(coalesce(phylum, '') = '5-LOW' AND basisOfRecord = 'HUMAN_OBSERVATION')"
_N = len(RECORD_COLUMNS)
_DUMP_FIELDS = {c: _QUOTED if c == "locality" else c for c in RECORD_COLUMNS}
_ACCEPTED = [f"nullif({sql}, '') AS {c}" for c, sql in _DUMP_FIELDS.items()]

oracle(
    "read_dwca_text",
    f"SELECT {', '.join(_ACCEPTED)} FROM records WHERE NOT {_SHORT}",
    scored=False,
)
def _short_line(columns: list[str]) -> str:
    fields = ", ".join(f"coalesce({_DUMP_FIELDS[c]}, '')" for c in columns[:-1])
    return f"concat_ws(chr(9), {fields})"


oracle(
    "capture_rejects",
    f"""SELECT CASE WHEN o_orderkey % {DUMP_FILES} = 0 THEN {_short_line(turned(list(RECORD_COLUMNS)))}
      ELSE {_short_line(list(RECORD_COLUMNS))} END AS line,
      CAST({_N - 1} AS INTEGER) AS n_fields, CAST({_N} AS INTEGER) AS n_expected
    FROM records WHERE {_SHORT}""",
    scored=False,
)
for _name in ("reject_audit", "ingest_split"):
    oracle(
        _name,
        f"""SELECT count(*) FILTER (WHERE NOT {_SHORT}) AS accepted,
          count(*) FILTER (WHERE {_SHORT}) AS rejected,
          CAST(count(*) FILTER (WHERE {_SHORT}) AS DOUBLE) / count(*) AS rejected_ratio
        FROM records""",
        scored=False,
    )
oracle("read_multimedia_text", "SELECT gbifID, identifier FROM media", scored=False)
oracle(
    "write_partitioned",
    "SELECT basisOfRecord, count(*) AS n FROM records GROUP BY ALL",
    scored=False,
)
oracle(
    "read_partitioned",
    f"SELECT {', '.join(RECORD_COLUMNS)} FROM records WHERE basisOfRecord = 'PRESERVED_SPECIMEN'",
    scored=False,
)
ORACLES["scan_snapshot"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  CAST({LAST_YEAR} AS INTEGER) AS snapshot_year FROM orders"""
oracle(
    "scan_projected",
    f"SELECT {', '.join(c for c in RECORD_COLUMNS if c != 'basisOfRecord')} FROM records",
    scored=False,
)
_ROWS_PER_YEAR = "SELECT snapshot_year, count(*) AS n FROM scored GROUP BY ALL"
for _name in ("union_snapshots", "sort_snapshots", "write_scored", "row_counts"):
    oracle(_name, _ROWS_PER_YEAR)
oracle(
    "discover_snapshots",
    "SELECT DISTINCT snapshot_year, concat('dump=', snapshot_year, '-01-01') AS name FROM scored",
)
for _name in ("score_batches", "stream_score"):
    oracle(_name, "SELECT * FROM scored")
oracle(
    "stream_level_counts",
    "SELECT snapshot_year, MIDS_level, count(*) AS n FROM scored GROUP BY ALL",
)
oracle(
    "select_snapshot",
    """SELECT gbifID, datasetKey, MIDS_level, snapshot_year FROM scored
    WHERE snapshot_year = 1998""",
)
oracle(
    "read_summaries",
    f"""SELECT total_rows, column_name, true_count, false_count, true_percentage,
      snapshot_year AS year FROM ({_summary("scored", "snapshot_year")})""",
)
oracle(
    "read_mapping",
    f"""SELECT snapshot_year, MIDS_level, n, {_pct("n", "PARTITION BY snapshot_year")} AS percent
    FROM (SELECT snapshot_year, MIDS_level, count(*) AS n FROM scored GROUP BY ALL)""",
)
oracle(
    "read_registry",
    """SELECT snapshot_year, concat('key-', snapshot_year) AS key,
      concat('10.0000/dl.', snapshot_year) AS doi, count(*) AS n FROM scored GROUP BY ALL""",
)
_LAST_SUMMARY = _summary("scored", where=f" WHERE snapshot_year = {LAST_YEAR}")
for _name in ("write_tsv", "snapshot_summary"):
    oracle(_name, _LAST_SUMMARY)
_TREND = f"""SELECT snapshot_year, replace(flag, 'mids:', '') AS element, true_count, total_rows
  FROM ({_element_rows("scored", "snapshot_year")})"""
for _name in ("write_csv", "element_trend_counts"):
    oracle(_name, f"SELECT snapshot_year, element, true_count FROM ({_TREND})")
for _name in ("write_json", "dataset_counts"):
    oracle(
        _name, "SELECT snapshot_year, datasetKey, count(*) AS n FROM scored GROUP BY ALL"
    )

# --- projections, predicates, scalar functions ------------------------------------------------

oracle(
    "null_sentinels",
    f"""SELECT gbifID, {_clean("scientificName", "incertae sedis")} AS scientificName,
      {_clean("taxonKey", "0")} AS taxonKey, {_clean("year")} AS year,
      {_clean("countryCode")} AS countryCode, {_clean("institutionID")} AS institutionID,
      CAST(snapshot_year AS INTEGER) AS snapshot_year FROM raw""",
    scored=False,
)
oracle(
    "add_missing_columns",
    """SELECT gbifID, locality, CAST(NULL AS VARCHAR) AS footprintWKT,
      CAST(NULL AS VARCHAR) AS footprintSRS FROM records""",
    scored=False,
)
oracle(
    "media_flag_to_text",
    """SELECT gbifID, CASE WHEN identifier IS NOT NULL THEN 'T' END AS multimedia, count(*) AS n
    FROM media GROUP BY ALL""",
    scored=False,
)
oracle(
    "compile_rules",
    f"""SELECT gbifID, snapshot_year, {", ".join(f'"{f}"' for f in FLAGS)} FROM scored""",
)
oracle("all_of_row", f"SELECT gbifID, snapshot_year, ({_all(1)}) AS complete FROM scored")
ORACLES["strip_class_prefix"] = (
    "SELECT page_id, regexp_replace(url, '^.*:', '') AS rest FROM pages"
)
oracle("score_level", "SELECT gbifID, snapshot_year, MIDS_level FROM scored")
oracle(
    "cast_output",
    """SELECT gbifID, datasetKey, CAST(-1 AS TINYINT) AS MIDS_level, year, countryCode, phylum,
      snapshot_year FROM scored""",
)
oracle(
    "cast_casualties",
    f"""SELECT CAST(0 AS BIGINT) AS gbifID,
      count(*) FILTER (WHERE {_p("year")} AND {_YEAR} IS NULL) AS year FROM raw""",
    scored=False,
)
oracle(
    "select_rename",
    "SELECT gbifID, datasetKey, MIDS_level AS MIDS_from, snapshot_year FROM scored",
)
_WEIGHTED = """SELECT gbifID, CAST(idx AS INTEGER) AS snapshot_idx, MIDS_level_old, MIDS_level_new,
  count(*) AS n FROM pairs"""
oracle("filter_eq", f"{_WEIGHTED} WHERE MIDS_level_old = 1 AND MIDS_level_new = 0 GROUP BY ALL")
oracle("filter_neq", f"{_WEIGHTED} WHERE MIDS_level_old <> MIDS_level_new GROUP BY ALL")
oracle(
    "filter_lt",
    """SELECT gbifID, datasetKey, from_year, to_year, MIDS_level_old, MIDS_level_new,
      CAST(MIDS_level_new AS INTEGER) - CAST(MIDS_level_old AS INTEGER) AS change, count(*) AS n
    FROM pairs WHERE MIDS_level_new < MIDS_level_old GROUP BY ALL""",
)
oracle(
    "filter_in",
    """SELECT snapshot_year, phylum, count(*) AS n FROM scored
    WHERE phylum IN (SELECT phylum FROM kingdoms WHERE kingdom = 'Animalia') GROUP BY ALL""",
)
oracle(
    "filter_not_null",
    """SELECT snapshot_year, count(*) AS n FROM scored WHERE countryCode IS NOT NULL
    GROUP BY ALL""",
)
oracle(
    "subset_levels",
    f"""SELECT snapshot_year, MIDS_level, n, {_pct("n", "PARTITION BY snapshot_year")} AS percent
    FROM (SELECT snapshot_year, MIDS_level, count(*) AS n FROM scored
          WHERE phylum = '3-MEDIUM' GROUP BY ALL)""",
)
_SIZES = """SELECT snapshot_year, datasetKey, count(*) AS n_records,
  CASE WHEN count(*) < 230 THEN 'Small' WHEN count(*) < 250 THEN 'Medium'
       WHEN count(*) < 1000 THEN 'Large' ELSE 'Very Large' END AS size_class
  FROM scored GROUP BY snapshot_year, datasetKey"""
oracle("size_class", _SIZES)
_PERIOD = """CASE WHEN year IS NULL OR year > 2024 THEN 'Unknown' WHEN year < 1800 THEN 'Pre-1800'
  WHEN year < 1900 THEN '1800-1899' WHEN year < 1950 THEN '1900-1949'
  WHEN year < 2000 THEN '1950-1999' ELSE '2000-2024' END"""
oracle(
    "year_group",
    f"SELECT snapshot_year, {_PERIOD} AS year_group, count(*) AS n FROM scored GROUP BY ALL",
)
oracle(
    "element_group",
    f"""SELECT snapshot_year, element, concat('MIDS ', substr(element, 5, 1)) AS mids_group,
      true_count FROM ({_TREND})""",
)
_LABEL = "concat('MIDS ', MIDS_level_old, ' → MIDS ', MIDS_level_new)"
_DIRECTION = "CASE WHEN MIDS_level_new > MIDS_level_old THEN 'Increase' ELSE 'Decrease' END"
oracle("transition_label", f"SELECT *, {_LABEL} AS transition FROM counted")
oracle(
    "change_status",
    """SELECT *, CASE WHEN MIDS_level_old = MIDS_level_new THEN 'Unchanged' ELSE 'Changed' END
      AS status FROM counted""",
)
oracle(
    "change_direction",
    f"SELECT *, {_DIRECTION} AS direction FROM counted WHERE MIDS_level_old <> MIDS_level_new",
)
_CHANGE = "CAST(MIDS_level_new AS INTEGER) - CAST(MIDS_level_old AS INTEGER)"
oracle(
    "level_change", f"SELECT *, {_CHANGE} AS change, abs({_CHANGE}) AS drop_size FROM counted"
)
oracle(
    "interval_label",
    "SELECT interval, CAST(sum(n_records) AS BIGINT) AS n FROM counted GROUP BY interval",
)
oracle(
    "strip_label",
    f"""SELECT replace(flag, 'mids:', '') AS element, replace(flag, 'mids:MIDS', '') AS label,
      true_count FROM ({_element_rows("scored")})""",
)
oracle(
    "split_label",
    f"""SELECT substr(flag, 10, 1) AS level, substr(flag, 11) AS element, true_count
    FROM ({_element_rows("scored")})""",
)
oracle(
    "separate_key",
    """SELECT concat(snapshot_year, ':', MIDS_level) AS xlab, snapshot_year AS year,
      CASE WHEN MIDS_level = -1 THEN '<0' ELSE CAST(MIDS_level AS VARCHAR) END AS level,
      count(*) AS n FROM scored GROUP BY ALL""",
)


def _percent_label(x: str) -> str:
    """The decimal with one digit that is nearest, ties to the even digit; a zero digit is not shown.

    Of the three decimals around the value the nearest one is taken, by distance and then by parity.
    """
    around = f"[floor({x} * 10) - 1, floor({x} * 10), floor({x} * 10) + 1]"
    keys = f"list_transform({around}, lambda t: [abs({x} - t / 10.0::DOUBLE), abs(t % 2), t])"
    tenths = f"CAST(list_sort({keys})[1][3] AS BIGINT)"
    whole, digit = f"{tenths} // 10", f"{tenths} % 10"
    return f"CASE WHEN {digit} = 0 THEN format('{{}}%', {whole}) ELSE format('{{}}.{{}}%', {whole}, {digit}) END"


oracle(
    "percent_label",
    f"""SELECT snapshot_year, datasetKey, MIDS_level, n, {_percent_label("x")} AS label
    FROM (SELECT *, {_pct("n", "PARTITION BY snapshot_year, datasetKey")} AS x
          FROM (SELECT snapshot_year, datasetKey, MIDS_level, count(*) AS n FROM scored
                GROUP BY ALL))""",
)
ORACLES["parse_snapshot_year"] = (
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL"
)
_NAME = "p_name || ' ' || p_brand || ' ' || p_type"
# Pieces of ten characters by their positions; all but a last, shorter one end in a hyphen.
ORACLES["wrap_label"] = f"""SELECT p_partkey, array_to_string([
    CASE WHEN length(substr(name, 10 * i + 1, 10)) = 10 THEN concat(substr(name, 10 * i + 1, 10), '-')
    ELSE substr(name, 10 * i + 1, 10) END
    for i in range(0, (length(name) + 9) // 10)], chr(10)) AS label
  FROM (SELECT p_partkey, {_NAME} AS name FROM part)"""
oracle(
    "level_order",
    f"""SELECT snapshot_year, size_class, count(*) AS n,
      CAST(CASE size_class WHEN 'Small' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Large' THEN 3 ELSE 4 END
           AS BIGINT) AS position
    FROM ({_SIZES}) GROUP BY snapshot_year, size_class""",
)

# --- joins ------------------------------------------------------------------------------------

oracle(
    "join_media",
    """SELECT r.gbifID, datasetKey, phylum, multimediaIdentifier
    FROM records r LEFT JOIN one_media m ON r.gbifID = m.gbifID""",
    scored=False,
)
oracle(
    "media_join",
    f"""SELECT {", ".join(f"r.{c}" for c in RECORD_COLUMNS)}, multimediaIdentifier
    FROM records r LEFT JOIN one_media m ON r.gbifID = m.gbifID""",
    scored=False,
)
oracle(
    "join_media_raw",
    """SELECT r.gbifID, datasetKey, phylum, identifier AS mediaIdentifier
    FROM records r LEFT JOIN media m ON r.gbifID = m.gbifID""",
    scored=False,
)
oracle("any_identifier", "SELECT gbifID, multimediaIdentifier FROM one_media", scored=False)
oracle(
    "new_records",
    "SELECT * EXCLUDE (idx) FROM sql_newcomers WHERE snapshot_year = 1999",
)
oracle(
    "new_rows_of_series", "SELECT gbifID, snapshot_year, MIDS_level, datasetKey FROM sql_newcomers"
)
oracle(
    "cohort_ids",
    "SELECT gbifID, snapshot_year AS cohort_year, count(*) AS n FROM newcomers GROUP BY ALL",
)
oracle(
    "match_snapshots",
    """SELECT gbifID, datasetKey, from_year, to_year, MIDS_level_old, MIDS_level_new, count(*) AS n
    FROM pairs GROUP BY ALL""",
)
_BASE = """SELECT s.snapshot_year, s.MIDS_level, count(*) AS n
  FROM scored_idx b JOIN scored_idx s ON b.gbifID IS NOT DISTINCT FROM s.gbifID
  WHERE b.idx = 0 GROUP BY ALL"""
oracle("follow_base_cohort", _BASE)
oracle("follow_cohorts", "SELECT * FROM cohorts")
oracle(
    "join_size_class",
    f"""SELECT s.gbifID, s.datasetKey, s.MIDS_level, s.snapshot_year, n_records, size_class
    FROM scored s JOIN ({_SIZES}) z
      ON s.datasetKey IS NOT DISTINCT FROM z.datasetKey AND s.snapshot_year = z.snapshot_year""",
)
oracle(
    "join_totals",
    f"SELECT snapshot_year, element, true_count, total_rows AS total_records FROM ({_TREND})",
)
oracle(
    "join_continent",
    """SELECT s.countryCode, s.snapshot_year, count(*) AS n, continent FROM scored s
    LEFT JOIN continents c ON s.countryCode = c.countryCode GROUP BY ALL""",
)
oracle(
    "join_kingdom",
    """SELECT gbifID, s.phylum, MIDS_level, snapshot_year FROM scored s
    JOIN kingdoms k ON s.phylum = k.phylum WHERE kingdom = 'Animalia'""",
)

# --- aggregations, windows, sorts, reshaping --------------------------------------------------

oracle("level_distribution", ORACLES["read_mapping"].split(_SCORED, 1)[1])
oracle(
    "element_counts",
    f"""SELECT snapshot_year, count(*) AS total_rows,
      {", ".join(f'count(*) FILTER (WHERE "{f}") AS "{f}"' for f in FLAGS)}
    FROM scored GROUP BY snapshot_year""",
)
oracle(
    "snapshot_totals", "SELECT snapshot_year, count(*) AS total_records FROM scored GROUP BY ALL"
)
oracle(
    "count_by_key", "SELECT snapshot_year, phylum, count(*) AS n FROM scored GROUP BY ALL"
)
_LEVELS = f"""SELECT year, level, true_count, true_percentage,
    CAST(row_number() OVER (ORDER BY year, MIDS_level) AS INTEGER) AS xpos
  FROM (SELECT snapshot_year AS year, MIDS_level, n AS true_count,
          CASE WHEN MIDS_level = -1 THEN '<0' ELSE CAST(MIDS_level AS VARCHAR) END AS level,
          {_pct("n", "PARTITION BY snapshot_year")} AS true_percentage
        FROM (SELECT snapshot_year, MIDS_level, count(*) AS n FROM scored GROUP BY ALL))"""
_TOTALS = f"""SELECT year, CAST(sum(true_count) AS BIGINT) AS total, min(xpos) AS xmin,
    max(xpos) AS xmax, (min(xpos) + max(xpos)) / 2.0::DOUBLE AS mid
  FROM ({_LEVELS}) GROUP BY year"""
for _name in ("year_totals", "records_over_time"):
    oracle(_name, _TOTALS)
for _name in ("levels_over_time", "sort_levels"):
    oracle(_name, _LEVELS)
oracle("row_position", f"SELECT year, level, xpos FROM ({_LEVELS})")
oracle(
    "distinct_elements",
    f"""SELECT level, count(*) AS n FROM (SELECT DISTINCT substr(flag, 10, 1) AS level,
      substr(flag, 11) AS element FROM ({_element_rows("scored")})) GROUP BY level""",
)
_DECLINES = "SELECT * FROM pairs WHERE MIDS_level_new < MIDS_level_old"
_BY_INTERVAL = f"""SELECT from_year, to_year, datasetKey, count(*) AS n_declined_specimens
  FROM ({_DECLINES}) GROUP BY ALL"""
oracle(
    "column_total",
    f"""SELECT *, CAST(sum(n_declined_specimens) OVER (PARTITION BY from_year, to_year) AS BIGINT)
      AS total_declined FROM ({_BY_INTERVAL})""",
)
oracle(
    "repeated_ids",
    """SELECT snapshot_year, total_rows, distinct_ids, total_rows - distinct_ids AS surplus_rows
    FROM (SELECT snapshot_year, count(*) AS total_rows,
            count(DISTINCT coalesce(gbifID, -1)) AS distinct_ids FROM scored GROUP BY ALL)""",
)
oracle(
    "share_of_total",
    f"""SELECT MIDS_level, n, {_pct("n", "")} AS percent
    FROM (SELECT MIDS_level, count(*) AS n FROM scored GROUP BY ALL)""",
)
oracle(
    "share_of_group",
    f"""SELECT phylum, MIDS_level, n, {_pct("n", "PARTITION BY phylum")} AS percent
    FROM (SELECT phylum, MIDS_level, count(*) AS n FROM scored GROUP BY ALL)""",
)
oracle(
    "largest_per_group",
    """SELECT snapshot_year, datasetKey, n
    FROM (SELECT snapshot_year, datasetKey, count(*) AS n FROM scored
          WHERE datasetKey IS NOT NULL GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY snapshot_year ORDER BY n DESC, datasetKey) = 1""",
)
oracle(
    "previous_snapshot",
    """SELECT snapshot_year, CASE WHEN idx > 0 THEN is_new END AS is_new, count(*) AS n
    FROM with_new GROUP BY ALL""",
)
_RANKED = f"""SELECT datasetKey, count(*) AS n_declined_specimens FROM ({_DECLINES})
  GROUP BY datasetKey"""
for _name in ("rank_declines", "declining_datasets"):
    oracle(_name, _RANKED)
for _name in ("rank_declines_by_interval", "declining_datasets_by_interval"):
    oracle(_name, _BY_INTERVAL)


def _top(old: int, new: int, from_year: int, to_year: int) -> str:
    name = f"records_{old}_to_{new}"
    return f"""SELECT datasetKey, n AS "{name}",
      {_pct("n", "")} AS "pct_of_all_{old}_to_{new}"
    FROM (SELECT o.datasetKey, count(*) AS n FROM scored o
          JOIN scored w ON o.gbifID IS NOT DISTINCT FROM w.gbifID
          WHERE o.snapshot_year = {from_year} AND w.snapshot_year = {to_year}
            AND o.MIDS_level = {old} AND w.MIDS_level = {new} GROUP BY o.datasetKey)
    ORDER BY n DESC, datasetKey NULLS FIRST LIMIT 10"""


oracle("top_declining", _top(0, -1, 2000, 2001))
oracle("top_level_drop", _top(1, 0, 1998, 1999))


def _kingdom_summary(kingdom: str, by: str = "", extra: str = "") -> str:
    where = f""" WHERE phylum IN (SELECT phylum FROM kingdoms WHERE kingdom = '{kingdom}'){extra}"""
    return _summary("scored", by, where)


_LAST_ONLY = f" AND snapshot_year = {LAST_YEAR}"
oracle(
    "union_groups",
    " UNION ALL ".join(
        f"SELECT *, '{k}' AS kingdom FROM ({_kingdom_summary(k, 'snapshot_year')})"
        for k in ("Animalia", "Plantae", "Fungi")
    ),
)
oracle("stack_elements_levels", _summary("scored", "snapshot_year"))
_TABLE = f"""SELECT snapshot_year, total_rows, replace(flag, 'mids:MIDS', '') AS column_name,
  true_count FROM ({_element_rows("scored", "snapshot_year")})"""
oracle("unpivot_elements", _TABLE)
oracle(
    "true_false_long",
    f"""SELECT snapshot_year, total_rows, column_name, '1' AS achieved, true_count FROM ({_TABLE})
    UNION ALL SELECT snapshot_year, total_rows, column_name, '0', total_rows - true_count
    FROM ({_TABLE})""",
)

# --- analyses ---------------------------------------------------------------------------------

oracle("score_records", "SELECT * FROM scored")
oracle("snapshot_summary_for_kingdom", _kingdom_summary("Animalia", "snapshot_year"))
oracle(
    "new_record_levels",
    f"""SELECT MIDS_level, n, {_pct("n", "PARTITION BY snapshot_year")} AS percent,
      snapshot_year AS year
    FROM (SELECT snapshot_year, MIDS_level, count(*) AS n FROM sql_newcomers GROUP BY ALL)""",
)
oracle(
    "element_trend_fraction",
    f"""SELECT snapshot_year, element, true_count, total_rows AS total_records,
      CAST(true_count AS DOUBLE) / total_rows AS true_pct,
      concat('MIDS ', substr(element, 5, 1)) AS mids_group FROM ({_TREND})""",
)
oracle(
    "new_record_elements",
    f"""SELECT concat(previous_year, '-', snapshot_year) AS interval, snapshot_year AS year,
      replace(flag, 'mids:', '') AS element, true_count, total_rows AS total_new,
      CAST(true_count AS DOUBLE) / total_rows AS true_pct
    FROM ({_element_rows("newcomers", "previous_year, snapshot_year")})""",
)
oracle(
    "change_status_by_interval",
    """SELECT interval, status, n, CAST(sum(n) OVER w AS BIGINT) AS total,
      CAST(n AS DOUBLE) / sum(n) OVER w AS percent
    FROM (SELECT interval, CASE WHEN MIDS_level_old = MIDS_level_new THEN 'Unchanged'
            ELSE 'Changed' END AS status, CAST(sum(n_records) AS BIGINT) AS n
          FROM counted GROUP BY ALL)
    WINDOW w AS (PARTITION BY interval)""",
)
oracle(
    "base_cohort_levels",
    f"""SELECT MIDS_level, n, snapshot_year, CAST(sum(n) OVER w AS BIGINT) AS total_records,
      CAST(n AS DOUBLE) / sum(n) OVER w AS pct_records
    FROM ({_BASE}) WINDOW w AS (PARTITION BY snapshot_year)""",
)
_COHORT = f"""SELECT cohort_year, snapshot_year, MIDS_level, n,
    CAST(sum(n) OVER w AS BIGINT) AS total_records, CAST(n AS DOUBLE) / sum(n) OVER w AS pct_records
  FROM cohorts WHERE cohort_year < {LAST_YEAR}
  WINDOW w AS (PARTITION BY cohort_year, snapshot_year)"""
oracle("intake_cohort_levels", _COHORT)
oracle("cohort_entry_levels", f"SELECT * FROM ({_COHORT}) WHERE cohort_year = snapshot_year")
_TRANSITIONS = f"""SELECT interval, {_LABEL} AS transition, {_DIRECTION} AS direction, n_records,
    total_records, 100.0::DOUBLE * n_records / total_records AS pct_of_all_records,
    {_pct("n_records", "PARTITION BY interval")} AS pct_of_changes
  FROM (SELECT *, CAST(sum(n_records) OVER (PARTITION BY interval) AS BIGINT) AS total_records
        FROM counted)
  WHERE MIDS_level_old <> MIDS_level_new"""
_LABELLED = f"""SELECT *, {_percent_label("pct_of_changes")} AS label FROM ({_TRANSITIONS})"""
oracle("level_transitions", _LABELLED)
oracle(
    "largest_transition",
    f"""SELECT * FROM ({_LABELLED}) QUALIFY row_number() OVER
      (PARTITION BY interval ORDER BY n_records DESC, transition) = 1""",
)
oracle(
    "direction_summary",
    f"""SELECT direction, interval, n_records,
      100.0::DOUBLE * n_records / total_records AS pct_of_all_records,
      {_pct("n_records", "PARTITION BY interval")} AS pct_of_changes
    FROM (SELECT direction, interval, CAST(sum(n_records) AS BIGINT) AS n_records, total_records
          FROM ({_TRANSITIONS}) GROUP BY direction, interval, total_records)""",
)
oracle(
    "decline_severity",
    f"""SELECT datasetKey, count(*) AS specimens_declined,
      CAST(sum(MIDS_level_old::INT - MIDS_level_new::INT) AS DOUBLE) / count(*) AS mean_drop,
      max(MIDS_level_old::INT - MIDS_level_new::INT) AS max_drop
    FROM ({_DECLINES}) GROUP BY datasetKey""",
)
oracle(
    "levels_by_dataset_size",
    f"""SELECT size_class, MIDS_level, n_records,
      CAST(n_records AS DOUBLE) / sum(n_records) OVER (PARTITION BY snapshot_year, size_class)
        AS pct_records, snapshot_year
    FROM (SELECT size_class, s.MIDS_level, s.snapshot_year, count(*) AS n_records
          FROM scored s JOIN ({_SIZES}) z ON s.datasetKey IS NOT DISTINCT FROM z.datasetKey
            AND s.snapshot_year = z.snapshot_year GROUP BY ALL)""",
)


def _completeness(source: str, group: str, false_count: bool = False) -> str:
    extra = ", total_rows - true_count AS false_count" if false_count else ""
    return f"""SELECT {group}, snapshot_year, replace(flag, 'mids:MIDS', '') AS column_name,
      true_count, total_rows, 100.0::DOUBLE * true_count / total_rows AS true_percentage{extra}
    FROM ({_element_rows(source, f"{group}, snapshot_year")})"""


_WITH_KINGDOM = (
    "(SELECT s.*, kingdom FROM scored s JOIN kingdoms k ON s.phylum = k.phylum"
    " WHERE kingdom IN ('Animalia', 'Plantae', 'Fungi'){})"
)
oracle("kingdom_completeness", _completeness(_WITH_KINGDOM.format(""), "kingdom"))
oracle(
    "kingdom_completeness_one_snapshot",
    _completeness(_WITH_KINGDOM.format(_LAST_ONLY), "kingdom", false_count=True),
)
_CONTINENT = _completeness(
    "(SELECT s.*, continent FROM scored s JOIN continents c ON s.countryCode = c.countryCode"
    f" WHERE continent IN {CONTINENTS})",
    "continent",
)
for _name in ("continent_completeness", "read_lookup_csv"):
    oracle(_name, _CONTINENT)
oracle(
    "period_completeness",
    _completeness(f"(SELECT *, {_PERIOD} AS year_group FROM scored)", "year_group"),
)
oracle(
    "phylum_counts",
    f"""SELECT s.phylum, count(*) AS n, kingdom FROM scored s
    LEFT JOIN kingdoms k ON s.phylum = k.phylum WHERE snapshot_year = {LAST_YEAR} GROUP BY ALL""",
)

# --- the history table ------------------------------------------------------------------------

_MASK = " + ".join(f'CASE WHEN "{f}" THEN {1 << i} ELSE 0 END' for i, f in enumerate(FLAGS))
# Neighbouring snapshots with the same number of equal rows: their index less their rank is the same.
oracle(
    "history_runs",
    f"""SELECT gbifID, datasetKey, MIDS_level, flags, n, min(snapshot_year) AS first_year,
      max(snapshot_year) AS last_year
    FROM (SELECT *, idx - row_number() OVER
            (PARTITION BY gbifID, datasetKey, MIDS_level, flags, n ORDER BY idx) AS run
          FROM (SELECT gbifID, datasetKey, MIDS_level, CAST({_MASK} AS BIGINT) AS flags, idx,
                  snapshot_year, count(*) AS n FROM scored_idx GROUP BY ALL))
    GROUP BY gbifID, datasetKey, MIDS_level, flags, n, run""",
)
oracle(
    "history_levels",
    "SELECT snapshot_year, datasetKey, MIDS_level, count(*) AS n FROM scored GROUP BY ALL",
)
for _name, _same in (
    ("history_transitions", "level_transitions"),
    ("history_decline_severity", "decline_severity"),
    ("history_level_drop", "top_level_drop"),
    ("history_base_cohort", "base_cohort_levels"),
    ("history_intake_cohorts", "intake_cohort_levels"),
    ("history_new_levels", "new_record_levels"),
    ("history_new_elements", "new_record_elements"),
):
    ORACLES[_name] = ORACLES[_same]

# --- presence masks ---------------------------------------------------------------------------

_SHOWN = {
    "catalogNumber": (), "institutionID": (), "taxonKey": ("0",), "locality": (), "year": (),
    "recordNumber": (), "multimediaIdentifier": (),
}
oracle(
    "presence_masks",
    f"""SELECT CAST(gbifID AS BIGINT) AS gbifID, CAST(snapshot_year AS INTEGER) AS snapshot_year,
      {", ".join(f"CAST({_p(c, *more)} AS INTEGER) AS has_{c}" for c, more in _SHOWN.items())} FROM raw""",
    scored=False,
)


def _elements(without: tuple[str, ...] = (), **changed: str | int) -> list[tuple[int, str, str]]:
    """(level, element, condition), with other conditions or levels for some elements."""
    out = []
    for flag, sql in FLAGS.items():
        level, name = int(flag[9]), flag[10:]
        other = changed.get(name)
        if name not in without:
            out.append((other if isinstance(other, int) else level, name, other if isinstance(other, str) else sql))
    return out


_LEVEL_3 = tuple(f[10:] for f in FLAGS if f[9] == "3")
_THREE = ("License", "Name", "DateCollected")
_SETS = {
    "default": _elements(),
    "no media": _elements(("Media", "MediaID")),
    "three levels": _elements(_LEVEL_3),
    "strict location": _elements(QualitativeLocation=f"{_p('locality')} AND {_p('countryCode')}"),
    "either agent": _elements(
        CollectingAgent=f"{_p('recordedBy')} OR NOT ({_p('recordedByID')} AND {_p('identifiedByID')})"
    ),
    "any date": _elements(DateCollected="year IS NOT NULL AND year <> ''"),
    "three elements": _elements(tuple(f[10:] for f in FLAGS if f[10:] not in _THREE)),
    "moved": _elements(Modified=2, ObjectType=0, IdentifiedByID=1),
}


def _level_of(elements: list[tuple[int, str, str]]) -> str:
    def all_to(top: int) -> str:
        return " AND ".join(f"({sql})" for level, _, sql in elements if level <= top) or "true"

    return f"""CAST(CASE WHEN {all_to(3)} THEN 3 WHEN {all_to(2)} THEN 2 WHEN {all_to(1)} THEN 1
      WHEN {all_to(0)} THEN 0 ELSE -1 END AS TINYINT)"""


_ID_YEAR = "CAST(gbifID AS BIGINT) AS gbifID, CAST(snapshot_year AS INTEGER) AS snapshot_year"
oracle(
    "score_mapping_sets",
    " UNION ALL ".join(
        f"""SELECT {_ID_YEAR}, '{name}' AS mapping, {_level_of(elements)} AS MIDS_level,
          CAST({" + ".join(f"CAST(({sql}) AS INTEGER)" for _, _, sql in elements)} AS INTEGER) AS n_flags FROM raw"""
        for name, elements in _SETS.items()
    ),
    scored=False,
)
oracle(
    "score_masked",
    f"""SELECT {_ID_YEAR}, datasetKey, {_level_of(_SETS["moved"])} AS MIDS_level,
      {", ".join(f'({sql}) AS "mids:MIDS{level}{name}"' for level, name, sql in _SETS["moved"])},
      {_YEAR} AS year, {_clean("countryCode")} AS countryCode, phylum FROM raw""",
    scored=False,
)

# --- repair of broken lines -------------------------------------------------------------------

_BROKEN = "(locality IS NOT NULL AND coalesce(phylum, '') IN ('1-URGENT', '3-MEDIUM'))"
_FED = f"""CASE WHEN locality IS NOT NULL AND phylum = '3-MEDIUM' THEN concat('some', chr(10), 'where')
  WHEN locality IS NOT NULL AND phylum = '1-URGENT' THEN concat('some', chr(10), chr(10), 'where')
  ELSE {_QUOTED} END"""
oracle(
    "repair_lines",
    f"""SELECT {", ".join(f"nullif({_FED if c == 'locality' else c}, '') AS {c}" for c in RECORD_COLUMNS)}
    FROM records WHERE NOT {_SHORT}""",
    scored=False,
)
ORACLES["repair_rejects"] = ORACLES["capture_rejects"]
oracle(
    "repair_audit",
    f"""SELECT count(*) FILTER (WHERE NOT {_SHORT} AND NOT {_BROKEN}) AS accepted,
      count(*) FILTER (WHERE {_BROKEN}) AS repaired,
      CAST(coalesce(sum(CASE phylum WHEN '1-URGENT' THEN 3 ELSE 2 END) FILTER (WHERE {_BROKEN}), 0) AS BIGINT) AS repaired_lines,
      count(*) FILTER (WHERE {_SHORT}) AS rejected FROM records""",
    scored=False,
)

# --- records under another id -----------------------------------------------------------------

_MATCH_COLUMNS = (
    "institutionCode", "catalogNumber", "datasetKey", "scientificName", "recordedBy", "recordNumber", "year", "countryCode",
)
_PASSES = (
    ("catalogue", "true", ("institutionCode", "catalogNumber"), ("datasetKey", "scientificName")),
    ("catalogue", "false", ("institutionCode", "catalogNumber"), ()),
    ("collector", "true", ("recordedBy", "recordNumber", "year"), ("countryCode", "institutionCode")),
    ("collector", "false", ("recordedBy", "recordNumber", "year"), ()),
)


def _match_pass(k: int, keys: tuple[str, ...], agree: tuple[str, ...]) -> str:
    by = ", ".join((*keys, *agree))
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in (*keys, *agree))
    return f"""
numbered{k} AS (
  SELECT *, row_number() OVER (PARTITION BY is_new, {by} ORDER BY id) AS rank FROM left{k}
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in keys)}),
matched{k} AS (
  SELECT o.id AS old_id, n.id AS new_id FROM numbered{k} o JOIN numbered{k} n
  ON NOT o.is_new AND n.is_new AND o.rank = n.rank AND {same}),
left{k + 1} AS (
  SELECT * FROM left{k} WHERE id NOT IN (SELECT old_id FROM matched{k}) AND id NOT IN (SELECT new_id FROM matched{k}))"""


ORACLES["changed_ids"] = f"""WITH {_RECORDS},
sides AS (
  SELECT CAST(gbifID AS BIGINT) AS id, false AS is_new, * EXCLUDE (gbifID) FROM raw WHERE snapshot_year = 1998
  UNION ALL
  SELECT CAST({CHANGED_ID_SQL} AS BIGINT), true, * EXCLUDE (gbifID) FROM raw WHERE snapshot_year = 1999),
cleaned AS (
  SELECT id, is_new, {", ".join(f"{_clean(c)} AS {c}" for c in _MATCH_COLUMNS)} FROM sides WHERE id IS NOT NULL),
left0 AS (
  SELECT * FROM cleaned
  QUALIFY min(is_new) OVER (PARTITION BY id) = max(is_new) OVER (PARTITION BY id) AND row_number() OVER
    (PARTITION BY id ORDER BY {", ".join(f"{c} NULLS FIRST" for c in _MATCH_COLUMNS)}) = 1),
{",".join(_match_pass(k, keys, agree) for k, (_, _, keys, agree) in enumerate(_PASSES))}
{" UNION ALL ".join(f"SELECT old_id, new_id, '{name}' AS rule, {agreed} AS agreed FROM matched{k}" for k, (name, agreed, _, _) in enumerate(_PASSES))}"""

# --- the cube, paths --------------------------------------------------------------------------

for _name, _same in (
    ("cube_kingdoms", "kingdom_completeness"),
    ("cube_continents", "continent_completeness"),
    ("cube_periods", "period_completeness"),
    ("cube_sizes", "levels_by_dataset_size"),
):
    ORACLES[_name] = ORACLES[_same]

_PATHS = """SELECT states, count(*) AS n_records FROM (
    SELECT i.gbifID, list(coalesce(state, '-') ORDER BY y.idx) AS states
    FROM (SELECT DISTINCT gbifID FROM scored_idx) i CROSS JOIN years y LEFT JOIN (
      SELECT gbifID, idx, string_agg(CASE WHEN n = 1 THEN level ELSE concat(level, 'x', n) END, '+' ORDER BY MIDS_level) AS state
      FROM (SELECT gbifID, idx, MIDS_level, CAST(MIDS_level AS VARCHAR) AS level, count(*) AS n FROM scored_idx GROUP BY ALL)
      GROUP BY gbifID, idx) s ON s.gbifID IS NOT DISTINCT FROM i.gbifID AND s.idx = y.idx
    GROUP BY i.gbifID) GROUP BY states"""
oracle("level_paths", f"SELECT array_to_string(states, '>') AS path, n_records FROM ({_PATHS})")
oracle(
    "path_tree",
    f"""SELECT depth, node, parent, n_records, n_records / CAST(sum(n_records) OVER (PARTITION BY depth, parent) AS DOUBLE) AS share
    FROM (SELECT CAST(d AS INTEGER) AS depth, array_to_string(states[1:d], '>') AS node,
            array_to_string(states[1:d - 1], '>') AS parent, CAST(sum(n_records) AS BIGINT) AS n_records
          FROM ({_PATHS}), (SELECT unnest(range(1, {len(YEARS) + 1})) AS d) GROUP BY ALL)""",
)
oracle("path_transitions", "SELECT * FROM counted")

# --- sketches ---------------------------------------------------------------------------------


def _changes(group: str) -> str:
    """Exact counts; the sketches of the test tables hold all ids."""
    return f"""ids AS (SELECT DISTINCT snapshot_year AS y, {group} AS g, gbifID FROM scored WHERE gbifID IS NOT NULL),
pairs_of_years AS (SELECT a.snapshot_year AS f, b.snapshot_year AS t FROM years a JOIN years b ON a.idx < b.idx),
groups AS (SELECT DISTINCT f, t, {group} AS g FROM pairs_of_years JOIN scored ON snapshot_year IN (f, t)),
sided AS (
  SELECT f, t, i.g, gbifID, bool_or(y = f) AS old, bool_or(y = t) AS new
  FROM pairs_of_years JOIN ids i ON y IN (f, t) GROUP BY ALL),
counts AS (
  SELECT f, t, g, count(*) FILTER (WHERE old AND new) AS kept, count(*) FILTER (WHERE NOT old) AS new,
    count(*) FILTER (WHERE NOT new) AS gone FROM sided GROUP BY ALL),
empty AS (SELECT snapshot_year AS y, {group} AS g, count(*) AS n FROM scored WHERE gbifID IS NULL GROUP BY ALL),
joined AS (
  SELECT CAST(g.f AS INTEGER) AS from_year, CAST(g.t AS INTEGER) AS to_year, g.g, coalesce(kept, 0) AS kept,
    coalesce(c.new, 0) AS new, coalesce(gone, 0) AS gone, coalesce(e.n, 0) AS n_empty
  FROM groups g LEFT JOIN counts c ON c.f = g.f AND c.t = g.t AND c.g IS NOT DISTINCT FROM g.g
  LEFT JOIN empty e ON e.y = g.t AND e.g IS NOT DISTINCT FROM g.g)"""


ORACLES["sketch_changes"] = f"""WITH {_SCORED}, {_changes("datasetKey")}
SELECT * EXCLUDE (g), g AS datasetKey, new AS new_low, new AS new_high FROM joined"""
ORACLES["sketch_changes_of_snapshots"] = f"""WITH {_SCORED}, {_changes("1")} SELECT * EXCLUDE (g) FROM joined"""

# --- changes of a stream ----------------------------------------------------------------------

oracle(
    "stream_changes",
    """SELECT interval, MIDS_level_old, MIDS_level_new, n_records FROM counted
    UNION ALL
    SELECT concat(previous_year, '-', snapshot_year), NULL, MIDS_level, count(*) FROM newcomers GROUP BY ALL
    UNION ALL
    SELECT concat(o.snapshot_year, '-', y.snapshot_year), o.MIDS_level, NULL, count(*)
    FROM scored_idx o JOIN years y ON y.idx = o.idx + 1
    WHERE NOT EXISTS (SELECT 1 FROM scored_idx n WHERE n.gbifID IS NOT DISTINCT FROM o.gbifID AND n.idx = o.idx + 1)
    GROUP BY ALL""",
)
