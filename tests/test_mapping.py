from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import presence
from snaplevel.mappings import Alternative, Element, MappingSet, default_mapping
from snaplevel.operators import scoring
from snaplevel.sources import lookups

FULL_HEADER = [
    "sssom:subject_id", "sssom:subject_label", "sssom:subject_category", "sssom:predicate_id",
    "sssom:object_id", "sssom:object_label", "sssom:object_category", "sssom:object_match_field",
    "semapv:RegexRemoval",
]
SHORT_HEADER = [
    "sssom:subject_id", "sssom:subject_category", "sssom:predicate_id", "sssom:object_id",
    "sssom:object_match_field", "semapv:RegexRemoval",
]


def write_mapping(path, header, rows):
    lines = ["\t".join(header)]
    lines += ["\t".join(r.get(h.split(":")[-1], "") for h in header) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def row(element, level, column, predicate="skos:narrowMatch", group="", removal=""):
    return {
        "subject_id": f"mids:{element}", "subject_category": f"mids:MIDS{level}",
        "predicate_id": predicate, "object_id": column, "object_match_field": group,
        "RegexRemoval": removal,
    }


ROWS = [
    row("Id", 0, "dwc:catalogNumber", removal="|unknown:undigitized"),
    row("Name", 1, "dwc:scientificName", removal="|incertae sedis"),
    row("Name", 1, "[dwc:Taxon]gbif:taxonKey", "skos:exactMatch", removal="|0"),
    row("Place", 2, "dwc:lat", "owl:intersectionOf", "dwc:lat|dwc:lon"),
    row("Place", 2, "dwc:lon", "owl:intersectionOf"),
    row("Place", 2, "dwc:wkt"),
    row("Media", 3, "abcd:Unit-Media"),
]


@pytest.mark.parametrize("header", [FULL_HEADER, SHORT_HEADER])
def test_both_layouts_read_alike(spark, tmp_path, header):
    mapping = lookups.read_mapping(spark, write_mapping(tmp_path / "m.tsv", header, ROWS))
    assert mapping.flags == [
        "mids:MIDS0Id", "mids:MIDS1Name", "mids:MIDS2Place", "mids:MIDS3Media"
    ]
    assert mapping.elements[1].alternatives == (
        Alternative(("scientificName",)), Alternative(("taxonKey",))
    )
    assert mapping.elements[2].alternatives == (Alternative(("lat", "lon")), Alternative(("wkt",)))
    assert mapping.sentinels == {
        "catalogNumber": ("", "unknown:undigitized"),
        "scientificName": ("", "incertae sedis"),
        "taxonKey": ("", "0"),
    }


def test_mapping_is_found_by_id(spark, tmp_path):
    write_mapping(tmp_path / "set_1.sssom.tsv", FULL_HEADER, ROWS)
    assert len(lookups.read_mapping_by_id(spark, str(tmp_path), "set_1").elements) == 4
    with pytest.raises(ValueError, match="no version"):
        lookups.read_mapping_by_id(spark, str(tmp_path), "set_1", "1")
    header = tmp_path / "set_1.sssom.yml"
    header.write_text("curie_map:\n  dwc: http://x/\nmapping_set_id: set_1\nmapping_set_version: 2\nlicense: https://y/\n")
    assert lookups.read_mapping_header(spark, str(tmp_path), "set_1") == {
        "mapping_set_id": "set_1", "mapping_set_version": "2", "license": "https://y/"
    }
    assert len(lookups.read_mapping_by_id(spark, str(tmp_path), "set_1", "2").elements) == 4
    with pytest.raises(ValueError, match="version of set_1 is '2'"):
        lookups.read_mapping_by_id(spark, str(tmp_path), "set_1", "1")
    header.write_text("mapping_set_id: another\n")
    with pytest.raises(ValueError, match="is 'another'"):
        lookups.read_mapping_by_id(spark, str(tmp_path), "set_1")


def test_short_mapping_line_is_an_error(spark, tmp_path):
    path = write_mapping(tmp_path / "m.tsv", FULL_HEADER, ROWS)
    with open(path, "a") as file:
        file.write("mids:Name\tmids:MIDS1\n")
    with pytest.raises(ValueError, match="too few fields"):
        lookups.read_mapping(spark, path)


def test_group_row_outside_every_group_is_an_error():
    rows = [row("Place", 2, "dwc:lat", "owl:intersectionOf")]
    with pytest.raises(ValueError, match="in no group"):
        MappingSet.from_rows(rows)


def test_unknown_predicate_and_missing_level_are_errors():
    with pytest.raises(ValueError, match="unknown predicate"):
        MappingSet.from_rows([row("Place", 2, "dwc:lat", "skos:closeMatch")])
    with pytest.raises(ValueError, match="no level"):
        MappingSet.from_rows([{**row("Place", 2, "dwc:lat"), "subject_category": "mids:Other"}])


def test_default_mapping_shape_and_round_trip():
    mapping = default_mapping()
    assert len(mapping.elements) == 18
    assert [sum(e.level == n for e in mapping.elements) for n in range(4)] == [2, 4, 6, 6]
    assert MappingSet.from_rows(mapping.to_rows()) == mapping
    assert "multimedia" in default_mapping("multimedia").columns
    assert "multimediaIdentifier" not in default_mapping("multimedia").columns


def random_mapping(rng, columns):
    elements = []
    for i in range(rng.randint(3, 8)):
        alternatives = tuple(
            Alternative(tuple(rng.sample(columns, rng.randint(1, 3))), rng.random() < 0.25)
            for _ in range(rng.randint(1, 4))
        )
        elements.append(Element(rng.randint(0, 3), f"E{i}", alternatives))
    sentinels = {
        c: tuple(rng.sample(["", "0", "it's", "a\\b", "x y"], rng.randint(1, 4)))
        for c in columns if rng.random() < 0.7
    }
    return MappingSet(tuple(elements), sentinels)


@pytest.mark.parametrize("seed", range(5))
def test_compiled_rules_agree_with_plain_evaluation(spark, seed):
    rng = random.Random(seed)
    columns = [f"c{i}" for i in range(6)]
    mapping = random_mapping(rng, columns)
    values = [None, "", "0", "it's", "a\\b", "x y", "real", " "]
    present = columns[:5]  # c5 is absent from the data
    data = [[str(i), *[rng.choice(values) for _ in present]] for i in range(200)]
    df = spark.createDataFrame(data, ["gbifID", *present])
    got = {r["gbifID"]: r for r in scoring.score_records(df, mapping).collect()}

    for record in data:
        cells = dict(zip(present, record[1:], strict=True))

        def there(column):
            value = cells.get(column)
            return value is not None and value not in mapping.sentinels.get(column, ())

        truth = {
            e.flag: any(all(map(there, a.columns)) != a.negated for a in e.alternatives)
            for e in mapping.elements
        }
        level = -1
        for n in range(4):
            if not all(truth[e.flag] for e in mapping.elements if e.level <= n):
                break
            level = n
        result = got[int(record[0])]
        assert {f: result[f] for f in truth} == truth
        assert result[S.LEVEL] == level


def test_level_from_flag_columns_equals_level_from_rules(spark):
    mapping = default_mapping()
    flags = mapping.flags
    rows = []
    for top in range(-1, 4):
        values = {e.flag: e.level <= top for e in mapping.elements}
        rows.append([values[f] for f in flags])
    df = spark.createDataFrame(rows, flags).withColumn("level", presence.score_level(mapping))
    assert [r.level for r in df.collect()] == [-1, 0, 1, 2, 3]


def test_sentinel_text_is_exact(spark):
    df = spark.createDataFrame([("0",), (" 0",), ("",), (None,), ("UNKNOWN",)], "taxonKey string")
    cleaned = presence.null_sentinels(df, {"taxonKey": ("", "0", "unknown"), "absent": ("x",)})
    assert [r[0] for r in cleaned.collect()] == [None, " 0", None, None, "UNKNOWN"]
    assert cleaned.columns == ["taxonKey"]


def test_strip_class_prefix_on_data(spark):
    df = spark.createDataFrame([("[dwc:Occurrence]dwc:year",), ("plain",)], "c string")
    out = df.select(presence.strip_class_prefix(F.col("c"))).collect()
    assert [r[0] for r in out] == ["year", "plain"]


def test_levels_without_elements_are_reached_with_the_one_below(spark):
    one = MappingSet((Element(0, "Id", (Alternative(("a",)),)),))
    gap = MappingSet((Element(0, "Id", (Alternative(("a",)),)), Element(2, "Place", (Alternative(("b",)),))))
    df = spark.createDataFrame([("1", "x", "y"), ("2", "x", None), ("3", None, "y")], "gbifID string, a string, b string")
    level = lambda m: [r[0] for r in scoring.score_records(df, m).orderBy("gbifID").select(S.LEVEL).collect()]
    assert level(one) == [3, 3, -1]
    assert level(gap) == [3, 1, -1]


def test_levels_outside_the_scale_are_refused():
    with pytest.raises(ValueError, match="MIDS4More"):
        MappingSet((Element(4, "More", (Alternative(("a",)),)),))
    with pytest.raises(ValueError, match="outside 0 to 3"):
        MappingSet.from_rows([row("More", 12, "dwc:a")])
