"""Queries of the operators of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel.llm import (
    bpe,
    divergence,
    embedding_dedup,
    fingerprints,
    hard_negatives,
    language_model,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    token_counts,
    warc,
)
from snaplevel.llm.common import read
from snaplevel.sources.workdir import work_folder

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to WARC archives and back; a page's record id is its number, "null" without one."""
    path = work_folder(spark, "warc")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    pages = read(spark, folder, "pages").select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("target_uri"),
        F.col("html").cast("binary").alias("payload"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
    )
    records = warc.with_revisits(pages, F.col("page_id"))
    records = records.withColumn("record_id", name(F.col("page_id")))
    records = records.withColumn("refers_to", F.when(F.col("refers_key").isNotNull(), name(F.col("refers_key"))))
    warc.write_warc(records, path)

    number = lambda c: F.expr(f"try_cast(substr({c}, 10) AS bigint)")
    back = warc.read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, folder, "documents")).drop("key")


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    weights = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, weights, threshold=0.3)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    decoded = bpe.round_trip(read(spark, folder, "documents"), vocabulary(BYTE_BPE))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(read(spark, folder, "documents"), short=True)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), vocabulary(BYTE_BPE))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = line_dedup.deduplicate_lines(read(spark, folder, "documents"))
    return docs.select("doc_id", "n_lines", "n_kept", "text")


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, folder, "embeddings"), threshold=0.98)


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, scale=256)


def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_documents(read(spark, folder, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe_encoding": op5_bpe_encoding,
    "op6_fingerprints": op6_fingerprints,
    "op7_license_scan": op7_license_scan,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lm_scoring": op13_lm_scoring,
}

OP1_SQL = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
), kept AS (SELECT body, max(page_id) AS page_id FROM bodies WHERE n >= 1000 GROUP BY body)
SELECT b.page_id, n::BIGINT AS payload_bytes, sha1(b.body) AS payload_digest,
       CASE WHEN k.page_id > b.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.page_id > b.page_id THEN k.page_id END AS refers_to
FROM bodies b LEFT JOIN kept k ON b.body = k.body
"""

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '~') AS body,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 15))::BIGINT AS place
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap,
         (3 * source_size) / ((rank - 1) % 3 + 1)::DOUBLE AS full_at FROM sums
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (ORDER BY full_at, rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, least(cap::DOUBLE, weight * coalesce(
    (SELECT level FROM levels WHERE full_at >= level ORDER BY full_at, rank LIMIT 1),
    (SELECT max(full_at) FROM levels))) AS target FROM levels
), queue AS (
  SELECT doc_id, d.source, size, source_size, target, weight, rank, place, body,
         row_number() OVER () AS n,
         sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, size, body, d.rowid_
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM sized) d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), items AS (
  SELECT n, size, sum(size) OVER (ORDER BY words / weight, rank, words
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
  FROM (SELECT *, upto + source_size * e AS words FROM queue, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0)
), taken AS (
  SELECT n, count(*) AS copies FROM items WHERE used <= (SELECT sum(source_size) FROM sums) GROUP BY n
)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken, source,
       coalesce(copies, 0)::INTEGER AS copies
FROM queue LEFT JOIN taken USING (n)
"""

#: Pairs of different sets that share a shingle are counted; components by walking the links.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(
    [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS c, any_value(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY md5(array_to_string(s, chr(10))), len(s)
), members AS (SELECT c, n, unnest(s) AS m FROM classes
), several AS (SELECT * FROM members WHERE m IN (SELECT m FROM members GROUP BY m HAVING count(*) > 1)
), links AS (
  SELECT a.c AS x, b.c AS y FROM several a JOIN several b ON a.m = b.m AND a.c <> b.c AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT c AS x, c AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x AS c, min(y) AS component_id FROM reach GROUP BY x
), named AS (SELECT md5(array_to_string(s, chr(10))) AS h, n, component_id FROM classes JOIN least USING (c))
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN named ON len(s) > 0 AND len(s) = n AND md5(array_to_string(s, chr(10))) = h
"""

#: Places of a notice's runs of words, and every window of 2 n words, whatever its first word, that holds some of them.
_NOTICES = ", ".join(
    "('{}', '{}')".format(*(x.replace("'", "''") for x in notice)) for notice in license_scan.NOTICES + license_scan.SHORT_NOTICES
)
OP7_SQL = rf"""
WITH notices AS (
  SELECT row_number() OVER () AS notice, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w
  FROM (VALUES {_NOTICES}) t(license, text)
), wanted AS (
  SELECT notice, license, len(w) AS n, least(5, len(w)) AS run,
         list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) AS s
  FROM notices
), words AS (
  SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents
), runs AS (
  SELECT row_, run, unnest(range(0, len(w) - run + 1)) AS p, unnest([array_to_string(w[i:i + run - 1], ' ') for i in range(1, len(w) - run + 2)]) AS s
  FROM words, (SELECT DISTINCT run FROM wanted)
), hits AS (
  SELECT row_, notice, n, x.run, p, r.s FROM runs r JOIN (SELECT notice, n, run, unnest(s) AS s FROM wanted) x ON r.run = x.run AND r.s = x.s
), windows AS (
  SELECT DISTINCT row_, notice, n, run, unnest(range(greatest(0, p - 2 * n + run), p + 1)) AS at_ FROM hits
), held AS (
  SELECT v.row_, v.notice, at_, count(DISTINCT h.s) AS k FROM windows v JOIN hits h
  ON h.row_ = v.row_ AND h.notice = v.notice AND h.p BETWEEN at_ AND at_ + 2 * v.n - v.run GROUP BY ALL
), found AS (
  SELECT doc_id, license, at_, k / len(s)::DOUBLE AS containment FROM held JOIN wanted USING (notice) JOIN words USING (row_)
)
SELECT doc_id, license, max(containment) AS containment, min(at_)::INTEGER AS at FROM found WHERE containment >= 0.75
GROUP BY doc_id, license
"""

#: The lines of the pairs compared share a half; whether they are one edit apart is asked character by character.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line FROM (
    SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), firsts AS (
  SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), long AS (SELECT * FROM firsts WHERE n >= 20
), pairs AS (
  SELECT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb FROM long a JOIN long b
  ON b.n = a.n AND substr(a.line, 1, a.n // 2) = substr(b.line, 1, a.n // 2) AND a.line < b.line
  UNION SELECT a.line, b.line, a.first, b.first FROM long a JOIN long b
  ON b.n = a.n AND substr(a.line, a.n // 2 + 2) = substr(b.line, a.n // 2 + 2) AND a.line < b.line
  UNION SELECT a.line, b.line, a.first, b.first FROM long a JOIN long b
  ON b.n = a.n + 1 AND substr(a.line, 1, a.n // 2) = substr(b.line, 1, a.n // 2)
  UNION SELECT a.line, b.line, a.first, b.first FROM long a JOIN long b
  ON b.n = a.n + 1 AND substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2 + 2)
), agreeing AS (
  SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, length(a) + 1) t(i) WHERE substr(a, 1, i) = substr(b, 1, i)) AS front
  FROM pairs
), near AS (
  SELECT CASE WHEN fa < fb THEN b ELSE a END AS line FROM agreeing
  WHERE substr(a, front + 1 + (length(a) = length(b))::INT) = substr(b, front + 2)
), kept AS (
  SELECT first.doc_id AS doc_id, first.pos AS pos FROM (
    SELECT struct_pack(doc_id := first[1], pos := first[2]) AS first FROM firsts WHERE line NOT IN (SELECT line FROM near))
  UNION ALL
  SELECT doc_id, pos FROM lines WHERE NOT regexp_matches(line, '[^\x20\x09-\x0D]')
), left_over AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM kept JOIN lines USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(n_kept, 0)::BIGINT AS n_kept,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN left_over k USING (doc_id)
"""

OP10_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT DISTINCT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x
), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(y, vec_id) AS component_id,
       coalesce(y, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.x LEFT JOIN counts ON vec_id = counts.x
"""

#: Shares of every kept term in every source of its language, also of those that lack it; sums as 128-bit numbers.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), terms AS (SELECT lang, source, doc, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), sources AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL
), dense AS (
  SELECT lang, source, term, lang_n, coalesce(n, 0)::HUGEINT AS n
  FROM sources JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER s + 5 * count(*) OVER s) AS q
  FROM dense WINDOW s AS (PARTITION BY lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 50
"""

#: Every anchor against every row; products of whole numbers below 2^53 are exact as doubles.
OP12_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS row_, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.row_ AS a, a.vec_id AS anchor_id, b.row_ AS b, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.row_ <> b.row_ AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score,
       (row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, s.vec_id NULLS LAST, s.b))::INTEGER AS rank
FROM positives p JOIN scores s ON p.a = s.a
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLES = {
    "op1_warc": OP1_SQL,
    "op3_ngram_join": OP3_SQL,
    "op7_license_scan": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op2_mix_sources": OP2_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
