"""Masks score every mapping set as the source columns do."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.mappings import Alternative, Element, MappingSet, default_mapping
from snaplevel.operators import masks, scoring
from snaplevel.registry import tables

COLUMNS = [f"c{i}" for i in range(9)]


def random_mapping(rng, columns=COLUMNS, absent=("nowhere",)):
    elements = []
    for k in range(rng.randrange(1, 9)):
        alternatives = tuple(
            Alternative(tuple(rng.sample([*columns, *absent], rng.choice([1, 1, 1, 2, 3]))), rng.random() < 0.2)
            for _ in range(rng.randrange(1, 5))
        )
        elements.append(Element(rng.randrange(4), f"E{k}", alternatives))
    sentinels = {c: tuple(rng.sample(["", "-", "0"], rng.randrange(3))) for c in columns if rng.random() < 0.6}
    return MappingSet(tuple(sorted(elements, key=lambda e: e.level)), sentinels)


def raw(spark, rng, n=120, columns=COLUMNS):
    texts = [None, "", "-", "0", "x", "x"]
    rows = [(str(i), f"d{i % 3}", str(1900 + i), "DE", None, *(rng.choice(texts) for _ in columns)) for i in range(n)]
    names = ["gbifID", "datasetKey", "year", "countryCode", "phylum", *columns]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_eight_mapping_sets_from_one_table_of_masks(spark, tmp_path, seed):
    rng = random.Random(seed)
    mappings = {f"m{k}": random_mapping(rng) for k in range(8)}
    df = raw(spark, rng)
    path = str(tmp_path / "masks")
    masks.presence_masks(df, list(mappings.values())).write.parquet(path)
    masked = spark.read.parquet(path)
    assert masks.known_properties(masked) == masks.properties_of(mappings.values())
    for mapping in mappings.values():
        got, want = masks.score_masked(masked, mapping), scoring.score_records(df, mapping)
        assert got.columns == want.columns and sorted_rows(got) == sorted_rows(want)
    each = masks.levels_of_all(masked, mappings, ["gbifID"])
    for name, mapping in mappings.items():
        scored = scoring.score_records(df, mapping)
        n_true = F.expr(" + ".join(f"int({S.quoted(f)})" for f in mapping.flags))
        want = scored.select(F.col("gbifID").cast("string"), F.lit(name), S.LEVEL, n_true)
        assert sorted_rows(each.where(F.col("mapping") == name)) == sorted_rows(want)


def test_more_than_one_number(spark):
    columns = [f"w{i}" for i in range(150)]
    rng = random.Random(7)
    mapping = MappingSet(
        tuple(Element(k % 4, f"E{k}", (Alternative(tuple(columns[k : k + 3]), k % 5 == 4), Alternative((columns[-k - 1],)))) for k in range(140)),
        {c: ("", "-") for c in columns},
    )
    mapping = MappingSet(tuple(sorted(mapping.elements, key=lambda e: e.level)), mapping.sentinels)
    df = raw(spark, rng, 40, columns)
    masked = masks.presence_masks(df, [mapping])
    assert [c for c in masked.columns if c.startswith(masks.MASKS)] == ["presence_0", "presence_1", "presence_2"]
    assert sorted_rows(masks.score_masked(masked, mapping)) == sorted_rows(scoring.score_records(df, mapping))


@pytest.mark.parametrize("seed", range(200))
def test_reduced_rules_hold_where_the_rules_do(seed):
    """All combinations of six bits, evaluated without Spark."""
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(6)]
    mapping = random_mapping(rng, names, absent=())
    bit = {c: k for k, c in enumerate(names)}
    rules = {e.flag: masks.Rule.of(e, bit) for e in mapping.elements}

    def holds(rule, bits):
        return rule.always or bool(rule.some & bits) or any(a <= bits for a in rule.every) or not rule.lacking <= bits

    needed, rest = masks.level_rules(rules.values())
    for row in itertools.product([False, True], repeat=6):
        bits = frozenset(k for k, x in enumerate(row) if x)
        plain = {
            e.flag: any(all(row[bit[c]] for c in a.columns) != a.negated for a in e.alternatives) for e in mapping.elements
        }
        for flag, rule in rules.items():
            assert holds(rule, bits) == plain[flag]
        assert (needed <= bits and all(holds(r, bits) for r in rest)) == all(plain.values())


def test_rules_are_reduced():
    bit = {c: k for k, c in enumerate("abcdef")}
    one = lambda *asked: masks.Rule.of(Element(0, "E", tuple(Alternative(tuple(a.lstrip("!")), a[0] == "!") for a in asked)), bit)
    assert one("a", "ab", "c") == masks.Rule(some=frozenset({0, 2}))
    assert one("ab", "abc", "abd") == masks.Rule(every=(frozenset({0, 1}),))
    assert one("!a", "!b") == masks.Rule(lacking=frozenset({0, 1}))
    assert one("ab", "!a") == masks.Rule(some=frozenset({1}), lacking=frozenset({0}))
    assert one("a", "!ab").always
    needed, rest = masks.level_rules([one("a"), one("b"), one("a", "c"), one("ab"), one("d", "e"), one("d", "e", "f"), one("a", "!ab")])
    assert needed == {0, 1} and rest == [one("d", "e")]


def test_masks_are_all_that_is_read(spark, tmp_path):
    rng = random.Random(1)
    mapping = random_mapping(rng)
    path = str(tmp_path / "masks")
    masks.presence_masks(raw(spark, rng), [mapping, random_mapping(rng)]).write.parquet(path)
    plan = masks.levels_of_all(spark.read.parquet(path), {"m": mapping}, ["gbifID"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<gbifID:string,presence_0:bigint>" in plan and "Exchange" not in plan


def test_unknown_property_is_an_error(spark):
    rng = random.Random(2)
    a = MappingSet((Element(0, "E", (Alternative(("c0",)),)),), {"c0": ("",)})
    b = MappingSet((Element(0, "E", (Alternative(("c0",)),)),), {"c0": ("", "-")})
    masked = masks.presence_masks(raw(spark, rng, 3), [a])
    with pytest.raises(ValueError, match="c0"):
        masks.score_masked(masked, b)


def test_default_mapping_takes_few_tests():
    rules = masks.MaskedRules(default_mapping(), masks.properties_of([default_mapping()]))
    plain = sum(len(a.columns) for e in default_mapping().elements for a in e.alternatives)
    assert sum(r.sql().count("&") for r in rules.rules.values()) < plain / 2
    assert set(tables.mapping_sets()) == set(tables.MAPPING_SETS) and len(tables.MAPPING_SETS) == 8


def test_media_flag_and_empty_table(spark):
    mapping = MappingSet((Element(0, "Media", (Alternative(("multimedia",)),)),))
    df = spark.createDataFrame([("1", True), ("2", False), ("3", None)], "gbifID string, multimedia boolean")
    masked = masks.presence_masks(df, [mapping])
    assert sorted_rows(masks.score_masked(masked, mapping)) == sorted_rows(scoring.score_records(df, mapping))
    assert masks.score_masked(masked.limit(0), mapping).collect() == []


def test_all_sets_at_once_are_compiled(spark, tmp_path):
    mappings = tables.mapping_sets()
    path = str(tmp_path / "masks")
    masks.presence_masks(raw(spark, random.Random(3)), list(mappings.values())).write.parquet(path)
    each = masks.levels_of_all(spark.read.parquet(path), mappings, ["gbifID"])
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(each._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # the JVM compiles no larger method


def test_equal_rules_of_one_set_count_each(spark):
    same = [Element(k % 2, f"E{k}", (Alternative(("a",)),)) for k in (0, 2, 1)]
    mappings = {"three": MappingSet(tuple(same), {}), "one": MappingSet(tuple(same[:1]), {}), "none": MappingSet((), {})}
    df = spark.createDataFrame([("1", "x"), ("2", None)], "gbifID string, a string")
    each = masks.levels_of_all(masks.presence_masks(df, list(mappings.values())), mappings, ["gbifID"])
    assert {tuple(r) for r in each.collect()} == {
        ("1", "three", 3, 3), ("1", "one", 3, 1), ("1", "none", 3, 0),
        ("2", "three", -1, 0), ("2", "one", -1, 0), ("2", "none", 3, 0),
    }
