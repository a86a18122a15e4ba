"""Presence masks: which properties a record has, as bits, so that any mapping set scores from a few numbers.

A property is a column together with the texts that count as missing in it. :func:`presence_masks` tests the properties
of all given mapping sets in one scan and packs them into numbers of 63 bits; the properties' order is kept
with the column, so a written table of masks explains itself. :func:`score_masked` then gives what
:func:`snaplevel.operators.scoring.score_records` gives, without the source columns.

Rules are reduced before they become tests of masks. Of an element's alternatives, those that ask for more than another
one go, negated ones become one, and single columns share one test. Towards a level, elements with a single column
share one test, and an element that another one implies needs none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel import schema as S
from snaplevel.functions import presence
from snaplevel.mappings import MappingSet
from snaplevel.mappings.model import Element
from snaplevel.operators import scoring

#: The numbers are the columns presence_0, presence_1, ...; the first one also has the order of the properties.
MASKS = "presence_"
BITS = presence.FLAGS_PER_NUMBER
Property = tuple[str, tuple[str, ...]]


def _property(column: str, mapping: MappingSet) -> Property:
    return column, tuple(sorted(set(mapping.sentinels.get(column, ()))))


def properties_of(mappings: Iterable[MappingSet]) -> list[Property]:
    """Every property that a rule of the mapping sets tests, once, in rule order."""
    tested = (_property(c, m) for m in mappings for e in m.elements for a in e.alternatives for c in a.columns)
    return list(dict.fromkeys(tested))


def presence_masks(df: DataFrame, mappings: Sequence[MappingSet], extra: Sequence[str] = ()) -> DataFrame:
    """Carried columns as they are, ``extra`` columns and the masks. One narrow projection; absent columns are never present."""
    known = properties_of(mappings)
    every = MappingSet(tuple(e for m in mappings for e in m.elements))
    kept = [c for c in extra if c not in scoring.CARRIED]
    rows = presence.media_flag_to_text(scoring.scan_projected(df, every, kept))
    have = set(rows.columns)
    tests = [presence.present_sql(*p) if p[0] in have else "false" for p in known]
    bits = [f"if({t}, {1 << i % BITS}L, 0L)" for i, t in enumerate(tests)]
    # Every bit is named twice on purpose, as in ``presence.score_level``: Spark then compiles each, as a shared subexpression, in
    # a method of its own. All tests in one method, with what the columns are made of, would outgrow the size that the JVM compiles.
    numbers = [F.expr(" | ".join(2 * bits[start : start + BITS])) for start in range(0, len(bits), BITS)]
    order = {"properties": [{"column": c, "missing": list(m)} for c, m in known]}
    numbers = numbers or [F.lit(0).cast("bigint")]
    masks = [n.alias(f"{MASKS}{k}", **({} if k else {"metadata": order})) for k, n in enumerate(numbers)]
    carried = [F.col(S.quoted(c)) if c in have else F.lit(None).cast("string").alias(c) for c in scoring.CARRIED]
    return rows.select(*carried, *masks, *[F.col(S.quoted(c)) for c in kept])


def known_properties(masked: DataFrame) -> list[Property]:
    """The properties of a table of masks, in the order of their bits."""
    order = masked.schema[f"{MASKS}0"].metadata["properties"]
    return [(p["column"], tuple(p["missing"])) for p in order]


@dataclass(frozen=True)
class Rule:
    """Holds if any bit of ``some`` is set, or all of one of ``every``, or one of ``lacking`` is not set.

    ``always`` says that no record fails it.
    """

    some: frozenset[int] = frozenset()
    every: tuple[frozenset[int], ...] = ()
    lacking: frozenset[int] = frozenset()
    always: bool = False

    @classmethod
    def of(cls, element: Element, bit: Mapping[str, int]) -> "Rule":
        asked = [(frozenset(bit[c] for c in a.columns), a.negated) for a in element.alternatives]
        # Not all of these or not all of those: not all of both. Where a record lacks none of them, they need no test.
        lacking = frozenset().union(*(bits for bits, negated in asked if negated))
        wanted = {bits - lacking for bits, negated in asked if not negated}
        if frozenset() in wanted:
            return cls(always=True)
        least = [a for a in wanted if not any(b < a for b in wanted)]
        several = sorted((a for a in least if len(a) > 1), key=sorted)
        return cls(frozenset().union(*(a for a in least if len(a) == 1)), tuple(several), lacking)

    @property
    def single(self) -> int | None:
        """The one bit that the rule is about, if it is that simple."""
        simple = len(self.some) == 1 and not self.every and not self.lacking
        return next(iter(self.some)) if simple else None

    def follows_from(self, bits: frozenset[int]) -> bool:
        """Does it hold wherever all of these bits are set?"""
        return self.always or bool(self.some & bits) or any(a <= bits for a in self.every)

    def implies(self, other: "Rule") -> bool:
        """Is the other one true wherever this one is? Only what the bits show at once."""
        if self.lacking and not self.lacking <= other.lacking:
            return False
        parts = [frozenset({b}) for b in self.some] + list(self.every)
        return not self.always and bool(parts or self.lacking) and all(other.follows_from(p) for p in parts)

    def sql(self) -> str:
        if self.always:
            return "true"
        tests = [f"({n} & {m}L) <> 0" for n, m in _numbers(self.some)]
        for bits in self.every:
            tests.append("(" + " AND ".join(f"({n} & {m}L) = {m}L" for n, m in _numbers(bits)) + ")")
        tests += [f"({n} & {m}L) <> {m}L" for n, m in _numbers(self.lacking)]
        return " OR ".join(tests) or "false"


def _numbers(bits: Iterable[int]) -> list[tuple[str, int]]:
    """The numbers of the masks that hold the bits, and the bits as a mask of each."""
    masks: dict[int, int] = {}
    for b in bits:
        masks[b // BITS] = masks.get(b // BITS, 0) | 1 << b % BITS
    return [(f"{MASKS}{k}", m) for k, m in sorted(masks.items())]


def level_rules(rules: Iterable[Rule]) -> tuple[frozenset[int], list[Rule]]:
    """All of the rules, as bits that must all be set and the other rules that still need a test."""
    rules = list(dict.fromkeys(rules))
    needed = frozenset(r.single for r in rules if r.single is not None)
    rest = [r for r in rules if r.single is None and not r.follows_from(needed)]
    # Of rules that imply each other the first one stays.
    least = [
        r for k, r in enumerate(rest)
        if not any(o.implies(r) and (not r.implies(o) or j < k) for j, o in enumerate(rest) if j != k)
    ]
    return needed, least


class MaskedRules:
    """The rules of a mapping set as tests of the masks of a table."""

    def __init__(self, mapping: MappingSet, known: Sequence[Property]):
        position = {p: k for k, p in enumerate(known)}
        lacking = [p for p in properties_of([mapping]) if p not in position]
        if lacking:
            names = ", ".join(f"{c} (missing: {', '.join(map(repr, m))})" for c, m in lacking)
            raise ValueError(f"the masks lack properties of this mapping set: {names}")
        bit = {c: position[_property(c, mapping)] for e in mapping.elements for a in e.alternatives for c in a.columns}
        self.mapping = mapping
        self.rules = {e.flag: Rule.of(e, bit) for e in mapping.elements}
        self._levels = {e.flag: e.level for e in mapping.elements}

    def flags(self) -> dict[str, Column]:
        """Flag name to condition. The casts keep Catalyst from seeing the level's conditions in the flags, as in ``compile_rules``."""
        return {f: F.expr(f"cast(cast(({r.sql()}) AS tinyint) AS boolean)") for f, r in self.rules.items()}

    def conditions(self) -> list[str]:
        """What each level above the lowest asks for beside the level below it."""
        out = []
        asked: list[Rule] = []
        for level in S.LEVELS[1:]:
            asked += [r for f, r in self.rules.items() if self._levels[f] == level]
            needed, rest = level_rules(asked)
            tests = [f"({n} & {m}L) = {m}L" for n, m in _numbers(needed)] + [f"({r.sql()})" for r in rest]
            out.append(" AND ".join(tests) or "true")
        return out

    def asked_bits(self, bit: Mapping[str, int]) -> tuple[list[list[int]], list[list[int]]]:
        """Where ``bit`` numbers the rules' texts: the bits that each level above the lowest asks for, and those of the
        rules that occur once at least, twice at least, and so on."""
        bits = {f: bit[r.sql()] for f, r in self.rules.items()}
        levels = [[b for f, b in bits.items() if self._levels[f] <= level] for level in S.LEVELS[1:]]
        times = Counter(bits.values())
        return levels, [[b for b, n in times.items() if n > k] for k in range(max(times.values(), default=0))]

    def level(self) -> Column:
        steps = [f"if({c}, 1, 0)" for c in self.conditions()]
        return F.expr(f"cast({' + '.join(['-1', *steps])} AS tinyint)")


def score_masked(masked: DataFrame, mapping: MappingSet, extra: Sequence[str] = ()) -> DataFrame:
    """The scored table of a mapping set; reads the masks and the carried columns only.

    The mapping's properties must be among those that the masks hold; a mapping set of its own is not needed for that.
    """
    rules = MaskedRules(mapping, known_properties(masked))
    extra = [c for c in extra if c not in scoring.CARRIED]
    flags = [c.alias(f) for f, c in rules.flags().items()]
    columns = scoring.output_columns(masked.columns, mapping, rules.level().alias(S.LEVEL), flags)
    return masked.select(*columns, *[F.col(S.quoted(c)) for c in extra])


def levels_of_all(masked: DataFrame, mappings: Mapping[str, MappingSet], keep: Sequence[str]) -> DataFrame:
    """One row per record and mapping set: ``keep`` columns, ``mapping``, the level, and how many flags are set. One scan.

    Every different rule of the sets is tested once per record and becomes a bit; a set is then a few masks of those bits,
    a constant row that each record is paired with. So the compiled methods stay small, however many sets there are.
    """
    known = known_properties(masked)
    compiled = {name: MaskedRules(mapping, known) for name, mapping in mappings.items()}
    tests = list(dict.fromkeys(r.sql() for c in compiled.values() for r in c.rules.values()))
    bit = {sql: k for k, sql in enumerate(tests)}
    numbers = range(-(-len(tests) // BITS))
    held = [
        F.expr(" | ".join(f"if({test}, {1 << i}L, 0L)" for i, test in enumerate(tests[k * BITS : (k + 1) * BITS]))).alias(f"_held_{k}")
        for k in numbers
    ]
    # Elements of one set with equal rules count each: the bits of the rules that occur once at least, twice at least, ...
    asked = {name: c.asked_bits(bit) for name, c in compiled.items()}
    most = max((len(counted) for _, counted in asked.values()), default=0)
    sets = []
    for name, (levels, counted) in asked.items():
        masks = {f"l{j}": bits for j, bits in enumerate(levels)}
        masks |= {f"n{j}": counted[j] if j < len(counted) else [] for j in range(most)}
        constants = [F.lit(_mask(bits, k)).cast("bigint").alias(f"{c}_{k}") for c, bits in masks.items() for k in numbers]
        sets.append(F.struct(F.lit(name).alias("mapping"), *constants))
    kept = [F.col(S.quoted(c)) for c in keep]
    each = masked.select(*kept, *held).select(*kept, *[f"_held_{k}" for k in numbers], F.explode(F.array(*sets)).alias("_set"))
    reached = [" AND ".join(f"(_held_{k} & _set.l{j}_{k}) = _set.l{j}_{k}" for k in numbers) or "true" for j in range(len(S.LEVELS) - 1)]
    level = F.expr(f"cast({' + '.join(['-1', *[f'if({c}, 1, 0)' for c in reached]])} AS tinyint)")
    n_flags = F.expr(" + ".join(f"bit_count(_held_{k} & _set.n{j}_{k})" for j in range(most) for k in numbers) or "0")
    return each.select(*kept, "_set.mapping", level.alias(S.LEVEL), n_flags.alias("n_flags"))


def _mask(bits: Iterable[int], number: int) -> int:
    """Those of the bits that are in one of the numbers, as its mask."""
    return sum(1 << b % BITS for b in set(bits) if b // BITS == number)
