"""Mapping rows turned into element rules. Driver-side metadata only: tens of rows, no data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from snaplevel.schema import ELEMENT_PREFIX, LEVELS

# Predicates of the mapping format.
SINGLE_PREDICATES = ("skos:narrowMatch", "skos:exactMatch")
GROUP_PREDICATE = "owl:intersectionOf"


def strip_class_prefix(name: str) -> str:
    """Text after the last colon: ``[dwc:Occurrence]dwc:year`` becomes ``year``."""
    return name.rsplit(":", 1)[-1]


@dataclass(frozen=True)
class Alternative:
    """One way to satisfy an element: all columns present, or, negated, not all of them present."""

    columns: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Element:
    """An element is present when any of its alternatives holds."""

    level: int
    name: str
    alternatives: tuple[Alternative, ...]

    @property
    def flag(self) -> str:
        return f"{ELEMENT_PREFIX}MIDS{self.level}{self.name}"


@dataclass(frozen=True)
class MappingSet:
    """Element rules and, per source column, the values that count as missing."""

    elements: tuple[Element, ...]
    sentinels: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        odd = [e.flag for e in self.elements if e.level not in LEVELS[1:]]
        if odd:
            raise ValueError(f"levels outside {LEVELS[1]} to {LEVELS[-1]}: {', '.join(odd)}")

    @property
    def flags(self) -> list[str]:
        return [e.flag for e in self.elements]

    @property
    def columns(self) -> list[str]:
        """Every source column a rule or a sentinel list refers to, once, in rule order."""
        names = [c for e in self.elements for a in e.alternatives for c in a.columns]
        return list(dict.fromkeys([*names, *self.sentinels]))

    def to_rows(self) -> list[dict[str, str]]:
        """Mapping rows that :meth:`from_rows` reads back to the same rules."""
        rows = []
        for element in self.elements:
            members = set()
            for a in element.alternatives:
                grouped = len(a.columns) > 1
                if grouped and members & set(a.columns):
                    raise ValueError(f"{element.name}: a column is in two groups")
                members |= set(a.columns) if grouped else set()
                for position, column in enumerate(a.columns):
                    rows.append(
                        {
                            "subject_id": f"{ELEMENT_PREFIX}{element.name}",
                            "subject_category": f"{ELEMENT_PREFIX}MIDS{element.level}",
                            "predicate_id": GROUP_PREDICATE if grouped else SINGLE_PREDICATES[0],
                            "predicate_modifier": "Not" if a.negated else "",
                            "object_id": column,
                            "object_match_field": "|".join(a.columns)
                            if grouped and position == 0
                            else "",
                            "RegexRemoval": "|".join(self.sentinels.get(column, ())),
                        }
                    )
        return rows

    @classmethod
    def from_rows(cls, rows: Iterable[Mapping[str, str | None]]) -> "MappingSet":
        """Build from mapping rows keyed by header name, with or without a ``prefix:`` in the header.

        Needs ``subject_id``, ``subject_category``, ``predicate_id`` and ``object_id``; uses
        ``object_match_field``, ``predicate_modifier`` and ``RegexRemoval`` where present.
        """
        found: dict[tuple[int, str], list[dict[str, str]]] = {}
        sentinels: dict[str, dict[str, None]] = {}
        for raw in rows:
            row = {strip_class_prefix(k): v or "" for k, v in raw.items()}
            level = re.search(r"(\d+)$", row["subject_category"])
            if level is None:
                raise ValueError(f"no level in subject_category {row['subject_category']!r}")
            found.setdefault((int(level[1]), strip_class_prefix(row["subject_id"])), []).append(row)
            removal = row.get("RegexRemoval", "")
            if removal:
                column = strip_class_prefix(row["object_id"])
                sentinels.setdefault(column, {}).update(dict.fromkeys(removal.split("|")))
        elements = tuple(
            Element(level, name, _alternatives(name, rows))
            for (level, name), rows in sorted(found.items(), key=lambda kv: kv[0][0])
        )
        return cls(elements, {c: tuple(v) for c, v in sentinels.items()})


def _alternatives(element: str, rows: list[dict[str, str]]) -> tuple[Alternative, ...]:
    groups = [
        tuple(strip_class_prefix(c) for c in r["object_match_field"].split("|"))
        for r in rows
        if r["predicate_id"] == GROUP_PREDICATE and r.get("object_match_field")
    ]
    grouped = {c for g in groups for c in g}
    out: dict[Alternative, None] = {}
    for row in rows:
        column = strip_class_prefix(row["object_id"])
        negated = row.get("predicate_modifier", "").lower() == "not"
        if row["predicate_id"] in SINGLE_PREDICATES:
            out[Alternative((column,), negated)] = None
        elif row["predicate_id"] != GROUP_PREDICATE:
            raise ValueError(f"{element}: unknown predicate {row['predicate_id']!r}")
        elif column not in grouped:
            raise ValueError(f"{element}: {column} is in no group of this element")
        elif row.get("object_match_field"):
            members = tuple(strip_class_prefix(c) for c in row["object_match_field"].split("|"))
            out[Alternative(members, negated)] = None
    return tuple(out)
