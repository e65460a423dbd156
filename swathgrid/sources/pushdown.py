"""Conditions that a file scan answers by not reading: whole-number ranges, names and flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.datasource import (
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

Ranges = list[tuple[int, int]]
NO_END = 1 << 62


def joined(values: Iterable[int]) -> Ranges:
    """Numbers as sorted half-open ranges."""
    out: list[list[int]] = []
    for v in sorted(set(values)):
        if out and out[-1][1] == v:
            out[-1][1] = v + 1
        else:
            out.append([v, v + 1])
    return [(a, b) for a, b in out]


def common(left: Ranges, right: Ranges) -> Ranges:
    found = [(max(a, c), min(b, d)) for a, b in left for c, d in right]
    return sorted((a, b) for a, b in found if a < b)


def without(left: Ranges, gone: Ranges) -> Ranges:
    ends = [0, *(x for pair in gone for x in pair), NO_END]
    return common(left, [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b])


class Selection:
    """What conditions leave of a source. None of its columns is ever NULL.

    ``where`` holds conditions given with the source: for numbers a list of half-open ranges, for names a list of them, for a
    flag its value.
    """

    def __init__(
        self, numbers: Iterable[str] = (), names: Iterable[str] = (), flags: Iterable[str] = (), where: dict | None = None
    ):
        self.numbers: dict[str, Ranges] = {c: [(0, NO_END)] for c in numbers}
        self.names: dict[str, list] = {c: [] for c in names}
        self.flags: dict[str, set[bool]] = {c: {True, False} for c in flags}
        for column, asked in (where or {}).items():
            if column in self.numbers:
                self.numbers[column] = common(self.numbers[column], [tuple(r) for r in asked])
            elif column in self.names:
                self.names[column].append(set(asked))
            elif column in self.flags:
                self.flags[column] &= {asked}
            else:
                raise ValueError(f"no condition on {column} can be answered by the scan")

    def push(self, filters: Iterable[Filter]) -> Iterable[Filter]:
        """Take over the conditions that can be answered completely; the others are left to Spark."""
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if column not in {**self.numbers, **self.names, **self.flags}:
            return False
        if isinstance(f, IsNotNull):
            return True
        if column in self.numbers:
            hit = _range(f)
            if hit is not None:
                self.numbers[column] = common(self.numbers[column], hit)
            return hit is not None
        equal = {f.value} if isinstance(f, (EqualTo, EqualNullSafe)) else set(f.value) if isinstance(f, In) else None
        if column in self.flags and equal is not None:
            self.flags[column] &= equal
            return True
        if column in self.names and (equal is not None or isinstance(f, StringStartsWith)):
            self.names[column].append(equal if equal is not None else f.value)
            return True
        return False

    def within(self, column: str, size: int) -> Ranges:
        """Ranges of a column that runs from 0 to size - 1."""
        return common(self.numbers[column], [(0, size)])

    def has_name(self, column: str, name: str) -> bool:
        return all(name.startswith(t) if isinstance(t, str) else name in t for t in self.names[column])


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _range(f: Filter) -> Ranges | None:
    if isinstance(f, In):
        return joined(v for v in f.value if v >= 0) if all(map(_whole, f.value)) else None
    if not _whole(getattr(f, "value", None)):
        return None
    v = f.value
    for kind, low, high in (
        ((EqualTo, EqualNullSafe), v, v + 1),
        (GreaterThan, v + 1, NO_END),
        (GreaterThanOrEqual, v, NO_END),
        (LessThan, 0, v),
        (LessThanOrEqual, 0, v + 1),
    ):
        if isinstance(f, kind):
            return [(max(0, low), high)] if max(0, low) < high else []
    return None
