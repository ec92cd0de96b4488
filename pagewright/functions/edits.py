"""Edits that keep track of where every character went: as columns, and for the rules that work token by token."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Edit = tuple[int, int, str]


@dataclass
class Tracked:
    """A text and, for each gap of the first text, the gap of this one where it lies."""

    text: str
    map: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.map = self.map or list(range(len(self.text) + 1))

    def edited(self, edits: Iterable[Edit]) -> Tracked:
        """Replace disjoint spans; edits that overlap or lie outside are an error. A deleted character maps to where it would stand."""
        ordered = sorted(edits, key=lambda e: (e[0], e[1]))
        out, starts, shifts, at, size = [], [0], [(0, 0, 0)], 0, 0
        for start, end, new in ordered:
            if not at <= start <= end <= len(self.text):
                raise ValueError(f"edit {start}:{end} overlaps another or lies outside the text")
            out += [self.text[at:start], new]
            size += start - at
            starts += [start, end]
            # Between start and end everything is at the replacement's start, from end on it follows it.
            shifts += [(0, size, 0), (1, size + len(new), end)]
            size += len(new)
            at = end
        out.append(self.text[at:])

        def moved(p: int) -> int:
            k = bisect_right(starts, p) - 1
            follows, base, origin = shifts[k]
            return base + p - origin if follows or not k else base

        step = [moved(p) for p in range(len(self.text) + 1)]
        return Tracked("".join(out), [step[p] for p in self.map])

    def then(self, later: Tracked) -> Tracked:
        """This one, then ``later``, which began at this one's text."""
        if len(later.map) != len(self.text) + 1:
            raise ValueError("the second rewrite began at another text")
        return Tracked(later.text, [later.map[p] for p in self.map])

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.map[start], self.map[end]


# As columns. Edits are an array of (start, end, replacement), disjoint, in code points; start = end inserts.


def ordered(edits: Column, text: Column) -> Column:
    """The edits in the order of the text; ones that overlap or lie outside are an error."""
    own = F.array_sort(edits)
    size = F.char_length(text)
    before = F.transform(own, lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get(own, i - 1)["end"]))
    bad = F.exists(F.zip_with(own, before, lambda e, at: (e["start"] < at) | (e["end"] < e["start"]) | (e["end"] > size)), lambda x: x)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("an edit overlaps another or lies outside the text")).cast("array<struct<start:int,end:int,replacement:string>>")).otherwise(own)


def rewritten(text: Column, edits: Column) -> Column:
    """The text with its (ordered) edits."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(edits, i - 1)["end"])
    pieces = F.transform(edits, lambda e, i: F.concat(F.substring(text, begin(i) + 1, e["start"] - begin(i)), e["replacement"]))
    tail = F.coalesce(F.get(edits, F.size(edits) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, tail + 1, F.char_length(text)))


def moved(position: Column, edits: Column) -> Column:
    """Where a gap of the text lies after its (ordered) edits: what an edit took away is at the beginning of what replaced it."""
    inside = F.get(F.filter(edits, lambda e: (e["start"] <= position) & (position < e["end"])), F.lit(0))
    base = F.coalesce(inside["start"], position)
    grown = F.aggregate(F.filter(edits, lambda e: e["end"] <= base), F.lit(0), lambda n, e: n + F.char_length(e["replacement"]) - (e["end"] - e["start"]))
    return base + grown


def moved_span(start: Column, end: Column, *rewrites: Column) -> Column:
    """A span after one rewrite, or after several, each of which began at the text of the one before."""
    for edits in rewrites:
        start, end = moved(start, edits), moved(end, edits)
    return F.struct(start.alias("start"), end.alias("end"))
