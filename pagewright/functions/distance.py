"""Edit distance of texts of any length.

Short pairs are measured by Spark's own function, long ones with bit vectors, once their common beginning and end are off: a
column of the distance table is two whole numbers of as many bits as the text has letters, so a step is a few operations on
them. (Spark's limited distance isn't used for long pairs: it looks for each letter from the beginning of the text.)
"""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of up to so many cells of the table are short.
CELLS = 4_000_000


def bit_distance(a: str, b: str) -> int:
    """Edit distance in len(b) steps over numbers of len(a) bits: ups and downs between neighbours of a column."""
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for letter in set(a):
        where[letter] = int("".join("1" if c == letter else "0" for c in reversed(a)), 2)
    up, down, distance = full, 0, len(a)
    for letter in b:
        same = where.get(letter, 0)
        keeps = same | down
        diagonal = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(rises & top) - bool(falls & top)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | (full & ~(keeps | rises)), rises & keeps
    return distance


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance in code points, null if one is null."""
    # Made here: a pandas function needs a session.
    @F.pandas_udf("int")
    def by_bits(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else bit_distance(x, y) for x, y in zip(first, second)], dtype="Int32")

    small = F.coalesce(F.char_length(a).cast("long") * F.char_length(b) <= CELLS, F.lit(True))
    return F.when(small, F.levenshtein(a, b)).otherwise(by_bits(F.when(~small, a), F.when(~small, b)))
