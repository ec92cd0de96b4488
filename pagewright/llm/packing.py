"""Best-fit packing: a grouping genetic algorithm on islands, with migration of elite bins.

Documents become token ids (whole texts, then an end id); only those longer than a sequence are cut, into full
pieces behind a first, shorter one. Full pieces are sequences of their own. The others are dealt to islands of a
bounded number of pieces. On an island, individuals are whole packings. Crossover takes the well-filled bins of one
parent over into the other, removes the bins there that hold a piece twice, and puts the displaced pieces back by
best fit, longest first. After a first epoch each island gets its neighbour's packing; the patterns of the best bins
found there (their lengths) are set up from own pieces and enter the population. A last round deals the pieces of
badly filled bins of all islands anew.

Islands depend on row numbers, not on keys or lengths, so that no group of equal documents makes one large.

Defined results: null and empty texts are documents of the end id alone; repeated rows are packed each by itself;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped
from .token_count import VOCABULARY, counter


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    end_id: int = 2
    vocabulary: str = VOCABULARY
    #: Pieces that an island has on average.
    island_size: int = 2048
    population: int = 6
    generations: int = 8
    #: Bins filled less than this are dealt anew in the last round.
    well_filled: float = 0.995


def token_ids(text: str, vocabulary: str) -> array:
    """The ids of a whole text; the strings of special tokens are those tokens, as in the library."""
    own = counter(vocabulary)
    ordinary = own.bpe.encode_ordinary
    if not any(s in text for s in own.special):
        return array("I", ordinary(text))
    ids = array("I")
    for part, special in own.segments(text):
        ids.extend([own.special[part]] if special else ordinary(part))
    return ids


def pieces(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document, cut where it is too long."""
    size = params.capacity

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = token_ids(text, params.vocabulary)
                ids.append(params.end_id)
                raw, n = ids.tobytes(), len(ids)
                at = 0
                for k, end in enumerate(range((n - 1) % size + 1, n + 1, size)):
                    rows.append((doc_id, k, at, end - at, zlib.crc32(raw[4 * at : 4 * end])))
                    at = end
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """An individual: bins (lists of piece numbers) and their free room."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def add(self, bin_: list[int]) -> None:
        self.bins.append(bin_)
        self.room.append(self.capacity - sum(self.lengths[i] for i in bin_))

    def best_fit(self, loose: list[int]) -> Packing:
        """Put the loose pieces where least room is left, in the order given."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0  # bit r: some bin has r free
        for k, r in enumerate(self.room):
            if r:
                by_room[r].append(k)
                mask |= 1 << r
        for i in loose:
            n = self.lengths[i]
            fits = mask >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                k = by_room[r].pop()
                if not by_room[r]:
                    mask ^= 1 << r
                self.bins[k].append(i)
            else:
                k, r = len(self.bins), self.capacity
                self.bins.append([i])
                self.room.append(0)
            self.room[k] = left = r - n
            if left:
                by_room[left].append(k)
                mask |= 1 << left
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)

    def filled(self) -> list[list[int]]:
        return [self.bins[k] for k in sorted(range(len(self.bins)), key=self.room.__getitem__)]


def crossed(taker: Packing, injected: list[list[int]]) -> Packing:
    """The taker with the injected bins; what it held of their pieces goes, the rest of those bins is fitted again."""
    child = Packing(taker.lengths, taker.capacity)
    taken = {i for b in injected for i in b}
    for b in injected:
        child.add(list(b))
    loose = []
    for b in taker.bins:
        if taken.isdisjoint(b):
            child.add(list(b))
        else:
            loose += [i for i in b if i not in taken]
    loose.sort(key=lambda i: -child.lengths[i])
    return child.best_fit(loose)


def set_up(lengths: list[int], patterns: list[tuple[int, ...]]) -> list[list[int]]:
    """Bins after the patterns, from pieces of these lengths, as far as there are any."""
    free: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        free.setdefault(n, []).append(i)
    out = []
    for pattern in patterns:
        if all(len(free.get(n, ())) >= k for n, k in Counter(pattern).items()):
            out.append([free[n].pop() for n in pattern])
    return out


def evolve(lengths: list[int], start: list[Packing], elite: list[tuple[int, ...]], params: PackParams, seed: int) -> Packing:
    rng = random.Random(seed)
    size = params.capacity
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [*start, Packing(lengths, size).best_fit(order)]
    if elite:
        people.append(crossed(people[-1], set_up(lengths, elite)))
    while len(people) < params.population:  # longest first, but for chance
        people.append(Packing(lengths, size).best_fit(sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))))
    least = -(-sum(lengths) // size)
    for _ in range(params.generations):
        people.sort(key=Packing.fitness, reverse=True)
        if len(people[0].bins) <= least:
            break
        people = people[: params.population]
        for _ in range(params.population // 2):
            giver, taker = rng.sample(people, 2)
            good = giver.filled()[: max(1, len(giver.bins) // 2)]
            people.append(crossed(taker, rng.sample(good, max(1, len(good) // 2))))
    return max(people, key=Packing.fitness)


COLUMNS = "rid long, doc_id string, piece int, start long, length long, ids_crc32 long, island long, bin long"


def placed(items: pd.DataFrame, best: Packing) -> pd.DataFrame:
    bins = [0] * len(items)
    for k, members in enumerate(best.bins):
        for i in members:
            bins[i] = k
    return items.assign(bin=bins)


def packed(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """The pieces with sequence_id and offset."""
    size, scratch = params.capacity, Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, params).withColumns({"rid": F.monotonically_increasing_id(), "doc_id": F.col("doc_id").cast("string")}), "pieces")
    full = cut.filter(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < size)

    def dealt(rows: DataFrame, salt: int) -> tuple[DataFrame, int]:
        islands = max(1, round(rows.count() / params.island_size))
        return rows.withColumn("island", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(islands).cast("long"))), islands

    def first(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("rid", ignore_index=True)
        return placed(items, evolve(items["length"].tolist(), [], [], params, int(items["island"].iloc[0])))

    def second(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own
        own = own.sort_values("rid", ignore_index=True)
        lengths = own["length"].tolist()
        mine = Packing(lengths, size)
        for _, members in own.groupby("bin").indices.items():
            mine.add(members.tolist())
        fill = near.groupby("bin")["length"].agg(["sum", tuple]).sort_values("sum", ascending=False)
        elite = fill["tuple"].tolist()[: max(1, len(fill) // 4)] if len(fill) else []
        return placed(own, evolve(lengths, [mine], elite, params, ~int(own["island"].iloc[0])))

    items, islands = dealt(rest, 0)
    one = scratch.write(items.groupBy("island").applyInPandas(first, COLUMNS), "first")
    moved = one.select(F.pmod(F.col("island") + 1, F.lit(islands).cast("long")).alias("island"), "bin", "length")
    two = scratch.write(one.groupBy("island").cogroup(moved.groupBy("island")).applyInPandas(second, COLUMNS), "second")
    scratch.drop("first")
    # What stands in badly filled bins is dealt once more, over fewer islands.
    fill = two.groupBy("island", "bin").agg(F.sum("length").alias("fill"))
    two = scratch.write(two.join(fill, ["island", "bin"]), "filled")
    scratch.drop("second")
    bad = F.col("fill") < params.well_filled * size
    again, _ = dealt(two.filter(bad).drop("island", "bin", "fill"), 1)
    last = again.groupBy("island").applyInPandas(first, COLUMNS).withColumn("round", F.lit(1))
    done = two.filter(~bad).drop("fill").withColumn("round", F.lit(0)).unionByName(last)

    def offsets(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["bin", "rid"], ignore_index=True)
        return batch.assign(offset=batch.groupby("bin")["length"].cumsum() - batch["length"])

    placed_rows = done.groupBy("round", "island").applyInPandas(offsets, COLUMNS + ", round int, offset long")
    number = (F.col("round").cast("long") * (1 << 40) + F.col("island")) * (1 << 22) + F.col("bin")
    out = placed_rows.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset").unionByName(full)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
