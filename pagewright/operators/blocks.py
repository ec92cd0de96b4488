"""All questions against all rows, a block of questions and a block of rows at a time.

Both sides are tables of blocks that lie in files, arrays as bytes. Spark pairs their partitions, and a task goes through the pairs of
its own; nothing is collected or broadcast, and a task holds one pair of blocks and the k best of one block of questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far a sum may lie below the floor through rounding.
SLACK = 1e-8


def paired(questions: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the pairs of a block of questions and a block of rows, by task."""
    return questions.crossJoin(rows.hint("shuffle_replicate_nl")).mapInPandas(run, schema)


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores: where they lie, if no partition has more than half of a core's part of them; else (a table in a few large row groups) dealt by key."""
    sizes = [r["count"] for r in rows.select(F.spark_partition_id().alias("partition")).groupBy("partition").count().collect()]  # a row a partition
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if 2 * cores * max(sizes, default=0) <= sum(sizes) else rows.repartition(key)


class Best:
    """The k best rows of each question of a block so far; equal scores go by id."""

    def __init__(self, k: int, size: int) -> None:
        self.k, self.floor = k, np.full(size, -np.inf)
        self.at, self.scores, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, scores = np.concatenate([self.at, at]), np.concatenate([self.scores, np.round(scores, 9)])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        order = order[place < self.k]
        self.at, self.scores, self.ids = at[order], scores[order], ids[order]
        last = self.at[self.k - 1 :][self.at[self.k - 1 :] == self.at[: len(self.at) - self.k + 1]] if len(self.at) >= self.k else self.at[:0]
        self.floor[last] = self.scores[np.searchsorted(self.at, last, "right") - 1]

    def told(self, names: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(self.at):
            yield pd.DataFrame({"query_id": names[self.at], "chunk_id": self.ids, "score": self.scores})


def best_of(k: int, candidates):
    """Pairs of blocks to the k best of each question in a task; ``candidates(pair, best)`` gives (question, score, id) that may be among them."""

    def run(batches):
        block, names, best = None, None, None
        for batch in batches:
            for pair in batch.itertuples(index=False):
                if pair.block != block:
                    if best:
                        yield from best.told(names)
                    block, names = pair.block, np.asarray(pair.query_ids)
                    best = Best(k, len(names))
                for found in candidates(pair, best):
                    best.add(*found)
        if best:
            yield from best.told(names)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
