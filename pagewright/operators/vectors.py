"""A stored vector index in cells, and exact nearest neighbours.

Cells are the clusters of k-means over a sample; every vector lies in the cell of its nearest centre, and a cell is a
folder. A question looks into its nearest cells until they hold as many candidates as were asked for, so the scan lists
those cells alone; candidates are then ranked by their exact cosine. Without a number of candidates all cells are looked
into, and the result is exact. How many candidates a wanted recall takes depends on the vectors (few where they are in clusters, most
of them where they are random), so a build measures it, with some of its own vectors as questions.

A task ranks what it reads in numpy, a batch of vectors against all questions that ask for their cell (or, in an exact search, block
by block), and hands on k rows a question at most. Pairs of question and vector are rows in ``similarities`` alone, which is all of them.
"""

from __future__ import annotations

import uuid
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, with_code
from ..sources.store import Log
from . import blocks

#: Bytes of question vectors that travel to each task; more questions are further passes.
QUESTION_BYTES = 64 << 20
SAMPLE, MAX_CELLS = 20_000, 4096
#: Vectors of a block, in bytes, and how many of them at most; rows that are handed on at a time.
BLOCK_BYTES, BLOCK, ROWS = 2 << 20, 1024, 1 << 18
#: Vectors of the sample that are questions to the new index, and how many neighbours each is asked for.
PROBES, PROBED = 100, 15


def _length(column: str):
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; equal ones go by id."""
    some = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _ranked(questions: np.ndarray, asked: dict[int, np.ndarray], k: int):
    """Batches of (cell, chunk_id, embedding) to the k best (question, chunk_id, score) of each question in this task.

    ``questions`` has a unit vector a row; ``asked`` the questions by cell.
    """

    def run(batches):
        ids: list[np.ndarray] = [np.empty(0, object)] * len(questions)
        best: list[np.ndarray] = [np.empty(0)] * len(questions)
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                who = asked.get(int(cell), ())
                if not len(who):
                    continue
                vectors = np.array(rows["embedding"].to_list(), np.float64)
                vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
                names, scores = rows["chunk_id"].to_numpy(), np.round(vectors @ questions[who].T, 9)
                for j, q in enumerate(who):
                    all_ids, all_scores = np.concatenate([ids[q], names]), np.concatenate([best[q], scores[:, j]])
                    at = _best(all_scores, all_ids, k)
                    ids[q], best[q] = all_ids[at], all_scores[at]
        found = [(q, i, s) for q in range(len(questions)) for i, s in zip(ids[q], best[q])]
        if found:
            yield pd.DataFrame(found, columns=["question", "chunk_id", "score"])

    return run


def _questions(queries: DataFrame):
    """Blocks (query_ids, unit vectors) of questions (query_id, embedding); those without length have no neighbours."""
    rows = queries.select("query_id", "embedding").filter(_length("embedding") > 0)
    stream = rows.toLocalIterator()
    names, vectors, size = [], [], 0
    for r in stream:
        names.append(r["query_id"])
        vectors.append(np.array(r["embedding"], np.float64))
        size += vectors[-1].nbytes
        if size >= QUESTION_BYTES:
            yield names, _unit(vectors)
            names, vectors, size = [], [], 0
    if names:
        yield names, _unit(vectors)


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    m = np.stack(vectors)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _nearest(scan, queries: DataFrame, k: int, asked) -> DataFrame:
    """query_id, chunk_id, score, rank; ``scan`` gives the vectors (cell, chunk_id, embedding) of the cells that a block of questions asks for."""
    spark, schema = with_code(queries.sparkSession), queries.schema["query_id"].dataType.simpleString()
    out = None
    for names, vectors in _questions(queries):
        cells = asked(vectors)
        rows = scan(sorted(cells))
        kind = rows.schema["chunk_id"].dataType.simpleString()
        found = rows.select("cell", "chunk_id", "embedding").mapInPandas(_ranked(vectors, cells, k), f"question int, chunk_id {kind}, score double")
        local = spark.createDataFrame(pd.DataFrame({"question": np.arange(len(names), dtype=np.int32), "query_id": names}), f"question int, query_id {schema}")
        w = Window.partitionBy("question").orderBy(F.desc("score"), "chunk_id")
        best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(F.broadcast(local), "question").select("query_id", "chunk_id", "score", "rank")
        out = best if out is None else out.unionByName(best)
    if out is None:
        kind = scan(None).schema["chunk_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {schema}, chunk_id {kind}, score double, rank int")
    return out


def _blocks(rows: DataFrame, id_: str, name: str, path: str) -> DataFrame:
    """Blocks (``name``: ids, ``name``_vectors: unit vectors as bytes) of rows (``id_``, embedding); those without length are left out."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches):
        for batch in batches:
            matrix = _unit([np.array(v, np.float64) for v in batch["embedding"]])
            step, ids = max(1, min(BLOCK, BLOCK_BYTES // matrix[0].nbytes)), batch[id_].to_numpy()
            at = range(0, len(ids), step)
            yield pd.DataFrame({name: [ids[i : i + step] for i in at], f"{name}_vectors": [matrix[i : i + step].tobytes() for i in at]})

    with_code(rows.sparkSession)
    packed = rows.select(id_, "embedding").filter(_length("embedding") > 0).mapInPandas(run, f"{name} array<{kind}>, {name}_vectors binary")
    return blocks.kept(packed.withColumn("block", F.monotonically_increasing_id()) if name == "query_ids" else packed, path)


def _both(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    folder = f"{shared_dir(queries.sparkSession)}/nearest-{uuid.uuid4().hex}"
    return _blocks(queries, "query_id", "query_ids", f"{folder}/questions"), _blocks(vectors, "chunk_id", "chunk_ids", f"{folder}/vectors")


def _kinds(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"


def _cosines(pair) -> np.ndarray:
    a, b = (np.frombuffer(v).reshape(len(ids), -1) for ids, v in ((pair.query_ids, pair.query_ids_vectors), (pair.chunk_ids, pair.chunk_ids_vectors)))
    return a @ b.T


def _near(k: int):
    def candidates(pair, best: blocks.Best):
        scores, floor = _cosines(pair), best.floor
        if scores.shape[1] > k and (floor == -np.inf).any():
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
        at, which = np.nonzero(scores >= floor[:, None] - blocks.SLACK)
        yield at, scores[at, which], np.asarray(pair.chunk_ids)[which]

    return candidates


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k vectors (chunk_id, embedding) with the largest cosine to each question's; exact."""
    asked, stored = _both(vectors, queries)
    return blocks.ranked(blocks.paired(asked, stored, blocks.best_of(k, _near(k)), _kinds(vectors, queries)), k)


def similarities(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: the cosine of every question (query_id, embedding) and every vector (chunk_id, embedding)."""

    def run(batches):
        for batch in batches:
            for pair in batch.itertuples(index=False):
                names, ids, scores = np.asarray(pair.query_ids), np.asarray(pair.chunk_ids), np.round(_cosines(pair), 9)
                step = max(1, ROWS // len(ids))
                for i in range(0, len(names), step):
                    some = names[i : i + step]
                    yield pd.DataFrame({"query_id": np.repeat(some, len(ids)), "chunk_id": np.tile(ids, len(some)), "score": scores[i : i + step].ravel()})

    return blocks.paired(*_both(vectors, queries), run, _kinds(vectors, queries)).select("query_id", "chunk_id", "score")


class VectorIndex:
    """The index in a folder. A new build is a new version; readers of the old one go on reading it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, log = spark, path.rstrip("/"), Log(spark, f"{path}/_log")
        self.number, self.about = log.latest()
        if not self.number:
            raise FileNotFoundError(f"no index in {path}")
        self.folder, self.sizes = f"{self.path}/{self.about['folder']}", {int(c): n for c, n in self.about["sizes"].items()}

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 1, recall: float = 0.95) -> VectorIndex:
        """Clusters at most ``sample`` vectors (those with the smallest hash of their id), then places every vector (chunk_id, embedding).

        By default there are as many cells as the square root of the number of vectors, 4096 at most. ``recall`` is the
        share of the nearest that a search by default finds; the number of candidates for it comes from PROBES questions.
        """
        spark, name = vectors.sparkSession, f"data/{uuid.uuid4().hex}"
        rows = vectors.select("chunk_id", "embedding").filter(_length("embedding") > 0)
        n = rows.count()
        cells = max(1, min(cells or isqrt(n), MAX_CELLS, sample))
        some = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(array_to_vector("embedding").alias("features"))
        about, kind = {"folder": name, "vectors": n, "centres": [], "sizes": {}}, vectors.schema
        if n:
            model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some) if cells > 1 else None
            about["centres"] = [c.tolist() for c in model.clusterCenters()] if model else [[0.0]]
            placed = model.transform(rows.withColumn("features", array_to_vector("embedding"))).select("chunk_id", "embedding", F.col("prediction").alias("cell")) if model else rows.withColumn("cell", F.lit(0))
            placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/{name}/cells")
            sizes = spark.read.parquet(f"{path}/{name}/cells").groupBy("cell").count().collect()  # MAX_CELLS rows at most
            about["sizes"] = {str(r["cell"]): r["count"] for r in sizes}
        about["id"], about["embedding"] = kind["chunk_id"].dataType.simpleString(), kind["embedding"].dataType.simpleString()
        about["candidates"] = cls._needed(spark, f"{path}/{name}", about, rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(PROBES), recall) if n else 0
        log = Log(spark, f"{path}/_log")
        while not log.take(log.latest()[0] + 1, about):
            pass
        return cls(spark, path)

    @staticmethod
    def _needed(spark: SparkSession, folder: str, about: dict, probes: DataFrame, recall: float) -> int:
        """How many candidates hold the wanted share of the questions' exact neighbours."""
        placed = spark.read.parquet(f"{folder}/cells")
        asked = probes.select(F.col("chunk_id").alias("query_id"), "embedding")
        exact = nearest(placed, asked, PROBED).select("query_id", "chunk_id")
        where = exact.join(placed.select("chunk_id", "cell"), "chunk_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(asked, "query_id").collect()  # PROBES rows
        sizes = np.array([about["sizes"].get(str(c), 0) for c in range(len(about["centres"]))])
        if len(sizes) < 2:
            return int(sizes.sum())
        order = np.argsort(-(_unit([np.array(r["embedding"], np.float64) for r in where]) @ _unit([np.array(c) for c in about["centres"]]).T), axis=1, kind="stable")
        upto = np.cumsum(sizes[order], axis=1)
        needs = sorted(int(upto[q, np.flatnonzero(order[q] == c)[0]]) for q, r in enumerate(where) for c in r["cells"])
        return needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))]

    def scan(self, cells: list[int] | None = None) -> DataFrame:
        """cell, chunk_id, embedding, from the folders of some cells or of all."""
        schema = f"chunk_id {self.about['id']}, embedding {self.about['embedding']}, cell int"
        if not self.sizes:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/cells")
        return rows if cells is None else rows.filter(F.col("cell").isin(cells))

    def _asked(self, candidates: int):
        centres = _unit([np.array(c) for c in self.about["centres"]]) if len(self.about["centres"]) > 1 else None
        sizes = np.array([self.sizes.get(c, 0) for c in range(len(self.about["centres"]))])

        def of(questions: np.ndarray) -> dict[int, np.ndarray]:
            if centres is None:
                return {0: np.arange(len(questions))}
            order = np.argsort(-(questions @ centres.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            asked: dict[int, list[int]] = {}
            for q, c in zip(*np.nonzero(before < candidates)):
                asked.setdefault(int(order[q, c]), []).append(int(q))
            return {c: np.array(q) for c, q in asked.items()}

        return of

    @property
    def candidates(self) -> int:
        """How many vectors a question looks at to find the share of its nearest that the build was asked for."""
        return self.about["candidates"]

    def top(self, queries: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank of the k nearest to each question (query_id, embedding).

        Each question looks at ``candidates`` vectors or more, of its nearest cells; at all of them without that number.
        """
        return _nearest(self.scan, queries, k, self._asked(max(candidates, k))) if candidates else nearest(self.scan(), queries, k)

    def recall(self, queries: DataFrame, k: int, candidates: int) -> float:
        """The share of the exact k nearest that are found among ``candidates``."""
        exact, found = self.top(queries, k).select("query_id", "chunk_id"), self.top(queries, k, candidates).select("query_id", "chunk_id")
        total = exact.count()
        return exact.join(found, ["query_id", "chunk_id"], "left_semi").count() / total if total else 1.0
