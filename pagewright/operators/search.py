"""Ranked retrieval: BM25 and vectors, over stored indexes or tables as they are, reciprocal rank fusion, answer context."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, CANDIDATE_FACTOR, MIN_CANDIDATES, NO_PASSAGE, RRF_K, VECTOR_FACTOR
from ..functions.analysis import analysed
from ..functions.models import embedded
from ..functions.text import bm25_idf, bm25_share, cut_passage
from ..session import shared_dir
from .blocks import kept, spread
from .lexical import LexicalIndex, best
from .vectors import VectorIndex, nearest

#: Up to so many terms of a batch of queries travel to all executors; more meet the texts in a shuffle.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def bm25(chunks: DataFrame, queries: DataFrame, french: bool = False) -> DataFrame:
    """query_id, chunk_id, score for queries (query_id, question): every chunk that shares a term.

    Reads the chunks themselves, for a corpus that has no LexicalIndex: one pass, in which a chunk keeps the queries' terms alone.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("question"), french, french))).alias("term"))
    lengths = chunks.select("chunk_id", analysed(F.col("content"), french, french).alias("terms"))
    matched = lengths.select("chunk_id", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(_small(wanted.select("term").distinct()), "term").groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("average"))
    df = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = matched.join(df, "term").join(F.broadcast(stats))  # one row
    part = bm25_share(bm25_idf(F.col("df"), F.col("n")), F.col("tf"), F.col("length"), F.col("average"), BM25_K1, BM25_B)
    return scored.withColumn("part", part).join(_small(wanted), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; equal scores go by chunk_id.

    Spark puts a rank limit below the exchange of a row_number filter, so each task sends k rows a query at most.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fused(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: scores depend on ranks alone."""
    rows = rankings[0].select("query_id", "chunk_id", "rank")
    for other in rankings[1:]:
        rows = rows.unionByName(other.select("query_id", "chunk_id", "rank"))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def depth(top_k: int) -> int:
    """How many hits of each ranking are fused."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    return max(CANDIDATE_FACTOR * top_k, MIN_CANDIDATES)


def shown(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a hit returns; never the vector. The hits are kept first: a batch's few meet the texts where these are read, which no shuffle sees."""
    hits = kept(found.select("query_id", "rank", "chunk_id", "score"), f"{shared_dir(found.sparkSession)}/hits-{uuid.uuid4().hex}")
    return _small(hits).join(chunks.select("chunk_id", "document_id", "page_number", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "document_id", "page_number", "content", "score")


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = 5, nulls: bool = True) -> DataFrame:
    """The top_k of BM25 and vectors fused, over tables as they are: one pass over the texts, none of them indexed. ``nulls`` as in ``best``."""
    n = depth(top_k)
    return shown(top(fused(best(chunks, queries, n, nulls=nulls), nearest(vectors, queries, n)), top_k), chunks)


def passages(max_chars: int) -> int:
    """How many passages fit into a context at most: none is shorter than the head of a page of an empty text, and each is followed by two letters."""
    return max_chars // (len("[1] page 1 du document 1\n") + 2) + 1


def places(lexical: DataFrame, vectors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank, wanted: two rankings (query_id, chunk_id, score) fused over their whole length, of which the k best and the ``wanted`` (query_id, chunk_id) are told.

    A chunk's share of a ranking is that of its place there, however far behind. All pairs are shuffled once, by question;
    a task sorts its own, and spills what memory doesn't hold.
    """
    kinds = [df.select("query_id", "chunk_id", score.alias("score"), F.lit(n).cast("byte").alias("kind")) for n, (df, score) in enumerate(((lexical, F.col("score")), (vectors, F.col("score")), (wanted, F.lit(None).cast("double"))))]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).repartition("query_id")
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "chunk_id"))
    share = F.when(F.col("kind") < 2, 1.0 / (RRF_K + place))
    each = rows.select("query_id", "chunk_id", share.alias("share"), (F.col("kind") == 2).alias("wanted"))
    sums = each.groupBy("query_id", "chunk_id").agg(F.round(F.sum("share"), 9).alias("score"), F.bool_or("wanted").alias("wanted")).filter(F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    found = sums.withColumn("rank", rank).filter((F.col("rank") <= k) | F.col("wanted"))
    return kept(found.select("query_id", "chunk_id", "score", "rank", "wanted"), f"{shared_dir(found.sparkSession)}/places-{uuid.uuid4().hex}")


def searched(lexical: LexicalIndex, vectors: VectorIndex, chunks: DataFrame, queries: DataFrame, top_k: int = 5, candidates: int | None = None) -> DataFrame:
    """The same over the stored indexes; the corpus is read for the hits' own texts alone.

    ``candidates`` is how many vectors a query looks at; all of them where it isn't given.
    """
    n = depth(top_k)
    return shown(top(fused(lexical.top(queries, n), vectors.top(queries, n, candidates)), top_k), chunks)


def search(lexical: LexicalIndex, vectors: VectorIndex, chunks: DataFrame, questions: DataFrame, embed, dim: int, top_k: int = 5, exact: bool = False) -> DataFrame:
    """From questions as they were typed (query_id, question) to hits: each gets its vector from the model that the chunks have theirs from.

    A question looks at five times as many vectors as are fused, or as many as the index has found to be needed; at all of them with ``exact``.
    """
    asked = embedded(questions.select("query_id", "question"), embed, dim, column="question")
    return searched(lexical, vectors, chunks, asked, top_k, None if exact else max(VECTOR_FACTOR * depth(top_k), vectors.candidates))


def one_batch(chunks: DataFrame, questions: DataFrame, embed, dim: int, top_k: int = 5) -> DataFrame:
    """What ``search`` gives with ``exact``, over chunks that have no index: texts get their vectors where they lie, and are read once more for their terms."""
    texts = spread(chunks.select("chunk_id", "content"), "chunk_id")
    asked = embedded(questions.select("query_id", "question"), embed, dim, column="question")
    return hybrid(chunks, embedded(texts, embed, dim), asked, top_k, nulls=False)


def context(hits: DataFrame, max_chars: int | Column) -> DataFrame:
    """query_id, context, sources: passages in order while they fit; the first that doesn't ends the list.

    ``max_chars`` may be a column of the hits: each query's own budget.

    Only the best passage is cut if it alone is too long. A query without a hit isn't in the result.
    """
    head = F.format_string("[%d] page %d du document %s\n", F.col("rank").cast("int"), F.col("page_number").cast("int"), F.col("document_id").cast("string"))
    rows = hits.withColumn("passage", F.concat(head, "content"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum(F.char_length("passage") + 2).over(w) - 2)
    fits = rows.filter((F.col("used") <= max_chars) | (F.col("rank") == 1))
    passage = F.when(F.col("used") <= max_chars, F.col("passage")).otherwise(cut_passage(F.col("passage"), max_chars))
    listed = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("passage"), "chunk_id"))).alias("own"))
    return listed.select("query_id", F.array_join(F.transform("own", lambda x: x["passage"]), "\n\n").alias("context"), F.transform("own", lambda x: x["chunk_id"]).alias("sources"))


def prompts(queries: DataFrame, contexts: DataFrame, rules: str) -> DataFrame:
    """Rules, then passages, then the question; null where there is no passage, with the fixed answer."""
    rows = queries.join(contexts, "query_id", "left")
    prompt = F.when(F.col("context").isNotNull(), F.concat(F.lit(rules + "\n\n"), "context", F.lit("\n\n"), "question"))
    return rows.select("query_id", prompt.alias("prompt"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.when(prompt.isNull(), NO_PASSAGE).alias("fixed_answer"))


def with_document_names(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """The file name of each hit's document, or a label from its id."""
    return hits.join(documents.select("document_id", "source_filename"), "document_id", "left").withColumn("label", F.coalesce("source_filename", F.concat(F.lit("document "), F.substring(F.col("document_id").cast("string"), 1, 8))))
