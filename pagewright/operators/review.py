"""Review of pages: revisions, states, scores, conflicts, approval, progress.

Revisions are append-only; whatever is current is an aggregate or a window over them. Latest-per-key uses max_by,
which combines on the map side, so a page with very many revisions costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALERT_BELOW, PACKET, REVIEWABLE
from ..functions.text import ustrip


def latest(revisions: DataFrame, where: Column | None = None) -> DataFrame:
    """The row of the highest revision of each page, among those that meet ``where``."""
    rows = revisions if where is None else revisions.filter(where)
    row = F.struct(*[F.col(c) for c in rows.columns if c != "page_id"])
    return rows.groupBy("page_id").agg(F.max_by(row, "revision").alias("row")).select("page_id", "row.*")


def latest_validated(revisions: DataFrame) -> DataFrame:
    """What is indexed: a newer draft doesn't count."""
    return latest(revisions, F.col("is_validated"))


def latest_by_origin(revisions: DataFrame, origin: str, validated: bool = False) -> DataFrame:
    """``validated``: read and approved one by one, not in bulk."""
    where = F.col("origin") == origin
    return latest(revisions, where & F.col("is_validated") & ~F.col("bulk_validated") if validated else where)


def machine_reading(revisions: DataFrame) -> DataFrame:
    """The normalised reading if a page has one, else the raw one; never a human's."""
    rows = revisions.filter(F.col("origin").isin("normalized", "ocr"))
    row = F.struct("revision", "origin", "content")
    best = F.struct((F.col("origin") == "normalized").alias("p"), F.col("revision"))
    return rows.groupBy("page_id").agg(F.max_by(row, best).alias("row")).select("page_id", "row.*")


def next_revision(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    top = revisions.groupBy("page_id").agg(F.max("revision").alias("top"))
    return pages.join(top, "page_id", "left").select("page_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_revision"))


def appended(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` behind ``revisions``, numbered on; rows whose key is already there are refused."""
    clash = new.join(revisions, ["page_id", "revision"], "left_semi").select(F.lit(True).alias("clash")).limit(1)
    if not clash.isEmpty():
        raise ValueError("a revision of this number exists")
    return revisions.unionByName(new, allowMissingColumns=True)


def page_scores(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """The worst block counts, never the mean."""
    return blocks.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("score"))).alias("score"))


def page_summaries(pages: DataFrame, revisions: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One row a page: latest revision, state, score, approved in bulk only. ``blocks`` has page_id, revision, score."""
    flags = revisions.groupBy("page_id").agg(
        F.max("revision").alias("latest_revision"),
        F.max_by("origin", "revision").alias("latest_origin"),
        F.bool_or("is_validated").alias("any_validated"),
        (F.bool_or("is_validated") & F.coalesce(F.every(F.when(F.col("is_validated"), F.col("bulk_validated"))), F.lit(False))).alias("bulk_validated"),
    )
    out = pages.join(flags, "page_id", "left")
    state = (
        F.when(F.col("latest_revision").isNull(), "untranscribed")
        .when(F.col("any_validated"), "validated")
        .when(F.col("latest_origin") == "human", "draft")
        .otherwise("to_review")
    )
    score = F.when(F.col("latest_revision").isNotNull(), F.lit(1.0))
    if blocks is not None:
        worst = blocks.groupBy("page_id", "revision").agg(F.min("score").alias("worst"))
        out = out.join(worst.withColumnRenamed("revision", "latest_revision"), ["page_id", "latest_revision"], "left")
        score = F.when(F.col("latest_revision").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("worst", F.lit(1.0)))))
    return out.select(*pages.columns, "latest_revision", state.alias("state"), score.alias("score"), F.coalesce("bulk_validated", F.lit(False)).alias("bulk_validated"))


#: Named filters of the gallery, over page summaries.
GALLERY = {
    "all": lambda: F.lit(True),
    "to_review": lambda: F.col("state") != "validated",
    "alerts": lambda: F.coalesce(F.col("score") < ALERT_BELOW, F.lit(False)),
    "validated": lambda: F.col("state") == "validated",
}


def gallery(summaries: DataFrame, name: str) -> DataFrame:
    if name not in GALLERY:
        raise ValueError(f"no such filter: {name!r}")
    return summaries.filter(GALLERY[name]())


def completeness(summaries: DataFrame) -> DataFrame:
    """A document is complete when it has a page and all of its pages are validated."""
    return summaries.groupBy("document_id").agg((F.count(F.lit(1)) > 0).alias("has_pages"), F.every(F.col("state") == "validated").alias("complete")).select("document_id", (F.col("has_pages") & F.col("complete")).alias("complete"))


def progress(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("document_id").agg(
        F.count_if(F.col("state") == "validated").alias("validated"),
        F.count(F.lit(1)).alias("total"),
        F.array_sort(F.collect_list(F.when(GALLERY["alerts"](), F.col("page_number")))).alias("alerts"),
    )


def neighbours(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("page_number")
    return pages.select("document_id", "page_number", "page_id", F.lag("page_id").over(w).alias("previous_page"), F.lead("page_id").over(w).alias("next_page"))


def next_to_review(summaries: DataFrame) -> DataFrame:
    """The first page that isn't validated after each page, from the start again at the end, never the page itself."""
    open_page = F.when(F.col("state") != "validated", F.col("page_id"))
    w = Window.partitionBy("document_id").orderBy("page_number")
    after = F.first(open_page, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.first(open_page, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return summaries.select("document_id", "page_id", F.coalesce(after, before).alias("next_to_review"))


def packets(pages: DataFrame, size: int = PACKET) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("page_number")
    return pages.select("document_id", "page_id", F.floor((F.row_number().over(w) - 1) / size).alias("packet"))


def conflicts(displayed: DataFrame, summaries: DataFrame) -> DataFrame:
    """Displayed (document_id, page_id, revision) against what is there: the first kind of conflict of each document.

    1: the page sets differ, 2: a page has no text, 3: a revision differs; null: none.
    """
    shown = displayed.select("document_id", "page_id", F.col("revision").alias("shown"), F.lit(True).alias("is_shown"))
    there = summaries.select("document_id", "page_id", F.col("latest_revision").alias("there"), F.lit(True).alias("is_there"))
    kind = (
        F.when(F.col("is_shown").isNull() | F.col("is_there").isNull(), 1)
        .when(F.col("there").isNull(), 2)
        .when(F.col("shown") != F.col("there"), 3)
    )
    return shown.join(there, ["document_id", "page_id"], "full_outer").groupBy("document_id").agg(F.min(kind).alias("conflict"))


def bulk_approved(revisions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """New revisions that approve every page without a validated one: the latest text again, by a human, in bulk.

    With ``documents`` (document_id, status), only those in a reviewable status. One document is approved as a whole
    or not at all: callers join away those with a conflict.
    """
    rows = revisions
    if documents is not None:
        rows = rows.join(documents.filter(F.col("status").isin(*REVIEWABLE)), "document_id", "left_semi")
    row = F.struct(*[F.col(c) for c in rows.columns if c != "page_id"])
    open_ = rows.groupBy("page_id").agg(F.max_by(row, "revision").alias("row"), F.bool_or("is_validated").alias("done")).filter(~F.col("done"))
    return open_.select("page_id", "row.*").withColumns({"revision": F.col("revision") + 1, "origin": F.lit("human"), "is_validated": F.lit(True), "bulk_validated": F.lit(True)})


def references(typed: DataFrame, reread: DataFrame) -> DataFrame:
    """One reference a page: typed ones first; re-readings that are blank count nothing."""
    own = typed.select("page_id", F.col("content").alias("typed"))
    other = reread.filter(ustrip(F.col("content")) != "").select("page_id", F.col("content").alias("reread"))
    return own.join(other, "page_id", "full_outer").select("page_id", F.coalesce("typed", "reread").alias("content"), F.when(F.col("typed").isNotNull(), "typed").otherwise("reread").alias("reference_origin"))


def chunks(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """One chunk a page from its latest validated revision, blank ones left out."""
    texts = latest_validated(revisions).select("page_id", ustrip(F.col("content")).alias("content")).filter("content != ''")
    return pages.join(texts, "page_id").select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("page_number").cast("string")).alias("chunk_id"), "document_id", "page_number", "content")


def collected_chunks(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """The chunks of the documents of which every page has a validated revision; others not at all."""
    missing = pages.join(latest_validated(revisions), "page_id", "left_anti").select("document_id").distinct()
    return chunks(pages.join(missing, "document_id", "left_anti"), revisions)


def alerts_first(blocks: DataFrame, below: float = 0.5) -> DataFrame:
    """page_id, revision, alerts: the blocks below the threshold, the lowest score first; equal scores by method."""
    low = blocks.filter(F.col("score") < below).select("page_id", "revision", F.struct("score", "method").alias("block"))
    return low.groupBy("page_id", "revision").agg(F.array_sort(F.collect_list("block")).alias("alerts"))
