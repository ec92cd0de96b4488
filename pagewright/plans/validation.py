"""Bulk validation: one gesture of a reviewer approves what is left of each document, as it was shown, or nothing of it.

Whether a document may be approved, its new revisions, what becomes of it and its indexing job are one plan over all
documents that were asked for; writing them is one commit of the revisions, which fails as a whole where somebody else has
written one of the same numbers meanwhile, and then the jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REVIEWABLE
from ..operators.review import bulk_approved, conflicts, page_summaries
from ..sources.sinks import revisions_store
from ..sources.store import Duplicate, Store

#: What a conflict of ``conflicts`` is called.
REFUSALS = {1: "other pages", 2: "a page without text", 3: "a page has changed"}


@dataclass(frozen=True)
class Validation:
    """results: document_id, verdict, validated_pages, already_validated, document_status, index_job; the new revisions; the new jobs."""

    results: DataFrame
    revisions: DataFrame
    jobs: DataFrame
    at: Column


def validation(documents: DataFrame, pages: DataFrame, revisions: DataFrame, displayed: DataFrame, at: Column) -> Validation:
    """For documents (document_id, status), with what the reviewer saw: ``displayed`` (document_id, page_id, revision).

    A document's verdict is ok, "not transcribed" by its status, or a conflict between what was shown and what is there. Pages that are
    validated already count apart. A document that gets a new revision is validated, and gets one indexing job.
    """
    now = page_summaries(pages, revisions)
    asked = documents.select("document_id", "status")
    mine = now.join(asked.select("document_id"), "document_id", "left_semi")
    seen = displayed.join(asked.select("document_id"), "document_id", "left_semi")
    refusal = F.when(~F.col("status").isin(*REVIEWABLE), "not transcribed")
    for kind, name in REFUSALS.items():
        refusal = refusal.when(F.col("conflict") == kind, name)
    judged = asked.join(conflicts(seen, mine), "document_id", "left").select("document_id", "status", refusal.otherwise("ok").alias("verdict"))
    good = judged.filter("verdict = 'ok'").select("document_id")
    own = revisions.join(pages.join(good, "document_id", "left_semi").select("page_id"), "page_id", "left_semi")
    new = bulk_approved(own)
    open_ = F.col("state") != "validated"
    counts = mine.groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(open_, F.col("page_number")))).alias("open"), F.count_if(~open_).alias("already"))
    rows = judged.join(counts, "document_id", "left")
    ok = F.col("verdict") == "ok"
    some = ok & (F.coalesce(F.size("open"), F.lit(0)) > 0)
    results = rows.select(
        "document_id", "verdict", F.when(some, F.col("open")).otherwise(F.array().cast(rows.schema["open"].dataType)).alias("validated_pages"), F.when(ok, F.coalesce("already", F.lit(0))).otherwise(0).cast("bigint").alias("already_validated"),
        F.when(some, "validated").otherwise(F.col("status")).alias("document_status"), some.alias("index_job"),
    )
    return Validation(results, new, index_jobs(results, at), at)


def index_jobs(results: DataFrame, at: Column) -> DataFrame:
    """One queued indexing job for each document that has been validated now."""
    job_id = F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.lit("index"), at.cast("string")), 256)
    return results.filter("index_job").select(job_id.alias("id"), F.col("document_id").cast("string").alias("document_id"), F.lit("index").alias("kind"), F.lit("queued").alias("status"), at.alias("created_at"))


def validate(root: str, jobs: Store, found: Validation) -> DataFrame:
    """Writes a validation below ``root`` and returns its results; a revision that somebody else has written meanwhile refuses all.

    Results are taken before anything is written: afterwards the same plan would find nothing left to approve.
    """
    spark = found.results.sparkSession
    results = spark.createDataFrame(found.results.toArrow(), found.results.schema)  # a row for each document of one gesture
    try:
        revisions_store(spark, root, found.revisions).append(found.revisions)
    except Duplicate as clash:
        raise Duplicate("another validation has just written on these pages: load them again") from clash
    jobs.append(index_jobs(results, found.at))
    return results
