"""The job log: last jobs, state machine, admission, delete guard, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTIVE_JOBS, REINDEXABLE


def last_jobs(jobs: DataFrame, *keys: str) -> DataFrame:
    """The most recent job of each key; equal times go by id."""
    row = F.struct(*[F.col(c) for c in jobs.columns if c not in keys])
    return jobs.groupBy(*keys).agg(F.max_by(row, F.struct("created_at", "job_id")).alias("row")).select(*keys, "row.*")


def state_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Current status of each job: its last event, else how it was queued."""
    now = events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "seq")).alias("now"), F.max_by("error", F.struct("at", "seq")).alias("error"))
    return jobs.join(now, "job_id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def ocr_admission(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether a transcription may start: preprocessed, or failed in a transcription; never beside an active one."""
    last = last_jobs(jobs, "document_id").select("document_id", F.col("kind").alias("last_kind"))
    active = jobs.filter((F.col("kind") == "transcribe") & F.col("status").isin(*ACTIVE_JOBS)).select("document_id").distinct().withColumn("active", F.lit(True))
    rows = documents.join(last, "document_id", "left").join(active, "document_id", "left")
    verdict = (
        F.when(F.col("active"), "already running")
        .when(F.col("status") == "preprocessed", "admitted")
        .when((F.col("status") == "failed") & (F.col("last_kind") == "transcribe"), "admitted")
        .otherwise("refused")
    )
    return rows.select("document_id", "status", verdict.alias("verdict"))


def enqueued(documents: DataFrame, jobs: DataFrame, kind: str, at: Column) -> DataFrame:
    """New queued jobs (job_id, document_id, kind, status, created_at) of the documents whose status admits ``kind``.

    A transcription starts by ``ocr_admission``, preprocessing with a new document, indexing with a validated one; never
    beside an active job of the same kind. The id comes from document, kind and time, so a task that runs again gives it anew.
    """
    if kind == "transcribe":
        ready = ocr_admission(documents, jobs).filter("verdict = 'admitted'")
    else:
        statuses = {"preprocess": ("new",), "index": REINDEXABLE}[kind]
        active = jobs.filter((F.col("kind") == kind) & F.col("status").isin(*ACTIVE_JOBS))
        ready = documents.filter(F.col("status").isin(*statuses)).join(active, "document_id", "left_anti")
    job_id = F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.lit(kind), at.cast("string")), 256)
    return ready.select(job_id.alias("job_id"), "document_id", F.lit(kind).alias("kind"), F.lit("queued").alias("status"), at.alias("created_at"))


def deletable(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents without an active job."""
    return documents.join(jobs.filter(F.col("status").isin(*ACTIVE_JOBS)), "document_id", "left_anti")


def pages_to_do(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """Pages that no machine has read yet: a hand-typed page still needs its reading."""
    return pages.join(revisions.filter(F.col("origin") == "ocr"), "page_id", "left_anti")


def pages_transcribed(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every document with the number of its pages that a machine has read, 0 where none."""
    read = revisions.filter(F.col("origin") == "ocr").select("page_id").distinct()
    counts = pages.join(read, "page_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("document_id").distinct().join(counts, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("pages_transcribed"))


def document_progress(documents: DataFrame) -> DataFrame:
    """Share of a document's pages that are done, from status, done and total."""
    part = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("done").cast("double"), F.col("total").cast("double")), F.lit(0.0)))
    share = (
        F.when(F.col("status").isin("awaiting_validation", "validated", "indexed"), 1.0)
        .when(F.col("status") == "transcribing", part)
        .when((F.col("status") == "failed") & (F.col("done") > 0), part)
        .otherwise(0.0)
    )
    action = F.when(F.col("status") == "preprocessed", "launch").when(F.col("status") == "failed", "relaunch")
    return documents.select("document_id", "status", share.alias("progress"), F.col("status").isin("new", "preprocessing", "transcribing").alias("in_progress"), action.alias("ocr_action"))
