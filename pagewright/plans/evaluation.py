"""An evaluation run: drive a document to its transcription, index its machine readings apart, measure, report.

A corpus has at most MAX_PAGES pages and a declared list of controls and questions, so what a report lists is bounded.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import POLL_SECONDS, REVIEWABLE
from ..functions.models import embedded
from ..operators.review import chunks, machine_reading
from ..sources.sinks import delete_files, upsert_chunks
from .pipeline import Models
from .report import rendered, report


def awaited(status: Callable[[], str], wanted: set[str], seconds: float, every: float = POLL_SECONDS) -> str:
    """Ask for the status until it is one of ``wanted``; a failure that isn't wanted, or no time left, is an error."""
    ends = time.monotonic() + seconds
    while time.monotonic() < ends:
        now = status()
        if now in wanted:
            return now
        if now == "failed":
            raise RuntimeError("the document failed; run again on the same document to go on")
        time.sleep(every)
    raise TimeoutError(f"{sorted(wanted)} not reached in {seconds:.0f} s")


def driven(status: Callable[[], str], launch: Callable[[], None], preprocessing: float, transcription: float, every: float = POLL_SECONDS) -> str:
    """Bring an imported document to its transcription; one that has it is left alone, a failed one is launched anew."""
    if (now := status()) in ("new", "preprocessing"):
        now = awaited(status, {"preprocessed", "failed", *REVIEWABLE}, preprocessing, every)
    if now in ("preprocessed", "failed"):
        launch()
    return awaited(status, set(REVIEWABLE), transcription, every)


def index_path(index: str, corpus: str) -> str:
    return f"{index}-eval-{corpus}"


def build_index(spark: SparkSession, index: str, corpus: str, pages: DataFrame, revisions: DataFrame, models: Models) -> int:
    """The corpus' own index, from machine readings (a human's text would measure nothing), built anew; returns its size."""
    path = index_path(index, corpus)
    delete_files(spark, path)
    read = chunks(pages, machine_reading(revisions).withColumn("is_validated", F.lit(True)))
    rows = embedded(read, models.embed, models.dim).withColumns({"document_id": F.col("document_id").cast("string"), "page_number": F.col("page_number").cast("int")})
    return upsert_chunks(spark, path, rows, models.dim)


def controls_passed(*controls: DataFrame) -> DataFrame:
    """One row: controls that passed, and how many there are."""
    rows = controls[0].select("passed")
    for other in controls[1:]:
        rows = rows.unionByName(other.select("passed"))
    return rows.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def markdown(spark: SparkSession, *parts) -> str:
    """The Markdown of a report of the same parts."""
    return rendered(report(spark, *parts).first())
