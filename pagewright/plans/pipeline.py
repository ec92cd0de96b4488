"""The document pipeline: import, transcribe, normalise, validate, index, as stages that resume.

A stage does what isn't done: pages with a reading are skipped, the index is overwritten by key, so running anew
after a loss changes nothing that is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REVIEWABLE, SCORES
from ..functions.models import embedded, transcribed
from ..functions.text import ustrip
from ..operators.jobs import pages_to_do
from ..operators.layout import normalised
from ..operators.review import collected_chunks, latest
from ..operators.tables import page_blocks


@dataclass(frozen=True)
class Models:
    """Makers of the model callables, called once in each task."""

    transcribe: Callable
    embed: Callable
    dim: int


def transcribe(pages: DataFrame, revisions: DataFrame, models: Models) -> DataFrame:
    """New OCR revisions (page_id, revision, origin, content, blocks, score) of the pages that have none."""
    todo = pages_to_do(pages, revisions)
    texts = transcribed(todo, models.transcribe).select("page_id", F.col("content_markdown").alias("text"))
    checked = texts.join(page_blocks(texts), "page_id")
    top = revisions.groupBy("page_id").agg(F.max("revision").alias("top"))
    return checked.join(top, "page_id", "left").select("page_id", (F.coalesce("top", F.lit(0)) + 1).cast("int").alias("revision"), F.lit("ocr").alias("origin"), F.col("text").alias("content"), "blocks", "score")


BLOCK = "struct<start_offset:int,method:string,end_offset:int,score:double>"


def normalise(pages: DataFrame, revisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New normalised revisions of pages whose latest one is OCR; unchanged and emptied pages are skipped.

    Blocks are the recomputed checks, the divergences of the second pass (where ``revisions`` has blocks) moved to where
    their text went or dropped with it, and one for each doubt. Words of ``known`` (document_id, text) extend the lexicon
    of that document.
    """
    own = F.col("blocks") if "blocks" in revisions.columns else F.lit(None)
    before_blocks = F.transform(own.cast(f"array<{_block_type(revisions)}>"), lambda b: F.struct(b["start_offset"].alias("start_offset"), b["method"].alias("method"), b["end_offset"].alias("end_offset"), b["score"].alias("score")).cast(BLOCK))
    now = latest(revisions.select("page_id", "revision", "origin", "content", before_blocks.alias("before_blocks")))
    rows = pages.join(now, "page_id").withColumn("editable", F.col("origin") == "ocr")
    texts = rows.select("document_id", "page_number", F.col("content").alias("text"), "editable")
    if known is not None:
        words = known.groupBy("document_id").agg(F.collect_list("text").alias("known"))
        first = rows.groupBy("document_id").agg(F.min("page_number").alias("page_number")).join(words, "document_id")  # once a document
        texts = texts.join(first, ["document_id", "page_number"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    out = normalised(texts)
    keys = rows.select(F.col("document_id").cast("string").alias("document_id"), "page_number", "page_id", "revision", F.col("content").alias("before"), "before_blocks")
    changed = out.join(keys, ["document_id", "page_number"]).filter((ustrip(F.col("text")) != "") & ((F.col("text") != F.col("before")) | (F.size("doubts") > 0)))
    doubts = F.transform("doubts", lambda d: F.struct(d["start"].alias("start_offset"), F.lit("structural").alias("method"), d["end"].alias("end_offset"), F.lit(SCORES["uncertain_break"]).alias("score")))

    def moved(at: Column) -> Column:
        return F.get("positions", F.least(at, F.char_length("before")))

    passes = F.filter(F.coalesce("before_blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: b["method"] == "double_pass")
    carried = F.transform(passes, lambda b: F.struct(moved(b["start_offset"]).alias("start_offset"), b["method"].alias("method"), moved(b["end_offset"]).alias("end_offset"), b["score"].alias("score")))
    carried = F.filter(carried, lambda b: b["start_offset"] < b["end_offset"])
    checked = changed.select("page_id", "text").join(page_blocks(changed.select("page_id", "text")), "page_id").select("page_id", F.col("blocks").alias("checks"))
    return changed.join(checked, "page_id").select("page_id", (F.col("revision") + 1).cast("int").alias("revision"), F.lit("normalized").alias("origin"), F.col("text").alias("content"), F.array_sort(F.concat("checks", carried, doubts)).alias("blocks"))


def _block_type(revisions: DataFrame) -> str:
    return revisions.schema["blocks"].dataType.elementType.simpleString() if "blocks" in revisions.columns else BLOCK


def normalise_document(documents: DataFrame, pages: DataFrame, revisions: DataFrame, document_id, known: DataFrame | None = None) -> DataFrame:
    """The same for one document (documents: document_id, status) that is past its transcription; any other is refused."""
    row = documents.filter(F.col("document_id") == document_id).select("status").first()
    if row is None:
        raise LookupError(f"no document {document_id}")
    if row["status"] not in REVIEWABLE:
        raise ValueError(f"document {document_id} is {row['status']}: its transcription isn't done")
    own = pages.filter(F.col("document_id") == document_id)
    return normalise(own, revisions.join(own.select("page_id"), "page_id", "left_semi"), known)


def index(pages: DataFrame, revisions: DataFrame, models: Models) -> DataFrame:
    """Chunks with vectors of the documents that are validated whole."""
    return embedded(collected_chunks(pages, revisions), models.embed, models.dim)
