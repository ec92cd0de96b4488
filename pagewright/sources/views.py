"""The document domain over the generic test tables: the same DataFrames that the stored tables would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id (the document row), document_id, page_number, content: ten rows make a document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("document_id"), (F.col("doc_id") % 10 + 1).alias("page_number"), F.col("text").alias("content"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as revisions of a page."""
    c = table(spark, sf_dir, "conversations")
    validated = (F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 7 == 0)
    return c.select(
        F.col("conv_id").alias("page_id"),
        F.floor(F.col("conv_id") / 5).alias("document_id"),
        (F.col("conv_id") % 5 + 1).alias("page_number"),
        (F.col("turn") + 1).alias("revision"),
        F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ocr").otherwise("normalized").alias("origin"),
        F.col("text").alias("content"),
        validated.alias("is_validated"),
        (validated & (F.col("conv_id") % 4 == 0)).alias("bulk_validated"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page universe: some pages at the end have no revision."""
    top = table(spark, sf_dir, "conversations").agg(F.max("conv_id").alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top") + 10)).alias("page_id")).select("page_id", F.floor(F.col("page_id") / 5).alias("document_id"), (F.col("page_id") % 5 + 1).alias("page_number"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence blocks of the page revisions: order lines of as many orders as there are pages."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("revision"), F.round(F.col("l_discount") * 10, 1).alias("score"), F.when(F.col("l_returnflag") == "A", "arithmetic").when(F.col("l_returnflag") == "N", "structural").otherwise("double_pass").alias("method"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the job log."""
    e = table(spark, sf_dir, "events")
    rest = F.col("event_id") % 4
    return e.select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("document_id"),
        F.when(F.col("event_id") % 3 == 0, "preprocess").when(F.col("event_id") % 3 == 1, "transcribe").otherwise("index").alias("kind"),
        F.when((rest == 0) & (F.col("event_id") % 500 == 0), "queued").when((rest == 1) & (F.col("event_id") % 501 == 1), "running").when(rest == 2, "done").otherwise("failed").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the job log, with a status."""
    j = jobs(spark, sf_dir).select("document_id").distinct()
    status = F.when(F.col("document_id") % 4 == 0, "preprocessed").when(F.col("document_id") % 4 == 1, "failed").when(F.col("document_id") % 4 == 2, "transcribing").otherwise("awaiting_validation")
    return j.select("document_id", status.alias("status"), (F.col("document_id") % 11).alias("done"), (F.col("document_id") % 13).alias("total"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select("doc_id")
    return e.join(d, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("chunk_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as questions, each with the stored vector of its number as its own."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return b.join(e, "query_id")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text: the lines of an order as a markdown table with French decimals, every fifth line misread.

    A total row closes the table; it states the true sum, but for every fourth order, which states twice as much.
    """
    li = table(spark, sf_dir, "lineitem")
    qty, total = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)")
    unit = (total / qty).cast("decimal(18,2)")
    shown = F.when(F.col("l_linenumber") % 5 == 0, unit + 1).otherwise(unit).cast("decimal(18,2)")
    number = lambda c: F.translate(c.cast("string"), ".", ",")
    row = F.concat(F.lit("| article "), F.col("l_partkey").cast("string"), F.lit(" | "), number(qty), F.lit(" | "), number(shown), F.lit(" | "), number(total), F.lit(" |"))
    body = li.select("l_orderkey", "l_linenumber", row.alias("row"), total.alias("total")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))).alias("rows"), F.sum("total").alias("sum"))
    stated = (F.col("sum") * F.when(F.col("l_orderkey") % 4 == 0, 2).otherwise(1)).cast("decimal(18,2)")
    text = F.concat(F.lit("| Désignation | Quantité | Prix | Total |\n|---|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n| Total | "), number(stated), F.lit(" | | |"))
    return body.select(F.col("l_orderkey").alias("page_id"), text.alias("text"))
