"""Page files and evaluation corpora: readers, checks of what is accepted, paths."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MAX_PAGE_BYTES, MAX_PAGES
from ..functions.text import image_path, is_image, natural_key, suffix_of, ustrip
from ..migrations import VERSION, at_version, version_of
from ..schemas import migrated, schema
from .store import Log


def stored(spark: SparkSession, root: str, name: str, version: int = VERSION) -> DataFrame:
    """A stored table, of the newest commit if it has commits; filters and columns reach the scan.

    By default with the declared schema. With an older ``version`` of the schema, as a reader of that version knows it.
    """
    log = Log(spark, f"{root}/{name}/_log")
    number, entry = log.latest()
    if not number:
        found = at_version(spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}"), name, version)
    else:
        # One look at a file for each commit's folder tells its version.
        by_commit: dict[str, list[str]] = {}
        for own in entry["folders"].values():
            for folder in own:
                by_commit.setdefault(folder.split("/bucket_=")[0], []).append(f"{root}/{name}/{folder}")
        if not by_commit:
            return empty(spark, name)
        groups: dict[int, list[str]] = {}
        for own in by_commit.values():
            groups.setdefault(version_of(spark.read.parquet(own[0])), []).extend(own)
        parts = [at_version(spark.read.option("mergeSchema", "true").parquet(*own), name, version) for _, own in sorted(groups.items())]
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return migrated(found, name) if version == VERSION else found


def stored_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str], key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """The same table out of a relational store, read in ranges of a whole-number key where one is given."""
    if key and bounds:
        low, high, parts = bounds
        return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
    return spark.read.jdbc(url, name, properties=properties)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def page_files(spark: SparkSession, folder: str, document_id: str) -> DataFrame:
    """One row a page image, numbered from 1 in natural order, with the path where it is kept.

    Other suffixes, empty or too large files, and too many pages are errors; pages of one document are few, so one
    window over them is bounded.
    """
    # Spark's readers skip files of length 0, so those show in the listing alone.
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
        if status.isFile() and status.getLen() == 0:
            raise ValueError(f"empty file: {status.getPath().getName()}")
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(natural_key(name), name))
    ok = (
        F.when(~is_image(F.col("path")), F.raise_error(F.concat(F.lit("not a page image: "), name)))
        .when(F.col("length") > MAX_PAGE_BYTES, F.raise_error(F.concat(F.lit("file too large: "), name)))
        .when(n > MAX_PAGES, F.raise_error(F.lit("too many pages")))
        .otherwise(F.col("content"))
    )
    rows = files.select("path", "length", ok.alias("content"), rank.alias("page_number"))
    return rows.select(F.lit(document_id).alias("document_id"), "page_number", "length", "content", image_path("inbox", F.lit(document_id), F.col("page_number"), suffix_of(F.col("path"))).alias("raw_image_path"))


def chosen_image(pages: DataFrame) -> DataFrame:
    """The preprocessed image where there is one (an empty path counts as none), else the raw one."""
    return pages.withColumn("image_path", F.coalesce(F.nullif("preprocessed_image_path", F.lit("")), "raw_image_path"))


def page_image(spark: SparkSession, root: str, pages: DataFrame, document_id: str, page_number: int, variant: str = "preprocessed") -> DataFrame:
    """One row (path, length, content): the image of a page below ``root``.

    ``variant`` is preprocessed or raw. No such page, no image of that variant, or a path that leads out of ``root`` is an error.
    """
    row = pages.filter((F.col("document_id") == document_id) & (F.col("page_number") == page_number)).select(F.col(f"{variant}_image_path").alias("path")).first()
    parts = (row["path"] or "").split("/") if row else []
    if not any(parts) or parts[0] == "" or ".." in parts:
        raise FileNotFoundError(f"document {document_id}, page {page_number}: no {variant} image")
    return spark.read.format("binaryFile").load(f"{root}/{row['path']}").select("path", "length", "content")


def corpus_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_number, path of ``folder``/pages; numbers must run from 1 without a gap or a double."""
    rows = spark.read.format("binaryFile").load(f"{folder}/pages").select("path", F.regexp_extract("path", r"page-(\d+)\.[^./]+$", 1).try_cast("int").alias("page_number"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_number").alias("d"), F.min("page_number").alias("a"), F.max("page_number").alias("b")).first()
    if not got["n"] or (got["n"], got["a"], got["b"]) != (got["d"], 1, got["n"]):
        raise ValueError("the corpus' pages have gaps, doubles or other names")
    return rows


def corpus_references(spark: SparkSession, folder: str) -> DataFrame:
    """page_number, content of ``folder``/reference; a blank one is an error."""
    rows = spark.read.text(f"{folder}/reference", wholetext=True).select(F.col("value").alias("content"), F.regexp_extract(F.col("_metadata.file_path"), r"page-(\d+)\.md$", 1).try_cast("int").alias("page_number"))
    return rows.withColumn("content", F.when(ustrip(F.col("content")) == "", F.raise_error(F.lit("a reference is blank"))).otherwise(F.col("content")))


def corpus_config(spark: SparkSession, folder: str, name: str) -> dict:
    """A TOML file of the corpus, through Spark's own reader, so that any store will do."""
    rows = spark.read.text(f"{folder}/{name}.toml", wholetext=True).collect()  # one small file
    return tomllib.loads(rows[0]["value"])


def corpus_questions(spark: SparkSession, folder: str, pages: int) -> DataFrame:
    """query_id, question, pages, values; page numbers out of range are an error."""
    rows = corpus_config(spark, folder, "questions").get("questions", [])
    for q in rows:
        if not q["pages"] or not all(1 <= p <= pages for p in q["pages"]):
            raise ValueError(f"question {q['id']}: a page out of range")
    return spark.createDataFrame([(q["id"], q["question"], q["pages"], q.get("valeurs", []), k) for k, q in enumerate(rows)], "query_id string, question string, pages array<int>, values array<string>, declared_at int")


def corpus_controls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Table controls, their declared tables, and expected numbers, each with its place in the file (declared_at)."""
    found = corpus_config(spark, folder, "controles")
    tables, numbers = found.get("tables", []), found.get("nombres", [])
    controls = [(t["nom"], t["pages"][0], t["pages"][-1], t["denominateur"]) for t in tables]
    declared = [(t["nom"], k, x["nom"], x["lots"], x["total"], at) for at, t in enumerate(tables) for k, x in enumerate(t["lots"] if isinstance(t["lots"], list) else [])]
    expected = [(n["nom"], n["page"], k, v, at) for at, n in enumerate(numbers) for k, v in enumerate(n["nombres"])]
    return (
        spark.createDataFrame(controls, "control string, first_page int, last_page int, denominator bigint"),
        spark.createDataFrame(declared, "control string, segment bigint, name string, lots bigint, total bigint, declared_at int"),
        spark.createDataFrame(expected, "control string, page_id int, position int, value string, declared_at int"),
    )
