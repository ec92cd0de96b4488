"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_code

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


#: Spark removes the shuffle files of a query when the query ends: nothing runs a written query a second time.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a temporary one, in local mode only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pagewright.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.pagewright.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """The intermediate tables of one run, as Parquet in a folder of its own within the shared one.

    Writing cuts the lineage and survives lost executors. A table goes as soon as its readers are done; those that a
    result still reads stay, and go with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.path}/{name}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table has stays out of the plan."""
    with_code(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


def mapped(docs: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas over doc_id and text. Ids travel as strings: pandas would make floats of whole numbers beside nulls."""
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, schema.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def ascii_lower(column):
    """Lower-case A to Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
