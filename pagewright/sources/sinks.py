"""Where results go: append-only revisions, the derived index, deletes over all of them, reports, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACTIVE_JOBS
from ..schemas import schema
from .store import Files, Log, Store


def revisions_store(spark: SparkSession, root: str, like: DataFrame | None = None) -> Store:
    """The revisions below ``root``: of a page there is one of each number. ``like`` gives a schema other than the declared one."""
    kind = like.schema if like is not None else schema("revisions")
    return Store(spark, f"{root}/revisions", kind, ("page_id", "revision"), "page_id")


def append_revisions(root: str, new: DataFrame) -> None:
    """Append; a (page_id, revision) that is there already, or stands twice in ``new``, is refused.

    Of two writers that add the same revision at the same time one is refused, whichever commits second.
    """
    revisions_store(new.sparkSession, root, new).append(new)


def delete_files(spark: SparkSession, path: str) -> bool:
    """Best effort: True if something went; never an error."""
    try:
        return Files(spark, path).delete(path)
    except Exception:  # noqa: BLE001  documented: a file that stays is no failure
        return False


def write_bytes(spark: SparkSession, root: str, files: DataFrame) -> int:
    """Writes (path, content) below ``root``, folders included, in the tasks that hold the rows; returns their number.

    A path that leads out of ``root`` refuses all. A task that runs again writes the same bytes anew.
    """
    parts = F.split("path", "/")
    outside = F.col("path").isNull() | F.col("path").startswith("/") | F.array_contains(parts, "..") | F.array_contains(parts, "")
    if not files.filter(outside).isEmpty():
        raise ValueError("a path leads out of the folder")
    target = Files(spark, root)
    base = str(target.fs.makeQualified(target.path(root)).toString()).rstrip("/")

    def put(batches):
        import pandas as pd
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(base.replace("file:/", "file:///") if base.startswith("file:/") and not base.startswith("file://") else base)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = f"{where.rstrip('/')}/{path}"
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                beside = f"{name}.part"
                with store.open_output_stream(beside) as out:
                    out.write(content)
                store.move(beside, name)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def index_store(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    """The index of chunks: a document's chunks lie in one bucket."""
    return Store(spark, path, schema("chunks"), ("chunk_id",), "document_id", buckets)


def ensure_index(spark: SparkSession, path: str) -> None:
    """Create an empty index if there is none."""
    index_store(spark, path).create()


def read_index(spark: SparkSession, path: str, documents: list[str] | None = None) -> DataFrame:
    """The newest version of an index, or some documents' part of it."""
    return index_store(spark, path).read(documents)


def upsert_chunks(spark: SparkSession, path: str, new: DataFrame, dim: int) -> int:
    """Overwrite by chunk_id; a missing or wrong vector refuses all; returns the number written.

    The new chunks are written before they are merged: vectors come from a model that shouldn't be asked twice.
    """
    checked = F.when(F.coalesce(F.size("embedding"), F.lit(0)) == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("a chunk without a vector of the right size")))
    return index_store(spark, path).upsert(new.withColumn("embedding", checked))


def delete_document(spark: SparkSession, path: str, document_id: str) -> None:
    """Take a document out of the index; no index is no error."""
    index_store(spark, path).delete([document_id])


def reindex(spark: SparkSession, path: str, chunks: DataFrame) -> int:
    """Build the index anew from the given chunks; returns their number."""
    store = index_store(spark, path)
    return store.read(version=store.replace(chunks)).count()


# Deletes over all stores, in the order in which a stop in the middle does no harm.

STEPS = ("index", "revisions", "pages", "jobs", "documents", "files")


class Deletes:
    """Deletion of documents from the index, the tables below ``root`` and the files, finished by whoever comes next.

    A document's deletion is a log of its own: the first entry is the tombstone, with the pages that it had; each further entry
    says that a step is done. Steps do nothing where nothing is left, so a step that was cut short runs again.
    The index goes first: a search may miss a document that is still there, but never cites one that is gone. Files go last.
    """

    def __init__(self, spark: SparkSession, root: str, index: str, files: str) -> None:
        self.spark, self.root, self.index, self.files = spark, root, index, files
        table = lambda name, key, by: Store(spark, f"{root}/{name}", schema(name), key, by)
        self.pages, self.jobs, self.documents = table("pages", ("id",), "document_id"), table("jobs", ("id",), "document_id"), table("documents", ("id",), "id")
        self.revisions = revisions_store(spark, root)

    def _log(self, document_id: str) -> Log:
        return Log(self.spark, f"{self.root}/_deletes/{document_id}")

    def delete(self, document_id: str) -> None:
        """Refused for a document that isn't there, or has a job that is queued or running."""
        log = self._log(document_id)
        if not log.latest()[0]:
            if self.documents.read([document_id]).isEmpty():
                raise LookupError(f"no document {document_id}")
            active = self.jobs.read([document_id]).filter(F.col("status").isin(*ACTIVE_JOBS)).first()
            if active:
                raise ValueError(f"a job of document {document_id} is {active['status']}: {active['kind']}")
            pages = [r["id"] for r in self.pages.read([document_id]).select("id").collect()]  # at most MAX_PAGES
            log.take(1, {"done": [], "pages": sorted(pages)})
        self._finish(document_id)

    def resume(self) -> list[str]:
        """Finishes every deletion that was begun; returns their documents."""
        begun = Files(self.spark, self.root).names(f"{self.root}/_deletes")
        for document_id in begun:
            self._finish(document_id)
        return begun

    def _finish(self, document_id: str) -> None:
        log = self._log(document_id)
        number, entry = log.latest()
        for step in STEPS:
            if step not in entry["done"]:
                self._step(step, document_id, entry["pages"])
                number, entry = number + 1, entry | {"done": [*entry["done"], step]}
                log.take(number, entry)  # taken already: another one finishes the same deletion
        log.files.delete(log.folder)

    def _step(self, step: str, document_id: str, pages: list[str]) -> None:
        if step == "index":
            delete_document(self.spark, self.index, document_id)
        elif step == "revisions":
            if pages:
                self.revisions.delete(pages)
        elif step == "files":
            for stage in ("inbox", "images"):
                delete_files(self.spark, f"{self.files}/{stage}/{document_id}")
        else:
            getattr(self, step).delete([document_id])


def write_report(report: DataFrame, markdown: str, folder: str) -> None:
    """JSON and Markdown of a report (one row)."""
    spark = report.sparkSession
    report.select("json").coalesce(1).write.mode("overwrite").text(f"{folder}/rapport.json")
    spark.createDataFrame([(markdown,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/rapport.md")


def export_markdown(texts: DataFrame, folder: str) -> None:
    """The validated text of each document, in a folder of its own."""
    texts.select(F.col("content").alias("value"), "document_id").write.mode("overwrite").partitionBy("document_id").text(folder)
