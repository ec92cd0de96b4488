"""Stored tables in buckets, under a log of versions.

A table is a folder of data folders and a log. A row lies in the bucket of its ``by`` column, and a version of the table says
for each bucket which data folders it consists of. Changes write new folders, beside all that is there, for the buckets
that they touch; the log's next entry is the commit point. Whatever happens before it leaves the old version whole, whatever
happens after it has the new one whole, and files of other buckets keep their names.

Writers don't lock. An entry's number can be taken once only; whoever comes second reads what the other one committed
and, if that touched the same buckets, looks again before it takes the next number.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..migrations import stamped


class Files:
    """What the store needs of a file system, by Hadoop's own client, so that any store will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self.path(name)))

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.path(name), True))

    def publish(self, name: str, text: str) -> bool:
        """``name`` with all of ``text``, or False if the name is taken: a rename that doesn't overwrite.

        A local file system's rename does overwrite, so there the whole file gets its name as a link.
        """
        where = self.path(name)
        beside = str(self.path(f"{where.getParent()}/.{where.getName()}.{uuid.uuid4().hex}"))
        self.write(beside, text)
        try:
            full = self.fs.makeQualified(where).toUri().toString()
            if urlparse(full).scheme == "file":
                local = lambda n: unquote(urlparse(self.fs.makeQualified(self.path(n)).toUri().toString()).path)
                try:
                    os.link(local(beside), local(name))
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(where) and bool(self.fs.rename(self.path(beside), where))
        finally:
            self.delete(beside)


class Log:
    """Numbered entries in a folder; each number is taken once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files, self.folder = Files(spark, folder), folder

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:012d}.json"))

    def latest(self) -> tuple[int, dict]:
        """Number and entry of the newest version; (0, {}) where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (0, {})

    def take(self, number: int, entry: dict) -> bool:
        return self.files.publish(f"{self.folder}/{number:012d}.json", json.dumps(entry, sort_keys=True))


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    folders: dict[int, list[str]]


class Duplicate(ValueError):
    """A key that is there already, or stands twice among the new rows."""


class Store:
    """One table: ``key`` columns name a row, and rows of one key share their value of ``by``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: tuple[str, ...], by: str, buckets: int = 16) -> None:
        self.spark, self.root, self.key, self.by, self.wanted = spark, path.rstrip("/"), key, by, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files, self.log = Files(spark, path), Log(spark, f"{self.root}/_log")

    # Reading

    def version(self) -> Version:
        number, entry = self.log.latest()
        return Version(number, entry.get("buckets", self.wanted), {int(b): f for b, f in entry.get("folders", {}).items()})

    def read(self, values: list | None = None, version: Version | None = None) -> DataFrame:
        """The newest version; with ``values``, the rows of those values of ``by``, from their buckets' files alone."""
        version = version or self.version()
        buckets = None if values is None else self._of(values, version.buckets)
        rows = self._rows([f for b, own in sorted(version.folders.items()) if buckets is None or b in buckets for f in own])
        return rows if values is None else rows.filter(F.col(self.by).isin(*values))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def _of(self, values: list, buckets: int) -> set[int]:
        """The buckets of some values, by the function that placed them."""
        if not values:
            return set()
        kind = self.schema[self.by].dataType
        some = self.spark.createDataFrame([(v,) for v in values], StructType().add(self.by, kind))
        return {r[0] for r in some.select(self._bucket(buckets)).collect()}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(buckets)).cast("int").alias("bucket_")

    # Writing

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, list[str]]:
        """A new data folder; by bucket the folder in it that has its rows. Nothing sees it until a version names it."""
        name = f"data/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        # Adaptive execution splits a bucket that is too large for one file and joins small ones.
        placed = stamped(rows.select(*columns, self._bucket(buckets)).hint("rebalance", "bucket_"))
        placed.write.partitionBy("bucket_").parquet(f"{self.root}/{name}")
        own = [n for n in self.files.names(f"{self.root}/{name}") if n.startswith("bucket_=")]
        return {int(n.split("=")[1]): [f"{name}/{n}"] for n in own}

    def _commit(self, seen: Version, changed: dict[int, list[str]]) -> Version | None:
        """The version after ``seen`` with the changed buckets; None if another writer took its number."""
        folders = {b: f for b, f in (seen.folders | changed).items() if f}
        entry = {"buckets": seen.buckets, "folders": {str(b): f for b, f in sorted(folders.items())}}
        return Version(seen.number + 1, seen.buckets, folders) if self.log.take(seen.number + 1, entry) else None

    def _unique(self, rows: DataFrame) -> None:
        if not rows.groupBy(*self.key).count().filter("count > 1").isEmpty():
            raise Duplicate(f"a row of ({', '.join(self.key)}) stands twice")

    def create(self) -> None:
        """An empty table, if there is none."""
        while not self.version().number:
            self._commit(self.version(), {})

    def append(self, new: DataFrame) -> Version:
        """Adds rows of new keys. A key that is there, or that another writer adds meanwhile, refuses all of them."""
        seen = self.version()
        folders = self._write(new, seen.buckets)
        rows = self._rows([f for own in folders.values() for f in own])
        try:
            self._unique(rows)
            checked: set[str] = set()
            while True:
                others = [f for b in folders for f in seen.folders.get(b, []) if f not in checked]
                if others and not rows.join(self._rows(others), list(self.key), "left_semi").isEmpty():
                    raise Duplicate(f"a row of this ({', '.join(self.key)}) exists")
                checked |= set(others)
                done = self._commit(seen, {b: [*seen.folders.get(b, []), *own] for b, own in folders.items()})
                if done:
                    return done
                seen = self.version()
        except BaseException:
            self._drop(folders)
            raise

    def upsert(self, new: DataFrame) -> int:
        """Puts rows in the place of those of the same keys, or adds them; returns their number.

        ``new`` is written once, as it comes; only buckets that it touches are merged and written anew.
        """
        seen = self.version()
        folders = self._write(new, seen.buckets)
        rows = self._rows([f for own in folders.values() for f in own])
        self._unique(rows)
        n = rows.count()
        self._changed(seen, set(folders), lambda old: old.join(rows, list(self.key), "left_anti").unionByName(rows))
        self._drop(folders)
        return n

    def delete(self, values: list) -> None:
        """Takes away all rows of some values of ``by``; values that aren't there are no error."""
        seen = self.version()
        self._changed(seen, self._of(values, seen.buckets) & set(seen.folders), lambda old: old.filter(~F.col(self.by).isin(*values)))

    def _changed(self, seen: Version, touched: set[int], change) -> None:
        while touched:
            before = {b: seen.folders.get(b, []) for b in touched}
            written = self._write(change(self._rows([f for own in before.values() for f in own])), seen.buckets)
            become = {b: written.get(b, []) for b in touched}
            # Another writer's commit matters only if it is in the same buckets.
            while all(seen.folders.get(b, []) == before[b] for b in touched):
                if self._commit(seen, become):
                    return
                seen = self.version()
            self._drop(written)

    def replace(self, rows: DataFrame) -> Version:
        """All of the table anew, whatever it was."""
        seen = self.version()
        written = self._write(rows, seen.buckets)
        self._unique(self._rows([f for own in written.values() for f in own]))
        while True:
            done = self._commit(seen, {b: [] for b in seen.folders} | written)
            if done:
                return done
            seen = self.version()

    def compact(self, most: int = 8) -> None:
        """Buckets of more than ``most`` folders, as appends leave them, become one folder each."""
        seen = self.version()
        self._changed(seen, {b for b, own in seen.folders.items() if len(own) > most}, lambda old: old)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data folders that none of the last ``keep`` versions has, and older entries; not beside a running writer. Returns the number of folders."""
        numbers = self.log.numbers()
        kept = {f.split("/")[1] for n in numbers[-keep:] for own in self.log.entry(n)["folders"].values() for f in own}
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in kept]
        for name in gone:
            self.files.delete(f"{self.root}/data/{name}")
        for n in numbers[:-keep]:
            self.files.delete(f"{self.log.folder}/{n:012d}.json")
        return len(gone)

    def _drop(self, folders: dict[int, list[str]]) -> None:
        for name in {"/".join(f.split("/")[:2]) for own in folders.values() for f in own}:
            self.files.delete(f"{self.root}/{name}")

