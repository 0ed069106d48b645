"""A stored table with upserts: buckets that are copied when they change, and a manifest for each version.

    <home>/data/<writer>/bucket=<b>/…     what a writer wrote: whole buckets
    <home>/manifest/<version>.json        which folder holds each bucket, and the bucket count
    <home>/head/<version>-<writer>        one empty file: the latest version, and who made it

A version is there when the head has been renamed to it: of several writers only one can rename a
file, and the others start over. A manifest is written before and never changes. So a reader sees one
whole version, whatever writers do; a writer that fails leaves a folder that nothing names; and a
change rewrites only the buckets that its keys fall into. A manifest names at most so many folders as
there are buckets, and is all that goes through the driver.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: How often a writer starts over when others were faster.
TRIES = 20
#: How often a reader looks for the head while it is being renamed.
LOOKS = 500


class Conflict(RuntimeError):
    pass


class Store:
    """A table by key columns at home (a folder that all executors share). n_buckets counts for the first version only."""

    def __init__(self, spark: SparkSession, home: str, schema: str, keys: list[str], n_buckets: int = BUCKETS) -> None:
        self.spark, self.home, self.keys = spark, home.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._first = n_buckets

    # ---- files of the driver

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.home).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        with_ = self._fs().open(self._path(path))
        try:
            return bytes(with_.readAllBytes()).decode()
        finally:
            with_.close()

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(f"{self.home}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _renamed(self, old: str, new: str) -> bool:
        """Rename what is at old; False if it is no longer there."""
        try:
            return bool(self._fs().rename(self._path(f"{self.home}/{old}"), self._path(f"{self.home}/{new}")))
        except Py4JJavaError:
            return False

    def _head(self) -> tuple[int, str] | None:
        """Version and writer of the head; None before there is one."""
        for _ in range(LOOKS):
            found = [n.split("-") for n in self._names("head") if not n.startswith(".") and n.endswith(".at")]
            if found:
                version, writer = max(found)
                return int(version), writer.removesuffix(".at")
            if not self._fs().exists(self._path(f"{self.home}/head")):
                return None
            time.sleep(0.01)  # it is being renamed just now
        raise RuntimeError(f"{self.home}/head holds no file")

    def _first_head(self) -> tuple[int, str]:
        """The head, made if there is none: a folder with a file in it, which cannot take the place of another one."""
        head = self._head()
        if head is None:
            old, aside = max(self._named(), default=0), f"{uuid.uuid4().hex}.head"
            self._fs().mkdirs(self._path(f"{self.home}/{aside}"))
            self._fs().create(self._path(f"{self.home}/{aside}/{old:012}-{uuid.uuid4().hex}.at"), False).close()
            self._renamed(aside, "head")
            head = self._head()
        return head

    def _named(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def versions(self) -> list[int]:
        head = self._head()
        return sorted({*self._named(), *([head[0]] if head and head[0] else [])})

    def manifest(self, version: int | None = None) -> dict:
        """version, n_buckets and buckets (number: folder); version 0 is the empty table."""
        head = self._head()
        if version is None:
            version = head[0] if head else max(self._named(), default=0)
        if version == 0:
            return {"version": 0, "n_buckets": self._first, "buckets": {}}
        if head and head[0] == version:
            # Its writer may not have named it yet.
            with contextlib.suppress(Py4JJavaError):
                return json.loads(self._text(f"{self.home}/manifest/{head[1]}.tmp"))
        return json.loads(self._text(f"{self.home}/manifest/{version:012}.json"))

    def _claimed(self, number: int) -> bool:
        try:
            return bool(self._fs().createNewFile(self._path(f"{self.home}/manifest/{number:012}.claim")))
        except Py4JJavaError as e:
            # A local folder is looked at first, and then the file is made.
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _commit(self, manifest: dict) -> None:
        """Make a version of its base's next number, unless someone else did: then Conflict.

        Numbers that writers claimed and did not use are passed over. Who makes the version is decided by
        the rename of the head, which only one writer can do.
        """
        fs, base = self._fs(), manifest["base"]
        fs.mkdirs(self._path(f"{self.home}/manifest"))
        number = base + 1
        while not self._claimed(number):
            number += 1
        old, writer = self._first_head()
        if old != base:
            raise Conflict(f"version {base} is no longer the latest")
        own = uuid.uuid4().hex
        text = json.dumps({**manifest, "version": number}).encode()
        out = fs.create(self._path(f"{self.home}/manifest/{own}.tmp"), False)
        out.write(bytearray(text))
        out.close()
        # The writer of the base may have died before it named its manifest.
        self._renamed(f"manifest/{writer}.tmp", f"manifest/{old:012}.json")
        if not self._renamed(f"head/{old:012}-{writer}.at", f"head/{number:012}-{own}.at"):
            raise Conflict(f"version {base} is no longer the latest")
        self._renamed(f"manifest/{own}.tmp", f"manifest/{number:012}.json")

    # ---- the table

    def _folders(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = [f for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.home}/data/{f}" for f in wanted])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the latest)."""
        return self._folders(self.manifest(version))

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _changed(self, keys: DataFrame, merge: Callable[[DataFrame], DataFrame], add: DataFrame | None) -> int:
        """Rewrite the buckets of keys: merge gives what stays of their rows, add the new ones. Starts over on the latest version if another writer was faster."""
        for _ in range(TRIES):
            base = self.manifest()
            n = base["n_buckets"]
            touched = sorted(r["b"] for r in keys.select(self._bucket(n).alias("b")).distinct().collect())  # n at most
            if not touched:
                return base["version"]
            rows = merge(self._folders(base, touched))
            rows = rows.unionByName(add) if add is not None else rows
            writer = uuid.uuid4().hex
            rows.withColumn("bucket", self._bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.home}/data/{writer}")
            fs = self._fs()
            new = {str(b): f"{writer}/bucket={b}" for b in touched if fs.exists(self._path(f"{self.home}/data/{writer}/bucket={b}"))}
            kept = {b: f for b, f in base["buckets"].items() if int(b) not in touched}
            try:
                self._commit({"base": base["version"], "n_buckets": n, "buckets": kept | new})
                return self.manifest()["version"]
            except Conflict:
                continue
        raise Conflict(f"other writers were faster {TRIES} times")

    def upsert(self, rows: DataFrame, by: str | None = None) -> int:
        """Put rows in the place of those of their keys, as a whole, nulls included; returns the version.

        Of rows of one key that of the greatest by counts; without by, keys must not repeat. Rows with a
        null in a key are left out. No rows make no version.
        """
        rest = [c for c in self.schema.names if c not in self.keys]
        given = rows.dropna(subset=self.keys)
        if by is not None:
            last = F.max_by(F.struct(*rest), F.col(by)) if rest else F.lit(None)
            given = given.groupBy(*self.keys).agg(last.alias("r")).select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        given = given.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        return self._changed(given, lambda old: old.join(given.select(*self.keys), self.keys, "left_anti").select(*self.schema.names), given)

    def remove(self, keys: DataFrame) -> int:
        """Remove the rows of keys; returns the version."""
        gone = keys.select(*self.keys).distinct()
        return self._changed(gone, lambda old: old.join(gone, self.keys, "left_anti").select(*self.schema.names), None)

    def unused(self) -> list[str]:
        """Folders of writers that no version names: of writers that failed, or are at work."""
        named = {f.split("/")[0] for v in self.versions() for f in self.manifest(v)["buckets"].values()}
        fs, folder = self._fs(), self._path(f"{self.home}/data")
        have = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(set(have) - named)
