"""Tables of Parquet files with versions: copy-on-write by bucket, a manifest for each version, compare-and-swap of the newest.

A version is a small text file that names, for each bucket, the folder its rows are in. A change reads and writes only the
buckets it touches, into a folder of its own; then it creates the next manifest, which only one writer can. A writer whose
base is no longer the newest version is refused. What a killed writer leaves behind is a folder that no manifest names, or a
manifest without its last line, which is no version; after LEASE seconds the next writer passes it by.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

LEASE, END = 600, "#end\n"


class Refused(RuntimeError):
    """Another writer was faster; read again and retry."""


class Table:
    """Rows dealt to `buckets` by a hash of the column `key`. path: a folder that all nodes share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._at(f"{self.path}/versions"))

    def _manifests(self) -> list[tuple[int, float]]:
        """(number, time) of all manifests, whole or not."""
        found = self.fs.listStatus(self._at(f"{self.path}/versions"))
        return sorted((int(s.getPath().getName()), s.getModificationTime() / 1000) for s in found if s.getPath().getName().isdigit())

    def _read(self, number: int) -> dict | None:
        stream = self.fs.open(self._at(f"{self.path}/versions/{number:08d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text[: -len(END)]) if text.endswith(END) else None

    def version(self) -> int:
        """The newest whole version; 0 is the empty table."""
        return next((n for n, _ in reversed(self._manifests()) if self._read(n) is not None), 0)

    def folders(self, version: int) -> dict[int, str]:
        return {int(b): p for b, p in self._read(version)["buckets"].items()} if version else {}

    def upto(self, version: int | None = None) -> int:
        """The number of the last change that a version holds; -1 where its changes had none."""
        version = self.version() if version is None else version
        return self._read(version).get("upto", -1) if version else -1

    def bucket(self, key=None):
        return F.pmod(F.xxhash64(key if key is not None else F.col(self.key)), F.lit(self.buckets)).cast("int")

    def rows(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or only those of some buckets."""
        version = self.version() if version is None else version
        paths = [p for b, p in sorted(self.folders(version).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], base: int | None = None, number: int | None = None) -> int:
        """The version after merge(rows of the touched buckets, changes): the new rows of these buckets. changes has the key.

        number: the change's place in a log, such as the epoch of a stream; one that the table holds already changes nothing.
        """
        base = self.version() if base is None else base
        upto = self.upto(base)
        if number is not None and number <= upto:
            return base
        number = upto if number is None else number
        touched = {r.b for r in changes.select(self.bucket().alias("b")).distinct().collect()}  # numbers of buckets
        if not touched:
            return base if number == upto else self.publish(base, self.folders(base), number)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        merge(self.rows(base, touched), changes).withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
        written = {int(s.getPath().getName().partition("=")[2]) for s in self.fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("bucket=")}
        folders = {b: p for b, p in self.folders(base).items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in written}
        return self.publish(base, folders, number)

    def publish(self, base: int, folders: dict[int, str], upto: int = -1) -> int:
        """Make `folders` the version after `base`, or refuse."""
        there = self._manifests()
        newest = there[-1][0] if there else 0
        if newest != base and (self.version() != base or time.time() - there[-1][1] < LEASE):
            raise Refused(f"version {base} is no longer the newest: {newest} is there")
        try:
            out = self.fs.create(self._at(f"{self.path}/versions/{newest + 1:08d}"), False)  # fails if it exists
        except Exception as e:
            raise Refused(f"version {newest + 1} is being written") from e
        try:
            out.write(bytearray((json.dumps({"base": base, "upto": upto, "buckets": folders}) + END).encode()))
        finally:
            out.close()
        return newest + 1
