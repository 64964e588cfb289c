"""Tables made of parts that are never changed, and a manifest that says which of them count.

A write adds a part in a folder of its own and then publishes a manifest with the next number; a manifest is
put in place by a rename that fails if its number is taken. So readers see all of a write or nothing, and
of two writers at once one is told to try again. Parts carry the number of the write they come from; a
write under a number that is already there takes its place. `compact` merges older parts into one.
Folders that the last two manifests do not name are removed.

Parts may be stored in buckets of a key's hash; `read` then opens the buckets asked for and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Live parts beyond which older ones are merged, and manifests that are kept.
MOST_PARTS, KEPT = 8, 2


class Files:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Whether the file could be put in place; never over another one."""
        folder, _, name = path.rpartition("/")
        self.fs.mkdirs(self.path(folder))
        draft = self.path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(draft, self.path(path), self.no_options)
        except Exception:
            self.fs.delete(draft, False)
            if self.fs.exists(self.path(path)):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


@dataclass(frozen=True)
class Part:
    number: int  # of the last write in it
    folder: str


class WriteConflict(RuntimeError):
    """Another writer has published first; nothing was changed."""


class PartsTable:
    """`schema` is that of the rows; reading adds `part`, the number of the write a row comes from."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, path)

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith("."))

    def parts(self, version: int | None = None) -> list[Part]:
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return []
        held = json.loads(self.files.text(f"{self.path}/manifests/{version:012d}.json"))
        return [Part(**p) for p in held["parts"]]

    def publish(self, parts: list[Part], after: int | None) -> None:
        """The next manifest; fails if somebody else has published since `after`."""
        version = 0 if after is None else after + 1
        text = json.dumps({"parts": [{"number": p.number, "folder": p.folder} for p in sorted(parts, key=lambda p: p.number)]})
        if not self.files.write_new(f"{self.path}/manifests/{version:012d}.json", text):
            raise WriteConflict(f"{self.path}: version {version} is taken")

    def write(self, rows: DataFrame, number: int | None, part: Column) -> str:
        folder = f"{number if number is not None else 'merged'}-{uuid.uuid4().hex[:12]}"
        out = rows.withColumn("part", part.cast("long"))
        if self.key:
            # Few files: a bucket's rows come together, and a large bucket is split.
            out = out.withColumn("bucket", self.bucket(self.key)).hint("rebalance", "bucket")
            out.write.partitionBy("bucket").parquet(f"{self.path}/parts/{folder}")
        else:
            out.write.parquet(f"{self.path}/parts/{folder}")
        return folder

    def add(self, rows: DataFrame, number: int | None = None) -> int:
        """Adds a write, by default with the next number; one of the same number is replaced."""
        version = max(self.versions(), default=None)
        parts = self.parts(version)
        number = max((p.number for p in parts), default=-1) + 1 if number is None else number
        folder = self.write(rows, number, F.lit(number))
        self.publish([p for p in parts if p.number != number] + [Part(number, folder)], version)
        return number

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all live parts, or of those numbered below `before`, of all buckets or of those given."""
        parts = [p for p in self.parts() if before is None or p.number < before]
        return self._rows(parts, buckets)

    def _rows(self, parts: list[Part], buckets: list[int] | None = None) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("part", LongType())])
        if not parts or buckets == []:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())]) if self.key else schema)
        # A part without rows has no bucket folders: the base path of each part is read on its own.
        found = None
        for p in parts:
            rows = reader.parquet(f"{self.path}/parts/{p.folder}")
            rows = rows.filter(F.col("bucket").isin(buckets)) if buckets is not None else rows
            rows = rows.drop("bucket") if self.key else rows
            found = rows if found is None else found.unionByName(rows)
        return found

    def compact(self, merge: Callable[[DataFrame], DataFrame], before: int | None = None, most: int = MOST_PARTS) -> bool:
        """Merges the parts numbered below `before` into one where there are more than `most`."""
        version = max(self.versions(), default=None)
        parts = self.parts(version)
        old = [p for p in parts if before is None or p.number < before]
        if len(old) <= most:
            return False
        merged = merge(self._rows(old))
        folder = self.write(merged.drop("part"), None, F.lit(0)) if "part" not in merged.columns else self.write(merged, None, F.col("part"))
        self.publish([p for p in parts if p not in old] + [Part(max(p.number for p in old), folder)], version)
        self.clear()
        return True

    def clear(self) -> None:
        """Removes what the last manifests do not name."""
        versions = self.versions()
        named = {p.folder for v in versions[-KEPT:] for p in self.parts(v)}
        for folder in set(self.files.names(f"{self.path}/parts")) - named:
            self.files.remove(f"{self.path}/parts/{folder}")
        for v in versions[:-KEPT]:
            self.files.remove(f"{self.path}/manifests/{v:012d}.json")
