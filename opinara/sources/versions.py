"""Tables of write-once folders, switched by one pointer.

A write fills a folder that nobody reads yet; then a new pointer file, which lists the folders of the
table, appears by one rename.  Readers follow the newest pointer, so they see all of a write or
nothing, in however many partitions and tables it lies.  One writer at a time: a second one finds
its pointer taken and fails without a trace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_POINTERS = "_pointers"


class Versions:
    """The folders of one table; ``kind`` tells apart what is stored side by side, such as rows and keys."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> tuple[int, list[str]]:
        """Number of the newest pointer (0: none) and its folders, oldest first."""
        pointers = self._path(f"{self.root}/{_POINTERS}")
        if not self._fs.exists(pointers):
            return 0, []
        names = [s.getPath().getName() for s in self._fs.listStatus(pointers)]
        newest = max((int(n) for n in names if n.isdigit()), default=0)
        if not newest:
            return 0, []
        said = self.spark._jvm.java.util.Scanner(self._fs.open(self._path(f"{self.root}/{_POINTERS}/{newest}")), "UTF-8")
        try:
            return newest, said.useDelimiter("\\A").next().split("\n")
        finally:
            said.close()

    def new_folder(self, kind: str, n: int) -> str:
        """Name of a folder for the write that follows version ``n``."""
        return f"{kind}/write={n + 1}-{uuid.uuid4().hex[:12]}"

    def path(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def switch(self, n: int, folders: list[str]) -> None:
        """Make ``folders`` the table, if version ``n`` still is the newest."""
        made = self._path(f"{self.root}/{_POINTERS}/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/{_POINTERS}/{n + 1}")
        out = self._fs.create(made, False)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(made, final):
            raise RuntimeError(f"another writer has changed {self.root}")

    def folders(self, kind: str) -> list[str]:
        return [f for f in self.current()[1] if f.startswith(f"{kind}/")]

    def read(self, kind: str, schema: StructType, folders: list[str] | None = None) -> DataFrame:
        """All rows of a kind, with ``_version``, the number of the write that each came with."""
        folders = self.folders(kind) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("_version", F.lit(0))
        rows = (self.spark.read.schema(StructType([*schema.fields]).add("write", "string")).option("basePath", self.path(kind))
                .parquet(*map(self.path, folders)))
        return rows.select(*schema.fieldNames(), F.substring_index("write", "-", 1).cast("int").alias("_version"))


def append(spark: SparkSession, path: str, rows: DataFrame, partition_by: str | None = None, kind: str = "rows") -> None:
    """Add a folder of rows; they appear at once."""
    table = Versions(spark, path)
    n, folders = table.current()
    folder = table.new_folder(kind, n)
    write(rows, table.path(folder), partition_by)
    table.switch(n, [*folders, folder])


def write(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    if partition_by:
        rows.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        rows.write.parquet(path)
