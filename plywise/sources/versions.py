"""Tables made of parts, with a numbered list of the parts that count.

A write adds a folder, which nobody reads, and then a small file that lists the folders of the table from now on. That
file appears by a rename, so a reader sees the old or the new table, and a write that fails leaves the old one. A number
is used once: a batch that is repeated under its number changes nothing. Parts of about the same age are merged once
there are ``FAN`` of them, so a table of n batches has about log n parts and a row is rewritten about log n times.
Folders that neither of the last two lists names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plywise.operators.ordering import last_per_key

FAN = 8
Merge = Callable[[DataFrame], DataFrame]


class Versioned:
    """A table below ``root``, optionally partitioned by columns of its rows.

    ``owner`` names who numbers the writes; a write by another owner is refused. ``notes`` are kept with the table.
    """

    def __init__(self, spark: SparkSession, root: str, partition_by: Sequence[str] = (), owner: str | None = None, notes: dict | None = None):
        self.spark, self.root, self.partition_by, self.owner, self.notes = spark, root.rstrip("/"), list(partition_by), owner, notes or {}
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        lists = self._path(f"{self.root}/lists")
        if not self._files.exists(lists):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(lists)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _list(self, number: int) -> dict:
        opened = self._files.open(self._path(f"{self.root}/lists/{number:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def _checked(self, number: int) -> dict:
        listed = self._list(number)
        if self.owner is not None and listed["owner"] not in (None, self.owner):
            raise ValueError(f"{self.root} belongs to {listed['owner']}; take a new folder for {self.owner}")
        return listed

    def _publish(self, number: int, parts: list[dict], schema: StructType) -> None:
        listed = {"parts": parts, "schema": schema.jsonValue(), "owner": self.owner, "notes": self.notes}
        new, final = (self._path(f"{self.root}/lists/{n}") for n in (f".{uuid4().hex}", f"{number:020d}.json"))
        out = self._files.create(new, False)
        try:
            out.write(bytearray(json.dumps(listed, sort_keys=True).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(new, final):
            self._files.delete(new, False)
            raise RuntimeError(f"{self.root}: list {number} was written by another writer")

    def _as_of(self, number: int | None) -> dict | None:
        numbers = [n for n in self.numbers() if number is None or n <= number]
        return self._list(numbers[-1]) if numbers else None

    def noted(self) -> dict:
        """The notes of the last write."""
        listed = self._as_of(None)
        return listed["notes"] if listed else {}

    def rows(self, upto: int | None = None, where: Column | None = None) -> DataFrame | None:
        """The rows of all parts with ``part``, which is larger for later ones; None before the first write.

        ``upto`` reads the table as it was after that number (one of the last two), ``where`` is put to the parts'
        scans, so that a condition on partition columns leaves folders out.
        """
        listed = self._as_of(upto)
        if listed is None:
            return None
        schema, out = StructType.fromJson(listed["schema"]), None
        for i, part in enumerate(listed["parts"]):
            found = self.spark.read.schema(schema).parquet(f"{self.root}/data/{part['folder']}")
            found = (found if where is None else found.where(where)).withColumn("part", F.lit(i))
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], schema).withColumn("part", F.lit(0))

    def _write(self, rows: DataFrame) -> str:
        folder = uuid4().hex
        rows.write.option("compression", "zstd").partitionBy(*self.partition_by).parquet(f"{self.root}/data/{folder}")
        return folder

    def append(self, rows: DataFrame, number: int, merge: Merge | None = None) -> bool:
        """Add ``rows`` as a part under this number, unless it or a later one is there; says whether it was added.

        ``merge`` makes one part of several (rows with ``part``); without it, parts are merged as they are.
        """
        numbers = self.numbers()
        listed = self._checked(numbers[-1]) if numbers else {"parts": []}
        if numbers and numbers[-1] >= number:
            return False
        parts = [*listed["parts"], {"folder": self._write(rows), "age": 0}]
        schema = self._schema(rows)
        while len(parts) >= FAN and len({p["age"] for p in parts[-FAN:]}) == 1:
            several = None
            for i, p in enumerate(parts[-FAN:]):
                one = self.spark.read.schema(schema).parquet(f"{self.root}/data/{p['folder']}").withColumn("part", F.lit(i))
                several = one if several is None else several.unionByName(one)
            merged = several.drop("part") if merge is None else merge(several)
            parts = [*parts[:-FAN], {"folder": self._write(merged.select(*schema.names)), "age": parts[-1]["age"] + 1}]
        self._publish(number, parts, schema)
        self._tidy()
        return True

    def _schema(self, rows: DataFrame) -> StructType:
        """Partition columns last, as they are read."""
        return StructType([*rows.drop(*self.partition_by).schema.fields, *[rows.schema[c] for c in self.partition_by]])

    def replace(self, rows: DataFrame, number: int | None = None) -> None:
        """Make ``rows`` the whole table."""
        numbers = self.numbers()
        number = (numbers[-1] + 1 if numbers else 0) if number is None else number
        self._publish(number, [{"folder": self._write(rows), "age": 0}], self._schema(rows))
        self._tidy()

    def _tidy(self) -> None:
        numbers = self.numbers()
        for number in numbers[:-2]:
            self._files.delete(self._path(f"{self.root}/lists/{number:020d}.json"), False)
        used = {p["folder"] for n in numbers[-2:] for p in self._list(n)["parts"]}
        for status in self._files.listStatus(self._path(f"{self.root}/data")):
            if status.getPath().getName() not in used:
                self._files.delete(status.getPath(), True)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every key the row of the latest part."""
    return last_per_key(rows, keys, ["part"]).drop("part")


def replace_groups(rows: DataFrame, table: Versioned, key: str) -> None:
    """Replace the groups (values of ``key``) that ``rows`` holds; the others stay, without being read or copied.

    The table is read with ``groups``: of every group the rows of the latest part that holds it.
    """
    numbers = table.numbers()
    table.append(rows, numbers[-1] + 1 if numbers else 0, lambda several: groups(several, key))


def groups(rows: DataFrame, key: str) -> DataFrame:
    """Of every group all rows of the latest part that holds it."""
    newest = rows.groupBy(key).agg(F.max("part").alias("part"))
    return rows.join(newest, [key, "part"], "left_semi").drop("part")
