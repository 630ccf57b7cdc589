"""A data source of annotated policy files: each file is a partition, read as a stream of rows and folded into items.

    spark.dataSource.register(PolicyItems)
    spark.read.format("policy_items").load("folder of csv files")

Filters on the column file choose the partitions, so files that they exclude are not opened.
Files are opened through pyarrow's file systems: local paths and the stores that it knows by their URI.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..functions import tables as T

SCHEMA = "file string, item int, data_categories array<string>, actions array<string>, purposes array<string>"
# Substrings of an annotation row that tell a term. Fixed values.
KEYWORDS = {
    "location": "Location", "gps": "Location", "contact": "Contact", "email": "Contact", "phone": "Contact", "address": "Contact",
    "demographic": "Demographic", "gender": "Demographic", "age": "Demographic", "health": "Health", "medical": "Health",
    "financial": "Financial", "credit card": "Financial", "bank": "Financial", "device id": "DeviceID", "imei": "DeviceID", "mac address": "DeviceID",
    "ip address": "IPAddress", "cookies": "cookies", "browser history": "BrowsingHistory",
    "collection": "Collect", "collect": "Collect", "sharing": "Share", "share": "Share", "disclosure": "Share", "use": "Use",
    "marketing": "Marketing", "advertising": "Advertising", "analytics": "Analytics", "legal": "Legal", "security": "Security",
}


@dataclass
class File(InputPartition):
    path: str


def fold(rows: Iterator[list[str]]) -> Iterator[tuple[list[str], list[str], list[str]]]:
    """Sorted categories, actions and purposes of each item: what rows mention is gathered until there is a category and an action, then anew. The rest at the end is dropped."""
    data, actions, purposes = set(), set(), set()
    for row in rows:
        text = " ".join(row).lower()
        for word, term in KEYWORDS.items():
            if word in text:
                (data if term in T.VOCAB_DATA else actions if term in T.VOCAB_ACTIONS else purposes).add(term)
        if data and actions:
            yield sorted(data), sorted(actions), sorted(purposes)
            data, actions, purposes = set(), set(), set()


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("file",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.path.endswith(".csv") and self._keeps(_name(i.path))] or [File("")]

    def read(self, partition: File):
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        csv.field_size_limit(min(sys.maxsize, 1 << 31 - 1))
        with store.open_input_stream(partition.path) as f:
            lines = csv.reader(io.TextIOWrapper(f, "utf-8", errors="replace", newline=""))
            for n, item in enumerate(fold(lines)):
                yield (_name(partition.path), n, *item)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".csv")


class PolicyItems(DataSource):
    """Items of the csv files below a folder (without headers): SCHEMA, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "policy_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("policy_items needs a path")
        return _Reader(self.options["path"])


def policy_items(spark, path: str) -> DataFrame:
    spark.dataSource.register(PolicyItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("policy_items").load(path)


def contrastive(items: DataFrame, id: Column) -> DataFrame:
    """Two behaviours an item: as the policy has it (label 0), and with a category that it lacks, the one at the md5 of id (label 1; none where it lacks none)."""
    foreign = F.array_except(F.array(*map(F.lit, T.VOCAB_DATA)), F.col("data_categories"))
    h = F.conv(F.substring(F.md5(id.cast("string")), 1, 8), 16, 10).cast("long")
    kinds = F.array(F.struct(F.lit(0).alias("label"), F.col("data_categories").alias("behaviour")), F.struct(F.lit(1).alias("label"), F.array(F.get(foreign, (h % F.greatest(F.size(foreign), F.lit(1))).cast("int"))).alias("behaviour")))
    return items.select("*", F.explode(kinds).alias("b")).where((F.col("b.label") == 0) | (F.size(foreign) > 0)).select(*items.columns, "b.*")
