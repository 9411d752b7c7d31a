"""A paged layer service as a data source: pages are the partitions, and a count check tells whether all came."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(DataSource):
    """Options: folder (holds count.json and page-<offset>.json, as a service answered them), page (rows a page)."""

    @classmethod
    def name(cls) -> str:
        return "cityloom_pages"

    def schema(self) -> str:
        return "id bigint, attributes string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["folder"], int(self.options.get("page", "1000")))


class Offset(InputPartition):
    def __init__(self, offset: int) -> None:
        super().__init__(offset)
        self.offset = offset


class PageReader(DataSourceReader):
    def __init__(self, folder: str, page: int) -> None:
        self.folder, self.page = folder, page

    def partitions(self) -> list[Offset]:
        count = json.loads((Path(self.folder) / "count.json").read_text())["count"]
        return [Offset(at) for at in range(0, count, self.page)] or [Offset(0)]

    def read(self, partition: Offset) -> Iterator[tuple]:
        path = Path(self.folder) / f"page-{partition.offset}.json"
        if path.exists():
            for x in json.loads(path.read_text())["features"]:
                yield x["attributes"]["OBJECTID"], json.dumps(x["attributes"])


def paged(spark: SparkSession, folder: str, page: int = 1000) -> DataFrame:
    """All rows, or an error if the service counted more than its pages hold."""
    spark.dataSource.register(Pages)
    df = spark.read.format("cityloom_pages").option("folder", folder).option("page", str(page)).load()
    want, got = json.loads((Path(folder) / "count.json").read_text())["count"], df.count()
    if want != got:
        raise ValueError(f"the service counts {want} rows, its pages hold {got}")
    return df


def answer_key(query: str) -> str:
    """The name under which a query's answer is kept: spaces don't matter."""
    import hashlib
    import re

    return hashlib.sha1(re.sub(r"\s+", " ", query).strip().encode()).hexdigest()
