"""Rows of a paged HTTP row API as a Spark data source: one partition a page.

    spark.dataSource.register(RowsApi)
    spark.read.format("rows_api").option("url", "https://…/rows?…").option("rows", 300).load()

Each page is read at `{url}&offset=…&length=…` (or from a file pattern with {offset} in it) and must be a JSON object
{"rows": [{"row": {"index", "text", "answer"}}]}.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = 100


class Page(InputPartition):
    def __init__(self, offset: int):
        self.value = offset


class RowsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.rows = options["url"], int(options.get("rows", PAGE))

    def partitions(self) -> list[InputPartition]:
        return [Page(o) for o in range(0, max(1, self.rows), PAGE)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = partition.value
        url = self.url.format(offset=o) if "{offset}" in self.url else f"{self.url}&offset={o}&length={min(PAGE, self.rows - o)}"
        with urlopen(url, timeout=60) as reply:
            for r in json.load(reply).get("rows", []):
                row = r.get("row", {})
                yield row.get("index"), row.get("text"), row.get("answer")


class RowsApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rows_api"

    def schema(self) -> str:
        return "idx int, text string, answer string"

    def reader(self, schema: StructType) -> RowsReader:
        return RowsReader(self.options)
