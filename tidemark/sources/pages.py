"""A paged JSON source: what a cursor-paginated listing gives, read from files page by page, one partition a listing."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Listing(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    """Follows `cursor` from page to page; a page that is missing ends the listing, as an unknown one does."""

    def __init__(self, options: dict):
        self.paths = options["paths"].split(",")
        self.key, self.start = options.get("key", "rows"), options.get("start", "0")

    def partitions(self) -> list[InputPartition]:
        return [Listing(p) for p in self.paths]

    def read(self, partition: Listing) -> Iterator[tuple]:
        cursor = self.start
        while cursor:
            page = Path(partition.path, f"{cursor}.json")
            if not page.exists():
                return
            body = json.loads(page.read_text())
            for row in body.get(self.key, []):
                yield (Path(partition.path).name, json.dumps(row, sort_keys=True))
            cursor = body.get("cursor")


class PagedJson(DataSource):
    """spark.dataSource.register(PagedJson); spark.read.format("paged_json").option("paths", "a,b").load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "listing string, row string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
