"""Landed pages as a Spark data source: a batch and a streaming reader of the format ``landed_pages``.

A folder holds a folder page=N for each page of a paged scan or of a webhook log, with files that hold one JSON object with data[]
on each line. Options: path (any file system that Arrow opens: a local or mounted path, or a URI), pages_per_task. Rows: page, pos, id (the
item's id, null where it has none), item (its JSON). Conditions on page are pushed down, so pages that cannot match are not opened. A stream
reads pages in the order of their numbers: its offset is the last page that a batch has read, kept in the checkpoint, so a
restarted query reads each page once. A page must be complete when it appears. Lines that are no JSON object, or have no data[], give no rows.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

SCHEMA = "page long, pos int, id long, item string"
_ARROW = pa.schema([("page", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("item", pa.string())])
PAGES_PER_TASK = 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def numbers(path: str) -> list[int]:
    """The numbers of the pages that have landed, in order."""
    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(x.base_name[5:]) for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("page=") and x.base_name[5:].isdigit())


def rows(path: str, page: int) -> Iterator[tuple[int, int, int | None, str]]:
    """The items of a page."""
    system, root = _opened(path)
    files = sorted(x.path for x in system.get_file_info(fs.FileSelector(posixpath.join(root, f"page={page}"))) if x.is_file and not x.base_name.startswith(("_", ".")))
    pos = 0
    for file in files:
        with system.open_input_stream(file) as stream:
            for line in stream.read().decode("utf-8", "replace").splitlines():
                try:
                    data = json.loads(line)
                except ValueError:
                    continue
                for item in data.get("data") or [] if isinstance(data, dict) else []:
                    own = item.get("id") if isinstance(item, dict) else None
                    yield page, pos, own if type(own) is int and abs(own) < 1 << 63 else None, json.dumps(item, ensure_ascii=False, separators=(",", ":"))
                    pos += 1


@dataclass
class Pages(D.InputPartition):
    of: list[int]


def _dealt(pages: list[int], size: int) -> list[Pages]:
    return [Pages(pages[i : i + size]) for i in range(0, len(pages), size)]


class _Reads:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("pages_per_task", PAGES_PER_TASK))

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        """The pages of a partition; Spark asks for none where there are none."""
        for page in partition.of if partition else []:
            found = list(rows(self.path, page))  # one page
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)] if found else [pa.array([], t) for t in _ARROW.types], schema=_ARROW)


class PagesReader(_Reads, D.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.holds = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Takes the conditions on page; the others are left to Spark."""
        tests = {D.EqualTo: lambda p, v: p == v, D.GreaterThan: lambda p, v: p > v, D.GreaterThanOrEqual: lambda p, v: p >= v, D.LessThan: lambda p, v: p < v, D.LessThanOrEqual: lambda p, v: p <= v, D.In: lambda p, v: p in v}
        for f in filters:
            if type(f) in tests and f.attribute == ("page",):
                self.holds.append((tests[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        return _dealt([p for p in numbers(self.path) if all(test(p, v) for test, v in self.holds)], self.size)


class PagesStream(_Reads, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max(numbers(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return _dealt([p for p in numbers(self.path) if start["page"] < p <= end["page"]], self.size)

    def commit(self, end: dict) -> None:
        """Pages stay where they landed."""


class LandedPages(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options)


def land(pages: DataFrame, path: str) -> None:
    """Writes pages (page, value as JSON text with data[]) as this source reads them."""
    pages.select("page", "value").repartition("page").write.mode("append").partitionBy("page").text(path)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format and its pushed-down conditions switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    return spark
