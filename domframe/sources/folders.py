"""Page folders as a data source that plans its partitions by website and takes filters.

spark.read.format("page_folders").option("suffix", "-exact").load(root); register PageFolders first. Folders of other
websites than those asked for are not opened, and pages of other numbers are not read. They are named by the options
verticals and websites (separated by commas), first and last (page_index); with the option push, and with
spark.sql.python.filterPushdown.enabled set, also by a query's filters on these columns. Spark keeps what it has pushed
into a table that is loaded for its next query too: load it anew for each query then.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import files
from .corpora import EXCLUDED_VERTICALS, EXCLUDED_WEBSITES

SCHEMA = "vertical string, website string, page_count int, page_index int, url string, html string"
_BASE = re.compile(r'<base href="([^\n]*)"/>')


class PageFolders(DataSource):
    """Files <vertical>/<vertical>-<site>(<count>)/NNNN<suffix>.htm; option pages: pages of a partition."""

    @classmethod
    def name(cls) -> str:
        return "page_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("push", "").lower() == "true" else _Reader)(self.options)


class _Pages(InputPartition):
    def __init__(self, vertical: str, website: str, count: int, folder: str, names: list[str]):
        self.vertical, self.website, self.count, self.folder, self.names = vertical, website, count, folder, names


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.suffix, self.pages = options["path"].rstrip("/"), options.get("suffix", ""), int(options.get("pages", 200))
        self.wanted: list[Filter] = [In((c,), tuple(options[f"{c}s"].split(","))) for c in ("vertical", "website") if f"{c}s" in options]
        self.wanted += [kind(("page_index",), int(options[name])) for name, kind in (("first", GreaterThanOrEqual), ("last", LessThanOrEqual)) if name in options]

    def _fits(self, column: str, value) -> bool:
        tests = {EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value}
        return all(tests[type(f)](value, f) for f in self.wanted if f.attribute == (column,))

    def partitions(self) -> list[InputPartition]:
        """A website is one partition or several; only folders of wanted websites are listed."""
        out: list[InputPartition] = []
        for vertical in files.listed(self.root, folders=True):
            if vertical in EXCLUDED_VERTICALS or not self._fits("vertical", vertical):
                continue
            for name in files.listed(f"{self.root}/{vertical}", folders=True):
                m = re.fullmatch(re.escape(vertical) + r"-([^/(]+)\((\d+)\)", name)
                if not m or (vertical, m[1]) in EXCLUDED_WEBSITES or not self._fits("website", m[1]):
                    continue
                folder = f"{self.root}/{vertical}/{name}"
                own = [x for x in files.listed(folder, folders=False) if re.fullmatch(r"\d{4}" + re.escape(self.suffix) + r"\.htm", x) and self._fits("page_index", int(x[:4]))]
                out += [_Pages(vertical, m[1], int(m[2]), folder, own[lo : lo + self.pages]) for lo in range(0, len(own), self.pages)]
        return out or [_Pages("", "", 0, self.root, [])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for name in partition.names:
            path = f"{partition.folder}/{name}"
            content = files.read(path).decode("utf-8").removeprefix("﻿")
            first, _, rest = content.partition("\n")
            m = _BASE.fullmatch(first.removesuffix("\r"))
            url = m[1] if m and m[1] else path if "://" in path else f"file://{path}"
            yield partition.vertical, partition.website, partition.count, int(name[:4]), url, rest if m else content


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, EqualTo | In) and name in (("vertical",), ("website",), ("page_index",)) or isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and name == ("page_index",):
                self.wanted.append(f)
            elif not isinstance(f, IsNotNull):  # no column holds nulls
                yield f
