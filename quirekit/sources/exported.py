"""A data source over exported pages: one partition a file, with the page range pushed down to the files' statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quirekit.functions import folds

SCHEMA = "doc_id long, page_no int, markdown string"
LAST = 2**31 - 1


class PageFile(InputPartition):
    def __init__(self, path: str, groups: list[int]):
        self.path, self.groups = path, groups


class PagesReader(DataSourceReader):
    """Reads the row groups whose pages can be wanted, and of them the wanted pages."""

    def __init__(self, path: str, pages: str | None):
        self.path, self.least, self.most = path, 1, LAST
        self.wanted = None if not pages else frozenset(folds.page_range(pages, max(int(x) for part in pages.split(",") for x in part.split("-") if x.strip())))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on page_no narrow what is read; all filters are given back, so Spark applies them as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page_no",):
                if isinstance(f, EqualTo):
                    self.least, self.most = max(self.least, f.value), min(self.most, f.value)
                elif isinstance(f, In):
                    self.least, self.most = max(self.least, min(f.value)), min(self.most, max(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            yield f

    def _may_have(self, least: int, most: int) -> bool:
        inside = least <= self.most and most >= self.least
        return inside and (self.wanted is None or any(least <= n <= most for n in self.wanted))

    def partitions(self) -> list[PageFile]:
        store, root = fs.FileSystem.from_uri(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if not info.path.endswith(".parquet"):
                continue
            meta = pq.read_metadata(info.path, filesystem=store)
            at = meta.schema.names.index("page_no")
            groups = []
            for g in range(meta.num_row_groups):
                seen = meta.row_group(g).column(at).statistics
                if seen is None or not seen.has_min_max or self._may_have(seen.min, seen.max):
                    groups.append(g)
            if groups:
                out.append(PageFile(info.path, groups))
        return out

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=partition.groups, columns=["doc_id", "page_no", "markdown"]):
                numbers = batch.column("page_no").to_pylist()
                keep = [n is not None and self.least <= n <= self.most and (self.wanted is None or n in self.wanted) for n in numbers]
                kept = batch.filter(pa.array(keep))
                types = (pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(kept.columns, types)], names=["doc_id", "page_no", "markdown"])


class PagesSource(DataSource):
    """``spark.read.format("exported_pages").option("path", uri).option("pages", "1-3,5").load()``: exported pages (doc_id, page_no, markdown).

    The path is a URI of a folder of Parquet files that every executor reaches. Pages without a number are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "exported_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"], self.options.get("pages"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
