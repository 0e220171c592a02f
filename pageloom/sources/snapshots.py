"""Page snapshots as a data source of their own: ``page_snapshots``.

The interface behind which a user puts another store of pages: it lists
partitions, takes the filters that it can use, and gives batches of pages. This
one reads Parquet files. Planning looks at file footers only; row groups whose
statistics rule a filter out are never opened, and each row group left is a
partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

NAME = "page_snapshots"
BATCH_ROWS = 1000
_COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}

#: How a filter compares: with a value, and with the least and the largest of a row group.
_COMPARE = {
    EqualTo: (pc.equal, lambda low, high, v: low <= v <= high),
    GreaterThan: (pc.greater, lambda low, high, v: high > v),
    GreaterThanOrEqual: (pc.greater_equal, lambda low, high, v: high >= v),
    LessThan: (pc.less, lambda low, high, v: low < v),
    LessThanOrEqual: (pc.less_equal, lambda low, high, v: low <= v),
}


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int


class SnapshotReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri = uri
        self.columns = schema.names
        self.taken: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of page_id and url with values are done here; the rest goes back."""
        for f in filters:
            known = isinstance(f, (*_COMPARE, In)) and len(f.attribute) == 1 and f.attribute[0] in ("page_id", "url")
            if known and f.value is not None:
                self.taken.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        files, root = pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)
        if files.get_file_info(root).type == pafs.FileType.File:
            return files, [root]
        found = files.get_file_info(pafs.FileSelector(root, recursive=True))
        return files, sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def _may_match(self, group) -> bool:
        """Whether the statistics of a row group leave room for the filters."""
        columns = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for kind, name, value in self.taken:
            found = columns.get(name)
            if found is None or not found.has_min_max:
                continue
            tests = [(EqualTo, v) for v in value if v is not None] if kind is In else [(kind, value)]
            if not any(_COMPARE[k][1](found.min, found.max, v) for k, v in tests):
                return False
        return True

    def partitions(self) -> list[RowGroup]:
        files, paths = self._files()
        parts = []
        for path in paths:
            meta = pq.read_metadata(path, filesystem=files)
            parts += [RowGroup(path, i) for i in range(meta.num_row_groups) if self._may_match(meta.row_group(i))]
        return parts or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        files, _ = self._files()
        names = list(dict.fromkeys([*self.columns, *(name for _, name, _ in self.taken)]))
        source = pq.ParquetFile(partition.path, filesystem=files)
        for batch in source.iter_batches(BATCH_ROWS, row_groups=[partition.number], columns=names):
            table = pa.Table.from_batches([batch])
            for kind, name, value in self.taken:
                column = table.column(name)
                mask = pc.is_in(column, pa.array(list(value), column.type)) if kind is In else _COMPARE[kind][0](column, value)
                table = table.filter(mask)
            wanted = pa.schema([(name, _COLUMNS[name]) for name in self.columns])
            yield from table.select(self.columns).cast(wanted).to_batches()


class PageSnapshots(DataSource):
    """``spark.read.format("page_snapshots").load(path)``: ``page_id, url, html``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page_id bigint, url string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SnapshotReader(self.options["path"], schema)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Pages through the source; it is registered and may take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSnapshots)
    return spark.read.format(NAME).load(path)
