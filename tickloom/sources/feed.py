"""A feed of trades in pages as a Spark data source, for batches and for streams.

A feed is a folder with one subfolder a page, ``page=<from>_<until>`` in milliseconds, of Parquet files whose trades all have from <= ts < until. Pages may overlap, as those
of an exchange do, so a trade may come twice; (series, seq) tells. A page is whole once it is listed, and later pages have a larger ``until``; the newest
pages may still grow where the option ``open`` says how many.

Pages are chosen by their names alone: a filter on ``ts`` leaves out those beyond it before any is opened, and Spark applies it to the trades of the rest. Files are read in
partitions of about ``partitionBytes``, a batch at a time, so a page of any size streams through a task. A stream's offset is the ``until`` of the last page it has planned:
it is in the query's checkpoint, and a restart goes on with the page after it. Only names and sizes reach the driver.

Options: ``path`` (local, or a file system that pyarrow knows), ``partitionBytes`` (128 MB), ``open`` (0). A column that a page lacks is null there, further ones are
left unread; rows without a time belong to no page. An empty folder is an empty feed; a missing one is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "series long, seq long, ts timestamp, price double, amount double, side string"
TYPES = {"series": pa.int64(), "seq": pa.int64(), "ts": pa.timestamp("us", "UTC"), "price": pa.float64(), "amount": pa.float64(), "side": pa.string()}
PAGE = re.compile(r"/page=(-?\d+)_(-?\d+)/[^/_.][^/]*$")
BEFORE = -(1 << 62)


@dataclass(frozen=True)
class File:
    since: int
    until: int
    path: str
    size: int


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


class Pages:
    """The listing of a feed, and the reading of its files."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        unknown = [c for c in schema.fieldNames() if c not in TYPES]
        if unknown:
            raise KeyError(f"a feed has no columns {', '.join(unknown)}")
        if not options.get("path"):
            raise KeyError("a feed needs a path")
        self.path, self.names = options["path"], schema.fieldNames()
        self.size, self.open = int(options.get("partitionBytes", 128 << 20)), int(options.get("open", 0))

    def _system(self) -> tuple[pf.FileSystem, str]:
        if self.path.startswith("file:"):
            return pf.LocalFileSystem(), "/" + self.path[5:].lstrip("/")
        return pf.FileSystem.from_uri(self.path) if "://" in self.path else (pf.LocalFileSystem(), self.path)

    def listed(self) -> list[File]:
        """Files of whole pages, in the order of pages."""
        system, root = self._system()
        got = []
        for f in system.get_file_info(pf.FileSelector(root, recursive=True)):
            name = PAGE.search(f.path)
            if name and f.is_file and f.size:
                got.append(File(int(name[1]), int(name[2]), f.path, f.size))
        growing = sorted({f.until for f in got})[-self.open :] if self.open else []
        return sorted((f for f in got if f.until not in growing), key=lambda f: (f.until, f.since, f.path))

    def planned(self, files: list[File]) -> list[Files]:
        out, held, size = [], [], 0
        for f in files:
            if held and size + f.size > self.size:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return out + [Files(held)] if held else out

    def batches(self, part: InputPartition | None) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        schema = pa.schema([(c, TYPES[c]) for c in self.names])
        for path in part.value if part is not None else []:
            with system.open_input_file(path) as source:
                file = pq.ParquetFile(source, coerce_int96_timestamp_unit="us")
                own = [c for c in self.names if c in file.schema_arrow.names]
                for b in file.iter_batches(columns=own or file.schema_arrow.names[:1]):
                    columns = [b.column(c).cast(TYPES[c]) if c in own else pa.nulls(b.num_rows, TYPES[c]) for c in self.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)


class FeedReader(DataSourceReader):
    def __init__(self, pages: Pages) -> None:
        self.pages, self.low, self.high = pages, BEFORE, -BEFORE

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take bounds on ``ts`` for the choice of pages; all filters go back to Spark, which applies them to rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), datetime) and f.value.tzinfo is not None:
                ms = int(f.value.timestamp() // 0.001) - 1, int(f.value.timestamp() // 0.001) + 2  # wide enough for any rounding
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, ms[0])
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, ms[1])
            yield f

    def partitions(self) -> list[Files]:
        return self.pages.planned([f for f in self.pages.listed() if f.until > self.low and f.since <= self.high])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.pages.batches(partition)


class FeedStream(DataSourceStreamReader):
    def __init__(self, pages: Pages) -> None:
        self.pages, self.last = pages, BEFORE

    def initialOffset(self) -> dict:
        return {"until": BEFORE}

    def latestOffset(self) -> dict:
        self.last = max([self.last, *(f.until for f in self.pages.listed())])
        return {"until": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.pages.planned([f for f in self.pages.listed() if start["until"] < f.until <= end["until"]])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.pages.batches(partition)


class TradeFeed(DataSource):
    """``spark.read.format("trade_feed").load(path)`` and ``spark.readStream...``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "trade_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(Pages(self.options, schema))

    def streamReader(self, schema: StructType) -> FeedStream:
        return FeedStream(Pages(self.options, schema))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TradeFeed)


def write_pages(trades: DataFrame, path: str, span_ms: int, overlap_ms: int = 0) -> None:
    """Add trades to a feed in pages of ``span_ms``, each with the ``overlap_ms`` before it too. A page with much of all trades is written by several tasks.

    Rows without a time have no page and aren't written; ``overlap_ms`` is at most ``span_ms``.
    """
    if not 0 <= overlap_ms <= span_ms or span_ms < 1:
        raise ValueError("a page spans at least a millisecond and overlaps one page at most")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.floor(ms / span_ms)
    pages = F.when(ms >= (k + 1) * span_ms - overlap_ms, F.array(k, k + 1)).otherwise(F.array(k))
    each = trades.where("ts is not null").withColumn("__k", F.explode(pages)).withColumn("ts", F.col("ts").cast("timestamp"))
    named = each.withColumn("page", F.concat_ws("_", F.col("__k") * span_ms - overlap_ms, (F.col("__k") + 1) * span_ms))
    named.repartitionByRange("__k", "series", "seq").drop("__k").write.mode("append").partitionBy("page").parquet(path)


def tape(feed: DataFrame) -> DataFrame:
    """Each trade of a batch once, by (series, seq); ``streaming.ingest.deduplicate`` does so for a stream."""
    return feed.dropDuplicates(["series", "seq"])
