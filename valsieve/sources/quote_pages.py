"""Quotes from pages as a listing service delivers them: one file of JSON lines a page, in folders by market and sector.

A page is a partition of its own; of more pages than ``PARTITIONS``, neighbours in
path order share one, as a task costs more than a page.  Filters on the market or the
sector are pushed to the list of pages, so pages of other buckets aren't opened.
Pushing needs ``spark.sql.python.filterPushdown.enabled`` (set in
``session.SESSION_CONF``); without it Spark filters the rows of all pages.  Paths may
be of any file system that Arrow opens.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "region string, sector string, ticker string, price double, mcap_c bigint, volume bigint"
FOLDERS = ("region", "sector")
#: Partitions a scan is cut into at most, whatever the number of pages.
PARTITIONS = 256


@dataclass
class Page:
    path: str
    region: str
    sector: str


@dataclass
class Pages(InputPartition):
    pages: list[Page]


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set[str]] = {}

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.path)
        pages = []
        for found in system.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in found.path.split("/") if "=" in p)
            if found.type != fs.FileType.File or not found.path.endswith(".json") or not all(f in parts for f in FOLDERS):
                continue
            place = {f: unquote(parts[f]) for f in FOLDERS}
            if all(place[f] in values for f, values in self.wanted.items()):
                pages.append(Page(found.path, **place))
        pages.sort(key=lambda p: p.path)
        run = -(-len(pages) // PARTITIONS) or 1
        return [Pages(pages[start:start + run]) for start in range(0, len(pages), run)]

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import json

        if partition is None:  # no page is left
            return
        system, _ = file_system(self.path)
        names = ("ticker", "price", "mcap_c", "volume")
        kinds = dict(zip(names, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))
        options = json.ParseOptions(explicit_schema=pa.schema(list(kinds.items())))
        for page in partition.pages:
            with system.open_input_stream(page.path) as file:
                table = json.read_json(file, parse_options=options)
            for batch in table.to_batches():
                place = [pa.array([value] * batch.num_rows, pa.string()) for value in (page.region, page.sector)]
                yield pa.RecordBatch.from_arrays([*place, *(batch.column(n) for n in names)], names=[*FOLDERS, *names])


class FilteringPageReader(PageReader):
    """Spark refuses a reader that takes filters where their pushing is switched off, so this is a reader of its own."""

    def pushFilters(self, filters):
        for one in filters:
            if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 and one.attribute[0] in FOLDERS:
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                name = one.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield one


class AllQuotePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "all_quote_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


class QuotePages(AllQuotePages):
    @classmethod
    def name(cls) -> str:
        return "quote_pages"

    def reader(self, schema) -> PageReader:
        return FilteringPageReader(self.options["path"])


def read_quote_pages(spark: SparkSession, path: str) -> DataFrame:
    """region, sector, ticker, price, mcap_c, volume of all pages below ``path``."""
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    source = QuotePages if pushing else AllQuotePages
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(path)


def write_quote_pages(quotes: DataFrame, path: str, rows: int) -> None:
    """Pages of at most ``rows`` quotes.

    Each task moves its own pages into place: the driver would move them one by one.
    """
    quotes.select(*SCHEMA.replace(" string", "").replace(" double", "").replace(" bigint", "").split(", ")).write.partitionBy(
        *FOLDERS).option("maxRecordsPerFile", rows).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)
