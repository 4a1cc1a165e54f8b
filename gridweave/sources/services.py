"""Paged feature services and tiled box queries as data sources of Spark.

    services.register(spark)
    spark.read.format("feature_service").schema("ord long, NAME string, x double, y double").option("size", 1000).load(layer)

A page, or a tile, is a partition, so a lost task fetches its own again and nothing else. A layer is an address
of a service or a folder of saved pages (``page=0/...``), tiles likewise (``tile=0/...``). Conditions on x and y
are handed to the service as its box, and fetched rows outside it are left out.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

from gridweave.operators.ordering import ordinal
from gridweave.sources.pages import count_pages, page_url, pages
from gridweave.sources.stores import listed, read_text, remote
from gridweave.workspace import Workspace, ship

WORLD = (-90.0, 90.0, -180.0, 180.0)


def typed(value, kind):
    """A JSON or CSV value as a column's type; what can't be read as it is null."""
    if value is None or value == "" and not isinstance(value, bool):
        return None if not isinstance(value, str) or isinstance(kind, (BooleanType, DoubleType, FloatType, IntegerType, LongType)) else value
    try:
        if isinstance(kind, (IntegerType, LongType)):
            return int(float(value))
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")
    except (TypeError, ValueError):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def narrowed(box: tuple, filters: list[Filter]) -> tuple:
    """A box (y_min, y_max, x_min, x_max) cut by conditions on x and y."""
    low = {"y": box[0], "x": box[2]}
    high = {"y": box[1], "x": box[3]}
    for f in filters:
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in low and isinstance(f.value, (int, float)):
            c = f.attribute[0]
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low[c] = max(low[c], float(f.value))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high[c] = min(high[c], float(f.value))
    return low["y"], high["y"], low["x"], high["x"]


class Page(InputPartition):
    def __init__(self, number: int, files: list[str] | None, last: bool):
        super().__init__(number)
        self.number, self.files, self.last = number, files, last


class _Pages(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.layer, self.size = options["path"].rstrip("/"), int(options.get("size", 1000))
        self.box = tuple(map(float, options["box"].split(","))) if "box" in options else WORLD
        self.fields_asked = options.get("fields", "*")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions cut the box; Spark looks at them again, since a service's box takes what touches it."""
        self.box = narrowed(self.box, filters)
        yield from filters

    def partitions(self) -> list[Page]:
        if not remote(self.layer):
            return [Page(n, files, False) for n, files in listed(self.layer, "page")]
        n = count_pages(self.layer, self.box, self.size, read_text) or 1
        return [Page(i, None, i == n - 1) for i in range(n)]

    def read(self, page: Page) -> Iterator[tuple]:
        """Rows of a page. A service's last task goes on until a short page, so features added since the count are met."""
        if page.files is not None:
            got = [x for f in page.files for x in json.loads(read_text(f)).get("features", [])]
            yield from self._rows(got, page.number * self.size)
        elif page.last:
            first = page.number * self.size
            for features in pages(self.layer, self.box, self.size, read_text, first):
                yield from self._rows(features, first)
                first += len(features)
        else:
            yield from self._rows(json.loads(read_text(page_url(self.layer, self.box, page.number * self.size, self.size, self.fields_asked))).get("features", []), page.number * self.size)

    def _rows(self, features: list[dict], first: int) -> Iterator[tuple]:
        for i, f in enumerate(features):
            at = (f.get("geometry") or {}).get("coordinates")
            point = at if isinstance(at, list) and len(at) >= 2 and not isinstance(at[0], list) else None
            if point and not (self.box[0] <= point[1] <= self.box[1] and self.box[2] <= point[0] <= self.box[3]):
                continue
            own = {**(f.get("properties") or {}), "ord": first + i, "coordinates": at, "x": point and point[0], "y": point and point[1]}
            yield tuple(typed(own.get(n), kind) for n, kind in self.fields)


class FeatureService(DataSource):
    """Features of a paged layer: ``ord``, ``x``, ``y`` (of points), ``coordinates`` as JSON, and properties by name."""

    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return "ord long, x double, y double, coordinates string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(schema, self.options)


class _Tiles(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.place, self.least = options["path"], int(options.get("least", 50))

    def partitions(self) -> list[Page]:
        urls = self.place.split()
        if len(urls) == 1 and not remote(urls[0]):
            return [Page(n, files, False) for n, files in listed(urls[0].rstrip("/"), "tile")]
        return [Page(i, [u], False) for i, u in enumerate(urls)]

    def read(self, tile: Page) -> Iterator[tuple]:
        line = 0
        for f in tile.files:
            body = read_text(f)
            for row in csv.DictReader(body.splitlines()) if len(body) > self.least else []:
                own = {**row, "tile": tile.number, "line": line}
                yield tuple(typed(own.get(n), kind) for n, kind in self.fields)
                line += 1


class TiledCsv(DataSource):
    """CSV answers of box queries: ``tile``, ``line``, and columns by the names of the header."""

    @classmethod
    def name(cls) -> str:
        return "tiled_csv"

    def schema(self) -> str:
        return "tile int, line long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Tiles(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with conditions handed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FeatureService, TiledCsv):
        spark.dataSource.register(source)


def save_pages(features: DataFrame, path: str, size: int, order: str, ws: Workspace) -> None:
    """Save a layer as pages of ``size`` features, as its service would answer them; ``value`` is a feature's JSON."""
    rows = ordinal(features, [F.col(order)], ws, "_n").withColumn("page", F.floor(F.col("_n") / size).cast("long"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]), ",")  # of a page
    pages_ = rows.groupBy("page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("value"))
    pages_.write.mode("overwrite").partitionBy("page").text(path)


def first_of_tiles(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of overlapping tiles, each key once: the first tile's first row."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct("tile", "line")).alias("_r"))
    return first.select("_r.*").drop("tile", "line")
