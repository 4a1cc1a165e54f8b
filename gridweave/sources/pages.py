"""Paged feature services and box queries as Spark data sources.

Each page, or box, is a partition that an executor fetches by itself. Fetching is a function
that users may give, so that tests and closed networks read saved pages.
"""

from __future__ import annotations

import itertools
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.workspace import ship


def http_text(url: str, timeout: float = 60.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode()


def page_url(layer: str, box: tuple[float, float, float, float], offset: int, size: int, fields: str = "*") -> str:
    """Query of features in (lat_min, lat_max, lon_min, lon_max), one page of them."""
    a, b, c, d = box
    query = {"where": "1=1", "geometry": f"{c},{a},{d},{b}", "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects", "outFields": fields, "outSR": "4326", "f": "geojson", "resultOffset": offset, "resultRecordCount": size}
    return f"{layer}/query?{urllib.parse.urlencode(query)}"


def count_pages(layer: str, box, size: int, fetch: Callable[[str], str]) -> int | None:
    """Pages of a layer by the service's own count of features in the box; None where it doesn't count."""
    try:
        n = json.loads(fetch(page_url(layer, box, 0, size) + "&returnCountOnly=true")).get("count")
    except (OSError, ValueError):
        return None
    return None if n is None else max(1, -(-int(n) // size))


def pages(layer: str, box, size: int = 1000, fetch: Callable[[str], str] = http_text, offset: int = 0) -> Iterator[list[dict]]:
    """Pages of features from ``offset`` on until one is short or empty."""
    while True:
        got = json.loads(fetch(page_url(layer, box, offset, size))).get("features", [])
        if got:
            yield got
        if len(got) < size:
            return
        offset += size


def feature_layer(spark: SparkSession, layer: str, box, properties: str, size: int = 1000, fetch: Callable[[str], str] = http_text, n_pages: int | None = None) -> DataFrame:
    """Rows of a layer: ord, properties by schema, x and y.

    Each page is fetched by a task of its own; their number, unless given, comes from the service's
    count. The last task goes on from its page until a short one, so features added since the count, and
    all pages of a service that doesn't count, are followed there.
    """
    ship(spark)
    n_pages = n_pages or count_pages(layer, box, size, fetch) or 1
    schema = f"properties struct<{properties}>, geometry struct<type:string,coordinates:string>"
    starts = spark.range(0, n_pages, 1, n_pages)

    def run(rows):
        for pdf in rows:
            for start in pdf["id"]:
                got = pages(layer, box, size, fetch, int(start) * size)
                if start < n_pages - 1:
                    got = itertools.islice(got, 1)
                for k, page in enumerate(got):
                    yield _frame((int(start) + k) * size, page)

    raw = starts.mapInPandas(run, "ord long, feature string").select("ord", F.from_json("feature", schema).alias("f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    return raw.select("ord", "f.properties.*", F.get(at, 0).alias("x"), F.get(at, 1).alias("y"))


def _frame(first: int, page: list[dict]):
    import pandas as pd

    return pd.DataFrame({"ord": range(first, first + len(page)), "feature": [json.dumps(x) for x in page]})


def feature_layers(spark: SparkSession, layers: list[str], box, properties: str, **options) -> DataFrame | None:
    """Union of the layers that answer; those that fail are left out, and none at all gives None."""
    found = []
    for n, layer in enumerate(layers):
        try:
            df = feature_layer(spark, layer, box, properties, **options).withColumn("layer", F.lit(n))
            if not df.isEmpty():
                found.append(df)
        except Exception as e:  # a layer that is down isn't the others' matter
            print(f"layer {layer} left out: {str(e).splitlines()[0]}")
    out = None
    for df in found:
        out = df if out is None else out.unionByName(df)
    return out


def overpass_query(box, tags: dict[str, list[str]], timeout: int = 60) -> str:
    """Nodes and ways with any of the tag values in (lat_min, lat_max, lon_min, lon_max), with centres."""
    a, b, c, d = box
    parts = "".join(f'{kind}["{k}"="{v}"]({a},{c},{b},{d});' for k, vs in tags.items() for v in vs for kind in ("node", "way"))
    return f"[out:json][timeout:{timeout}];({parts});out center;"


def tiled_csv(spark: SparkSession, urls: list[str], schema: str, key: list[str], fetch: Callable[[str], str] = http_text, least: int = 50) -> DataFrame:
    """CSV answers of overlapping boxes, one a task, each key once: the first box's row."""
    ship(spark)
    boxes = spark.createDataFrame(list(enumerate(urls)), "box int, url string").repartition(max(len(urls), 1))

    def run(rows):
        import pandas as pd

        for pdf in rows:
            for box, url in zip(pdf["box"], pdf["url"], strict=True):
                body = fetch(url)
                lines = body.splitlines()[1:] if len(body) > least else []
                yield pd.DataFrame({"box": [box] * len(lines), "line": range(len(lines)), "value": lines})

    raw = boxes.mapInPandas(run, "box int, line long, value string").select("box", "line", F.from_csv("value", schema).alias("r"))
    first = raw.groupBy(*[F.col(f"r.{k}") for k in key]).agg(F.min(F.struct("box", "line", "r")).alias("x"))
    return first.select("x.r.*")


def download(url: str, path: str, chunk: int = 8192, timeout: float = 600.0) -> int:
    """Save a large file to a path that Spark reads later, by chunks; the bytes written."""
    n = 0
    with urllib.request.urlopen(url, timeout=timeout) as r, open(path, "wb") as f:
        while data := r.read(chunk):
            n += f.write(data)
    return n
