"""Row-wise and set operations of the cleaning steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.geo import in_box, widened


def box_filter(df: DataFrame, box: Sequence[float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(in_box(lat, lon, box))


def box_or_wider(df: DataFrame, box: Sequence[float], by: float = 0.01, **names) -> DataFrame:
    """Rows in the box; where there are none, those in the box widened on all sides."""
    strict = box_filter(df, box, **names)
    return box_filter(df, widened(box, by), **names) if strict.isEmpty() else strict


def external_flag(df: DataFrame, box: Sequence[float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``external``: not in the box; null coordinates are external."""
    return df.withColumn("external", ~F.coalesce(in_box(lat, lon, box), F.lit(False)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns aligned by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_present(frames: list[DataFrame | None]) -> DataFrame | None:
    """As ``union_all``, of the frames that are there and hold rows."""
    own = [f for f in frames if f is not None and not f.isEmpty()]
    return union_all(own) if own else None


def first_column(df: DataFrame, names: list[str], default=None) -> Column:
    """The first of these columns that the frame has, else a constant."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def only_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def render_ready(df: DataFrame) -> DataFrame:
    """Without timestamp columns, and with nested ones as JSON text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            continue
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        out.append(F.to_json(f.name).alias(f.name) if nested else F.col(f.name))
    return df.select(*out)


def profile(df: DataFrame) -> dict:
    """Columns and number of rows."""
    return {"columns": df.columns, "rows": df.count()}


def both_ways(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Every edge and its reverse, the reverse right after it: ``way`` is 0 or 1."""
    rest = [c for c in edges.columns if c not in (u, v)]
    ways = F.array(F.struct(F.col(u).alias(u), F.col(v).alias(v), F.lit(0).alias("way")), F.struct(F.col(v).alias(u), F.col(u).alias(v), F.lit(1).alias("way")))
    return edges.select(F.explode(ways).alias("_w"), *rest).select("_w.*", *rest)
