"""Counts, shares and confusion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows of each value, most first, ties by value; nulls don't count."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(k) if k else out


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys)


def conditional_counts(df: DataFrame, by: str | None, **tests: Column) -> DataFrame:
    """Rows that meet each test, in all or by a key."""
    counts = [F.count_if(t).alias(n) for n, t in tests.items()]
    return (df.groupBy(by) if by else df).agg(*counts)


def flood_summary(nodes: DataFrame, kind: str = "infra_type", division: str = "division", depth: str = "depth") -> DataFrame:
    """By kind: nodes, those in a division, those flooded, their share and their mean depth.

    The mean is of flooded nodes only, 0 where there are none; the share is in percent.
    """
    wet = F.col(depth) > 0
    out = nodes.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(division) >= 0).alias("mapped"), F.count_if(wet).alias("flooded"), F.coalesce(F.avg(F.when(wet, F.col(depth))), F.lit(0.0)).alias("avg_depth"))
    return out.withColumn("pct", F.coalesce(F.try_divide(F.col("flooded") * 100.0, F.col("total")), F.lit(0.0)))


def flood_overall(nodes: DataFrame, division: str = "division", depth: str = "depth") -> DataFrame:
    """One row: nodes, mapped, external, flooded, dry, and the flooded share of all and of mapped."""
    mapped, wet = F.col(division) >= 0, F.col(depth) > 0
    n = nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("external"), F.count_if(wet).alias("flooded"), F.count_if(mapped & ~wet).alias("dry"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    return n.withColumns({"pct_flooded": share("flooded", "total"), "pct_of_mapped": share("flooded", "mapped")})


def depth_range(divisions: DataFrame, depth: str = "depth", order: str = "division") -> DataFrame:
    """Least and largest depth, flooded divisions, and all depths in order to two decimals."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, depth))), lambda x: F.round(x[depth], 2))
    return divisions.agg(F.min(depth).alias("min_depth"), F.max(depth).alias("max_depth"), F.count_if(F.col(depth) > 0).alias("flooded_divisions"), listed.alias("depths"))


def confusion(df: DataFrame, predicted: Column, observed: Column, by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, recall, precision and accuracy; a ratio without a base is 0."""
    p, o = F.coalesce(predicted, F.lit(False)), F.coalesce(observed, F.lit(False))
    n = conditional_counts(df, by, tp=p & o, fp=p & ~o, fn=~p & o, tn=~p & ~o)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def agreement(df: DataFrame, by: str, predicted: Column, observed: Column) -> DataFrame:
    """By key: rows predicted, observed, both, and only one of the two."""
    p, o = F.coalesce(predicted, F.lit(False)), F.coalesce(observed, F.lit(False))
    return conditional_counts(df, by, predicted=p, observed=o, both=p & o, only_predicted=p & ~o, only_observed=~p & o)


def first_of_each(df: DataFrame, key: str, order: list) -> DataFrame:
    """One representative row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def min_max(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Columns scaled to 0..1 within each key, raw ones kept as ``raw_*``; constant ones become 0."""
    over = Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))
    if by is None:
        ends = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
        out = df.crossJoin(F.broadcast(ends))
    else:
        out = df.withColumns({f"_{k}_{c}": f(c).over(over) for c in columns for k, f in (("lo", F.min), ("hi", F.max))})
    for c in columns:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"raw_{c}", F.col(c)).withColumn(c, ((F.col(c) - F.col(f"_lo_{c}")) / F.when(width == 0, F.lit(1.0)).otherwise(width)))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi")])
