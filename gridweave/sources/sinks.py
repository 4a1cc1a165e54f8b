"""Writers: GeoJSON, CSV, graph documents, tensors and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridweave.sources.documents import write_document

KINDS = {"bigint": "long", "int": "long", "double": "double", "float": "double", "boolean": "boolean"}


def features_text(df: DataFrame, x: str = "lon", y: str = "lat", coordinates: str | None = None, geometry: str = "Point") -> Column:
    """A row's GeoJSON feature as text, null properties left out."""
    place = F.col(coordinates) if coordinates else F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    own = [c for c in df.columns if c != coordinates]
    shape = F.struct(F.lit(geometry).alias("type"), place.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*own).alias("properties"), shape.alias("geometry")))


def features(df: DataFrame, **shape) -> DataFrame:
    """One JSON text a row: a GeoJSON feature, null properties left out."""
    return df.select(features_text(df, **shape).alias("value"))


def write_geojson(df: DataFrame, path: str, **shape) -> None:
    """Features as lines of JSON, in parallel."""
    features(df, **shape).write.mode("overwrite").text(path)


def write_feature_collection(df: DataFrame, path: str, order: str | None = None, **shape) -> None:
    """One document of any size, features by ``order``, written by parts that are joined when all are done."""
    texts = features(df, **shape)
    rows = texts if order is None else df.select(F.col(order).alias("_order"), features_text(df, **shape).alias("value"))
    write_document(rows, [F.col("_order")] if order else None, path, "document.json", '{"type":"FeatureCollection","features":[', ",\n", "]}")


def write_csv(df: DataFrame, path: str, drop: list[str] | None = None) -> None:
    df.drop(*(drop or ["geometry", "coordinates"])).write.mode("overwrite").option("header", True).csv(path)


def graphml_lines(nodes: DataFrame, edges: DataFrame, node_id: str = "node_id") -> tuple[list[str], DataFrame]:
    """The lines that begin a graph document, and (value): those of its nodes and edges, dealt to tasks in their order.

    Null attributes are left out. Rows are dealt and sorted as they are, by ``ord`` and then by all columns, and become
    texts where they lie, so what is sent and sorted is less than the document.
    """
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keys, at = [], {}
    for kind, df, own in (("node", nodes, {node_id, "ord"}), ("edge", edges, {"u", "v", "ord"})):
        for name, dtype in df.dtypes:
            if name not in own:
                at[kind, name] = f"d{len(keys)}"
                keys.append(f'<key id="d{len(keys)}" for="{kind}" attr.name="{name}" attr.type="{KINDS.get(dtype, "string")}"/>')
    data = lambda kind, df: F.concat_ws("", *[F.concat(F.lit(f'<data key="{at[kind, c]}">'), esc(F.col(c)), F.lit("</data>")) for c in df.columns if (kind, c) in at])

    def dealt(df: DataFrame, first: list[str]) -> DataFrame:
        order = [F.col("ord").cast("string").cast("long")] if "ord" in df.columns else []
        order += [F.col(c) for c in first + [c for c in df.columns if c not in {*first, "ord"}]]
        return df.repartitionByRange(*order).sortWithinPartitions(*order)

    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    n = dealt(nodes, [node_id]).select(F.concat(F.lit('<node id="'), esc(F.col(node_id)), F.lit('">'), data("node", nodes), F.lit("</node>")).alias("value"))
    e = dealt(edges, ["u", "v"]).select(F.concat(F.lit('<edge source="'), esc(F.col("u")), F.lit('" target="'), esc(F.col("v")), F.lit('">'), data("edge", edges), F.lit("</edge>")).alias("value"))
    return head, n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, node_id: str = "node_id") -> None:
    """One document of any size, in node and edge order, written by parts that are joined when all are done."""
    head, lines = graphml_lines(nodes, edges, node_id)
    write_document(lines, None, path, "document.graphml", "\n".join(head) + "\n", foot="\n</graph></graphml>\n")


def _contents(df: DataFrame) -> list[Column]:
    """Rows, and the sum of their hashes, which no order changes."""
    hashed = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).alias("digest")]


def write_tensors(node_vectors: DataFrame, edge_vectors: DataFrame, path: str) -> dict:
    """Vectors by kind and triplet as Parquet: their row counts, once read back and found the same.

    Counts and digests are taken while the rows are written, so the vectors are computed once.
    """
    told = {}
    for name, df, by in (("nodes", node_vectors, ["infra_type"]), ("edges", edge_vectors, ["src_type", "relation", "dst_type"])):
        seen = Observation()
        df.observe(seen, *_contents(df)).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
        told[name] = {"schema": df.schema, **seen.get}
    check_tensors(node_vectors.sparkSession, path, told)
    return {k: v["n"] for k, v in told.items()}


def check_tensors(spark: SparkSession, path: str, told: dict) -> None:
    """Read a bundle back; another count or digest than ``told`` for a part is an error."""
    for name, t in told.items():
        back = spark.read.schema(t["schema"]).parquet(f"{path}/{name}")
        got = back.agg(*_contents(back)).first()
        if (got.n, got.digest) != (t["n"], t["digest"]):
            raise OSError(f"{name}: wrote {t['n']} rows with digest {t['digest']}, read {got.n} with {got.digest}")


def tensor_summary(spark: SparkSession, path: str, node_columns: list[str], edge_columns: list[str]) -> DataFrame:
    """(part, name, rows, width) of a bundle: a row for each kind of nodes and each triplet of edges."""
    out = None
    for part, by, vectors in (("nodes", ["infra_type"], node_columns), ("edges", ["src_type", "relation", "dst_type"], edge_columns)):
        df = spark.read.parquet(f"{path}/{part}")
        widths = [F.coalesce(F.max(F.size(c)), F.lit(0)) for c in vectors]
        one = df.groupBy(F.concat_ws("__", *by).alias("name")).agg(F.count(F.lit(1)).alias("rows"), sum(widths[1:], widths[0]).alias("width")).select(F.lit(part).alias("part"), "name", "rows", "width")
        out = one if out is None else out.unionByName(one)
    return out


def write_lines(spark, lines: list[str], path: str) -> None:
    """A short summary as one text file."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    write_document(rows, [F.col("i")], path, "document.txt", foot="\n")
