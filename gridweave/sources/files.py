"""Readers of files: GeoJSON, CSV, depth vectors, Overpass JSON and graph documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.operators.ordering import if_few, ordinal
from gridweave.workspace import Workspace

#: Columns of a cell-tower export, in order.
TOWER_COLUMNS = "radio string, mcc int, net int, area int, cell long, unit int, lon double, lat double, range int, samples int, changeable int, created long, updated long, average_signal int"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_or_empty(spark: SparkSession, path: str, schema: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What ``read`` gives, or an empty frame of ``schema`` where there is no such file."""
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


#: How a document starts whose features begin on lines of their own.
COLLECTION = '{"type":"FeatureCollection","features":['


def _head(spark: SparkSession, path: str, stop: bytes) -> bytes | None:
    """The beginning of the one file in a path until ``stop`` or 64 KB; None where there are several files, or none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in (fs.globStatus(p) or []) if f.isFile()] + [f.getPath() for d in (fs.globStatus(p) or []) if d.isDirectory() for f in fs.listStatus(d.getPath()) if not f.getPath().getName().startswith(("_", "."))]
    if len(found) != 1:
        return None
    from gridweave.sources.stores import store

    try:
        files, own = store(str(found[0].toUri()))
        with files.open_input_stream(own) as f:
            head = b""
            while len(head) < 1 << 16 and stop not in head and (block := f.read(1 << 12)):
                head += block
    except (ValueError, OSError):  # a store that Spark alone can open
        return None
    return head


def _features_by_lines(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """(ord, f) of a document as ``write_feature_collection`` writes it, read by many tasks; None where any line isn't whole features."""
    if not (_head(spark, path, COLLECTION.encode()) or b"").startswith(COLLECTION.encode()):
        return None
    place = [F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    text = F.regexp_replace(F.regexp_replace(F.trim("value"), f"^\\Q{COLLECTION}\\E", ""), "(,|\\]\\})$", "")
    lines = spark.read.text(path).select(text.alias("value"), *place).where("value <> ''")
    if not lines.where(~(F.startswith("value", F.lit('{"type":"Feature"')) & F.endswith("value", F.lit("}")))).isEmpty():
        return None
    rows = lines.select("_start", "_row", F.posexplode(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), kind)).alias("_pos", "f"))
    return ordinal(rows, [F.col("_start"), F.col("_row"), F.col("_pos")], Workspace(spark)).select(F.col("ord").cast("int").alias("ord"), "f")


def geojson(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """One row a feature: ``ord`` (place in the file), its properties, and ``coordinates``.

    With a schema of properties nothing is inferred. Points also get ``x`` and ``y``.
    """
    rows = None
    if properties:
        kind = f"array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
        rows = _features_by_lines(spark, path, kind)
        raw = spark.read.schema(T.StructType.fromDDL(f"features {kind}")).option("multiLine", True).json(path)
    else:
        raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("features").alias("ord", "f")) if rows is None else rows
    own = [f.name for f in rows.schema["f"].dataType["properties"].dataType.fields]
    out = rows.select("ord", *[F.col(f"f.properties.`{c}`").alias(c) for c in own], F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    if isinstance(out.schema["coordinates"].dataType, T.StringType):
        lone = F.from_json("coordinates", "array<double>")
        return out.withColumns({"x": F.when(F.col("geometry_type") == "Point", F.get(lone, 0)), "y": F.when(F.col("geometry_type") == "Point", F.get(lone, 1))})
    if out.schema["coordinates"].dataType == T.ArrayType(T.DoubleType()):
        return out.withColumns({"x": F.get("coordinates", 0), "y": F.get("coordinates", 1)})
    return out


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; the schema's names take the place of the header's."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).option("enforceSchema", True).csv(path) if schema else reader.csv(path)


def towers(spark: SparkSession, path: str) -> DataFrame:
    """A cell-tower export, gzipped or not, whose header is replaced."""
    return csv(spark, path, TOWER_COLUMNS)


def depth_vector(spark: SparkSession, path: str, name: str = "depth") -> DataFrame:
    """(division, depth) of the first row of a CSV file without a header."""
    row = spark.read.option("header", False).csv(path).limit(1)
    return row.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in row.columns])).alias("division", name))


def text_csv(spark: SparkSession, body: str, schema: str, least: int = 50) -> DataFrame:
    """Rows of a response's CSV text with a header; a body of ``least`` characters or fewer has none."""
    if len(body) <= least:
        return spark.createDataFrame([], schema)
    lines = spark.createDataFrame([(x,) for x in body.splitlines()[1:]], "value string")
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """(ord, lat, lon, tags) of an Overpass answer; the centre stands in for a missing place."""
    schema = "elements array<struct<lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("elements").alias("ord", "e"))
    place = lambda c: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit(0.0)), F.col(f"e.center.{c}")).alias(c)
    return e.select("ord", place("lat"), place("lon"), "e.tags")


def division_bounds(spark: SparkSession, rows: list[tuple], expected: int = 18) -> DataFrame:
    """(division, left, bottom, right, top) of raster bounds in the order of their names.

    ``rows`` are (name, left, bottom, right, top); any other number of them is an error.
    """
    if len(rows) != expected:
        raise ValueError(f"{len(rows)} divisions instead of {expected}")
    return spark.createDataFrame([(i, *map(float, r[1:])) for i, r in enumerate(sorted(rows))], "division int, left double, bottom double, right double, top double")


def _graph_part(spark: SparkSession, path: str, tag: str, ids: list[str]) -> DataFrame:
    """Nodes or edges of a graph document, its declared keys as typed columns."""
    head = _head(spark, path, b"<graph ") or b""
    if b"<graph " in head:  # keys come first, so the rest isn't read for them
        from xml.etree import ElementTree

        top = ElementTree.fromstring(head[: head.index(b"<graph ")] + b"</graphml>")
        keys = [(k.get("id"), k.get("attr.name"), k.get("attr.type")) for k in top if k.tag.rsplit("}", 1)[-1] == "key" and k.get("for") == tag]
    else:
        keys = spark.read.format("xml").option("rowTag", "key").load(path)
        keys = [(r["_id"], r["_attr.name"], r["_attr.type"]) for r in keys.select("_id", F.col("`_attr.name`"), F.col("`_attr.type`"), "_for").where(F.col("_for") == tag).collect()]
    data = "data array<struct<_VALUE:string,_key:string>>"
    schema = T.StructType.fromDDL(", ".join(f"`_{i}` string" for i in ids) + f", {data}")
    kinds = {"string": "string", "long": "long", "int": "long", "double": "double", "float": "double", "boolean": "boolean"}
    typed = lambda value, kind: value.try_cast(kinds.get(kind, "string"))
    found = lambda k: F.try_element_at("m", F.lit(k))
    mapped = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    if tag == "edge":
        rows = _edge_texts(spark, path)
        plain = F.col("_plain")
        # an edge as this library writes it is taken apart as text; parsers take some ten times longer
        rows = rows.withColumn("_plain", _plain_edge("_text", ids, [k for k, _, _ in keys])).withColumn("_x", F.when(~F.col("_plain"), F.from_xml("_text", schema)))
        rows = rows.select("*", F.col("_x.data").alias("data")).withColumn("m", F.when(~plain, mapped))
        own = [F.when(plain, _between(f'{i}="', '"')).otherwise(F.col(f"_x._{i}")).alias(f"_{i}") for i in ids]
        rows = rows.select("_file", "_start", *own, *[typed(F.when(plain, _between(f'<data key="{k}">', "<")).otherwise(found(k)), kind).alias(f"_at_{i}") for i, (k, _, kind) in enumerate(keys)])
    else:
        rows = spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)
        rows = rows.select("*", *place).withColumn("m", mapped)
        rows = rows.select("_file", "_start", *[f"_{i}" for i in ids], *[typed(found(k), kind).alias(f"_at_{i}") for i, (k, _, kind) in enumerate(keys)])
    rows = _numbered_as_read(rows, Workspace(spark))
    return rows.select("ord", *[F.col(f"_{i}") for i in ids], *[F.col(f"_at_{i}").alias(name) for i, (_, name, _) in enumerate(keys)])


def _between(start: str, end: str) -> Column:
    """What stands in an edge's text between two texts, the first of which is there once; null where it isn't."""
    return F.when(F.contains("_text", F.lit(start)), F.substring_index(F.substring_index("_text", start, -1), end, 1))


def _plain_edge(text: str, ids: list[str], keys: list[str]) -> Column:
    """Whether an edge has just its ends and known data, each once and in order, with nothing that XML would change."""
    value = r"(?! )[^\"<>&\t\n\x0B\f\r]++(?<! )"
    names = "".join(f' {i}="{value}"' for i in ids)
    return F.col(text).rlike(f"^<edge{names}>" + "".join(f'(?:<data key="\\Q{k}\\E">{value}</data>)?+' for k in keys) + "</edge>$")


#: How a line of a graph document begins that has no edge.
_OTHER_LINES = ("<?xml ", "<graphml ", "<key ", "<graph ", "<node ", "</graph>", "</graphml>")


def _edge_texts(spark: SparkSession, path: str) -> DataFrame:
    """(_text, _file, _start): the edges of a graph document as they stand there, in their order, read by many tasks."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias("_text"), *place).where("_text <> ''")
    edge = F.startswith("_text", F.lit("<edge ")) & (F.endswith("_text", F.lit("</edge>")) | F.endswith("_text", F.lit("/>"))) & (F.instr(F.substring("_text", 2, 1 << 30), F.lit("<edge")) == 0)
    other = F.lit(False)
    for x in _OTHER_LINES:
        other = other | F.startswith("_text", F.lit(x))
    other = other & F.endswith("_text", F.lit(">")) & (F.instr("_text", F.lit("<edge")) == 0) & (F.instr("_text", F.lit("<!")) == 0)
    if lines.where(~(edge | other)).isEmpty():  # each line is whole, as this library writes them; all before the edges would be one text else
        return lines.where(F.startswith("_text", F.lit("<edge ")))
    # edges are last: from one's beginning to the next's is one, and files are split there
    text = spark.read.option("lineSep", "<edge").text(path).select("value", *place).where(F.col("value").rlike("^\\s+[^<\\s]"))
    end, lone = F.instr("value", F.lit("</edge>")), F.instr("value", F.lit("/>"))
    whole = F.concat(F.lit("<edge"), F.when(end > 0, F.substring("value", F.lit(1), end + 6)).otherwise(F.substring("value", F.lit(1), lone + 1)))
    return text.where((end > 0) | (lone > 0)).select(whole.alias("_text"), "_file", "_start")


def _numbered_as_read(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Rows of files with ``ord``: 0, 1, 2, ... in the order of files, their blocks (_file, _start) and of rows in a block.

    A block's rows are read by one task in their order, so they are counted where they lie, and neither dealt nor sorted.
    """
    saved = ws.save(rows.withColumn("_row", F.monotonically_increasing_id()))
    blocks = saved.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = ws.save(blocks.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    return saved.join(if_few(shift), ["_file", "_start"]).withColumn("ord", F.col("_row") + F.col("_shift")).drop("_file", "_start", "_row", "_shift")


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, node_id, attributes) in document order."""
    return _graph_part(spark, path, "node", ["id"]).withColumnRenamed("_id", "node_id")


def graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """(ord, u, v, attributes) in document order."""
    return _graph_part(spark, path, "edge", ["source", "target"]).withColumnsRenamed({"_source": "u", "_target": "v"})
