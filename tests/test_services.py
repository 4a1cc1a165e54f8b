"""Data sources of pages and tiles, and the writer of one document."""

import json
import os

from pyspark.sql import functions as F

from gridweave.sources import files, services, sinks
from gridweave.sources.documents import write_document
from gridweave.workspace import Workspace


def _saved(spark, folder, n=10, size=3):
    ws = Workspace(spark)
    df = spark.createDataFrame([(i, f"s{i}", float(i), float(-i), None if i % 2 else i) for i in range(n)], "i long, NAME string, lon double, lat double, n int")
    services.save_pages(df.select("i", sinks.features_text(df).alias("value")), folder, size, "i", ws)
    services.register(spark)


def test_a_page_is_a_partition_and_conditions_cut_the_box(spark, tmp_path):
    folder = str(tmp_path / "layer")
    _saved(spark, folder)
    df = spark.read.format("feature_service").schema("ord long, NAME string, n int, x double, y double, coordinates string, other double").option("size", 3).load(folder)
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r.ord, r.NAME, r.n, r.x, r.y, json.loads(r.coordinates), r.other) for r in df.collect()) == [(i, f"s{i}", None if i % 2 else i, float(i), float(-i), [i, -i], None) for i in range(10)]
    some = df.where("x >= 2 and x <= 5 and y < -3")
    assert sorted(r.ord for r in some.collect()) == [4, 5]
    assert services.narrowed(services.WORLD, [services.GreaterThan(("x",), 2), services.LessThanOrEqual(("y",), -3.5), services.EqualTo(("NAME",), 1)]) == (-90.0, -3.5, 2.0, 180.0)


def test_a_lost_task_fetches_its_page_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "layer")
    _saved(spark, folder)
    reader = services.FeatureService({"path": folder, "size": "3"}).reader(files.T.StructType.fromDDL("ord long, NAME string"))
    asked = []
    own = services.read_text
    monkeypatch.setattr(services, "read_text", lambda f: asked.append(f) or own(f))
    page = reader.partitions()[2]
    assert list(reader.read(page)) == list(reader.read(page)) == [(6, "s6"), (7, "s7"), (8, "s8")]
    assert len(set(asked)) == 1 and "page=2" in asked[0]


def test_pages_of_a_service(monkeypatch):
    """A counted service: a partition a page, the last one goes on to what came since."""
    from tests.test_sources import _service

    fetch = _service(10, count=7)
    monkeypatch.setattr(services, "read_text", fetch)
    reader = services.FeatureService({"path": "http://x/0", "size": "3"}).reader(files.T.StructType.fromDDL("ord long, NAME string"))
    got = [list(reader.read(p)) for p in reader.partitions()]
    assert [len(g) for g in got] == [3, 3, 4]
    assert sorted(x for g in got for x in g) == [(i, f"s{i}") for i in range(10)]


def test_tiles_as_partitions(spark, tmp_path):
    for tile, rows in ((0, range(8)), (1, range(5, 12))):
        os.makedirs(tmp_path / f"t/tile={tile}")
        (tmp_path / f"t/tile={tile}/a.csv").write_text("cell,v,name\n" + "".join(f"{i},{i}.{tile},some name {i}\n" for i in rows))
    os.makedirs(tmp_path / "t/tile=2")
    (tmp_path / "t/tile=2/a.csv").write_text("none")
    services.register(spark)
    rows = spark.read.format("tiled_csv").schema("tile int, line long, cell int, v double").load(str(tmp_path / "t"))
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, services.first_of_tiles(rows, ["cell"]).collect())) == [(i, float(f"{i}.{0 if i < 8 else 1}")) for i in range(12)]


def test_one_document_from_many_tasks(spark, tmp_path):
    rows = spark.range(1000).repartition(7).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("value"))
    for n in (1000, 0, 1000):
        write_document(rows.where(F.col("id") < n), [F.desc("id")], str(tmp_path / "d"), "whole.txt", "<", ",", ">")
        want = "<" + ",".join(f"é{i}" for i in range(n - 1, -1, -1) if i % 10 != 3) + ">"
        assert (tmp_path / "d/whole.txt").read_text() == want
        assert os.listdir(tmp_path / "d") == ["whole.txt"]


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    rows = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    try:
        write_document(rows, None, str(tmp_path / "d"), "whole.txt")
        raise AssertionError
    except Exception as e:
        assert "no" in str(e)
    assert not os.path.exists(tmp_path / "d") or os.listdir(tmp_path / "d") == []
