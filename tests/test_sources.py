import gzip
import json
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from gridweave.plans import flood, present
from gridweave.sources import files, pages, sinks


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2.5, None), ("b", 3.0, 4.0, 7)], "name string, lon double, lat double, n int")
    sinks.write_feature_collection(df, str(tmp_path / "one"), order="name")
    got = files.geojson(spark, str(tmp_path / "one"), "name string, n int").orderBy("ord").collect()
    assert [(r.ord, r.name, r.n, r.x, r.y) for r in got] == [(0, "a", None, 1.5, 2.5), (1, "b", 7, 3.0, 4.0)]
    sinks.write_geojson(df, str(tmp_path / "many"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "many")).collect()]
    assert len(lines) == 2 and all(x["type"] == "Feature" for x in lines)


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("n<1>", 0, "A & \"B\"", True, None), ("n2", 1, "C", False, 5)], "node_id string, ord long, name string, external boolean, tower_count long")
    edges = spark.createDataFrame([("n<1>", "n2", 0, 1.25)], "u string, v string, ord long, weight double")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    n = files.graphml_nodes(spark, str(tmp_path / "g")).orderBy("ord").collect()
    assert [(r.node_id, r.name, r.external, r.tower_count) for r in n] == [("n<1>", 'A & "B"', True, None), ("n2", "C", False, 5)]
    e = files.graphml_edges(spark, str(tmp_path / "g")).first()
    assert (e.u, e.v, e.weight) == ("n<1>", "n2", 1.25)


def test_documents_are_read_by_parts(spark, tmp_path):
    """One document was one task's; its features and edges are split now, wherever a part ends."""
    rows = spark.range(200).selectExpr("id as n", "concat('a ]}, ', id) as name", "cast(id as double) as lon", "2.0D as lat")
    sinks.write_feature_collection(rows, str(tmp_path / "one"), order="n")
    foreign = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": None}]}, separators=(",", ":")).replace(',"properties"', ',\n"properties"')
    (tmp_path / "other.json").write_text(foreign)
    edges = "".join(f'<edge source="a{i}" target="b"/>' if i % 3 else f'<edge\n source="a{i}" target="b">\n <data key="d0">{i}.5</data>\n</edge>\n' for i in range(200))
    (tmp_path / "g.graphml").write_text(f'\n<graphml xmlns="x"><key id="d0" for="edge" attr.name="w" attr.type="double"/><graph edgedefault="directed"><node id="b"/>{edges}</graph></graphml>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        kind = "array<struct<properties:struct<n:long,name:string>,geometry:struct<type:string,coordinates:string>>>"
        assert files._features_by_lines(spark, str(tmp_path / "one"), kind) is not None
        assert files._features_by_lines(spark, str(tmp_path / "other.json"), kind) is None
        got = files.geojson(spark, str(tmp_path / "one"), "n long, name string").orderBy("ord").collect()
        assert [(r.ord, r.n, r.name, r.x) for r in got] == [(i, i, f"a ]}}, {i}", float(i)) for i in range(200)]
        assert [r.n for r in files.geojson(spark, str(tmp_path / "other.json"), "n long").collect()] == [1]
        e = files.graphml_edges(spark, str(tmp_path / "g.graphml")).orderBy("ord").collect()
        assert [(r.ord, r.u, r.v, r.w) for r in e] == [(i, f"a{i}", "b", None if i % 3 else i + 0.5) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_readers(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("any,names,here,x,y,z,lon,lat,r,s,c,cr,up,av\nLTE,310,260,1,2,3,-74.0,40.7,100,5,1,10,20,0\n")
    r = files.towers(spark, str(tmp_path / "t.csv.gz")).first()
    assert (r.radio, r.mcc, r.net, r.lat) == ("LTE", 310, 260, 40.7)
    (tmp_path / "d.csv").write_text("0.5,1.25,0\n9,9,9\n")
    assert [(r.division, r.depth) for r in files.depth_vector(spark, str(tmp_path / "d.csv")).collect()] == [(0, 0.5), (1, 1.25), (2, 0.0)]
    assert files.text_csv(spark, "short", "a int").count() == 0
    assert files.text_csv(spark, "a,b\n" + "1,2\n" * 30, "a int, b int").count() == 30
    sinks.write_csv(spark.createDataFrame([(1, "g")], "a int, geometry string"), str(tmp_path / "w"))
    assert files.csv(spark, str(tmp_path / "w")).columns == ["a"]


def test_guards(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int", files.csv).count() == 0
    (tmp_path / "b.csv").write_text("a\n1\n")
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "b.csv")]) == str(tmp_path / "b.csv")
    with pytest.raises(ValueError):
        files.division_bounds(spark, [("a", 0, 0, 1, 1)])
    assert files.division_bounds(spark, [("b", 0, 0, 1, 1), ("a", 5, 0, 6, 1)], 2).where("division = 0").first().left == 5.0


def test_overpass(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "x"}}, {"center": {"lat": 3.0, "lon": 4.0}}]}))
    assert [(r.ord, r.lat, r.lon) for r in files.overpass(spark, str(tmp_path / "o.json")).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    assert pages.overpass_query((1, 2, 3, 4), {"amenity": ["fuel"]}).count("(1,3,2,4)") == 2


def _service(n, count=None):
    def fetch(url):
        q = parse_qs(urlparse(url).query)
        if count is not None and "returnCountOnly" in q:
            return json.dumps({"count": count})
        at, size = int(q["resultOffset"][0]), int(q["resultRecordCount"][0])
        own = [{"type": "Feature", "properties": {"NAME": f"s{i}"}, "geometry": {"type": "Point", "coordinates": [i, -i]}} for i in range(at, min(n, at + size))]
        return json.dumps({"features": own})

    return fetch


@pytest.mark.parametrize(("n_pages", "count", "tasks"), [(None, None, 1), (4, None, 4), (None, 10, 4), (None, 5, 2), (None, 20, 7), (None, 0, 1)])
def test_pages(spark, n_pages, count, tasks):
    # a count may be missing, right, or passed by what the service holds meanwhile
    df = pages.feature_layer(spark, "http://x/0", (0, 1, 0, 1), "NAME string", 3, _service(10, count), n_pages)
    assert df.rdd.getNumPartitions() == tasks
    assert sorted((r.ord, r.NAME, r.x, r.y) for r in df.collect()) == [(i, f"s{i}", float(i), float(-i)) for i in range(10)]


def test_layers_that_fail_are_left_out(spark):
    def fetch(url):
        if "/1/" in url:
            raise OSError("down")
        return _service(2)(url)

    got = pages.feature_layers(spark, ["http://x/1", "http://x/2"], (0, 1, 0, 1), "NAME string", size=5, fetch=fetch)
    assert got.count() == 2


def test_tiles_keep_the_first(spark):
    body = "h\n" + "".join(f"{i},{i}.5\n" for i in range(20))
    got = pages.tiled_csv(spark, ["a", "b"], "cell int, v double", ["cell"], lambda url: body)
    assert got.count() == 20


def test_overlay_and_layers(spark, tmp_path):
    nodes = spark.createDataFrame([("p", "power", "P", 40.70, -74.0, False), ("h", "hospital", "H", 40.71, -74.0, False), ("o", "odd", "O", 40.80, -73.0, True)], "node_id string, infra_type string, name string, lat double, lon double, external boolean")
    from gridweave.functions.geo import state_plane_feet

    x, y = state_plane_feet(F.lit(40.70), F.lit(-74.0))
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    div = spark.createDataFrame([(0, at.x - 100, at.y - 100, at.x + 100, at.y + 100)], "division int, left double, bottom double, right double, top double")
    wet = flood.overlay(nodes, div, spark.createDataFrame([(0, 1.5, 3.48)], "division int, cold double, warm double"))
    assert {r.node_id: (r.division, r.depth_m, r.inundated) for r in wet.collect()} == {"p": (0, 1.5, True), "h": (-1, 0.0, False), "o": (-1, 0.0, False)}
    edges = spark.createDataFrame([("p", "h", "power_dependency", 96.0, 1200, None), ("p", "o", "repair_access", 0.0, None, "recovery")], "u string, v string, edge_type string, buffer_hours double, distance_m long, layer string")
    assert {r.node_id: r.colour for r in present.node_layer(wet, edges).collect()} == {"p": "#E6A817", "h": "#D62728", "o": "#888888"}
    layer = {r.v: (r.z, r.popup) for r in present.edge_layer(edges, nodes).collect()}
    assert layer["o"][0] == 0 and layer["h"] == (1, "<b>Power Dependency</b><br>p to h<br><b>Distance (m):</b> 1200<br><b>Buffer (h):</b> 96.0")
    assert present.depth_circles(wet).count() == 1
    assert sinks.write_tensors(spark.createDataFrame([("power", 0)], "infra_type string, idx int"), spark.createDataFrame([("a", "r", "b", 1)], "src_type string, relation string, dst_type string, i int"), str(tmp_path / "t")) == {"nodes": 1, "edges": 1}


def test_edges_on_whole_lines_are_read_as_text(spark, tmp_path, monkeypatch):
    """Nodes before the first edge were one text of one task, and each edge was parsed twice."""
    odd = ["plain", " spaced ", 'a "b" & <c>', "", "x\ty", "é", None]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(300)], "node_id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{299 - i}", i, i / 4, odd[i % 7]) for i in range(300)], "u string, v string, ord long, weight double, name string")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    texts = files._edge_texts(spark, str(tmp_path / "g"))
    assert texts.where(F.startswith("_text", F.lit("<edge source="))).count() == 300
    assert spark.read.text(str(tmp_path / "g")).count() == 300 * 2 + 6
    plain = texts.where(files._plain_edge("_text", ["source", "target"], ["d0", "d1"])).count()
    assert plain == sum(odd[i % 7] in ("plain", "é", None) for i in range(300))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [tuple(r) for r in files.graphml_edges(spark, str(tmp_path / "g")).orderBy("ord").collect()]
        monkeypatch.setattr(files, "_plain_edge", lambda *_: F.lit(False))
        assert got == [tuple(r) for r in files.graphml_edges(spark, str(tmp_path / "g")).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[:4] for r in got] == [(i, f"n{i}", f"n{299 - i}", i / 4) for i in range(300)]
    assert {r[4] for r in got} >= {"plain", "é", 'a "b" & <c>', None}
    twice = '<graphml xmlns="x">\n<key id="d0" for="edge" attr.name="w" attr.type="double"/>\n<graph edgedefault="directed">\n<!-- <edge source="no" target="no"></edge>\n-->\n<edge source="a" target="b"/><edge source="b" target="a"/>\n</graph></graphml>'
    (tmp_path / "two.graphml").write_text(twice.replace("<!-- <edge source=\"no\" target=\"no\"></edge>\n-->\n", ""))
    assert [r.u for r in files.graphml_edges(spark, str(tmp_path / "two.graphml")).orderBy("ord").collect()] == ["a", "b"]
