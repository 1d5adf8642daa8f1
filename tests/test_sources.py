"""Sources, sinks, state and the registered queries."""

import gzip
import io
import json
import os
import random
import zipfile
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pedshade.plans import fixtures, queries
from pedshade.sources import archives, binary_graph, citygml, files, graph_json, publish
from pedshade.streaming import state

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def graph(spark):
    nodes = spark.createDataFrame([("b", 139.7, 35.6), ("a", 139.71, 35.61)], "node_id string, lon double, lat double")
    line = [{"lon": 139.71, "lat": 35.61}, {"lon": 139.705, "lat": 35.605}, {"lon": 139.7, "lat": 35.6}]
    edges = spark.createDataFrame([("a:b:0", "a", "b", 12.5, 0.25, 0.5, line, 0.125, 0.5, 1.0)], "edge_id string, source string, target string, length double, green_score double, water_penalty double, geometry array<struct<lon: double, lat: double>>, shade_0900 double, shade_1200 double, shade_1500 double")
    return nodes, edges


def test_binary_graph_round_trip(spark, tmp_path):
    nodes, edges = graph(spark)
    for compress in (True, False):
        path = f"{tmp_path}/g{compress}.bin"
        binary_graph.write(nodes, edges, path, compress)
        n, e = binary_graph.read(spark, path)
        assert [(r.node_id, r.lon, r.lat) for r in n.collect()] == [(0, 139.71, 35.61), (1, 139.7, 35.6)]
        r = e.first()
        assert (r.source, r.target, r.length, r.shade_0900, r.shade_1500) == (0, 1, 12.5, 0.125, 1.0) and r.geometry[1].lon == 139.705
    with open(f"{tmp_path}/broken.bin", "wb") as f:
        f.write(b"no graph")
    n, _ = binary_graph.read(spark, f"{tmp_path}/broken.bin", f"{tmp_path}/gFalse.bin")
    assert n.count() == 2


@pytest.mark.parametrize("part_rows", [3, 7, 1 << 16])
def test_binary_graph_in_sections(spark, tmp_path, part_rows):
    """Parts of any size make the file that one writer would make, and ranges of it read the same rows."""
    rnd = random.Random(part_rows)
    n = [(f"n{k:03}", 139 + k / 1000, 35.6 - k / 997) for k in range(20)]
    line = lambda: [(139 + rnd.random(), 35 + rnd.random()) for _ in range(rnd.randint(2, 5))]
    e = [(f"e{k:04}", rnd.choice(n)[0], rnd.choice(n)[0], rnd.random() * 90, rnd.random(), rnd.random(), line(), 0.5, rnd.random(), 1.0) for k in range(50)]
    nodes = spark.createDataFrame(n, "node_id string, lon double, lat double").repartition(3)
    edges = spark.createDataFrame(e, "edge_id string, source string, target string, length double, green_score double, water_penalty double, geometry array<struct<lon: double, lat: double>>, shade_0900 double, shade_1200 double, shade_1500 double").repartition(4)
    path = f"{tmp_path}/in/g.bin"
    assert binary_graph.write(nodes, edges, path, False, part_rows) == os.path.getsize(path)
    number = {name: k for k, (name, *_) in enumerate(n)}
    frame = pd.DataFrame([(number[r[1]], number[r[2]], *r[3:6]) for r in e], columns=["source", "target", "length", "green_score", "water_penalty"])
    whole = binary_graph.encode(pd.DataFrame(n, columns=["node_id", "lon", "lat"]), frame, [np.array(r[6]) for r in e], np.array([r[7:] for r in e]))
    assert open(path, "rb").read() == whole
    packed = f"{tmp_path}/in/g.bin.gz"
    binary_graph.write(nodes, edges, packed, True, part_rows)
    assert gzip.decompress(open(packed, "rb").read()) == whole
    want, got = binary_graph.read(spark, path), binary_graph.read_ranges(spark, path, part_rows)
    for a, b in zip(want, got):
        assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(graph_json.SourceError, match="packed"):
        binary_graph.read_ranges(spark, packed)
    empty = f"{tmp_path}/in/none.bin"
    binary_graph.write(nodes.filter("false"), edges.filter("false"), empty, False)
    assert [df.count() for df in binary_graph.read_ranges(spark, empty)] == [0, 0]


def test_tile_layers(spark, tmp_path):
    line = lambda *at: [(139.7 + x / 1000, 35.6 + y / 1000) for x, y in at]
    rows = [("a", 0.5, line((0, 0), (5, 3), (9, 9))), ("b", None, line((0, 0), (90, 0)))]
    df = spark.createDataFrame(rows, "id string, heat double, geometry array<struct<lon: double, lat: double>>")
    base = f"file://{tmp_path}/tiles"
    publish.write_layers({"heat": (df, ["id", "heat"]), "shade": (df.filter("heat is null"), ["id"])}, base, (139.0, 35.0, 140.0, 36.0), (12,))
    told = json.load(open(f"{tmp_path}/tiles/shade.json"))
    assert told["tiles"] == ["shade/{z}/{x}/{y}.pbf"] and os.path.exists(f"{tmp_path}/tiles/_SUCCESS")
    found = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/tiles/heat") for f in names]
    features = [f for path in found for f in publish.decode_tile(open(path, "rb").read())]
    assert {(name, p["id"], p.get("heat")) for name, _, p in features} == {("heat", "a", 0.5), ("heat", "b", None)}
    assert 1 < len([1 for *_, p in features if p["id"] == "b"]) <= len(found)
    for path in found:  # the flat line crosses its tiles from edge to edge, at one height
        for _, lines, p in publish.decode_tile(open(path, "rb").read()):
            assert all(-publish.TILE_BUFFER <= v <= publish.EXTENT + publish.TILE_BUFFER for drawn in lines for point in drawn for v in point)
            assert p["id"] == "a" or (len(lines) == 1 and len({y for _, y in lines[0]}) == 1)


def test_binary_graph_ranges_share_tasks(spark, tmp_path):
    """Small parts do not make more tasks, and every row is read."""
    k = 5 * spark.sparkContext.defaultParallelism
    nodes = spark.range(k).select(F.col("id").alias("node_id"), (139 + F.col("id") / 1000).alias("lon"), F.lit(35.6).alias("lat"))
    point = F.array(F.struct(F.lit(139.0).alias("lon"), F.lit(35.0).alias("lat")))
    scores = [F.lit(0.5).alias(c) for c in ("length", "green_score", "water_penalty", "shade_0900", "shade_1200", "shade_1500")]
    edges = spark.range(k).select(F.format_string("e%05d", "id").alias("edge_id"), F.col("id").alias("source"), F.col("id").alias("target"), point.alias("geometry"), *scores)
    path = f"{tmp_path}/g.bin"
    binary_graph.write(nodes, edges, path, False, 1)
    n, e = binary_graph.read_ranges(spark, path, 1)
    for df in (n, e):
        assert df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.node_id for r in n.collect()) == sorted(r.source for r in e.collect()) == list(range(k))


def test_binary_graph_refuses_bad_files(spark, tmp_path):
    nodes, edges = graph(spark)
    binary_graph.write(nodes, edges, f"{tmp_path}/g.bin", False)
    raw = open(f"{tmp_path}/g.bin", "rb").read()
    for bad, what in ((raw[:-1], "size"), (b"\0" + raw[1:], "magic"), (raw[:4] + b"\x02" + raw[5:], "version"), (raw[:10], "header")):
        with pytest.raises(graph_json.SourceError, match=what):
            binary_graph.Graph(bad)
    assert binary_graph.Graph(gzip.compress(raw)).edges["length"][0] == 12.5
    with pytest.raises(ValueError, match="no node"):
        binary_graph.write(nodes.filter("node_id = 'a'"), edges, f"{tmp_path}/h.bin")


def test_graph_and_shade_documents(spark, tmp_path):
    nodes, edges = graph(spark)
    publish.publish_files({f"{tmp_path}/graph.json": graph_json.graph_document(nodes, edges).first().document.encode()})
    n, e = graph_json.read_graph(spark, f"{tmp_path}/graph.json")
    assert sorted(tuple(r) for r in n.collect()) == [("a", 139.71, 35.61), ("b", 139.7, 35.6)]
    r = e.first()
    assert (r.edge_id, r.length, r.geometry[0].lat) == ("a:b:0", 12.5, 35.61)
    long = edges.select("edge_id", F.col("shade_0900").alias("09:00"), F.col("shade_1200").alias("12:00"), F.col("shade_1500").alias("15:00")).unpivot("edge_id", ["09:00", "12:00", "15:00"], "scenario", "score")
    publish.publish_files({f"{tmp_path}/shade.json": graph_json.shade_document(long).first().document.encode()})
    assert sorted(tuple(r) for r in graph_json.read_shade(spark, f"{tmp_path}/shade.json").collect()) == sorted(tuple(r) for r in long.collect())
    with open(f"{tmp_path}/bad.json", "w") as f:
        json.dump({"edgeShadeScores": {"a": [0.1]}}, f)
    with pytest.raises(Exception, match="each scenario"):
        graph_json.read_shade(spark, f"{tmp_path}/bad.json").collect()
    with pytest.raises(Exception, match="NaN"):
        graph_json.graph_document(nodes, edges.withColumn("length", F.lit(float("nan")))).collect()


def test_station_sources(spark, tmp_path):
    csv = "施設名,緯度,経度\n駅,35.6,139.7\n空,,139.7\n誤,x,1\n遠,95,0\n"
    with open(f"{tmp_path}/s.csv", "wb") as f:
        f.write(csv.encode("cp932"))
    rows = graph_json.read_station_csv(spark, f"{tmp_path}/s.csv").collect()
    assert [(r.lon, r.lat, r.fields["施設名"]) for r in rows] == [(139.7, 35.6, "駅")]
    with open(f"{tmp_path}/none.csv", "w") as f:
        f.write("緯度,経度\n")
    with pytest.raises(graph_json.SourceError, match="empty"):
        graph_json.read_station_csv(spark, f"{tmp_path}/none.csv")
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "n"}, "geometry": {"type": "Point", "coordinates": [139.7, 35.6]}}]}
    json.dump(doc, open(f"{tmp_path}/s.geojson", "w"))
    assert graph_json.read_stations(spark, f"{tmp_path}/s.geojson").first().name == "n"
    doc["features"][0]["geometry"]["coordinates"] = [139.7, 35.6, 1.0]
    json.dump(doc, open(f"{tmp_path}/t.geojson", "w"))
    with pytest.raises(Exception, match="points in range"):
        graph_json.read_stations(spark, f"{tmp_path}/t.geojson").collect()
    assert {r.column: r.n_null for r in graph_json.inspect_columns(spark.createDataFrame([(1, None)], "a long, b string")).collect()} == {"a": 0, "b": 1}


GML = """<m:CityModel xmlns:m="m" xmlns:b="b" xmlns:gml="http://www.opengis.net/gml" xmlns:xlink="http://www.w3.org/1999/xlink">
<gml:boundedBy><gml:Envelope srsName="crs-6697"/></gml:boundedBy>
<m:cityObjectMember><b:Building gml:id="one"><b:measuredHeight>10</b:measuredHeight>
 <b:boundedBy><b:RoofSurface><gml:Polygon gml:id="roof"><gml:exterior><gml:LinearRing><gml:posList srsDimension="3">35.1 139.1 20 35.1 139.2 20 35.2 139.2 20 35.1 139.1 20</gml:posList></gml:LinearRing></gml:exterior>
 <gml:interior><gml:LinearRing><gml:pos>35.11 139.11 20</gml:pos><gml:pos>35.11 139.12 20</gml:pos><gml:pos>35.12 139.12 20</gml:pos><gml:pos>35.11 139.11 20</gml:pos></gml:LinearRing></gml:interior></gml:Polygon></b:RoofSurface></b:boundedBy>
 <b:lod2Solid><gml:surfaceMember xlink:href="#roof"/><gml:surfaceMember xlink:href="#gone"/></b:lod2Solid></b:Building></m:cityObjectMember>
<m:cityObjectMember><b:Building gml:id="two"><b:consistsOfBuildingPart><b:BuildingPart gml:id="p1"/></b:consistsOfBuildingPart><b:consistsOfBuildingPart><b:BuildingPart gml:id="p2"/></b:consistsOfBuildingPart></b:Building></m:cityObjectMember>
</m:CityModel>"""


def test_citygml(spark, tmp_path):
    with open(f"{tmp_path}/x.gml", "w") as f:
        f.write(GML)
    rows = {r.building_id: r for r in citygml.read_buildings(spark, str(tmp_path)).collect()}
    one = rows["one"].parts[0]
    assert rows["one"].measured_height == 10 and rows["one"].crs == "crs-6697" and one.part_id == "one"
    assert one.lod2.unresolved == ["gone"] and [s.id for s in one.lod2.surfaces] == ["roof"] and one.lod2.surfaces[0].kind == "RoofSurface"
    assert len(one.lod2.surfaces[0].rings) == 2 and one.lod2.surfaces[0].rings[0][0].x == 139.1
    assert [p.part_id for p in rows["two"].parts] == ["p1", "p2"]
    for bad in (GML.replace("35.1 139.1 20 35.1", "35.1 139.1 nan 35.1"), GML.replace('srsDimension="3"', 'srsDimension="2"'), GML.replace("<b:measuredHeight>10", "<b:measuredHeight>x")):
        with pytest.raises(citygml.CityGmlError):
            list(citygml.iter_buildings(bad.encode()))


def city(n, head=True):
    """A file of n buildings that differ in length."""
    start, end = GML.index("<m:cityObjectMember>"), GML.index("</m:CityModel>")
    start_of = GML[:start] if head else GML[:start].replace(' srsName="crs-6697"', "")
    members = [GML[start:end].replace('"one"', f'"one{k}"').replace('"two"', f'"two{k}"').replace("<b:measuredHeight>", "<!-- é " + "x" * (k % 40) + " --><b:measuredHeight>") for k in range(n)]
    if not head:
        members[2] = members[2].replace("<b:Building ", '<b:Building srsName="crs-late" ')
    return start_of + "\n".join(members) + GML[end:]


@pytest.mark.parametrize("head", [True, False])
def test_citygml_splits_hold_the_same_buildings(tmp_path, monkeypatch, head):
    """Any cut, also through tags and characters, and steps of any size."""
    path = f"{tmp_path}/x.gml"
    raw = city(6, head).encode()
    with open(path, "wb") as f:
        f.write(raw)
    want = list(citygml.iter_buildings(raw))
    assert len(want) == 12 and want[-1]["crs"] == ("crs-6697" if head else "crs-late")
    for step in (64, 1 << 20):
        monkeypatch.setattr(citygml, "STEP", step)
        for size in (97, 500, 1333, len(raw)):
            with files.Ranges(path) as file:
                got = [b for at in range(0, len(raw), size) for b in citygml.split_buildings(file, at, min(at + size, len(raw)))]
            assert got == want
    for other in ("<a/>", "<m:CityModel xmlns:m='m'/>"):
        with open(path, "w") as f:
            f.write(other)
        with files.Ranges(path) as file:
            assert list(citygml.split_buildings(file, 0, file.size)) == []
    with open(path, "wb") as f:
        f.write(city(3).encode("utf-16"))
    with files.Ranges(path) as file:
        assert len([b for at in (0, 900) for b in citygml.split_buildings(file, at, at + 900)]) == 6


def test_citygml_source_and_zipped_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/a b")
    for name in ("one", "a b/two"):
        with open(f"{tmp_path}/in/{name}.gml", "w") as f:
            f.write(city(20))
    whole, cut = (citygml.read_buildings(spark, f"file://{tmp_path}/in", n) for n in (1 << 30, 5000))
    assert whole.rdd.getNumPartitions() == 2 < 8 <= cut.rdd.getNumPartitions()
    rows = sorted(map(str, whole.collect()))
    assert len(rows) == 80 and sorted(map(str, cut.collect())) == rows
    with open(f"{tmp_path}/a.zip", "wb") as f:
        f.write(zipped({"x.gml": city(20).encode(), "y/z.gml": city(20).encode()}))
    assert sorted(map(str, citygml.zipped_buildings(archives.zip_entries(spark, f"{tmp_path}/a.zip")).collect())) == rows


def test_archives_are_read_by_ranges(spark, tmp_path):
    rnd = random.Random(3)
    entries = {f"doc/{k}.bin": rnd.randbytes(200_000) for k in range(12)} | {"zeros.bin": bytes(30_000_000), "empty": b""}
    raw = zipped(entries, True)
    with open(f"{tmp_path}/big.zip", "wb") as f:
        f.write(raw)
    with files.Ranges(f"{tmp_path}/big.zip") as file:
        z = archives.RangeZip(file.size, file.read)
        found = z.entries()
        assert file.bytes_read < 70_000 + 200 * len(entries) < file.size / 10
        before = file.bytes_read
        e = found["doc/3.bin"]
        assert b"".join(archives.inflate(e, file.read, 4096)) == entries["doc/3.bin"] and file.bytes_read - before == 30 + e.packed
        sizes = [len(p) for p in archives.inflate(found["zeros.bin"], file.read, 1 << 16)]
        assert sum(sizes) == 30_000_000 and max(sizes) <= 1 << 16  # a small range unpacks to much, but never at once
    listed = archives.zip_entries(spark, str(tmp_path)).filter("path like '%.bin' or path = 'empty'")
    got: dict = {}
    for r in archives.read_pieces(listed, 1 << 20, 300_000).orderBy("path", "nth").collect():
        got[r.path] = got.get(r.path, b"") + bytes(r.content)
        assert len(r.content) < 3 << 20
    assert got == entries
    broken = bytearray(raw)
    broken[found["doc/3.bin"].offset + 5000] ^= 255
    with open(f"{tmp_path}/big.zip", "wb") as f:
        f.write(broken)
    assert archives.read_pieces(listed.filter("path = 'doc/4.bin'")).count() == 1
    with pytest.raises(Exception, match="checksum|invalid|distance|block"):
        archives.read_pieces(listed.filter("path = 'doc/3.bin'")).collect()


def test_files_come_with_the_commit(spark, tmp_path):
    base = f"file://{tmp_path}/out"
    rows = spark.range(20).select(F.concat(F.lit("a b/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".bin")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    files.write_files(rows.repartition(4), base)
    at = lambda: sorted(os.path.relpath(os.path.join(d, n), f"{tmp_path}/out") for d, _, names in os.walk(f"{tmp_path}/out") for n in names)
    assert at() == sorted([f"a b/{k % 3}/{k}.bin" for k in range(20)] + ["_SUCCESS"])
    assert open(f"{tmp_path}/out/a b/1/7.bin").read() == "7"
    bad = rows.withColumn("path", F.concat(F.lit("new/"), "path")).withColumn("content", F.when(F.col("path").endswith("13.bin"), F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    for broken, why in ((bad.repartition(4), "no"), (rows.withColumn("path", F.lit("new/same")).repartition(2), "two rows"), (rows.withColumn("path", F.lit("../x")), "below")):
        with pytest.raises(Exception, match=why):
            files.write_files(broken, base)
        assert at() == sorted([f"a b/{k % 3}/{k}.bin" for k in range(20)] + ["_SUCCESS"])


def zipped(entries, force64=False):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force64) as f:
                f.write(data)
    return raw.getvalue()


def test_archives(spark, tmp_path):
    names = {"udx/bldg/53394610_bldg_6697_op.gml": b"<a/>" * 100, "udx/bldg/53394501_bldg_6697_2_op.gml": b"b", "readme.txt": b"r"}
    for force in (False, True):
        raw = zipped(names, force)
        reads = []
        z = archives.RangeZip(len(raw), lambda s, n: reads.append(n) or raw[s : s + n])
        assert {p: z.read_entry(p) for p in z.entries()} == names
    with open(f"{tmp_path}/a.zip", "wb") as f:
        f.write(raw)
    found = archives.discover_buildings(archives.list_entries(spark, f"{tmp_path}/a.zip")).collect()
    assert [r.mesh_id for r in found] == ["53394501", "53394610"]
    got = archives.read_entries(spark, f"{tmp_path}/a.zip", r"\.txt$").collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("readme.txt", b"r")]
    with open(f"{tmp_path}/evil.zip", "wb") as f:
        f.write(zipped({"../x": b"1"}))
    with pytest.raises(Exception, match="unsafe"):
        archives.list_entries(spark, f"{tmp_path}/evil.zip").collect()
    broken = bytearray(zipped({"x": b"hello hello"}))
    broken[45] ^= 255
    with pytest.raises(Exception):  # noqa: B017  the checksum, the length or the stream itself
        archives.RangeZip(len(broken), lambda s, n: bytes(broken[s : s + n])).read_entry("x")
    assert archives.raw_status(spark, str(tmp_path), (".zip",)) == "available"
    assert archives.raw_status(spark, f"{tmp_path}/absent") == "missing" and archives.registry(spark).count() == 6


def test_area_and_graphml(spark, tmp_path):
    area = {"id": "a", "name": "n", "center": [139.5, 35.5], "zoom": 12.0, "boundingBox": [139.0, 35.0, 140.0, 36.0]}
    json.dump(area, open(f"{tmp_path}/a.json", "w"))
    assert archives.read_area(spark, f"{tmp_path}/a.json")["bbox"] == (139.0, 35.0, 140.0, 36.0)
    for change in ({"boundingBox": [140.0, 35.0, 139.0, 36.0]}, {"center": [0.0, 0.0]}, {"name": None}):
        json.dump(area | change, open(f"{tmp_path}/b.json", "w"))
        with pytest.raises(ValueError):
            archives.read_area(spark, f"{tmp_path}/b.json")
    with open(f"{tmp_path}/g.graphml", "w") as f:
        f.write('<graphml><key id="d0" attr.name="x"/><key id="d1" attr.name="y"/><key id="d2" attr.name="length"/><graph><node id="1"><data key="d0">139.7</data><data key="d1">35.6</data></node><node id="2"><data key="d0">139.8</data><data key="d1">35.6</data></node><edge source="1" target="2" id="0"><data key="d2">9.5</data></edge></graph></graphml>')
    nodes, edges = archives.read_graphml(spark, f"{tmp_path}/g.graphml")
    assert nodes.count() == 2 and tuple(edges.first()) == ("1:2:0", "1", "2", 9.5)


def test_publishing_is_all_or_nothing(tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    publish.publish_files({a: b"old"})

    def fails_second(src, dst):
        if dst == b:
            raise OSError("disk")
        os.replace(src, dst)

    with pytest.raises(OSError):
        publish.publish_files({a: b"new", b: b"new"}, fails_second)
    assert open(a, "rb").read() == b"old" and sorted(os.listdir(tmp_path)) == ["a"]
    publish.publish_files({a: b"new", b: b"new"})
    assert open(a, "rb").read() == open(b, "rb").read() == b"new"


def test_tables_publish_together(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    publish.publish_tables({a: spark.range(3), b: spark.range(4)})
    def check(path, df):
        if path == b and df.count() == 9:
            raise ValueError("refused")
    with pytest.raises(ValueError):
        publish.publish_tables({a: spark.range(8), b: spark.range(9)}, check)
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 4 and len(os.listdir(tmp_path)) == 2
    publish.publish_tables({a: spark.range(8), b: spark.range(9)})
    assert spark.read.parquet(b).count() == 9
    v = f"{tmp_path}/v"
    for stamp, n in (("20260101", 1), ("20260201", 2)):
        publish.write_version(spark.range(n), v, stamp)
    assert publish.latest_version(spark.read, v).count() == 2
    s = f"{tmp_path}/s"
    publish.write_shards(spark.createDataFrame([(1, "m1"), (2, "m2")], "x long, mesh_id string"), s)
    publish.write_shards(spark.createDataFrame([(3, "m2")], "x long, mesh_id string"), s)
    assert sorted(r.x for r in spark.read.parquet(s).collect()) == [1, 3]
    assert "| n |" in publish.markdown_report("t", {"x": spark.createDataFrame([(1,)], "n long")})


def test_shards_have_a_file_for_each_unit(spark, tmp_path):
    """Not one for each unit and task."""
    s = f"{tmp_path}/s"
    df = spark.range(600, numPartitions=6).selectExpr("id", "concat('m', id % 5) AS mesh_id")
    for _ in range(2):
        publish.write_shards(df, s)
    assert spark.read.parquet(s).count() == 600
    assert sum(f.endswith(".parquet") for *_, names in os.walk(s) for f in names) == 5


def test_vector_tiles(spark, tmp_path):
    line = [{"lon": 139.70, "lat": 35.60}, {"lon": 139.80, "lat": 35.65}]
    df = spark.createDataFrame([(line, 0.5, "e")], "geometry array<struct<lon: double, lat: double>>, heat double, id string")
    tiles = publish.vector_tiles(df, ["heat", "id"])
    rows = tiles.collect()
    assert {r.z for r in rows} == {10, 11, 12, 13} and all(bytes(r.tile)[0] == 0x1A for r in rows)
    publish.write_tiles(tiles, str(tmp_path))
    assert sum(len(f) for *_, f in os.walk(tmp_path)) == len(rows)
    assert publish.encode_tile([([(9000.0, 9000.0), (9100.0, 9000.0)], {})]) == b""
    assert publish.clip_to_tile([(-10.0, 5.0), (20.0, 5.0)], 0, 10) == [[(0.0, 5.0), (10.0, 5.0)]]


# -- state ------------------------------------------------------------------------------------

def run(*events):
    s = dict(state.INITIAL)
    for e in events:
        s = state.step(s, e if isinstance(e, dict) else {"action": e})
    return s


def test_selection_transitions():
    start = {"action": "START_COMMITTED", "start": "s"}
    end = {"action": "DESTINATION_AND_ROUTE_COMMITTED", "destination": "d", "route": "r"}
    ready = run(start, end)
    assert ready["phase"] == state.ROUTE_READY and (ready["start"], ready["destination"], ready["route"]) == ("s", "d", "r")
    assert run(end) == state.INITIAL and run(start, start) == run(start)
    assert run("SELECT_START_REQUESTED") == state.INITIAL
    picking = run(start, end, "SELECT_START_REQUESTED")
    assert picking["phase"] == state.SELECTING_START
    failed = state.step(picking, {"action": "CANDIDATE_REJECTED", "error": "x"})
    assert failed["error"] == "x" and failed["route"] == "r" and failed["phase"] == state.SELECTING_START
    again = state.step(failed, {"action": "START_AND_ROUTE_COMMITTED", "start": "s2", "route": "r2"})
    assert (again["start"], again["route"], again["error"]) == ("s2", "r2", None)
    assert run(start, end, {"action": "ROUTE_RECALCULATED", "route": "r3"})["route"] == "r3"
    assert run({"action": "ROUTE_MODE_SELECTED", "mode": "coolest"})["selected_mode"] == "coolest"
    assert run({"action": "ROUTE_MODE_SELECTED", "mode": "slow"}) == state.INITIAL and run(start, "RESET") == state.INITIAL and run("??") == state.INITIAL


@needs_data
def test_batch_fold_equals_stream(spark, tmp_path):
    events = fixtures.load(spark, DATA, "ui_events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r.session_id: r for r in state.fold_sessions(events).collect()}
    for e in (rows := events.orderBy("session_id", "ts", "event_id").toPandas()).session_id.unique()[:3]:
        s = dict(state.INITIAL)
        for r in rows[rows.session_id == e].to_dict("records"):
            s = state.step(s, r)
        assert batch[e].phase == s["phase"] and batch[e].selected_mode == s["selected_mode"]
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = state.stream_sessions(stream).writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.session_id: r for r in spark.table("sessions").collect()}
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(v) for k, v in batch.items()}


def run_stream(df, out, checkpoint):
    """Runs to the end of what is there now and returns what came out."""
    df.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    return df.sparkSession.read.schema(state._REQUEST).parquet(out).collect()


def test_recalculations_over_a_restarted_stream(spark, tmp_path):
    rnd = random.Random(12)
    stamp = lambda k: datetime(2026, 1, 1) + timedelta(seconds=k)
    rows = []
    for k in range(120):
        pick = rnd.random() < 0.5
        rows.append((rnd.randrange(9), k, stamp(k // 2), f"s{k}" if pick and k % 10 else None, f"d{k}" if pick else None, None if pick else rnd.choice(["09:00", "12:00", "15:00"])))
    batch = sorted(tuple(r) for r in state.recalculations(spark.createDataFrame(rows, state.CHANGES)).collect())
    rnd.shuffle(rows)
    os.makedirs(f"{tmp_path}/in")
    stream = state.stream_recalculations(spark.readStream.schema(state.CHANGES).parquet(f"{tmp_path}/in"))
    for part in (rows[:50], rows[50:51], rows[51:]):  # the query starts anew for each, from its checkpoint
        spark.createDataFrame(part, state.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    # Late changes give nothing newer than what is held, so the last request is the one with the latest part.
    last = {}
    for r in got:
        last[r.session_id] = max(last.get(r.session_id, r), r, key=lambda x: x.asked)
    assert {b[0] for b in batch} == {i for i in last if any(b[0] == i for b in batch)}
    assert [tuple(last[b[0]])[3:] for b in batch] == [b[3:] for b in batch]
    assert sorted(tuple(r) for r in got)[-1][0] in range(9) and len(got) >= len(batch)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    stamp = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    os.makedirs(f"{tmp_path}/in")
    stream = state.stream_recalculations(spark.readStream.schema(state.CHANGES).parquet(f"{tmp_path}/in"), "10 minutes")
    steps = [
        [(1, 1, stamp(0), "a", "b", None), (2, 2, stamp(0), "c", "d", None)],
        [(1, 3, stamp(5), None, None, "09:00")],
        [(9, 4, stamp(14), "e", "f", None)],  # time passes: session 2 was last heard 14 minutes ago, session 1 nine
        [(9, 5, stamp(14), "e", "g", None)],
        [(1, 6, stamp(14.5), None, None, "12:00"), (2, 7, stamp(14.5), None, None, "12:00")],
    ]
    for part in steps:
        spark.createDataFrame(part, state.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(tuple(r)[:4] for r in got) == [(1, "a", "b", "09:00"), (1, "a", "b", "12:00")]


def test_pending_units(spark):
    u = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "unit_id string")
    p = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "failed")], "unit_id string, status string")
    s = spark.createDataFrame([("a",), ("c",)], "unit_id string")
    assert {tuple(r) for r in state.pending_units(u, p, s).collect()} == {("b", "new"), ("c", "failed"), ("d", "new")}


# -- registered queries --------------------------------------------------------------------------

def plain(df: pd.DataFrame) -> list:
    def show(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{float(v) + 0.0:.9g}"
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(con.sql(queries.SQL[name]).df())


@needs_data
def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    trips = queries.QUERIES["station_trip_costs"](spark, DATA).collect()
    assert len(trips) == 3 * spark.read.parquet(f"{DATA}/supplier.parquet").count()


def test_layers(spark):
    import math

    from pedshade.sources import layers

    ring = lambda x, n=4: [[{"x": x + dx, "y": 0.0 + dy} for dx, dy in [(0, 0), (1, 0), (1, 1), (0, 1)][:n]]]
    rows = [("a", 1, ring(0.0), "Polygon"), ("a", 2, ring(1.0), "Polygon"), ("a", 3, ring(9.0), "Polygon"), ("a", 4, ring(0.5, 2), "Polygon"), ("b", 5, ring(0.0), "LineString"), ("c", 6, ring(0.0), "Polygon"), ("a", 7, None, "Polygon")]
    df = layers.with_boxes(spark.createDataFrame(rows, "layer string, poly_id long, rings array<array<struct<x: double, y: double>>>, kind string"))
    definitions = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("none", True)], "layer string, include boolean")
    got = {r.layer: tuple(r)[1:] for r in layers.inspect_layers(df, definitions, (0.0, 0.0, 1.0, 1.0)).collect()}
    # Boxes that touch meet; a layer of lines, or without rows, is not usable.
    assert got == {"a": (True, 5, 3, 2, True), "b": (True, 1, 1, 0, False), "c": (False, 1, 1, 0, False), "none": (True, 0, 0, 0, False)}
    assert sorted(r.poly_id for r in layers.read_layers(df, definitions, (0.0, 0.0, 1.0, 1.0)).collect()) == [1, 2]
    with pytest.raises(Exception, match="undecided layer: c"):
        layers.read_layers(df, definitions.withColumn("include", F.when(F.col("layer") != "c", True)), (0.0, 0.0, 1.0, 1.0)).collect()
    assert math.isclose(layers.with_boxes(df).filter("poly_id = 1").first().east, 1.0)


def test_large_graphs_are_refused_as_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 139.7, 35.6), (2, 139.71, 35.61)], "node_id long, lon double, lat double")
    edge = ("a", 1, 2, 5.0, 0.5, 0.5, 0.1, 0.2, 0.3, [{"lon": 139.7, "lat": 35.6}, {"lon": 139.71, "lat": 35.61}])
    edges = spark.createDataFrame([edge], "edge_id string, source long, target long, length double, green_score double, water_penalty double, shade_0900 double, shade_1200 double, shade_1500 double, geometry array<struct<lon: double, lat: double>>")
    for write in (lambda: graph_json.graph_document(nodes, edges, most_edges=0), lambda: binary_graph.write(nodes, edges, f"{tmp_path}/g.bin", most_edges=0)):
        with pytest.raises(ValueError, match="at most"):
            write()
    with pytest.raises(Exception, match="no node"):
        binary_graph.write(nodes.filter("node_id = 1"), edges, f"{tmp_path}/g.bin")


def test_staged_sources_keep_what_they_had(spark, tmp_path):
    from pedshade.sources import archives

    one, two = (spark.createDataFrame([(k,)], "k long") for k in (1, 2))
    assert archives.stage("s", str(tmp_path), lambda: one, "1") == "staged"
    assert archives.stage("s", str(tmp_path), lambda: two, "2") == "cached"

    def broken():
        raise OSError("no network")

    with pytest.raises(OSError):
        archives.stage("s", str(tmp_path), broken, "3", force=True)
    assert archives.staged(spark, "s", str(tmp_path)).first().k == 1
    archives.stage("s", str(tmp_path), lambda: two, "4", force=True)
    assert archives.staged(spark, "s", str(tmp_path)).first().k == 2


def test_broken_archives_are_refused():
    from pedshade.sources import archives

    raw = zipped({"a.txt": b"a", "b.txt": b"b"})
    end = raw.rfind(b"PK\x05\x06")
    several = raw[: end + 4] + b"\x01\x00" + raw[end + 6 :]
    fewer = raw[: end + 8] + b"\x01\x00\x01\x00" + raw[end + 12 :]
    for bad, why in ((several, "several disks"), (fewer, "entries"), (raw[:end], "end record")):
        with pytest.raises(ValueError, match=why):
            archives.RangeZip(len(bad), lambda s, n, bad=bad: bad[s : s + n]).entries()


def test_runner_resumes(spark, tmp_path):
    from pedshade.pipelines import Runner

    units = spark.createDataFrame([("001",), ("2",), ("3",)], "unit_id string")
    runner = Runner(spark, "p", str(tmp_path))
    asked = []

    def build(bad):
        def run(pending):
            asked.append(sorted(r.unit_id for r in pending.collect()))
            rows = pending.select("unit_id", F.lit(len(asked)).alias("attempt"))
            return rows.filter(~F.col("unit_id").isin(bad)), pending.filter(F.col("unit_id").isin(bad)).select("unit_id", F.lit("why").alias("detail"))

        return run

    def crash(pending):
        raise OSError("lost")

    with pytest.raises(OSError):
        runner.run(units, crash)
    assert runner.run(units, build(["2"])) == 1
    assert [(r.unit_id, r.status, r.detail) for r in runner.progress().filter("status = 'failed'").collect()] == [("2", "failed", "why")]
    with pytest.raises(ValueError, match="not complete: 2"):
        runner.complete(units)
    # A shard that was lost after its record is done again, with the unit that failed.
    import shutil

    shutil.rmtree(f"{tmp_path}/shards/unit_id=001")
    assert runner.run(units, build([])) == 0
    assert asked == [["001", "2", "3"], ["001", "2"]]
    assert sorted((r.unit_id, r.attempt) for r in runner.complete(units).collect()) == [("001", 2), ("2", 2), ("3", 1)]
    assert runner.run(units, build([])) == 0 and len(asked) == 2
    assert runner.progress().filter("status = 'failed'").isEmpty()
    with pytest.raises(ValueError, match="progress of 'p'"):
        Runner(spark, "q", str(tmp_path)).progress()


def test_simplified_lines():
    from pedshade.sources import publish

    assert publish.simplified([(0, 0), (5, 1), (10, 0), (10, 50)], 3) == [(0, 0), (10, 0), (10, 50)]
    assert publish.simplified([(0, 0), (5, 9), (10, 0)], 3) == [(0, 0), (5, 9), (10, 0)]
    assert publish.simplified([(0, 0), (9, 0), (0, 0)], 3) == [(0, 0), (9, 0), (0, 0)]
