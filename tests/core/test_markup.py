"""Readers of map and place files against files written by hand."""

import json

from fieldglass.sources import markup, readers

OSM = """<osm><node id="1" lat="2.5" lon="3"><tag k="Name" v="x&amp;y"/><tag k="name" v="z"/></node><node id="2" lat="0" lon="0"/>
<way id="5"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way><relation id="7"><member type="way" ref="5" role="outer"/></relation></osm>"""
CHANGE = """<osmChange><create><node id="1" lat="1" lon="2"/></create><modify><way id="5"><nd ref="1"/></way><node id="3" lat="1" lon="2"/></modify><delete><relation id="9"/></delete></osmChange>"""
KML = """<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><Placemark><name>p</name><Point><coordinates> 3,4,5 </coordinates></Point></Placemark>
<Placemark><name>l</name><LineString><coordinates>1,2
 3,4,9 bad,5</coordinates></LineString></Placemark><Placemark><gx:Track><when>2024-01-01T00:00:01Z</when><when>2024-01-01T00:00:02Z</when><gx:coord>1 2 3</gx:coord><gx:coord>4 5</gx:coord></gx:Track></Placemark>
<Placemark><name>none</name></Placemark></Document></kml>"""


def test_map_objects(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    nodes = {r.id: r for r in markup.osm_objects(spark, str(tmp_path), "node").collect()}
    assert nodes[1].tags == {"name": "z"} and (nodes[1].lat, nodes[1].lon) == (2.5, 3.0) and nodes[2].tags == {} and len(nodes) == 2
    way = markup.osm_objects(spark, str(tmp_path), "way").collect()
    assert [(w.id, w.nodes, w.tags) for w in way] == [(5, [1, 2], {"highway": "path"})]
    members = markup.osm_objects(spark, str(tmp_path), "relation").first().members
    assert [tuple(m) for m in members] == [("way", 5, "outer")]


def test_changes(spark, tmp_path):
    (tmp_path / "a.osc").write_text(CHANGE)
    got = {(r.action, r.kind, r.id) for r in markup.osm_changes(spark, str(tmp_path)).collect()}
    assert got == {("create", "node", 1), ("modify", "way", 5), ("modify", "node", 3), ("delete", "relation", 9)}


def test_placemarks(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    got = {r.kind: r for r in markup.kml_places(spark, str(tmp_path)).collect()}
    assert set(got) == {"point", "line", "track"}
    assert [tuple(p) for p in got["point"].points] == [(3.0, 4.0, 5.0)] and got["point"].ms is None
    assert [tuple(p) for p in got["line"].points] == [(1.0, 2.0, None), (3.0, 4.0, 9.0)]
    assert [tuple(p) for p in got["track"].points] == [(1.0, 2.0, 3.0), (4.0, 5.0, None)] and got["track"].ms == [1704067201000, 1704067202000]


def test_packs_survive_extra_fields_and_damage(spark, tmp_path):
    good = {"v": 1, "more": {}, "cams": [[1.5, 2.5, "N"], [None, 2.0, "x"], [3, 4]]}
    (tmp_path / "a.txt").write_text(json.dumps(good) + '\n{"v":1,"cams":[[1,2\n')
    got = sorted(tuple(r) for r in markup.read_packs(spark, str(tmp_path)).collect())
    assert got == [(1.5, 2.5, "N"), (3.0, 4.0, "")]


def test_snapshot_keeps_the_last_tile_and_the_oldest_stamp(spark):
    rows = [(1, "2024-02", 7, 1.0, 2.0, {"brand": "a", "name": "n"}), (2, "2024-01", 7, 1.5, 2.0, {"brand": "", "operator": "o"}), (2, "2024-01", 8, None, 2.0, {}), (2, "", 9, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "tile int, stamp string, id long, lat double, lon double, tags map<string,string>")
    got = {r.id: r for r in markup.camera_snapshot(df).collect()}
    assert set(got) == {7, 9} and got[7].lat == 1.5 and got[7].tags == {"operator": "o"} and got[9].tags == {} and got[9].stamp == "2024-01"


def test_geojson_forms(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    polygon = {"type": "Polygon", "coordinates": [ring]}
    docs = [{"type": "FeatureCollection", "features": [{"id": "a", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}, {"id": "p", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}, {"type": "Feature", "id": "b", "geometry": polygon}, polygon]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, docs)))
    got = {r.id: len(r.rings) for r in readers.geojson_polygons(spark, str(tmp_path), lines=True).collect()}
    assert got == {"a": 3, "b": 1, None: 1}
