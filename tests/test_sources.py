import http.server
import json
import threading
import urllib.error
import urllib.parse

import pytest

from wayfold.operators.network import Network
from wayfold.operators.reach import reach
from wayfold.sources.network_io import load_network, network_from_csv, save_network, write_csv
from wayfold.sources.osm import (
    boxes, element_records, fetcher, network_from_elements, node_query, node_query_text, read_elements, street_network, way_query_text,
)
from wayfold.streaming.accessibility import windowed_reach_sum
from test_network import EDGES, NODES


@pytest.fixture(scope="module")
def grid(spark):
    return Network(
        spark.createDataFrame(NODES, "node_id bigint, x double, y double"),
        spark.createDataFrame(EDGES, "from bigint, to bigint, distance double, time double"),
    )


def test_save_and_load(spark, grid, tmp_path):
    save_network(grid, str(tmp_path / "n"))
    again = load_network(spark, str(tmp_path / "n"))
    assert again.impedance_names == ("distance", "time") and again.twoway
    assert {tuple(r) for r in again.edges_df.collect()} == set(EDGES)
    gone = spark.createDataFrame([(0,), (7,), (6,), (None,)], "node_id bigint")
    save_network(grid, str(tmp_path / "n"), gone)
    kept = load_network(spark, str(tmp_path / "n"))
    assert sorted(r.node_id for r in kept.nodes_df.collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 11]
    assert sorted(tuple(r) for r in kept.edges_df.collect()) == [
        (2, 1, 1.0, 5.0), (2, 3, 1.0, 6.0), (4, 5, 1.0, 2.0), (9, 8, 1.0, 9.0), (10, 9, 1.0, 8.0)
    ]


def test_csv(spark, grid, tmp_path):
    write_csv(grid.nodes_df, str(tmp_path / "nodes"))
    write_csv(grid.edges_df.select("time", "to", "from"), str(tmp_path / "edges"))
    again = network_from_csv(spark, str(tmp_path / "nodes"), str(tmp_path / "edges"), ["time"])
    assert reach(again, 10).count() == 50


def test_query_text():
    box = (37.8659303546, -122.2588003879, 37.8661598571, -122.2585062512)
    ends = "({},{},{},{});".format(*box)
    assert node_query_text(*box) == "[out:json];(  node    " + ends + ");out;"
    assert node_query_text(*box, tags="tag") == "[out:json];(  node  [tag]  " + ends + ");out;"
    assert node_query_text(*box, tags=["a", "b"]) == "[out:json];(  node  [a][b]  " + ends + ");out;"


def test_street_query_text_and_areas():
    text = way_query_text(1.0, 2.0, 3.0, 4.0, "drive", 60, 1024)
    assert text.startswith('[out:json][timeout:60][maxsize:1024];(way["highway"]["highway"!~"^(') and text.endswith("(1.0,2.0,3.0,4.0);>;);out;")
    assert "footway" in text and "motorway" not in text and "motorway" in way_query_text(1.0, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError):
        way_query_text(1.0, 2.0, 3.0, 4.0, "swim")
    assert boxes(0.0, 0.0, 0.4, 0.4) == [(0.0, 0.0, 0.4, 0.4)]
    parts = boxes(-0.5, 10.0, 0.5, 11.0, 60_000.0)
    assert len(parts) == 4 and parts[0] == (-0.5, 10.0, 0.0, 10.5) and parts[-1] == (0.0, 10.5, 0.5, 11.0)
    with pytest.raises(ValueError):
        boxes(1.0, 0.0, 0.0, 1.0)


def test_streets_of_a_box(spark, tmp_path):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["data"][0]
            asked.append(query)
            self.send_response(429 if "[timeout:7]" in query else 200)
            self.end_headers()
            near = [{"type": "node", "id": k, "lat": 0.0, "lon": k * 0.001} for k in (1, 2, 3)]
            empty = "[timeout:8]" in query
            self.wfile.write(json.dumps({"elements": [] if empty else [*near, {"type": "way", "id": 1, "nodes": [1, 2, 3]}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = fetcher(str(tmp_path), f"http://127.0.0.1:{server.server_port}/api")
    network = street_network(spark, fetch, 0.0, 0.0, 0.6, 0.4)
    assert len(asked) == 2 and sorted((r.source, r.destination) for r in reach(network, 150).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)]
    assert network.edges_df.count() == 2
    with pytest.raises(urllib.error.HTTPError):
        street_network(spark, fetch, 0.0, 0.0, 0.1, 0.1, timeout=7)
    with pytest.raises(RuntimeError):
        street_network(spark, fetch, 0.0, 0.0, 0.1, 0.1, timeout=8)
    server.shutdown()


def test_elements(spark, tmp_path):
    answer = {"elements": [
        {"type": "node", "id": 1, "lat": 0.0, "lon": 0.0, "extra": 1},
        {"type": "node", "id": 2, "lat": 0.0, "lon": 0.001, "tags": {"highway": "stop", "source": "x"}},
        {"type": "node", "id": 3, "lat": 0.0, "lon": 0.002},
        {"type": "way", "id": 9, "nodes": [1, 2, 3, 4], "tags": {"highway": "path"}},
    ]}
    path = tmp_path / "answer.json"
    path.write_text(json.dumps(answer))
    elements = read_elements(spark, str(path))
    rows = {r.id: r for r in element_records(elements, ["highway", "source"]).collect()}
    assert rows[2].highway == "stop" and rows[2].source is None and rows[1].highway is None
    assert element_records(elements).where("id = 1").first().tags == {}
    asked = []
    found = node_query(spark, lambda q: asked.append(q) or str(path), 0, 0, 1, 1, keys=["highway"])
    assert found.count() == 4 and "node" in asked[0]
    path.write_text('{"elements": []}')
    with pytest.raises(RuntimeError):
        node_query(spark, lambda q: str(path), 0, 0, 1, 1)
    path.write_text(json.dumps(answer))
    network = network_from_elements(read_elements(spark, str(path)))
    edges = {(r["from"], r["to"]): r["distance"] for r in network.edges_df.collect()}
    assert set(edges) == {(1, 2), (2, 3)} and edges[1, 2] == pytest.approx(111.195, abs=0.01)


def test_streaming_sum(spark, grid, tmp_path):
    spark.createDataFrame(
        [(0, "2024-01-01 00:00:10", 5.0), (4, "2024-01-01 00:00:20", 7.0), (None, "2024-01-01 00:00:20", 7.0), (11, "2024-01-01 00:10:00", 1.0)],
        "node_id bigint, at string, value double",
    ).selectExpr("node_id", "cast(at as timestamp) as ts", "value").write.parquet(str(tmp_path / "in"))
    schema = "node_id bigint, ts timestamp, value double"
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = windowed_reach_sum(events, reach(grid, 1, "distance"), 1.0, "1 minute", "1 minute")
    query = out.writeStream.format("memory").queryName("sums").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.source, r.window_start.minute): (r.events, r.value) for r in spark.table("sums").collect()}
    assert found == {(0, 0): (2, 12.0), (4, 0): (2, 12.0), (5, 0): (1, 7.0), (7, 10): (1, 1.0), (11, 10): (1, 1.0)}
