"""Graphs written as documents, against the standard parser of XML and the reader."""

import json
import xml.etree.ElementTree as tree

from pathloom.sources import files

SPACE = "{http://graphml.graphdrawing.org/xmlns}"
NODES = [(1, 2.5, 'a <b> & "c"', ["x", "y"]), (2, None, None, None), (3, -1.0, "\u8def \x07", [])]
EDGES = [(1, 2, 0, 9.5, True), (1, 2, 1, None, False), (3, 1, 0, 7.0, None)]


def tables(spark, nodes=NODES, edges=EDGES):
    return spark.createDataFrame(nodes, "node long, x double, name string, tags array<string>"), spark.createDataFrame(edges, "u long, v long, k int, name double, open boolean")


def test_parts_in_order_are_one_document_with_typed_keys(spark, tmp_path):
    for count in (1, 5):
        path = tmp_path / f"g{count}"
        files.write_graphml(*tables(spark), str(path), files=count)
        parts = sorted(path.glob("part-*"))
        assert len(parts) <= count
        root = tree.fromstring("".join(p.read_text() for p in parts))
        keys = {k.get("id"): (k.get("for"), k.get("attr.type")) for k in root.iter(f"{SPACE}key")}
        assert keys == {"x": ("node", "double"), "name": ("all", "string"), "tags": ("node", "string"), "k": ("edge", "int"), "open": ("edge", "boolean")}
        data = lambda e: {d.get("key"): d.text for d in e.iter(f"{SPACE}data")}
        found = {int(n.get("id")): data(n) for n in root.iter(f"{SPACE}node")}
        assert found[1]["name"] == 'a <b> & "c"' and json.loads(found[1]["tags"]) == ["x", "y"]
        assert found[2] == {} and found[3] == {"x": "-1.0", "name": "\u8def \ufffd", "tags": "[]"}
        links = sorted((int(e.get("source")), int(e.get("target")), sorted(data(e).items())) for e in root.iter(f"{SPACE}edge"))
        assert links == [(1, 2, [("k", "0"), ("name", "9.5"), ("open", "true")]), (1, 2, [("k", "1"), ("open", "false")]), (3, 1, [("k", "0"), ("name", "7.0")])]


def test_what_is_written_is_read_back_and_empty_graphs_are_documents(spark, tmp_path):
    files.write_graphml(*tables(spark), str(tmp_path / "g"), files=3)
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g"))
    assert {r["node"]: r["attributes"].get("x") for r in nodes.collect()} == {1: "2.5", 2: None, 3: "-1.0"}
    assert sorted((r["u"], r["v"], r["attributes"]["k"], r["attributes"].get("name")) for r in edges.collect()) == [(1, 2, "0", "9.5"), (1, 2, "1", None), (3, 1, "0", "7.0")]
    files.write_graphml(*tables(spark, [], []), str(tmp_path / "none"), files=2)
    root = tree.fromstring("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))
    assert [e.tag for e in root][-1] == f"{SPACE}graph" and len(root[-1]) == 0
