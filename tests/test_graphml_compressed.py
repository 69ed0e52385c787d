"""Compressed parts of a graph are one compressed document and read back the same; the query writes its network so."""

import gzip
import xml.etree.ElementTree as tree

from pathloom.plans import streams
from pathloom.sources import files


def test_compressed_parts_are_one_document_and_read_back(spark, tmp_path):
    nodes = spark.createDataFrame([(n, n * 0.5) for n in range(50)], "node long, x double")
    edges = spark.createDataFrame([(n, (7 * n + 1) % 50, "road <&>" + str(n)) for n in range(50)], "u long, v long, name string")
    files.write_graphml(nodes, edges, str(tmp_path / "g"), files=3, compression="gzip")
    root = tree.fromstring(gzip.decompress(b"".join(p.read_bytes() for p in sorted((tmp_path / "g").glob("part-*")))))
    assert len(root[-1]) == 100
    at, links = files.read_graphml(spark, str(tmp_path / "g"))
    assert sorted((r["node"], r["attributes"]["x"]) for r in at.collect()) == [(n, str(n * 0.5)) for n in range(50)]
    assert sorted((r["u"], r["v"], r["attributes"]["name"]) for r in links.collect()) == sorted((n, (7 * n + 1) % 50, f"road <&>{n}") for n in range(50))


def test_query_writes_its_document_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert streams.snk02_graphml(spark, "/root/testdata/sf0.001").count()
    parts = list(tmp_path.glob("network-*.graphml/part-*"))
    assert parts and all(p.read_bytes()[:2] == b"\x1f\x8b" for p in parts)
