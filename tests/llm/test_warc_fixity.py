import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from pathloom.llm import warc_fixity as wf

SCHEMA = "page_id long, url string, html string, digest string, leaf int"
PAGES = [(k, f"http://h{k % 7}.org/{k}", f"<p>{k}</p>\r\n\r\n" * (k % 40)) for k in range(300)] + [(300, None, None), (301, "http://x\r\ny", "é" * 100_000), (None, "u", "h"), (5, "again", "again"), (5, "again", "again")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartitionByRange(parts, F.coalesce("page_id", F.lit(-1)), "url")


def archived(spark, rows, path, parts=3):
    return wf.read_archive(spark, wf.write_archive(frame(spark, rows, parts), str(path)))


def test_records_read_back_as_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wf, "RECORDS_PER_FILE", 16)
    found = archived(spark, PAGES, tmp_path / "a").collect()
    assert len(found) == len(PAGES) == len({r["leaf"] for r in found})
    blobs = [gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*"))]
    cut = {(r["page_id"], bytes(r["digest"])) for r in found}
    for page, url, html in PAGES:
        body = (html or "").encode()
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: {wf.DATE}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
        whole = head.encode() + body
        assert (page, hashlib.sha256(whole).digest()) in cut and any(whole in b for b in blobs)


def test_only_faults_are_reported_and_only_their_branches_are_read(spark, tmp_path):
    bad = {7, 160, 161, 301}
    theirs = [(p, u, ("~" + h[1:]) if p in bad else h) for p, u, h in PAGES]
    ours, replica = archived(spark, PAGES, tmp_path / "a"), archived(spark, theirs, tmp_path / "b")
    rows = wf.audit(ours, replica).collect()
    assert len(rows) == len(PAGES)
    assert {r["page_id"] for r in rows if not r["intact"]} == bad
    assert all((r["record_sha256"] == r["replica_sha256"]) == r["intact"] for r in rows)
    trees = wf.grow(ours), wf.grow(replica)
    assert wf.differing(spark, *trees).count() == len(bad)
    assert wf.differing(spark, trees[0], trees[0]).count() == 0
    roots = [t[-1].collect() for t in trees]
    assert len(roots[0]) == 1 and roots[0] != roots[1]


def test_missing_records_broken_files_and_empty_archives(spark, tmp_path):
    ours = archived(spark, PAGES[:60], tmp_path / "a", 1)
    fewer = archived(spark, PAGES[:57], tmp_path / "b", 1)
    lost = [r for r in wf.audit(ours, fewer).collect() if not r["intact"]]
    assert len(lost) == 3 and all(r["replica_sha256"] is None for r in lost)
    (file,) = Path(tmp_path / "b").glob("part-*.gz")
    data = gzip.decompress(file.read_bytes())
    file.write_bytes(gzip.compress(data[: len(data) // 2]))
    (tmp_path / "b" / f".{file.name}.crc").unlink(missing_ok=True)
    broken = wf.audit(ours, wf.read_archive(spark, str(tmp_path / "b"))).collect()
    assert 0 < sum(r["intact"] for r in broken) < 60
    nothing = archived(spark, [], tmp_path / "c")
    assert nothing.collect() == [] and wf.audit(nothing, nothing).collect() == []
    assert all(not r["intact"] for r in wf.audit(ours, nothing).collect())


def test_a_flipped_byte_in_a_packed_file_is_located(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k * 7919 % 1000} {'ab cd ' * (k % 9)}</p>") for k in range(400)]
    ours, theirs = archived(spark, rows, tmp_path / "a", 2), archived(spark, rows, tmp_path / "b", 2)
    file = sorted(Path(tmp_path / "b").glob("part-*.gz"))[0]
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    file.write_bytes(bytes(data))
    (tmp_path / "b" / f".{file.name}.crc").unlink(missing_ok=True)
    found = wf.audit(ours, theirs).collect()
    hurt = {r["page_id"] for r in found if not r["intact"]}
    assert len(found) == len(rows) and 0 < len(hurt) < len(rows)
    # Only that file's records from the fault on; the other file agrees.
    first = {r["page_id"] for r in ours.filter(f"leaf < {wf.FILES_PER_TASK * wf.RECORDS_PER_FILE}").collect()}
    assert hurt <= first and min(hurt) > min(first)


def test_offsets_are_part_of_the_tree(spark, tmp_path):
    ours, theirs = archived(spark, PAGES[:40], tmp_path / "a", 1), archived(spark, [(0, "http://other/0", "longer"), *PAGES[1:40]], tmp_path / "b", 1)
    trees = wf.grow(ours), wf.grow(theirs)
    a, b = (t[1].orderBy("node").collect() for t in trees)
    assert all(x["digest"] != y["digest"] for x, y in zip(a, b))
    assert [r["page_id"] for r in wf.audit(ours, theirs).collect() if not r["intact"]] == [0]
