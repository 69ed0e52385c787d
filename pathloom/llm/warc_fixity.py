"""WARC archives and a Merkle audit of their replicas.

Pages are written as WARC files by Spark's text writer, whose line separator is the one that ends a
WARC record; layout follows the scan, so nothing is shuffled. An archive is read back file by file:
every record gives its offset, length and SHA-256. These digests, in order of file and place, are
the leaves of a tree; a node is the digest of its up to sixteen children, each with its number and
the range of offsets that it covers, first within a file, then over ranges of files, up to one root.
Two replicas are compared from their roots down, and only the children of nodes that differ are
looked at, so a small fault in a large archive is found by a few small joins.

Defined results: a null url is written as an empty one and a null html as an empty payload; a null
id is written and read back as null; rows that repeat are records of their own; a record that is
missing in one replica differs, one that only stands elsewhere in its file does not; where a file
cannot be unpacked or parsed on, what is left of it is one unreadable record; an empty table has no records, and two empty archives agree; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import materialize, table, work_path

#: Children of a node are told apart by this many bits of the leaf's number.
FANOUT_BITS = 4
#: Records in a file, a power of the fan-out; files that one task may write, likewise.
RECORDS_PER_FILE, FILES_PER_TASK = 4096, 4096
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

LEAVES = "leaf bigint, page_id bigint, start bigint, length bigint, digest binary"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record, without the blank lines that end it."""
    one_line = F.translate(F.coalesce(url, F.lit("")), "\r\n", "")
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        one_line,
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
    )


def write_archive(pages: DataFrame, path: str) -> str:
    """Write page_id, url, html as gzip-compressed WARC files, in the order of the scan."""
    rows = pages.select(record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


_length = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
_page = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d*)>\r\n")


def parse(data: bytes) -> Iterator[tuple[int | None, int, int, bytes]]:
    """page_id, offset, length, digest of each record of an uncompressed WARC file."""
    at, end = 0, END.encode()
    while at < len(data):
        head = data.find(end, at)
        length = _length.search(data, at, head + 2) if head >= 0 else None
        stop = head + 4 + int(length[1]) if length else -1
        if stop < 0 or data[stop : stop + 4] != end:
            yield None, at, len(data) - at, hashlib.sha256(data[at:]).digest()
            return
        page = _page.search(data, at, head + 2)
        yield int(page[1]) if page and page[1] else None, at, stop - at, hashlib.sha256(data[at:stop]).digest()
        at = stop + 4


def unpack(data: bytes, step: int = 4096) -> tuple[bytes, bytes]:
    """What gzip members hold, as far as they can be unpacked, and the packed bytes that cannot."""
    out, at, member = [], 0, zlib.decompressobj(31)
    while at < len(data):
        before = member.copy()
        try:
            out.append(member.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), data[at:]
            # On by single bytes: what comes before the fault is not lost.
            member, step = before, 1
            continue
        at += len(data[at : at + step]) - len(member.unused_data)
        if member.eof:
            member = zlib.decompressobj(31)
    return b"".join(out), b""


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of an archive: number in order of file and place, page_id, offset, length, digest."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                place = re.search(r"part-(\d+)-.*-c(\d+)\.", name.as_py())
                if not place or int(place[2]) >= FILES_PER_TASK:
                    raise ValueError(f"{name} does not have a place in an archive of this module: part-TASK-...-cFILE, fewer than {FILES_PER_TASK} files a task")
                first = (int(place[1]) * FILES_PER_TASK + int(place[2])) * RECORDS_PER_FILE
                text, lost = unpack(content.as_py())
                found = list(parse(text))
                if lost:
                    found.append((None, len(text), len(lost), hashlib.sha256(lost).digest()))
                rows = [(first + k, *row) for k, row in enumerate(found)]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], names=["leaf", "page_id", "start", "length", "digest"])

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    return files.select("path", "content").mapInArrow(leaves, LEAVES)


def grow(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the tree, leaves first, each (node, digest, start, stop); the last has the root only."""
    levels = [leaves.select(F.col("leaf").alias("node"), "digest", "start", (F.col("start") + F.col("length")).alias("stop"))]
    top = leaves.agg(F.max("leaf")).first()[0] or 0
    while top > 0:
        top >>= FANOUT_BITS
        children = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(" ", c["node"], c["start"], c["stop"], F.hex(c["digest"]))), "\n")
        node = F.shiftright("node", FANOUT_BITS)
        parents = levels[-1].groupBy(node.alias("parent")).agg(F.unhex(F.sha2(joined, 256)).alias("digest"), F.min_by("start", "node").alias("start"), F.max_by("stop", "node").alias("stop"))
        levels.append(materialize(parents.withColumnRenamed("parent", "node"), "merkle-level"))
    return levels


def differing(spark: SparkSession, ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """leaf: numbers of the leaves that differ or that only one replica has."""
    # The lower tree is raised to the other's height: its root stands for itself on the levels above.
    height = max(len(ours), len(theirs))
    ours, theirs = ([*levels, *[levels[-1]] * (height - len(levels))] for levels in (ours, theirs))
    suspects = None
    for level in range(height - 1, -1, -1):
        sides = []
        for levels, name in ((ours, "a"), (theirs, "b")):
            nodes = levels[level].select("node", F.col("digest").alias(name))
            if suspects is not None:
                nodes = nodes.join(suspects, F.shiftright("node", FANOUT_BITS) == F.col("parent"), "left_semi")
            sides.append(nodes)
        apart = sides[0].join(sides[1], "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        suspects = materialize(apart.select(F.col("node").alias("parent")), "differing")
    return suspects.withColumnRenamed("parent", "leaf")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of our archive: page_id, record_bytes, record_sha256, replica_sha256, intact."""
    spark = ours.sparkSession
    apart = differing(spark, grow(ours), grow(theirs))
    faulty = materialize(apart.join(theirs.select("leaf", F.col("digest").alias("other")), "leaf", "left").withColumn("apart", F.lit(True)), "faults")
    hexed = lambda c: F.lower(F.hex(c))
    return ours.join(faulty, "leaf", "left").select(
        "page_id",
        F.col("length").alias("record_bytes"),
        hexed("digest").alias("record_sha256"),
        F.when(F.col("apart"), hexed("other")).otherwise(hexed("digest")).alias("replica_sha256"),
        F.col("apart").isNull().alias("intact"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """Pages as a replica with known faults holds them: the first byte of some payloads differs."""
    hit = (F.pmod("page_id", F.lit(97)) == 5) & F.col("html").startswith("<")
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, audit a replica with known faults against the archive."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replicas = [write_archive(rows, work_path(spark, "warc")) for rows in (pages, damaged(pages))]
    return audit(*[materialize(read_archive(spark, path), "leaves") for path in replicas])


_RECORD = r"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '')
  || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
  || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || body"""

SQL = {
    "op3_warc_fixity": f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, page_id % 97 = 5 AND starts_with(coalesce(html, ''), '<') AS hit FROM pages
), r AS (
  SELECT page_id, hit, {_RECORD} AS ours FROM p
), d AS (
  SELECT page_id, url, hit, CASE WHEN hit THEN '~' || substr(body, 2) ELSE body END AS body FROM p
), t AS (
  SELECT page_id, {_RECORD} AS theirs FROM d
)
SELECT r.page_id, strlen(ours)::BIGINT AS record_bytes, sha256(ours) AS record_sha256, sha256(theirs) AS replica_sha256, NOT hit AS intact
FROM r JOIN t USING (page_id)
"""
}
