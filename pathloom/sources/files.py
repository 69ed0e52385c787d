"""Readers and writers of the file formats that places, networks and logs come in.

Every reader states its schema, so nothing is inferred by an extra pass over the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def with_defaults(items: str, defaults: str, fields: list[str]) -> list[Column]:
    """Fields of a map, taken from a map of defaults where the key is absent; a null value stays null."""
    own, other = F.col(items), F.col(defaults)
    return [F.when(F.map_contains_key(own, F.lit(f)), F.try_element_at(own, F.lit(f))).otherwise(F.try_element_at(other, F.lit(f))).alias(f) for f in fields]


def read_catalogue(spark: SparkSession, path: str, items: str, defaults: str, fields: list[str]) -> DataFrame:
    """Nested documents: one row for each item, absent keys filled from the document's defaults."""
    schema = f"`{items}` array<map<string,string>>, `{defaults}` map<string,string>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.explode(items).alias("item"), F.coalesce(F.col(defaults), F.create_map().cast("map<string,string>")).alias("default")).select(*with_defaults("item", "default", fields))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, coordinates (JSON text), properties of each feature of a collection."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, attributes) and edges (u, v, attributes); attributes by key, typed by the caller.

    The parser that looks for row tags is asked for: it reads a large document in splits, and a folder
    of the parts of one, as write_graphml makes it.
    """
    data = "data array<struct<_key:string,_VALUE:string>>"
    entries = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    read = lambda tag, schema: spark.read.format("xml").schema(schema).option("rowTag", tag).option("useLegacyXMLParser", True).load(path)
    nodes = read("node", f"_id long, {data}").select(F.col("_id").alias("node"), entries.alias("attributes"))
    edges = read("edge", f"_source long, _target long, {data}").select(F.col("_source").alias("u"), F.col("_target").alias("v"), entries.alias("attributes"))
    return nodes, edges


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header, which may start with a byte-order mark."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType, strict: bool) -> DataFrame:
    """A JSON snapshot: strict fails where a row does not fit, otherwise such a snapshot has no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A database table, in ranges of a numeric key; rows outside the bounds are in the end ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions)


def generate_queries(spark: SparkSession, n: int, templates: list[str], modes: list[str], seed: int = 42) -> DataFrame:
    """id, template, mode: rows that depend on id and seed only, however they are partitioned."""
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    return spark.range(n).select("id", pick(templates, 1).alias("template"), pick(modes, 2).alias("mode"))


# ---- writers ----------------------------------------------------------------------------------


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a snapshot as a whole: Spark's committer publishes new files only when all are written."""
    df.write.mode("overwrite").json(path)


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    """CSV of several tables under the union of their columns in first-seen order; missing values are empty."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    whole.write.mode("overwrite").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str, kind: str = "csv") -> None:
    """u, v, k, length (one decimal), highway, road of each edge as CSV or JSON lines."""
    rows = edges.select("u", "v", "k", F.round("length", 1).alias("length"), "highway", "road")
    (rows.write.mode("overwrite").option("header", True).csv if kind == "csv" else rows.write.mode("overwrite").json)(path)


def write_with_summary(df: DataFrame, path: str, *measures: Column) -> None:
    """A table as CSV, and the measures over all of it as one JSON row in a folder beside it."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    df.agg(*measures).write.mode("overwrite").json(f"{path}/summary")


#: Names of attribute types in the format.
GRAPHML_TYPES = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double"}


def _xml_text(column: Column, kind: DataType) -> Column:
    """A value as text of a document: nested ones as JSON, characters that XML cannot hold as U+FFFD."""
    text = F.to_json(column) if isinstance(kind, (ArrayType, MapType, StructType)) else column.cast("string")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "\ufffd")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, files: int | None = None, compression: str = "none") -> None:
    """A directed graph as GraphML: the part files of the folder, in order of their names, are one document.

    nodes has node, edges has u and v; all other columns are attributes under typed keys. A name that
    nodes and edges share is one key, a string where their types differ. Nulls have no entry. Lines are
    range-sorted into the given number of files (else as many as there are shuffle partitions), so that
    no task holds the document; files=1 makes one file. A graph without nodes is a document as well.
    With compression "gzip" the parts in order are one compressed document, which read_graphml reads a part to a task.
    """
    spark = nodes.sparkSession
    own = [{f.name: f.dataType for f in df.schema if f.name not in ids} for df, ids in ((nodes, ("node",)), (edges, ("u", "v")))]
    quoted = lambda name: name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for name in own[0] | own[1]:
        kinds = {GRAPHML_TYPES.get(side[name].simpleString(), "string") for side in own if name in side}
        scope = "all" if all(name in side for side in own) else "node" if name in own[0] else "edge"
        head.append(f'<key id="{quoted(name)}" for="{scope}" attr.name="{quoted(name)}" attr.type="{kinds.pop() if len(kinds) == 1 else "string"}"/>')
    head.append('<graph edgedefault="directed">')

    def entries(kinds: dict[str, DataType]) -> Column:
        column = lambda name: F.col("`" + name.replace("`", "``") + "`")
        return F.concat_ws("", *[F.concat(F.lit(f'<data key="{quoted(n)}">'), _xml_text(column(n), k), F.lit("</data>")) for n, k in kinds.items()])

    line = lambda part, *pieces: [F.lit(part).alias("part"), F.concat(*pieces).alias("line")]
    ends = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, line string")
    body = nodes.select(*line(1, F.lit('<node id="'), F.col("node").cast("string"), F.lit('">'), entries(own[0]), F.lit("</node>"))).unionByName(
        edges.select(*line(2, F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('">'), entries(own[1]), F.lit("</edge>")))
    )
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", F.xxhash64("line")]
    ends.unionByName(body).repartitionByRange(count, *order).sortWithinPartitions(*order, "line").select("line").write.mode("overwrite").option("compression", compression).text(path)
