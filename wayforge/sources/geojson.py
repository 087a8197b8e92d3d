"""GeoJSON and CSV readers and writers for ways, roads and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.functions import geo

TAGS = "map<string,string>"
#: One way as JSON: id, tags, geometry and its nodes.
WAY = (
    f"id string, properties {TAGS}, geometry struct<coordinates:array<array<double>>>, "
    f"nodes array<struct<id:string,properties:{TAGS},geometry:struct<coordinates:array<double>>>>"
)
COLLECTION = f"features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:{TAGS}>>"


def points(coords):
    """array<array<double>> to array of x, y."""
    return F.transform(coords, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))


def read_ways_csv(spark: SparkSession, path: str, column: str = "feature", many: bool = False) -> DataFrame:
    """way_id, tags, line, nodes from a CSV whose column holds a way as JSON (many: a list of ways). Broken cells give no row."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if many:
        way = raw.select(F.explode(F.from_json(F.col(column), f"array<struct<{_struct(WAY)}>>")).alias("w"))
    else:
        way = raw.select(F.from_json(F.col(column), WAY).alias("w"))
    return way.where("w.id is not null").select(F.col("w.id").alias("way_id"), F.col("w.properties").alias("tags"), points(F.col("w.geometry.coordinates")).alias("line"), F.col("w.nodes").alias("nodes"))


def _struct(ddl: str) -> str:
    """DDL columns as struct fields: the first space of each top-level column becomes a colon."""
    out, depth, start, parts = [], 0, 0, []
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    parts.append(ddl[start:])
    for p in parts:
        name, kind = p.strip().split(" ", 1)
        out.append(f"{name}:{kind}")
    return ",".join(out)


def explode_nodes(ways: DataFrame) -> DataFrame:
    """way_id, seq, last, node_id, lon, lat, tags: one row for each place of a way."""
    n = ways.select("way_id", F.posexplode("nodes").alias("seq", "n"), (F.size("nodes") - 1).alias("last"))
    xy = F.col("n.geometry.coordinates")
    return n.select("way_id", "seq", "last", F.col("n.id").alias("node_id"), F.element_at(xy, 1).alias("lon"), F.element_at(xy, 2).alias("lat"), F.col("n.properties").alias("tags"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """file_key, original_id, tags, line, target (3857): lines of GeoJSON files, MultiLineStrings taken apart.

    The id is the property id, ID or @id, or else a running number by file order.
    """
    raw = spark.read.schema(COLLECTION).option("multiLine", True).json(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_key"), F.posexplode("features").alias("k", "f"))
    one = F.from_json(F.col("f.geometry.coordinates"), "array<array<double>>")
    several = F.from_json(F.col("f.geometry.coordinates"), "array<array<array<double>>>")
    lines = F.when(F.col("f.geometry.type") == "LineString", F.array(one)).when(F.col("f.geometry.type") == "MultiLineString", several)
    rows = raw.select("file_key", "k", F.col("f.properties").alias("tags"), F.posexplode(lines).alias("part", "c")).withColumn("line", points(F.col("c")))
    number = (F.row_number().over(W.partitionBy("file_key").orderBy("k", "part")) - 1).cast("string")
    known = F.coalesce(*(F.try_element_at(F.col("tags"), F.lit(k)) for k in ("id", "ID", "@id")))
    return rows.select("file_key", F.coalesce(known, number).alias("original_id"), "tags", "line", geo.project_line(F.col("line")).alias("target"))


def pair_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names that both folders hold: all pairs are then processed in one job, keyed by file_key."""
    return a.select("file_key").distinct().join(b.select("file_key").distinct(), "file_key")


def to_csv(df: DataFrame, path: str, line: str = "line") -> None:
    df.withColumn("geometry", geo.wkt(F.col(line))).drop(line).write.option("header", True).mode("overwrite").csv(path)


def feature(geom_type: str, line, properties) -> "F.Column":
    """A Feature as JSON text from a line (array of x, y) and a map of properties."""
    xy = F.transform(line, lambda p: F.array(p["x"], p["y"]))
    coords = F.to_json(xy) if geom_type == "LineString" else F.to_json(F.element_at(xy, 1)) if geom_type == "Point" else F.to_json(F.array(xy))
    props = F.coalesce(F.to_json(properties), F.lit("{}"))
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{geom_type}","coordinates":'), coords, F.lit('},"properties":'), props, F.lit("}"))


def write_geojson(features: DataFrame, path: str, crs: str | None = None, name: str | None = None, order: list[str] | None = None) -> None:
    """One FeatureCollection document from a column `feature` of JSON text; valid also when empty.

    A collection is one document, so it is written by one task as a stream of lines; large results go to
    Parquet or to a document for each key (write_by_key) instead.
    """
    import json

    head = '{"type":"FeatureCollection",' + (f'"name":{json.dumps(name)},' if name else "") + (f'"crs":{{"type":"name","properties":{{"name":{json.dumps(crs)}}}}},' if crs else "") + '"features":['
    rows = features.withColumn("__k", F.row_number().over(W.orderBy(*(order or ["feature"]))))
    body = rows.select(F.col("__k"), F.when(F.col("__k") > 1, F.concat(F.lit(","), "feature")).otherwise(F.col("feature")).alias("value"))
    ends = features.sparkSession.createDataFrame([(-1, head), (2**62, "]}")], "__k long, value string")
    ends.unionByName(body.withColumn("__k", F.col("__k").cast("long"))).coalesce(1).sortWithinPartitions("__k").select("value").write.mode("overwrite").text(path)


def write_by_key(features: DataFrame, path: str, key: str) -> None:
    """Features as JSON lines, a folder for each key."""
    features.select(key, F.col("feature").alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def upload_items(features: DataFrame, category: str, date: str) -> DataFrame:
    """Task-service items: id, first coordinate, and properties with prefixed keys and the category."""
    from wayforge.functions.tags import get, prefix_keys

    p = F.element_at("line", 1)
    props = F.map_concat(prefix_keys(F.col("tags")), F.create_map(F.lit("tofix:category"), F.lit(category)))
    return features.where(get(F.col("tags"), "id").isNotNull()).select(get(F.col("tags"), "id").alias("id"), p["x"].alias("lon"), p["y"].alias("lat"), props.alias("properties"), F.lit(date).alias("date"))


def upload(items: DataFrame, client_factory, project: str) -> None:
    """Upserts items through a client made on each partition; the feature id is the key, so a repeat is harmless.
    The client has ensure_project(name) and upsert(project, id, lon, lat, properties, date)."""

    def send(rows):
        client = client_factory()
        client.ensure_project(project)
        for r in rows:
            client.upsert(project, r["id"], r["lon"], r["lat"], dict(r["properties"]), r["date"])

    items.foreachPartition(send)


def read_overture(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Segments whose bbox struct meets the box; the predicate reaches Parquet row groups."""
    x0, y0, x1, y1 = bbox
    return spark.read.parquet(path).where((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """origin, height, width, data, z, x, y of PNG tiles; an unreadable image is a row of width -1."""
    from wayforge.functions.tags import tile_name

    img = spark.read.format("image").option("pathGlobFilter", "*.[pP][nN][gG]").load(folder).select("image.*")
    return img.withColumn("t", tile_name(F.col("origin"))).select("origin", "height", "width", "nChannels", "data", "t.z", "t.x", "t.y")
