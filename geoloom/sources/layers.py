"""Reading and writing layers, tables, catalog pages, tiles, files and document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geom as G

FORMATS = ("geojson", "geojsonl", "parquet")

ASSET = "struct<href:string,type:string,gsd:double>"
ITEM = (
    "id string, collection string, bbox array<double>, "
    f"assets map<string,{ASSET}>, properties struct<datetime:string,start_datetime:string,platform:string,"
    "constellation:string,`eo:cloud_cover`:double,title:string,gsd:double,`eo:gsd`:double>"
)


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False, srid: int = 4326) -> DataFrame:
    """A GeoJSON layer; ``properties`` is the DDL of the attributes to keep.

    ``lines`` reads one feature per line, which splits over tasks; a FeatureCollection
    document is one record and is exploded.
    """
    feature = T.StructType().add("geometry", "string").add("properties", T.StructType.fromDDL(properties))
    if lines:
        rows = spark.read.schema(feature).json(path).select(F.struct("*").alias("f"))
    else:
        doc = spark.read.option("multiLine", True).schema(T.StructType().add("features", T.ArrayType(feature))).json(path)
        rows = doc.select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", G.from_geojson(F.col("f.geometry")).alias("geom"), F.lit(srid).alias("srid"))


def read_layer(spark: SparkSession, path: str, layer: str | None = None, column: str = "layer") -> DataFrame:
    """One layer of a Parquet container partitioned by ``layer``.

    A container with several layers and no name given is refused, naming them.
    """
    df = spark.read.parquet(path)
    if column not in df.columns:
        return df
    if layer is None:
        names = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
        if len(names) > 1:
            raise ValueError(f"{path!r} holds {len(names)} layers ({', '.join(names)}); pass layer=... to choose one")
        return df.drop(column)
    return df.where(F.col(column) == layer).drop(column)


def feature_lines(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Each row as one GeoJSON feature text in ``value``."""
    attributes = [c for c in df.columns if c not in (geom, "srid", *G.BBOX)]
    head = F.lit('{"type":"Feature","properties":')
    properties = F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}) if attributes else F.lit("{}")
    shape = F.coalesce(G.to_geojson(F.col(geom)), F.lit("null"))
    return df.select(F.concat(head, properties, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def write_layer(df: DataFrame, path: str, layer: str | None = None, mode: str = "errorifexists") -> None:
    """Write by extension: ``.geojsonl`` as one feature per line, ``.parquet`` with box columns.

    With ``layer`` the Parquet table is a container partitioned by layer; writing a
    layer again replaces that layer alone.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("geojsonl", "geojson", "json"):
        feature_lines(df).write.mode(mode).text(path)
    elif suffix == "parquet":
        boxed = G.with_bbox(df)
        if layer is None:
            boxed.write.mode(mode).parquet(path)
        else:
            boxed.withColumn("layer", F.lit(layer)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("layer").parquet(path)
    else:
        raise ValueError(f"unsupported output extension {suffix!r}; use .geojsonl or .parquet")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table without geometry, legal as the right side of an attribute join."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tiles(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """A Parquet tile table, limited to a window of tiles by statistics on ``tile_row/tile_col``."""
    df = spark.read.parquet(path)
    if rows:
        df = df.where(F.col("tile_row").between(*rows))
    if cols:
        df = df.where(F.col("tile_col").between(*cols))
    return df


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tiles sorted by position within range partitions, so that windows prune row groups."""
    tiles.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").write.mode(mode).parquet(path)


def read_item_pages(spark: SparkSession, path: str) -> DataFrame:
    """Harvested catalog pages as one row per item, with the page's ``matched`` count."""
    page = T.StructType().add("context", T.StructType().add("matched", "long"))
    page = page.add("features", T.ArrayType(T.StructType.fromDDL(ITEM)))
    pages = spark.read.option("multiLine", True).schema(page).json(path)
    rows = pages.select(F.col("_metadata.file_name").alias("page"), F.col("context.matched").alias("matched"), F.posexplode("features").alias("pos", "f"))
    p = F.col("f.properties")
    return rows.select(
        "page", "matched", "pos", F.col("f.id").alias("id"), F.col("f.collection").alias("collection"), F.col("f.bbox").alias("bbox"),
        F.col("f.assets").alias("assets"),
        F.struct(
            p["datetime"].alias("datetime"), p["start_datetime"].alias("start_datetime"), p["platform"].alias("platform"),
            p["constellation"].alias("constellation"), p["eo:cloud_cover"].alias("cloud_cover"), p["title"].alias("title"),
            p["gsd"].alias("gsd"), p["eo:gsd"].alias("eo_gsd"),
        ).alias("properties"),
    )


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of the files that match a glob, contents never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", "modificationTime").orderBy("path")


def search_lines(documents: DataFrame, query: str, limit: int, path: str = "path", text: str = "text") -> DataFrame:
    """Lines that hold the query, case ignored: file, 1-based line number, the text without blank ends.

    ``truncated`` is true on every row when more than ``limit`` lines matched.
    """
    needle = F.lit(query.lower())
    lines = documents.where(F.contains(F.lower(F.col(text)), needle)).select(
        F.col(path).alias("file"), F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")).alias("pos", "line_text")
    ).where(F.contains(F.lower("line_text"), needle))
    hits = lines.select("file", (F.col("pos") + 1).alias("line"), F.trim("line_text").alias("text"))
    first = hits.orderBy("file", "line").limit(limit + 1)
    over = first.agg((F.count(F.lit(1)) > limit).alias("t"))
    return first.withColumn("truncated", over.scalar()).orderBy("file", "line").limit(limit)


def read_document_tree(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """A folder of text documents as ``path, text``."""
    docs = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
    return docs.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
