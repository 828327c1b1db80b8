"""Geotagged-photo metadata: one job over a table of header fields.

The input has ``path``, ``exif map<string,string>`` (tag names, numbers as text, DMS
triples as ``d,m,s``) and ``xmp`` (the packet's text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom as G
from ..functions.geom import let

# Makes that mark a capture as drone imagery.
DRONE_MAKES = ("dji", "autel", "parrot", "sensefly", "wingtra", "yuneec", "skydio", "3dr", "delair", "quantum")
# Name parts that mark an elevation model.
DEM_HINTS = ("dsm", "dtm", "dem", "elevation", "surface", "terrain", "height")
# XMP local names per field, in the order in which they are tried.
XMP_NAMES = {
    "latitude": ("GpsLatitude", "GPSLatitude"),
    "longitude": ("GpsLongitude", "GpsLongtitude", "GPSLongitude"),
    "latitude_ref": ("GPSLatitudeRef",),
    "longitude_ref": ("GPSLongitudeRef",),
    "direction": ("GimbalYawDegree", "FlightYawDegree"),
    "altitude": ("AbsoluteAltitude",),
    "relative_altitude": ("RelativeAltitude",),
    "make": ("Make",),
    "model": ("Model",),
    "timestamp": ("CreateDate", "DateTimeOriginal"),
}
NUMBER = r"[-+]?\d+(?:\.\d+)?"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\x00+|\\x00+$", ""))


def first_number(text: Column) -> Column:
    """The first number in a metadata text, or a ``n/d`` rational."""

    def parsed(n: Column) -> Column:
        ratio = F.get(n, F.lit(0)) / F.when(F.get(n, F.lit(1)) != 0, F.get(n, F.lit(1)))
        return F.when(text.rlike(rf"^\s*{NUMBER}/{NUMBER}\s*$"), ratio).otherwise(F.get(n, F.lit(0)))

    return let(numbers(text), parsed)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).cast("array<double>")


def dms(text: Column) -> Column:
    """``d,m[,s]`` (decimals or rationals) to decimal degrees; fewer than two give NULL."""
    parts = F.transform(F.split(text, ","), lambda v: first_number(v))
    return let(
        parts,
        lambda n: F.get(n, F.lit(0)) + F.get(n, F.lit(1)) / 60.0 + F.coalesce(F.get(n, F.lit(2)), F.lit(0.0)) / 3600.0,
    )


def xmp_coordinate(value: Column, ref: Column) -> Column:
    """Decimal, ``24,40.8167N`` or d/m/s text; a hemisphere letter or the reference sets the sign."""
    tail = F.regexp_extract(value, r"([NSEWnsew])\s*$", 1)
    letter = F.upper(F.when(tail != "", tail).otherwise(F.regexp_extract(value, r"^\s*([NSEWnsew])", 1)))
    seen = F.struct(
        numbers(value).alias("n"), letter.alias("letter"), F.substring(F.upper(clean(ref)), 1, 1).alias("mark")
    )

    def signed(p: Column) -> Column:
        first = F.get(p["n"], F.lit(0))
        minutes, seconds = (F.coalesce(F.get(p["n"], F.lit(i)), F.lit(0.0)) for i in (1, 2))
        size = F.abs(first) + minutes / 60.0 + seconds / 3600.0
        south = p["letter"].isin("S", "W") | p["mark"].isin("S", "W")
        north = p["letter"].isin("N", "E") | p["mark"].isin("N", "E")
        return F.when(south, -size).when(north, size).when(first < 0, -size).otherwise(size)

    return let(seen, signed)


def unescape(text: Column) -> Column:
    for code, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def xmp_fields(packet: Column) -> Column:
    """The known fields of a packet as a map, by local name and any prefix.

    Attributes count before elements, and the first match of a field stays.
    """
    known = "|".join(n for names in XMP_NAMES.values() for n in names)
    attribute = rf'(?:^|[\s:<])({known})\s*=\s*"([^"]*)"'
    element = rf"<(?:\w[\w.-]*:)?({known})(?:\s[^>]*)?>\s*([^<]+?)\s*</"

    def pairs(pattern: str) -> Column:
        names = F.regexp_extract_all(packet, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(packet, F.lit(pattern), F.lit(2))
        return F.arrays_zip(names.alias("name"), values.alias("value"))

    return F.concat(pairs(attribute), pairs(element))


def xmp_field(fields: Column, names: tuple[str, ...]) -> Column:
    """A field's text from the packet's pairs: the first pair with one of its names."""
    hit = F.get(F.filter(fields, lambda p: p["name"].isin(*names) & (p["value"] != "")), F.lit(0))
    return F.trim(unescape(hit["value"]))


def looks_like_drone(camera: Column, xmp: Column) -> Column:
    packet = F.lower(F.coalesce(xmp, F.lit("")))
    return F.lower(camera).rlike("|".join(DRONE_MAKES)) | F.contains(packet, F.lit("drone-dji")) | F.contains(packet, F.lit("gimbal"))


def photo_records(headers: DataFrame) -> DataFrame:
    """Flat photo records, EXIF before XMP; photos without a usable position are dropped."""
    x = F.col("exif")
    staged = G.bound(headers, {"_x": xmp_fields(F.coalesce("xmp", F.lit("")))})
    south = F.when(F.startswith(F.upper(clean(x["GPSLatitudeRef"])), F.lit("S")), -1.0).otherwise(1.0)
    west = F.when(F.startswith(F.upper(clean(x["GPSLongitudeRef"])), F.lit("W")), -1.0).otherwise(1.0)
    fields = {f"_{k}": xmp_field(F.col("_x"), v) for k, v in XMP_NAMES.items()}
    staged = G.bound(staged, fields | {"_glat": dms(x["GPSLatitude"]) * south, "_glon": dms(x["GPSLongitude"]) * west}).drop("_x")
    has_gps = F.col("_glat").isNotNull() & F.col("_glon").isNotNull()
    below = F.trim(x["GPSAltitudeRef"]).isin("1", "\x01")
    staged = G.bound(
        staged,
        {
            "lat": F.when(has_gps, F.col("_glat")).otherwise(xmp_coordinate(F.col("_latitude"), F.col("_latitude_ref"))),
            "lon": F.when(has_gps, F.col("_glon")).otherwise(xmp_coordinate(F.col("_longitude"), F.col("_longitude_ref"))),
            "_gps_alt": F.when(has_gps, first_number(x["GPSAltitude"]) * F.when(below, -1.0).otherwise(1.0)),
            "_abs_alt": first_number(F.col("_altitude")), "_rel_alt": first_number(F.col("_relative_altitude")),
            "direction": F.coalesce(F.when(has_gps, first_number(x["GPSImgDirection"])), first_number(F.col("_direction"))),
        },
    )
    staged = staged.where("lat between -90 and 90 and lon between -180 and 180")

    def text(tag: str, fallback: str) -> Column:
        own = clean(x[tag])
        return F.when(own != "", own).otherwise(F.coalesce(F.col(fallback), F.lit("")))

    camera = F.trim(F.concat_ws(" ", *[F.when(t != "", t) for t in (text("Make", "_make"), text("Model", "_model"))]))
    kind = F.when(F.col("_gps_alt").isNotNull(), "gps").when(F.col("_abs_alt").isNotNull(), "absolute").when(F.col("_rel_alt").isNotNull(), "relative")
    staged = staged.withColumns(
        {
            "camera": camera, "altitude": F.coalesce("_gps_alt", "_abs_alt", "_rel_alt"), "altitude_kind": kind,
            "timestamp": text("DateTimeOriginal", "_timestamp"),
        }
    )
    drone = looks_like_drone(F.col("camera"), F.col("xmp"))
    label = F.when(F.col("camera") != "", F.col("camera"))
    return staged.select(
        "path", F.lit("photo").alias("kind"), F.coalesce(label, F.lit("Photo")).alias("label"), "lon", "lat", "camera", "timestamp",
        drone.alias("drone"), "altitude", "altitude_kind", "direction",
    )


def raster_records(headers: DataFrame) -> DataFrame:
    """Georeferenced rasters with a usable extent and their role (``dem`` or ``ortho``).

    The input has ``path, srid, identity, width, height, bands, west, south, east, north``
    with the extent in longitude and latitude.
    """
    name = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    finite = F.lit(True)
    for side in ("west", "south", "east", "north"):
        finite = finite & F.col(side).isNotNull() & ~F.isnan(side) & (F.abs(side) != float("inf"))
    ok = (
        F.col("srid").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & ~F.coalesce("identity", F.lit(False)) & finite
        & (F.col("west") < F.col("east")) & (F.col("south") < F.col("north"))
        & (F.col("west") >= -180) & (F.col("east") <= 180) & (F.col("south") >= -90) & (F.col("north") <= 90)
    )
    role = F.when((F.col("bands") == 1) | name.rlike("|".join(DEM_HINTS)), "dem").otherwise("ortho")
    label = F.trim(F.replace(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))
    return headers.where(ok).select(
        "path", F.lit("raster").alias("kind"), F.when(label != "", label).otherwise("Georeferenced raster").alias("label"),
        "srid", "bands", "west", "south", "east", "north", role.alias("role"),
    )


def detect_summary(all_paths: DataFrame, photos: DataFrame, rasters: DataFrame) -> DataFrame:
    """One row: photos, rasters, skipped files and the union bounds."""
    files = photos.select("kind", F.col("lon").alias("w"), F.col("lat").alias("s"), F.col("lon").alias("e"), F.col("lat").alias("n")).unionByName(
        rasters.select("kind", F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n"))
    )
    total = all_paths.agg(F.count(F.lit(1)).alias("n"))
    return files.agg(
        F.count_if(F.col("kind") == "photo").alias("photos"), F.count_if(F.col("kind") == "raster").alias("rasters"),
        F.min("w").alias("minx"), F.min("s").alias("miny"), F.max("e").alias("maxx"), F.max("n").alias("maxy"),
    ).withColumn("skipped", total.scalar() - F.col("photos") - F.col("rasters"))


def pick_dem(photos: DataFrame, dems: DataFrame, group: str, order: str) -> DataFrame:
    """Per photo group the DEM to use: the first that contains the photos, else the largest overlap.

    ``dems`` carries ``group`` too (the selection it came with); one row per group.
    """
    box = photos.groupBy(group).agg(
        F.min("lon").alias("pw"), F.min("lat").alias("ps"), F.max("lon").alias("pe"), F.max("lat").alias("pn")
    )
    both = dems.join(box, group)
    holds = (F.col("west") <= F.col("pw")) & (F.col("south") <= F.col("ps")) & (F.col("east") >= F.col("pe")) & (F.col("north") >= F.col("pn"))
    w = F.least("east", "pe") - F.greatest("west", "pw")
    h = F.least("north", "pn") - F.greatest("south", "ps")
    overlap = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    rank = F.struct(F.when(holds, 0).otherwise(1).alias("a"), F.when(holds, 0.0).otherwise(-overlap).alias("b"), F.col(order).alias("c"))
    usable = both.withColumns({"_rank": rank, "_ok": holds | (overlap > 0)}).where("_ok")
    return usable.groupBy(group).agg(F.min_by("path", "_rank").alias("dem"))


def photo_layer(photos: DataFrame) -> DataFrame:
    """Photo records as a point layer with their folder; altitude and direction to 3 places."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    return photos.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", folder.alias("folder"), "camera", "timestamp",
        F.round("altitude", 3).alias("altitude"), F.round("direction", 3).alias("direction"), "altitude_kind",
        G.point("lon", "lat").alias("geom"), F.lit(4326).alias("srid"),
    )
