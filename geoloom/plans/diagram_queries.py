"""Queries over point diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import diagram as D
from . import layers as L
from .registry import query


@query(
    "voronoi_cells",
    "select count(*) as cells, round((max(x)-min(x))*(max(y)-min(y)), 3) as area from (select distinct x, y from points)",
    base=(L.POINTS,),
)
def voronoi_cells(spark, sf):
    """One cell per distinct point; together they cover the extent once."""
    v = D.voronoi(L.points(spark, sf).withColumn("srid", F.lit(3857)), srid=3857)
    return v.agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(G.area(F.col("geom"))), 3).alias("area"))


@query("delaunay_triangles")
def delaunay_triangles(spark, sf):
    """Triangle count and total area; the tests compare them with the hull."""
    t = D.voronoi(L.points(spark, sf).withColumn("srid", F.lit(3857)), "delaunay", srid=3857)
    return t.agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum(G.area(F.col("geom"))), 3).alias("area"))
