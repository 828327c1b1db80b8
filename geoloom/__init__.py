"""Spark-native geospatial analytics: lazy DataFrame operators over vector layers,
raster tables, imagery catalogs, model detections, photo metadata and run history."""
