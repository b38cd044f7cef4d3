"""Raster object analytics on Spark: images as tables, regions, features, labels, a prototype classifier."""
