"""Spark-first engine for ordered measurement series, 2-D curves and rasters."""
