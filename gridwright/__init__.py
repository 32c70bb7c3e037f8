"""Gridwright: raster, detection and job analytics as Spark DataFrame jobs."""
