"""DataFrame operators of the raster, detection and job engine."""
