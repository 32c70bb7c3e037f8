"""Sources and sinks: GeoTIFF, shapefiles, archives, PNG and GeoJSON."""
