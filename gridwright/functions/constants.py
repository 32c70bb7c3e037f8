"""Values that results depend on.

Fixed values: the class map, colours, palette, layer order and limits below are
part of the data contract and must stay as they are.
"""

FEATURE_CLASSES = {
    "building": [1, 2, 3],
    "road": [6, 9, 52],
    "utility": [83, 93, 130],
    "vegetation": [4, 17],
    "water": [21, 26, 60],
}
FEATURE_COLOURS = {
    "building": "#FF4444",
    "road": "#4488FF",
    "utility": "#FFAA00",
    "vegetation": "#44BB44",
    "water": "#00BBFF",
    "unknown": "#888888",
}
DEFAULT_COLOUR = "#888888"
DEFAULT_MAP_COLOUR = "#FFFFFF"
PALETTE = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]
LAYER_FILES = {
    False: ["Built_Up_Area_type.shp", "Road.shp", "Water_Body.shp", "Utility_Poly.shp"],
    True: ["Built_Up_Area_typ.shp", "Road.shp", "Water_Body.shp", "Utility_Poly_.shp"],
}

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 64
MIN_AREA = 100
CONFIDENCE_GAIN = 20
CONFIDENCE_CAP = 0.99
THRESHOLD = 0.10
TILE_SIZE = 1024
TILE_STRIDE = 512
TILE_KEEP_SHARE = 0.01
MAX_UPLOAD_BYTES = 6 * 1024**3
PART_BYTES = 8 * 1024 * 1024
TTL_SECONDS = 86_400
UPLOAD_TTL_SECONDS = 3_600
PING_SECONDS = 15
DEFAULT_CRS = "EPSG:4326"
UNKNOWN_CRS = "Unknown"
DEFAULT_CENTRE = (20.5937, 78.9629)
MAP_ZOOM = (14, 5)
