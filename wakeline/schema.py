"""Column names, types and fixed domain values of ship position reports."""

from __future__ import annotations

from pyspark.sql import types as T

# ITU "not available" sentinels per column.
SENTINELS = {"lat": 91.0, "lon": 181.0, "sog": 102.3, "heading": 511, "draught": 25.5}

#: Types of the known columns of track files without types (CSV).
CSV_TYPES = {
    "mmsi": "bigint", "event_id": "bigint", "segment_id": "bigint", "time": "timestamp", "msg_type": "int",
    "lat": "double", "lon": "double", "sog": "double", "cog": "double", "heading": "double", "draught": "double",
    "imo": "bigint", "ship_type": "int", "length": "double", "width": "double",
}

# Closed validity ranges per column.
RANGES = {
    "lat": (-90.0, 90.0),
    "lon": (-180.0, 180.0),
    "sog": (0.0, 102.2),
    "cog": (0.0, 360.0),
    "heading": (0.0, 360.0),
    "turn": (-127.0, 127.0),
    "nav_status": (0, 15),
    "msg_type": (1, 27),
    "accuracy": (0, 1),
}

# Message-type domains.
POSITION_TYPES = (1, 2, 3, 18, 19, 27)
CONTEXT_TYPES = (4, 21)
METADATA_TYPES = (5, 24)
SAFETY_TYPES = (6, 7, 8, 9, 12, 13, 14, 15, 16)
RECEIVER_POSITION_TYPES = (1, 2, 3, 18, 19)

# Message class by type, eight-class coding.
BASIC_CLASSES = {
    1: "A_pos", 2: "A_pos", 3: "A_pos", 4: "Base_pos",
    5: "Static", 18: "B_pos", 21: "ATON", 24: "StaticB",
}

# Message class by type, ten-class coding.
TASK_CLASSES = {
    1: "A_pos", 2: "A_pos", 3: "A_pos",
    4: "base_station", 5: "static_voyage",
    6: "safety_comm", 7: "safety_comm", 8: "safety_comm", 9: "sar_aircraft",
    12: "safety_comm", 13: "safety_comm", 14: "safety_comm",
    18: "B_pos", 19: "B_pos", 21: "aton", 24: "static_data", 27: "long_range",
}

# Graph node type by message class.
NODE_TYPES = {
    "A_pos": "vessel_a",
    "B_pos": "vessel_b",
    "base_station": "infrastructure",
    "aton": "infrastructure",
    "static_voyage": "metadata",
    "static_data": "metadata",
}

# What each task keeps. None means every class.
_CORE = POSITION_TYPES + CONTEXT_TYPES
TASKS = {
    "trajectory_prediction": {
        "types": _CORE, "fields": ("trajectory",),
        "classes": ("A_pos", "B_pos", "long_range"),
    },
    "anomaly_detection": {
        "types": _CORE + METADATA_TYPES, "fields": ("trajectory", "voyage"),
        "classes": ("A_pos", "B_pos", "static_voyage", "long_range"),
    },
    "graph_neural_networks": {
        "types": _CORE + METADATA_TYPES + SAFETY_TYPES,
        "fields": ("trajectory", "identity"), "classes": None,
    },
    "collision_avoidance": {
        "types": _CORE, "fields": ("trajectory",), "classes": ("A_pos", "B_pos"),
    },
    "port_operations": {
        "types": _CORE + METADATA_TYPES, "fields": ("trajectory", "voyage"),
        "classes": ("A_pos", "B_pos", "static_voyage"),
    },
    "environmental_monitoring": {
        "types": _CORE, "fields": (), "classes": ("A_pos", "B_pos", "long_range"),
    },
    "search_and_rescue": {
        "types": _CORE + SAFETY_TYPES, "fields": ("trajectory", "safety"),
        "classes": ("A_pos", "B_pos", "sar_aircraft", "safety_comm"),
    },
}

# Optional log fields by group.
FIELD_GROUPS = {
    "trajectory": ("speed", "course", "heading", "turn", "status", "accuracy",
                   "second", "maneuver", "raim"),
    "voyage": ("shipname", "shiptype", "to_bow", "to_stern", "to_port",
               "to_starboard", "destination", "eta", "draught"),
    "identity": ("callsign", "imo", "aid_type", "name", "off_position", "virtual_aid"),
    "safety": ("safety_text",),
}

# Vessel category by AIS type code (closed ranges).
VESSEL_CATEGORIES = (
    ("cargo", ((70, 74),)),
    ("tanker", ((80, 85), (89, 89))),
    ("fishing", ((30, 30),)),
    ("passenger", ((60, 69),)),
)

# Receiver-log field names mapped to canonical column names.
LOG_ALIASES = {
    "speed": "sog", "course": "cog", "type": "msg_type", "status": "nav_status",
    "shipname": "name", "callsign": "call_sign", "shiptype": "ship_type",
}
TABLE_ALIASES = {
    "latitude": "lat", "longitude": "lon", "speed": "sog", "course": "cog",
    "timestamp": "time",
}

LOG_FIELDS = T.StructType([
    T.StructField("class", T.StringType()),
    T.StructField("rxtime", T.StringType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("mmsi", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("course", T.DoubleType()),
    T.StructField("heading", T.IntegerType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("accuracy", T.IntegerType()),
    T.StructField("second", T.IntegerType()),
    T.StructField("maneuver", T.IntegerType()),
    T.StructField("raim", T.BooleanType()),
    T.StructField("shipname", T.StringType()),
    T.StructField("shiptype", T.IntegerType()),
    T.StructField("shiptype_text", T.StringType()),
    T.StructField("callsign", T.StringType()),
    T.StructField("imo", T.LongType()),
    T.StructField("to_bow", T.IntegerType()),
    T.StructField("to_stern", T.IntegerType()),
    T.StructField("to_port", T.IntegerType()),
    T.StructField("to_starboard", T.IntegerType()),
    T.StructField("draught", T.DoubleType()),
    T.StructField("destination", T.StringType()),
    T.StructField("eta", T.StringType()),
    T.StructField("partno", T.IntegerType()),
    T.StructField("aid_type", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("off_position", T.BooleanType()),
    T.StructField("virtual_aid", T.BooleanType()),
    T.StructField("channel", T.StringType()),
    T.StructField("safety_text", T.StringType()),
    T.StructField("seq", T.LongType()),
])

REQUIRED_CORE = ("mmsi", "time", "lat", "lon")

VESSEL_DOCUMENT = T.StructType([
    T.StructField("mmsi", T.LongType()),
    T.StructField("segment_id", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("static", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("call_sign", T.StringType()),
        T.StructField("ship_type", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
    ])),
    T.StructField("trajectory", T.ArrayType(T.StructType([
        T.StructField("time", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sog", T.DoubleType()),
        T.StructField("cog", T.DoubleType()),
    ]))),
])
