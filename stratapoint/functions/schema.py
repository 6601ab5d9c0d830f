"""The fixed vocabulary of point dimensions and the schemas of point formats."""

from __future__ import annotations

from pyspark.sql import types as T

from ..model import InvalidInput

# fixed values: dimensions in layout order with their Spark types and unsigned widths
DIMENSIONS: dict[str, T.DataType] = {
    "x": T.DoubleType(), "y": T.DoubleType(), "z": T.DoubleType(), "intensity": T.IntegerType(), "return_number": T.ShortType(), "number_of_returns": T.ShortType(),
    "classification": T.ShortType(), "scan_direction_flag": T.BooleanType(), "edge_of_flight_line": T.BooleanType(), "scan_angle": T.FloatType(), "user_data": T.ShortType(),
    "point_source_id": T.IntegerType(), "synthetic": T.BooleanType(), "key_point": T.BooleanType(), "withheld": T.BooleanType(), "overlap": T.BooleanType(),
    "scan_channel": T.ShortType(), "gps_time": T.DoubleType(), "red": T.IntegerType(), "green": T.IntegerType(), "blue": T.IntegerType(), "nir": T.IntegerType(),
    "wave_packet_index": T.ShortType(), "wave_packet_offset": T.DecimalType(20, 0), "wave_packet_size": T.LongType(), "wave_return_location": T.FloatType(), "extra_bytes": T.BinaryType(),
}
CORE = list(DIMENSIONS)[:17]
XYZ = ["x", "y", "z"]
# fixed values: optional blocks of each point format: gps time, colour, near infrared, waveform
FORMATS = {0: "", 1: "g", 2: "c", 3: "gc", 4: "gw", 5: "gcw", 6: "g", 7: "gc", 8: "gcn", 9: "gw", 10: "gcnw"}
BASE_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
UNSIGNED = {"intensity": 16, "point_source_id": 16, "red": 16, "green": 16, "blue": 16, "nir": 16, "classification": 8, "user_data": 8, "return_number": 4, "number_of_returns": 4, "scan_channel": 2}


def layout(point_format: int, extra: int = 0) -> list[str]:
    """Dimensions of a point format in layout order."""
    if point_format not in FORMATS:
        raise InvalidInput(f"point format {point_format} is not known")
    has = FORMATS[point_format]
    out = list(CORE)
    for mark, names in (("g", ["gps_time"]), ("c", ["red", "green", "blue"]), ("n", ["nir"]), ("w", ["wave_packet_index", "wave_packet_offset", "wave_packet_size", "wave_return_location"])):
        out += names if mark in has else []
    return out + ["extra_bytes"] * bool(extra)


def schema_for_format(point_format: int, extra: int = 0) -> T.StructType:
    return T.StructType([T.StructField(d, DIMENSIONS[d]) for d in layout(point_format, extra)])


def selection(wanted: list[str] | None) -> list[str]:
    """Distinct known dimensions in the order asked for; None means all."""
    names = list(DIMENSIONS) if wanted is None else list(dict.fromkeys(wanted))
    if unknown := [n for n in names if n not in DIMENSIONS]:
        raise InvalidInput(f"unknown dimensions: {', '.join(unknown)}")
    return names


def projected(columns: list[str], wanted: list[str] | None) -> list[str]:
    """What a projection returns: layout order, dimensions that are absent are skipped."""
    names = set(selection(wanted))
    return [c for c in columns if c in names]


def check_schema(schema: T.StructType, exact: bool = False) -> None:
    """Raise unless the columns are dimensions with matching types (integers may be wider unless ``exact``)."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    for f in schema.fields:
        want = DIMENSIONS.get(f.name)
        if want is None or f.dataType == want:
            continue
        if exact or not (isinstance(f.dataType, whole) and isinstance(want, (*whole, T.BooleanType)) or isinstance(f.dataType, (T.FloatType, T.DoubleType)) and isinstance(want, (T.FloatType, T.DoubleType))):
            raise InvalidInput(f"column {f.name} is {f.dataType.simpleString()}, expected {want.simpleString()}")
