"""Scalar column functions of the load and report stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Volts per count of a 16-bit converter at 3.3 V; counts per unit of acceleration and of a quaternion part.
VOLTS_PER_COUNT = 3.3 / 65535
ACCELERATION_COUNTS = 1000
QUATERNION_COUNTS = 10000


def volts(raw: Column) -> Column:
    return raw.cast("double") * VOLTS_PER_COUNT


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def euler_degrees(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw of a unit quaternion, rotations about fixed axes in the order x, y, z."""
    roll = F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))
    pitch = F.degrees(F.asin(F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))))
    yaw = F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))
    return roll, pitch, yaw


def iso_millis(ms: Column) -> Column:
    """UTC time of epoch milliseconds; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def str2bool(text: Column) -> Column:
    """true, yes, 1 / false, no, 0 in any case; anything else is an error."""
    low = F.lower(text)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False).when(low.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), text)).cast("boolean"))


def time_axis(idx: Column, n: Column, fs: float) -> tuple[Column, Column]:
    """Place of a sample on a readable axis, and its unit: seconds below 120 s, minutes below 7200 s, else hours."""
    total = n / F.lit(fs)
    unit = F.when(total < 120, "sec").when(total < 7200, "min").otherwise("hour")
    scale = F.when(total < 120, 1.0).when(total < 7200, 60.0).otherwise(3600.0)
    return idx / F.lit(fs) / scale, unit


def split_uri(uri: Column) -> tuple[Column, Column]:
    """Bucket (authority) and key (path without leading slashes) of a URI; no bucket is an error."""
    bucket = F.parse_url(uri, F.lit("AUTHORITY"))
    bucket = F.when(F.coalesce(bucket, F.lit("")) != "", bucket).otherwise(F.raise_error(F.lit("a URI without a bucket")).cast("string"))
    return bucket, F.ltrim(F.parse_url(uri, F.lit("PATH")), F.lit("/"))
