"""Distances, signatures and tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
FRESH_DAYS, STALE_DAYS = 30, 90


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_hex(text: Column) -> Column:
    """Up to 16 hexadecimal digits as the signed bigint of the same bits; null for anything else."""
    padded = F.lpad(text, 16, "0")
    half = lambda at: F.conv(F.substring(padded, at, 8), 16, 10).cast("bigint")
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def signature64(vector: Column) -> Column:
    """The signs of a vector's first 64 parts, as bits of a bigint."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, n: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), n)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, bit: acc.bitwiseOR(bit))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def upright_size(width: Column, height: Column, orientation: Column, rotation: Column) -> Column:
    """struct(width, height), swapped once if either the tag or the container's rotation turns the picture."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False)) | F.coalesce(rotation.isin(1, 3, 90, 270), F.lit(False))
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(turned, pair(height, width)).otherwise(pair(width, height))


def age_days(at: Column, now: Column) -> Column:
    """Whole days, never under zero."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    return F.greatest(F.floor(seconds / 86400), F.lit(0))


def custody_tier(days: Column) -> Column:
    """fresh, softening or stale; undated counts as fresh."""
    return F.when(days >= STALE_DAYS, "stale").when(days >= FRESH_DAYS, "softening").otherwise("fresh")


def clean(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def geo_point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon) if both are numbers; 0.0 is one."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon")))
