"""Typed leaves: stored values as a struct of ok, canon and error, and keys that sort as the type does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .xpath import java_pattern

# Bounds of the integer types.
INTEGERS = {
    "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647),
    "int64": (-9223372036854775808, 9223372036854775807), "uint8": (0, 255), "uint16": (0, 65535),
    "uint32": (0, 4294967295), "uint64": (0, 18446744073709551615),
}


def _stored(canon: Column, ok: Column, error: str) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, canon).alias("canon"), F.when(~ok, F.lit(error)).alias("error"))


def in_ranges(x: Column, ranges: list[tuple]) -> Column:
    """Within one of the closed intervals; None leaves a side open."""
    out = F.lit(False)
    for low, high in ranges:
        part = F.lit(True)
        if low is not None:
            part &= x >= low
        if high is not None:
            part &= x <= high
        out |= part
    return out


def store_integer(s: Column, kind: str, ranges: list[tuple] | None = None) -> Column:
    value = F.when(F.rlike(F.trim(s), F.lit(r"^[+-]?[0-9]+$")), F.trim(s)).try_cast("decimal(38,0)")
    ok = in_ranges(value, [tuple(F.lit(str(v)).cast("decimal(38,0)") for v in INTEGERS[kind])])
    return _stored(value.cast("string"), ok & (in_ranges(value, ranges) if ranges else F.lit(True)), f"not a valid {kind}")


def store_decimal(s: Column, digits: int, ranges: list[tuple] | None = None) -> Column:
    """Fixed point with at most ``digits`` fractional digits; the canonical form has at least one."""
    shape = F.rlike(F.trim(s), F.lit(rf"^[+-]?[0-9]+(\.[0-9]{{1,{digits}}}0*)?$"))
    value = F.when(shape, F.trim(s)).try_cast(f"decimal(19,{digits})")
    canon = F.regexp_replace(F.regexp_replace(value.cast("string"), "0+$", ""), r"\.$", ".0")
    return _stored(canon, value.isNotNull() & (in_ranges(value, ranges) if ranges else F.lit(True)), "not a valid decimal64")


def store_string(s: Column, length: list[tuple] | None = None, patterns: list[tuple[str, bool]] = ()) -> Column:
    """Length in code points; each pattern comes with whether it must match."""
    ok = s.isNotNull()
    if length:
        ok &= in_ranges(F.length(s), length)
    for pattern, wanted in patterns:
        ok &= F.rlike(s, F.lit(java_pattern(pattern))) == F.lit(wanted)
    return _stored(s, ok, "not a valid string")


def store_boolean(s: Column) -> Column:
    return _stored(s, s.isin("true", "false"), "not a valid boolean")


def store_empty(s: Column) -> Column:
    return _stored(s, s == "", "not a valid empty")


def store_enum(s: Column, names: list[str]) -> Column:
    return _stored(s, s.isin(*names), "not a valid enumeration")


def store_bits(s: Column, names: list[str]) -> Column:
    """Names by position, none twice."""
    given = F.filter(F.split(F.trim(s), "[ \t\r\n]+"), lambda x: x != "")
    ordered = F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(given, n))
    return _stored(F.array_join(ordered, " "), F.size(given) == F.size(ordered), "not valid bits")


def store_binary(s: Column, length: list[tuple] | None = None) -> Column:
    """Base64 with line breaks allowed; length in bytes."""
    packed = F.regexp_replace(s, "[\r\n]", "")
    raw = F.try_to_binary(packed, F.lit("base64"))
    return _stored(packed, raw.isNotNull() & (in_ranges(F.octet_length(raw), length) if length else F.lit(True)), "not valid binary")


def _octets(s: Column) -> Column:
    return F.transform(F.split(s, "[.]"), lambda x: x.try_cast("int"))


def _dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(n, b).bitwiseAND(F.lit(255)).cast("string") for b in (24, 16, 8, 0)])


def _address(s: Column) -> tuple[Column, Column]:
    """Whether a text is four decimal octets without needless zeros, and their number."""
    octet = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    shape = F.rlike(s, F.lit(rf"^{octet}(\.{octet}){{3}}$"))
    return shape, F.aggregate(_octets(s), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)


def store_ipv4_address(s: Column) -> Column:
    """Four octets, with a zone after % kept as it is."""
    plain = F.substring_index(s, "%", 1)
    ok = _address(plain)[0] & (~F.contains(s, F.lit("%")) | F.rlike(s, F.lit(r"%[\p{N}\p{L}]+$")))
    return _stored(s, ok, "not a valid ipv4-address")


def store_ipv4_prefix(s: Column) -> Column:
    """Address and length; the bits beyond the length become zero."""
    plain, bits = F.substring_index(s, "/", 1), F.regexp_extract(s, "/([0-9]|[12][0-9]|3[0-2])$", 1).try_cast("int")
    shape, number = _address(plain)
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    canon = F.concat(_dotted(number - number % size), F.lit("/"), bits.cast("string"))
    return _stored(canon, shape & bits.isNotNull() & (F.concat(plain, F.lit("/"), bits.cast("string")) == s), "not a valid ipv4-prefix")


def store_date_and_time(s: Column, z_is_unknown: bool = False) -> Column:
    """An instant, printed in UTC with the fraction as written: equal instants have equal forms, in whatever zone they come.

    The zone -00:00, and with ``z_is_unknown`` (the later revision of the type) also Z, says that the local zone is not
    known; it is kept apart, as -00:00 or Z. A zone has up to 23 hours and 59 minutes; the sign counts for hours only, so
    -00:30 is half an hour ahead. A 60th second is the next minute's first.
    """
    # One pattern tells the shape; in it everything but the fraction has its place.
    shape = F.rlike(s, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"))
    zulu = F.endswith(s, F.lit("Z"))

    def num(at: int, size: int = 2) -> Column:
        return F.substring(s, at, size).try_cast("bigint")

    day = F.substring(s, 1, 10).try_cast("date")
    hours, minutes = F.when(zulu, 0).otherwise(num(-6, 3)), F.when(zulu, 0).otherwise(num(-2))
    ok = shape & day.isNotNull() & (num(12) < 24) & (num(15) < 60) & (num(18) <= 60) & (F.abs(hours) < 24) & (minutes < 60)
    ahead = hours * 3600 + F.when(hours < 0, -minutes).otherwise(minutes) * 60
    total = F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + num(12) * 3600 + num(15) * 60 + num(18) - ahead
    # Added to a timestamp without a zone, which no session's zone moves.
    moment = (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.expr("INTERVAL '1' SECOND") * total).cast("string")
    fraction = F.substring(s, F.lit(20), F.length(s) - F.when(zulu, 20).otherwise(25))
    unknown = F.endswith(s, F.lit("-00:00")) | (zulu & F.lit(z_is_unknown))
    zone = F.when(unknown, "Z" if z_is_unknown else "-00:00").otherwise("+00:00")
    return _stored(F.concat(F.replace(moment, F.lit(" "), F.lit("T")), fraction, zone), ok, "not a valid date-and-time")


def store_union(*members: Column) -> Column:
    """The first member that stores the value, with its number."""
    out = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("canon"), F.lit("no union member fits").alias("error"), F.lit(-1).alias("member"))
    for i, m in reversed(list(enumerate(members))):
        out = F.when(m["ok"], F.struct(m["ok"].alias("ok"), m["canon"].alias("canon"), m["error"].alias("error"), F.lit(i).alias("member"))).otherwise(out)
    return out


def same_value(a: Column, b: Column) -> Column:
    """Equality of stored values: both are valid and canonical texts are equal, however they were written."""
    return F.coalesce(a["ok"] & b["ok"] & (a["canon"] == b["canon"]), F.lit(False))


def sort_key(canon: Column, kind: str, values: dict[str, int] | None = None) -> Column:
    """Bytes whose order is the type's order: fixed-width numbers, instants with their fraction, enumerations by their
    ``values``, addresses by their octets and zones, texts as they are."""
    if kind == "date-and-time":
        fraction = F.rtrim(F.regexp_extract(canon, r"\.([0-9]+)", 1), F.lit("0"))
        return F.encode(F.concat(F.substring(canon, 1, 19), F.lit("."), fraction), "UTF-8")
    if kind == "enumeration":
        pairs = [F.lit(x) for kv in (values or {}).items() for x in kv]
        return F.encode(F.lpad((F.create_map(*pairs)[canon].cast("bigint") + (1 << 31)).cast("string"), 10, "0"), "UTF-8")
    if kind == "ipv4-address":
        zone = F.regexp_extract(canon, "%.*$", 0)
        return F.encode(F.concat(F.lpad(_address(F.substring_index(canon, "%", 1))[1].cast("string"), 10, "0"), zone), "UTF-8")
    if kind in ("ipv6-address", "ipv6-prefix"):
        from . import inet6

        return inet6.sort_key(canon)
    if kind in INTEGERS:
        shifted = canon.cast("decimal(38,0)") + F.lit(str(1 << 64)).cast("decimal(38,0)")
        return F.encode(F.lpad(shifted.cast("string"), 21, "0"), "UTF-8")
    if kind == "decimal64":
        scaled = canon.cast("decimal(38,18)") + F.lit("10000000000000000000").cast("decimal(38,18)")
        return F.encode(F.lpad(scaled.cast("string"), 39, "0"), "UTF-8")
    return F.encode(canon, "UTF-8")


def same_instant(a: Column, b: Column) -> Column:
    """Whether two stored date-and-times are one instant; 0.5 and 0.50 seconds are the same, an unknown zone is another."""
    known = F.endswith(a["canon"], F.lit("+00:00")) == F.endswith(b["canon"], F.lit("+00:00"))
    return F.coalesce(a["ok"] & b["ok"] & known & (sort_key(a["canon"], "date-and-time") == sort_key(b["canon"], "date-and-time")), F.lit(False))


def ranked(df: DataFrame, key: Column, out: str = "pos") -> DataFrame:
    """Numbers all rows from 1 in the order of ``key``: ranges are sorted apart, and each starts after the rows of
    those before it. Only one count per range meets in one place."""
    here = df.withColumn("_key", key)
    here = here.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()).persist()
    counts = here.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return here.withColumn("_in", inside).join(starts, "_part").withColumn(out, F.col("_ahead") + F.col("_in")).select(*df.columns, out)
