"""Column rules for wire values: attribute values, ids, enumerations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire enumerations.
SPAN_KINDS = {2: "SERVER", 3: "CLIENT", 4: "PRODUCER", 5: "CONSUMER"}
STATUS_CODES = {1: "OK", 2: "ERROR"}
TEMPORALITIES = {1: "DELTA", 2: "CUMULATIVE"}
PROFILE_KINDS = {1: "CPU", 2: "WALL", 3: "ALLOC", 4: "LOCK", 5: "GC"}
SEVERITY_NAMES = {1: "TRACE", 5: "DEBUG", 9: "INFO", 13: "WARN", 17: "ERROR", 21: "FATAL"}
APP_LOG_LEVELS = {"Trace": 1, "Debug": 5, "Information": 9, "Warning": 13, "Error": 17, "Critical": 21}


def named(number: Column, names: dict, default: str) -> Column:
    """Name of an enumeration value."""
    out = F.lit(default)
    for key, name in names.items():
        out = F.when(number == key, name).otherwise(out)
    return out


def span_kind(kind: Column) -> Column:
    return named(kind, SPAN_KINDS, "INTERNAL")


def span_status(code: Column) -> Column:
    return named(code, STATUS_CODES, "UNSET")


def infer_server_error_status(kind: Column, status: Column, http_status: Column) -> Column:
    """A server span without a status that answered 5xx counts as failed."""
    return F.when((kind == "SERVER") & (status == "UNSET") & (http_status >= 500), "ERROR").otherwise(status)


def default_severity_text(text: Column, number: Column) -> Column:
    """Given text, else the name of an exact severity number."""
    return F.when(F.coalesce(text, F.lit("")) == "", named(number, SEVERITY_NAMES, "")).otherwise(text)


def severity_of_log_level(level: Column) -> Column:
    """Severity number of an application log level, 0 when unknown."""
    return named(level, APP_LOG_LEVELS, "0").cast("int")


def hex_id(text: Column, digits: int | None = None) -> Column:
    """Lower-case hex id, '' when missing or, if ``digits`` is given, of another length."""
    value = F.lower(F.coalesce(text, F.lit("")))
    return value if digits is None else F.when(F.length(value) == digits, value).otherwise("")


def int64(text: Column) -> Column:
    """Quoted 64-bit integer, 0 when missing."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def double_text(value: Column) -> Column:
    """Shortest text of a double: no trailing ``.0``, exponents only outside 1e-5 .. 1e15."""
    raw = value.cast("string")
    size = F.abs(value)
    whole = (value == F.floor(value)) & (size < 1e15)
    plain = F.regexp_replace(F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), "0+$", ""), "\\.$", "")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), "\\.0$", "")
    exponent = F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    digits = F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), F.abs(exponent))).otherwise(F.abs(exponent).cast("string"))
    return (
        F.when(value.isNull() | ~F.contains(raw, F.lit("E")) & ~whole, raw)
        .when(whole, value.try_cast("bigint").cast("string"))
        .when((size >= 1e-5) & (size < 1e15), plain)
        .otherwise(F.concat(mantissa, F.lit("E"), sign, digits))
    )


def any_value_to_string(value: Column, with_bytes: bool = True) -> Column:
    """Text of a wire value; '' for none, lists and (without ``with_bytes``) byte strings."""
    options = [
        value["string_value"],
        value["int_value"],
        double_text(value["double_value"]),
        F.when(value["bool_value"], "true").when(~value["bool_value"], "false"),
    ]
    if with_bytes:
        options.append(F.base64(value["bytes_value"]))
    return F.coalesce(*options, F.lit(""))


def any_value_to_int(value: Column) -> Column:
    """Integer of a wire value: doubles are cut, text is parsed; null when it has none."""
    return F.coalesce(
        value["int_value"].try_cast("bigint"),
        value["double_value"].try_cast("bigint"),
        F.trim(value["string_value"]).try_cast("bigint"),
    )


def texts(attributes: Column, with_bytes: bool = True) -> Column:
    """Attributes as an array of (key, text)."""
    pairs = F.transform(
        attributes,
        lambda kv: F.struct(F.coalesce(kv["key"], F.lit("")).alias("key"), any_value_to_string(kv["value"], with_bytes).alias("text")),
    )
    return F.coalesce(pairs, F.array().cast("array<struct<key:string,text:string>>"))


def by_key(pairs: Column) -> Column:
    """Map of (key, text) pairs, the last duplicate winning (``spark.sql.mapKeyDedupPolicy``)."""
    return F.map_from_entries(pairs)


def text_of(attributes: Column, key: str) -> Column:
    """Text under a key of such a map, '' without one."""
    return F.coalesce(F.try_element_at(attributes, F.lit(key)), F.lit(""))


def first_filled(pairs: Column, keys: Sequence[str]) -> Column:
    """First non-empty text among several keys, '' without one."""
    found = F.filter(pairs, lambda kv: kv["key"].isin(list(keys)) & (kv["text"] != ""))
    return F.coalesce(F.try_element_at(found, F.lit(1))["text"], F.lit(""))


def keys_of(pairs: Column) -> Column:
    return pairs["key"]


def texts_of(pairs: Column) -> Column:
    return pairs["text"]


def json_object(pairs: Column) -> Column:
    """Flat JSON object of strings keeping order and duplicate keys."""
    # One-entry maps let Spark do the escaping; the braces of each are cut off.
    entry = lambda kv: F.regexp_replace(
        F.to_json(F.create_map(F.coalesce(kv["key"], F.lit("")), kv["text"])), r"^\{|\}$", ""
    )
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, entry), ","), F.lit("}"))
