"""JSON value rules as Column builders over ``VARIANT``; nothing here runs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(value: Column) -> Column:
    """Variant of a JSON text (string or binary); null where it is not JSON."""
    return F.try_parse_json(value.cast("string"))


def step(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"path segment cannot hold quotes: {name!r}")
    return f"['{name}']"


def path(dotted: str) -> str:
    """Dotted path through objects only; case-sensitive; no array index."""
    return "$" + "".join(step(p) for p in dotted.split("."))


def get(v: Column, dotted: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path(dotted), kind)


def get_fold(v: Column, dotted: str) -> Column:
    """As :func:`get`, each segment falling back to a key equal but for case (the smallest such).

    A fold over the segments, so the expression does not grow with the path."""

    def step_fold(at: Column, name: Column) -> Column:
        def pick(members: Column) -> Column:
            fold = F.array_min(F.filter(F.map_keys(members), lambda k: F.lower(k) == F.lower(name)))
            return F.try_element_at(members, F.when(F.map_contains_key(members, name), name).otherwise(fold))

        return let(F.try_variant_get(at, "$", "map<string,variant>"), pick)

    return F.aggregate(F.array(*[F.lit(n) for n in dotted.split(".")]), v, step_fold)


def kind_of(v: Column) -> Column:
    """string, bool, number, null, object, array; SQL null where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "bool")
        .when(s == "VOID", "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s.isNotNull(), "number")
    )


def to_double(v: Column) -> Column:
    """Number as is, string parsed, bool 1 or 0, anything else null."""
    k = kind_of(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(k.isin("number", "string"), text.try_cast("double")).when(k == "bool", F.when(text == "true", 1.0).otherwise(0.0))


def text_of(v: Column) -> Column:
    """Text of a value: numbers plain, without exponent or trailing zeros; null for JSON null."""
    text = F.try_variant_get(v, "$", "string")
    plain = F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when((kind_of(v) == "number") & text.rlike(r"\.0$|E"), F.coalesce(plain, text)).otherwise(text)


def to_key(v: Column) -> Column:
    """String as is, number without trailing zeros, null or missing empty, else compact JSON."""
    return F.coalesce(text_of(v), F.lit(""))


def to_millis(v: Column) -> Column:
    """Epoch milliseconds: numbers under 1e11 are seconds; strings RFC 3339, else numeric."""
    text = F.try_variant_get(v, "$", "string")
    n = F.when(kind_of(v).isin("number", "string"), text.try_cast("double"))
    number = F.when(n < 1e11, (n * 1000).cast("long")).otherwise(n.cast("long"))
    stamp = F.when((kind_of(v) == "string") & text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.unix_millis(text.try_cast("timestamp")))
    return F.coalesce(stamp, number)


def key_of(v: Column, field: str | None, record_key: Column) -> Column:
    """Record key if no field is named, else the path's value; empty where missing."""
    return F.coalesce(record_key, F.lit("")) if not field else to_key(get(v, field))


def event_time(v: Column, field: str | None, record_ms: Column) -> Column:
    return record_ms if not field else F.coalesce(to_millis(get(v, field)), record_ms)


def typed(v: Column, name: str, kind: str) -> Column:
    """Top-level field as string, long, int, double or boolean; null on mismatch.

    String takes JSON text of other values; long and int truncate numbers (int wraps
    to 32 bits); double takes numbers, boolean booleans.
    """
    x = get(v, name)
    k = kind_of(x)
    text = F.try_variant_get(x, "$", "string")
    number = F.when(k == "number", F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long")))
    if kind == "string":
        return F.when(k != "null", text_of(x))
    if kind == "long":
        return number
    if kind == "int":
        low = number.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
    if kind == "double":
        return F.when(k == "number", text.try_cast("double"))
    if kind == "boolean":
        return F.when(k == "bool", text == "true")
    raise ValueError(f"unknown field type {kind!r}")
