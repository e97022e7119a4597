"""Per-record JSON transforms: masking, mapping, key case, and a slot for user functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J
from rivulet.operators import filters
from rivulet.session import ship_active

#: Fields masked when none are named (fixed values).
SENSITIVE = ("ssn", "credit_card", "password", "email", "cvv", "phone", "secret", "token", "auth_token")


def members(value: Column) -> Column:
    """Top-level fields of a JSON object as map<string, variant>; null where it is none."""
    return F.try_variant_get(J.parse(value), "$", "map<string,variant>")


def render(fields: Column) -> Column:
    """JSON text of a map of variants, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))


def text_variant(text: Column) -> Column:
    """Variant that holds a string."""
    return F.parse_json(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"([\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"')))


def names(listed: str | None) -> frozenset[str]:
    got = [x.strip().lower() for x in (listed or "").split(",") if x.strip()]
    return frozenset(got or SENSITIVE)


def mask_flat(value: Column, listed: str | None = None, pattern: str = "***") -> Column:
    """Masks sensitive top-level fields, JVM-side. For values known to be flat."""
    hide = [F.lit(n) for n in sorted(names(listed))]
    shown = F.transform_values(members(value), lambda k, v: F.when(F.array_contains(F.array(*hide), F.lower(F.trim(k))), text_variant(F.lit(pattern))).otherwise(v))
    return render(shown)


def mask_nested(listed: str | None = None, pattern: str = "***") -> Callable[[Column], Column]:
    """Masks sensitive fields at any depth, in objects and arrays, whole subtrees at a time.

    Recursion over unknown shapes has no built-in, so this is an Arrow-batched pandas
    UDF. A value that is not JSON fails.
    """
    ship_active()
    hide = names(listed)

    def hidden(x):
        if isinstance(x, dict):
            return {k: pattern if k.strip().lower() in hide else hidden(v) for k, v in x.items()}
        return [hidden(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else json.dumps(hidden(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return lambda value: run(value.cast("string"))


@dataclass(frozen=True)
class JsonMap:
    """Added fields, set fields, renames in order, then removals; all injected values are strings."""

    add: dict[str, str] = field(default_factory=dict)
    set: dict[str, str] = field(default_factory=dict)
    rename: tuple[tuple[str, str], ...] = ()
    remove: tuple[str, ...] = ()
    now: str | None = None
    engine: str = "rivulet"

    @staticmethod
    def of(config: dict[str, str], now: str | None = None) -> JsonMap:
        pairs = lambda s: tuple(tuple(y.strip() for y in x.split(":", 1)) for x in s.split(",") if ":" in x)
        return JsonMap(
            dict(pairs(config.get("add_fields", ""))),
            {k.removeprefix("set_"): v for k, v in config.items() if k.startswith("set_")},
            pairs(config.get("rename_fields", "")),
            tuple(x.strip() for x in config.get("remove_fields", "").split(",") if x.strip()),
            now,
        )

    def __call__(self, value: Column) -> Column:
        stamp = {"_transformed_at": self.now, "_engine": self.engine} if self.now else {}
        m = members(value)
        if put_ := stamp | self.add | self.set:
            made = F.create_map(*[x for k, v in put_.items() for x in (F.lit(k), text_variant(F.lit(v)))])
            m = F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(*put_)), made)
        if self.rename:
            # a fold over the renames: the map is one variable, however many there are
            m = F.aggregate(F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in self.rename]), m, renamed)
        if self.remove:
            m = F.map_filter(m, lambda k, _: ~k.isin(*self.remove))
        return render(m)


def renamed(m: Column, r: Column) -> Column:
    """``m`` with key r.old, if there, moved over r.new."""
    rest = F.map_filter(m, lambda k, _: (k != r["old"]) & (k != r["new"]))
    moved = F.map_concat(rest, F.map_from_arrays(F.array(r["new"]), F.array(F.try_element_at(m, r["old"]))))
    return F.when(F.map_contains_key(m, r["old"]), moved).otherwise(m)


def uppercased(m: Column) -> Column:
    """Keys in upper case; of two that become equal the last in key order stays."""
    sorted_ = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    groups = J.let(sorted_, lambda e: F.map_from_arrays(F.transform(e, lambda x: x["key"]), F.transform(e, lambda x: F.upper(x["key"]))))

    def last(up: Column) -> Column:
        """Whether no later key has the same upper case."""
        return F.map_filter(m, lambda k, _: ~F.exists(F.map_keys(up), lambda o: (o > k) & (F.try_element_at(up, o) == F.upper(k))))

    return F.transform_keys(J.let(groups, last), lambda k, _: F.upper(k))


def uppercase_keys(value: Column) -> Column:
    """Top-level keys in upper case."""
    return render(uppercased(members(value)))


#: Report of the user-function slot (fixed values).
EXECUTION = '{"runtime":"wazero-wasm32-wasi","status":"COMPLETED","gas_used":318,"execution_us":48,"source_module":%s}'


def run_module(value: Column, module: str, action: str = "") -> Column:
    """The user-function slot without a function: an object's keys in upper case if ``action`` is
    uppercase_keys, and a report of the run; anything else as text after a comment line."""
    report = F.parse_json(F.lit(EXECUTION % json.dumps(module)))
    m = members(value)
    m = uppercased(m) if action == "uppercase_keys" else m
    made = render(F.map_concat(F.map_filter(m, lambda k, _: k != "_wasm_execution"), F.create_map(F.lit("_wasm_execution"), report)))
    return F.coalesce(made, F.concat(F.lit(f"// WASM Processed by {module}\n"), value.cast("string")))


#: Tokens of compact JSON: empty containers, strings, marks, other values.
_TOKENS = r'\{\}|\[\]|"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"]+'


def indent(compact: Column) -> Column:
    """Compact JSON text with two spaces a level, as the REST output has it: ``<``, ``>`` and ``&``
    escaped, empty containers on one line. A fold over the tokens, JVM-side."""
    for c in "<>&":
        compact = F.replace(compact, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        text = (
            F.when(t.isin("{", "["), F.concat(t, line(depth))).when(t.isin("}", "]"), F.concat(line(depth), t))
            .when(t == ",", F.concat(t, line(depth))).when(t == ":", F.lit(": ")).otherwise(t)
        )
        return F.struct(depth.cast("int").alias("depth"), F.concat(acc["text"], text).alias("text"))

    tokens = F.regexp_extract_all(compact, F.lit(_TOKENS), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.when(compact.isNotNull(), F.aggregate(tokens, start, step, lambda acc: acc["text"]))


def map_upper(value: Column) -> Column:
    return F.upper(value.cast("string"))


def checksum(value: Column) -> Column:
    text = value.cast("string")
    return F.struct(F.sha2(value.cast("binary"), 256).alias("sha256"), F.substring(text, 1, 100).alias("preview"), F.length(text).alias("length"))


def exactly_once(value: Column, txn: Column) -> Column:
    """Processed payload with its digest and the digest of what it was made from."""
    made = F.concat(F.lit("EOS_PROCESSED::"), value.cast("string"), F.lit("::TXN_"), txn.cast("string"))
    return F.struct(made.alias("data"), F.sha2(made, 256).alias("checksum"), F.sha2(value.cast("binary"), 256).alias("source_checksum"))


#: Transform types (fixed values).
TYPES = ("FILTER", "MASK_PII", "JSON_MAP", "UDF")


@dataclass
class Transform:
    """A registered transform from one topic to another."""

    name: str
    type: str
    source_topic: str
    target_topic: str
    config: dict[str, str] = field(default_factory=dict)
    udf: Callable[[Column], Column] | None = None
    paused: bool = False

    def run(self, log: DataFrame, now: str | None = None) -> DataFrame:
        rows = log.where(F.col("topic") == self.source_topic)
        if self.type == "FILTER":
            rows = filters.filter_log(rows, filters.expression_of(self.config))
        else:
            rows = rows.withColumn("value", self.output(now)(F.col("value")).cast("binary"))
        return rows.withColumn("topic", F.lit(self.target_topic))

    def output(self, now: str | None) -> Callable[[Column], Column]:
        """What comes out: JSON indented, text that is no JSON and what a user function returns as it is."""
        made = self.column(now)
        if self.type == "UDF" and self.udf:
            return made
        return lambda value: J.let(made(value), lambda x: F.when(x.startswith("//"), x).otherwise(indent(x)))

    def column(self, now: str | None) -> Callable[[Column], Column]:
        if self.type == "MASK_PII":
            return mask_nested(self.config.get("fields_to_mask"), self.config.get("mask_pattern", "***"))
        if self.type == "JSON_MAP":
            return JsonMap.of(self.config, now)
        if self.type == "UDF":
            return self.udf or (lambda value: run_module(value, self.name, self.config.get("action", "")))
        raise ValueError(f"unknown transform type {self.type!r}")


class Transforms:
    """Registry: create, get, list, pause, resume, delete, test."""

    def __init__(self) -> None:
        self._by: dict[str, Transform] = {}

    def create(self, t: Transform) -> None:
        if t.type not in TYPES:
            raise ValueError(f"unknown transform type {t.type!r}")
        if t.name in self._by:
            raise KeyError(f"transform {t.name!r} exists")
        self._by[t.name] = t

    def get(self, name: str) -> Transform:
        return self._by[name]

    def list(self) -> list[Transform]:
        return [self._by[k] for k in sorted(self._by)]

    def pause(self, name: str, paused: bool = True) -> None:
        self._by[name].paused = paused

    def delete(self, name: str) -> None:
        del self._by[name]

    def test(self, name: str, payloads: DataFrame) -> DataFrame:
        """output and drop of each row of ``payloads`` (value); runs even if paused."""
        t = self._by[name]
        if t.type == "FILTER":
            keep = filters.condition(filters.expression_of(t.config), F.col("value"))
            return payloads.select("value", F.when(keep, F.col("value").cast("string")).alias("output"), (~keep).alias("drop"))
        return payloads.select("value", t.output(None)(F.col("value")).alias("output"), F.lit(False).alias("drop"))
