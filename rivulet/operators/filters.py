"""The filter language: one comparison ``path op literal`` compiled to a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J

#: Searched for in this order anywhere in the text, not leftmost (fixed values).
OPERATORS = ("==", "!=", ">=", "<=", ">", "<", " contains ")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)", re.I)
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


@dataclass(frozen=True)
class Comparison:
    path: str
    op: str
    literal: str

    @property
    def number(self) -> float | None:
        return float(self.literal) if _NUMBER.fullmatch(self.literal) else None


def parse(text: str) -> Comparison:
    text = text.strip()
    for op in OPERATORS:
        lhs, found, rhs = text.partition(op)
        if found:
            lhs = lhs.strip()
            for prefix in ("record.", "payload."):
                lhs = lhs.removeprefix(prefix)
            rhs = rhs.strip()
            if len(rhs) > 1 and rhs[0] == rhs[-1] and rhs[0] in "\"'":
                rhs = rhs[1:-1]
            return Comparison(lhs.strip(), op.strip(), rhs)
    raise ValueError(f"unsupported filter expression: {text}")


def expression_of(config: dict[str, str]) -> str:
    """``filter_expression``, else ``condition``, else the first ``filter:`` line of ``code``."""
    for name in ("filter_expression", "condition"):
        if config.get(name, "").strip():
            return config[name].strip()
    for line in config.get("code", "").splitlines():
        if line.strip().startswith("filter:"):
            return line.strip().removeprefix("filter:").strip().removesuffix(";").strip()
    return ""


def condition(text: str, value: Column, mode: str = "fail") -> Column:
    """Whether a JSON value passes. A missing field passes ``!=`` only. Where an ordering meets
    something that is not numeric: mode ``fail`` raises, ``drop`` drops, ``null`` gives null;
    the same for a value that is not JSON."""
    c = parse(text)
    if c.op in (">", ">=", "<", "<=") and c.number is None:
        raise ValueError(f"right side of {c.op} must be numeric, got {c.literal!r}")
    def bad(message: str) -> Column:
        return {"fail": F.raise_error(F.lit(message)), "drop": F.lit(False), "null": F.lit(None)}[mode].cast("boolean")

    def test(x: Column) -> Column:
        return J.let(F.struct(J.kind_of(x).alias("kind"), J.text_of(x).alias("text")), lambda s: _compare(c, s["kind"], s["text"], bad))

    return J.let(J.parse(value), lambda v: F.when(v.isNull(), bad("payload is not JSON")).otherwise(test(J.get_fold(v, c.path))))


def _compare(c: Comparison, kind: Column, text: Column, bad) -> Column:
    shown = F.coalesce(text, F.lit("<nil>"))
    if c.op in ("==", "!="):
        same = F.when(kind == "string", F.lower(text) == c.literal.lower())
        if c.literal in _TRUE + _FALSE:
            same = same.when(kind == "bool", (text == "true") == F.lit(c.literal in _TRUE))
        else:
            same = same.when(kind == "bool", text == c.literal.lower())
        if c.number is not None:
            same = same.when(kind == "number", text.try_cast("double") == c.number)
        same = same.otherwise(shown == c.literal)
        hit = same if c.op == "==" else ~same
    elif c.op == "contains":
        hit = F.contains(F.lower(shown), F.lit(c.literal.lower()))
    else:
        n = F.when(kind.isin("number", "string"), text.try_cast("double"))
        compare = {">": n > c.number, ">=": n >= c.number, "<": n < c.number, "<=": n <= c.number}[c.op]
        hit = F.when(n.isNull(), bad("field is not numeric")).otherwise(compare)
    return F.when(kind.isNull(), F.lit(c.op == "!=")).otherwise(hit)


def filter_log(log: DataFrame, text: str, mode: str = "fail") -> DataFrame:
    """Rows whose value passes; an empty expression keeps all."""
    return log.where(condition(text, F.col("value"), mode)) if text.strip() else log


def not_blank(value: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(value.cast("string"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")) > 0, F.lit(False))
