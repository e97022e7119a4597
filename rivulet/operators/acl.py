"""Access rules evaluated as a query: deny, then role, then allow, then refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J

#: Parts of a glob: an escaped character, a class, a wildcard, any other character.
_PARTS = r"\\.|\[\^?(?:\\.|[^\]\\])+\]|[*?]|[^\\]"


def glob(pattern: Column) -> Column:
    """Regular expression of a glob with ``*``, ``?``, ``[..]``, ``[^..]`` and backslash escapes; stars and
    question marks stop at ``/``. A pattern with an open class or a lone backslash matches nothing."""

    def part(p: Column) -> Column:
        plain = F.when(p.rlike(r"^[A-Za-z0-9_ ]$"), p).otherwise(F.concat(F.lit("\\"), p))
        # inside a class only ^ at its start and - between characters keep their meaning
        listed = F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), r"([\[&])", r"\\$1")
        escaped = F.when(F.substring(p, 2, 1).rlike("[A-Za-z0-9]"), F.substring(p, 2, 1)).otherwise(p)
        return (
            F.when(F.length(p) == 1, F.when(p == "*", "[^/]*").when(p == "?", "[^/]").otherwise(plain))
            .when(p.startswith("["), F.concat(F.lit("["), listed, F.lit("]"))).otherwise(escaped)
        )

    def whole(parts: Column) -> Column:
        bad = (F.array_join(parts, "") != pattern) | F.exists(parts, lambda p: (p == "[") | (p == "\\"))
        return F.when(bad, F.lit("(?!)")).otherwise(F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, part), ""), F.lit("$")))

    return J.let(F.regexp_extract_all(pattern, F.lit(_PARTS), F.lit(0)), whole)


def bare(principal: Column) -> Column:
    return F.regexp_replace(F.trim(principal), "^User:", "")


def principal_matches(rule: Column, asked: Column, pattern: Column | None = None) -> Column:
    """pattern: the glob of the bare rule, where it has been made beforehand."""
    r, q = bare(rule), bare(asked)
    return (r == "*") | (F.lower(r) == F.lower(q)) | F.rlike(q, glob(r) if pattern is None else pattern)


def name_matches(rule: Column, name: Column, pattern: Column | None = None) -> Column:
    prefix = rule.endswith("*") & F.startswith(name, F.regexp_replace(rule, r"\*$", ""))
    return (rule == "*") | (rule == name) | prefix | F.rlike(name, glob(rule) if pattern is None else pattern)


#: Rules that are broadcast at most.
MAX_RULES = 100_000


def evaluate(requests: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    """(request_id, allowed, verdict, rule_id) for requests (request_id, principal, resource_type,
    resource_name, operation).

    Rules (rule_id, principal, resource_type, resource_name, operation, permission, seq) and
    users (username, role) are configuration; the rules are matched by patterns, so they
    are broadcast, at most ``MAX_RULES`` of them (more raise ValueError). Only what is asked, without
    repetition, meets the rules: the requests join their answer. The reason names the
    first rule in order that decided.
    """
    if rules.count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} access rules")
    asked = ["principal", "resource_type", "resource_name", "operation"]
    every, requests = requests, requests.select(*asked).distinct()
    r = rules.withColumn("__name", glob(F.col("resource_name"))).withColumn("__who", glob(bare(F.col("principal"))))
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])
    hit = (
        ((F.col("r_resource_type") == F.col("resource_type")) | F.col("r_resource_type").isin("ALL", ""))
        & ((F.col("r_operation") == F.col("operation")) | (F.col("r_operation") == "ALL"))
        & principal_matches(F.col("r_principal"), F.col("principal"), F.col("r___who"))
        & name_matches(F.col("r_resource_name"), F.col("resource_name"), F.col("r___name"))
    )
    first = lambda p: F.min_by("r_rule_id", F.when(F.col("r_permission") == p, F.col("r_seq")))
    rank = lambda p: F.max((F.col("r_permission") == p).cast("int")) == 1
    m = requests.join(F.broadcast(r), hit, "left").groupBy(*requests.columns).agg(
        F.coalesce(rank("DENY"), F.lit(False)).alias("denied"), first("DENY").alias("deny_rule"), F.coalesce(rank("ALLOW"), F.lit(False)).alias("granted"), first("ALLOW").alias("allow_rule")
    )
    u = users.select(F.col("username").alias("__user"), "role")
    m = m.join(u, bare(F.col("principal")) == F.col("__user"), "left")
    boss = F.coalesce(F.col("role") == "SUPER_ADMIN", F.lit(False))
    verdict = F.when(F.col("denied"), "deny").when(boss, "super_admin").when(F.col("granted"), "allow").otherwise("default_deny")
    rule = F.when(F.col("denied"), F.col("deny_rule")).when(~boss & F.col("granted"), F.col("allow_rule"))
    m = m.select(*asked, verdict.alias("verdict"), rule.alias("rule_id"))
    same = F.lit(True)
    for c in asked:
        same = same & every[c].eqNullSafe(m[c])
    return every.join(m, same).select("request_id", F.col("verdict").isin("super_admin", "allow").alias("allowed"), "verdict", "rule_id")
