"""Quality rules whose cutoffs are chosen with a guarantee: exact binomial bounds on
labelled holdouts limit false rejection per stratum, corrected for all tests made.

DataFrame functions only; no Python code runs on the executors.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import let, maybe_broadcast, stage, table, whole_row, words_of


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose ``value`` exceeds a cutoff; ``cutoffs`` are the candidates."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


#: Shares are of words (symbols, repeats), of lines, or of characters in words.
RULES = (
    Rule("symbols", "n_symbols / n_words", (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.5, 0.7)),
    Rule("repeats", "n_repeat_words / n_words", (0.1, 0.2, 0.3, 0.4)),
    Rule("word_length", "word_chars / n_words", (8.0, 10.0, 12.0, 16.0, 24.0)),
    Rule("marks", "n_marks / greatest(word_chars, 1)", (0.05, 0.1, 0.15, 0.2, 0.3)),
)


@dataclass(frozen=True)
class Risk:
    """``alpha``: largest share of good documents of a stratum that the cutoffs may reject,
    with probability 1 - ``delta`` over all strata and all that is tested."""

    alpha: float = 0.02
    delta: float = 0.05
    rules: tuple[Rule, ...] = field(default=RULES)

    def paths(self) -> list[tuple[float, list[dict[str, float]]]]:
        """(share of delta, settings from loosest to strictest), fixed beforehand: first all rules
        together, their t-th loosest cutoffs at step t, then each rule alone."""
        loose = {r.name: sorted(r.cutoffs, reverse=True) for r in self.rules}
        steps = max(map(len, loose.values()))
        joint = [{k: c[min(t, len(c) - 1)] for k, c in loose.items()} for t in range(steps)]
        return [(0.5, joint)] + [(0.5 / len(loose), [{k: x} for x in c]) for k, c in loose.items()]

    @property
    def least(self) -> float:
        """Good documents below which a stratum can certify nothing, at the whole of delta."""
        return math.log(self.delta) / math.log1p(-self.alpha)


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more (each word once).

    Windows are 64-bit hashes; only texts that have a repeated one sort (hash,
    position) pairs, and neighbours of equal hash give the covered positions.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"]),
        )
        at = let(pairs, lambda s: F.array_sort(F.transform(twice(s), lambda j: F.get(s, j)["p"])))
        steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return let(at, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(some).cast("long")


def text_stats(text: Column) -> Column:
    """Struct of counts over a whole text (null: no words)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            without(r"[#*$%&|<>]+").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            without(r"[^\p{L}\p{N}\s]+").alias("n_marks"),
        ),
    )


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__q`` of base statistics and the base verdict."""
    s = docs.withColumn("__q", text_stats(F.col(text_col)))
    q = F.col("__q")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return s.withColumn(
        "__q",
        F.struct(
            q["n_words"].alias("n_words"),
            q["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            (q["lines"]["n"] - q["lines"]["d"]).alias("n_dup_lines"),
            q["n_repeat_words"].alias("n_repeat_words"),
            q["lines"]["n"].alias("n_lines"),
            q["n_marks"].alias("n_marks"),
            failed.alias("base_failed"),
        ),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), summed term by term in logarithms.

    At most ``ln(delta')`` exactly when the Clopper-Pearson upper bound at level
    delta' of a rate with k hits in n is at most p.
    """
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)
    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        lambda a, j: let(
            a["t"] + F.log((n - j + 1) / j) + F.lit(odds),
            lambda t: F.struct(
                t.alias("t"),
                (F.greatest(a["s"], t) + F.log1p(F.exp(F.least(a["s"], t) - F.greatest(a["s"], t)))).alias("s"),
            ),
        ),
        lambda a: a["s"],
    )


def cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, cutoffs map rule -> cutoff) from labelled holdout rows.

    labelled: stratum, good boolean, the columns of the statistics; a row for each independent
    document. One conditional count per setting in a single partially aggregated group-by.
    Along each of the fixed paths (:meth:`Risk.paths`) a setting is certified if the exact bound on its false rejection
    rate is at most alpha and those before it are certified: a fixed sequence, so the whole level of a path
    serves each of its steps. Paths share delta, and so do the strata with enough good documents to
    certify anything (a count that tells nothing of rejections). Of the certified settings a stratum takes
    that which rejects most bad documents net of good ones, then fewest good ones, then that of
    the first path and the loosest; one that rejects no bad one is not taken. Too few labels
    certify nothing, and nothing is rejected.
    """
    tests = [(p, i, share, s) for p, (share, path) in enumerate(risk.paths()) for i, s in enumerate(path)]
    values = {r.name: r.value for r in risk.rules}
    counts = [F.sum(F.col("good").cast("long")).alias("n")]
    for p, i, _, s in tests:
        over = F.lit(False)
        for k, c in s.items():
            over = over | (F.expr(values[k]) > F.lit(c))
        counts.append(F.sum((over & F.col("good")).cast("long")).alias(f"fr_{p}_{i}"))
        counts.append(F.sum((over & ~F.col("good")).cast("long")).alias(f"tr_{p}_{i}"))
    by = stage(labelled.groupBy("stratum").agg(*counts), "risk")
    level = math.log(risk.delta / max(1, by.where(F.col("n") >= risk.least).count()))
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("path"), F.lit(i).alias("step"), F.lit(level + math.log(share)).alias("level"), F.col(f"fr_{p}_{i}").alias("fr"), F.col(f"tr_{p}_{i}").alias("tr"),
                F.create_map(*[F.lit(x) for kv in s.items() for x in kv]).alias("cutoffs"),
            )
            for p, i, share, s in tests
        ]
    )
    so_far = Window.partitionBy("stratum", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tried = by.where(F.col("n") >= risk.least).select("stratum", "n", F.explode(rows).alias("t")).select("stratum", "n", "t.*")
    tried = tried.withColumn("ok", F.bool_and(binomial_tail(F.col("fr"), F.col("n"), risk.alpha) <= F.col("level")).over(so_far))
    best = F.max_by("cutoffs", F.struct(F.col("tr") - F.col("fr"), -F.col("fr"), -F.col("path"), -F.col("step")))
    return tried.where("ok AND tr > 0").groupBy("stratum").agg(best.alias("cutoffs"))


def judge(
    docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep_columns: bool = True
) -> DataFrame:
    """Every row of ``docs`` with struct ``__q`` (statistics, base_failed) and ``__kept``.

    labels: doc_id, quality (1: good, 0: bad; null and any other value are no labels). Repeated labels of
    a document count once, good if any says so. The holdout is every labelled text
    that passes the base rules, once in a stratum however many rows and ids hold it (copies are no
    independent trials; good if any is); nothing else is learned from labels, so none needs to
    be set aside. A null stratum is a stratum of its own; strata without enough labels
    reject by the base rules only. The rows with their statistics are written once to
    the scratch folder; the cutoffs (one row a stratum) are broadcast if counted small.
    Null, empty and very long texts, repeated rows and an empty table are allowed; columns
    of ``docs`` may have any names but ``__q`` and ``__kept``.
    """
    return _judged(docs, labels, risk, id_col, text_col, stratum_col, keep_columns).select("__row.*", "__q", "__kept")


def _judged(docs: DataFrame, labels: DataFrame, risk: Risk, id_col: str, text_col: str, stratum_col: str, keep_columns: bool) -> DataFrame:
    """__row (struct of the columns of ``docs``, or of doc_id alone), __q and __kept."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("<null>"))
    row = whole_row(docs) if keep_columns else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    src = docs.select(row.alias("__row"), F.col(id_col).cast("long").alias("__id"), stratum.alias("__stratum"), F.col(text_col).alias("__text"))
    seen = stage(with_stats(src, "__text").withColumn("__key", F.xxhash64("__text")).drop("__text"), "quality")
    good = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg((F.max("quality") == 1).alias("good"))
    held = seen.where(~F.col("__q.base_failed")).select("__id", F.col("__stratum").alias("stratum"), "__key", "__q").join(good, "__id")
    held = held.groupBy("stratum", "__key").agg(F.bool_or("good").alias("good"), F.first("__q").alias("__q")).select("stratum", "good", "__q.*")
    chosen = maybe_broadcast(stage(cutoffs(held, risk).withColumnRenamed("stratum", "__stratum"), "cutoffs"), 100_000)
    q = seen.join(chosen, "__stratum", "left")
    bad = F.lit(False)
    for r in risk.rules:
        value = r.value
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"):
            value = re.sub(rf"\b{c}\b", f"__q.{c}", value)
        cut = F.try_element_at(F.col("cutoffs"), F.lit(r.name))
        bad = bad | F.coalesce(F.expr(value.replace("__q.n_words", "greatest(__q.n_words, 1)")) > cut, F.lit(False))
    return q.select("__row", "__q", (~F.col("__q.base_failed") & ~bad).alias("__kept"))


def filter_quality(
    docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """``docs`` without the rejected rows (see :func:`judge`), columns of any names as they were."""
    return _judged(docs, labels, risk, id_col, text_col, stratum_col, True).where("__kept").select("__row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_columns=False)
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in stats], F.col("__kept").alias("kept"))


def oracle(risk: Risk = Risk()) -> str:
    """DuckDB SQL for :func:`op7_quality_rules`: windows as rows, bounds from log-gamma sums."""
    values = {r.name: r.value for r in risk.rules}
    tests = [(p, i, share, x) for p, (share, path) in enumerate(risk.paths()) for i, x in enumerate(path)]
    over = lambda x, n="n_words": " OR ".join(f"{values[k].replace('n_words', n)} > {c!r}" for k, c in x.items())
    rows = " UNION ALL ".join(f"SELECT stratum, good, {p} AS path, {i} AS step, {share!r} AS share, ({over(x)}) AS over FROM h" for p, i, share, x in tests)
    bad = " ".join(f"WHEN path = {p} AND step = {i} THEN {over(x, 'greatest(n_words, 1)')}" for p, i, _, x in tests)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk.alpha!r}) + (n - i) * ln(1 - {risk.alpha!r}))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '<null>') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY doc_id),
s AS (SELECT d.doc_id, stratum, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, CAST(length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}\x09-\x0D\x20]', '', 'g')) AS BIGINT) AS n_marks FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT stratum, t, bool_or(good) AS good, {", ".join(f"any_value({c}) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks"))}
  FROM f JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY stratum, t),
e AS (SELECT stratum FROM h GROUP BY stratum HAVING count(*) FILTER (good) >= {risk.least!r}),
x AS ({rows}),
k AS (SELECT stratum, path, step, share, count(*) FILTER (good) AS n, count(*) FILTER (good AND over) AS fr, count(*) FILTER (NOT good AND over) AS tr FROM x WHERE stratum IN (SELECT stratum FROM e) GROUP BY ALL),
v AS (SELECT *, (SELECT sum({term}) FROM (SELECT unnest(range(fr + 1)) AS i)) <= share * {risk.delta!r} / (SELECT count(*) FROM e) AS good FROM k),
o AS (SELECT *, bool_and(good) OVER (PARTITION BY stratum, path ORDER BY step) AS ok FROM v),
b AS (SELECT stratum, path, step FROM o WHERE ok AND tr > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY tr - fr DESC, fr, path, step) = 1)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(CASE {bad} END, FALSE) AS kept
FROM f LEFT JOIN b ON b.stratum = f.stratum
"""
