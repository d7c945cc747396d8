"""The evidence registry: observations and comparisons from source reports, their rules and the audit of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import scalars

METRICS = ["dice", "iou", "precision", "recall", "boundary_f1"]
REPORT = "id string, role string, rows int, metrics struct<" + ",".join(f"{m}:double" for m in METRICS) + ">"


def observations(reports: DataFrame, text: str = "report") -> DataFrame:
    """(id, metric, value) in long form from JSON reports by a fixed schema."""
    r = reports.select(F.from_json(text, REPORT).alias("r"))
    return r.select("r.id", F.explode(F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(f"r.metrics.{m}"))))).alias("metric", "value"))


def comparisons(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, second, metric, delta) for pairs (first, second): second less first."""
    a = obs.select(F.col("id").alias("first"), "metric", F.col("value").alias("a"))
    b = obs.select(F.col("id").alias("second"), "metric", F.col("value").alias("b"))
    return pairs.join(a, "first").join(b, ["second", "metric"]).select("first", "second", "metric", (F.col("b") - F.col("a")).alias("delta"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that can't be told counts as broken."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def first_status(*ladder: tuple[Column, str], done: str) -> Column:
    """The first blocking status that holds."""
    out = None
    for hit, name in ladder:
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(done)


def registry_rules(value: str, low: str, high: str) -> dict[str, Column]:
    v, a, b = F.col(value), F.col(low), F.col(high)
    return {
        "finite": scalars.is_finite(v),
        "interval": a.isNull() & b.isNull() | (scalars.is_finite(a) & scalars.is_finite(b) & (a <= b)),
        "contains": a.isNull() | v.between(a, b),
    }


def clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, clause, negated): text cut at sentence ends and semicolons; negated if a negation stands in the clause."""
    cut = df.select(key, F.posexplode(F.split(text, r"[.;!?]\s+")).alias("pos", "clause"))
    low = F.lower("clause")
    return cut.where(F.trim("clause") != "").select(key, "pos", "clause", low.rlike(r"\b(not|no|never|without|cannot)\b").alias("negated"))


def numbers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, token) of decimal numbers in a text."""
    return df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(r"[-+]?[0-9]+\.[0-9]+"), F.lit(0))).alias("token"))
