"""Audits of paths, manifests, caches, indexes and masks: what breaks a rule becomes rows or columns, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contained(path: Column) -> Column:
    """Whether a relative name stays below its root however it is normalised; null, empty and absolute names do not."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

    low = F.aggregate(steps, start, step, lambda s: s["low"])
    return F.coalesce((path != "") & ~path.startswith("/") & (low >= 0), F.lit(False))


def drift(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, state) of found and pinned (name, digest): 'intact', 'drift', 'missing' (pinned, not found) or 'not_pinned'.

    Digests compare without case. One shuffle, no broadcast: both sides meet by name.
    """
    side = lambda df, as_: df.select("name", F.lower("digest").alias(as_))
    both = side(found, "has").join(side(pinned, "wants"), "name", "full_outer")
    state = F.when(F.col("has").isNull(), "missing").when(F.col("wants").isNull(), "not_pinned").when(F.col("has") == F.col("wants"), "intact").otherwise("drift")
    return both.select("name", state.alias("state"))


def cache_problems(candidate: DataFrame, zero: DataFrame, index: str, key: list[str], compared: list[str]) -> DataFrame:
    """(rule, broken): how two arms of a cache break their contract; rules that hold are there with 0.

    In each arm the index must run from 0 without gaps and a key may occur once; rows must agree in `compared`, repeats
    counted (one aggregation over both arms instead of two differences).
    """
    arms = {"candidate": candidate, "zero": zero}
    out = []
    for name, df in arms.items():
        gaps = F.coalesce(F.max(index) + 1 - F.count_distinct(index), F.lit(0)).cast("long")
        out.append(df.agg(gaps.alias("broken")).select(F.lit(f"{name}_gap").alias("rule"), "broken"))
        repeated = df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("broken"))
        out.append(repeated.select(F.lit(f"{name}_repeated_key").alias("rule"), "broken"))
    rows = candidate.select(*compared, F.lit(1).alias("_side")).unionAll(zero.select(*compared, F.lit(-1).alias("_side")))
    over = rows.groupBy(*compared).agg(F.sum("_side").alias("_over"))
    only = over.agg(F.sum(F.greatest("_over", F.lit(0))).alias("candidate"), F.sum(F.greatest(-F.col("_over"), F.lit(0))).alias("zero"))
    for name in arms:
        out.append(only.select(F.lit(f"only_{name}").alias("rule"), F.coalesce(name, F.lit(0)).cast("long").alias("broken")))
    result = out[0]
    for df in out[1:]:
        result = result.unionAll(df)
    return result


def index_problems(rows: DataFrame, role: str, group: str, fold: str, counts: dict[str, int], folds: int) -> DataFrame:
    """(rule, scope, found, expected) of an index of rows with roles, groups and folds: only what deviates.

    count: a role has another number of rows than pinned (a role that is absent has 0). unknown_role: rows of a role that
    isn't pinned. split_group: a group lies in several folds. empty_fold: a fold from 0 to folds - 1 has no row.
    """
    spark = rows.sparkSession
    expected = spark.createDataFrame(sorted(counts.items()), "scope string, expected long")
    by_role = rows.groupBy(F.col(role).cast("string").alias("scope")).agg(F.count("*").alias("found"))
    both = by_role.join(expected, "scope", "full_outer")
    rule = F.when(F.col("expected").isNull(), "unknown_role").otherwise("count")
    out = both.select(rule.alias("rule"), "scope", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    out = out.where("found <> expected")
    groups = rows.groupBy(F.col(group).cast("string").alias("scope")).agg(F.count_distinct(fold).alias("found")).where("found > 1")
    out = out.unionAll(groups.select(F.lit("split_group").alias("rule"), "scope", "found", F.lit(1).cast("long").alias("expected")))
    used = rows.select(F.col(fold).cast("long").alias("id")).distinct()
    empty = spark.range(folds).join(used, "id", "left_anti")
    return out.unionAll(empty.select(F.lit("empty_fold").alias("rule"), F.col("id").cast("string").alias("scope"), F.lit(0).cast("long").alias("found"), F.lit(1).cast("long").alias("expected")))


def quality_branch(mean: Column, deviation: Column, blockiness: Column, artifacts: Column | None = None) -> Column:
    """The branch of a configuration that an image's quality picks; the first rule that holds wins.

    artifacts: share of dark artifacts, where that branch is configured.
    """
    ladder = F.when(mean < 122.0, "low_brightness").when(blockiness >= 0.02, "jpeg_compression").when(deviation < 13.0, "low_contrast").otherwise("clean")
    return ladder if artifacts is None else F.when(artifacts >= 0.002, "hair_artifact").otherwise(ladder)


def policy_branch(specular: Column, blur: Column, least_specular: float = 0.005, most_blur: float = -1.0) -> Column:
    """'specular_or_blur' for many highlights or a low variance of the Laplacian, else 'clean'."""
    return F.when((specular >= least_specular) | (blur <= most_blur), "specular_or_blur").otherwise("clean")


def mask_scores(pred: Column, target: Column) -> dict[str, Column]:
    """Overlap of two arrays of booleans: dice, iou, precision and recall; 1 where the denominator is 0."""
    pairs = F.zip_with(pred, target, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    many = lambda f: F.size(F.filter(pairs, f)).cast("double")
    tp, p, t = many(lambda x: x["p"] & x["t"]), many(lambda x: x["p"]), many(lambda x: x["t"])
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    return {"dice": share(2 * tp, p + t), "iou": share(tp, p + t - tp), "precision": share(tp, p), "recall": share(tp, t)}


def border_fraction(mask: Column, height: int, width: int) -> Column:
    """Share of the outermost pixels (row-major array of booleans) that are set."""
    edge = [i for i in range(height * width) if i // width in (0, height - 1) or i % width in (0, width - 1)]
    return F.size(F.filter(F.transform(F.array(*map(F.lit, edge)), lambda i: F.get(mask, i)), lambda x: x)) / F.lit(float(len(edge)))


def refinement_deltas(baseline: Column, refined: Column, target: Column, height: int, width: int) -> dict[str, Column]:
    """What refining a mask gains over its baseline, and whether it clings to the border (over half of it set)."""
    before, after = mask_scores(baseline, target), mask_scores(refined, target)
    border = border_fraction(refined, height, width)
    return {f"{m}_delta": after[m] - before[m] for m in before} | {"invalid_border_fraction": border, "invalid_border": border > 0.5}
