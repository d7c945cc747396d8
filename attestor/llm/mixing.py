"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

A pool (a source, or all sources without a weight of their own) is cut into blocks of consecutive documents. With integer
weights q and blocks N per pool, fluid time t(v) = sum(min(N, q * v)) gives block k its window: released at t(k / q), due
at t((k + 1) / q), rounded outwards. Earliest deadline first then keeps every pool less than one block from its share; when
a pool runs out, the others go on in their proportions.

At whole v every pool has done a whole number of blocks, so the schedule falls into periods of sum(q) slots at most that
don't depend on each other, and a period is told by how many blocks each pool has left in it. There are at most two such
shapes for each pool and one more; one period of each is scheduled, and documents look their slot up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Name of the pool of all sources without a weight of their own (null among them).
OTHER = "(other)"


def pool_of(weights: dict[str, int]) -> Column:
    return F.when(F.col("source").isin(list(weights)), F.col("source")).otherwise(F.lit(OTHER))


def in_pools(docs: DataFrame, weights: dict[str, int], per_bucket: int) -> DataFrame:
    """Adds _pool and _idx: the document's place in its pool, from 0, in the order of md5(doc_id), doc_id and text.

    Places are dealt in two steps, so that no pool is ever in one task: counts of ranges of the hash are summed up, and
    documents are numbered within a range.
    """
    buckets = max(1, -(-docs.count() // per_bucket))
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    at = F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2.0**32)).cast("int")
    rows = docs.withColumn("_pool", pool_of(weights)).withColumn("_md5", md5).withColumn("_bucket", at)
    counts = rows.groupBy("_pool", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_pool").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_pool", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_pool", "_bucket").orderBy("_md5", "doc_id", "text")
    keys = rows.withColumn("_place", F.row_number().over(within) - 1)
    return keys.join(counts, ["_pool", "_bucket"]).withColumn("_idx", F.col("_before") + F.col("_place")).drop("_md5", "_bucket", "_before", "_place")


def slots(totals: DataFrame, weights: dict[str, int], block_rows: int) -> DataFrame:
    """(shape, pool, j, slot, first, start, length): where the j-th block of a pool goes in a period of each shape.

    first: the first period of the shape; start: its first slot; length: slots in each of its periods. totals: (pool, n).
    """
    q = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("pool"))
    pools = totals.select(F.struct("pool", q.cast("long").alias("q"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")).alias("p"))
    plan = pools.agg(F.array_sort(F.collect_list("p")).alias("pools"))  # one entry per weight, and one more
    breaks = "array_sort(array_distinct(concat(array(0L), flatten(transform(pools, p -> array(p.blocks div p.q, p.blocks div p.q + 1))))))"
    shapes = plan.selectExpr("pools", f"posexplode({breaks}) as (shape, first)")
    shapes = shapes.selectExpr(
        "shape",
        "first",
        "pools",
        "aggregate(pools, 0L, (t, p) -> t + least(p.blocks, p.q * first)) as start",
        "transform(pools, p -> greatest(0L, least(p.q, p.blocks - p.q * first))) as have",
    )
    # windows of a period's blocks, in fluid time from its beginning; x / q is the fluid time that a pool's own share gives
    fluid = "aggregate(zip_with(pools, have, (o, m) -> least(m * p.q, o.q * {j})), 0L, (t, x) -> t + x)"
    jobs = (
        "flatten(transform(arrays_zip(pools, have), e -> transform(filter(sequence(0L, greatest(e.have, 1L) - 1L), j -> j < e.have), j -> "
        "named_struct('due', ({due} + e.pools.q - 1L) div e.pools.q, 'pool', e.pools.pool, 'j', j, 'released', {released} div e.pools.q))))"
    ).format(due=fluid.format(j="(j + 1L)").replace("p.q", "e.pools.q"), released=fluid.format(j="j").replace("p.q", "e.pools.q"))
    shapes = shapes.selectExpr("shape", "first", "start", f"array_sort({jobs}) as jobs")
    # earliest deadline first among what is released, slot by slot
    step = (
        "transform(array(filter(s.todo, x -> x.released <= t)[0]), pick -> "
        "named_struct('todo', filter(s.todo, x -> x.pool <> pick.pool or x.j <> pick.j), 'done', concat(s.done, array(pick))))[0]"
    )
    done = f"aggregate(filter(sequence(0, size(jobs)), t -> t < size(jobs)), named_struct('todo', jobs, 'done', slice(jobs, 1, 0)), (s, t) -> {step}, s -> s.done)"
    return shapes.selectExpr("shape", "first", "start", "size(jobs) as length", f"posexplode({done}) as (slot, job)").selectExpr(
        "shape", "job.pool as pool", "job.j as j", "slot", "first", "start", "length"
    )


def mix(docs: DataFrame, weights: dict[str, int], block_rows: int = 16, per_bucket: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """docs with pool, block, slot and position (from 0): the order that interleaves sources to their target weights.

    weights: an integer share for each source; sources without one, and null, form one pool with the weight of '(other)'
    (1 if it has none). A block is `block_rows` consecutive documents of a pool, the last one what is left. Every document
    gets a position, none is dropped or repeated; rows that repeat a doc_id are placed one after the other. After any
    number of slots each pool has had less than one block more or less than its share of them, as long as it has any left.
    Empty tables give empty results. Columns of docs stay (of them only those in `keep`, if it is given); a column named like
    a new one is replaced.
    """
    if any(v < 1 or v != int(v) for v in weights.values()):
        raise ValueError("weights must be positive integers")
    weights = {OTHER: 1} | weights
    named = {k: v for k, v in weights.items() if k != OTHER}
    weight = lambda pool: F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col(pool)).cast("long")
    own = [F.col("`" + x.replace("`", "``") + "`") for x in (docs.columns if keep is None else keep) if x not in ("pool", "block", "slot", "position")]
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    docs = docs.select(F.struct(*own).alias("_row"), "doc_id", "source", text.alias("text"))
    placed = in_pools(docs, named, per_bucket)
    totals = docs.groupBy(pool_of(named).alias("pool")).agg(F.count("*").alias("n"))
    table = common.materialise(slots(totals, weights, block_rows), "slots")
    # the shape of a block's period is the last one that begins no later; both tables have a size that the weights bound
    firsts = table.agg(F.array_sort(F.collect_set("first")).alias("_firsts"))
    holes = (
        totals.withColumn("_q", weight("pool"))
        .withColumn("_last", F.ceil(F.col("n") / block_rows) - 1)
        .withColumn("_hole", (F.col("_last") + 1) * block_rows - F.col("n"))
    )
    last = holes.join(table, "pool").where((F.col("j") == F.col("_last") % F.col("_q")) & (F.expr("_last div _q") >= F.col("first")))
    last = last.groupBy("pool").agg(F.max_by(F.struct(F.expr("start + (_last div _q - first) * length + slot").alias("at"), F.col("_hole").alias("n")), "first").alias("h"))
    bounds = F.broadcast(last.agg(F.collect_list("h").alias("_holes")))
    block = F.floor(F.col("_idx") / block_rows).cast("long")
    rows = placed.withColumn("_block", block).withColumn("_q", weight("_pool")).withColumn("_period", F.expr("_block div _q")).withColumn("_j", F.expr("_block % _q"))
    one = F.lit(1).alias("_one")
    rows = rows.withColumn("_one", one).join(F.broadcast(firsts.withColumn("_one", one)), "_one").join(bounds.withColumn("_one", one), "_one")
    rows = rows.withColumn("_first", F.expr("element_at(filter(_firsts, x -> x <= _period), -1)"))
    look = table.select(F.col("pool").alias("_pool"), F.col("j").alias("_j"), F.col("first").alias("_first"), "slot", "start", "length")
    joined = rows.join(F.broadcast(look), ["_pool", "_j", "_first"])  # at most (2 pools + 1) * sum of weights rows
    slot = F.expr("start + (_period - _first) * length + slot")
    joined = joined.withColumn("_slot", slot)
    position = F.expr(f"_slot * {block_rows} + _idx % {block_rows} - aggregate(filter(_holes, x -> x.at < _slot), 0L, (s, x) -> s + x.n)")
    return joined.select("_row.*", F.col("_pool").alias("pool"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), position.alias("position"))


def mixed_order(docs: DataFrame, weights: dict[str, int], block_rows: int = 16) -> DataFrame:
    """The documents themselves, with their own columns only, sorted into the order of mix(); nulls, repeated rows and empty tables as there."""
    return mix(docs.select(F.struct("*").alias("_doc"), "doc_id", "source", "text"), weights, block_rows).orderBy("position").select("_doc.*")
