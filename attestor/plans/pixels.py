"""Raster queries over `embeddings` as 8 x 8 grids of byte levels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import channels, regions
from attestor.functions import kernels as k
from attestor.operators.rasters import byte_levels, measure, spread

from .base import query, table

c = F.col

#: Pixels in DuckDB: vec_id, i, y, x, g.
PX = """WITH raw AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings),
px AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE))) AS INTEGER) AS g FROM raw)
"""


def grids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", byte_levels(c("embedding")).alias("g"))


def over(spark: SparkSession, sf: str, kernel, schema: str) -> DataFrame:
    return measure(grids(spark, sf), "vec_id", "g", 8, 8, kernel, schema)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(n, digits).alias(n) if t == "double" else n for n, t in df.dtypes))


def mean(a):
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


@query(PX + "SELECT vec_id, round(avg(g), 8) AS mean, round(stddev_pop(g), 8) AS std FROM px GROUP BY vec_id")
def luminance_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Inside the row, by array functions: no shuffle and no Python."""
    m = grids(spark, sf).select("vec_id", mean(c("g")).alias("mean"), "g")
    return rounded(m.select("vec_id", "mean", F.sqrt(mean(F.transform("g", lambda v: (v - c("mean")) * (v - c("mean"))))).alias("std")))


@query(PX + ", h AS (SELECT vec_id, g, count(*) / 64.0::DOUBLE AS p FROM px GROUP BY vec_id, g) SELECT vec_id, round(-sum(p * log2(p)), 8) AS entropy FROM h GROUP BY vec_id")
def entropy8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(over(spark, sf, lambda g: {"entropy": k.entropy(g)}, "entropy double"))


@query(
    PX + """, q AS (SELECT a.vec_id, a.y, a.x, a.g, unnest([0, 1, 2, 3]) AS d FROM px a),
m AS (SELECT q.*, abs(q.y + CASE d WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS yy, abs(q.x + CASE d WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END) AS xx FROM q),
j AS (SELECT m.vec_id, m.y, m.x, m.g, sum(p.g) AS s FROM m JOIN px p ON p.vec_id = m.vec_id AND p.y = CASE WHEN yy > 7 THEN 14 - yy ELSE yy END AND p.x = CASE WHEN xx > 7 THEN 14 - xx ELSE xx END GROUP BY m.vec_id, m.y, m.x, m.g)
SELECT vec_id, round(var_pop(s - 4 * g), 6) AS laplacian FROM j GROUP BY vec_id""")
def laplacian_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(over(spark, sf, lambda g: {"laplacian": k.laplacian_variance(g)}, "laplacian double"), 6)


@query(PX + """, d AS (SELECT a.vec_id, 'x' AS axis, b.x AS pos, abs(b.g - a.g) / 255.0::DOUBLE AS jump FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1
 UNION ALL SELECT a.vec_id, 'y', b.y, abs(b.g - a.g) / 255.0::DOUBLE FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.x = b.x AND b.y = a.y + 1),
e AS (SELECT vec_id, axis, avg(CASE WHEN pos % 4 = 0 THEN jump END) - avg(CASE WHEN pos % 4 <> 0 THEN jump END) AS v FROM d GROUP BY vec_id, axis)
SELECT vec_id, round(greatest(0, avg(v)), 8) AS blockiness FROM e GROUP BY vec_id""")
def blockiness8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(over(spark, sf, lambda g: {"blockiness": k.blockiness(g, 4)}, "blockiness double"))


@query(PX + """, q AS (SELECT vec_id, y, x, least(g * 8 // 256, 7) AS l FROM px), o AS (SELECT unnest([0, 1, 1, 1]) AS dy, unnest([1, 1, 0, -1]) AS dx, unnest([0, 1, 2, 3]) AS o),
p AS (SELECT a.vec_id, o, a.l AS i, b.l AS j FROM q a, o JOIN q b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx), s AS (SELECT * FROM p UNION ALL SELECT vec_id, o, j, i FROM p),
n AS (SELECT vec_id, o, i, j, count(*)::DOUBLE AS k FROM s GROUP BY vec_id, o, i, j), t AS (SELECT *, k / sum(k) OVER (PARTITION BY vec_id, o) AS w FROM n),
e AS (SELECT vec_id, o, sum((i - j) * (i - j) * w) AS contrast, sum(w / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(w * w)) AS energy FROM t GROUP BY vec_id, o)
SELECT vec_id, round(avg(contrast), 8) AS contrast, round(avg(homogeneity), 8) AS homogeneity, round(avg(energy), 8) AS energy FROM e GROUP BY vec_id""")
def glcm8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(over(spark, sf, lambda g: {n: v for n, v in k.glcm(g).items() if n != "correlation"}, "contrast double, homogeneity double, energy double"))


@query(PX + "SELECT vec_id, y // 4 * 2 + x // 4 AS region, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(least(y, x, 7 - y, 7 - x)) AS border FROM px GROUP BY vec_id, region")
def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of grid regions (there are no superpixels here): grouped by sample and region."""
    p = grids(spark, sf).select("vec_id", F.posexplode("g").alias("i", "g"))
    y, x = F.floor(c("i") / 8).cast("int"), c("i") % 8
    p = p.select("vec_id", "g", y.alias("y"), x.alias("x"), (F.floor(y / 4) * 2 + F.floor(x / 4)).cast("int").alias("region"))
    edge = F.least("y", "x", 7 - c("y"), 7 - c("x"))
    return p.groupBy("vec_id", "region").agg(F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("std"), F.count("*").alias("area"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.avg("x"), 6).alias("cx"), F.min(edge).alias("border"))


@query(PX + """, r AS (SELECT vec_id, y // 4 * 2 + x // 4 AS region, avg(g) AS m, avg(y) AS cy, avg(x) AS cx, count(*) AS n FROM px GROUP BY vec_id, region),
w AS (SELECT a.vec_id, a.region, abs(a.m - b.m) AS d, b.n * exp(-((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) / 32.0::DOUBLE) AS w FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.region <> b.region)
SELECT vec_id, region, round(sum(w * d) / sum(w), 6) AS contrast FROM w GROUP BY vec_id, region""")
def region_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Each region against the others of its image, weighted by nearness and area: the few regions sit in one row."""
    p = grids(spark, sf).select("vec_id", F.posexplode("g").alias("i", "g"))
    y, x = F.floor(c("i") / 8), c("i") % 8
    r = p.groupBy("vec_id", (F.floor(y / 4) * 2 + F.floor(x / 4)).cast("int").alias("region")).agg(F.avg("g").alias("m"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.count("*").alias("n"))
    s = r.groupBy("vec_id").agg(F.collect_list(F.struct("region", "m", "cy", "cx", "n")).alias("rs")).select("vec_id", "rs", F.explode("rs").alias("a"))
    others = F.filter("rs", lambda b: b.region != c("a.region"))
    w = lambda b: b.n * F.exp(-((c("a.cy") - b.cy) ** 2 + (c("a.cx") - b.cx) ** 2) / 32.0)
    add = lambda f: F.aggregate(F.transform(others, f), F.lit(0.0), lambda t, v: t + v)
    return s.select("vec_id", c("a.region").alias("region"), F.round(add(lambda b: w(b) * F.abs(c("a.m") - b.m)) / add(w), 6).alias("contrast"))


@query(PX + "SELECT vec_id, y // 4 * 2 + x // 4 AS region, round(avg(CASE WHEN g > 140 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS target FROM px GROUP BY vec_id, region")
def region_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = grids(spark, sf).select("vec_id", F.posexplode("g").alias("i", "g"))
    region = (F.floor(c("i") / 32) * 2 + F.floor((c("i") % 8) / 4)).cast("int")
    return p.groupBy("vec_id", region.alias("region")).agg(F.round(F.avg((c("g") > 140).cast("double")), 8).alias("target"))


@query(PX + """, a AS (SELECT vec_id, y, x, avg(g) OVER (PARTITION BY vec_id, y // 4, x // 4) AS s4, avg(g) OVER (PARTITION BY vec_id, y // 2, x // 2) AS s2 FROM px)
SELECT vec_id, y, x, round((s4 + s2) / 2, 6) AS score FROM a""")
def multiscale_map(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of region scores of two scales, pixel by pixel, inside the row: each region's score is found once."""
    places = lambda y, x, s: [8 * (y * s + j) + x * s + i for j in range(s) for i in range(s)]
    score = lambda at: reduce(Column.__add__, (F.get("g", j).cast("double") for j in at)) / len(at)
    scores = lambda s: F.array(*(score(places(y, x, s)) for y in range(8 // s) for x in range(8 // s)))
    of = lambda p, s: F.floor(p / 8 / s) * (8 // s) + F.floor(p % 8 / s)
    rows = spread(grids(spark, sf), "vec_id").select("vec_id", scores(4).alias("s4"), scores(2).alias("s2"))
    out = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.get("s4", of(p, 4).cast("int")) + F.get("s2", of(p, 2).cast("int"))) / 2)
    m = rows.select("vec_id", F.posexplode(out).alias("i", "s"))
    return m.select("vec_id", F.floor(c("i") / 8).cast("int").alias("y"), (c("i") % 8).alias("x"), F.round("s", 6).alias("score"))


@query(PX + """, m AS (SELECT vec_id, i % 3 AS ch, avg(g) / 255.0::DOUBLE AS m FROM px WHERE i < 63 GROUP BY vec_id, ch), t AS (SELECT vec_id, avg(m) AS t FROM m GROUP BY vec_id)
SELECT m.vec_id, ch, round(t / greatest(m, 1e-6), 8) AS gain FROM m JOIN t USING (vec_id)""")
def gray_world(spark: SparkSession, sf: str) -> DataFrame:
    """Channel gains that make the mean colour gray (63 values as 21 pixels of three channels)."""
    part = lambda ch: mean(F.transform(F.filter("g", lambda v, i: (i < 63) & (i % 3 == ch)), lambda v: v / 255.0))
    m = grids(spark, sf).select("vec_id", F.array(*map(part, range(3))).alias("m"))
    gains = F.transform("m", lambda v: mean(c("m")) / F.greatest(v, F.lit(1e-6)))
    return m.select("vec_id", F.posexplode(gains).alias("ch", "gain")).select("vec_id", c("ch").alias("ch"), F.round("gain", 8).alias("gain"))


@query(PX + """, m AS (SELECT vec_id, i % 3 AS ch, pow(avg(pow(g / 255.0::DOUBLE, 6)), 1 / 6.0::DOUBLE) AS m FROM px WHERE i < 63 GROUP BY vec_id, ch), t AS (SELECT vec_id, avg(m) AS t FROM m GROUP BY vec_id)
SELECT m.vec_id, ch, round(least(1.15, greatest(0.85, t / greatest(m, 1e-6))), 8) AS gain FROM m JOIN t USING (vec_id)""")
def shades_of_gray(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda ch: F.pow(mean(F.transform(F.filter("g", lambda v, i: (i < 63) & (i % 3 == ch)), lambda v: F.pow(v / 255.0, F.lit(6.0)))), F.lit(1 / 6.0))
    m = grids(spark, sf).select("vec_id", F.array(*map(part, range(3))).alias("m"))
    gains = F.transform("m", lambda v: F.least(F.lit(1.15), F.greatest(F.lit(0.85), mean(c("m")) / F.greatest(v, F.lit(1e-6)))))
    return m.select("vec_id", F.posexplode(gains).alias("ch", "gain")).select("vec_id", "ch", F.round("gain", 8).alias("gain"))


@query(PX + "SELECT vec_id, sum(CAST(round(pow(g / 255.0::DOUBLE, 1 / 1.2::DOUBLE) * 255.0::DOUBLE) AS INTEGER))::BIGINT AS total FROM px GROUP BY vec_id")
def gamma_curve(spark: SparkSession, sf: str) -> DataFrame:
    bent = F.transform("g", lambda v: F.round(F.pow(v / 255.0, F.lit(1 / 1.2)) * 255.0).cast("int"))
    return grids(spark, sf).select("vec_id", F.aggregate(bent, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(PX + "SELECT vec_id, count(*) FILTER (WHERE sqrt(((y - 3.5::DOUBLE) / 4) ** 2 + ((x - 3.5::DOUBLE) / 4) ** 2) > 0.95 AND g < 120) AS dark_corner FROM px GROUP BY vec_id")
def vignette_pixels(spark: SparkSession, sf: str) -> DataFrame:
    far = lambda i: F.sqrt(((F.floor(i / 8) - 3.5) / 4) ** 2 + ((i % 8 - 3.5) / 4) ** 2) > 0.95
    return grids(spark, sf).select("vec_id", F.size(F.filter("g", lambda v, i: far(i) & (v < 120))).cast("long").alias("dark_corner"))


@query(PX + """, b AS (SELECT vec_id, quantile_cont(g, 0.5) AS m FROM px WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY vec_id)
SELECT vec_id, i, abs(g - m)::DOUBLE AS distance FROM px JOIN b USING (vec_id)""")
def saliency8(spark: SparkSession, sf: str) -> DataFrame:
    """Each pixel's distance from the border's median."""
    ring = F.sort_array(F.filter("g", lambda v, i: (F.floor(i / 8)).isin(0, 7) | (i % 8).isin(0, 7)))
    m = grids(spark, sf).select("vec_id", "g", ((F.get(ring, F.lit(13)) + F.get(ring, F.lit(14))) / 2.0).alias("m"))
    return m.select("vec_id", F.posexplode(F.transform("g", lambda v: F.abs(v - c("m")))).alias("i", "distance"))


@query(PX + """, o AS (SELECT unnest([-1,-1,-1,0,1,1,1,0]) AS dy, unnest([-1,0,1,1,1,0,-1,-1]) AS dx, unnest([0,1,2,3,4,5,6,7]) AS b),
s AS (SELECT a.vec_id, a.i, sum(CASE WHEN p.g >= a.g THEN 1 << b ELSE 0 END)::BIGINT AS code FROM px a, o JOIN px p ON p.vec_id = a.vec_id AND p.y = a.y + dy AND p.x = a.x + dx WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY a.vec_id, a.i)
SELECT vec_id, sum(code)::BIGINT AS total FROM s GROUP BY vec_id""")
def local_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return over(spark, sf, lambda g: {"total": int(k.local_binary(g)[1:7, 1:7].astype(int).sum())}, "total long")


@query(PX + "SELECT vec_id, sum(floor(g * 0.6::DOUBLE + 0.5::DOUBLE))::BIGINT AS darker, sum(floor(127.5::DOUBLE + 0.5::DOUBLE * (g - 127.5::DOUBLE) + 0.5::DOUBLE))::BIGINT AS flatter, sum(floor(least(255, g * (0.6::DOUBLE + x * 0.05::DOUBLE)) + 0.5::DOUBLE))::BIGINT AS uneven FROM px GROUP BY vec_id")
def corruption_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The corruptions that are arithmetic per pixel, halves up."""
    add = lambda f: F.aggregate(F.transform("g", f), F.lit(0).cast("long"), lambda s, v: s + F.floor(v + 0.5).cast("long"))
    return grids(spark, sf).select(
        "vec_id", add(lambda v, i: v * 0.6).alias("darker"), add(lambda v, i: 127.5 + (v - 127.5) * 0.5).alias("flatter"), add(lambda v, i: F.least(F.lit(255.0), v * (0.6 + (i % 8) * 0.05))).alias("uneven")
    )


@query(PX + "SELECT vec_id, CASE WHEN count(DISTINCT g) = 1 THEN 'constant' WHEN max(g) <= 127 THEN 'empty' WHEN min(g) >= 127 THEN 'full' ELSE 'binary' END AS class, count(*) FILTER (WHERE g >= 127) AS n FROM px GROUP BY vec_id")
def mask_decode(spark: SparkSession, sf: str) -> DataFrame:
    g = grids(spark, sf).select("vec_id", F.size(F.array_distinct("g")).alias("d"), F.array_max("g").alias("hi"), F.array_min("g").alias("lo"), F.size(F.filter("g", lambda v: v >= 127)).cast("long").alias("n"))
    return g.select("vec_id", F.when(c("d") == 1, "constant").when(c("hi") <= 127, "empty").when(c("lo") >= 127, "full").otherwise("binary").alias("class"), "n")


@query(PX + """, m AS (SELECT vec_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px WHERE g > 150 GROUP BY vec_id)
SELECT vec_id, greatest(0, y0 - CAST(round_even((y1 - y0 + 1) * 0.2::DOUBLE, 0) AS INTEGER)) AS top, least(7, y1 + CAST(round_even((y1 - y0 + 1) * 0.2::DOUBLE, 0) AS INTEGER)) AS bottom,
 greatest(0, x0 - CAST(round_even((x1 - x0 + 1) * 0.2::DOUBLE, 0) AS INTEGER)) AS leftmost, least(7, x1 + CAST(round_even((x1 - x0 + 1) * 0.2::DOUBLE, 0) AS INTEGER)) AS rightmost FROM m""")
def expanded_box(spark: SparkSession, sf: str) -> DataFrame:
    """The bounding box of a mask with a margin of a fifth, halves to even, cut to the image."""
    on = F.filter(F.transform("g", lambda v, i: F.when(v > 150, i)), lambda i: i.isNotNull())
    m = grids(spark, sf).select("vec_id", on.alias("on")).where(F.size("on") > 0)
    y, x = F.transform("on", lambda i: F.floor(i / 8).cast("int")), F.transform("on", lambda i: i % 8)
    m = m.select("vec_id", F.array_min(y).alias("y0"), F.array_max(y).alias("y1"), F.array_min(x).alias("x0"), F.array_max(x).alias("x1"))
    margin = lambda a, b: F.rint((c(b) - c(a) + 1) * 0.2).cast("int")
    zero, seven = F.lit(0), F.lit(7)
    return m.select("vec_id", F.greatest(zero, c("y0") - margin("y0", "y1")).alias("top"), F.least(seven, c("y1") + margin("y0", "y1")).alias("bottom"), F.greatest(zero, c("x0") - margin("x0", "x1")).alias("leftmost"), F.least(seven, c("x1") + margin("x0", "x1")).alias("rightmost"))


BOUNDS = PX + """, m AS (SELECT vec_id, y, x, g > 135 AS p FROM px), e AS (SELECT a.vec_id, a.y, a.x FROM m a LEFT JOIN m b ON b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.p
 WHERE a.p GROUP BY a.vec_id, a.y, a.x HAVING count(*) < 9),
t AS (SELECT vec_id - 1 AS vec_id, y, x FROM e), pr AS (SELECT vec_id FROM e INTERSECT SELECT vec_id FROM t),
d AS (SELECT e.vec_id, 'p' AS side, min(sqrt((e.y - t.y) ** 2 + (e.x - t.x) ** 2)) AS d FROM e JOIN t USING (vec_id) GROUP BY e.vec_id, e.y, e.x
 UNION ALL SELECT e.vec_id, 't', min(sqrt((e.y - t.y) ** 2 + (e.x - t.x) ** 2)) FROM e JOIN t USING (vec_id) GROUP BY t.y, t.x, e.vec_id),
s AS (SELECT vec_id, avg(CASE WHEN side = 'p' THEN CASE WHEN d <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS p, avg(CASE WHEN side = 't' THEN CASE WHEN d <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS r, quantile_cont(d, 0.95) AS hd95, avg(d) AS assd FROM d GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 8) AS boundary_f1, round(hd95, 8) AS hd95, round(assd, 8) AS assd FROM s"""


@query(BOUNDS)
def boundary_f1_8x8(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary F1 at tolerance 1, HD95 and ASSD of each mask against the next one; pairs without both boundaries are left out."""
    g = grids(spark, sf)
    pair = g.join(g.select((c("vec_id") - 1).alias("vec_id"), c("g").alias("h")), "vec_id").select("vec_id", F.concat("g", "h").alias("g"))

    def kernel(two: np.ndarray) -> dict:
        a, b = two[0] > 135, two[1] > 135
        return k.boundary_scores(a, b, 1.0) | {"both": int(a.any() and b.any())}

    out = measure(pair.select("vec_id", "g"), "vec_id", "g", 2, 64, lambda x: kernel(x.reshape(2, 8, 8)), "boundary_f1 double, hd95 double, assd double, both long")
    return rounded(out.where("both = 1").drop("both"))


@query(PX + """, w AS (SELECT vec_id, (g % 7) * 1.0::DOUBLE AS a, g / 255.0::DOUBLE AS b FROM px), t AS (SELECT vec_id, avg(b) AS m, stddev_pop(b) AS s FROM w GROUP BY vec_id), d AS (SELECT vec_id, abs(m - 0.45) / 0.05 + abs(s - 0.05) / 0.02 AS x, abs(m - 0.55) / 0.05 + abs(s - 0.07) / 0.02 AS y FROM t)
SELECT vec_id, CASE WHEN abs(x - y) < 0.05 THEN 'undecided' WHEN x < y THEN 'dark' ELSE 'light' END AS route FROM d""")
def router_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of two centroids in standardised features, if by a margin."""
    m = grids(spark, sf).select("vec_id", F.transform("g", lambda v: v / 255.0).alias("b"))
    m = m.select("vec_id", "b", mean(c("b")).alias("m"))
    m = m.select("vec_id", "m", F.sqrt(mean(F.transform("b", lambda v: (v - c("m")) * (v - c("m"))))).alias("s"))
    far = lambda a, b: F.abs(c("m") - a) / 0.05 + F.abs(c("s") - b) / 0.02
    x, y = far(0.45, 0.05), far(0.55, 0.07)
    return m.select("vec_id", F.when(F.abs(x - y) < 0.05, "undecided").when(x < y, "dark").otherwise("light").alias("route"))


# kernels that SQL doesn't express; tests hold them against definitions


def _rgb(g: np.ndarray) -> np.ndarray:
    b = g.astype(np.uint8)
    return np.stack([b, b.T, 255 - b], -1)


def _kernel_query(name: str, kernel, schema: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return over(spark, sf, lambda g: kernel(_rgb(g)), schema)

    run.__name__ = name
    query()(run)


def _total(f):
    return lambda i: {"total": float(np.asarray(f(i), np.float64).sum())}


for _name, _f in {
    "kernel_clahe": lambda i: k.on_lightness(i, k.clahe),
    "kernel_retinex": lambda i: k.retinex(i, 2.0),
    "kernel_guided": lambda i: k.filtered(i, "guided"),
    "kernel_median": lambda i: k.filtered(i, "median"),
    "kernel_bilateral": lambda i: k.filtered(i, "bilateral"),
    "kernel_shading": lambda i: k.shading_corrected(i, 2.0),
    "kernel_specular": lambda i: regions.filled(i, k.specular(i)),
    "kernel_black_frame": k.black_frame,
    "kernel_dark_artifacts": k.dark_artifacts,
    "kernel_unsharp": k.unsharp,
    "kernel_gabor": k.gabor,
    "kernel_wavelet": k.wavelet_energy,
    "kernel_density": k.density_component,
    "kernel_invariant": k.invariant_gray,
    "kernel_shade_attenuated": lambda i: k.shade_attenuated(i, 2.0),
    "kernel_chromaticity": k.red_chromaticity,
    "kernel_wiener": lambda i: k.wiener(k.luminance(i)),
    "kernel_deblock": lambda i: k.deblock(k.luminance(i), 4),
    "kernel_ciede2000": lambda i: k.ciede2000(k.to_lab(i), k.to_lab(i[::-1])),
    "kernel_modulation": lambda i: k.modulated(i)[0],
    "kernel_contour": lambda i: k.refine(i, k.saliency(i), 0.5)[0],
    "kernel_jpeg": lambda i: k.corrupt(i, "jpeg"),
    "kernel_blur": lambda i: k.corrupt(i, "gaussian_blur"),
    "kernel_noise": lambda i: k.corrupt(i, "gaussian_noise", 7),
    "kernel_boundary_proxy": regions.boundary_proxy,
    "kernel_superpixels": lambda i: regions.superpixels(i, 4),
    "kernel_regions": lambda i: regions.described(i, regions.superpixels(i, 4)),
    "kernel_resize": lambda i: k.resize(i, 5, 7),
    "kernel_preprocess": lambda i: channels.preprocess(i, {"clahe": {}, "contrast_stretch": {}, "filter": {"kind": "median"}, "extra_channel": {"name": "lbp_texture"}}),
}.items():
    _kernel_query(_name, _total(_f), "total double")
_kernel_query("kernel_ssim", lambda i: {"ssim": k.ssim(i, i[:, ::-1], 64)}, "ssim double")
_kernel_query("kernel_phash", lambda i: {"code": k.phash(i)}, "code long")
_kernel_query("kernel_quality", lambda i: {"class": k.quality_class(i)}, "class string")
_kernel_query("kernel_noise_sigma", lambda i: {"sigma": k.noise_sigma(k.luminance(i))}, "sigma double")


@query(PX + "SELECT vec_id, 8 AS height, 8 AS width, CAST(sum(g) AS BIGINT) AS total, count(*) FILTER (WHERE g > 127) AS masked FROM px GROUP BY vec_id")
def image_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Rasters as PNG files (grey or colours, 8 or 16 bits, each filter of rows), decoded again as grey levels and as masks; sizes from the headers."""
    from attestor.sources import rasters

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            made = []
            for n, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                image = np.repeat(np.array(g, np.uint8).reshape(8, 8, 1), (1, 2, 3, 4)[n % 4], axis=2)
                made.append(rasters.encode_png(image, n % 5 if n % 7 else None, 16 if n % 3 == 0 else 8))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["vec_id", "content"])

    files = grids(spark, sf).mapInArrow(encode, "vec_id long, content binary")
    both = rasters.decoded(files, "vec_id", form="grey").select("vec_id", c("pixels").alias("grey"))
    both = both.join(rasters.decoded(files, "vec_id", form="mask").select("vec_id", c("pixels").alias("mask")), "vec_id").join(rasters.sizes(files, "vec_id"), "vec_id")
    levels = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("long"))
    total = lambda x: F.aggregate(levels(x), F.lit(0).cast("long"), lambda a, v: a + v)
    return both.select("vec_id", "height", "width", total("grey").alias("total"), total("mask").alias("masked"))


@query()
def calibrated_prior(spark: SparkSession, sf: str) -> DataFrame:
    """A forest on superpixels, clean and with noise, scored out of fold; every threshold with its figures, and which one is taken."""
    from attestor.operators import prior

    g = grids(spark, sf)
    rgb = F.flatten(F.transform("g", lambda v, i: F.array(v, F.get("g", (i % 8) * 8 + F.floor(i / 8).cast("int")), 255 - v)))
    images = g.select(c("vec_id").alias("id"), c("vec_id").cast("string").alias("group_key"), rgb.alias("pixels"), F.transform("g", lambda v: (v > 140).cast("int")).alias("mask"))
    rows = prior.region_rows(spread(images, "id").sortWithinPartitions("id"), 8, 8, 6)
    from attestor.operators.graphs import ensure_checkpoint_dir

    ensure_checkpoint_dir(rows)
    return prior.thresholds(prior.out_of_fold(rows.checkpoint()))
