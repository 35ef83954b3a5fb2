"""Array, colour and grid kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import color, fields
from quarry.functions import columns as C
from quarry.functions import vectors as V
from quarry.registry import query, table


@query("field_measures", "SELECT vec_id, round(list_count(list_filter(embedding, lambda x: x < -0.1)) / len(embedding), 6) AS interior, round(list_stddev_pop(list_filter(embedding::DOUBLE[], lambda x: x >= -0.1::FLOAT)), 6) AS std FROM embeddings")
def field_measures(spark, d):
    v = F.transform("embedding", lambda x: F.when(x < F.lit(-0.1).cast("float"), F.lit(float("nan")).cast("float")).otherwise(x))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.interior_fraction(v), 6).alias("interior"), F.round(V.finite_std(v), 6).alias("std"))


@query("cycles_spanned", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round((quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) * 3, 6) AS cycles FROM e GROUP BY 1")
def cycles_spanned(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return e.groupBy("vec_id").agg(F.round((F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05))) * 3, 6).alias("cycles"))


TILES = "t AS (SELECT vec_id, ((i - 1) // 8) // 4 * 2 + ((i - 1) % 8) // 4 AS tile, max(x) - min(x) AS span, count(*) FILTER (x >= -0.1::FLOAT) / count(*) AS finite FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)"


@query("tile_coverage", f"WITH {TILES} SELECT vec_id, round(avg((span >= 0.5 AND finite >= 0.25)::INT), 6) AS coverage, round(quantile_cont(span::DOUBLE, 0.25), 6) AS q25 FROM t GROUP BY 1")
def tile_coverage(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    tile = F.expr("(i div 8) div 4 * 2 + (i % 8) div 4")
    t = cells.groupBy("vec_id", tile.alias("tile")).agg((F.max("x") - F.min("x")).alias("span"), (F.count_if(F.col("x") >= F.lit(-0.1).cast("float")) / F.count("*")).alias("finite"))
    return t.groupBy("vec_id").agg(F.round(F.avg(((F.col("span") >= 0.5) & (F.col("finite") >= 0.25)).cast("int")), 6).alias("coverage"), F.round(F.percentile(F.col("span").cast("double"), F.lit(0.25)), 6).alias("q25"))


@query("composite_richness", """
WITH m AS (SELECT p_partkey, least(1, p_size / 40.0)::DOUBLE AS cov, least(2, greatest(0, (p_retailprice - 900) / 487)) AS rich, CASE WHEN p_size < 5 THEN 0.5 WHEN p_size > 45 THEN 0.8 ELSE 1 END::DOUBLE AS sz, p_size % 10 = 7 AS veto FROM part) SELECT p_partkey, CASE WHEN veto THEN 0 ELSE round(cov * rich * sz, 4) END::DOUBLE AS score FROM m""")
def composite_richness(spark, d):
    cov, rich = F.least(F.lit(1.0), F.col("p_size") / 40.0), F.least(F.lit(2.0), F.greatest(F.lit(0.0), (F.col("p_retailprice") - 900) / 487))
    band = F.when(F.col("p_size") < 5, 0.5).when(F.col("p_size") > 45, 0.8).otherwise(1.0)
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 7, 0.0).otherwise(F.round(cov * rich * band, 4)).alias("score"))


@query("emd_1d", """
WITH h AS (SELECT floor(l_quantity / 5)::INT AS bin, count(*) FILTER (l_returnflag = 'A') / sum(count(*) FILTER (l_returnflag = 'A')) OVER () AS a, count(*) FILTER (l_returnflag = 'N') / sum(count(*) FILTER (l_returnflag = 'N')) OVER () AS b FROM lineitem GROUP BY 1), c AS (SELECT abs(sum(a - b) OVER (ORDER BY bin)) AS d FROM h) SELECT round(sum(d), 6) AS emd FROM c""")
def emd_1d(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"))
    s = h.groupBy().agg(F.array_sort(F.collect_list(F.struct("bin", "a", "b"))).alias("h"), F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return s.select(F.round(V.emd_1d(F.transform("h", lambda x: x["a"] / F.col("ta")), F.transform("h", lambda x: x["b"] / F.col("tb"))), 6).alias("emd"))


@query("cosine_to_first", "WITH f AS (SELECT embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], f) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(f, f))), 6) AS cos FROM embeddings, f")
def cosine_to_first(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("f"))
    return e.join(F.broadcast(first), F.lit(True)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("f")), 6).alias("cos"))


@query("window_scan", """
WITH c AS (SELECT event_id // 4 AS y, value FROM events), w AS (SELECT value, unnest(range(greatest(0, (y - 5) // 5 * 5), y // 5 * 5 + 1, 5)) AS y0 FROM c)
SELECT y0, count(*) AS n, round(count(*) FILTER (value < 20) / count(*), 6) AS black, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS var FROM w GROUP BY 1 HAVING count(*) FILTER (value < 20) / count(*) <= 0.4 AND var_pop(value) >= 100""")
def window_scan(spark, d):
    """Windows of 10 lines every 5: each pixel goes to the windows that hold it."""
    c = table(spark, d, "events").select(F.expr("event_id div 4").alias("y"), "value")
    own = F.expr("sequence(greatest(0L, (y - 5) div 5 * 5), y div 5 * 5, 5L)")
    w = c.select(F.explode(own).alias("y0"), "value").groupBy("y0")
    out = w.agg(F.count("*").alias("n"), (F.count_if(F.col("value") < 20) / F.count("*")).alias("black"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return out.where("black <= 0.4 and var >= 100").select("y0", "n", F.round("black", 6).alias("black"), F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


@query("density_focus", """
WITH c AS (SELECT user_id % 10 AS g, event_id % 16 AS x, event_id // 16 % 9 AS y, value, event_id FROM events) SELECT g, CASE WHEN sum(value) FILTER (value > 50) > 0 THEN round(sum(value * x) FILTER (value > 50) / sum(value) FILTER (value > 50), 6) ELSE arg_max(x, value * 1000000 - event_id)::DOUBLE END AS fx, round(sum(value * y) FILTER (value > 50) / sum(value) FILTER (value > 50), 6) AS fy FROM c GROUP BY 1""")
def density_focus(spark, d):
    c = table(spark, d, "events").select((F.col("user_id") % 10).alias("g"), (F.col("event_id") % 16).alias("x"), (F.expr("event_id div 16") % 9).alias("y"), "value", "event_id")
    w = F.when(F.col("value") > 50, F.col("value"))
    peak = F.max_by("x", F.col("value") * 1000000 - F.col("event_id")).cast("double")
    return c.groupBy("g").agg(F.coalesce(F.round(F.sum(w * F.col("x")) / F.sum(w), 6), peak).alias("fx"), F.round(F.sum(w * F.col("y")) / F.sum(w), 6).alias("fy"))


STRETCH = "WITH r AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), b AS (SELECT max(v) FILTER (i = floor(0.005 * (n - 1) + 0.5)) AS lo, max(v) FILTER (i = floor(0.995 * (n - 1) + 0.5)) AS hi FROM r), u AS (SELECT p_partkey, least(1, greatest(0, (v - lo) / (hi - lo))) AS u FROM r, b) "


@query("percentile_stretch", STRETCH + "SELECT p_partkey, round(u, 6) AS linear, round(sqrt(u), 6) AS root, round(ln(1 + 9 * u) / ln(10.0), 6) AS log, round(u * u * (3 - 2 * u), 6) AS scurve, round(cume_dist() OVER (ORDER BY u), 6) AS histeq FROM u")
def percentile_stretch(spark, d):
    from quarry.operators.aggregate import nearest_rank

    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    lo, hi = (nearest_rank(p, "p_retailprice", q, []).select(F.col("quantile").alias(n)) for q, n in ((0.005, "lo"), (0.995, "hi")))
    u = p.join(F.broadcast(lo), F.lit(True)).join(F.broadcast(hi), F.lit(True)).withColumn("u", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo")))))
    t = lambda m, n: F.round(C.transform_unit(m, F.col("u")), 6).alias(n)
    return u.select("p_partkey", t("linear", "linear"), t("sqrt", "root"), t("log", "log"), t("scurve", "scurve"), F.round(F.cume_dist().over(W.orderBy("u")), 6).alias("histeq"))


LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"
RGB = "SELECT p_partkey, " + ", ".join(f"{LIN.format(c=c)} AS {n}" for c, n in (("(p_size / 50.0)::DOUBLE", "r"), ("((p_partkey % 256) / 255.0)::DOUBLE", "g"), ("((p_partkey * 7 % 256) / 255.0)::DOUBLE", "b"))) + " FROM part"


def rgb():
    return F.col("p_size") / 50.0, F.col("p_partkey") % 256 / 255.0, F.col("p_partkey") * 7 % 256 / 255.0


@query("colour_oklab", f"""
WITH c AS ({RGB}), m AS (SELECT p_partkey, cbrt(0.4122214708*r + 0.5363325363*g + 0.0514459929*b) AS l, cbrt(0.2119034982*r + 0.6806995451*g + 0.1073969566*b) AS m, cbrt(0.0883024619*r + 0.2817188376*g + 0.6299787005*b) AS s FROM c)
SELECT p_partkey, round(0.2104542553*l + 0.7936177850*m - 0.0040720468*s, 6) AS "L", round(1.9779984951*l - 2.4285922050*m + 0.4505937099*s, 6) AS a, round(0.0259040371*l + 0.7827717662*m - 0.8086757660*s, 6) AS b FROM m""")
def colour_oklab(spark, d):
    lab = color.oklab(*rgb())
    return table(spark, d, "part").select("p_partkey", *(F.round(x, 6).alias(n) for x, n in zip(lab, ("L", "a", "b"), strict=True)))


@query("colour_luma", "SELECT p_partkey, round(0.2126 * p_size / 50.0 + 0.7152 * (p_partkey % 256) / 255.0 + 0.0722 * (p_partkey * 7 % 256) / 255.0, 6)::DOUBLE AS luma, (0.2126 * p_size / 50.0 + 0.7152 * (p_partkey % 256) / 255.0 + 0.0722 * (p_partkey * 7 % 256) / 255.0) * 255 >= 70 AS bright FROM part")
def colour_luma(spark, d):
    y = color.luma(*rgb())
    return table(spark, d, "part").select("p_partkey", F.round(y, 6).alias("luma"), (y * 255 >= 70).alias("bright"))


def lab_sql(name: str, r: str, g: str, b: str) -> str:
    """SQL of the columns l, a and b (with a suffix) of linear light."""
    f = [f"({' + '.join(f'{k!r} * {c}' for k, c in zip(row, (r, g, b), strict=True))}) / {white!r}" for row, white in zip(color.SRGB_XYZ, color.WHITE, strict=True)]
    x, y, z = (f"(CASE WHEN {t} > {216 / 24389!r} THEN cbrt({t}) ELSE ({24389 / 27!r} * {t} + 16) / 116 END)" for t in (f"({v})::DOUBLE" for v in f))
    return f"116 * {y} - 16 AS l{name}, 500 * ({x} - {y}) AS a{name}, 200 * ({y} - {z}) AS b{name}"


LIGHT = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92::DOUBLE ELSE pow(({0} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS {0}"
HUE = "CASE WHEN {0} = 0 AND {1} = 0 THEN 0 WHEN atan2({0}, {1}) < 0 THEN degrees(atan2({0}, {1})) + 360 ELSE degrees(atan2({0}, {1})) END"


@query("ciede2000", f"""
WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS r, p_partkey % 256 / 255.0::DOUBLE AS g, p_partkey * 7 % 256 / 255.0::DOUBLE AS b FROM part),
i AS (SELECT p_partkey, {LIGHT.format("r")}, {LIGHT.format("g")}, {LIGHT.format("b")} FROM p), lab AS (SELECT p_partkey, {lab_sql("1", "r", "g", "b")}, {lab_sql("2", "b", "r", "g")} FROM i),
s AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS m FROM lab), t AS (SELECT *, a1 * (1.5 - 0.5 * sqrt(m / (m + 6103515625))) AS x1, a2 * (1.5 - 0.5 * sqrt(m / (m + 6103515625))) AS x2 FROM s),
u AS (SELECT *, sqrt(x1 * x1 + b1 * b1) AS c1, sqrt(x2 * x2 + b2 * b2) AS c2, {HUE.format("b1", "x1")} AS h1, {HUE.format("b2", "x2")} AS h2 FROM t),
v AS (SELECT *, (c1 + c2) / 2 AS c, (l1 + l2) / 2 AS l, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS h FROM u),
w AS (SELECT *, 1 - 0.17 * cos(radians(h - 30)) + 0.24 * cos(radians(2 * h)) + 0.32 * cos(radians(3 * h + 6)) - 0.2 * cos(radians(4 * h - 63)) AS t, -2 * sqrt(pow(c, 7) / (pow(c, 7) + 6103515625)) * sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) AS rt,
  (l2 - l1) / (1 + 0.015 * pow(l - 50, 2) / sqrt(20 + pow(l - 50, 2))) AS dl, (c2 - c1) / (1 + 0.045 * c) AS dc FROM v),
x AS (SELECT *, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * c * t) AS hue FROM w)
SELECT p_partkey, round(sqrt(dl * dl + dc * dc + hue * hue + rt * dc * hue), 6) AS de FROM x""")
def ciede2000(spark, d):
    a, b = color.cielab(*rgb()), color.cielab(rgb()[2], rgb()[0], rgb()[1])
    p = table(spark, d, "part").select("p_partkey", *(x.alias(n) for x, n in zip([*a, *b], ("l1", "a1", "b1", "l2", "a2", "b2"), strict=True)))
    return color.ciede2000(p, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").select("p_partkey", F.round("de", 6).alias("de"))


@query("palette_classes", """
WITH s AS (SELECT p_partkey, list_transform(range(0, 8), lambda i: ((p_partkey * (i + 3) * 37) % 256)::DOUBLE) AS v FROM part) SELECT p_partkey, round(list_sum(list_transform(range(2, 9), lambda i: abs(v[i] - v[i - 1]))), 4) AS variation, abs(v[8] - v[1]) AS seam, CASE WHEN abs(v[8] - v[1]) <= 40 THEN 'cyclic' WHEN v[8] > v[1] THEN 'rising' ELSE 'falling' END AS family, list_max(v) - list_min(v) AS span FROM s""")
def palette_classes(spark, d):
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("p_partkey") * (i + 3) * 37 % 256).cast("double"))
    p = table(spark, d, "part").select("p_partkey", v.alias("v"))
    seam = F.abs(F.element_at("v", 8) - F.element_at("v", 1))
    family = F.when(seam <= 40, "cyclic").when(F.element_at("v", 8) > F.element_at("v", 1), "rising").otherwise("falling")
    return p.select("p_partkey", F.round(V.arc_length(F.col("v")), 4).alias("variation"), seam.alias("seam"), family.alias("family"), (F.array_max("v") - F.array_min("v")).alias("span"))


@query("composite_tones", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS b, l_discount * 10 AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round(b * t, 6)::DOUBLE AS multiply, round(1 - (1 - b) * (1 - t), 6)::DOUBLE AS screen, round(CASE WHEN b < 0.5 THEN 2 * b * t ELSE 1 - 2 * (1 - b) * (1 - t) END, 6)::DOUBLE AS overlay, round(least(b, t), 6)::DOUBLE AS lowest,
  round(b / (1 + b), 6)::DOUBLE AS reinhard, round(least(1, greatest(0, b * (2.51 * b + 0.03) / (b * (2.43 * b + 0.59) + 0.14))), 6)::DOUBLE AS aces FROM c""")
def composite_tones(spark, d):
    b, t = F.col("l_quantity") / 50.0, F.col("l_discount") * 10
    mix = [F.round(C.combine(m, b, t), 6).alias(n) for m, n in (("multiply", "multiply"), ("screen", "screen"), ("overlay", "overlay"), ("min", "lowest"))]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *mix, F.round(C.tone("reinhard", b), 6).alias("reinhard"), F.round(C.tone("aces", b), 6).alias("aces"))


@query("bounded_reframe", """
WITH f AS (SELECT p_partkey, p_retailprice, k, -abs(p_retailprice * k - 1200) AS s FROM part, (VALUES (0.8), (1.0), (1.25)) v(k)), b AS (SELECT p_partkey, arg_max(k, s * 1000 - k) AS k, any_value(p_retailprice) AS p FROM f GROUP BY 1),
g AS (SELECT p_partkey, k, dx, dy, -(abs(p * k + 40 * dx - 1200) + abs(p_partkey % 50 + 20 * dy - 25)) AS s FROM b, (VALUES (-1), (0), (1)) x(dx), (VALUES (-1), (0), (1)) y(dy))
SELECT p_partkey, k::DOUBLE AS k, dx, dy FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(s, 6) DESC, dx, dy) AS rn FROM g) WHERE rn = 1""")
def bounded_reframe(spark, d):
    """Best width factor, then the best of nine shifts: both by one aggregation over exploded candidates."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("p"))
    f = p.withColumn("k", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.25)))))
    b = f.groupBy("p_partkey", "p").agg(F.max_by("k", -F.abs(F.col("p") * F.col("k") - 1200) * 1000 - F.col("k")).alias("k"))
    shifts = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    g = b.withColumn("m", F.explode(shifts))
    s = -(F.abs(F.col("p") * F.col("k") + 40 * F.col("m.dx") - 1200) + F.abs(F.col("p_partkey") % 50 + 20 * F.col("m.dy") - 25))
    best = g.groupBy("p_partkey", "k").agg(F.max(F.struct(F.round(s, 6).alias("s"), (-F.col("m.dx")).alias("x"), (-F.col("m.dy")).alias("y"))).alias("b"))
    return best.select("p_partkey", "k", (-F.col("b.x")).alias("dx"), (-F.col("b.y")).alias("dy"))


def _views(spark, d):
    """Small views of the plane, one for each supplier."""
    return table(spark, d, "supplier").select("s_suppkey", (-0.6 + F.col("s_nationkey") / 100.0).alias("cx"), (F.col("s_acctbal") / 20000).alias("cy"), F.lit(0.5).alias("w"))


def _per_view(spark, d, kernel, schema):
    import pandas as pd

    def run(batches):
        for f in batches:
            yield pd.DataFrame([{"s_suppkey": r.s_suppkey, **kernel(fields.plane(r.cx, r.cy, r.w, 12, 16))} for r in f.itertuples()], columns=[c.split()[0] for c in schema.split(", ")])

    return _views(spark, d).mapInPandas(run, schema)


@query("escape_fields")
def escape_fields(spark, d):
    def kernel(c):
        s = fields.smooth_count(c, 64)
        r = fields.radial(s, 16, 6)
        return {"interior": float(np.isnan(s).mean()), "rings": r["rings"], "extent": r["extent"], "energy": float(fields.edge_energy(np.repeat(np.nan_to_num(s)[..., None], 3, 2)).mean())}

    return _per_view(spark, d, kernel, "s_suppkey long, interior double, rings double, extent double, energy double")


@query("orbit_fields")
def orbit_fields(spark, d):
    def kernel(c):
        f = fields.orbit_fields(c, 48, ("smooth", "stripe", "trap", "curvature"))
        return {k: float(np.nanmean(x)) if np.isfinite(x).any() else None for k, x in f.items()}

    return _per_view(spark, d, kernel, "s_suppkey long, smooth double, stripe double, trap double, curvature double")


@query("field_foci")
def field_foci(spark, d):
    def kernel(c):
        f = fields.foci(np.nan_to_num(fields.smooth_count(c, 64)), (1,), 2, 3)
        return {"n": len(f), "y": float(f[0, 0]) if len(f) else None, "x": float(f[0, 1]) if len(f) else None, "strength": float(f[0, 2]) if len(f) else None}

    return _per_view(spark, d, kernel, "s_suppkey long, n long, y double, x double, strength double")


@query("shaded_tiles")
def shaded_tiles(spark, d):
    ramp = fields.cyclic_table([(0.0, (0, 0, 0)), (0.3, (1, 0.5, 0)), (0.7, (0.2, 0.4, 1))], 64)

    def kernel(c):
        img = fields.shade(fields.smooth_count(c, 64), ramp, 0.05, 0.1)
        small = np.stack([fields.resample(img[..., k], 2, "mitchell") for k in range(3)], 2)
        return {"r": float(img[..., 0].mean()), "g": float(img[..., 1].mean()), "b": float(img[..., 2].mean()), "small": float(small.mean()), "occupied": fields.occupancy(fields.edge_energy(img), 4, 0.05)}

    return _per_view(spark, d, kernel, "s_suppkey long, r double, g double, b double, small double, occupied double")


@query("period_polynomials")
def period_polynomials(spark, d):
    """Degree and sum of coefficients of the exact-period polynomials."""
    return spark.createDataFrame([(n + 1, len(p) - 1, int(sum(p))) for n, p in enumerate(fields.period_polynomials(7))], "period int, degree int, total long")


@query("gradient_profiles")
def gradient_profiles(spark, d):
    e = table(spark, d, "embeddings")
    f = fields.grid_udf(lambda v: fields.gradient_profile(v, 8), 8, "array<double>")
    return e.select("vec_id", f(F.col("embedding").cast("array<double>")).alias("profile")).select("vec_id", *(F.round(F.col("profile")[i], 6).alias(f"p{i}") for i in range(8)))


@query("extracted_palettes")
def extracted_palettes(spark, d):
    """A closed ramp of 8 colours from each label's vectors, laid end to end, three entries a colour (the first fill up the last)."""
    import pandas as pd

    def run(f):
        line = np.concatenate(f.sort_values("vec_id")["embedding"].tolist()).astype(float)
        px = np.append(line, line[: -len(line) % 3]).reshape(-1, 3)
        ramp = fields.extract_palette(px, 8, 0.1)
        return pd.DataFrame({"label": f["label"].iloc[0], "stop": range(8), "x": ramp[:, 0], "y": ramp[:, 1], "z": ramp[:, 2]})

    out = table(spark, d, "embeddings").groupBy("label").applyInPandas(run, "label int, stop long, x double, y double, z double")
    return out.select("label", "stop", *(F.round(c, 6).alias(c) for c in "xyz"))
