"""Column functions: keys, predicates, decoding, rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def location_key(*parts: Column | str) -> Column:
    """Parts joined by |, null as an empty part (concat_ws alone would skip it)."""
    return F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def join_key(location: Column, *parts: str) -> Column:
    """The composite identity of a row: its location and further columns."""
    return F.struct(location.alias("location"), *parts)


def slug(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_")


def namespaced_id(path: Column, row_id: Column) -> Column:
    return F.concat(slug(path), F.lit("__"), row_id.cast("string"))


def safe_name(name: Column) -> Column:
    """Characters outside letters, digits, ., _ and - become _."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def hash_pick(key: Column, n: int) -> Column:
    """The first 8 hex digits of md5(key), mod n."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that does not hold (null counts as not holding); null if all hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The class of the first pattern found in text."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(c)) for p, c in rules), F.lit(default))


def lookup(key: Column, values: Mapping[str, str]) -> Column:
    """The value of a key in a small fixed map; null for other keys."""
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def resolve_partition(kind: Column, values: Mapping[str, str], x: Column, y: Column, special: tuple[float, float], special_name: str) -> Column:
    """A kind's partition: tokens that are partitions already pass; an exact point has a partition of its own."""
    passed = F.when(kind.isin(sorted(set(values.values()))), kind)
    return F.when((x == special[0]) & (y == special[1]), F.lit(special_name)).otherwise(F.coalesce(passed, lookup(kind, values)))


def schema_era(walk: Column, campaign: Column) -> Column:
    """walk or campaign by which field is present; both is an error, neither null."""
    both = F.raise_error(F.lit("row has the fields of both eras")).cast("string")
    return F.when(walk.isNotNull() & campaign.isNotNull(), both).when(walk.isNotNull(), "walk").when(campaign.isNotNull(), "campaign")


def collapse(category: Column, prefixes: Sequence[tuple[str, str]], default: str) -> Column:
    """The coarse group of the first prefix that fits."""
    return F.coalesce(*(F.when(category.startswith(p), F.lit(g)) for p, g in prefixes), F.lit(default))


def ordinal_decode(p2: Column, p3: Column, p4: Column, t_good: float = 0.5, t_bad: float = 0.5, t_great: float = 0.5) -> Column:
    """1 and one for each threshold met."""
    return 1 + (p2 >= t_bad).cast("int") + (p3 >= t_good).cast("int") + (p4 >= t_great).cast("int")


def score_band(score: Column, decoded: Column, t_good: float, t_high: float) -> Column:
    return F.when(decoded <= 1, "REJECT").when(score < t_good, "SUB").when(score < t_high, "Q3").otherwise("HIGH")


def band_verdict(interior: Column, median: Column, spread: Column, max_interior: float, min_median: float, min_spread: float) -> Column:
    """Primary reason by priority, and signed margins (positive: passes)."""
    reason = F.when(interior > max_interior, "interior").when(median < min_median, "median").when(spread < min_spread, "spread")
    return F.struct(reason.alias("reason"), (max_interior - interior).alias("m_interior"), (median - min_median).alias("m_median"), (spread - min_spread).alias("m_spread"))


def guard_fail(interior: Column, std: Column, max_interior: float = 0.25, min_std: float = 6.0) -> Column:
    """interior, flat, both or null."""
    a, b = interior >= max_interior, std < min_std
    return F.when(a & b, "both").when(a, "interior").when(b, "flat")


def admitted(current: Column, guard: Column, distinct: Column, source: Column, bypass: Sequence[str], decoded: Column, least: int = 3) -> Column:
    """Conjunction of the gates; missing flags count as false, a missing class as 0; sources in bypass skip the class gate."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return flag(current) & flag(guard) & flag(distinct) & (flag(source.isin(list(bypass))) | (F.coalesce(decoded, F.lit(0)) >= least))


def stamped_cut(score: Column, value: float, live: str, stamp: str) -> Column:
    """score >= value, an error if the live version is not the one the cut was stamped for."""
    return F.when(F.lit(live) == stamp, score >= value).otherwise(F.raise_error(F.lit(f"cut stamped for {stamp}, live is {live}")).cast("boolean"))


def require_current(version: Column, live: str) -> Column:
    """true where the version is live; an error elsewhere."""
    return F.when(version == live, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not current: "), F.coalesce(version, F.lit("null")))).cast("boolean"))


def flags(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named)))


def auto_maxiter(width: Column, base: float = 500.0, k: float = 0.35, lo: int = 300, hi: int = 20_000) -> Column:
    """base (1 + k log2(3 / width)), rounded half to even, within lo and hi."""
    return F.least(F.greatest(F.bround(base * (1 + k * F.log2(3.0 / width)), 0).cast("long"), F.lit(lo).cast("long")), F.lit(hi).cast("long"))


def recording_floor(t: Column, floor: float = 0.2, fraction: float = 0.6) -> Column:
    return F.least(t, F.greatest(F.lit(floor), fraction * t))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rank_score(*logits: Column) -> Column:
    """Sum of sigmoids of ordinal logits."""
    out = sigmoid(logits[0])
    for x in logits[1:]:
        out = out + sigmoid(x)
    return out


def linear_score(terms: Sequence[tuple[Column, float, float, float]], bias: float) -> Column:
    """sigmoid of bias + sum of weight (x - mean) / std over (x, mean, std, weight)."""
    z = F.lit(bias)
    for x, mean, std, weight in terms:
        z = z + weight * (x - mean) / std
    return sigmoid(z)


def hinge(margin: float, d: Column) -> Column:
    return F.greatest(F.lit(0.0), margin - d)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of k of n, rounded to 4 places; null for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    ok = lambda c: F.round(F.when(n > 0, c), 4)
    return ok((mid - half) / den), ok((mid + half) / den)


def priority(energy: Column, gumbel: Column, dup_penalty: Column, cos_max: Column, weight: float, beta: float, depth: Column, lo: float, hi: float) -> Column:
    """energy + gumbel - duplicate penalty - novelty penalty + beta depth; the novelty penalty ramps from cosine lo to hi."""
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos_max - lo) / (hi - lo)))
    return energy + gumbel - dup_penalty - weight * F.coalesce(ramp, F.lit(0.0)) + beta * depth


def combine(mode: str, b: Column, t: Column) -> Column:
    """Composite of two channels in [0, 1]."""
    return {"multiply": b * t, "screen": 1 - (1 - b) * (1 - t), "overlay": F.when(b < 0.5, 2 * b * t).otherwise(1 - 2 * (1 - b) * (1 - t)), "min": F.least(b, t)}[mode]


def tone(mode: str, x: Column, knee: float = 0.8) -> Column:
    """Reinhard, the public ACES fit, or a soft knee."""
    aces = (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)
    soft = F.when(x <= knee, x).otherwise(knee + (1 - knee) * (1 - F.exp(-(x - knee) / (1 - knee))))
    return {"reinhard": x / (1 + x), "aces": F.least(F.lit(1.0), F.greatest(F.lit(0.0), aces)), "knee": soft}[mode]


def transform_unit(mode: str, u: Column) -> Column:
    """Of a value in [0, 1]: linear, sqrt, log or scurve."""
    return {"linear": u, "sqrt": F.sqrt(u), "log": F.log1p(9 * u) / F.log(F.lit(10.0)), "scurve": u * u * (3 - 2 * u)}[mode]


def canonical_point(x: Column, y: Column, places: int = 6) -> Column:
    """Rounded coordinates with the sign of y dropped: mirror images share a key."""
    zero = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)
    return F.concat_ws(",", zero(F.bround(x, places)).cast("string"), zero(F.bround(F.abs(y), places)).cast("string"))
