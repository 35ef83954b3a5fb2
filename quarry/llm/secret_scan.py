"""Secret scans: strong patterns as they stand; weak candidates only where an interval join links complementary parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Table

#: Kinds in the order in which equal starts are listed; pattern, what a cheap test looks for, and part played.
#: A run that is too short for hex or access cannot hide a longer match, so the length stands in the pattern there;
#: assign consumes short values, so they are dropped afterwards.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", "identifier"),
    "hex": (r"[0-9a-f]{24,}", "secret"),
    "user": (r"""(?i)(username|user_id|login|client_id|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "identifier"),
    "blob": (r"[A-Za-z0-9+/]{40,}={0,2}", "secret"),
    "endpoint": (r"""(?i)(https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+""", "endpoint"),
}
BASE = ("assign", "access", "hex")
MIN_VALUE = 6
#: Cells in which the interval join looks for parts, in code points.
CELL = 1024
#: So many spans (about 80 bytes each) at most are sent to each task.
SENT_SPANS = 200_000


def _hits(text: Column, kind: str) -> Column:
    """Length of the text before each match since the one before it, and the match; leftmost ones that do not overlap."""
    pattern, role = KINDS[kind]
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("skip"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    order = list(KINDS).index(kind)
    found = F.transform(
        F.filter(zipped, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), x["skip"].alias("skip"), F.length(x["hit"]).alias("size"), _sound(x["hit"], kind).alias("sound")),
    )
    none = F.array().cast("array<struct<kind:int,nth:int,skip:int,size:int,sound:boolean>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _sound(hit: Column, kind: str) -> Column:
    return F.length(F.regexp_extract(hit, KINDS[kind][0], 2)) >= MIN_VALUE if kind == "assign" else F.lit(True)


def parts(docs: DataFrame, keys: list[str], repeated: bool = False) -> DataFrame:
    """keys, kind (its place in KINDS; -1 once for each row), start and stop (code points) of all candidate spans.

    Texts are searched once: the matches are written to the shared folder, and the rest works on them. repeated: keys may
    occur in several rows, all of equal text; their matches count once, as places are sums of lengths over a key's matches.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("skip"), F.lit(0).alias("size"), F.lit(True).alias("sound")))
    every = F.concat(row, *(_hits(F.col("_text"), k) for k in KINDS))
    hits = Table(docs.select(*keys, text.alias("_text")).select(*keys, F.explode(every).alias("x")).select(*keys, "x.*")).df
    if repeated:
        hits = hits.dropDuplicates([*keys, "kind", "nth"])
    before = W.partitionBy(keys[0], "kind").orderBy("nth")
    stop = F.sum(F.col("skip").cast("long") + F.col("size")).over(before)
    placed = hits.where("kind >= 0").select(*keys, "kind", (stop - F.col("size")).alias("start"), stop.alias("stop"), "sound").where("sound").drop("sound")
    return placed.union(hits.where("kind < 0").select(*keys, "kind", F.lit(0).cast("long"), F.lit(0).cast("long")))


def linked(found: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Base spans, and weak ones that have a part of another role at most `reach` code points away in the same text.

    The interval join meets in cells of CELL code points: a weak span looks into the cells that its scope covers.
    """
    names, roles = list(KINDS), [KINDS[k][1] for k in KINDS]
    role = F.element_at(F.array(*map(F.lit, roles)), F.col("kind") + 1)
    strong = F.col("kind").isin([names.index(k) for k in BASE])
    spans = found.where("kind >= 0").withColumn("role", role)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL)))
    weak = spans.where(~strong).withColumn("cell", cells(F.greatest(F.col("start") - reach, F.lit(0)), F.col("stop") + reach))
    others = spans.select(*(F.col(k).alias(f"o_{k}") for k in keys[:1]), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), cells(F.col("start"), F.col("stop")).alias("o_cell"))
    near = (F.col(keys[0]) == F.col(f"o_{keys[0]}")) & (F.col("cell") == F.col("o_cell")) & (F.col("role") != F.col("o_role")) & (F.col("o_start") <= F.col("stop") + reach) & (F.col("o_stop") >= F.col("start") - reach)
    kept = weak.join(others, near, "left_semi").select(*keys, "kind", "start", "stop").distinct()
    return spans.where(strong).select(*keys, "kind", "start", "stop").union(kept)


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs(doc_id, text).

    Access identifiers, secrets and endpoints are parts. Kinds in BASE are reported as they stand. Of the others, each
    needs a part of another role within `reach` code points: an interval join over the texts' spans.

    A null text counts as empty and gives a row without spans; doc_id may be null; repeated rows each give a row. Spans
    of one kind do not overlap; spans of different kinds may, and equal starts are listed in the order of KINDS. Other
    columns are ignored. Texts are read whole; a text's spans are dealt by cells of CELL code points.
    """
    keys = ["row", "doc_id"]
    found = parts(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), keys)
    spans = linked(found, keys, reach).union(found.where("kind < 0"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    every = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "stop")))).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("s", lambda x: x["kind"] < len(BASE))
    return every.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", reach: int = 200) -> DataFrame:
    """docs with each span, overlapping ones as one, replaced by `mark`, and n_chars, if there, counted anew.

    Rows meet their spans by doc_id and a hash of the text, so equal rows fare alike; texts without spans stay as they are.
    Of equal rows the spans of one are placed. Up to SENT_SPANS spans are sent to the texts; more meet them by a shuffle.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    taken = max(map(len, docs.columns)) * "_"  # no column of docs starts with so many
    named = docs.withColumn(f"{taken}_key", key)
    found = parts(named.select(F.col(f"{taken}_key").alias("row"), "text"), ["row"], repeated=True)
    spans = Table(linked(found, ["row"], reach).distinct(), narrow=True).df
    few = spans.count() <= SENT_SPANS
    spans = spans.groupBy(F.col("row").alias(f"{taken}_row")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(f"{taken}_spans"))
    spans = F.broadcast(spans) if few else spans
    at = F.col(f"{taken}_spans")
    text, n = F.col("text"), F.length("text")
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["stop"]).alias("at"),
    )
    ends = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), n))
    masked = F.aggregate(at, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, ends)
    out = named.join(spans, F.col(f"{taken}_key") == F.col(f"{taken}_row"), "left").withColumn("text", F.when(at.isNotNull(), masked).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(at.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
