"""URL filters: host and path rules first, else the ratio of two smoothed variable-order Markov models over characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Table

#: Host, path and verdict of each rule.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Characters as the models see them: letters, 0 for any digit, signs, ~ for all others; ^ before and $ after the URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.:?=&#_-~^$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first by name) and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def trigrams(url: Column) -> Column:
    """Each character with the two before it; at least the end of the URL."""
    seen = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    seen = F.regexp_replace(F.regexp_replace(seen, "[0-9]", "0"), r"[^a-z0/.:?=&#_\-]", "~")
    line = F.concat(F.lit("^^"), seen, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(line) - 2), lambda i: F.substring(line, i, 3))


def fit(urls: DataFrame) -> DataFrame:
    """gram and ratio: ln p(third | first two) under accepted URLs less that under rejected ones, for all trigrams of the alphabet.

    urls: class ('allow' or 'block') and gram. Witten-Bell smoothing: each order is mixed with the next lower one by the
    number of different characters seen after its context, down to add-one frequencies of single characters.
    """
    spark, size = urls.sparkSession, len(ALPHABET)
    counts = urls.groupBy("class", "gram").agg(F.count("*").cast("double").alias("n"))
    symbols = F.split(F.lit(ALPHABET), "")
    grid = spark.range(1).select(F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("class"))
    for name in "abc":
        grid = grid.withColumn(name, F.explode(F.array_remove(symbols, "")))
    grid = grid.withColumn("gram", F.concat("a", "b", "c"))
    full = grid.join(counts, ["class", "gram"], "left").fillna(0.0, ["n"])
    seen = lambda c: F.sum((F.col(c) > 0).cast("double"))
    two = full.groupBy("class", "b", "c").agg(F.sum("n").alias("n2"))
    one = two.groupBy("class", "c").agg(F.sum("n2").alias("n1"))
    one = one.withColumn("p1", (F.col("n1") + 1) / (F.sum("n1").over(W.partitionBy("class")) + size))
    of_b = W.partitionBy("class", "b")
    two = two.join(one.select("class", "c", "p1"), ["class", "c"]).withColumn("s2", F.sum("n2").over(of_b)).withColumn("k2", seen("n2").over(of_b))
    two = two.withColumn("p2", F.when(F.col("s2") > 0, (F.col("n2") + F.col("k2") * F.col("p1")) / (F.col("s2") + F.col("k2"))).otherwise(F.col("p1")))
    of_ab = W.partitionBy("class", "a", "b")
    full = full.join(two.select("class", "b", "c", "p2"), ["class", "b", "c"]).withColumn("s3", F.sum("n").over(of_ab)).withColumn("k3", seen("n").over(of_ab))
    full = full.withColumn("p3", F.when(F.col("s3") > 0, (F.col("n") + F.col("k3") * F.col("p2")) / (F.col("s3") + F.col("k3"))).otherwise(F.col("p2")))
    return full.groupBy("gram").agg(F.sum(F.when(F.col("class") == "allow", F.log("p3")).otherwise(-F.log("p3"))).alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, folds: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio of each row of pages(page_id, url).

    The longest rule that fits decides. Else the ratio does: the mean over a URL's characters of ln p(accepted) less
    ln p(rejected). The models learn from URLs that a rule decides, but for one in `folds` by md5 of the URL; those set
    the threshold, in steps of 0.01, at the best mean of both classes' hit rates (of equals the one nearest 0).

    A null URL, or one without ://, has an empty host and path, so no rule fits; its ratio is that of its characters, if
    only the end. Without URLs of one class that model knows nothing, and the threshold is 0. Repeated rows each give a
    row. Other columns are ignored. The table of all trigrams (a fixed number) is sent to each task. Long URLs count whole.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    fold = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % folds
    rows = rows.select("row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), fold.alias("fold"), trigrams(F.col("url")).alias("grams"))
    model = Table(fit(rows.where(F.col("given").isNotNull() & (F.col("fold") > 0)).select(F.col("given").alias("class"), F.explode("grams").alias("gram")))).df
    cells = rows.select("row", "page_id", "host", "path", "rule", "given", "fold", F.explode("grams").alias("gram")).join(F.broadcast(model), "gram")
    scored = cells.groupBy("row", "page_id", "host", "path", "rule", "given", "fold").agg(F.avg("ratio").alias("ratio"))
    threshold = _threshold(scored.where(F.col("given").isNotNull() & (F.col("fold") == 0)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("ratio") >= threshold, "allow").otherwise("block")).alias("verdict"), "ratio")


def _threshold(scored: DataFrame) -> float:
    """The least accepted ratio, half way between the bins that it parts; from counts in at most 2,001 bins of 0.01."""
    bins = scored.groupBy(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("ratio") * 100))).cast("int").alias("bin")).agg(
        F.count(F.when(F.col("given") == "allow", 1)).alias("good"), F.count(F.when(F.col("given") == "block", 1)).alias("bad")
    )
    upward, every = W.orderBy(F.col("bin").desc()), W.partitionBy()
    hits = F.sum("good").over(upward) / F.sum("good").over(every)
    kept = 1 - F.sum("bad").over(upward) / F.sum("bad").over(every)
    best = bins.select("bin", F.lead("bin").over(upward).alias("below"), hits.alias("hits"), kept.alias("kept"), F.sum("good").over(every).alias("goods"), F.sum("bad").over(every).alias("bads"))
    best = best.where("goods > 0 and bads > 0").withColumn("mean", F.round(F.col("hits") + F.col("kept"), 9)).orderBy(F.col("mean").desc(), F.abs("bin"), "bin").select("bin", "below").first()
    return 0.0 if not best else (best["bin"] if best["below"] is None else (best["bin"] + best["below"] + 1) / 2) / 100
