"""URL filter: lists decide first, mined association rules the rest.

A URL becomes a set of typed tokens; tokens that always stand together are mined as one. Spark's FP-growth mines token combinations that go with a label; rules under a support
or a confidence are dropped, and so are rules that a shorter rule with at least their confidence makes needless. An inverted
index from token to rules finds the rules whose tokens a URL has in full; the surest of them gives the verdict.

The support is a share of the labelled rows at every size: of a few hundred rows one alone can make a rule. URLs of any length are read
whole. Null URLs and those without ``://`` have an empty host and path and no tokens, so they are allowed. Repeated URLs get
equal verdicts. Without labels, or without rules, all that no list decides is allowed. Columns of the result win over
equal names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: (verdict, host, path); a rule fits the host, its subdomains, and paths that start with its own.
LIST = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of host names that label a page "block" where no list does.
SEEDS = ("casino", "pills", "bets", "adult", "spam", "ads")
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9
#: At most about so many labelled rows are mined; which ones depends on the URL's hash alone.
MOST_LABELLED = 500_000
#: So many postings are broadcast at most; more are joined by shuffling.
MOST_BROADCAST = 100_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def by_list(host: Column, path: Column, rules=LIST) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: words of the host's labels, and words of the path other than numbers."""
    words = F.filter(F.split(host, "[._-]"), lambda x: x != "")
    pieces = F.filter(F.split(path, "[/._-]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(F.transform(words, lambda x: F.concat(F.lit("w:"), x)), F.transform(pieces, lambda x: F.concat(F.lit("p:"), x))))


def _alike(rows: DataFrame, least: float) -> DataFrame:
    """(item, tokens): the tokens of (row, tokens) that ``least`` rows or more have; those that stand in the same rows are one
    item, so that a long constant part of many URLs gives one item instead of the combinations of its tokens."""
    marks = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(20,0)")).alias(f"mark{k}") for k in (0, 1)]
    places = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least)
    alike = places.groupBy("n", "mark0", "mark1").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return alike.select(F.element_at("tokens", 1).alias("item"), "tokens")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most: int = MOST_LABELLED) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) from (url, tokens, label)."""
    n = labelled.count()
    spark = labelled.sparkSession
    schema = "rule_id long, tokens array<string>, verdict string, confidence double, support double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, most / n)
    rows = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else labelled
    rows = materialize(rows.select("tokens", "label", F.monotonically_increasing_id().alias("row")))
    alike = materialize(_alike(rows, min_support * rows.count()))
    members = alike.select("item", F.explode("tokens").alias("token"))
    named = rows.select("row", F.explode("tokens").alias("token")).join(members, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    labels = F.array(F.concat(F.lit("="), "label"))
    items = rows.join(named, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), labels).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    label = F.element_at("consequent", 1)
    found = model.associationRules.where(label.startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    found = found.select(F.explode("antecedent").alias("item"), F.xxhash64(F.array_sort("antecedent"), label).alias("rule_id"), F.substring(label, 2, 100).alias("verdict"), "confidence", "support")
    whole = found.join(alike, "item").groupBy("rule_id", "verdict", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    found = materialize(whole)
    # a shorter rule with the same verdict and no less confidence makes a rule needless
    inner = found.select("rule_id", F.explode("tokens").alias("token"), F.col("verdict").alias("of"), F.col("confidence").alias("sure"), F.size("tokens").alias("size"))
    post = found.select(F.col("rule_id").alias("short_id"), F.explode("tokens").alias("token"), "verdict", "confidence", F.size("tokens").alias("need"))
    needless = (
        inner.join(post, "token").where("need < size AND verdict = of AND confidence >= sure")
        .groupBy("rule_id", "short_id", "need").count().where("count = need").select("rule_id").distinct()
    )
    return found.join(needless, "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) for each distinct url of (url, tokens) that has all tokens of some rule: the verdict of the surest."""
    postings = materialize(rules.select("rule_id", F.explode("tokens").alias("token"), "verdict", "confidence", F.size("tokens").alias("need")))
    few = postings.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    exploded = urls.distinct().select("url", F.explode("tokens").alias("token"))
    hits = exploded.join(F.broadcast(postings) if few else postings, "token")
    full = hits.groupBy("url", "rule_id", "need", "verdict", "confidence").count().where("count = need")
    best = F.max_by("verdict", F.struct("confidence", "need", "verdict")).alias("mined")
    return full.groupBy("url").agg(best)


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=LIST) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; labels: (url, label), else the lists' own verdicts and SEEDS."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, listed = by_list(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "listed": listed})
    marked = rows.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    if labels is None:
        seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"w:{s}") for s in SEEDS]))
        taught = marked.withColumn("label", F.when(seeded, "block").otherwise(F.coalesce("listed", F.lit("allow")))).where(F.size("tokens") > 0)
    else:
        taught = marked.join(labels.select("url", "label"), "url")
    found = mine(taught.select("url", "tokens", "label"))
    mined = materialize(match(marked.where("listed IS NULL").select("url", "tokens"), found))
    verdict = F.coalesce("listed", "mined", F.lit("allow")).alias("verdict")
    return rows.join(mined, "url", "left").select("page_id", "host", "path", "rule", verdict)
