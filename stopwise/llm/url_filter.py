"""Operator 8: allow or block urls by rules and, where none fits, by boosted trees on lexical features.

Only DataFrame functions and MLlib. The host is what stands after the first `://` up to `/`,
`?`, `#` or the end, A-Z lower-cased; the path goes on to `?`, `#` or the end. A rule fits
its host and all subdomains if the path starts with its own; the longest rule wins.

The trees are trained on labelled urls: at most TRAINING_ROWS of them, those with the
smallest hashes. A url counts once, however many rows have it. `weak_labels` makes the labels where a table has none: a url
whose host has a word of SEED_WORDS is to be blocked, any other one is not. Features are
length, depth, digit ratio, entropy of the characters, parameters, hyphens and dots of the
host, and smoothed block rates of the host's suffixes (last one, two and three labels) in
the training rows of all other hosts. A row's own host never counts in its rates, neither when
the trees are fitted nor when they judge, so no rate tells the label of its host. The model sees no host words as such.

Defined cases: null or url without `://` has an empty host and path and no rule; repeated
rows get a verdict each; without training rows of both kinds the verdict is the kind there
is, `allow` if there is none. Columns other than page_id and url are left out.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.cluster import stored

# (verdict, rule). A rule is a host and the beginning of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# Words of hosts that make a url a positive example.
SEED_WORDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "xxx"]
TRAINING_ROWS = 50_000
TRAINING_TASKS = 4
TREES, DEPTH = 15, 4
SMOOTHING = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "dots", "rate1", "rate2", "rate3"]


def parsed(urls: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.substr("url", F.instr("url", "://") + 3)).otherwise(F.lit(""))
    rows = urls.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.col("_rest"), F.length(host) + 1), r"^[^?#]*", 0)
    return rows.select("page_id", "url", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Adds the longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rows.withColumns({"rule": rule, "_ruled": verdict})


def weak_labels(rows: DataFrame) -> Column:
    """1 if the host has a seed word, else 0."""
    return F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(w) for w in SEED_WORDS])).cast("int")


def suffix(labels: int) -> Column:
    return F.substring_index("host", ".", -labels)


def lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(F.coalesce(share(c) * F.log2(F.when(share(c) > 0, share(c))), F.lit(0.0))))
    without = lambda column, pattern: F.length(column) - F.length(F.regexp_replace(column, pattern, ""))
    return rows.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": without(F.col("path"), "/").cast("double"), "digit_ratio": without(url, "[0-9]") / size, "entropy": entropy,
        "parameters": without(F.regexp_extract(url, r"\?([^#]*)", 1), "[^=]*=?[^&]*&").cast("double"),
        "hyphens": without(F.col("host"), "-").cast("double"), "dots": without(F.col("host"), "[.]").cast("double"),
    })


def training_sample(rows: DataFrame, label: Column) -> DataFrame:
    """At most TRAINING_ROWS labelled urls, the same ones for the same table."""
    labelled = rows.withColumn("label", label).filter("label IS NOT NULL").select("url", "host", "path", "label").distinct()
    return labelled.orderBy(F.xxhash64("url"), "url", "label").limit(TRAINING_ROWS)


def with_rates(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Adds the smoothed block rate of each suffix over the sample's rows of other hosts, from tables no longer than the sample."""
    overall = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("p")).first().p
    sums = [F.sum("label").alias("_blocked"), F.count("*").alias("_all")]
    own = sample.groupBy("host").agg(*sums).withColumnsRenamed({"_blocked": "_own_blocked", "_all": "_own_all"})
    rows = rows.join(F.broadcast(own), "host", "left").fillna(0, ["_own_blocked", "_own_all"])
    for n in (1, 2, 3):
        whole = sample.groupBy(suffix(n).alias("_suffix")).agg(*sums)
        rows = rows.withColumn("_suffix", suffix(n)).join(F.broadcast(whole), "_suffix", "left").fillna(0, ["_blocked", "_all"])
        rate = (F.col("_blocked") - F.col("_own_blocked") + SMOOTHING * overall) / (F.col("_all") - F.col("_own_all") + SMOOTHING)
        rows = rows.withColumn(f"rate{n}", rate).drop("_suffix", "_blocked", "_all")
    return rows.drop("_own_blocked", "_own_all")


def judged(urls: DataFrame, rules: list[tuple[str, str]] = RULES, label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of block, for every row."""
    rows = ruled(parsed(urls), rules)
    sample = stored(training_sample(rows, weak_labels(rows) if label is None else label), "labelled_urls")
    kinds = {r.label for r in sample.select("label").distinct().limit(3).collect()}
    if len(kinds) < 2:
        scored = rows.withColumn("_block", F.lit(float(max(kinds, default=0))))
    else:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=7, labelCol="label", featuresCol="features")
        # Dealt out and ordered by the data, so that the trees come out the same again.
        dealt = with_rates(lexical(sample), sample).repartition(TRAINING_TASKS, "url").sortWithinPartitions("url")
        model = trees.fit(assemble.transform(dealt))
        scored = model.transform(assemble.transform(with_rates(lexical(rows), sample))).withColumn("_block", F.col("prediction"))
    said = F.coalesce("_ruled", F.when(F.col("_block") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", said.alias("verdict"))
