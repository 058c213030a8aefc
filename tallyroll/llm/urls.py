"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's path;
of several the longest wins, of equally long ones the first in the alphabet. The trees are trained on labelled
urls: lengths, depth, digit ratio, entropy, parameter counts and statistics of the suffix, that is how often
labelled urls with the same last host label, or the same last label and first path segment, are blocked. The
statistics cover all labelled urls; the trees are fitted on at most ``train_rows`` different ones, up to half
of them of each label and those with the least hashes, weighted back to the labels' shares. Training and scoring are Spark's own; no Python runs on the executors.

Null urls and those without ``://`` have empty host and path and fit no rule. Without labelled urls of both
kinds everything that no rule fits is allowed. Repeated rows are judged each for itself, an empty table gives
an empty result. Columns that carry a result's name give way to it.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tallyroll.llm.common import empty, stored, together

Rule = tuple[str, str, str]  # verdict, host, path
SMOOTH = 10.0
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters",
    "has_fragment", "suffix_rate", "suffix_share", "branch_rate", "branch_share",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, own, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = F.transform(letters, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def with_features(df: DataFrame, url: str) -> DataFrame:
    """The rows with lexical features and the keys of the suffix statistics."""
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rest = F.concat("host", "path")
    return df.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))}).withColumns(
        {
            "url_length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count_of(F.col("path"), "/[^/]"),
            "labels": count_of(F.col("host"), "[^.]+"),
            "hyphens": count_of(F.col("host"), "-"),
            "digit_ratio": count_of(rest, "[0-9]") / F.greatest(F.length(rest), F.lit(1)),
            "entropy": entropy(F.col("host")),
            "parameters": count_of(F.regexp_extract(text, "\\?([^#]*)", 1), "[^&]+"),
            "has_fragment": F.contains(text, F.lit("#")).cast("double"),
            "_suffix": F.regexp_extract("host", "([^.]*)$", 1),
            "_branch": F.concat(F.regexp_extract("host", "([^.]*)$", 1), F.regexp_extract("path", "^(/[^/]*/?)", 1)),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(kind, key, rate, share) over all labelled rows: smoothed share of blocked ones, and how common the key is."""
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("_suffix", "_branch")]))
    counts = labelled.select(keys.alias("k"), "label").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
    prior = (total["bad"] or 0) / (total["n"] or 1)
    rate = (F.col("bad") + SMOOTH * prior) / (F.col("n") + SMOOTH)
    return counts.select("k.kind", "k.key", rate.alias("rate"), (F.col("n") / (total["n"] or 1)).alias("share"))


def with_statistics(df: DataFrame, statistics: DataFrame) -> DataFrame:
    """Look the statistics up; keys that no labelled url has get the mean rate and share 0."""
    prior = statistics.filter("kind = '_suffix'").agg((F.sum(F.col("rate") * F.col("share")) / F.sum("share")).alias("p")).first()["p"] or 0.0
    for kind, name in (("_suffix", "suffix"), ("_branch", "branch")):
        own = statistics.filter(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("rate").alias("_rate"), F.col("share").alias("_share"))
        df = df.join(own, F.col(kind) == F.col("_key"), "left")
        df = df.withColumns({f"{name}_rate": F.coalesce("_rate", F.lit(prior)), f"{name}_share": F.coalesce("_share", F.lit(0.0))})
        df = df.drop("_key", "_rate", "_share")
    return df


def training_urls(known: DataFrame, train_rows: int) -> DataFrame:
    """(_hash, label, weight) of the different labelled urls to train on, at most ``train_rows`` / 2 of each label.

    Those with the least hashes are taken, a url counts once however often it stands in the table, and the weights
    restore the labels' shares of all different urls. Empty unless both labels exist.
    """
    each = stored(known.select(F.xxhash64("_url").alias("_hash"), "label").distinct(), "labelled")
    totals = {r["label"]: r["count"] for r in each.groupBy("label").count().collect()}  # the labels are 0 and 1
    most = max(1, train_rows // 2) if len(totals) > 1 else 0
    parts = [
        each.filter(F.col("label") == label).orderBy("_hash").limit(most).withColumn("weight", F.lit(max(1.0, n / max(most, 1))))
        for label, n in sorted(totals.items())
    ]
    return stored(reduce(DataFrame.union, parts, each.limit(0).withColumn("weight", F.lit(1.0))), "training")


def fitted(known: DataFrame, statistics: DataFrame, train_rows: int, trees: int, depth: int) -> GBTClassificationModel | None:
    """Trees on at most ``train_rows`` different labelled urls; null if all labels are of one kind."""
    chosen = training_urls(known, train_rows)
    if empty(chosen):
        return None
    rows = known.withColumn("_hash", F.xxhash64("_url")).join(F.broadcast(chosen), ["_hash", "label"])  # at most ``train_rows``
    rows = with_statistics(rows.dropDuplicates(["_hash", "label"]), statistics)
    sample = stored(rows.select(*FEATURES, "weight", F.col("label").cast("double").alias("label")), "train")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, weightCol="weight").fit(vectors.select("features", "label", "weight"))


def judge(
    df: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    labelled: DataFrame | None = None,
    train_rows: int = 20_000,
    trees: int = 10,
    depth: int = 4,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default all) with host, path, rule, verdict, and the trees' ``block_score``.

    ``labelled`` has (url, label), 1 for block; without it the urls that a rule decides are the labelled ones.
    """
    results = ["host", "path", "rule", "verdict", "block_score"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]
    rows = with_features(df.select(together(df, keep), F.col(f"`{url}`").alias("_url")), "_url")
    rows = rows.withColumn("_rule", rule_for(rules, F.col("host"), F.col("path")) if rules else F.lit(None).cast("struct<rule:string,verdict:string>"))
    if labelled is None:
        known = rows.filter("_rule is not null").withColumn("label", (F.col("_rule.verdict") == "block").cast("int"))
    else:
        known = with_features(labelled.select(F.col("url").alias("_url"), "label").filter("label is not null"), "_url")
    statistics = stored(suffix_statistics(known), "suffixes")
    model = fitted(known, statistics, train_rows, trees, depth)
    if model is None:
        scored = rows.withColumn("block_score", F.lit(None).cast("double"))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(with_statistics(rows, statistics))
        model.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
        scored = model.transform(vectors).withColumn("block_score", vector_to_array("_probability")[1])
    learnt = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "_kept.*", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learnt).alias("verdict"), "block_score"
    )
