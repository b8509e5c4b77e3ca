"""URL filters, with DataFrame operations only: longest-match rules, and for the rest a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict): host, then the start of the path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
NGRAM = 3
FEATURES = 4096
#: Most labelled urls that training uses: those with the smallest md5.
TRAIN_ROWS = 2_000
#: Labelled urls by what their hosts and paths say, for both labels with common starts, endings and paths.
BLOCKED = """casino-win casino-royal mega-casino online-casino lucky-casino free-bets best-bets bets-now sport-bets bet-win win-cash cash-win spam-farm
link-farm seo-spam content-farm farm-links cheap-pills pills-shop buy-pills diet-pills pills-online adult-x adult-cams x-adult xxx-video hot-adult ads-track
track-ads ads-server click-ads adtrack popup-ads poker-win free-poker slots-win malware-load keygen-crack warez-free crack-free phish-login""".split()
ALLOWED = """news daily weather library museum school college history science garden kitchen recipes travel maps music theatre cinema sports
health medicine doctor lawyer council city village river mountain forest farming market books poems letters journal review
physics maths chemistry biology language grammar dictionary teacher parents children family people country nation theory
motion station nature culture others author father mother weather-report thunder theory-of thread""".split()


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://(.*)", 1)
    found = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(found, F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits: the host is the rule's or a subdomain of it, the path starts with the rule's. Null
    if none fits. Of equally long rules the first in the list counts."""
    def fits(r: str) -> Column:
        own, slash, start = r.partition("/")
        return ((h == own) | h.endswith(f".{own}")) & p.startswith(slash + start)

    longest = sorted(rules, key=lambda r: -len(r[0]))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r, _ in longest])


def grams(h: Column, p: Column, n: int = NGRAM) -> Column:
    """Character n-grams of `^host$` and of `^path$`, marked by the part that they come from. Shorter parts give one
    gram. Texts of any length: the array grows with the text."""
    def of(mark: str, s: Column) -> Column:
        full = F.concat(F.lit("^"), s, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(full) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(full, i, F.lit(n))))

    return F.concat(of("h", h), of("p", p))


def featurize(df: DataFrame, host_col: str = "host", path_col: str = "path") -> DataFrame:
    with_grams = df.withColumn("_grams", grams(F.col(host_col), F.col(path_col)))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES).transform(with_grams).drop("_grams")


@dataclass
class UrlModel:
    """A fitted regression, or None where the labelled table has not both verdicts; all urls are then allowed."""

    model: LogisticRegressionModel | None

    def p_block(self, df: DataFrame, into: str = "p_block") -> DataFrame:
        if self.model is None:
            return df.withColumn(into, F.lit(0.0))
        made = ["rawPrediction", "probability", "prediction", "_features"]
        return self.model.transform(featurize(df)).withColumn(into, vector_to_array("probability").getItem(1)).drop(*made)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> UrlModel:
    """labelled: host, path, label (1: block, 0: allow). At most `rows` distinct urls, by md5, are used."""
    sample = labelled.filter("label is not null").groupBy("host", "path").agg(F.max("label").cast("double").alias("label"))
    sample = sample.orderBy(F.md5(F.concat("host", "path")), "host", "path").limit(rows)
    sample = featurize(sample).select("_features", "label").coalesce(1).persist()
    try:
        seen = sample.agg(F.min("label"), F.max("label")).first()
        if seen[0] is None or seen[0] == seen[1]:
            return UrlModel(None)
        return UrlModel(LogisticRegression(featuresCol="_features", labelCol="label", maxIter=30, regParam=0.01, elasticNetParam=0.0).fit(sample))
    finally:
        sample.unpersist()


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule. A null url, or one without `://`, has empty host and path; a rule then can't fit."""
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return split.withColumn("rule", rule(F.col("host"), F.col("path")))


def by_rule(col: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    return reduce(lambda c, r: c.when(col == r[0], F.lit(r[1])), rules[1:], F.when(col == rules[0][0], F.lit(rules[0][1])))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """host, path, label: the small labelled table that the query trains on. Urls without a host are labelled block, as
    nothing can be fetched from them."""
    text = lambda *xs: F.array(*map(F.lit, xs))
    one, at = spark.range(1), lambda xs, i: F.get(xs, i.cast("int"))
    named = [one.select(F.posexplode(text(*names)).alias("i", "name"), F.lit(label).alias("label")) for label, names in ((1, BLOCKED), (0, ALLOWED))]
    each = named[0].unionByName(named[1]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    turn, number = F.col("i") + F.col("k"), (100 + 37 * F.col("i") + 11 * F.col("k")).cast("string")
    host = F.concat(at(text("", "www.", "m.", "blog."), turn % 4), "name", F.lit(".example."), at(text("com", "org", "net"), turn % 3))
    path = F.when(F.col("k") == 0, "/").otherwise(F.concat(at(text("", "/en/", "/de/", "/fr/", "/es/", "/en/"), F.col("k")), number, at(text("", ".html", "", "", ".html", ""), F.col("k"))))
    empty = one.select(F.lit("").alias("host"), F.explode(text("", "/", "/en/1")).alias("path"), F.lit(1).alias("label"))
    return each.select(host.alias("host"), path.alias("path"), "label").unionByName(empty)


def judge(pages: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block. The rule decides; else the regression does, trained on `labelled`
    (host, path, label). One row for each row of pages, repeated rows included."""
    scored = train(labelled).p_block(parts(pages))
    free = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule(F.col("rule")), free).alias("verdict"), "p_block")
