"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.registry import query, table
from crossweave.session import stage

# Rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "parameters", "query_length",
            "hyphens", "suffix_share", "suffix_rows", "site_rows")
#: Groups of sites; a row's suffix share is taken from the other groups.
FOLDS = 5


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): between the first :// and the next / ? # with A-Z lower-cased; up to ? or #; the remainder."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.regexp_extract(after, r"(?s)^[^/?#]*(.*)$", 1)
    return host, F.regexp_extract(tail, r"^[^?#]*", 0), F.regexp_extract(tail, r"(?s)^[^?#]*(.*)$", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, nulls if none does; ties go to the first in order of text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0][::-1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that one url gives, from columns url, host, path and rest."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.char_length(url), F.lit(1))
    digits = lambda c: F.char_length(c) - F.char_length(F.regexp_replace(c, "[0-9]", ""))
    # entropy of the characters: from how often each character occurs, once for each that does
    letters = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(
        (lambda p: -p * F.log2(p))((F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / size)))
    labels = F.split("host", r"\.")
    return pages.withColumns({
        "length": F.char_length(url), "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "depth": F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit(""))), "labels": F.size(labels),
        "digit_ratio": digits(url) / size, "host_digits": digits(F.col("host")), "entropy": entropy,
        "parameters": F.when(F.contains("rest", F.lit("=")), F.size(F.split("rest", "[&;]"))).otherwise(0), "query_length": F.char_length("rest"),
        "hyphens": F.char_length(url) - F.char_length(F.regexp_replace(url, "[-_%]", "")),
        "suffix": F.element_at(labels, -1), "site": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))})


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """rows with suffix_share, suffix_rows and site_rows, from columns suffix, site and y (null where no label is known), over all rows.

    suffix_share is the mean label of the labelled sites of a suffix, each site counting once, smoothed by one site of either label, over the sites
    in other groups than the row's own. So a labelled row never sees its own site's label, just as a row without a label cannot,
    and a suffix without labelled sites elsewhere has 0.5. The others are logarithms of row counts.
    """
    group = F.pmod(F.xxhash64("site"), F.lit(FOLDS)).cast("int")
    sites = stage(rows.groupBy("suffix", "site").agg(F.avg("y").alias("m"), F.count("*").alias("n")).withColumn("fold", group), "sites")
    told = lambda of: (F.coalesce(F.sum(F.when(of, F.col("m"))), F.lit(0.0)) + 1.0) / (F.count(F.when(of, F.col("m"))) + 2.0)
    suffixes = stage(sites.groupBy("suffix").agg(F.log1p(F.sum("n")).alias("suffix_rows"), *[told(F.col("fold") != k).alias(f"share{k}") for k in range(FOLDS)]), "suffixes")
    shares = F.array(*[f"share{k}" for k in range(FOLDS)])
    rows = rows.join(suffixes, "suffix").withColumn("suffix_share", F.element_at(shares, group + 1))
    return rows.join(sites.select("suffix", "site", F.log1p("n").alias("site_rows")), ["suffix", "site"])


def tree_column(tree: DecisionTreeRegressionModel) -> Column:
    """A fitted tree as nested CASE expressions over the feature columns, evaluated in generated code."""
    def walk(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold())), walk(node.leftChild())).otherwise(walk(node.rightChild()))
    return walk(tree._call_java("rootNode"))


def judge(pages: DataFrame, rules=RULES, sample: int = 20_000, trees: int = 20, depth: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every page: the longest rule's verdict, else that of the boosted trees.

    Urls that a rule judges are the labelled ones. Trees are fitted on at most `sample` of them, drawn by a hash of the url (a
    documented bound on rows for the fit only); suffix statistics are aggregates over all rows, joined back with skew handling.
    Only DataFrame expressions and the library's own tree fit run; the fitted trees become CASE expressions.

    Null urls and urls without :// have an empty host and path, no rule and a score like any other. If labelled urls are of
    one verdict, or there are none, that verdict (allow) is the method's. Repeated rows are judged each; an empty table
    gives no rows; other columns are not read.
    """
    rows = featured(pages, rules, id_col, url_col)
    drawn = rows.where("y is not null").orderBy(F.xxhash64("url"), "id").limit(sample).select("y", *[F.col(f).cast("double") for f in FEATURES])
    classes = [r.y for r in drawn.select("y").distinct().collect()]
    if len(classes) < 2:
        score = F.lit(float(classes[0]) if classes else 0.0)
    else:
        score = score_column(fit(drawn, trees, depth))
    return rows.withColumn("score", score).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", F.when(
        F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def featured(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule, the rule's verdict (told), its label y and all FEATURES of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path, rest = url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path, "rest": rest})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": rule, "told": verdict})).withColumn("y", F.when(F.col("told") == "block", 1.0).when(F.col("told") == "allow", 0.0))
    return suffix_statistics(rows)


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit(rows: DataFrame, trees: int, depth: int) -> GBTClassificationModel:
    ready = vectors(rows).select("y", "features")
    return GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, seed=5, checkpointInterval=-1).fit(ready)


def score_column(model: GBTClassificationModel) -> Column:
    """The model's probability of a block as one expression over the feature columns."""
    margin = sum((tree_column(t) * F.lit(float(w)) for t, w in zip(model.trees, model.treeWeights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


@query("op5_url_verdicts")
def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
