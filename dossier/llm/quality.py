"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of the whole text come from built-in column functions. A random forest of shallow trees is fitted on labelled
rows; every path from a root to a node is a conjunctive rule. A logistic regression with an L1 penalty weighs the rules and
keeps few; those are compiled into one Spark column expression, so scoring runs inside the JVM without any model object.

At most ``MAX_ROWS`` labelled rows, those with the least hashes of id and statistics, fit the model (documented bound). They
are put in the order of the hashes into one partition, as Spark draws a forest's samples by partition and place: so any layout of
the input gives the same model. All rows are scored.
Defined results: null and empty texts have all statistics 0 and get a score like any other; without labels of both classes
every score is the share of label 1, or 0.5 without any label; labels that are null, or of unknown documents, are not used;
rows that repeat score alike; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize, table, words
from dossier.llm.langid import fold

MAX_ROWS, TREES, DEPTH, PENALTY, THRESHOLD, SEED = 40_000, 24, 3, 0.002, 0.3, 5


def statistics(docs: DataFrame, keep: list, text_col: str) -> DataFrame:
    """The columns `keep` and the statistics s0 .. of each text, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("__t"), words(text).alias("__w"))
    n = F.greatest(F.length("__t"), F.lit(1)).cast("double")
    count = F.greatest(F.size("__w"), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count("__t", F.lit(pattern)) / n

    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != "")
    stats = [
        F.log1p(F.length("__t").cast("double")),
        F.log1p(F.size("__w").cast("double")),
        F.length("__t") / count,
        F.size(F.array_distinct("__w")) / count,
        share(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"),
        share(r"\|"),
        share("!"),
        share(r"\p{Lu}"),
        share("[0-9]"),
        share(r"[.?]"),
        share("\n"),
        F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
        F.length("__t") / F.greatest(F.size(lines), F.lit(1)).cast("double"),
        F.size(F.filter("__w", lambda w: F.length(w) <= 2)) / count,
    ]
    return materialize(base.select(*keep, *[s.cast("double").alias(f"s{i}") for i, s in enumerate(stats)]), "statistics")


def _paths(node, path: tuple) -> list[tuple]:
    """Conjunctions (statistic, is at most, threshold) that lead to the nodes of a tree, the root left out unless it is a leaf."""
    if node.subtreeDepth() == 0:
        return [path]
    own = [path] if path else []
    split = node.split()
    i, t = split.featureIndex(), split.threshold()
    return own + _paths(node.leftChild(), (*path, (i, True, t))) + _paths(node.rightChild(), (*path, (i, False, t)))


def condition(rule: tuple) -> Column:
    out = F.lit(True)
    for i, low, t in rule:
        out = out & (F.col(f"s{i}") <= t if low else F.col(f"s{i}") > t)
    return out


class Rules:
    """Weighted rules; score() is their column expression over the statistics."""

    def __init__(self, rules: list[tuple], weights: list[float], bias: float) -> None:
        self.rules, self.weights, self.bias = rules, weights, bias

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Fit on rows (id, label, s0 ..): forest, paths, then L1 logistic weights."""
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = (ones + 0.5) / (n + 1) if n else 0.5
        return Rules([], [], math.log(share / (1 - share)))
    stats = [c for c in rows.columns if c.startswith("s")]
    place = F.xxhash64("id", *stats)
    picked = F.pmod(place, F.lit(1_000_000)) < min(1.0, 1.1 * max_rows / n) * 1_000_000  # a tenth over: the limit decides
    sample = rows.where(picked).select(F.col("label").cast("double").alias("label"), *stats, place.alias("place"))
    sample = materialize(sample.orderBy("place", "label", *stats).limit(max_rows).drop("place"), "sample").coalesce(1)
    sample = sample.withColumn("features", array_to_vector(F.array(*stats)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED, maxBins=64).fit(sample)
    rules = sorted({p for t in forest.trees for p in _paths(t._java_obj.rootNode(), ())}, key=repr)
    lasso = weighed(sample, rules, penalty)
    weights = lasso.coefficients.toArray()
    kept = [i for i, w in enumerate(weights) if abs(w) > 1e-9]
    return Rules([rules[i] for i in kept], [float(weights[i]) for i in kept], float(lasso.intercept))


def weighed(sample: DataFrame, rules: list[tuple], penalty: float = PENALTY):
    """The L1 logistic model of label over which rules hold."""
    flags = F.array(*[condition(r).cast("double") for r in rules])
    held = sample.select("label", array_to_vector(flags).alias("features"))
    return LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=True).fit(held)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    stats = statistics(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    held = fold("doc_id", 5) == 0
    known = stats.where(~held).join(labels, F.col("doc_id") == F.col("id")).drop("doc_id")
    model = fit(materialize(known, "labelled"))
    scored = stats.select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
