"""A quality classifier as a sparse ensemble of rules.

A small forest is grown on statistics of a bounded sample of labelled texts. Every path from a root to a node is a
conjunction of comparisons, that is a rule. Lasso logistic regression over the rules' 0/1 columns leaves few with a
weight, and those are compiled into one Spark column expression over the statistics.

The sample is bounded by ``SAMPLE`` rows, the ones whose hashed id comes first; it needs no more for some hundred
rules. Scoring covers every whole text.

Defined cases: null and empty texts have zero statistics and get a score like any other; null labels are not used; with
no labels, or with one class only, the score is the share of label 1 (0.5 without labels); repeated rows each get a row.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import spare_name, written
from helioframe.llm.quality_rules import one_label
from helioframe.llm.text_stats import derived, text_stats

SAMPLE = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002
FEATURES = (
    "symbols_per_100", "upper_share", "dup_line_share", "repeat_share", "distinct_share", "word_length",
    "digit_share", "mark_share", "stop_share", "words_per_line", "log_words",
)

Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]

_BRANCH = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")


def paths(description: str, names: tuple[str, ...]) -> list[Rule]:
    """All paths of the trees in a model's description, shorter ones first, each once."""
    rules: dict[Rule, None] = {}
    held: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        if line.strip().startswith("Tree "):
            held = []
        if m := _BRANCH.match(line):
            depth = len(m[1])
            held = [h for h in held if h[0] < depth]
            held.append((depth, (names[int(m[3])], m[4], float(m[5]))))
            rules[tuple(sorted(c for _, c in held))] = None
    return sorted(rules, key=lambda r: (len(r), r))


def holds(rule: Rule, values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        out = out & (values[name] <= bound if sign == "<=" else values[name] > bound)
    return out


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample: int) -> DataFrame:
    """Statistics and label of at most ``sample`` training documents."""
    picked = one_label(labels).where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids and labels, so they go to the texts; the texts stay where they are read.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.select("doc_id", F.col("label").cast("double").alias("label"), text_stats("text").alias("s"))
    return rows.select("doc_id", "label", *(c.alias(n) for n, c in derived("s").items() if n in FEATURES))


def fit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", sample: int = SAMPLE) -> list[tuple[Rule, float]]:
    """Rules with their weights; the empty rule, which always holds, carries the intercept."""
    # A shuffle of the few sampled rows, not coalesce(1), which would draw the scan of all texts into that one task.
    train = written(sampled(docs, labels, doc_id, text, sample).repartition(1).sortWithinPartitions("doc_id", "label", *FEATURES))
    n, good = train.agg(F.count("label"), F.sum("label")).first()
    if not n or good in (0, n):
        share = (good + 0.5) / (n + 1) if n else 0.5
        return [((), math.log(share / (1 - share)))]
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="stats").transform(train)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="stats", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=5
    ).fit(vectors)
    rules = paths(forest.toDebugString, FEATURES)
    values = {n: F.col(n) for n in FEATURES}
    columns = [f"r{i}" for i in range(len(rules))]
    flags = train.select("label", *(holds(r, values).cast("double").alias(c) for r, c in zip(rules, columns, strict=True)))
    design = VectorAssembler(inputCols=columns, outputCol="rules").transform(flags)
    lasso = LogisticRegression(
        labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60
    ).fit(design)
    weights = lasso.coefficients.toArray().tolist()
    return [((), float(lasso.intercept)), *((r, w) for r, w in zip(rules, weights, strict=True) if w)]


def score(rules: list[tuple[Rule, float]], values: dict[str, Column]) -> Column:
    """The weights of the rules that hold, as a probability."""
    total = F.lit(0.0)
    for rule, weight in rules:
        total = total + (F.when(holds(rule, values), F.lit(weight)).otherwise(F.lit(0.0)) if rule else F.lit(weight))
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, rules: list[tuple[Rule, float]], into: str, text: str = "text") -> DataFrame:
    s, names = spare_name(docs, "_stats"), {}
    rows = docs.withColumn(s, text_stats(F.col(text).cast("string")))
    for name, column in derived(s).items():
        if any(name == c[0] for rule, _ in rules for c in rule):
            names[name] = spare_name(rows, f"_{name}")
            rows = rows.withColumn(names[name], column)
    out = rows.withColumn(into, score(rules, {n: F.col(c) for n, c in names.items()}))
    return out.drop(s, *names.values())


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", cutoff: float = 0.3) -> DataFrame:
    into = spare_name(docs, "_score")
    return scored(docs, fit(docs, labels, doc_id, text), into, text).select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        F.col(into).alias("score"),
        (F.col(into) >= cutoff).cast("int").alias("predicted"),
    )
