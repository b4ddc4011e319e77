"""Scores of parsed pages from the verdicts of their rules: means by type, categories of types, and weighted combinations of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: types of each category, and the weights of categories in each combination
CATEGORIES = {
    "normalized_text_correctness": ("missing_word_percent", "unexpected_word_percent", "too_many_word_occurence_percent", "missing_sentence_percent", "unexpected_sentence_percent", "too_many_sentence_occurence_percent", "extra_content", "bag_of_digit_percent"),
    "normalized_order": ("order",), "normalized_title_accuracy": ("is_title", "title_hierarchy_percent"), "normalized_code_block": ("is_code_block",), "normalized_latex": ("is_latex",),
}
STYLES = ("bold", "strikeout", "sup", "sub")
COMBINED = {
    "normalized_text_score": {"normalized_text_correctness": 1.0, "normalized_text_styling": 1.0, "normalized_order": 1.0, "normalized_title_accuracy": 1.0, "normalized_latex": 0.2, "normalized_code_block": 0.2},
    "content_faithfulness": {"normalized_text_correctness": 1.0, "normalized_order": 0.5},
    "semantic_formatting": {"normalized_text_styling": 1.0, "normalized_title_accuracy": 1.0, "normalized_latex": 0.2, "normalized_code_block": 0.2},
}
BETA = 0.5
ANGLES = {"0deg": 10.0, "90deg": 1.0, "180deg": 1.0, "270deg": 1.0}


def by_type(verdicts: DataFrame, key: str) -> DataFrame:
    """key, kind, n, average score; ``verdicts``: key, kind, score, where one without a score counts as 0."""
    return verdicts.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("average"))


def f_beta(there: Column, gone: Column, beta: float = BETA) -> Column:
    """A weighted harmonic mean of marks found where they belong and absent where they do not; a side without rules is whole."""
    b, p, r = beta * beta, F.coalesce(there, F.lit(1.0)), F.coalesce(gone, F.lit(1.0))
    return F.when(p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def categories(types: DataFrame, key: str) -> DataFrame:
    """key, category, value: means of the means of a category's types that a page has; styling weighs all rules on marks that must be there against all on marks
    that must not."""
    mean = lambda names: F.avg(F.when(F.col("kind").isin(*names), F.col("average")))

    def whole(names):  # the mean of all rules of some types
        ours = F.col("kind").isin(*names)
        return F.sum(F.when(ours, F.col("n") * F.col("average"))) / F.sum(F.when(ours, F.col("n")))

    there, gone = (whole([f"is_{n}{s}" for s in STYLES]) for n in ("", "not_"))
    wide = types.groupBy(key).agg(*[mean(v).alias(k) for k, v in CATEGORIES.items()], there.alias("_there"), gone.alias("_gone"))
    wide = wide.withColumn("normalized_text_styling", F.when(F.col("_there").isNotNull() | F.col("_gone").isNotNull(), f_beta(F.col("_there"), F.col("_gone"))))
    named = [*CATEGORIES, "normalized_text_styling"]
    long = wide.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in named])).alias("x")).select(key, "x.*")
    return long.where("value is not null")


def combined(found: DataFrame, key: str) -> DataFrame:
    """key, metric, value: combinations of the categories that a page has, by their weights."""
    out = []
    for name, weights in COMBINED.items():
        w = F.coalesce(*[F.when(F.col("category") == c, F.lit(x)) for c, x in weights.items()])
        out.append(F.struct(F.lit(name).alias("metric"), w.alias("w")))
    long = found.select(key, "value", F.explode(F.array(*out)).alias("x")).select(key, "value", "x.*").where("w is not null")
    return long.groupBy(key, "metric").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def scores(verdicts: DataFrame, key: str) -> DataFrame:
    """key, metric, value: rule pass means by type, categories, combinations."""
    types = by_type(verdicts, key)
    found = categories(types, key)
    rules = types.select(key, F.concat(F.lit("rule_"), "kind", F.lit("_score")).alias("metric"), F.col("average").alias("value"))
    return rules.unionByName(found.withColumnRenamed("category", "metric")).unionByName(combined(found, key))


def rotation(results: DataFrame) -> DataFrame:
    """One row: pass rate of rotated pages by angle, upright ones weighing ten times. ``results``: tag, passed."""
    rate = lambda a: F.coalesce(F.avg(F.when(F.col("tag") == a, F.col("passed").cast("double"))), F.lit(0.0))
    return results.agg((sum(rate(a) * w for a, w in ANGLES.items()) / sum(ANGLES.values())).alias("normalized_rotate"))
