"""Interesting strings: keyword rules as compiled expressions, no join."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import columns as C, rules


def score_strings(strings: DataFrame) -> DataFrame:
    """sample_id, address, value, score, tags, benign_hint of every string whose score is above zero.

    A lone file-system keyword and a network keyword without a strong mark count less; vendor marks take points off.
    """
    v, low = F.col("v"), F.col("low")
    rows = C.held(strings.select("sample_id", "address", "value"), {"v": C.clean_string(F.coalesce("value", F.lit("")))}).where((F.length("v") >= 5) & ~C.boring_library(v))
    rows = C.held(rows.drop("value"), {"low": F.lower(v)})
    benign = [C.any_keyword(low, rules.VENDOR_KEYWORDS), low.startswith("prop:system."), low.contains("windows.security."), low.contains("microsoft.")]
    counts = {f"k_{n}": C.hits(low, keywords) for n, (keywords, _, _) in rules.STRING_PATTERNS.items()}
    rows = C.held(rows, counts | {"vendor": reduce(add, [b.cast("int") for b in benign]), "strong": C.any_keyword(low, rules.STRONG_NETWORK_MARKS)})

    def points(name: str, score: int) -> F.Column:
        found = F.col(f"k_{name}")
        if name == "filesystem_path":
            return F.when(found == 1, max(4, score - 6)).when(found > 1, score).otherwise(0)
        if name == "url_or_network":
            return F.when((found > 0) & ~F.col("strong"), max(5, score - 8)).when(found > 0, score).otherwise(0)
        return F.when(found > 0, score).otherwise(0)

    total = reduce(add, [points(n, s) for n, (_, s, _) in rules.STRING_PATTERNS.items()])
    tags = C.compact(*[F.when(F.col(f"k_{n}") > 0, t) for n, (_, _, t) in rules.STRING_PATTERNS.items()])
    rows = rows.withColumn("score", total - F.least(8 * F.col("vendor"), F.lit(18))).where("score > 0")
    return rows.select("sample_id", "address", F.col("v").alias("value"), "score", F.array_sort(F.array_distinct(tags)).alias("tags"), (F.col("vendor") > 0).alias("benign_hint"))


def top_strings(scored: DataFrame, k: int = 40) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "value", "address"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
