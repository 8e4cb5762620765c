"""Advisory text: JSON out of noisy replies, and guardrails. The model call is a callable that the caller supplies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


def first_object(text: str) -> str | None:
    """First balanced JSON object of a text; braces inside strings don't count."""
    start = text.find("{")
    while start >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, start)
            return text[start:end]
        except ValueError:
            start = text.find("{", start + 1)
    return None


@F.pandas_udf(StringType())
def json_of(replies: pd.Series) -> pd.Series:
    return replies.map(lambda t: first_object(t) if t else None)


def parse(replies: DataFrame) -> DataFrame:
    """reply -> verdict, priority, next_step, summary, with defaults where fields are missing."""
    v = F.try_parse_json(json_of("reply"))
    get = lambda path, default: F.coalesce(F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit("")), F.lit(default))
    rows = replies.withColumn("verdict", get("$.triage_recommendation.verdict", "suspicious")).withColumn("priority", F.lower(get("$.triage_recommendation.priority", "medium")))
    return rows.withColumn("priority", F.when(F.col("priority").isin("low", "medium", "high"), F.col("priority")).otherwise("medium")).withColumn("next_step", get("$.triage_recommendation.next_step", "")).withColumn("summary", get("$.executive_summary", ""))


def guard(rows: DataFrame) -> DataFrame:
    """rows: verdict, priority, next_step, malware_level, packing_level, risk_level, warning. First branch that matches."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    strong = (F.col("malware_level") == "high") | (F.col("risk_level") == "critical") | low("verdict").contains("likely-malicious")
    packed = low("warning").contains("packed") | (F.col("packing_level") == "high")
    benign = low("verdict").contains("benign") | (((F.col("risk_level") == "low") | (F.col("malware_level") == "low")) & ~strong)
    a, b = packed & ~strong, benign & ~strong
    verdict: Column = F.when(a, "packed-needs-unpacking").when(b, "benign-leaning").otherwise(F.col("verdict"))
    step = F.when(~strong & (F.trim(F.coalesce("next_step", F.lit(""))) == ""), "review the highest-ranked functions by hand").otherwise(F.col("next_step"))
    return rows.withColumn("verdict", verdict).withColumn("priority", F.when(b & ~a, "low").otherwise(F.col("priority"))).withColumn("next_step", step)


def ask(prompts: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """Adds reply to rows with a prompt."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(reply=p["prompt"].map(call))

    return prompts.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", reply string")
