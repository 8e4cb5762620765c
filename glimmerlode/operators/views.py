"""Views over stored results: diffs, inspection, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import rules


def set_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Values of a sample on one side only: key, value, change."""
    l, r = left.select(key, value).distinct(), right.select(key, value).distinct()
    return r.join(l, [key, value], "left_anti").withColumn("change", F.lit("added")).unionByName(l.join(r, [key, value], "left_anti").withColumn("change", F.lit("removed")))


def numeric_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left, right and right minus left of each number, samples of either side."""
    l = left.select(key, *[F.col(c).alias(f"left_{c}") for c in columns])
    r = right.select(key, *[F.col(c).alias(f"right_{c}") for c in columns])
    both = l.join(r, key, "full")
    for c in columns:
        both = both.withColumn(f"left_{c}", F.coalesce(f"left_{c}", F.lit(0))).withColumn(f"right_{c}", F.coalesce(f"right_{c}", F.lit(0))).withColumn(f"delta_{c}", F.col(f"right_{c}") - F.col(f"left_{c}"))
    return both


def inspect_function(enriched: DataFrame, name: str) -> DataFrame:
    return enriched.where(F.col("name") == name)


def inspect_capability(enriched: DataFrame, capability: str, k: int = 12) -> DataFrame:
    """Functions related to a capability by match or role, best first."""
    alias = {"networking": "network", "process_injection": "injection", "dynamic_loading": "loader"}
    related = enriched.where(F.array_contains("caps", capability) | F.array_contains("roles", alias.get(capability, capability)))
    return related.withColumn("rank", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "name"))).where(F.col("rank") <= k)


def ranked_apis(apis: DataFrame) -> DataFrame:
    return apis.withColumn("rank", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("weight"), "name")))


def top_indicators(capabilities: DataFrame, apis: DataFrame, functions: DataFrame, strings: DataFrame, k: int = 12) -> DataFrame:
    """Up to five capabilities, APIs, functions and strings (60 characters of each), in block order, at most k a sample."""
    w = W.partitionBy("sample_id")
    part = lambda df, block, text, by: df.withColumn("r", F.row_number().over(w.orderBy(F.desc(by), "name"))).where("r <= 5").select(F.col("sample_id").cast("string").alias("sample_id"), F.lit(block).alias("block"), "r", text.alias("indicator"))
    said = lambda kind, by: F.concat(F.lit(f"{kind}:"), "name", F.lit(" (+"), F.col(by).cast("string"), F.lit(")"))
    rows = part(capabilities, 1, said("capability", "score"), "score").unionByName(part(apis, 2, said("api", "weight"), "weight")).unionByName(part(functions.where("score > 0"), 3, said("function", "score"), "score"))
    texts = strings.withColumn("name", F.struct("value", "address"))
    rows = rows.unionByName(part(texts, 4, F.concat(F.lit("string:"), F.substring("value", 1, 60), F.lit(" (+"), F.col("score").cast("string"), F.lit(")")), "score"))
    return rows.withColumn("rank", F.row_number().over(w.orderBy("block", "r"))).where(F.col("rank") <= k).select("sample_id", "rank", "indicator")


def ui_symbols() -> list[str]:
    """API names of ordinary desktop programs."""
    return ["CreateWindowExW", "DialogBoxParamW", "DispatchMessageW", "TranslateMessage", "GetMessageW", "DefWindowProcW", "LoadCursorW", "LoadIconW", "BeginPaint", "EndPaint", "DrawTextW", "ShowWindow", "UpdateWindow", "CreateDialogParamW", "ChooseFontW", "PageSetupDlgW", "PrintDlgExW", "GetOpenFileNameW", "GetSaveFileNameW", "MessageBoxW"]


def context_features(symbols: DataFrame, enriched: DataFrame, interesting: DataFrame) -> DataFrame:
    """Feature row for benign contexts from the import surface, the functions and the interesting strings."""
    from ..functions.columns import canonical

    s = symbols.select("sample_id", "symbol", canonical(F.col("symbol")).alias("c")).groupBy("sample_id").agg(
        F.count_distinct(F.when(F.col("c").isin(ui_symbols()), F.col("c"))).alias("ui"), F.count("*").alias("syms"), F.count_distinct(F.when(F.col("c").isin("LoadLibrary", "GetProcAddress"), F.col("c"))).alias("ldr"), F.count_distinct(F.when(F.col("c").isin("CreateFile", "ReadFile", "WriteFile"), F.col("c"))).alias("io"))
    role = lambda r: F.count_if(F.array_contains("roles", r))
    f = enriched.groupBy("sample_id").agg(F.count_if(F.col("score") >= 35).alias("hi"), F.count_if(F.col("score") >= 15).alias("med"), role("persistence").alias("per"), role("anti_analysis").alias("anti"), role("injection").alias("inj"), role("network").alias("net"))
    said = interesting.groupBy(F.col("sample_id").cast("string").alias("_s")).agg(F.count_if(F.lower("value").contains("microsoft.com")).alias("ms"), F.count_if("benign_hint").alias("bs"))
    rows = f.join(s, "sample_id", "left").join(said, F.col("sample_id").cast("string") == F.col("_s"), "left").drop("_s")
    return rows.fillna(0, ["ui", "syms", "ldr", "io", "ms", "bs"])
