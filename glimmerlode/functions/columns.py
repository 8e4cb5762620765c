"""Scalar operators as Column expressions: JVM-side, foldable and inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from . import rules



def canonical(api: Column) -> Column:
    """Canonical API name."""
    base = F.substring(api, F.lit(1), F.length(api) - 1)
    return F.when(F.substring(api, -1, 1).isin("A", "W") & base.isin(rules.TWO_FORMS), base).otherwise(api)


def weight(api: Column) -> Column:
    """Weight of a raw name, else of its canonical name, else null."""
    table = F.create_map(*[F.lit(x) for kv in rules.API_WEIGHTS.items() for x in kv])
    return F.coalesce(table[api], table[canonical(api)])


def clean_string(value: Column) -> Column:
    """Trim, drop one pair of quotes (with or without u), trim again."""
    v = F.trim(value)
    wide = (F.length(v) >= 3) & v.startswith('u"') & v.endswith('"')
    plain = (F.length(v) >= 2) & v.startswith('"') & v.endswith('"')
    cut = F.when(wide, F.substring(v, F.lit(3), F.length(v) - 3)).when(plain, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.trim(cut)


def boring_library(value: Column) -> Column:
    return F.lower(value).endswith(".dll") & ~value.contains("/") & ~value.contains("\\")


def hits(value: Column, keywords: list[str]) -> Column:
    """Number of keywords inside a lower-case value."""
    return reduce(add, [value.contains(k).cast("int") for k in keywords])


def any_keyword(value: Column, keywords: list[str]) -> Column:
    """Whether a lower-case value has any of the keywords."""
    return reduce(or_, [value.contains(k) for k in keywords])


def entropy_class(entropy: Column) -> Column:
    return F.when(entropy.isNull(), "unknown").when(entropy >= 7.6, "very_high").when(entropy >= 7.2, "high").when(entropy >= 6.8, "elevated").otherwise("normal")


def function_risk(score: Column) -> Column:
    return F.when(score >= 60, "critical").when(score >= 35, "high").when(score >= 15, "medium").otherwise("low")


def report_band(score: Column) -> Column:
    return F.when(score >= 120, "critical").when(score >= 85, "high").when(score >= 30, "medium").otherwise("low")


def confidence_rank(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "medium", 2).otherwise(1)


def rank_confidence(rank: Column) -> Column:
    return F.when(rank >= 3, "high").when(rank == 2, "medium").otherwise("low")


def capability_confidence(name: Column, count: Column, least: Column) -> Column:
    soft = F.when(count >= least + 2, "medium").otherwise("low")
    return F.when(name.isin(rules.SOFT), soft).when(count >= least + 2, "high").when(count >= least + 1, "medium").otherwise("low")


def compact(*parts: Column) -> Column:
    """Array of the parts that are not null."""
    return F.array_compact(F.array(*parts))


def held(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns computed once: behind a generator later expressions read them instead of repeating them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select("*", F.explode(F.array(made)).alias("_held")).select(*[c for c in rows.columns if c not in columns], *[F.col(f"_held.{n}").alias(n) for n in columns])


# What counts as white space, and as no value.
SPACE = " \t\n\r\x0b\x0c"
NO_VALUE = ("none", "unknown", "n/a", "na", "null")


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(SPACE))


def joined(items: Column, separator: str = ", ") -> Column:
    """The items that are neither null nor blank, joined; empty for none."""
    return F.coalesce(F.array_join(F.filter(items, lambda x: F.coalesce(trimmed(x), F.lit("")) != ""), separator), F.lit(""))


def joined_or_none(items: Column) -> Column:
    """All items joined, `none` for an empty or null list."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "none").otherwise(F.array_join(F.coalesce(items, F.array().cast("array<string>")), ", "))


def meaningful(value: Column) -> Column:
    """The trimmed value, empty where it only says that there is none."""
    v = F.coalesce(trimmed(value), F.lit(""))
    return F.when(F.lower(v).isin(*NO_VALUE), "").otherwise(v)


def shortened(value: Column, most: int) -> Column:
    """At most `most` characters, the last three of a cut text being dots; a bound of 0 or less cuts nothing."""
    if most <= 0:
        return value
    cut = F.substring(value, 1, most) if most <= 3 else F.concat(F.substring(value, 1, most - 3), F.lit("..."))
    return F.when(F.length(value) <= most, value).otherwise(cut)


def tidy_list(items: Column) -> Column:
    """Trimmed items without blanks and repeats, in order; an empty list for null."""
    clean = F.filter(F.transform(items, trimmed), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.array_distinct(clean), F.array().cast("array<string>"))
