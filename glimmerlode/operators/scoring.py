"""Decision tables over one feature row per sample: projections only, no shuffle after the features."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import columns as C, rules


def points(*pairs: tuple[Column, int]) -> Column:
    """Sum of the numbers whose tests hold."""
    return reduce(add, [F.when(test, n).otherwise(0) for test, n in pairs])


def benign_contexts(rows: DataFrame) -> DataFrame:
    """rows: ui, syms, ldr, io, ms, bs, hi, med, per, anti, inj, net. Adds contexts and adjustment."""
    c = {x: F.col(x) for x in "ui syms ldr io ms bs hi med per anti inj net".split()}
    tests = [
        (c["ui"] >= 8) & (c["syms"] > 120), (c["ldr"] >= 2) & (c["ms"] > 0), (c["io"] >= 2) & (c["ui"] >= 5), (c["per"] > 0) & (c["per"] <= 3) & (c["inj"] == 0) & (c["net"] == 0), (c["anti"] > 0) & (c["anti"] <= 3) & (c["hi"] == 0),
        c["hi"] == 0, (c["med"] <= 2) & (c["bs"] >= 2), (c["ui"] >= 10) & (c["syms"] >= 150), (c["inj"] == 0) & (c["net"] == 0) & (c["hi"] == 0) & ((c["per"] > 0) | (c["anti"] > 0)),
    ]
    named = list(zip(rules.BENIGN_CONTEXTS.items(), tests, strict=True))
    return rows.withColumn("contexts", C.compact(*[F.when(t, n) for (n, _), t in named])).withColumn("adjustment", points(*[(t, d) for (_, d), t in named]))


def adjusted(raw: Column, adjustment: Column) -> Column:
    return F.greatest(raw + adjustment, F.lit(0))


def high_impact(prefix: str = "") -> Column:
    return F.col("injection") | F.col("networking") | F.col("crypto")


def soft() -> Column:
    return F.col("persistence") | F.col("anti_analysis") | F.col("dynamic_loading")


def conditions() -> dict[str, Column]:
    """The eight named score conditions."""
    caps = sum((F.col(c).cast("int") for c in ("injection", "networking", "crypto", "persistence", "anti_analysis", "dynamic_loading")), F.lit(0))
    return {
        "multiple_high_risk_top_functions": F.col("high_risk") >= 2,
        "packed_sample_static_visibility_penalty": F.col("packed"),
        "process_injection_capability": F.col("injection"),
        "high_signal_interesting_strings": F.col("strong_strings") >= 1,
        "top_function_reasoned_evidence": F.col("reasoned") >= 1,
        "strong_packing_with_weak_visible_behavior": F.col("packed") & (F.col("apis") <= 4) & (caps <= 1) & (F.col("max_top") < 35),
        "benign_context_heavy_discount": (F.col("contexts") >= 2) & (F.col("negative") >= 20),
        "soft_capability_only_discount": soft() & ~high_impact(),
    }


def compile_rule(rule: dict) -> Column | None:
    """Boolean Column of a score or derived rule: its optional predicates, all of them. None if it has no predicate."""
    known = conditions()
    tests: list[Column] = []
    if rule.get("condition"):
        tests.append(known.get(rule["condition"], F.lit(False)))
    flags = {"require_likely_packed": F.col("packed"), "require_high_entropy_executable": F.col("exec_entropy") >= 1}
    least = {"min_high_risk_functions": "high_risk", "min_top_function_score": "max_top", "min_benign_contexts": "contexts", "min_suspicious_sections": "suspicious_sections"}
    most = {"max_suspicious_api_count": "apis", "max_top_function_score": "max_top"}
    tests += [test == F.lit(rule[k]) for k, test in flags.items() if rule.get(k) is not None]
    tests += [F.col(c) >= rule[k] for k, c in least.items() if rule.get(k) is not None]
    tests += [F.col(c) <= rule[k] for k, c in most.items() if rule.get(k) is not None]
    tests += [F.col(_flag(c)) for c in rule.get("requires_all", [])]
    if rule.get("requires_any"):
        tests.append(reduce(or_, [F.col(_flag(c)) for c in rule["requires_any"]]))
    tests += [~F.col(_flag(c)) for c in rule.get("forbids", [])]
    tests += [F.col(_flag(c)) & F.col(f"{_flag(c)}_high") for c in rule.get("requires_high_confidence", [])]
    return reduce(and_, tests) if tests else None


def _flag(capability: str) -> str:
    return "injection" if capability == "process_injection" else capability


def calibrate(rows: DataFrame, score_rules: list[dict] | None = None) -> DataFrame:
    """Adds calibrated, fired (ids in rule order) and band. score_rules: as read by rule_files, else the built-in ones."""
    if score_rules is None:
        score_rules = [{"id": n, "condition": n, "delta": d} for n, d in rules.SCORE_RULES.items()]
    tests = [(r, compile_rule(r)) for r in score_rules]
    tests = [(r, t) for r, t in tests if t is not None]
    fired = C.compact(*[F.when(t, r["id"]) for r, t in tests]) if tests else F.array().cast("array<string>")
    delta = points(*[(t, r["delta"]) for r, t in tests]) if tests else F.lit(0)
    rows = rows.withColumn("fired", fired).withColumn("calibrated", F.greatest(F.col("score") + delta, F.lit(0)))
    return rows.withColumn("band", C.report_band(F.col("calibrated")))


def malware_risk(rows: DataFrame) -> DataFrame:
    """Adds malware and malware_level to calibrated rows. local_api: how many top functions show local API evidence."""
    inj, net, cry, per, anti, load = (F.col(c) for c in ("injection", "networking", "crypto", "persistence", "anti_analysis", "dynamic_loading"))
    local, evidence = F.col("local_api") >= 2, F.col("local_api") > 0
    score = F.col("calibrated") + points((inj, 18), (net & per, 8), (net & ~per & cry, 8), (net & ~per & ~cry, 4), (load & inj, 8), (anti & (inj | load | net | cry), 6), (F.col("high_risk") >= 3, 10), (local, 6))
    score = score + points((~high_impact() & soft(), -15), (F.col("contexts") >= 2, -12), (F.col("negative") >= 20, -10), (~inj & ~net & ~cry & (F.col("high_risk") == 0), -8), (F.col("packed") & ~inj & ~evidence, -10), (F.col("packed") & (inj | evidence), -5))
    return rows.withColumn("malware", F.greatest(score, F.lit(0))).withColumn("malware_level", C.report_band(F.col("malware")))


def packing_risk(rows: DataFrame) -> DataFrame:
    """Adds packing and packing_level. high_names: names of the sections of high entropy, executable or not."""
    packed, ex, he, oep = F.col("packed"), F.col("exec_entropy"), F.col("high_entropy"), F.col("oep")
    caps = high_impact() | soft()
    hint = F.lower(F.coalesce(F.nullif(F.trim("family"), F.lit("")), F.trim("summary_family"), F.lit("")))
    resources = (F.size("high_names") > 0) & (ex == 0) & F.forall("high_names", lambda n: F.lower(F.trim(n)).isin(".rsrc", "rsrc"))
    score = F.greatest("packer_score", "summary_packer_score") + points((~hint.isin(rules.NO_FAMILY), 10), (F.col("notes") > 0, 4), (resources, -10)) + points((packed, 20), (F.col("entry_entropy") >= 7.6, 10), ((F.col("entry_entropy") >= 7.2) & (F.col("entry_entropy") < 7.6), 6), (oep >= 35, 12), ((oep >= 20) & (oep < 35), 6), (packed & (F.col("apis") <= 3), 10), (packed & ~caps, 10), ((ex == 0) & ~packed, -6))
    score = score + F.least(4 * F.col("suspicious_sections"), F.lit(12)) + F.least(4 * F.greatest(he, F.lit(0)), F.lit(12)) + F.least(6 * ex, F.lit(18))
    return rows.withColumn("packing", F.greatest(score, F.lit(0))).withColumn("packing_level", C.report_band(F.col("packing")))


def derived_capabilities(rows: DataFrame, derived_rules: list[dict] | None = None) -> DataFrame:
    """Adds the array derived: names of the rules that hold, in rule order. A rule without predicates never does."""
    tests = [(r["name"], compile_rule(r)) for r in (rules.DERIVED_RULES if derived_rules is None else derived_rules)]
    found = [F.when(t, n) for n, t in tests if t is not None]
    return rows.withColumn("derived", C.compact(*found) if found else F.array().cast("array<string>"))


def decide(rows: DataFrame) -> DataFrame:
    """Adds signal, confidence, review, priority, assessment, dominant and interpretation to rows with both risks and derived."""
    m, p, ml, pl = F.col("malware"), F.col("packing"), F.col("malware_level"), F.col("packing_level")
    calm = (F.col("contexts") >= 2) & ~high_impact() & (m < 65)
    hc = (F.col("injection") & F.col("injection_high")) | (F.col("networking") & F.col("networking_high")) | (F.col("crypto") & F.col("crypto_high"))
    signal = F.when(calm, "low").when((m >= 120) | hc | (F.col("injection") & (F.col("high_risk") >= 1)), "high").when(m >= 60, "medium").otherwise("low")
    confidence = F.when(~F.col("valid"), "low").when(F.col("packed") & (F.col("reasoned") == 0), "low").when(F.col("packed"), "medium").when(hc | (F.col("reasoned") >= 2) | (F.col("high_risk") >= 2), "high").otherwise("medium")
    critical = (F.col("band") == "critical") & high_impact()
    review = F.col("packed") | critical | ml.isin("high", "critical") | (F.size("derived") > 0) | ~F.col("valid") | (F.col("oep") >= 35)
    priority = F.when((F.col("packed") & (ml == "high")) | (ml == "critical") | critical | ((pl == "high") & (F.col("oep") >= 35)), "high").when(review, "medium").otherwise("low")
    assessment = F.when(calm, "benign_leaning").when((p >= m + 25) & (m < 85), "packing_first").when(F.array_contains("derived", "in_memory_loader"), "in_memory_loader").when(ml.isin("high", "critical"), "malware_leaning").when(pl == "high", "packed").otherwise("inconclusive")
    dominant = F.when(calm & (p < 65), "balanced").when((m < 35) & (p < 35), "low_signal").when(p > m + 10, "packing").when(m > p + 10, "malware").otherwise("balanced")
    return rows.select("*", signal.alias("signal"), confidence.alias("confidence"), review.alias("review"), priority.alias("priority"), assessment.alias("assessment"), dominant.alias("dominant")).withColumn("interpretation", reduce(lambda c, kv: c.when(F.col("dominant") == kv[0], kv[1]), rules.INTERPRETATIONS.items(), F.when(F.lit(False), "")).otherwise(rules.INTERPRETATION_ELSE))


def capability_ranks(rows: DataFrame) -> DataFrame:
    """rows: name, confidence, match_count, min_matches, sup, med, top, contexts, negative, packed. Adds calibrated confidence."""
    n, least, sup, med, top = (F.col(c) for c in ("match_count", "min_matches", "sup", "med", "top"))
    impact = F.col("name").isin(rules.HIGH_IMPACT)
    start = C.confidence_rank(F.col("confidence"))
    high = F.greatest(start, F.when(n >= least + 2, 3).when(n >= least + 1, 2).otherwise(1), F.when(sup >= 2, 3).when(sup == 1, 2).otherwise(1), F.when(top >= 1, 2).otherwise(1), F.when((F.col("name") == "process_injection") & ((top >= 1) | (med >= 1)), 3).otherwise(1))
    other = F.when(sup >= 2, F.greatest(start, F.lit(2))).when(sup == 1, F.lit(1)).otherwise(start)
    other = F.greatest(other, F.when((n >= least + 2) & (sup >= 2) & (top >= 1), 3).when((n >= least + 1) & (sup >= 2), 2).otherwise(1))
    other = F.when((F.col("contexts") >= 2) & (top == 0), 1).when((F.col("negative") >= 20) & (med == 0), 1).otherwise(other)
    other = F.when(F.col("packed") & (sup == 0) & (top == 0), F.greatest(other - 1, F.lit(1))).otherwise(other)
    return rows.withColumn("calibrated", C.rank_confidence(F.when(impact, high).otherwise(other)))


def invalid_fields(name: Column, risk: Column, version: Column) -> Column:
    """Names of the three required fields that are null or blank."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return C.compact(F.when(blank(name), "sample.name"), F.when(blank(risk), "summary.risk_level"), F.when(blank(version), "summary.contract_version"))


def raw_score(apis: DataFrame, capabilities: DataFrame, strings: DataFrame, functions: DataFrame, packers: DataFrame) -> DataFrame:
    """sample_id and raw: capped sums of the best APIs, capabilities, strings and functions, and a bonus for packed samples with strong signals.

    apis: sample_id, name, weight; capabilities: name, score, confidence; strings: score, benign_hint, value, address;
    functions: name, score; packers: sample_id, packed, one row a sample. Each part is one partial aggregate per sample.
    """
    w = W.partitionBy("sample_id")
    best = lambda df, by, n, *ties: df.withColumn("r", F.row_number().over(w.orderBy(F.desc(by), *ties))).where(F.col("r") <= n)
    capped = lambda by, most: F.least(F.col(by), F.lit(most))
    impact = F.col("name").isin(rules.HIGH_IMPACT) & F.col("confidence").isin("medium", "high")
    parts = [
        best(apis, "weight", 12, "name").groupBy("sample_id").agg(F.sum(capped("weight", 12)).alias("points"), F.lit(0).alias("signals")),
        capabilities.groupBy("sample_id").agg(F.sum(F.when(F.col("name").isin(rules.SOFT), capped("score", 12)).otherwise(capped("score", 30))).alias("points"), F.count_if(impact).alias("signals")),
        best(strings, "score", 25, "value", "address").where("not benign_hint").groupBy("sample_id").agg(F.sum(capped("score", 12)).alias("points"), F.lit(0).alias("signals")),
        best(functions, "score", 6, "name").groupBy("sample_id").agg(F.sum(capped("score", 14)).alias("points"), F.count_if(F.col("score") >= 15).alias("signals")),
    ]
    total = reduce(lambda a, b: a.unionByName(b), parts).groupBy("sample_id").agg(F.sum("points").alias("points"), F.sum("signals").alias("signals"))
    out = packers.select("sample_id", "packed").join(total, "sample_id", "left").fillna(0, ["points", "signals"])
    return out.select("sample_id", (F.col("points") + F.when(F.col("packed") & (F.col("signals") >= 2), 6).otherwise(0)).cast("long").alias("raw"))


def summary(raw: DataFrame, contexts: DataFrame) -> DataFrame:
    """sample_id, raw, score after the benign contexts' adjustment (0 at least) and its risk level."""
    rows = raw.join(contexts.select("sample_id", "adjustment"), "sample_id", "left").fillna(0, ["adjustment"])
    return rows.withColumn("score", adjusted(F.col("raw"), F.col("adjustment"))).select("sample_id", "raw", "score", C.report_band(F.col("score")).alias("risk_level"))
