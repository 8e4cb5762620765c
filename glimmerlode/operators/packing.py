"""Sections, entropy, unpacking patterns and entry-point candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import columns as C, rules

SAMPLED = 65_536


def byte_entropy(sections: DataFrame, key: list[str]) -> DataFrame:
    """Shannon entropy of the first SAMPLED bytes: byte counts first, so the shuffle carries at most 256 rows a section."""
    rows = sections.select(*key, F.explode(F.regexp_extract_all(F.hex(F.substring("content", 1, SAMPLED)), F.lit(".."), F.lit(0))).alias("byte"))
    rows = rows.groupBy(*key, "byte").agg(F.count("*").alias("c"))
    sums = rows.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("x"))
    return sums.select(*key, F.col("n").alias("sampled"), F.round(F.log2(F.col("n").cast("double")) - F.col("x") / F.col("n"), 4).alias("entropy"))


def section_suspicion(sections: DataFrame) -> DataFrame:
    """sections with entropy: entropy_class, suspicious, reasons."""
    bad = F.col("name").isin(rules.SUSPICIOUS_SECTIONS)
    odd = ~F.lower("name").isin(rules.COMMON_SECTIONS)
    very, high = F.col("entropy") >= 7.6, (F.col("entropy") >= 7.2) & (F.col("entropy") < 7.6)
    very, high = F.coalesce(very, F.lit(False)), F.coalesce(high, F.lit(False))
    x, w = F.col("execute"), F.col("write")
    small = odd & x & (F.col("size") < 1024)
    reasons = C.compact(F.when(bad, "name"), F.when(x & w, "write_execute"), F.when(F.col("size") == 0, "empty"), F.when(~F.col("initialized") & x, "uninitialized_execute"), F.when(very, "very_high_entropy"), F.when(high, "high_entropy"), F.when(small, "small_execute"))
    return sections.withColumn("entropy_class", C.entropy_class(F.col("entropy"))).withColumn("suspicious", bad | (x & w) | (~F.col("initialized") & x) | (very & (x | odd)) | (high & x) | small).withColumn("reasons", reasons)


def previous_mnemonics(instructions: DataFrame, n: int = 5) -> DataFrame:
    w = W.partitionBy("sample_id").orderBy("idx").rowsBetween(-n, -1)
    return instructions.withColumn("previous", F.collect_list("mnemonic").over(w))


def unpack_patterns(instructions: DataFrame, window: int = 25) -> DataFrame:
    """Per sample: which of the five entry patterns hold, and their score."""
    rows = instructions.where(F.col("idx") < window)
    m, jump = F.upper("mnemonic"), F.upper("mnemonic").isin("JMP", "CALL")
    s = rows.groupBy("sample_id").agg(F.min(F.when(m.isin("PUSHAD", "PUSHA"), F.col("idx"))).alias("push"), F.min(F.when(m.isin("POPAD", "POPA"), F.col("idx"))).alias("pop"), F.count_if(jump).alias("jumps"), F.max(F.when(jump, F.col("idx"))).alias("last"), F.count("*").alias("n"))
    names = [("pushad_near_entry", F.col("push").isNotNull(), 20), ("popad_near_entry", F.col("pop").isNotNull(), 20), ("pushad_to_popad", F.col("pop") > F.col("push"), 15), ("dense_transfers", F.col("jumps") >= 4, 10), ("tail_transfer", (F.col("n") >= 4) & (F.col("last") >= F.col("n") - 4), 10)]
    score = sum((F.when(t, p).otherwise(0) for _, t, p in names), F.lit(0))
    return s.select("sample_id", C.compact(*[F.when(t, n) for n, t, _ in names]).alias("patterns"), score.alias("score"))


def oep_candidates(transfers: DataFrame, scan: int = 180, k: int = 10) -> DataFrame:
    """Scored transfer targets: the best per address, first on ties, at most k a sample."""
    t = previous_mnemonics(transfers).where((F.col("idx") < scan) & F.col("mnemonic").isin("JMP", "CALL") & F.col("target_exec"))
    jump, same = F.col("mnemonic") == "JMP", F.col("target_section") == F.col("entry_section")
    bad_target = F.col("target_section").isin(rules.SUSPICIOUS_SECTIONS)
    code = F.lower("target_section").isin(rules.CODE_SECTIONS)
    cross = F.when(jump, 35).otherwise(18) + F.when(code, 20).when(~bad_target & (F.col("target_section") != "unknown"), 10).otherwise(-6) + F.when(F.col("entry_section").isin(rules.SUSPICIOUS_SECTIONS) & ~bad_target, 12).otherwise(0)
    seen = lambda *m: F.arrays_overlap("previous", F.array(*[F.lit(x) for x in m]))
    score = F.when(same, F.when(jump, 4).otherwise(2)).otherwise(cross) - F.when(F.col("target_write"), 8).otherwise(0) + F.when(F.col("has_function"), 6).otherwise(0) + F.when((F.col("idx") >= 24) & jump, 8).otherwise(0) + F.when(seen("POPAD", "POPA"), 18).when(seen("PUSHAD", "PUSHA"), 8).otherwise(0)
    kind = F.concat(F.when(same, "same_section_").otherwise("cross_section_"), F.when(jump, "jump").otherwise("call"))
    rows = t.withColumn("score", score).where("score > 0").withColumn("kind", kind)
    best = F.row_number().over(W.partitionBy("sample_id", "target").orderBy(F.desc("score"), "idx"))
    rows = rows.withColumn("b", best).where("b = 1")
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "target"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("sample_id", "rank", F.col("target").alias("address"), "target_section", "score", "kind", (F.col("idx") >= 24).alias("late"))


def packer_family(sections: DataFrame, symbols: DataFrame, patterns: DataFrame, entry: DataFrame) -> DataFrame:
    """sample_id, family; entry: sample_id, entry_section."""
    names = sections.groupBy("sample_id").agg(F.collect_set("name").alias("names"))
    resolves = symbols.where(F.col("symbol").isin("VirtualAlloc", "VirtualProtect", "GetProcAddress", "LoadLibraryW", "LoadLibraryA")).select("sample_id").distinct().withColumn("resolves", F.lit(True))
    rows = entry.join(names, "sample_id", "left").join(resolves, "sample_id", "left").join(patterns.select("sample_id", F.size("patterns").alias("found")), "sample_id", "left")
    has = lambda *n: F.coalesce(F.arrays_overlap("names", F.array(*[F.lit(x) for x in n])), F.lit(False))
    family = F.when(has("UPX0", "UPX1", "UPX2"), "UPX-like").when(has(".aspack"), "ASPack-like").when((F.coalesce("found", F.lit(0)) > 0) & F.col("resolves"), "generic runtime unpacking").when(F.col("entry_section").isin(rules.SUSPICIOUS_SECTIONS), "packed/loader stub section").otherwise("unknown")
    return rows.select("sample_id", family.alias("family"))


def packer_features(sections: DataFrame, entry: DataFrame, symbols: DataFrame) -> DataFrame:
    """One feature row per entry: sections with entropy, entropy_class and suspicious; entry: sample_id, entry_section.

    The entry's own section is the first of its name; without one its entropy is null and its flags are false.
    """
    high, lower = F.coalesce(F.col("entropy") >= 7.2, F.lit(False)), F.lower(F.coalesce("name", F.lit("")))
    resource, marked = lower.isin(rules.RESOURCE_SECTIONS), F.col("entropy_class") == "high"
    counts = {"suspicious": F.col("suspicious"), "odd_execute": F.col("execute") & ~lower.isin(rules.CODE_SECTIONS), "high": high, "high_execute": high & F.col("execute"), "resource_high": marked & resource, "other_high": marked & ~resource, "class_high_execute": marked & F.col("execute")}
    own = F.when(F.col("name") == F.col("entry_section"), F.struct("ord", "entropy", "write", "execute"))
    rows = entry.join(sections, "sample_id", "left").groupBy("sample_id", "entry_section").agg(F.min(own).alias("own"), *[F.count_if(t).cast("int").alias(n) for n, t in counts.items()])
    api = C.canonical(F.col("symbol"))
    seen = symbols.groupBy("sample_id").agg(F.count("*").cast("int").alias("symbols"), F.max(api.isin("GetProcAddress", "LoadLibrary")).alias("resolver"), F.max(api.isin("VirtualAlloc", "VirtualAllocEx", "VirtualProtect", "VirtualProtectEx")).alias("memory"))
    rows = rows.join(seen, "sample_id", "left").fillna(0, ["symbols"]).fillna(False, ["resolver", "memory"])
    flag = lambda c: F.coalesce(F.col(f"own.{c}"), F.lit(False)).alias(f"entry_{c}")
    return rows.select("*", F.col("own.entropy").alias("entry_entropy"), flag("write"), flag("execute")).drop("own")


def _cut(score: F.Column, high: int, medium: int) -> F.Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def _scored(rows: DataFrame, table: dict[str, int], tests: dict[str, F.Column]) -> tuple[F.Column, F.Column]:
    held = {n: F.coalesce(tests[n], F.lit(False)) for n in table}
    return sum((F.when(held[n], p).otherwise(0) for n, p in table.items()), F.lit(0)), C.compact(*[F.when(held[n], n) for n in table])


def packer_score(rows: DataFrame) -> DataFrame:
    """Adds indicators, packer (points), packed and packer_confidence to feature rows."""
    some, few, small = F.col("high") > 0, F.col("symbols") < 20, F.col("symbols") < 40
    points, names = _scored(rows, rules.PACKER_INDICATORS, {
        "suspicious_sections": F.col("suspicious") > 0, "entrypoint_in_suspicious_section": F.col("entry_section").isin(rules.SUSPICIOUS_SECTIONS), "entrypoint_in_rwx_section": F.col("entry_write") & F.col("entry_execute"),
        "very_small_import_surface": few, "small_import_surface": small & ~few, "runtime_unpacking_apis": F.col("resolver") & F.col("memory"), "nonstandard_executable_sections": F.col("odd_execute") > 0,
        "high_entropy_sections": some, "high_entropy_executable_sections": F.col("high_execute") > 0, "high_entropy_entrypoint_section": F.col("entry_entropy") >= 7.2, "high_entropy_plus_small_import_surface": some & small,
    })
    return rows.withColumn("packer", points).withColumn("indicators", names).withColumn("packed", F.col("packer") >= 45).withColumn("packer_confidence", _cut(F.col("packer"), 75, 40))


def packer_enrichment(rows: DataFrame) -> DataFrame:
    """Adds the entry code's points: pattern_score, and oep, popad and late of the best candidate (null: none)."""
    there = F.col("oep").isNotNull()
    points, names = _scored(rows, rules.PACKER_ENTRY_INDICATORS, {"strong_oep_candidate": F.col("oep") >= 35, "popad_backed_oep_transition": there & F.col("popad"), "late_stub_handoff": there & F.col("late")})
    rows = rows.withColumn("packer", F.col("packer") + F.coalesce("pattern_score", F.lit(0)) + points).withColumn("indicators", F.concat("indicators", names))
    rows = rows.withColumn("packed", F.col("packer") >= 45).withColumn("packer_confidence", _cut(F.col("packer"), 75, 40))
    return rows.withColumn("family", F.when(~F.col("packed") & (F.col("family") == "unknown"), "none").otherwise(F.col("family")))


def benign_packer(rows: DataFrame) -> DataFrame:
    """Takes points off for resource-only entropy and desktop programs, clears generic hints and cuts confidence anew."""
    resources = (F.col("resource_high") > 0) & (F.col("other_high") == 0)
    desktop = (F.col("ui") >= 10) & (F.col("entry_section") == ".text") & (F.col("class_high_execute") == 0)
    generic = F.col("family") == "generic runtime unpacking"
    score = F.greatest(F.col("packer") - F.when(resources, 10).otherwise(0) - F.when(desktop, 8).otherwise(0), F.lit(0))
    cleared = F.when((F.col("ui") >= 8) & (F.col("high_risk") == 0) & generic, "none").otherwise(F.col("family"))
    rows = rows.withColumn("family", cleared).withColumn("packer", score).withColumn("packed", F.col("packer") >= 45).withColumn("packer_confidence", _cut(F.col("packer"), 55, 30))
    weak = F.coalesce("family", F.lit("")).isin("unknown", "generic runtime unpacking", "")
    return rows.withColumn("family", F.when(~F.col("packed") & weak, "none").otherwise(F.col("family"))).withColumn("status", F.when(F.col("packed"), "packer-like indicators detected").otherwise("executable does not appear packed"))
