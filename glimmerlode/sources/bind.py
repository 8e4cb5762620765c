"""Fact tables from the provided tables: the corpus has no binaries, so facts follow from arithmetic on its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..functions import rules

NEUTRAL = ["CreateWindowExW", "DialogBoxParamW", "DispatchMessageW", "TranslateMessage", "GetMessageW", "DefWindowProcW", "LoadCursorW", "LoadIconW", "BeginPaint", "EndPaint", "DrawTextW", "ShowWindow", "UpdateWindow", "RegOpenKeyExW", "Sleep", "HeapAlloc"]
APIS = [*rules.API_WEIGHTS, *NEUTRAL]
MNEMONICS = ["PUSHAD", "MOV", "JMP", "CALL", "XOR", "POPAD", "JMP", "RET", "PUSHA"]
SECTIONS = [".text", "UPX0", ".rsrc", ".boom", "CODE", ".rdata", ".aspack", "odd"]

FAMILIES = ["", "UPX-like", "Unknown", " none ", "N/A", "ASPack-like", "null"]
HIGH_NAMES = ["", ".text", ".rsrc|.text", ".RSRC |rsrc"]

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function per order: sample_id, fn, ord, n."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("fn"))
    w = W.partitionBy("sample_id")
    return orders.withColumn("ord", F.row_number().over(w.orderBy("fn")) - 1).withColumn("n", F.count("*").over(w)).withColumn("name", F.concat(F.lit("f"), "ord"))


def api_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag of references: sample_id, fn, api."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("fn"), pick(APIS, F.col("l_partkey") % len(APIS)).alias("api"))
    return lines.join(functions(spark, sf_dir).select("sample_id", "fn", "name"), "fn")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct internal calls: sample_id, caller, callee (names), never to itself."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("fn"), "l_suppkey")
    found = lines.join(functions(spark, sf_dir), "fn")
    return found.select("sample_id", F.col("name").alias("caller"), F.concat(F.lit("f"), ((F.col("ord") + F.col("l_suppkey")) % F.col("n")).cast("string")).alias("callee")).where("caller <> callee").distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_refs(spark, sf_dir).select("sample_id", F.col("api").alias("symbol")).distinct()


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, address, value: URLs and document texts, and the literal strings of EXAMPLES."""
    urls = read(spark, sf_dir, "pages").select(F.lit("pages").alias("sample_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("address"), F.col("url").alias("value"))
    texts = read(spark, sf_dir, "documents").select(F.col("source").alias("sample_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("address"), F.col("text").alias("value"))
    extra = spark.createDataFrame([("examples", f"x{i}", v) for i, v in enumerate(EXAMPLES)], "sample_id string, address string, value string")
    return urls.unionByName(texts).unionByName(extra)


def string_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag of references from functions to strings: sample_id, name, address."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("fn"), F.concat(F.lit("x"), (F.col("l_suppkey") % len(EXAMPLES)).cast("string")).alias("address"))
    return lines.join(functions(spark, sf_dir).select("sample_id", "fn", "name"), "fn").select("sample_id", "name", "address")


def sample_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings that a sample's functions reference: sample_id, address, value."""
    refs = string_refs(spark, sf_dir).select("sample_id", "address").distinct()
    return refs.select("sample_id", "address", pick(EXAMPLES, F.substring("address", 2, 9).cast("int")).alias("value"))


EXAMPLES = ["HKEY_LOCAL_MACHINE run key", "regsvr32 and RunOnce", "c:\\temp only", "C:\\Users\\x\\AppData\\y.exe", "start cmd.exe and powershell", "vmware or wireshark", "kernel32.dll", "abc", "Microsoft print setup with cookie", "windows.security.aes microsoft.com", "plain www. site", "u\"quoted .bat\"", "prop:system.rsa"]


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per document, three to a sample: sample_id, ord, name, size, flags, content."""
    d = read(spark, sf_dir, "documents").where("doc_id is not null")
    k = F.col("doc_id")
    return d.select(F.floor(k / 3).cast("long").alias("sample_id"), (k % 3).cast("int").alias("ord"), pick(SECTIONS, k % len(SECTIONS)).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (k % 5 == 0).alias("write"), (k % 2 == 0).alias("execute"), (k % 7 != 0).alias("initialized"), F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user in time order: sample_id, idx, event_id, mnemonic."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), "event_id", "ts")
    return e.withColumn("idx", F.row_number().over(W.partitionBy("sample_id").orderBy("ts", "event_id")) - 1).withColumn("mnemonic", pick(MNEMONICS, F.col("event_id") % len(MNEMONICS))).drop("ts")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps and calls with their targets; the entry section of a sample follows from its id."""
    e = F.col("event_id")
    t = instructions(spark, sf_dir)
    return t.select("*", F.concat(F.lit("a"), (e % 13).cast("string")).alias("target"), pick(SECTIONS, e % len(SECTIONS)).alias("target_section"), (e % 4 != 0).alias("target_exec"), (e % 6 == 0).alias("target_write"), (e % 3 == 0).alias("has_function"), F.when(F.col("sample_id") % 2 == 0, ".text").otherwise("UPX1").alias("entry_section"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per customer: a sweep over the inputs of the decision tables, so that every branch is met."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("sample_id"), ((k * 37) % 160).cast("int").alias("score"), (k % 3 == 0).alias("packed"), ((k * 13) % 110).cast("int").alias("packer_score"), (k % 5).cast("int").alias("high_risk"), ((k * 7) % 50).cast("int").alias("max_top"), (k % 4).cast("int").alias("strong_strings"), (k % 6).cast("int").alias("reasoned"),
        (k % 9).cast("int").alias("apis"), (k % 4).cast("int").alias("contexts"), ((k * 11) % 60).cast("int").alias("negative"), (k % 2 == 0).alias("injection"), (k % 3 == 1).alias("networking"), (k % 7 == 0).alias("crypto"), (k % 4 == 1).alias("persistence"), (k % 5 == 2).alias("anti_analysis"), (k % 6 < 3).alias("dynamic_loading"),
        (k % 8 < 3).alias("injection_high"), ((k % 11) % 4).cast("int").alias("local_api"), (k % 10 < 3).alias("networking_high"), (k % 9 < 2).alias("crypto_high"), ((k * 17) % 90).cast("int").alias("summary_packer_score"), pick(FAMILIES, k % len(FAMILIES)).alias("family"), F.when(k % 2 == 0, "UPX").otherwise("").alias("summary_family"), (k % 5 == 1).cast("int").alias("notes"), F.split(pick(HIGH_NAMES, k % len(HIGH_NAMES)), "[|]").alias("all_names"), (k % 10).cast("int").alias("suspicious_sections"), (k % 3).cast("int").alias("high_entropy"), (k % 5 == 4).cast("int").alias("exec_entropy"), (5.5 + (k % 25) / 10.0).cast("double").alias("entry_entropy"), ((k * 3) % 50).cast("int").alias("oep"), (k % 13 != 0).alias("valid"),
    ).withColumn("high_names", F.filter("all_names", lambda n: n != "")).drop("all_names")


def packer_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of packer features per customer, so that every branch of the packer table is met."""
    k = F.col("c_custkey")
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (k % len(values)).cast("int"))
    return read(spark, sf_dir, "customer").select(
        k.alias("sample_id"), (k % 3).cast("int").alias("suspicious"), at([".text", "UPX1", "CODE"], "string").alias("entry_section"), (k % 5 < 2).alias("entry_write"), (k % 2 == 0).alias("entry_execute"), (k % 61).cast("int").alias("symbols"), (k % 3 == 1).alias("resolver"), (k % 7 < 3).alias("memory"),
        (k % 4 == 1).cast("int").alias("odd_execute"), (k % 11 % 3).cast("int").alias("high"), (k % 11 % 3 % 2).cast("int").alias("high_execute"), at([None, 6.0, 7.19, 7.2, 7.9], "double").alias("entry_entropy"), at([0, 0, 20, 55], "int").alias("pattern_score"), at([None, 10, 34, 35, 60, 20, 0], "int").alias("oep"), (k % 5 == 1).alias("popad"), (k % 3 == 2).alias("late"),
        at(["unknown", "generic runtime unpacking", "UPX-like", "packed/loader stub section"], "string").alias("family"), (k % 13).cast("int").alias("ui"), (k % 17 % 2).cast("int").alias("high_risk"), (k % 19 % 2).cast("int").alias("resource_high"), (k % 23 % 3).cast("int").alias("other_high"), (k % 29 % 2).cast("int").alias("class_high_execute"),
    )
