"""Benchmark decontamination by template windows. DataFrame functions only.

Texts become templates: runs of white space turn into one space, numbers, names and units into typed placeholders,
other words into lower case. A window of WINDOW tokens of the benchmark is held if its template or its plain lower-case
words are in the document, so a copy in other case or line breaks is met too. Windows meet in a hash join; the benchmark side is broadcast
only while its counted rows stay under BROADCAST_ROWS. A document is a candidate for an item if the distinct windows
of the item that it holds are at least SIMILARITY of the item's windows. Candidates whose item has slots are read
again with the fillers of their slots: matches are grouped by diagonal (document position minus item position), whose
fillers map one to one by majority. A window against that mapping counts only if its fillers are the item's own, so
re-parameterised copies stay, chance meetings go, and a clash costs the windows that hold it and no others.

An item with fewer words than a window matches where its whole template equals a document's. Defined cases: null
texts and items without words match nothing; rows that repeat a doc_id count as one document; a null doc_id is a
document of its own; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .common import discard, fresh, materialize

WINDOW = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 200_000
#: Fixed unit words.
UNITS = "mm cm m km mg g kg lb oz ml l s ms min h hr hours hour minutes minute seconds second days day weeks week years year meters metres meter metre miles mile feet foot inches inch grams gram kilograms kilogram liters litres dollars dollar euros euro cents cent percent degrees degree mph kph".split()
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
#: Only capitals are looked at; behind them the alternatives see what they would see alone.
NAME = r"(?=\p{Lu})(?:(?<=[\p{Ll}\p{N}][,;:]? )\p{Lu}\p{Ll}+(?![\p{L}\p{M}\p{N}])|(?<=^|^ |[.!?] )\p{Lu}\p{Ll}+(?= \p{Ll}))"
#: Placeholders from the private use area: number, unit, name.
NUM, UNIT, PERSON = "\ue000", "\ue001", "\ue002"
#: White space (any of Unicode) other than one space, and placeholders of the text itself.
SPACES = r"[\s\x{85}\p{Z}\ue000-\ue002]{2,}|[\s\x{85}\p{Z}\ue000-\ue002&&[^ ]]"
WORD = r"[\p{L}\p{M}\ue000-\ue002]+"


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once: a generator keeps the optimizer from repeating them in what follows."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select("*", F.explode(F.array(made)).alias("_held")).select(*[c for c in rows.columns if c not in columns], *[F.col(f"_held.{n}").alias(n) for n in columns])


def _marked(clean: Column) -> Column:
    """Clean text with its placeholders. A name is a capitalised word after a lower-case one, or one that opens a sentence before one; a unit follows a number."""
    names = F.regexp_replace(clean, NAME, PERSON)
    numbers = F.regexp_replace(names, NUMBER, f" {NUM} ")
    units = F.regexp_replace(numbers, f"(?<={NUM} {{1,2}})(?i:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{M}}])", UNIT)
    return F.when(clean.rlike(r"\p{N}"), units).otherwise(names)


def tokens(rows: DataFrame, key: str) -> DataFrame:
    """key, template tokens t and at the same positions plain lower-case words w (null where the text has no slot)."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES, " ")
    made = _held(rows.select(F.col(key), "text"), text=text)
    made = _held(made, marked=_marked(F.col("text")))
    words = F.regexp_extract_all(F.lower("text"), F.lit(NUMBER + r"|[\p{L}\p{M}]+"), F.lit(0))
    made = made.select(key, F.regexp_extract_all(F.lower("marked"), F.lit(WORD), F.lit(0)).alias("t"), F.when(F.col("marked").rlike(f"[{NUM}{UNIT}{PERSON}]"), words).alias("w"))
    return _held(made, t=F.col("t"), w=F.col("w")).where(F.size("t") > 0)


def _hash(tokens: str, i: Column, width: int) -> Column:
    """Hash of the window at i; reads by index, as a slice would copy the whole array each time."""
    return F.xxhash64(F.least(F.size(tokens), F.lit(width)), *[F.get(tokens, i + k) for k in range(width)])


def windows(rows: DataFrame, key: str, width: int = WINDOW) -> DataFrame:
    """key and hash k of every window, as template and, where that differs, as plain words."""
    n = F.greatest(F.size("t") - (width - 1), F.lit(1))
    hashes = lambda side: F.transform(F.slice("t", 1, n), lambda x, i: _hash(side, i, width))
    return tokens(rows, key).select(key, F.explode(F.when(F.col("w").isNull(), hashes("t")).otherwise(F.array_distinct(F.concat(hashes("t"), hashes("w"))))).alias("k"))


def fillers(rows: DataFrame, key: str, width: int = WINDOW) -> DataFrame:
    """One row per window: key, pos, hash h of the template, q of the words, and the array f of fillers (null where there is no slot)."""
    made = _held(tokens(rows, key), w=F.coalesce("w", "t"))
    made = _held(made, f=F.zip_with("t", "w", lambda t, w: F.when(t.isin(NUM, UNIT, PERSON), w)))
    n = F.greatest(F.size("t") - (width - 1), F.lit(1))
    cells = F.transform(F.slice("t", 1, n), lambda x, i: F.struct(_hash("t", i, width).alias("h"), _hash("w", i, width).alias("q"), F.array(*[F.get("f", i + k) for k in range(width)]).alias("f")))
    return made.select(key, F.posexplode(cells).alias("pos", "c")).select(key, "pos", "c.h", "c.q", "c.f")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, width: int = WINDOW) -> DataFrame:
    """doc_id, item_id, hits, n_windows and similarity of every contaminated document and item. Each step is stored, as the driver's memory follows the size of a plan."""
    cells = materialize(fillers(benchmark.select("item_id", "text"), "item_id", width), "bench-fillers")
    items = cells.groupBy("item_id", "h").agg(F.collect_set("q").alias("qs"))
    items = items.withColumn("n_windows", F.count("*").over(W.partitionBy("item_id")))
    items = materialize(items.select("item_id", "n_windows", "h", F.explode(F.array_distinct(F.concat(F.array("h"), "qs"))).alias("k")), "bench-windows")
    small = items.count() <= BROADCAST_ROWS
    near = F.broadcast(items) if small else items
    met = windows(docs.select("doc_id", "text"), "doc_id", width).join(near, "k").drop("k")
    hits = met.distinct().groupBy("doc_id", "item_id", "n_windows").agg(F.count("*").alias("hits"))
    found = materialize(hits.where(F.col("hits") >= similarity * F.col("n_windows")), "bench-hits")
    slotted = _consistent(docs, cells, found, width)
    discard(cells, items)
    out = found.join(slotted, found["doc_id"].eqNullSafe(slotted["s_doc"]) & found["item_id"].eqNullSafe(slotted["s_item"]), "left")
    kept = F.coalesce("s_hits", "hits")
    out = out.where(kept >= similarity * F.col("n_windows"))
    return out.select("doc_id", "item_id", kept.cast("long").alias("hits"), F.col("n_windows").cast("long").alias("n_windows"), F.round(kept / F.col("n_windows"), 6).alias("similarity"))


def _consistent(docs: DataFrame, bench: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """s_doc, s_item, s_hits, stored: for candidates whose item has slots, the distinct windows whose fillers hold.

    These are windows with the same words on both sides, or whose fillers all follow their diagonal's
    mapping: each item filler goes to the document filler it meets in most windows, and of item fillers that then share
    a document filler the one with most windows keeps it.
    """
    items = bench.select(F.col("item_id").alias("s_item"), F.col("pos").alias("i_pos"), "h", "q", F.col("f").alias("i_f"))
    with_slots = items.where(F.exists("i_f", lambda x: x.isNotNull())).select("s_item").distinct()
    pairs = found.join(with_slots, F.col("item_id").eqNullSafe(F.col("s_item"))).select("doc_id", "s_item").distinct()
    pairs = materialize(pairs, "bench-pairs")
    wanted = pairs.select(F.col("doc_id").alias("w_doc")).distinct()
    own = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")), "left_semi")
    own = fillers(own, "doc_id", width).withColumnRenamed("doc_id", "s_doc")
    own = materialize(own, "bench-own")
    near = own.join(pairs, F.col("s_doc").eqNullSafe(F.col("doc_id"))).drop("doc_id")
    said = near.select("s_doc", "s_item", "q").distinct().join(items, ["s_item", "q"]).select("s_doc", "s_item", "h", F.lit(True).alias("good"))
    cells = near.drop("q").join(items.drop("q"), ["s_item", "h"])
    both = F.filter(F.zip_with("i_f", "f", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"].isNotNull())
    cells = cells.select("s_doc", "s_item", "h", "pos", (F.col("pos") - F.col("i_pos")).alias("diagonal"), F.array_distinct(both).alias("pairs"))
    line, a, b = ["s_doc", "s_item", "diagonal"], F.col("pair.a"), F.col("pair.b")
    slots = cells.select("*", F.explode_outer("pairs").alias("pair")).withColumn("votes", F.count("*").over(W.partitionBy(*line, a, b)))
    slots = slots.withColumn("first", F.max(F.struct("votes", a == b, b)).over(W.partitionBy(*line, a))["b"] == b)
    slots = slots.withColumn("agrees", F.col("first") & (F.max(F.when(F.col("first"), F.struct("votes", a == b, a))).over(W.partitionBy(*line, b))["a"] == a))
    held = slots.groupBy(*line, "pos", "h", "pairs").agg(F.bool_and(F.coalesce("agrees", F.lit(False))).alias("good")).select("s_doc", "s_item", "h", "good")
    held = held.unionByName(said).groupBy("s_doc", "s_item").agg(F.count_distinct(F.when(F.col("good"), F.col("h"))).alias("s_hits"))
    out = materialize(held, "bench-held")
    discard(pairs, own)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; columns of any name pass through."""
    name = fresh(docs, "bad_id")
    bad = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "bench-leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
