"""Registered queries of addresses and of text helpers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import addresses
from ..sources import bind
from . import oracle as O
from .catalog import query

_SP = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query(f"""WITH {O.FACTS}, r AS (SELECT sample_id, name, ord * 1000 AS s, ord * 1000 + 400 + fn % 600 AS e FROM fns),
p AS (SELECT f.sample_id, l_linenumber AS line, fn, l_partkey * 37 % (n * 1000) AS address FROM lineitem JOIN fns f ON f.fn = l_orderkey WHERE l_returnflag = 'R')
SELECT p.sample_id, p.fn, CAST(line AS BIGINT) AS line, CAST(address AS BIGINT) AS address, r.name AS owner, coalesce(address = s, false) AS at_start
FROM p LEFT JOIN r ON r.sample_id = p.sample_id AND address >= s AND address < e""")
def address_owners(spark, sf):
    """The function that holds each referenced address: a range join by pages."""
    f = bind.functions(spark, sf)
    start = F.col("ord") * 1000
    ranges = f.select("sample_id", start.cast("long").alias("start"), (start + 400 + F.col("fn") % 600).cast("long").alias("end"), F.col("name").alias("owner"), start.cast("long").alias("first"))
    lines = bind.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey")
    points = lines.join(f, "fn").select("sample_id", "fn", "line", (F.col("l_partkey") * 37 % (F.col("n") * 1000)).cast("long").alias("address"))
    return addresses.containing(points, ranges, ["owner", "first"]).select("sample_id", "fn", "line", "address", "owner", F.coalesce(F.col("address") == F.col("first"), F.lit(False)).alias("at_start"))


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 30000 WHEN c_custkey % 4 < 3 THEN 8192 * (c_custkey % 3) + 5 WHEN c_custkey % 8 = 3 THEN 100 END AS a FROM customer),
b AS (SELECT * FROM (VALUES ('.text', 0, 8192, true, false), ('.data', 8192, 12288, false, true), ('.rsrc', 16384, 20000, false, false)) t(name, s, e, x, w))
SELECT k AS sample_id, CAST(a AS BIGINT) AS address, coalesce(name, 'unknown') AS section, coalesce(x, false) AS is_executable, coalesce(w, false) AS is_writable FROM p LEFT JOIN b ON a >= s AND a < e""")
def entry_points(spark, sf):
    k = F.col("c_custkey")
    custom = bind.read(spark, sf, "customer")
    none = F.lit(None).cast("long")
    programs = custom.select(k.alias("sample_id"), F.when(k % 4 == 0, F.array(none, k % 30000)).otherwise(F.array(none)).cast("array<bigint>").alias("external"), F.when(k % 4 < 3, 8192 * (k % 3) + 5).cast("long").alias("image_base"), F.when(k % 8 == 3, 100).cast("long").alias("min_address"))
    parts = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end"), F.lit(x).alias("x"), F.lit(w).alias("w")) for n, s, e, x, w in ((".text", 0, 8192, True, False), (".data", 8192, 12288, False, True), (".rsrc", 16384, 20000, False, False))]))
    return addresses.entry_points(programs, custom.select(k.alias("sample_id"), parts))


_ITEMS = "[source, NULL, '  ', ' web ', chr(9) || source || chr(10), '']"


@query(f"""WITH t AS (SELECT doc_id, text, source, list_transform({_ITEMS}, lambda x: trim(x, {_SP})) AS l FROM documents),
c AS (SELECT *, list_filter(l, lambda x: coalesce(x, '') <> '') AS k FROM t)
SELECT doc_id, array_to_string(list_filter({_ITEMS}, lambda x: trim(coalesce(x, ''), {_SP}) <> ''), '; ') AS joined, CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'a, b' END AS listed,
CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'Noneless' WHEN doc_id % 5 = 2 THEN '' ELSE coalesce(trim(source, {_SP}), '') END AS meaning,
CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS short, left(text, 2) AS tiny, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') AS tidy FROM c""")
def text_helpers(spark, sf):
    d = bind.read(spark, sf, "documents")
    items = F.array("source", F.lit(None).cast("string"), F.lit("  "), F.lit(" web "), F.concat(F.lit("\t"), "source", F.lit("\n")), F.lit(""))
    k = F.col("doc_id") % 5
    value = F.when(k == 0, " N/A\n").when(k == 1, "Noneless").when(k == 2, "UNKNOWN").otherwise(F.col("source"))
    listed = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    return d.select("doc_id", C.joined(items, "; ").alias("joined"), C.joined_or_none(listed).alias("listed"), C.meaningful(value).alias("meaning"), C.shortened(F.col("text"), 40).alias("short"), C.shortened(F.col("text"), 2).alias("tiny"), F.array_join(C.tidy_list(items), "|").alias("tidy"))
