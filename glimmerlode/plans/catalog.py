"""The registered queries of the triage operators, each with the SQL that checks it. Arrays leave as sorted, joined text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..functions import columns as C, rules
from ..operators import apis, functions as fn, graph, packing, scoring, strings, views
from ..sources import bind
from ..sources.store import stored
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(array: str | Column) -> Column:
    return F.array_join(array, ",")


def big(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched functions, stored once: every derivation below reads them by column."""
    return stored(fn.enrich_functions(bind.functions(spark, sf), bind.api_refs(spark, sf), bind.calls(spark, sf)), "functions")


@query(f"WITH {O.STRING_FACTS} SELECT sample_id, address, CAST(score AS BIGINT) AS score, array_to_string(tags, ',') AS tags, benign_hint FROM strings_scored WHERE score > 0")
def string_scoring(spark, sf):
    return strings.score_strings(bind.strings(spark, sf)).select("sample_id", "address", big("score"), text("tags").alias("tags"), "benign_hint")


@query(f"WITH {O.STRING_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, value, address) AS rank FROM strings_scored WHERE score > 0) SELECT sample_id, rank, address, CAST(score AS BIGINT) AS score, array_to_string(tags, ',') AS tags, benign_hint FROM r WHERE rank <= 40")
def string_top40(spark, sf):
    return strings.top_strings(strings.score_strings(bind.strings(spark, sf))).select("sample_id", big("rank"), "address", big("score"), text("tags").alias("tags"), "benign_hint")


@query(f"WITH {O.STRING_FACTS} SELECT address, left(v, 220) AS value FROM (SELECT address, v, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY address) AS ord FROM cleaned WHERE length(v) >= 4) WHERE ord <= 400")
def string_scan(spark, sf):
    rows = bind.strings(spark, sf).withColumn("v", C.clean_string(F.coalesce("value", F.lit("")))).where(F.length("v") >= 4)
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy("sample_id").orderBy("address"))).where("ord <= 400")
    return rows.select("address", F.substring("v", 1, 220).alias("value"))


@query(O.facts(f"SELECT DISTINCT api AS symbol, {O.canon('api')} AS name, CAST({O.weight('api')} AS BIGINT) AS weight FROM refs"))
def api_canonical(spark, sf):
    return bind.symbols(spark, sf).select("symbol").distinct().select("symbol", C.canonical(F.col("symbol")).alias("name"), C.weight(F.col("symbol")).cast("long").alias("weight"))


@query(O.facts(f"SELECT sample_id, name, CAST(max(w) AS BIGINT) AS weight, array_to_string(list_sort(list(symbol)), ',') AS variants, row_number() OVER (PARTITION BY sample_id ORDER BY max(w) DESC, name) AS rank FROM (SELECT sample_id, symbol, {O.canon('symbol')} AS name, {O.weight('symbol')} AS w FROM symbols) WHERE w IS NOT NULL GROUP BY sample_id, name"))
def suspicious_apis(spark, sf):
    return views.ranked_apis(apis.suspicious_apis(bind.symbols(spark, sf))).select("sample_id", "name", big("weight"), text("variants").alias("variants"), big("rank"))


_DETECT = f"""det0 AS (SELECT sample_id, capability AS name, least, base, count(*) AS n, list_sort(list(api)) AS m FROM (SELECT DISTINCT sample_id, {O.canon('symbol')} AS c FROM symbols) JOIN caprule ON api = c GROUP BY ALL),
det AS (SELECT *, CASE WHEN name IN ('anti_analysis', 'persistence', 'dynamic_loading') THEN CASE WHEN n >= least + 2 THEN 'medium' ELSE 'low' END WHEN n >= least + 2 THEN 'high' WHEN n >= least + 1 THEN 'medium' ELSE 'low' END AS confidence FROM det0 WHERE n >= least)"""


@query(f"WITH {O.FACTS}, {_DETECT} SELECT sample_id, name, n AS match_count, confidence, CAST(base + CASE confidence WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 0 END AS BIGINT) AS score, array_to_string(m, ',') AS matched FROM det")
def capability_detect(spark, sf):
    return apis.detect_capabilities(bind.symbols(spark, sf)).select("sample_id", "name", big("match_count"), "confidence", big("score"), text("matched_apis").alias("matched"))


_SUPPORT = """imp AS (SELECT DISTINCT sample_id, name AS f, score, capability FROM (SELECT sample_id, name, score, unnest(caps) AS capability FROM enriched UNION ALL SELECT sample_id, name, score, CASE r WHEN 'network' THEN 'networking' WHEN 'injection' THEN 'process_injection' WHEN 'loader' THEN 'dynamic_loading' ELSE r END FROM (SELECT sample_id, name, score, unnest(roles) AS r FROM enriched) WHERE r <> 'execution')),
rk AS (SELECT sample_id, name AS f, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS rank FROM enriched),
sup AS (SELECT sample_id, capability AS name, count(*) AS local, count(*) FILTER (score >= 15) AS medium, count(*) FILTER (rank <= 25 AND score > 0) AS top FROM imp JOIN rk USING (sample_id, f) GROUP BY ALL)"""


@query(f"WITH {O.FACTS}, {_SUPPORT} SELECT * FROM sup")
def capability_support(spark, sf):
    return fn.capability_support(enriched(spark, sf)).select("sample_id", "name", big("local"), big("medium"), big("top"))


@query(f"""WITH {O.FACTS}, {_DETECT}, {_SUPPORT}, strong AS (SELECT DISTINCT sample_id FROM symbols WHERE list_contains({O.lst(rules.STRONG_INJECTION)}, symbol)),
j AS (SELECT coalesce(d.sample_id, s.sample_id) AS sample_id, coalesce(d.name, s.name) AS name, d.n, d.confidence AS c0, d.base + CASE d.confidence WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 0 END AS s0, coalesce(local, 0) AS local, coalesce(medium, 0) AS medium, coalesce(top, 0) AS top FROM det d FULL JOIN sup s ON d.sample_id = s.sample_id AND d.name = s.name),
r AS (SELECT DISTINCT capability AS name, least, base FROM caprule),
k AS (SELECT j.*, r.least, r.base, c0 IS NOT NULL AS here, name IN ('anti_analysis', 'persistence', 'dynamic_loading') AS soft, sample_id IN (SELECT sample_id FROM strong) AS strong FROM j JOIN r USING (name)),
o AS (SELECT sample_id, name, here, soft, local, top, n, least,
 CASE WHEN here AND soft AND local <= 1 AND n <= least THEN 'low' WHEN here AND soft AND local >= 2 THEN 'medium' WHEN here AND NOT soft AND local >= 2 AND top >= 1 AND c0 = 'low' THEN 'medium' WHEN here THEN c0
  WHEN name = 'networking' AND local >= 2 AND medium >= 1 THEN CASE WHEN top = 0 THEN 'medium' ELSE 'high' END WHEN name = 'process_injection' AND local >= 2 AND medium >= 1 AND strong THEN 'medium' WHEN name = 'dynamic_loading' AND local >= 2 AND top >= 1 THEN 'medium' END AS confidence,
 CASE WHEN here AND soft AND local <= 1 AND n <= least THEN greatest(4, least(s0, base)) WHEN here AND soft AND local >= 2 THEN greatest(s0, base + 3) WHEN here AND NOT soft AND local >= 2 AND top >= 1 THEN greatest(s0, base + 6) WHEN here THEN s0 WHEN name = 'networking' THEN base + 6 WHEN name = 'process_injection' THEN base + 5 ELSE base + 2 END AS score FROM k)
SELECT sample_id, name, confidence, CAST(score AS BIGINT) AS score, CASE WHEN NOT here THEN 'local_function_evidence' WHEN soft AND local <= 1 AND n <= least THEN 'global_import_surface+weak_local_support' WHEN local >= 2 AND (soft OR top >= 1) THEN 'global_import_surface+multi_function_local_evidence' ELSE 'global_import_surface' END AS source FROM o WHERE confidence IS NOT NULL""".replace("least(s0, base)", "CASE WHEN s0 < base THEN s0 ELSE base END"))
def capability_reconcile(spark, sf):
    symbols = bind.symbols(spark, sf)
    out = apis.reconcile_capabilities(apis.detect_capabilities(symbols), fn.capability_support(enriched(spark, sf)), symbols.where(F.col("symbol").isin(rules.STRONG_INJECTION)))
    return out.select("sample_id", "name", "confidence", big("score"), "source")


@query(O.facts("SELECT sample_id, name, CAST(score AS BIGINT) AS score, risk, array_to_string(roles, ',') AS roles, array_to_string(caps, ',') AS caps, array_to_string(internal, ',') AS internal, array_to_string(external, ',') AS external FROM enriched"))
def function_scores(spark, sf):
    return enriched(spark, sf).select("sample_id", "name", big("score"), "risk", text("roles").alias("roles"), text("caps").alias("caps"), text("internal").alias("internal"), text("external").alias("external"))


@query(O.facts("SELECT sample_id, name, CAST(incoming AS BIGINT) AS incoming, structure FROM enriched"))
def structure_roles(spark, sf):
    return enriched(spark, sf).select("sample_id", "name", big("incoming"), "structure")


@query(O.facts("SELECT sample_id, callee AS name, count(*) AS incoming FROM calls GROUP BY ALL"))
def incoming_calls(spark, sf):
    return bind.calls(spark, sf).groupBy("sample_id", F.col("callee").alias("name")).agg(F.count("*").alias("incoming"))


@query(O.facts("SELECT * FROM roles0"))
def behavior_roles(spark, sf):
    return enriched(spark, sf).select("sample_id", "name", F.explode("roles").alias("role"))


@query(O.facts("SELECT sample_id, name, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS rank FROM enriched WHERE score > 0) WHERE rank <= 25"))
def top_functions(spark, sf):
    return fn.top_functions(enriched(spark, sf)).select("sample_id", "name", big("score"), big("rank"))


@query(O.facts("SELECT sample_id, name, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS rank FROM enriched WHERE score >= 35) WHERE rank <= 12"))
def high_risk_functions(spark, sf):
    return fn.top_functions(enriched(spark, sf).where(F.col("risk").isin("high", "critical")), 12).select("sample_id", "name", big("score"), big("rank"))


@query(O.facts("SELECT sample_id, name AS source, unnest(internal) AS target, 'internal' AS type FROM enriched UNION ALL SELECT sample_id, name, unnest(external), 'external' FROM enriched"))
def callgraph_edges(spark, sf):
    return graph.edges(enriched(spark, sf))


@query(O.facts("SELECT sample_id, count(*) AS nodes, CAST(sum(n_int + n_ext) AS BIGINT) AS edges FROM enriched GROUP BY ALL"))
def callgraph_counts(spark, sf):
    return graph.counts(enriched(spark, sf)).select("sample_id", "nodes", big("edges"))


@query(O.facts("SELECT * FROM (SELECT sample_id, role, name, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY sample_id, role ORDER BY score DESC, name) AS rank FROM (SELECT sample_id, unnest(roles) AS role, name, score FROM enriched)) WHERE rank <= 10"))
def behavior_clusters(spark, sf):
    return fn.behavior_clusters(enriched(spark, sf)).select("sample_id", "role", "name", big("score"), big("rank"))


@query(O.facts("SELECT sample_id, 'structure' AS kind, structure AS role, count(*) AS n FROM enriched GROUP BY ALL UNION ALL SELECT sample_id, 'behavior', role, count(*) FROM (SELECT sample_id, unnest(roles) AS role FROM enriched) GROUP BY ALL"))
def role_summary(spark, sf):
    e = enriched(spark, sf)
    return e.groupBy("sample_id", F.lit("structure").alias("kind"), F.col("structure").alias("role")).agg(F.count("*").alias("n")).unionByName(e.select("sample_id", F.lit("behavior").alias("kind"), F.explode("roles").alias("role")).groupBy("sample_id", "kind", "role").agg(F.count("*").alias("n")))


@query(O.facts("SELECT * FROM (SELECT sample_id, name, CAST(n_int + n_ext AS BIGINT) AS connectivity, row_number() OVER (PARTITION BY sample_id ORDER BY n_int + n_ext DESC, incoming DESC, score DESC, name) AS rank FROM enriched WHERE n_int + n_ext >= 12 AND (score >= 15 OR len(roles) > 0)) WHERE rank <= 12"))
def hub_functions(spark, sf):
    return fn.hub_functions(enriched(spark, sf)).select("sample_id", "name", big("connectivity"), big("rank"))


_NODES = "nodes AS (SELECT sample_id, name, score, roles, structure, internal FROM enriched)"
_ROLE2 = "list_distinct(list_concat(a.roles, b.roles))"


def _two_hop(k: int) -> str:
    return f"""{_NODES}, seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS r FROM nodes WHERE score >= 15 OR len(roles) > 0) WHERE r <= 50),
step AS (SELECT sample_id, name, score, roles, unnest(internal[1:10]) AS b FROM seed),
path AS (SELECT s.sample_id, s.name AS a, n.name AS b, s.score + n.score AS combined, list_sort(list_distinct(list_concat(s.roles, n.roles))) AS roles FROM step s JOIN nodes n ON n.sample_id = s.sample_id AND n.name = s.b),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY combined DESC, a, b) AS rank FROM path WHERE combined >= 20 OR len(roles) > 0) WHERE rank <= {k})"""


@query(f"WITH {O.FACTS}, {_two_hop(30)} SELECT sample_id, a, b, CAST(combined AS BIGINT) AS combined, array_to_string(roles, ',') AS roles, rank FROM two")
def two_hop_flows(spark, sf):
    return graph.two_hop(enriched(spark, sf)).select("sample_id", "a", "b", big("combined"), text(F.array_sort("roles")).alias("roles"), big("rank"))


_THREE = f"""{_NODES}, seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS r FROM nodes WHERE score >= 20 OR len(roles) > 0) WHERE r <= 35),
s1 AS (SELECT sample_id, name, score, roles, unnest(internal[1:6]) AS b FROM seed),
s2 AS (SELECT s.sample_id, s.name AS a, s.score AS sa, s.roles AS ra, n.name AS b, n.score AS sb, n.roles AS rb, unnest(n.internal[1:6]) AS c FROM s1 s JOIN nodes n ON n.sample_id = s.sample_id AND n.name = s.b),
path AS (SELECT s.sample_id, a, b, n.name AS c, sa + sb + n.score AS combined, list_distinct(list_concat(list_concat(ra, rb), n.roles)) AS roles FROM s2 s JOIN nodes n ON n.sample_id = s.sample_id AND n.name = s.c WHERE n.name <> a),
three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY combined DESC, a, b, c) AS rank FROM path WHERE combined >= 35 OR len(roles) > 0) WHERE rank <= 25)"""


@query(f"WITH {O.FACTS}, {_THREE} SELECT sample_id, a, b, c, CAST(combined AS BIGINT) AS combined, rank FROM three")
def three_hop_flows(spark, sf):
    return graph.three_hop(enriched(spark, sf)).select("sample_id", "a", "b", "c", big("combined"), big("rank"))


@query(O.facts("""SELECT 'initializer' AS kind, sample_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, n_int + n_ext DESC, name) AS rank FROM enriched WHERE structure = 'initializer') WHERE rank <= 8
UNION ALL SELECT 'dispatcher', sample_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n_int + n_ext DESC, score DESC, name) AS rank FROM enriched WHERE structure = 'dispatcher') WHERE rank <= 8
UNION ALL SELECT 'worker', sample_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, incoming DESC, name) AS rank FROM enriched WHERE structure = 'worker' AND (score >= 10 OR len(roles) > 0)) WHERE rank <= 12""".replace("score DESC, n_int + n_ext DESC, name", "score DESC, n_int DESC, name")))
def behavior_story(spark, sf):
    e = enriched(spark, sf)
    parts = [fn.story_functions(e, k).select(F.lit(k).alias("kind"), "sample_id", "name", big("rank")) for k in ("initializer", "dispatcher", "worker")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {O.SECTION_FACTS} SELECT doc_id, sampled, entropy FROM ent")
def byte_entropy(spark, sf):
    return packing.byte_entropy(bind.sections(spark, sf), ["doc_id"])


@query(f"""WITH {O.SECTION_FACTS}, v(entropy) AS (VALUES (6.79), (6.8), (7.19), (7.2), (7.59), (7.6), (NULL)), both_ AS (SELECT CAST(entropy AS DOUBLE) AS entropy FROM v UNION ALL SELECT entropy FROM ent)
SELECT entropy, CASE WHEN entropy IS NULL THEN 'unknown' WHEN entropy >= 7.6 THEN 'very_high' WHEN entropy >= 7.2 THEN 'high' WHEN entropy >= 6.8 THEN 'elevated' ELSE 'normal' END AS entropy_class, count(*) AS n FROM both_ GROUP BY ALL""")
def entropy_class(spark, sf):
    sweep = spark.createDataFrame([(x,) for x in (6.79, 6.8, 7.19, 7.2, 7.59, 7.6, None)], "entropy double")
    rows = sweep.unionByName(packing.byte_entropy(bind.sections(spark, sf), ["doc_id"]).select("entropy"))
    return rows.select("entropy", C.entropy_class(F.col("entropy")).alias("entropy_class")).groupBy("entropy", "entropy_class").agg(F.count("*").alias("n"))


_SECTION = f"""WITH {O.SECTION_FACTS}, s AS (SELECT sec.*, CASE WHEN doc_id % 9 = 0 THEN 7.7 WHEN doc_id % 9 = 1 THEN 7.3 ELSE entropy END AS e, list_contains({O.lst(rules.SUSPICIOUS_SECTIONS)}, name) AS bad, NOT list_contains({O.lst(rules.COMMON_SECTIONS)}, lower(name)) AS odd FROM sec LEFT JOIN ent USING (doc_id)),
r AS (SELECT *, coalesce(e >= 7.6, false) AS very, coalesce(e >= 7.2 AND e < 7.6, false) AS high, odd AND x AND size < 1024 AS small FROM s)
SELECT doc_id, bad OR (x AND w) OR (NOT init AND x) OR (very AND (x OR odd)) OR (high AND x) OR small AS suspicious, array_to_string(list_filter([CASE WHEN bad THEN 'name' END, CASE WHEN x AND w THEN 'write_execute' END, CASE WHEN size = 0 THEN 'empty' END, CASE WHEN NOT init AND x THEN 'uninitialized_execute' END, CASE WHEN very THEN 'very_high_entropy' END, CASE WHEN high THEN 'high_entropy' END, CASE WHEN small THEN 'small_execute' END], lambda y: y IS NOT NULL), ',') AS reasons FROM r"""


@query(_SECTION)
def section_suspicion(spark, sf):
    s = bind.sections(spark, sf)
    k = F.col("doc_id") % 9
    rows = s.drop("content").join(packing.byte_entropy(s, ["doc_id"]), "doc_id", "left").withColumn("entropy", F.when(k == 0, 7.7).when(k == 1, 7.3).otherwise(F.col("entropy")))
    return packing.section_suspicion(rows).select("doc_id", "suspicious", text("reasons").alias("reasons"))


@query(f"WITH {O.EVENT_FACTS} SELECT event_id, m AS mnemonic, coalesce(previous, '') AS previous FROM prev")
def prev_mnemonics(spark, sf):
    return packing.previous_mnemonics(bind.instructions(spark, sf)).select("event_id", "mnemonic", text("previous").alias("previous"))


@query(f"""WITH {O.EVENT_FACTS}, a AS (SELECT sample_id, min(CASE WHEN m IN ('PUSHAD', 'PUSHA') THEN idx END) AS p, min(CASE WHEN m IN ('POPAD', 'POPA') THEN idx END) AS q, count(*) FILTER (m IN ('JMP', 'CALL')) AS j, max(CASE WHEN m IN ('JMP', 'CALL') THEN idx END) AS l, count(*) AS n FROM ins WHERE idx < 25 GROUP BY sample_id),
f AS (SELECT sample_id, list_filter([CASE WHEN p IS NOT NULL THEN 'pushad_near_entry' END, CASE WHEN q IS NOT NULL THEN 'popad_near_entry' END, CASE WHEN q > p THEN 'pushad_to_popad' END, CASE WHEN j >= 4 THEN 'dense_transfers' END, CASE WHEN n >= 4 AND l >= n - 4 THEN 'tail_transfer' END], lambda x: x IS NOT NULL) AS ps FROM a)
SELECT sample_id, array_to_string(ps, ',') AS patterns, CAST(coalesce(list_sum(list_transform(ps, lambda x: CASE x WHEN 'pushad_near_entry' THEN 20 WHEN 'popad_near_entry' THEN 20 WHEN 'pushad_to_popad' THEN 15 ELSE 10 END)), 0) AS BIGINT) AS score FROM f""")
def unpack_patterns(spark, sf):
    return packing.unpack_patterns(bind.instructions(spark, sf)).select("sample_id", text("patterns").alias("patterns"), big("score"))


@query(f"""WITH {O.EVENT_FACTS}, t AS (SELECT *, 'a' || (event_id % 13) AS target, {O.lst(bind.SECTIONS)}[event_id % {len(bind.SECTIONS)} + 1] AS ts, CASE WHEN sample_id % 2 = 0 THEN '.text' ELSE 'UPX1' END AS es, ',' || coalesce(previous, '') || ',' AS pv FROM (SELECT sample_id, event_id, idx, m, array_to_string(list(m) OVER (PARTITION BY sample_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ',') AS previous FROM ins) WHERE idx < 180 AND m IN ('JMP', 'CALL') AND event_id % 4 <> 0),
u AS (SELECT *, list_contains({O.lst(rules.SUSPICIOUS_SECTIONS)}, ts) AS bt, list_contains({O.lst(rules.CODE_SECTIONS)}, lower(ts)) AS code, list_contains({O.lst(rules.SUSPICIOUS_SECTIONS)}, es) AS be FROM t),
s AS (SELECT *, CASE WHEN ts = es THEN CASE m WHEN 'JMP' THEN 4 ELSE 2 END ELSE CASE m WHEN 'JMP' THEN 35 ELSE 18 END + CASE WHEN code THEN 20 WHEN NOT bt THEN 10 ELSE -6 END + CASE WHEN be AND NOT bt THEN 12 ELSE 0 END END - CASE WHEN event_id % 6 = 0 THEN 8 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 6 ELSE 0 END + CASE WHEN idx >= 24 AND m = 'JMP' THEN 8 ELSE 0 END + CASE WHEN contains(pv, ',POPAD,') OR contains(pv, ',POPA,') THEN 18 WHEN contains(pv, ',PUSHAD,') OR contains(pv, ',PUSHA,') THEN 8 ELSE 0 END AS score FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, target ORDER BY score DESC, idx) AS b FROM s WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, target) AS rank FROM b WHERE b = 1)
SELECT sample_id, rank, target AS address, ts AS target_section, CAST(score AS BIGINT) AS score, CASE WHEN ts = es THEN 'same_section_' ELSE 'cross_section_' END || CASE m WHEN 'JMP' THEN 'jump' ELSE 'call' END AS kind, idx >= 24 AS late FROM r WHERE rank <= 10""")
def oep_candidates(spark, sf):
    return packing.oep_candidates(bind.transfers(spark, sf)).select("sample_id", big("rank"), "address", "target_section", big("score"), "kind", "late")


@query(f"""WITH {O.FACTS}, {O.SECTION_FACTS}, {O.EVENT_FACTS}, ent_ AS (SELECT DISTINCT user_id AS sample_id, CASE WHEN user_id % 2 = 0 THEN '.text' ELSE 'UPX1' END AS es FROM events),
nm AS (SELECT sample_id, list(DISTINCT name) AS names FROM sec GROUP BY ALL), rs AS (SELECT DISTINCT sample_id FROM symbols WHERE symbol IN ('VirtualAlloc', 'VirtualProtect', 'GetProcAddress', 'LoadLibraryW', 'LoadLibraryA')),
pt AS (SELECT DISTINCT sample_id FROM ins WHERE idx < 25 AND m IN ('PUSHAD', 'PUSHA', 'POPAD', 'POPA') UNION SELECT sample_id FROM (SELECT sample_id, count(*) FILTER (m IN ('JMP', 'CALL')) AS j, max(CASE WHEN m IN ('JMP', 'CALL') THEN idx END) AS l, count(*) AS n FROM ins WHERE idx < 25 GROUP BY ALL) WHERE j >= 4 OR (n >= 4 AND l >= n - 4))
SELECT e.sample_id, CASE WHEN list_has_any(coalesce(names, []), ['UPX0', 'UPX1', 'UPX2']) THEN 'UPX-like' WHEN list_contains(coalesce(names, []), '.aspack') THEN 'ASPack-like' WHEN e.sample_id IN (SELECT sample_id FROM pt) AND e.sample_id IN (SELECT sample_id FROM rs) THEN 'generic runtime unpacking' WHEN list_contains({O.lst(rules.SUSPICIOUS_SECTIONS)}, es) THEN 'packed/loader stub section' ELSE 'unknown' END AS family FROM ent_ e LEFT JOIN nm USING (sample_id)""")
def packer_family(spark, sf):
    i = bind.instructions(spark, sf)
    entry = bind.transfers(spark, sf).select("sample_id", "entry_section").distinct()
    return packing.packer_family(bind.sections(spark, sf), bind.symbols(spark, sf), packing.unpack_patterns(i), entry)


_CTX = f"""ui AS (SELECT sample_id, count(DISTINCT CASE WHEN list_contains({O.lst(views.ui_symbols())}, c) THEN c END) AS ui, count(*) AS syms, count(DISTINCT CASE WHEN c IN ('LoadLibrary', 'GetProcAddress') THEN c END) AS ldr, count(DISTINCT CASE WHEN c IN ('CreateFile', 'ReadFile', 'WriteFile') THEN c END) AS io FROM (SELECT sample_id, {O.canon('symbol')} AS c FROM symbols) GROUP BY ALL),
ff AS (SELECT sample_id, count(*) FILTER (score >= 35) AS hi, count(*) FILTER (score >= 15) AS med, count(*) FILTER (list_contains(roles, 'persistence')) AS per, count(*) FILTER (list_contains(roles, 'anti_analysis')) AS anti_x, count(*) FILTER (list_contains(roles, 'injection')) AS inj, count(*) FILTER (list_contains(roles, 'network')) AS net FROM enriched GROUP BY ALL),
cx AS (SELECT ff.*, coalesce(ui, 0) AS ui, coalesce(syms, 0) AS syms, coalesce(ldr, 0) AS ldr, coalesce(io, 0) AS io FROM ff LEFT JOIN ui USING (sample_id))"""


@query(f"""WITH {O.FACTS}, {_CTX}, l AS (SELECT sample_id, list_filter([CASE WHEN ui >= 8 AND syms > 120 THEN 'rich_windows_gui_context' END, CASE WHEN io >= 2 AND ui >= 5 THEN 'desktop_app_file_io_context' END, CASE WHEN per BETWEEN 1 AND 3 AND inj = 0 AND net = 0 THEN 'weak_persistence_signal' END, CASE WHEN anti_x BETWEEN 1 AND 3 AND hi = 0 THEN 'weak_anti_analysis_signal' END, CASE WHEN hi = 0 THEN 'no_high_risk_functions' END, CASE WHEN ui >= 10 AND syms >= 150 THEN 'microsoft_desktop_app_profile' END, CASE WHEN inj = 0 AND net = 0 AND hi = 0 AND per + anti_x > 0 THEN 'soft_capability_only_profile' END], lambda x: x IS NOT NULL) AS c FROM cx)
SELECT sample_id, array_to_string(c, ',') AS contexts, CAST(coalesce(list_sum(list_transform(c, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.BENIGN_CONTEXTS.items())} END)), 0) AS BIGINT) AS adjustment FROM l""")
def benign_contexts(spark, sf):
    found = strings.top_strings(strings.score_strings(bind.strings(spark, sf)))
    return scoring.benign_contexts(views.context_features(bind.symbols(spark, sf), enriched(spark, sf), found)).select("sample_id", text("contexts").alias("contexts"), big("adjustment"))


_ADJUSTMENT = "CAST(" + " + ".join(f"CASE WHEN {test} THEN {rules.BENIGN_CONTEXTS[name]} ELSE 0 END" for name, test in {"rich_windows_gui_context": "ui >= 8 AND syms > 120", "desktop_app_file_io_context": "io >= 2 AND ui >= 5", "weak_persistence_signal": "per BETWEEN 1 AND 3 AND inj = 0 AND net = 0", "weak_anti_analysis_signal": "anti_x BETWEEN 1 AND 3 AND hi = 0", "no_high_risk_functions": "hi = 0", "microsoft_desktop_app_profile": "ui >= 10 AND syms >= 150", "soft_capability_only_profile": "inj = 0 AND net = 0 AND hi = 0 AND per + anti_x > 0"}.items()) + " AS BIGINT)"
_RAW = f"""{_DETECT}, cap_ AS (SELECT sample_id, name, confidence, base + CASE confidence WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 0 END AS score FROM det),
api_ AS (SELECT sample_id, name, max(w) AS weight FROM (SELECT sample_id, {O.canon('symbol')} AS name, {O.weight('symbol')} AS w FROM symbols) WHERE w IS NOT NULL GROUP BY ALL),
fun_ AS (SELECT sample_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS r FROM enriched),
part_ AS (SELECT sample_id, least(weight, 12) AS p, 0 AS s FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY weight DESC, name) AS r FROM api_) WHERE r <= 12
  UNION ALL SELECT sample_id, CASE WHEN name IN ('persistence', 'anti_analysis', 'dynamic_loading') THEN least(score, 12) ELSE least(score, 30) END, CAST(name IN ('process_injection', 'networking', 'crypto') AND confidence IN ('medium', 'high') AS INTEGER) FROM cap_
  UNION ALL SELECT sample_id, least(score, 14), CAST(score >= 15 AS INTEGER) FROM fun_ WHERE r <= 6),
raw_ AS (SELECT c_custkey AS sample_id, CAST(coalesce(sum(p), 0) + CASE WHEN c_custkey % 3 = 0 AND coalesce(sum(s), 0) >= 2 THEN 6 ELSE 0 END AS BIGINT) AS raw FROM customer LEFT JOIN part_ ON sample_id = c_custkey GROUP BY c_custkey)"""


def _raw(spark, sf):
    s = bind.symbols(spark, sf)
    packers = bind.read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), (F.col("c_custkey") % 3 == 0).alias("packed"))
    none = spark.createDataFrame([], "sample_id long, score int, benign_hint boolean, value string, address string")
    return scoring.raw_score(apis.suspicious_apis(s), apis.detect_capabilities(s), none, enriched(spark, sf), packers)


@query(f"WITH {O.FACTS}, {_RAW} SELECT * FROM raw_")
def raw_score(spark, sf):
    return _raw(spark, sf)


@query(f"""WITH {O.FACTS}, {_CTX}, {_RAW}, ctx_ AS (SELECT sample_id, {_ADJUSTMENT} AS adjustment FROM cx) SELECT sample_id, raw, greatest(raw + coalesce(adjustment, 0), 0) AS score, CASE WHEN greatest(raw + coalesce(adjustment, 0), 0) >= 120 THEN 'critical' WHEN greatest(raw + coalesce(adjustment, 0), 0) >= 85 THEN 'high' WHEN greatest(raw + coalesce(adjustment, 0), 0) >= 30 THEN 'medium' ELSE 'low' END AS risk_level FROM raw_ LEFT JOIN ctx_ USING (sample_id)""")
def risk_summary(spark, sf):
    found = strings.top_strings(strings.score_strings(bind.strings(spark, sf)))
    contexts = scoring.benign_contexts(views.context_features(bind.symbols(spark, sf), enriched(spark, sf), found))
    return scoring.summary(_raw(spark, sf), contexts).select("sample_id", "raw", big("score"), "risk_level")


def judged(spark, sf):
    return scoring.decide(scoring.derived_capabilities(scoring.packing_risk(scoring.malware_risk(scoring.calibrate(bind.features(spark, sf))))))


@query(f"WITH {O.FEATURES} SELECT sample_id, CAST(calibrated AS BIGINT) AS calibrated, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS fired, band FROM mal")
def score_calibration(spark, sf):
    return judged(spark, sf).select("sample_id", big("calibrated"), text("fired").alias("fired"), "band")


@query(f"WITH {O.FEATURES} SELECT sample_id, CAST(malware AS BIGINT) AS malware, ml AS malware_level FROM lev")
def malware_risk(spark, sf):
    return judged(spark, sf).select("sample_id", big("malware"), "malware_level")


@query(f"WITH {O.FEATURES} SELECT sample_id, CAST(packing AS BIGINT) AS packing, pl AS packing_level FROM lev")
def packing_risk(spark, sf):
    return judged(spark, sf).select("sample_id", big("packing"), "packing_level")


@query(f"WITH {O.FEATURES} SELECT sample_id, array_to_string(derived, ',') AS derived FROM lev")
def derived_capabilities(spark, sf):
    return judged(spark, sf).select("sample_id", text("derived").alias("derived"))


@query(f"""WITH {O.FEATURES}, d AS (SELECT *, (inj AND inj_high) OR (net AND net_high) OR (cry AND cry_high) AS hc, band = 'critical' AND impact AS crit, packed OR (band = 'critical' AND impact) OR ml IN ('high', 'critical') OR len(derived) > 0 OR NOT valid OR oep >= 35 AS review FROM lev),
j AS (SELECT sample_id, CASE WHEN calm THEN 'low' WHEN malware >= 120 OR hc OR (inj AND high_risk >= 1) THEN 'high' WHEN malware >= 60 THEN 'medium' ELSE 'low' END AS signal, CASE WHEN NOT valid OR (packed AND reasoned = 0) THEN 'low' WHEN packed THEN 'medium' WHEN hc OR reasoned >= 2 OR high_risk >= 2 THEN 'high' ELSE 'medium' END AS confidence, review,
CASE WHEN (packed AND ml = 'high') OR ml = 'critical' OR crit OR (pl = 'high' AND oep >= 35) THEN 'high' WHEN review THEN 'medium' ELSE 'low' END AS priority, CASE WHEN calm THEN 'benign_leaning' WHEN packing >= malware + 25 AND malware < 85 THEN 'packing_first' WHEN list_contains(derived, 'in_memory_loader') THEN 'in_memory_loader' WHEN ml IN ('high', 'critical') THEN 'malware_leaning' WHEN pl = 'high' THEN 'packed' ELSE 'inconclusive' END AS assessment,
CASE WHEN calm AND packing < 65 THEN 'balanced' WHEN malware < 35 AND packing < 35 THEN 'low_signal' WHEN packing > malware + 10 THEN 'packing' WHEN malware > packing + 10 THEN 'malware' ELSE 'balanced' END AS dominant FROM d), e AS (SELECT * FROM j) SELECT *, CASE dominant {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.INTERPRETATIONS.items())} ELSE '{rules.INTERPRETATION_ELSE}' END AS interpretation FROM e""")
def decision_summary(spark, sf):
    return judged(spark, sf).select("sample_id", "signal", "confidence", "review", "priority", "assessment", "dominant", "interpretation")


_RANKS = """f AS (SELECT c_custkey AS k, ['process_injection', 'networking', 'crypto', 'persistence', 'anti_analysis', 'dynamic_loading'][c_custkey % 6 + 1] AS name, 1 + c_custkey % 3 AS start, 2 + c_custkey % 5 AS n, 2 AS least, c_custkey % 4 AS sup, c_custkey % 3 AS med, c_custkey % 2 AS top, c_custkey % 4 AS contexts, (c_custkey * 11) % 60 AS negative, c_custkey % 3 = 0 AS packed FROM customer),
h AS (SELECT *, greatest(start, CASE WHEN n >= least + 2 THEN 3 WHEN n >= least + 1 THEN 2 ELSE 1 END, CASE WHEN sup >= 2 THEN 3 WHEN sup = 1 THEN 2 ELSE 1 END, CASE WHEN top >= 1 THEN 2 ELSE 1 END, CASE WHEN name = 'process_injection' AND top + med >= 1 THEN 3 ELSE 1 END) AS hi, greatest(CASE WHEN sup >= 2 THEN greatest(start, 2) WHEN sup = 1 THEN 1 ELSE start END, CASE WHEN n >= least + 2 AND sup >= 2 AND top >= 1 THEN 3 WHEN n >= least + 1 AND sup >= 2 THEN 2 ELSE 1 END) AS lo FROM f),
g AS (SELECT *, CASE WHEN (contexts >= 2 AND top = 0) OR (negative >= 20 AND med = 0) THEN 1 ELSE lo END AS lo2 FROM h),
z AS (SELECT k, name, CASE WHEN name IN ('process_injection', 'networking', 'crypto') THEN hi WHEN packed AND sup = 0 AND top = 0 THEN greatest(lo2 - 1, 1) ELSE lo2 END AS r FROM g)"""


@query(f"WITH {_RANKS} SELECT k AS sample_id, name, CASE WHEN r >= 3 THEN 'high' WHEN r = 2 THEN 'medium' ELSE 'low' END AS calibrated FROM z")
def capability_confidence(spark, sf):
    k = F.col("c_custkey")
    rows = bind.read(spark, sf, "customer").select(k.alias("sample_id"), bind.pick(["process_injection", "networking", "crypto", "persistence", "anti_analysis", "dynamic_loading"], k % 6).alias("name"), C.rank_confidence(1 + k % 3).alias("confidence"), (2 + k % 5).alias("match_count"), F.lit(2).alias("min_matches"), (k % 4).alias("sup"), (k % 3).alias("med"), (k % 2).alias("top"), (k % 4).alias("contexts"), ((k * 11) % 60).alias("negative"), (k % 3 == 0).alias("packed"))
    return scoring.capability_ranks(rows).select("sample_id", "name", "calibrated")


@query("SELECT c_custkey AS sample_id, array_to_string(list_filter([CASE WHEN trim(coalesce(n, '')) = '' THEN 'sample.name' END, CASE WHEN trim(coalesce(r, '')) = '' THEN 'summary.risk_level' END, CASE WHEN trim(coalesce(v, '')) = '' THEN 'summary.contract_version' END], lambda x: x IS NOT NULL), ',') AS missing FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN c_name ELSE '  ' END AS n, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'low' END AS r, CASE WHEN c_custkey % 7 > 0 THEN '1.0.0' END AS v FROM customer)")
def contract_validation(spark, sf):
    k = F.col("c_custkey")
    rows = bind.read(spark, sf, "customer").select(k.alias("sample_id"), F.when(k % 3 == 1, F.col("c_name")).when(k % 3 == 2, "  ").alias("n"), F.when(k % 5 == 0, "").otherwise("low").alias("r"), F.when(k % 7 > 0, "1.0.0").alias("v"))
    return rows.select("sample_id", text(scoring.invalid_fields(F.col("n"), F.col("r"), F.col("v"))).alias("missing"))


def _half(spark, sf, late: bool):
    lines = bind.read(spark, sf, "lineitem").where("l_returnflag <> 'N'").where((F.col("l_linenumber") > 2) == late)
    refs = lines.select(F.col("l_orderkey").alias("fn"), bind.pick(bind.APIS, F.col("l_partkey") % len(bind.APIS)).alias("symbol"))
    return refs.join(bind.functions(spark, sf).select("sample_id", "fn"), "fn").select("sample_id", "symbol").distinct()


_HALVES = f"halves AS (SELECT DISTINCT f.sample_id, {O.lst(bind.APIS)}[l_partkey % {len(bind.APIS)} + 1] AS symbol, l_linenumber > 2 AS late FROM lineitem JOIN fns f ON f.fn = l_orderkey WHERE l_returnflag <> 'N')"


@query(f"WITH {O.FACTS}, {_HALVES}, a AS (SELECT sample_id, symbol FROM halves WHERE NOT late), b AS (SELECT sample_id, symbol FROM halves WHERE late) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def report_diff_sets(spark, sf):
    return views.set_diff(_half(spark, sf, False), _half(spark, sf, True), "sample_id", "symbol")


@query(f"""WITH {O.FACTS}, {_HALVES}, w AS (SELECT sample_id, late, count(*) AS symbols, coalesce(sum({O.weight('symbol')}), 0) AS weight FROM halves GROUP BY ALL), s AS (SELECT DISTINCT sample_id FROM w)
SELECT s.sample_id, coalesce(a.symbols, 0) AS left_symbols, coalesce(b.symbols, 0) AS right_symbols, coalesce(b.symbols, 0) - coalesce(a.symbols, 0) AS delta_symbols, CAST(coalesce(b.weight, 0) - coalesce(a.weight, 0) AS BIGINT) AS delta_weight FROM s LEFT JOIN (SELECT * FROM w WHERE NOT late) a USING (sample_id) LEFT JOIN (SELECT * FROM w WHERE late) b USING (sample_id)""")
def report_diff_summary(spark, sf):
    summed = lambda late: _half(spark, sf, late).groupBy("sample_id").agg(F.count("*").alias("symbols"), F.coalesce(F.sum(C.weight(F.col("symbol"))), F.lit(0)).cast("long").alias("weight"))
    return views.numeric_diff(summed(False), summed(True), "sample_id", ["symbols", "weight"]).select("sample_id", "left_symbols", "right_symbols", "delta_symbols", "delta_weight")


@query(O.facts("SELECT sample_id, name, CAST(score AS BIGINT) AS score, structure, array_to_string(roles, ',') AS roles FROM enriched WHERE name = 'f3'"))
def inspect_function(spark, sf):
    return views.inspect_function(enriched(spark, sf), "f3").select("sample_id", "name", big("score"), "structure", text("roles").alias("roles"))


@query(O.facts("SELECT sample_id, name, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS rank FROM enriched WHERE list_contains(caps, 'networking') OR list_contains(roles, 'network')) WHERE rank <= 12"))
def inspect_capability(spark, sf):
    return views.inspect_capability(enriched(spark, sf), "networking").select("sample_id", "name", big("score"), big("rank"))


@query(f"""WITH {O.FACTS}, {O.STRING_FACTS}, {_DETECT}, c AS (SELECT sample_id, name, base + CASE confidence WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 0 END AS s FROM det), p AS (SELECT sample_id, name, max(w) AS s FROM (SELECT sample_id, {O.canon('symbol')} AS name, {O.weight('symbol')} AS w FROM symbols) WHERE w IS NOT NULL GROUP BY ALL),
u AS (SELECT CAST(sample_id AS VARCHAR) AS sample_id, 1 AS b, 'capability:' || name || ' (+' || s || ')' AS indicator, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, name) AS r FROM c UNION ALL SELECT CAST(sample_id AS VARCHAR), 2, 'api:' || name || ' (+' || s || ')', row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, name) FROM p UNION ALL SELECT CAST(sample_id AS VARCHAR), 3, 'function:' || name || ' (+' || score || ')', row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) FROM enriched WHERE score > 0
  UNION ALL SELECT sample_id, 4, 'string:' || left(value, 60) || ' (+' || score || ')', row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, value, address) FROM strings_scored WHERE score > 0),
z AS (SELECT sample_id, indicator, row_number() OVER (PARTITION BY sample_id ORDER BY b, r) AS rank FROM u WHERE r <= 5) SELECT * FROM z WHERE rank <= 12""")
def top_indicators(spark, sf):
    s = bind.symbols(spark, sf)
    return views.top_indicators(apis.detect_capabilities(s), apis.suspicious_apis(s), enriched(spark, sf), strings.score_strings(bind.strings(spark, sf))).select("sample_id", big("rank"), "indicator")


from . import places, stories  # noqa: E402, F401  (register their queries in the same tables)
