"""Registered queries of packer tables, string evidence, reasons, storylines and rule sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C, rules
from ..operators import apis, functions as fn, graph, packing, scoring, stories, strings
from ..sources import bind, rule_files
from ..sources.store import stored
from . import oracle as O
from .catalog import _DETECT, _NODES, _THREE, _two_hop, big, enriched, query, text


def _strings(spark, sf):
    return fn.function_strings(bind.string_refs(spark, sf), strings.score_strings(bind.sample_strings(spark, sf)))


def enriched_with_strings(spark, sf):
    """Enriched functions whose strings count too, stored once."""
    return stored(fn.enrich_functions(bind.functions(spark, sf), bind.api_refs(spark, sf), bind.calls(spark, sf), strings=_strings(spark, sf)), "functions-strings")


_STRINGS = f"""{O.FACTS}, {O.STRING_FACTS},
fstr AS (SELECT r.sample_id, r.name, e.address, e.value, e.score, e.tags, e.benign_hint FROM (SELECT DISTINCT f.sample_id, f.name, 'x' || (l_suppkey % {len(bind.EXAMPLES)}) AS address FROM lineitem JOIN fns f ON f.fn = l_orderkey WHERE l_returnflag = 'A') r JOIN strings_scored e ON e.address = r.address AND e.sample_id = 'examples' AND e.score > 0),
sagg AS (SELECT sample_id, name, sum(CASE WHEN benign_hint THEN 0 ELSE least(score, 15) END) AS ss, list_distinct(flatten(list(tags))) AS stags FROM fstr GROUP BY ALL),
sbest AS (SELECT sample_id, name, list(value ORDER BY r) AS strings FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY score DESC, value, address) AS r FROM fstr) WHERE r <= 12 GROUP BY ALL),
sroles AS (SELECT sample_id, name, list_sort(list(DISTINCT role)) AS roles FROM (SELECT * FROM roles0 UNION ALL SELECT sample_id, name, CASE t WHEN 'networking' THEN 'network' ELSE t END FROM (SELECT sample_id, name, unnest(stags) AS t FROM sagg) WHERE t <> 'filesystem') GROUP BY ALL),
hitl AS (SELECT sample_id, name, list_sort(list(DISTINCT target)) AS hl FROM cref WHERE w IS NOT NULL GROUP BY ALL),
sj AS (SELECT j.* EXCLUDE (roles), coalesce(r.roles, []) AS roles, coalesce(g.ss, 0) AS ss, coalesce(b.strings, []) AS strings, coalesce(h.hl, []) AS hl, len(j.internal) AS n_int FROM joined j LEFT JOIN sroles r USING (sample_id, name) LEFT JOIN sagg g USING (sample_id, name) LEFT JOIN sbest b USING (sample_id, name) LEFT JOIN hitl h USING (sample_id, name)),
sp AS (SELECT *, CASE WHEN n_int >= 15 THEN 2 ELSE 0 END + CASE WHEN n_ext >= 30 THEN 2 ELSE 0 END AS fan, CASE WHEN list_contains(caps, 'persistence') AND hits <= 2 THEN 12 ELSE 0 END + CASE WHEN list_contains(caps, 'anti_analysis') AND hits <= 2 THEN 10 ELSE 0 END
  + CASE WHEN list_contains(caps, 'dynamic_loading') AND list_contains(roles, 'loader') AND hits <= 3 THEN 10 ELSE 0 END + CASE WHEN n_int >= 20 AND n_ext >= 20 AND hits <= 2 AND len(caps) <= 1 AND len(strings) = 0 THEN 10 ELSE 0 END AS weak FROM sj),
se AS (SELECT *, CAST(least(45, greatest(0, api_score + ss + least(3 * len(caps), 9) + fan - weak)) AS BIGINT) AS score, CASE WHEN incoming = 0 AND n_int + n_ext >= 8 THEN 'initializer' WHEN n_int >= 8 AND n_int + n_ext >= 15 THEN 'dispatcher' WHEN (n_int >= 3 AND n_ext >= 3) OR n_int + n_ext >= 6 THEN 'worker' ELSE 'leaf' END AS structure FROM sp)"""

_CLEAN = "lambda x: trim(coalesce(x, '')) <> ''"


def _reasons(source: str, strings_: str = "strings", hits: str = "hl") -> str:
    """CTEs rz, rs: every function of `source` with its reasons."""
    return f"""rz AS (SELECT *, list_filter([CASE WHEN len({hits}) > 0 THEN 'suspicious API mix: ' || array_to_string({hits}[1:4], ', ') END, CASE WHEN len(caps) > 0 THEN 'local capability evidence: ' || array_to_string(caps[1:3], ', ') END, CASE WHEN len(roles) > 0 THEN 'behavior roles: ' || array_to_string(roles[1:3], ', ') END,
  CASE WHEN len({strings_}) > 0 THEN 'interesting strings: ' || array_to_string(list_filter(list_transform({strings_}[1:2], lambda x: left(x, 40)), {_CLEAN}), ' | ') END, CASE WHEN structure = 'dispatcher' AND n_int >= 8 THEN 'dispatcher-like high fan-out control node' END, CASE WHEN structure = 'initializer' THEN 'possible bootstrap or early execution function' END,
  CASE WHEN n_ext >= 6 THEN 'large external API surface concentrated in one function' END], lambda x: x IS NOT NULL) AS rl FROM {source}),
rs AS (SELECT *, CASE WHEN len(rl) = 0 THEN ['high local score driven by aggregated weak signals'] ELSE rl END AS reasons FROM rz)"""


@query(f"WITH {_STRINGS} SELECT sample_id, name, rank, address, value, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY score DESC, value, address) AS rank FROM fstr) WHERE rank <= 12")
def function_strings(spark, sf):
    w = F.row_number().over(fn.W.partitionBy("sample_id", "name").orderBy(F.desc("score"), "value", "address"))
    return _strings(spark, sf).withColumn("rank", w).where("rank <= 12").select("sample_id", "name", big("rank"), "address", "value", big("score"))


@query(f"WITH {_STRINGS} SELECT sample_id, name, score, array_to_string(roles, ',') AS roles, len(strings) AS strings FROM se")
def function_scores_with_strings(spark, sf):
    return enriched_with_strings(spark, sf).select("sample_id", "name", big("score"), text("roles").alias("roles"), F.size("strings").cast("long").alias("strings"))


@query(f"""WITH {_STRINGS}, d AS (SELECT sample_id, name, 'suspicious_api' AS type, target AS driver, CAST(w AS BIGINT) AS delta FROM cref WHERE w IS NOT NULL UNION ALL SELECT sample_id, name, 'interesting_string', left(value, 80), least(score, 15) FROM fstr WHERE NOT benign_hint
  UNION ALL SELECT sample_id, name, 'local_capabilities', array_to_string(caps, ','), least(3 * len(caps), 9) FROM se WHERE len(caps) > 0 UNION ALL SELECT sample_id, name, 'connectivity', name, fan FROM se WHERE fan > 0 UNION ALL SELECT sample_id, name, 'benign_adjustment', name, -weak FROM se WHERE weak > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY abs(delta) DESC, type, driver) AS rank FROM d) WHERE rank <= 4""")
def score_drivers(spark, sf):
    refs = bind.api_refs(spark, sf).select("sample_id", "name", C.canonical(F.col("api")).alias("target"), C.weight(F.col("api")).alias("w"))
    return stories.score_drivers(refs, _strings(spark, sf), enriched_with_strings(spark, sf)).select("sample_id", "name", "type", "driver", big("delta"), big("rank"))


_TOP = "tf AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, name) AS rank FROM rs WHERE score > 0)"


@query(f"""WITH {_STRINGS}, {_reasons('se')}, {_TOP} SELECT sample_id, name, rank, reasons[1] AS primary_reason, array_to_string(reasons[1:3], '; ') AS reason_summary,
  array_to_string(list_filter([CASE WHEN len(hl) > 0 THEN 'apis=' || array_to_string(hl[1:3], ', ') END, CASE WHEN len(caps) > 0 THEN 'capabilities=' || array_to_string(caps[1:3], ', ') END, CASE WHEN len(strings) > 0 THEN 'strings=' || array_to_string(list_filter(list_transform(strings[1:2], lambda x: left(x, 25)), {_CLEAN}), ' | ') END], lambda x: x IS NOT NULL), '; ') AS driver_summary FROM tf WHERE rank <= 25""")
def function_reasons(spark, sf):
    return stories.function_reasons(fn.top_functions(enriched_with_strings(spark, sf))).select("sample_id", "name", big("rank"), "primary_reason", "reason_summary", "driver_summary")


@query(f"""WITH {_STRINGS}, {_reasons('se')}, {_TOP}, ck AS (SELECT *, list_filter([CASE structure WHEN 'dispatcher' THEN 'follow the highest fan-out internal branches first' END, CASE structure WHEN 'initializer' THEN 'inspect bootstrap/setup logic and first-stage callees' END, CASE WHEN len(hl) > 0 THEN 'validate suspicious API call sites and argument flow' END,
  CASE WHEN len(strings) > 0 THEN 'inspect string xrefs and nearby basic blocks' END, 'confirm the top local score drivers in disassembly and decompiler'], lambda x: x IS NOT NULL) AS c FROM tf WHERE rank <= 8)
SELECT sample_id, name, rank, array_to_string(reasons[1:3], '; ') || '.' AS why, CASE WHEN len(c) = 0 THEN 'inspect core control flow and first-level callees' ELSE array_to_string(c, '; ') END || '.' AS what_to_check FROM ck""")
def analyst_targets(spark, sf):
    top = fn.top_functions(enriched_with_strings(spark, sf))
    return stories.analyst_targets(stories.function_reasons(top)).select("sample_id", "name", big("rank"), "why", "what_to_check")


_HAS = "len(list_intersect(roles, [{}])) = {}"
_NOTE_SQL = ", ".join(f"CASE WHEN {_HAS.format(', '.join(repr(r) for r in wanted), len(wanted))} THEN '{note}' END" for wanted, note in rules.PATH_NOTES)
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _lines() -> str:
    """CTE sl: the storyline, from flows computed with the order of their roles."""
    two, three = _two_hop(30), _THREE.replace(f"{_NODES}, ", "").replace("seed AS", "seed3 AS").replace("FROM seed)", "FROM seed3)").replace("path AS", "path3 AS").replace("FROM path WHERE", "FROM path3 WHERE")
    return f"""{two}, {three},
fl AS (SELECT t.sample_id, 'three_hop_flow' AS type, rank, [a, b, c] AS path, combined, list_concat(list_concat(x.roles, y.roles), z.roles) AS rr, [x.structure, y.structure, z.structure] AS st FROM three t JOIN nodes x ON x.sample_id = t.sample_id AND x.name = a JOIN nodes y ON y.sample_id = t.sample_id AND y.name = b JOIN nodes z ON z.sample_id = t.sample_id AND z.name = c WHERE rank <= 10
  UNION ALL SELECT t.sample_id, 'two_hop_flow', rank, [a, b], combined, list_concat(x.roles, y.roles), [x.structure, y.structure] FROM two t JOIN nodes x ON x.sample_id = t.sample_id AND x.name = a JOIN nodes y ON y.sample_id = t.sample_id AND y.name = b WHERE rank <= 10 AND t.sample_id NOT IN (SELECT sample_id FROM three)),
fo AS (SELECT *, {_FIRST.format('rr')} AS roles FROM fl),
fq AS (SELECT *, list_filter([{_NOTE_SQL}], lambda x: x IS NOT NULL) AS notes FROM fo),
fr AS (SELECT *, CASE WHEN len(notes) > 0 THEN array_to_string(notes[1:2], '; ') WHEN list_contains(st, 'dispatcher') THEN '{rules.PATH_DISPATCHER}' ELSE '{rules.PATH_PLAIN}' END AS narrative FROM fq),
sl AS (SELECT sample_id, type, rank, narrative, array_to_string(path, ' -> ') || ' | score=' || combined || ' | roles: ' || CASE WHEN len(roles) > 0 THEN array_to_string(roles, ', ') ELSE 'no explicit behavioral roles' END || ' | structure: ' || array_to_string(st, ' -> ') || ' | narrative: ' || narrative AS description FROM fr)"""


@query(f"WITH {O.FACTS}, {_lines()} SELECT * FROM sl")
def storyline(spark, sf):
    e = enriched(spark, sf)
    return stories.storyline(graph.two_hop(e), graph.three_hop(e)).select("sample_id", "type", big("rank"), "narrative", "description")


@query(f"""WITH {O.FACTS}, hitl AS (SELECT sample_id, name, list_sort(list(DISTINCT target)) AS hl FROM cref WHERE w IS NOT NULL GROUP BY ALL), eh AS (SELECT e.*, coalesce(hl, []) AS hl, [''][1:0] AS strings FROM enriched e LEFT JOIN hitl USING (sample_id, name)), {_reasons('eh')}, {_lines()},
p AS (SELECT sample_id, 1 AS n, 'Likely execution starts around ' || name || ' (score=' || score || ', fan_out=' || (n_int + n_ext) || ') because it looks like an early-stage control node.' AS line FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, n_int DESC, name) AS r FROM rs WHERE structure = 'initializer') WHERE r = 1
  UNION ALL SELECT sample_id, 2, 'Primary dispatcher candidate is ' || name || ' (' || reasons[1] || ').' FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n_int + n_ext DESC, score DESC, name) AS r FROM rs WHERE structure = 'dispatcher') WHERE r = 1
  UNION ALL SELECT sample_id, 3, 'Most notable worker functions: ' || string_agg(name, ', ' ORDER BY r) || '.' FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, incoming DESC, name) AS r FROM rs WHERE structure = 'worker' AND (score >= 10 OR len(roles) > 0)) WHERE r <= 3 GROUP BY sample_id
  UNION ALL SELECT sample_id, 4, 'Best reconstructed flow: ' || description || '.' FROM sl WHERE rank = 1)
SELECT sample_id, string_agg(line, ' ' ORDER BY n) AS sentences FROM p GROUP BY sample_id""")
def story_summary(spark, sf):
    e = enriched(spark, sf)
    ranked = {k: stories.function_reasons(fn.story_functions(e, k)) for k in ("initializer", "dispatcher", "worker")}
    out = stories.story_summary(ranked["initializer"], ranked["dispatcher"], ranked["worker"], stories.storyline(graph.two_hop(e), graph.three_hop(e)))
    return out.select("sample_id", F.array_join("sentences", " ").alias("sentences"))


_PAIR_SQL = ", ".join(f"CASE WHEN {_HAS.format(', '.join(repr(r) for r in pair), len(pair))} THEN '{b}' END" for pair, b in rules.PAIR_BEHAVIORS)
_CAP_SQL = ", ".join(f"CASE WHEN list_contains(cs, '{c}') THEN '{b}' END" for c, b in rules.CAPABILITY_BEHAVIORS.items())


@query(f"""WITH {O.FACTS}, {_DETECT}, {_THREE}, cs_ AS (SELECT sample_id, list(name) AS cs FROM det GROUP BY ALL), rl_ AS (SELECT sample_id, list_distinct(flatten(list(roles))) AS roles FROM enriched GROUP BY ALL), th_ AS (SELECT DISTINCT sample_id FROM three),
b AS (SELECT r.sample_id, roles, coalesce(cs, []) AS cs, t.sample_id IS NOT NULL AS deep FROM rl_ r LEFT JOIN cs_ USING (sample_id) LEFT JOIN th_ t ON t.sample_id = r.sample_id)
SELECT sample_id, array_to_string(list_filter([{_CAP_SQL}, {_PAIR_SQL}, CASE WHEN deep THEN '{rules.FLOW_BEHAVIOR}' END], lambda x: x IS NOT NULL), ',') AS behaviors FROM b""")
def inferred_behaviors(spark, sf):
    e = enriched(spark, sf)
    return stories.inferred_behaviors(e.select("sample_id").distinct(), apis.detect_capabilities(bind.symbols(spark, sf)), e, graph.three_hop(e)).select("sample_id", text("behaviors").alias("behaviors"))


_SWEEP = f"""k AS (SELECT c_custkey AS k FROM customer),
pf AS (SELECT k AS sample_id, k % 3 AS sus, ['.text', 'UPX1', 'CODE'][k % 3 + 1] AS es, k % 5 < 2 AND k % 2 = 0 AS rwx, k % 61 AS syms, k % 3 = 1 AND k % 7 < 3 AS resolves, k % 4 = 1 AS odd, k % 11 % 3 AS hi, k % 11 % 3 % 2 AS hx, [NULL, 6.0, 7.19, 7.2, 7.9][k % 5 + 1] AS ee, [0, 0, 20, 55][k % 4 + 1] AS pat, [NULL, 10, 34, 35, 60, 20, 0][k % 7 + 1] AS oep, k % 5 = 1 AS popad, k % 3 = 2 AS late,
  ['unknown', 'generic runtime unpacking', 'UPX-like', 'packed/loader stub section'][k % 4 + 1] AS fam, k % 13 AS ui, k % 17 % 2 AS risky, k % 19 % 2 AS rh, k % 23 % 3 AS oh, k % 29 % 2 AS chx FROM k),
ps AS (SELECT *, list_filter([CASE WHEN sus > 0 THEN 'suspicious_sections' END, CASE WHEN list_contains({O.lst(rules.SUSPICIOUS_SECTIONS)}, es) THEN 'entrypoint_in_suspicious_section' END, CASE WHEN rwx THEN 'entrypoint_in_rwx_section' END, CASE WHEN syms < 20 THEN 'very_small_import_surface' WHEN syms < 40 THEN 'small_import_surface' END, CASE WHEN resolves THEN 'runtime_unpacking_apis' END,
  CASE WHEN odd THEN 'nonstandard_executable_sections' END, CASE WHEN hi > 0 THEN 'high_entropy_sections' END, CASE WHEN hx > 0 THEN 'high_entropy_executable_sections' END, CASE WHEN ee >= 7.2 THEN 'high_entropy_entrypoint_section' END, CASE WHEN hi > 0 AND syms < 40 THEN 'high_entropy_plus_small_import_surface' END], lambda x: x IS NOT NULL) AS ind FROM pf),
p1 AS (SELECT *, CAST(coalesce(list_sum(list_transform(ind, lambda x: CASE x {' '.join(f"WHEN '{n}' THEN {p}" for n, p in rules.PACKER_INDICATORS.items())} END)), 0) AS BIGINT) AS base FROM ps),
p2 AS (SELECT *, list_filter([CASE WHEN oep >= 35 THEN 'strong_oep_candidate' END, CASE WHEN oep IS NOT NULL AND popad THEN 'popad_backed_oep_transition' END, CASE WHEN oep IS NOT NULL AND late THEN 'late_stub_handoff' END], lambda x: x IS NOT NULL) AS more, base + pat + CASE WHEN oep >= 35 THEN 15 ELSE 0 END + CASE WHEN oep IS NOT NULL AND popad THEN 10 ELSE 0 END + CASE WHEN oep IS NOT NULL AND late THEN 8 ELSE 0 END AS total FROM p1),
p3 AS (SELECT *, CASE WHEN total < 45 AND fam = 'unknown' THEN 'none' ELSE fam END AS fam2 FROM p2),
p4 AS (SELECT *, greatest(0, total - CASE WHEN rh > 0 AND oh = 0 THEN 10 ELSE 0 END - CASE WHEN ui >= 10 AND es = '.text' AND chx = 0 THEN 8 ELSE 0 END) AS final, CASE WHEN ui >= 8 AND risky = 0 AND fam2 = 'generic runtime unpacking' THEN 'none' ELSE fam2 END AS fam3 FROM p3)"""


@query(f"WITH {_SWEEP} SELECT sample_id, base AS packer, array_to_string(ind, ',') AS indicators, base >= 45 AS packed, CASE WHEN base >= 75 THEN 'high' WHEN base >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM p1")
def packer_score(spark, sf):
    return packing.packer_score(bind.packer_sweep(spark, sf)).select("sample_id", big("packer"), text("indicators").alias("indicators"), "packed", F.col("packer_confidence").alias("confidence"))


@query(f"WITH {_SWEEP} SELECT sample_id, CAST(total AS BIGINT) AS packer, array_to_string(list_concat(ind, more), ',') AS indicators, total >= 45 AS packed, CASE WHEN total >= 75 THEN 'high' WHEN total >= 40 THEN 'medium' ELSE 'low' END AS confidence, fam2 AS family FROM p3")
def packer_enrichment(spark, sf):
    return packing.packer_enrichment(packing.packer_score(bind.packer_sweep(spark, sf))).select("sample_id", big("packer"), text("indicators").alias("indicators"), "packed", F.col("packer_confidence").alias("confidence"), "family")


@query(f"""WITH {_SWEEP} SELECT sample_id, CAST(final AS BIGINT) AS packer, final >= 45 AS packed, CASE WHEN final >= 55 THEN 'high' WHEN final >= 30 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN final < 45 AND fam3 IN ('unknown', 'generic runtime unpacking', '') THEN 'none' ELSE fam3 END AS family,
  CASE WHEN final >= 45 THEN 'packer-like indicators detected' ELSE 'executable does not appear packed' END AS status FROM p4""")
def benign_packer(spark, sf):
    rows = packing.benign_packer(packing.packer_enrichment(packing.packer_score(bind.packer_sweep(spark, sf))))
    return rows.select("sample_id", big("packer"), "packed", F.col("packer_confidence").alias("confidence"), "family", "status")


@query(f"""WITH {O.FACTS}, {O.SECTION_FACTS}, s AS (SELECT sec.*, CASE WHEN doc_id % 9 = 0 THEN 7.7 WHEN doc_id % 9 = 1 THEN 7.3 ELSE entropy END AS e, list_contains({O.lst(rules.SUSPICIOUS_SECTIONS)}, name) AS bad, NOT list_contains({O.lst(rules.COMMON_SECTIONS)}, lower(name)) AS odd FROM sec LEFT JOIN ent USING (doc_id)),
t AS (SELECT *, coalesce(e >= 7.2, false) AS high, bad OR (x AND w) OR (NOT init AND x) OR (coalesce(e >= 7.6, false) AND (x OR odd)) OR (coalesce(e >= 7.2 AND e < 7.6, false) AND x) OR (odd AND x AND size < 1024) AS sus, coalesce(e >= 7.2 AND e < 7.6, false) AS marked, lower(name) IN ('.rsrc', 'rsrc', 'resource') AS res FROM s),
en AS (SELECT DISTINCT user_id AS sample_id, CASE WHEN user_id % 2 = 0 THEN '.text' ELSE 'UPX1' END AS entry_section FROM events),
ag AS (SELECT en.sample_id, entry_section, count(*) FILTER (sus) AS suspicious, count(*) FILTER (x AND lower(name) NOT IN ('.text', 'text', '.code', 'code')) AS odd_execute, count(*) FILTER (high) AS high, count(*) FILTER (high AND x) AS high_execute, count(*) FILTER (marked AND res) AS resource_high, count(*) FILTER (marked AND NOT res) AS other_high, count(*) FILTER (marked AND x) AS class_high_execute FROM en LEFT JOIN t USING (sample_id) GROUP BY ALL),
ow AS (SELECT en.sample_id, arg_min(w, ord) AS entry_write, arg_min(x, ord) AS entry_execute, arg_min(CASE WHEN e IS NULL THEN -1 ELSE e END, ord) AS e0 FROM en JOIN t ON t.sample_id = en.sample_id AND t.name = entry_section GROUP BY ALL),
sy AS (SELECT sample_id, count(*) AS symbols, bool_or({O.canon('symbol')} IN ('GetProcAddress', 'LoadLibrary')) AS resolver, bool_or(symbol IN ('VirtualAlloc', 'VirtualAllocEx', 'VirtualProtect', 'VirtualProtectEx')) AS memory FROM symbols GROUP BY ALL)
SELECT ag.*, coalesce(symbols, 0) AS symbols, coalesce(resolver, false) AS resolver, coalesce(memory, false) AS memory, CAST(nullif(e0, -1) AS DOUBLE) AS entry_entropy, coalesce(entry_write, false) AS entry_write, coalesce(entry_execute, false) AS entry_execute FROM ag LEFT JOIN ow ON ow.sample_id = ag.sample_id LEFT JOIN sy ON sy.sample_id = ag.sample_id""")
def packer_features(spark, sf):
    s = bind.sections(spark, sf)
    k = F.col("doc_id") % 9
    rows = s.drop("content").join(packing.byte_entropy(s, ["doc_id"]), "doc_id", "left").withColumn("entropy", F.when(k == 0, 7.7).when(k == 1, 7.3).otherwise(F.col("entropy")))
    entry = bind.transfers(spark, sf).select("sample_id", "entry_section").distinct()
    out = packing.packer_features(packing.section_suspicion(rows), entry, bind.symbols(spark, sf))
    return out.select("sample_id", "entry_section", *[big(c) for c in ("suspicious", "odd_execute", "high", "high_execute", "resource_high", "other_high", "class_high_execute", "symbols")], "resolver", "memory", "entry_entropy", "entry_write", "entry_execute")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s.rule}', 'internal_fallback', 'file_not_found', CAST({len(s.built_in())} AS BIGINT))" for s in rule_files.SOURCES) + ") t(rule, source, reason, n)")
def rule_provenance(spark, sf):
    return rule_files.provenance(spark, rule_files.load(f"{sf}/rules")).select("rule", "source", "reason", "n")


@query(f"WITH {O.FEATURES} SELECT sample_id, CAST(calibrated AS BIGINT) AS calibrated, array_to_string(derived, ',') AS derived FROM lev")
def file_rules(spark, sf):
    """Calibration and derived capabilities by the rules of a folder (here one without files: the built-in rules)."""
    loaded = rule_files.load(f"{sf}/rules").rules
    rows = scoring.derived_capabilities(scoring.calibrate(bind.features(spark, sf), loaded["rust_score_rules"]), loaded["rust_derived_rules"])
    return rows.select("sample_id", big("calibrated"), text("derived").alias("derived"))
