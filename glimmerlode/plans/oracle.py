"""DuckDB SQL of the triage queries, from the same rule data but in its own words."""

from __future__ import annotations

from ..functions import rules
from ..sources import bind


def lst(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def case(pairs, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + " END"


def canon(c: str) -> str:
    return f"CASE WHEN right({c}, 1) IN ('A', 'W') AND list_contains({lst(rules.TWO_FORMS)}, left({c}, length({c}) - 1)) THEN left({c}, length({c}) - 1) ELSE {c} END"


def weight(c: str) -> str:
    return f"coalesce({case(rules.API_WEIGHTS.items(), c)}, {case(rules.API_WEIGHTS.items(), '(' + canon(c) + ')')})"


CAP_ROWS = ", ".join(f"('{n}', '{a}', {m}, {s})" for n, (_, m, s) in rules.CAPABILITIES.items() for a in rules.canonical_apis(n))
ROLE_ROWS = ", ".join(f"('{r}', '{a}')" for r, apis in rules.ROLE_APIS.items() for a in apis)

FACTS = f"""
fn AS (SELECT o_custkey AS sample_id, o_orderkey AS fn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
fns AS (SELECT *, 'f' || ord AS name FROM fn),
refs AS (SELECT f.sample_id, f.name, {lst(bind.APIS)}[l_partkey % {len(bind.APIS)} + 1] AS api FROM lineitem JOIN fns f ON f.fn = l_orderkey WHERE l_returnflag <> 'N'),
calls AS (SELECT DISTINCT f.sample_id, f.name AS caller, 'f' || ((f.ord + l_suppkey) % f.n) AS callee FROM lineitem JOIN fns f ON f.fn = l_orderkey WHERE l_returnflag = 'N' AND f.ord <> (f.ord + l_suppkey) % f.n),
symbols AS (SELECT DISTINCT sample_id, api AS symbol FROM refs),
caprule(capability, api, least, base) AS (VALUES {CAP_ROWS}),
rolerule(role, api) AS (VALUES {ROLE_ROWS}),
cref AS (SELECT sample_id, name, {canon('api')} AS target, {weight('api')} AS w FROM refs),
capof AS (SELECT DISTINCT sample_id, name, capability FROM cref JOIN caprule ON api = target),
caps AS (SELECT sample_id, name, list_sort(list(capability)) AS caps FROM capof GROUP BY ALL),
ext AS (SELECT sample_id, name, sum(coalesce(w, 0)) AS api_score, count(DISTINCT target) AS n_ext, count(DISTINCT CASE WHEN w IS NOT NULL THEN target END) AS hits, list_sort(list(DISTINCT target)) AS external FROM cref GROUP BY ALL),
outc AS (SELECT sample_id, caller AS name, list_sort(list(callee)) AS internal FROM calls GROUP BY ALL),
inc AS (SELECT sample_id, callee AS name, count(*) AS incoming FROM calls GROUP BY ALL),
roles0 AS (SELECT DISTINCT sample_id, name, role FROM cref JOIN rolerule ON api = target
  UNION SELECT sample_id, name, CASE capability WHEN 'networking' THEN 'network' ELSE capability END FROM capof WHERE capability IN ('networking', 'persistence', 'anti_analysis', 'crypto')),
roles AS (SELECT sample_id, name, list_sort(list(role)) AS roles FROM roles0 GROUP BY ALL),
joined AS (SELECT f.sample_id, f.name, coalesce(e.api_score, 0) AS api_score, coalesce(e.n_ext, 0) AS n_ext, coalesce(e.hits, 0) AS hits, coalesce(e.external, []) AS external, coalesce(c.caps, []) AS caps, coalesce(o.internal, []) AS internal, coalesce(i.incoming, 0) AS incoming, coalesce(r.roles, []) AS roles
  FROM fns f LEFT JOIN ext e USING (sample_id, name) LEFT JOIN caps c USING (sample_id, name) LEFT JOIN outc o USING (sample_id, name) LEFT JOIN inc i USING (sample_id, name) LEFT JOIN roles r USING (sample_id, name)),
scored AS (SELECT *, len(internal) AS n_int, CAST(least(45, greatest(0, api_score + least(3 * len(caps), 9)
   + CASE WHEN len(internal) >= 15 THEN 2 ELSE 0 END + CASE WHEN n_ext >= 30 THEN 2 ELSE 0 END
   - CASE WHEN list_contains(caps, 'persistence') AND hits <= 2 THEN 12 ELSE 0 END - CASE WHEN list_contains(caps, 'anti_analysis') AND hits <= 2 THEN 10 ELSE 0 END
   - CASE WHEN list_contains(caps, 'dynamic_loading') AND list_contains(roles, 'loader') AND hits <= 3 THEN 10 ELSE 0 END
   - CASE WHEN len(internal) >= 20 AND n_ext >= 20 AND hits <= 2 AND len(caps) <= 1 THEN 10 ELSE 0 END)) AS INTEGER) AS score FROM joined),
enriched AS (SELECT *, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 35 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS risk,
   CASE WHEN incoming = 0 AND n_int + n_ext >= 8 THEN 'initializer' WHEN n_int >= 8 AND n_int + n_ext >= 15 THEN 'dispatcher' WHEN n_int >= 3 AND n_ext >= 3 THEN 'worker' WHEN n_int + n_ext >= 6 THEN 'worker' ELSE 'leaf' END AS structure FROM scored)"""


def facts(sql: str) -> str:
    return f"WITH {FACTS}\n{sql}"


STRING_FACTS = f"""
raw AS (SELECT 'pages' AS sample_id, 'p' || page_id AS address, url AS value FROM pages UNION ALL SELECT source, 'd' || doc_id, text FROM documents
  UNION ALL SELECT 'examples', 'x' || (i - 1), {lst(bind.EXAMPLES)}[i] FROM range(1, {len(bind.EXAMPLES) + 1}) t(i)),
trimmed AS (SELECT sample_id, address, trim(coalesce(value, ''), ' ') AS v FROM raw),
cleaned AS (SELECT sample_id, address, trim(CASE WHEN length(v) >= 3 AND v LIKE 'u"%"' THEN v[3:-2] WHEN length(v) >= 2 AND v LIKE '"%"' THEN v[2:-2] ELSE v END, ' ') AS v FROM trimmed),
kept AS (SELECT *, lower(v) AS low FROM cleaned WHERE length(v) >= 5 AND NOT (lower(v) LIKE '%.dll' AND NOT contains(v, '/') AND NOT contains(v, chr(92)))),
hit AS (SELECT *, {', '.join(f"len(list_filter({lst(k)}, lambda k: contains(low, k))) AS k_{n}" for n, (k, _, _) in rules.STRING_PATTERNS.items())},
  len(list_filter({lst(rules.STRONG_NETWORK_MARKS)}, lambda k: contains(low, k))) > 0 AS strong,
  CAST(len(list_filter({lst(rules.VENDOR_KEYWORDS)}, lambda k: contains(low, k))) > 0 AS INTEGER) + CAST(starts_with(low, 'prop:system.') AS INTEGER) + CAST(contains(low, 'windows.security.') AS INTEGER) + CAST(contains(low, 'microsoft.') AS INTEGER) AS vendor FROM kept),
strings_scored AS (SELECT sample_id, address, v AS value, vendor > 0 AS benign_hint,
  CASE WHEN k_url_or_network = 0 THEN 0 WHEN strong THEN 15 ELSE 7 END + CASE k_filesystem_path WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 10 END + CASE WHEN k_registry > 0 THEN 20 ELSE 0 END + CASE WHEN k_crypto_ransom > 0 THEN 12 ELSE 0 END + CASE WHEN k_commands > 0 THEN 20 ELSE 0 END + CASE WHEN k_anti_analysis > 0 THEN 20 ELSE 0 END - least(18, 8 * vendor) AS score,
  list_sort(list_filter([{', '.join(f"CASE WHEN k_{n} > 0 THEN '{t}' END" for n, (_, _, t) in rules.STRING_PATTERNS.items())}], lambda x: x IS NOT NULL)) AS tags FROM hit)"""

SECTION_FACTS = f"""
sec AS (SELECT doc_id // 3 AS sample_id, CAST(doc_id % 3 AS INTEGER) AS ord, {lst(bind.SECTIONS)}[doc_id % {len(bind.SECTIONS)} + 1] AS name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, doc_id % 5 = 0 AS w, doc_id % 2 = 0 AS x, doc_id % 7 <> 0 AS init, doc_id, hex(encode(coalesce(text, '')))[1:131072] AS h FROM documents),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b FROM sec),
bcount AS (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY ALL),
ent AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS sampled, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 4) AS entropy FROM bcount GROUP BY doc_id)"""

EVENT_FACTS = f"""
ins AS (SELECT user_id AS sample_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, {lst(bind.MNEMONICS)}[event_id % {len(bind.MNEMONICS)} + 1] AS m FROM events),
prev AS (SELECT *, array_to_string(list(m) OVER (PARTITION BY sample_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ',') AS previous FROM ins)"""

FEATURES = """
feat AS (SELECT c_custkey AS sample_id, (c_custkey * 37) % 160 AS score, c_custkey % 3 = 0 AS packed, (c_custkey * 13) % 110 AS packer_score, c_custkey % 5 AS high_risk, (c_custkey * 7) % 50 AS max_top, c_custkey % 4 AS strong_strings, c_custkey % 6 AS reasoned, c_custkey % 9 AS apis, c_custkey % 4 AS contexts, (c_custkey * 11) % 60 AS negative,
  c_custkey % 2 = 0 AS inj, c_custkey % 3 = 1 AS net, c_custkey % 7 = 0 AS cry, c_custkey % 4 = 1 AS per, c_custkey % 5 = 2 AS anti_x, c_custkey % 6 < 3 AS ldr, c_custkey % 8 < 3 AS inj_high, (c_custkey % 11) % 4 AS local_api, c_custkey % 10 < 3 AS net_high, c_custkey % 9 < 2 AS cry_high, (c_custkey * 17) % 90 AS summary_packer, ['', 'UPX-like', 'Unknown', ' none ', 'N/A', 'ASPack-like', 'null'][c_custkey % 7 + 1] AS family, CASE WHEN c_custkey % 2 = 0 THEN 'UPX' ELSE '' END AS summary_family, c_custkey % 5 = 1 AS noted, [[], ['.text'], ['.rsrc', '.text'], ['.RSRC ', 'rsrc']][c_custkey % 4 + 1] AS high_names, c_custkey % 10 AS sus, c_custkey % 3 AS he, CAST(c_custkey % 5 = 4 AS INTEGER) AS ex, 5.5 + (c_custkey % 25) / 10.0 AS ep, (c_custkey * 3) % 50 AS oep, c_custkey % 13 <> 0 AS valid FROM customer),
cond AS (SELECT *, inj OR net OR cry AS impact, per OR anti_x OR ldr AS softs, CAST(inj AS INT) + CAST(net AS INT) + CAST(cry AS INT) + CAST(per AS INT) + CAST(anti_x AS INT) + CAST(ldr AS INT) AS n_caps FROM feat),
fire AS (SELECT *, [CASE WHEN high_risk >= 2 THEN 'multiple_high_risk_top_functions' END, CASE WHEN packed THEN 'packed_sample_static_visibility_penalty' END, CASE WHEN inj THEN 'process_injection_capability' END, CASE WHEN strong_strings >= 1 THEN 'high_signal_interesting_strings' END, CASE WHEN reasoned >= 1 THEN 'top_function_reasoned_evidence' END,
  CASE WHEN packed AND apis <= 4 AND n_caps <= 1 AND max_top < 35 THEN 'strong_packing_with_weak_visible_behavior' END, CASE WHEN contexts >= 2 AND negative >= 20 THEN 'benign_context_heavy_discount' END, CASE WHEN softs AND NOT impact THEN 'soft_capability_only_discount' END] AS f FROM cond),
cal AS (SELECT *, greatest(0, score + list_sum(list_transform(f, lambda x: CASE x WHEN 'multiple_high_risk_top_functions' THEN 10 WHEN 'packed_sample_static_visibility_penalty' THEN -10 WHEN 'process_injection_capability' THEN 15 WHEN 'high_signal_interesting_strings' THEN 5 WHEN 'top_function_reasoned_evidence' THEN 6 WHEN 'strong_packing_with_weak_visible_behavior' THEN -6 WHEN 'benign_context_heavy_discount' THEN -10 WHEN 'soft_capability_only_discount' THEN -8 ELSE 0 END))) AS calibrated FROM fire),
mal AS (SELECT *, CASE WHEN calibrated >= 120 THEN 'critical' WHEN calibrated >= 85 THEN 'high' WHEN calibrated >= 30 THEN 'medium' ELSE 'low' END AS band, greatest(0, calibrated + CASE WHEN inj THEN 18 ELSE 0 END + CASE WHEN net AND (per OR cry) THEN 8 WHEN net THEN 4 ELSE 0 END + CASE WHEN ldr AND inj THEN 8 ELSE 0 END + CASE WHEN anti_x AND (inj OR ldr OR net OR cry) THEN 6 ELSE 0 END + CASE WHEN high_risk >= 3 THEN 10 ELSE 0 END + CASE WHEN local_api >= 2 THEN 6 ELSE 0 END
  - CASE WHEN softs AND NOT impact THEN 15 ELSE 0 END - CASE WHEN contexts >= 2 THEN 12 ELSE 0 END - CASE WHEN negative >= 20 THEN 10 ELSE 0 END - CASE WHEN NOT impact AND high_risk = 0 THEN 8 ELSE 0 END - CASE WHEN packed AND NOT inj AND local_api = 0 THEN 10 WHEN packed THEN 5 ELSE 0 END) AS malware FROM cal),
pac AS (SELECT *, greatest(0, greatest(packer_score, summary_packer) + CASE WHEN lower(CASE WHEN trim(family) <> '' THEN trim(family) ELSE trim(summary_family) END) IN ('', 'none', 'unknown', 'n/a', 'na', 'null') THEN 0 ELSE 10 END + CASE WHEN noted THEN 4 ELSE 0 END - CASE WHEN len(high_names) > 0 AND ex = 0 AND len(list_filter(high_names, lambda n: lower(trim(n)) NOT IN ('.rsrc', 'rsrc'))) = 0 THEN 10 ELSE 0 END + CASE WHEN packed THEN 20 ELSE 0 END + least(4 * sus, 12) + least(4 * he, 12) + least(6 * ex, 18) + CASE WHEN ep >= 7.6 THEN 10 WHEN ep >= 7.2 THEN 6 ELSE 0 END + CASE WHEN oep >= 35 THEN 12 WHEN oep >= 20 THEN 6 ELSE 0 END + CASE WHEN packed AND apis <= 3 THEN 10 ELSE 0 END + CASE WHEN packed AND n_caps = 0 THEN 10 ELSE 0 END - CASE WHEN ex = 0 AND NOT packed THEN 6 ELSE 0 END) AS packing,
  list_filter([CASE WHEN inj AND ldr AND inj_high AND high_risk >= 1 THEN 'in_memory_loader' END, CASE WHEN net AND per AND high_risk >= 1 THEN 'persistent_networked_payload' END, CASE WHEN anti_x AND inj AND inj_high THEN 'evasion_aware_injector' END, CASE WHEN ldr AND packed AND ex >= 1 THEN 'packed_loader_stub' END, CASE WHEN inj AND ldr AND inj_high AND max_top >= 30 THEN 'staged_injector' END], lambda x: x IS NOT NULL) AS derived FROM mal),
lev AS (SELECT *, CASE WHEN malware >= 120 THEN 'critical' WHEN malware >= 85 THEN 'high' WHEN malware >= 30 THEN 'medium' ELSE 'low' END AS ml, CASE WHEN packing >= 120 THEN 'critical' WHEN packing >= 85 THEN 'high' WHEN packing >= 30 THEN 'medium' ELSE 'low' END AS pl, contexts >= 2 AND NOT impact AND malware < 65 AS calm FROM pac)"""
