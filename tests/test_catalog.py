"""Every registered triage query against its SQL, on the smallest tables."""

import duckdb
import pytest

from glimmerlode.functions import columns as C, rules
from glimmerlode.operators import advice, scoring, strings, views
from glimmerlode.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer orders lineitem events documents pages".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(catalog.ORACLES[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in cols], strict=True)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("score", "band"), [(29, "low"), (30, "medium"), (84, "medium"), (85, "high"), (119, "high"), (120, "critical")])
def test_bands(spark, score, band):
    assert spark.range(1).select(C.report_band(F.lit(score))).first()[0] == band


def test_rule_without_predicate_never_fires(spark):
    assert scoring.compile_rule({"id": "x", "delta": 3}) is None


def test_canonical_names():
    assert rules.canonical_name("CreateFileW") == "CreateFile" and rules.canonical_name("SetWindowsHookExW") == "SetWindowsHookExW"


@pytest.mark.parametrize(("text", "want"), [('x {"a": "}"} y', '{"a": "}"}'), ("{bad {\"a\": 1}", '{"a": 1}'), ("none", None)])
def test_first_object(text, want):
    assert advice.first_object(text) == want


def test_guard(spark):
    rows = spark.createDataFrame([("suspicious", "medium", "", "low", "high", "low", "packed"), ("suspicious", "high", "go", "high", "high", "low", "packed")], "verdict string, priority string, next_step string, malware_level string, packing_level string, risk_level string, warning string")
    assert [r.verdict for r in advice.guard(rows).collect()] == ["packed-needs-unpacking", "suspicious"]


def test_string_rules_of_benign_contexts(spark):
    names = ["LoadLibraryW", "GetProcAddress"]
    symbols = spark.createDataFrame([(k, n) for k in range(4) for n in names[: 1 if k == 3 else 2]], "sample_id long, symbol string")
    functions = spark.createDataFrame([(k, 40, ["network"]) for k in range(4)] + [(2, 40, ["network"])] * 2, "sample_id long, score int, roles array<string>")
    said = [(0, "http://www.Microsoft.com/help cookie: powershell cmd.exe"), (0, "https://go.microsoft.com/x cookie: powershell cmd.exe"), (1, "https://go.microsoft.com/x cookie: powershell cmd.exe"), (2, "http://www.microsoft.com/a cookie: powershell cmd.exe"), (2, "http://www.microsoft.com/b cookie: powershell cmd.exe"), (3, "powershell cmd.exe")]
    found = strings.top_strings(strings.score_strings(spark.createDataFrame([(k, f"a{i}", v) for i, (k, v) in enumerate(said)], "sample_id long, address string, value string")))
    got = {r.sample_id: (r.contexts, r.adjustment) for r in scoring.benign_contexts(views.context_features(symbols, functions, found)).collect()}
    loading, said_twice = "benign_dynamic_loading_context", "benign_string_context"
    assert got == {0: ([loading, said_twice], -30), 1: ([loading], -20), 2: ([loading], -20), 3: ([], 0)}
