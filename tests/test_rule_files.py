"""Rule files: external, invalid, empty and missing ones, and what they change."""

import json

import pytest

from glimmerlode.operators import scoring
from glimmerlode.plans import catalog
from glimmerlode.sources import bind, rule_files

SF = "/root/testdata/sf0.001"


def write(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.json").write_text(data if isinstance(data, str) else json.dumps(data))
    return rule_files.load(str(folder))


def by_rule(loaded):
    return {rule: (source, reason) for rule, source, reason, _, _ in loaded.provenance}


def test_external_files_win(tmp_path):
    loaded = write(tmp_path, api_weights={"X": 3}, capability_rules={"c": {"apis": ["X"], "min_matches": 1, "score": 2}}, string_patterns={"p": {"keywords": ["k"], "score": 1, "tag": "t"}}, rust_score_rules=[{"id": "a", "condition": "process_injection_capability", "delta": 4}], rust_derived_rules=[{"name": "d", "requires_all": ["crypto"]}])
    assert set(by_rule(loaded).values()) == {("external", None)} and not loaded.using_defaults()
    assert loaded.rules["api_weights"] == {"X": 3}


@pytest.mark.parametrize("name, bad", [("api_weights", {"X": "3"}), ("api_weights", {"X": True}), ("api_weights", []), ("capability_rules", {"c": {"apis": "X", "min_matches": 1, "score": 2}}), ("capability_rules", {"c": {"apis": ["X"], "score": 2}}), ("string_patterns", {"p": {"keywords": ["k"], "score": 1, "tag": 2}}), ("rust_score_rules", []), ("rust_score_rules", [{"id": "a"}]), ("rust_derived_rules", []), ("rust_derived_rules", "{")])
def test_bad_file_falls_back(tmp_path, name, bad):
    loaded = write(tmp_path, **{name: bad})
    built_in = next(s.built_in() for s in rule_files.SOURCES if s.rule == name)
    assert by_rule(loaded)[name] == ("internal_fallback", "load_error") and loaded.rules[name] == built_in
    assert loaded.using_defaults()


def test_missing_files_fall_back(tmp_path):
    assert set(by_rule(write(tmp_path)).values()) == {("internal_fallback", "file_not_found")}


def test_file_rules_decide(spark, tmp_path):
    loaded = write(tmp_path, rust_score_rules=[{"id": "a", "condition": "process_injection_capability", "delta": 4}, {"id": "never", "delta": 9}], rust_derived_rules=[{"name": "d", "requires_all": ["crypto"], "forbids": ["networking"]}, {"name": "never"}]).rules
    rows = scoring.derived_capabilities(scoring.calibrate(bind.features(spark, SF), loaded["rust_score_rules"]), loaded["rust_derived_rules"]).collect()
    assert rows and all(r.calibrated == r.score + 4 * r.injection and r.fired == ["a"] * r.injection and r.derived == ["d"] * (r.crypto and not r.networking) for r in rows)


def test_folder_of():
    assert rule_files.folder_of(" ", "x") == "x" and rule_files.folder_of("y", "x") == "y"


def test_story_queries_are_registered():
    assert {"storyline", "packer_score", "function_reasons", "rule_provenance"} <= set(catalog.QUERIES)
