"""Rules from JSON files in a folder: each file is checked, and the built-in rules stand in for one that fails.

The folder is read once on the driver (rules are small); operators take the loaded rules as parameters and compile them
to Columns. Every file's provenance is a row: where its rules come from, why, and how many hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules

PROVENANCE = "rule string, source string, reason string, error string, n long"


def _is(value: Any, kind: type) -> bool:
    """Exact kinds: a boolean is no number here."""
    return isinstance(value, kind) and not (kind is int and isinstance(value, bool))


def _texts(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def _table(data: Any, fields: dict[str, Callable[[Any], bool]]) -> str | None:
    """What is wrong with an object of objects that must have these fields, or None."""
    if not isinstance(data, dict):
        return "not an object"
    for name, rule in data.items():
        bad = [f for f, good in fields.items() if not isinstance(rule, dict) or f not in rule or not good(rule[f])]
        if bad:
            return f"{name}: {', '.join(bad)}"
    return None


def _weights(data: Any) -> str | None:
    if not isinstance(data, dict):
        return "not an object"
    bad = [k for k, v in data.items() if not _is(v, int)]
    return f"{bad[0]}: weight" if bad else None


def _listed(name: str) -> Callable[[Any], str | None]:
    """A list of rules with this text field; an empty list counts as a fault, so that the built-in rules apply."""

    def check(data: Any) -> str | None:
        if not isinstance(data, list) or not all(isinstance(r, dict) and isinstance(r.get(name), str) for r in data):
            return f"not a list of rules with {name}"
        if name == "id" and not all(_is(r.get("delta"), int) for r in data):
            return "delta"
        return None if data else "empty"

    return check


@dataclass(frozen=True)
class Source:
    rule: str
    check: Callable[[Any], str | None]
    built_in: Callable[[], Any]

    @property
    def filename(self) -> str:
        return f"{self.rule}.json"


SOURCES = [
    Source("api_weights", _weights, lambda: dict(rules.API_WEIGHTS)),
    Source("capability_rules", lambda d: _table(d, {"apis": _texts, "min_matches": lambda x: _is(x, int), "score": lambda x: _is(x, int)}), lambda: {n: {"apis": a, "min_matches": m, "score": s} for n, (a, m, s) in rules.CAPABILITIES.items()}),
    Source("string_patterns", lambda d: _table(d, {"keywords": _texts, "score": lambda x: _is(x, int), "tag": lambda x: isinstance(x, str)}), lambda: {n: {"keywords": k, "score": s, "tag": t} for n, (k, s, t) in rules.STRING_PATTERNS.items()}),
    Source("rust_score_rules", _listed("id"), lambda: [{"id": n, "condition": n, "delta": d} for n, d in rules.SCORE_RULES.items()]),
    Source("rust_derived_rules", _listed("name"), lambda: list(rules.DERIVED_RULES)),
]


@dataclass(frozen=True)
class RuleSet:
    """Loaded rules by name and their provenance rows."""

    folder: str
    rules: dict[str, Any]
    provenance: list[tuple[str, str, str | None, str | None, int]]

    def using_defaults(self) -> bool:
        """Whether the score rules or the derived rules are the built-in ones."""
        return any(source != "external" for rule, source, *_ in self.provenance if rule.startswith("rust_"))


def folder_of(stored: str | None, default: str) -> str:
    """The folder that a report names, else the default one."""
    return stored if stored and stored.strip() else default


def load(folder: str) -> RuleSet:
    """Rules of a folder; a file that is missing, unreadable or invalid is replaced by the built-in rules and says so."""
    found, rows = {}, []
    for s in SOURCES:
        path, error, reason = Path(folder) / s.filename, None, None
        try:
            data = json.loads(path.read_text(encoding="utf-8"))
            error = s.check(data)
        except FileNotFoundError:
            reason = "file_not_found"
        except (OSError, ValueError) as e:
            error = str(e)
        reason = "load_error" if error else reason
        found[s.rule] = s.built_in() if reason else data
        rows.append((s.rule, "internal_fallback" if reason else "external", reason, error, len(found[s.rule])))
    return RuleSet(folder, found, rows)


def provenance(spark: SparkSession, loaded: RuleSet) -> DataFrame:
    return spark.createDataFrame(loaded.provenance, PROVENANCE)
