"""The policy document: a source, its fields and rule sets. Read from dicts or JSON; unknown keys are ignored."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

KINDS = ("identity", "nullify", "fixed", "regexp", "hash", "sql_statement", "detokenize", "numeric_rounding", "aggregation")


class PolicyError(ValueError):
    """The policy cannot be applied; raised before any row is read."""


def _snake(x: Any) -> Any:
    """Keys in snake_case, at any depth."""
    if isinstance(x, dict):
        return {re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), k): _snake(v) for k, v in x.items()}
    return [_snake(v) for v in x] if isinstance(x, list) else x


def _name(field: Any) -> str:
    return field if isinstance(field, str) else ".".join(field["name_parts"])


def principals_of(entry: dict) -> tuple[str, ...]:
    """Groups by name; roles and permissions as ``role:x`` and ``permission:x``."""
    out = []
    for p in entry.get("principals") or ():
        p = {"group": p} if isinstance(p, str) else p
        kind = next((k for k in ("group", "role", "permission") if p.get(k)), None)
        if kind is None:
            raise PolicyError(f"principal without a name: {p}")
        out.append(p[kind] if kind == "group" else f"{kind}:{p[kind]}")
    return tuple(out)


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Transform:
    """One of KINDS with its settings, for the callers in ``principals`` (none: everybody else)."""

    kind: str = "identity"
    settings: tuple[tuple[str, Any], ...] = ()
    principals: tuple[str, ...] = ()

    def get(self, key: str, default: Any = None) -> Any:
        return dict(self.settings).get(key, default)


@dataclass(frozen=True)
class Condition:
    """``value``: SQL text of a generic filter, or days of a retention filter (none: unlimited)."""

    value: Any
    principals: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter:
    kind: str
    conditions: tuple[Condition, ...]
    field: str | None = None


@dataclass(frozen=True)
class RuleSet:
    target: str
    transforms: tuple[tuple[str, tuple[Transform, ...]], ...] = ()
    filters: tuple[Filter, ...] = ()
    target_type: str = "SQL_VIEW"


@dataclass(frozen=True)
class Policy:
    source: str
    fields: tuple[Field, ...]
    rule_sets: tuple[RuleSet, ...] = ()
    title: str = ""
    version: int | None = None
    platform: str = ""


def _settings(x: Any) -> tuple[tuple[str, Any], ...]:
    return tuple((k, _settings(v) if isinstance(v, dict) else tuple(_name(i) if isinstance(i, dict) and "name_parts" in i else str(i) for i in v) if isinstance(v, list) else v) for k, v in x.items()) if isinstance(x, dict) else (("value", x),)


def transform_from(entry: dict) -> Transform:
    given = [k for k in KINDS if k in entry]
    unknown = set(entry) - set(KINDS) - {"principals"}
    if unknown or len(given) > 1:
        raise PolicyError(f"unknown or ambiguous transform: {sorted(unknown or given)}")
    kind = given[0] if given else "identity"
    return Transform(kind, _settings(entry.get(kind) or {}), principals_of(entry))


def filter_from(entry: dict) -> Filter:
    if "generic_filter" in entry:
        return Filter("generic", tuple(Condition(c["condition"], principals_of(c)) for c in entry["generic_filter"].get("conditions", ())))
    if "retention_filter" in entry:
        f = entry["retention_filter"]
        days = lambda c: None if not c.get("period") else int(c["period"].get("days", 0))
        return Filter("retention", tuple(Condition(days(c), principals_of(c)) for c in f.get("conditions", ())), _name(f["field"]))
    raise PolicyError("a filter must be generic or a retention")


def policy_from(document: dict | str) -> Policy:
    """Policy of a dict or JSON text; keys in camelCase or snake_case."""
    d = _snake(json.loads(document) if isinstance(document, str) else document)
    source, meta = d.get("source") or {}, d.get("metadata") or {}
    ref = source.get("ref", "")
    ref = ref if isinstance(ref, str) else ref.get("platform_fqn") or ref.get("integration_fqn", "")
    fields = tuple(Field(_name(f), f.get("type", "string"), bool(f.get("required")), tuple(f.get("tags") or ())) for f in source.get("fields") or ())
    sets = []
    for r in d.get("rule_sets") or ():
        target = r.get("target") or {}
        name = target.get("ref", target.get("fullname", ""))
        name = name if isinstance(name, str) else name.get("platform_fqn") or name.get("integration_fqn", "")
        sets.append(RuleSet(name or f"{ref}_view", tuple((_name(t["field"]), tuple(map(transform_from, t.get("transforms") or ()))) for t in r.get("field_transforms") or ()), tuple(map(filter_from, r.get("filters") or ())), target.get("type", "SQL_VIEW")))
    return Policy(ref, fields, tuple(sets), meta.get("title", ""), meta.get("version"), (d.get("platform") or {}).get("id", ""))


def principals_in(rule_set: RuleSet) -> list[str]:
    """Every principal that a rule set names, sorted."""
    entries = [t for _, ts in rule_set.transforms for t in ts] + [c for f in rule_set.filters for c in f.conditions]
    return sorted({p for e in entries for p in e.principals})
