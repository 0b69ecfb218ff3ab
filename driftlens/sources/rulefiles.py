"""Rules from TOML files: layers, includes, disabled names, levels. Files are few and read on the driver.

A file may have ``include`` (paths relative to it, to a depth of MOST_DEPTH), ``disable`` (globs of names), ``catalog`` (a boolean), a
table ``levels`` and ``[[rule]]`` tables with a name, conditions in kebab case (beside or in ``when``), messages and effects.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from driftlens.operators.rules import Rule, layered, problems

MOST_DEPTH = 8


@dataclass
class Ruleset:
    rules: list[Rule] = field(default_factory=list)
    levels: dict[str, str] = field(default_factory=dict)
    catalog: bool = True
    problems: list[str] = field(default_factory=list)


def rule_of(table: dict) -> dict:
    """A rule's table with its conditions flat and its names in snake case; lists as tuples."""
    flat = {k: v for k, v in table.items() if k != "when"} | table.get("when", {})
    out = {k.replace("-", "_"): tuple(v) if isinstance(v, list) else v for k, v in flat.items()}
    if out.pop("noise", None) is True and "noise" not in table.get("when", {}):
        out["hides"] = True  # beside the conditions it is an effect
    return out


def documents(path: Path, depth: int = 0) -> list[tuple[Path, dict]]:
    """A file's includes, then the file; an unreadable one gives a document that says so."""
    try:
        doc = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        return [(path, {"problem": f"{path.name}: {type(e).__name__}"})]
    if depth >= MOST_DEPTH:
        return [(path, {"problem": f"{path.name}: included too deep"})]
    return [x for inner in doc.get("include", []) for x in documents(path.parent / inner, depth + 1)] + [(path, doc)]


def read(*layers: str | Path) -> Ruleset:
    """Files from the weakest to the strongest layer: rules of an equal name are replaced in place, later levels win, the
    catalogue is on if no file turns it off, and disabled names go last."""
    known = {f.name for f in fields(Rule)}
    out, groups, disabled = Ruleset(), [], []
    for layer in layers:
        for _, doc in documents(Path(layer)):
            if "problem" in doc:
                out.problems.append(doc["problem"])
                continue
            tables = [rule_of(t) for t in doc.get("rule", [])]
            out.problems += problems(tables)
            groups.append([Rule(**{k: v for k, v in t.items() if k in known}) for t in tables if t.get("name")])
            disabled += doc.get("disable", [])
            out.levels |= doc.get("levels", {})
            out.catalog &= doc.get("catalog", True)
    out.rules = layered(groups, disabled)
    out.problems = sorted(set(out.problems))
    return out
