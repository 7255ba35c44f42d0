"""Ordered regex rules from TOML, run as one fold over the text, and manifests of cleaning steps."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    replace: str
    comment: str = ""


def load_rules(path: str | Path) -> tuple[Rule, ...]:
    """Rules of a TOML file, in order. A missing key or bad pattern is a ValueError that names file and rule number, from 1."""
    path = Path(path)
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    out = []
    for n, r in enumerate(data.get("rules", []), 1):
        if "pattern" not in r or "replace" not in r:
            raise ValueError(f"{path.name}: rule #{n} lacks pattern or replace")
        try:
            re.compile(r["pattern"])
        except re.error as e:
            raise ValueError(f"{path.name}: rule #{n}: {e}") from e
        out.append(Rule(r["pattern"], r["replace"], r.get("comment", "")))
    return tuple(out)


@cache
def builtin_rules(name: str) -> tuple[Rule, ...]:
    return load_rules(Path(__file__).parent / "rulesets" / f"{name}.toml")


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, '$' before a last newline only, and \\N in a class as the octal it is."""

    def fix_class(m: re.Match) -> str:
        return re.sub(r"(?<!\\)\\([1-7])", lambda g: f"\\\\x0{g[1]}".replace("\\\\", "\\"), m[0])

    return "(?Ud)" + re.sub(r"\[(?:\\.|[^\]\\])+\]", fix_class, pattern)


def java_replacement(text: str) -> str:
    """\\N and \\g<N> become $N; a literal dollar or backslash is kept as such."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and (m := re.match(r"\\(?:g<(\w+)>|(\d+))", text[i:])):
            name = m[1] or m[2]
            out.append(f"${name}" if name.isdigit() else f"${{{name}}}")
            i += len(m[0])
            continue
        if c == "\\" and i + 1 < len(text):
            out.append({"n": "\n", "t": "\t", "\\": "\\\\"}.get(text[i + 1], text[i + 1]))
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def apply_rules(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All rules in order, every match of each. One fold over an array of literals: hundreds of rules do not deepen the plan."""
    if not rules:
        return text
    table = F.array(*[F.struct(F.lit(java_pattern(r.pattern)).alias("p"), F.lit(java_replacement(r.replace)).alias("r")) for r in rules])
    return F.aggregate(table, text, lambda acc, x: F.regexp_replace(acc, x["p"], x["r"]))


def apply_rules_python(text: str, rules: tuple[Rule, ...]) -> str:
    for r in rules:
        text = re.sub(r.pattern, r.replace, text)
    return text


Step = Callable[[Column], Column]


def load_steps(directory: str | Path | None, builtin: dict[str, Step], max_line_count: int | None = None) -> list[tuple[str, Step]]:
    """The steps of pipeline.toml in a directory (None: the packaged one), in order; each is a Column -> Column function.

    An unknown type, missing file or unknown built-in is a ValueError. The step `linebreak` is left out below two lines.
    """
    root = Path(directory) if directory else Path(__file__).parent / "rulesets"
    manifest = root / "pipeline.toml"
    if not manifest.exists():
        raise ValueError(f"no step manifest in {root}")
    out: list[tuple[str, Step]] = []
    for s in tomllib.loads(manifest.read_text(encoding="utf-8")).get("steps", []):
        if s.get("type") == "rules":
            file = root / s["file"]
            if not file.exists():
                raise ValueError(f"missing rule file {s['file']}")
            out.append((file.stem, lambda c, rules=load_rules(file): apply_rules(c, rules)))
        elif s.get("type") == "builtin":
            if s["name"] not in builtin:
                raise ValueError(f"unknown step {s['name']!r}")
            if s["name"] == "linebreak" and max_line_count is not None and max_line_count < 2:
                continue
            out.append((s["name"], builtin[s["name"]]))
        else:
            raise ValueError(f"unknown step type {s.get('type')!r}")
    return out


def clean(text: Column, steps: list[tuple[str, Step]]) -> Column:
    for _, step in steps:
        text = step(text)
    return text
