"""Patterns, pattern trees and criteria, and their JSON forms.

A graph is a DataFrame ``edges(target_id, src, label, dst)`` without repeats, one target per project.  Properties of a node are loops.  Labels are strings:
a plain name, or ``annotation.<kind>=<value>``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

#: Verdicts in the order in which reports list them.
VERDICTS = ("positive", "negative", "neutral")

# The vocabulary of the typegraph format. Annotation kinds in the order in which a reader tries them.
PLAIN_LABELS = ("extends", "implements", "invokes", "overrides", "accessesField", "dependsOn", "contains")
ANNOTATION_KINDS = ("nameClass", "modifier", "scheme", "location")

Edge = tuple[str, str, str]


def annotation(kind: str, value: str) -> str:
    """The canonical label of an annotation loop."""
    if kind not in ANNOTATION_KINDS:
        raise ValueError(f"unknown annotation {kind!r}")
    return f"annotation.{kind}={value}"


def decode_label(raw: object, *, strict: bool = True) -> str:
    """The canonical label of a JSON edge: a plain string, or an object with one annotation."""
    if isinstance(raw, str):
        if strict and raw not in PLAIN_LABELS:
            raise ValueError(f"invalid edge type {raw!r}")
        return raw
    inner = raw.get("annotation") if isinstance(raw, dict) else None
    if isinstance(inner, dict):
        for kind in ANNOTATION_KINDS:
            if isinstance(inner.get(kind), str):
                return annotation(kind, inner[kind])
    raise ValueError(f"invalid edge {raw!r}")


def encode_label(label: str) -> object:
    """The JSON form of a canonical label."""
    head, _, value = label.partition("=")
    if head.startswith("annotation.") and _:
        return {"annotation": {head.removeprefix("annotation."): value}}
    return label


@dataclass(frozen=True)
class PatternTree:
    """A pattern (a set of edges over variable names) with a verdict; children extend it and share its variables by name."""

    verdict: str
    pattern: frozenset[Edge]
    children: tuple[PatternTree, ...] = ()

    def __post_init__(self) -> None:
        if self.verdict not in VERDICTS:
            raise ValueError(f"unknown verdict {self.verdict!r}")

    @classmethod
    def of(cls, verdict: str, pattern: Iterable[Edge], *children: PatternTree) -> PatternTree:
        return cls(verdict, frozenset(pattern), children)

    @classmethod
    def decode(cls, raw: dict, *, strict: bool = True) -> PatternTree:
        edges = frozenset((s, decode_label(e, strict=strict), d) for s, e, d in raw["pattern"])
        return cls(raw["verdict"], edges, tuple(cls.decode(c, strict=strict) for c in raw.get("children", ())))

    def encode(self) -> dict:
        out: dict = {"verdict": self.verdict, "pattern": [[s, encode_label(e), d] for s, e, d in sorted(self.pattern)]}
        return out | ({"children": [c.encode() for c in self.children]} if self.children else {})

    def map_pattern(self, f: Callable[[frozenset[Edge]], frozenset[Edge]]) -> PatternTree:
        return replace(self, pattern=f(self.pattern), children=tuple(c.map_pattern(f) for c in self.children))


@dataclass(frozen=True)
class Criterion:
    """A text and the trees that judge it."""

    text: str
    patterns: tuple[PatternTree, ...] = field(default=())

    @classmethod
    def decode(cls, raw: dict | str, *, strict: bool = True) -> Criterion:
        raw = json.loads(raw) if isinstance(raw, str) else raw
        return cls(raw["criterion"], tuple(PatternTree.decode(p, strict=strict) for p in raw["patterns"]))

    def encode(self) -> dict:
        return {"criterion": self.text, "patterns": [p.encode() for p in self.patterns]}


def family(make: Callable[[str], PatternTree], values: Iterable[str]) -> tuple[PatternTree, ...]:
    """One tree for each value: how a criterion script writes patterns that differ in a literal."""
    return tuple(make(v) for v in values)


def suggested_pattern(raw: dict | str) -> tuple[PatternTree, ...]:
    """Trees from a language model's answer ``{success, patterns: [{verdict, graph: {nodes: [{id, labels}], edges: [{fromId, toId, label}]}}]}``; its node labels become loops."""
    raw = json.loads(raw) if isinstance(raw, str) else raw
    if not raw.get("success"):
        raise ValueError(raw.get("message") or raw.get("reason") or "no pattern")
    trees = []
    for p in raw["patterns"]:
        loops = {(n["id"], label, n["id"]) for n in p["graph"]["nodes"] for label in n["labels"]}
        trees.append(PatternTree.of(p["verdict"], loops | {(e["fromId"], e["label"], e["toId"]) for e in p["graph"]["edges"]}))
    return tuple(trees)
