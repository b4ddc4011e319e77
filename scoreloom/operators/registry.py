"""Registries: what is found by name, by what it owns, or by default. Each kind of thing that users may add has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

DEFAULT = "__default__"


@dataclass(frozen=True)
class Entry:
    keys: tuple[str, ...]
    value: Any
    priority: int = 0
    owns: Callable[[Any], bool] | None = None


@dataclass
class Registry:
    """``kind`` names what is registered, in errors. A key belongs to one entry."""

    kind: str
    entries: list[Entry] = field(default_factory=list)

    def add(self, *keys: str, value: Any, priority: int = 0, owns: Callable[[Any], bool] | None = None) -> Any:
        if not keys:
            raise ValueError(f"a {self.kind} needs a key")
        for k in keys:
            if k in self.names():
                raise ValueError(f"{self.kind} {k!r} is registered already")
        self.entries.append(Entry(keys, value, priority, owns))
        return value

    def names(self) -> list[str]:
        return sorted(k for e in self.entries for k in e.keys)

    def get(self, name: str) -> Any:
        for e in self.entries:
            if name in e.keys:
                return e.value
        raise ValueError(f"no {self.kind} {name!r}; there are: {', '.join(self.names())}")

    def resolve(self, keys: list[str], about: Any = None) -> Any:
        """The entry of highest priority (the first of equals) under one of the keys, or else that owns what it is about, or else the default."""
        tests = (lambda e: set(keys) & set(e.keys), lambda e: DEFAULT not in e.keys and e.owns is not None and e.owns(about), lambda e: DEFAULT in e.keys)
        for test in tests:
            if fit := [e for e in self.entries if test(e)]:
                return max(fit, key=lambda e: e.priority).value
        raise ValueError(f"no {self.kind} for {', '.join(keys)}; there are: {', '.join(self.names())}")


METRICS, EVALUATORS, MAPPERS, PIPELINES = (Registry(k) for k in ("metric", "evaluator", "label mapper", "pipeline"))


def _fill() -> None:
    from ..functions import jsonpaths, table_metrics
    from ..sources import adapters
    from . import attribution, document_score, extraction, rule_engine

    metrics = {"accuracy": jsonpaths.subset_score, "anls": attribution.anls, "answer": attribution.answer_matches, "grits": table_metrics.grits, "teds": table_metrics.teds_of_pages, "record_match": table_metrics.record_match, "header_accuracy": table_metrics.header_scores}
    for name, f in metrics.items():
        METRICS.add(name, value=f)
    for name, f in {"parse": rule_engine.evaluate, "extract": extraction.document_scores, "layout_detection": attribution.page_scores, "document": document_score.document_scores}.items():
        EVALUATORS.add(name, value=f)
    MAPPERS.add(DEFAULT, value=adapters.canonical_label)
    MAPPERS.add("core", value=adapters.core_label)
    MAPPERS.add("basic", value=lambda raw: adapters.target_label(adapters.canonical_label(raw), "basic"))


_fill()
