"""Readers and renderers by format name; the one of the greatest priority is taken."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Registry:
    """Tools are functions of DataFrames, so a conversion is a plan: read, transform, render."""

    readers: dict[str, list[tuple[int, Callable]]] = field(default_factory=dict)
    renderers: dict[str, list[tuple[int, Callable[[DataFrame], DataFrame]]]] = field(default_factory=dict)

    def reader(self, kind: str, tool: Callable, priority: int = 0) -> None:
        self.readers.setdefault(kind, []).append((priority, tool))

    def renderer(self, kind: str, tool: Callable[[DataFrame], DataFrame], priority: int = 0) -> None:
        self.renderers.setdefault(kind, []).append((priority, tool))

    @staticmethod
    def _best(tools: dict[str, list], kind: str) -> Callable:
        if kind not in tools:
            raise ValueError(f"no tool for {kind}; there are: {', '.join(sorted(tools))}")
        return max(tools[kind], key=lambda t: t[0])[1]

    def convert(self, source, kind: str, to: str, steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
        rows = self._best(self.readers, kind)(source)
        for step in steps:
            rows = rows.transform(step)
        return self._best(self.renderers, to)(rows)
