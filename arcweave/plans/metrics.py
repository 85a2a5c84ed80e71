"""Scopes with durations and values, as a tree, and their JSON."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager


class Metrics:
    """``with m.scope("scc"): m.value("n", 5)``; scopes nest, names repeat as lists."""

    def __init__(self):
        self.root: dict = {}
        self._path = [self.root]

    @contextmanager
    def scope(self, name: str):
        node: dict = {}
        here = self._path[-1]
        if name in here:
            here[name] = [*(here[name] if isinstance(here[name], list) else [here[name]]), node]
        else:
            here[name] = node
        self._path.append(node)
        began = time.perf_counter_ns()
        try:
            yield node
        finally:
            node["duration"] = time.perf_counter_ns() - began
            self._path.pop()

    def value(self, name: str, value) -> None:
        self._path[-1][name] = value

    def json(self, rank: int = 0) -> str:
        """One object keyed by rank."""
        return json.dumps({str(rank): self.root}, indent=1)

    def write(self, path: str, rank: int = 0) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.json(rank))
