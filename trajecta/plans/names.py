"""A registry of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        """Registers a function by its name; without an oracle only its tests check it."""

        def take(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = oracle
            return f

        return take
