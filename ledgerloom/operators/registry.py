"""A small registry of named implementations per stage."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """(stage, name) to factory; registering twice or asking for an unknown one raises."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], Callable] = {}

    def register(self, stage: str, name: str) -> Callable[[Callable], Callable]:
        def add(factory: Callable) -> Callable:
            if (stage, name) in self._made:
                raise ValueError(f"{name} is already registered for {stage}")
            self._made[stage, name] = factory
            return factory

        return add

    def create(self, stage: str, name: str, *args, **kwargs):
        if (stage, name) not in self._made:
            raise KeyError(f"nothing named {name} for {stage}; there is {self.names(stage)}")
        return self._made[stage, name](*args, **kwargs)

    def names(self, stage: str) -> list[str]:
        return sorted(n for s, n in self._made if s == stage)

    def matrix(self) -> dict[str, list[str]]:
        """Stages with what they offer."""
        return {s: self.names(s) for s in sorted({s for s, _ in self._made})}
