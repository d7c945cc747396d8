"""Named functions that users may add to: corruptions, filters, channels, clocks and column functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from . import channels as named
from . import kernels


class Registry:
    """Names to callables; an unknown name lists the known ones."""

    def __init__(self, kind: str, start: dict[str, Callable] | None = None):
        self.kind, self.known = kind, dict(start or {})

    def add(self, name: str, f: Callable) -> Callable:
        if name in self.known:
            raise ValueError(f"{self.kind} {name!r} is there already")
        self.known[name] = f
        return f

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.known))


corruptions = Registry("corruption", kernels.CORRUPTIONS)
channels = Registry("channel", named.CHANNELS)
#: The clock that time-outs read; tests put their own in.
clock: Callable[[], float] = time.monotonic
