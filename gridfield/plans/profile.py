"""Named timers with floating-point operation counts."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass
class Event:
    calls: int = 0
    seconds: float = 0.0
    flops: int = 0

    @property
    def gflops(self) -> float:
        """Per second, in units of 10**9; 0 where no time has passed."""
        return self.flops / self.seconds / 1e9 if self.seconds else 0.0


class Profiler:
    """tic and toc nest; a time holds that of what is inside.  Spark works when an action runs: put that inside."""

    def __init__(self):
        self.events: dict[str, Event] = {}
        self.open: list[tuple[str, float]] = []

    def tic(self, name: str) -> None:
        self.events.setdefault(name, Event())
        self.open.append((name, time.perf_counter()))

    def toc(self) -> Event:
        name, began = self.open.pop()
        event = self.events[name]
        event.calls, event.seconds = event.calls + 1, event.seconds + time.perf_counter() - began
        return event

    def add_flops(self, n: int, sites: int = 1) -> None:
        """For every timer that runs."""
        for name in {x for x, _ in self.open}:
            self.events[name].flops += n * sites

    @contextmanager
    def timed(self, name: str, flops: int = 0, sites: int = 1) -> Iterator[Event]:
        self.tic(name)
        try:
            self.add_flops(flops, sites)
            yield self.events[name]
        finally:
            self.toc()

    def report(self) -> list[tuple[str, int, float, float]]:
        """name, calls, seconds, GFLOP/s; the slowest first."""
        return sorted(((n, e.calls, e.seconds, e.gflops) for n, e in self.events.items()), key=lambda r: -r[2])
