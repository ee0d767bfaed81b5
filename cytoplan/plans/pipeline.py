"""The bundle, embed and figures stages: each is skipped if its output exists and it isn't forced."""

from __future__ import annotations

import time
from collections.abc import Callable

STAGES = ("bundle", "embed", "figures")


class Run:
    """Stages to run: those in only (all by default); from start on they are forced."""

    def __init__(self, start: str | None = None, only: str | None = None) -> None:
        for s in [*([start] if start else []), *(parts := [p.strip() for p in (only or "").split(",") if p.strip()])]:
            if s not in STAGES:
                raise SystemExit(f"unknown stage {s}; there are {', '.join(STAGES)}")
        self.wanted = set(parts or STAGES)
        self.forced = set(STAGES[STAGES.index(start) :]) if start else set()
        self.seconds: dict[str, float] = {}

    def stage(self, name: str, done: Callable[[], bool], work: Callable[[], None]) -> bool:
        """Runs work unless the stage isn't wanted, or done already and not forced; returns whether it ran."""
        if name not in self.wanted or (done() and name not in self.forced):
            return False
        began = time.time()
        work()
        self.seconds[name] = time.time() - began
        return True
