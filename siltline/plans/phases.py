"""Phases of a scan: in order, resumable, each done at most once for the same evidence."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A phase that is done again makes the later ones stale, but for those that read raw evidence only.
KEEPS = frozenset({"carve"})


class Stopped(Exception):
    """The run was asked to stop; what is done is recorded."""


@dataclass
class Progress:
    """(phase, unit) pairs that are done, in a file that is replaced as a whole. Unit * is the whole phase."""

    path: str
    done: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                self.done = json.load(f)

    def is_done(self, phase: str, unit: str = "*") -> bool:
        return unit in self.done.get(phase, {})

    def mark(self, phase: str, unit: str = "*") -> None:
        self.done.setdefault(phase, {})[unit] = time.time()
        self._save()

    def forget(self, phase: str) -> None:
        if self.done.pop(phase, None) is not None:
            self._save()

    def remaining(self, phase: str, units: list[str]) -> list[str]:
        return [u for u in dict.fromkeys(units) if not self.is_done(phase, u)]

    def _save(self) -> None:
        with open(f"{self.path}.part", "w", encoding="utf-8") as f:
            json.dump(self.done, f)
        os.replace(f"{self.path}.part", self.path)


@dataclass
class Scan:
    """Registered phases run in order: phase(context) returns False if it is only partly done and must be tried again."""

    progress: Progress
    phases: dict[str, Callable] = field(default_factory=dict)
    stop_flag: str | None = None

    def phase(self, name: str):
        def add(f: Callable) -> Callable:
            self.phases[name] = f
            return f

        return add

    def check_stop(self) -> None:
        if self.stop_flag and os.path.exists(self.stop_flag):
            raise Stopped(self.stop_flag)

    def run(self, names: list[str] | None = None, context=None, again: bool = False) -> list[str]:
        """Runs the named phases (all if none) that are not done, and returns those that it ran."""
        unknown = set(names or ()) - set(self.phases)
        if unknown:
            raise ValueError(f"no such phase: {', '.join(sorted(unknown))}")
        order, ran = list(self.phases), []
        for i, name in enumerate(order):
            if names and name not in names or self.progress.is_done(name) and not again:
                continue
            self.check_stop()
            complete = self.phases[name](context)
            ran.append(name)
            for later in order[i + 1 :]:
                if later not in KEEPS:
                    self.progress.forget(later)
            if complete is not False:
                self.progress.mark(name)
        return ran


def recheck(coverage: DataFrame, checked: DataFrame) -> DataFrame:
    """Counts before and after another look at lost blocks: coverage and checked are (volume, blkid, status), the latter with new statuses of some blocks."""
    both = coverage.join(checked.select("volume", "blkid", F.col("status").alias("now")), ["volume", "blkid"], "left")
    lost = lambda c: ~F.col(c).isin("ok", "ok_stale", "embedded", "hole", "discarded")
    state = both.withColumn("now", F.coalesce("now", "status"))
    return state.groupBy("volume").agg(F.count_if(lost("status")).alias("before"), F.count_if(lost("now")).alias("after")).withColumn("recovered", F.col("before") - F.col("after"))
