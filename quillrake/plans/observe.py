"""What a run did and how long it took: timed stages and row counts that ride along with the job."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("quillrake")


@dataclass
class Run:
    """Stages in order with their seconds; failed ones with their error."""

    stages: list[tuple[str, float, str | None]] = field(default_factory=list)
    counts: dict[str, Observation] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, error = time.perf_counter(), None
        try:
            yield
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            self.stages.append((name, time.perf_counter() - began, error))
            (log.error if error else log.info)("%s: %.3f s%s", name, self.stages[-1][1], f", {error}" if error else "")

    def counted(self, df: DataFrame, name: str) -> DataFrame:
        """df, whose rows are counted when an action runs it: no job of its own."""
        self.counts[name] = Observation(name)
        return df.observe(self.counts[name], F.count(F.lit(1)).alias("rows"))

    def count(self, name: str, n: int) -> None:
        """A number of rows that is known already."""
        self.known[name] = n

    def rows(self, name: str) -> int:
        return self.known[name] if name in self.known else self.counts[name].get["rows"]

    @property
    def seconds(self) -> float:
        return sum(s for _, s, _ in self.stages)

    def report(self) -> str:
        return "\n".join(f"{n:<24} {s:9.3f} s" + (f"  failed: {e}" if e else "") for n, s, e in self.stages)
