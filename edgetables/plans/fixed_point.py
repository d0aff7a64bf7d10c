"""Repeat a step until it finds no new pair."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from edgetables.operators.pairs import dedup_flagged, metric_columns
from edgetables.plans.storage import Workspace

MAX_ITERATIONS = 100
Step = Callable[[DataFrame, int], DataFrame]


class NotConverged(RuntimeError):
    pass


@dataclass
class FixedPoint:
    """Result of a loop; ``metrics`` holds one entry per stored generation, with its seconds.

    The pairs are read from a stored table: ``close()``, or leaving the result as
    a context, removes it.
    """

    pairs: DataFrame
    iterations: int
    converged: bool
    metrics: list[dict] = field(default_factory=list)
    workspace: Workspace | None = None

    def __enter__(self) -> FixedPoint:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        if self.workspace:
            self.workspace.close()


def fixed_point(
    pairs: DataFrame,
    step: Step | tuple[Step, ...],
    n_pairs: int | None = None,
    max_iterations: int = MAX_ITERATIONS,
    on_limit: str = "raise",
    distinct: bool = True,
    workspace: Workspace | None = None,
    settles: bool = False,
) -> FixedPoint:
    """Apply ``step`` and deduplicate until no row is flagged new.

    ``step(pairs, n)`` gets an upper bound ``n`` of the pairs it reads.  Every
    generation is stored, its stop test is made on the way, and the one before is
    dropped.  ``distinct=False`` is for steps that drop the copies in their input
    themselves.  ``on_limit="return"`` hands back the unfinished pairs, marked as
    such, instead of raising.  Several steps take turns; the loop ends when each
    in a row has found nothing.  ``settles`` is for steps of which the first, once
    it finds nothing, leaves every ``src`` in one pair, and the others keep it so:
    they go on alone, and there are no copies to look for.  Whatever raises
    leaves no table behind.
    """
    workspace = workspace or Workspace(pairs.sparkSession)
    try:
        bound = pairs.count() if n_pairs is None else n_pairs
        metrics, stored, quiet = [], None, 0
        steps, turn = step if isinstance(step, tuple) else (step,), 0
        for done in range(1, max_iterations + 1):
            began = time.perf_counter()
            moved = steps[turn](pairs, bound)
            flagged = dedup_flagged(moved) if distinct else moved
            name = f"pairs-{done}"
            pairs, seen = workspace.write(flagged, name, *metric_columns(), columns=["src", "dst"], n_rows=2 * bound)
            if stored:
                workspace.drop(stored)
            stored, bound = name, seen["pair_count"]
            metrics.append({"iteration": done, **seen, "seconds": time.perf_counter() - began})
            quiet = 0 if seen["new_pairs"] else quiet + 1
            if quiet == len(steps):
                return FixedPoint(pairs, done, True, metrics, workspace)
            turn = (turn + 1) % len(steps)
            if settles and turn == 1 and quiet:
                steps, turn, quiet, distinct, settles = steps[1:], 0, 0, False, False
        if on_limit == "raise":
            raise NotConverged(f"pairs still change after {max_iterations} iterations")
        return FixedPoint(pairs, max_iterations, False, metrics, workspace)
    except BaseException:
        workspace.close()
        raise
