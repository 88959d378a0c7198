"""Windows over whole-number times: what is live, and what has been produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.spec import Spec, Stream, WindowSpec


def bounds(window: WindowSpec, at: int | None) -> tuple[int | None, int | None]:
    """The first and last time of the window in force when the latest time is `at` (None: before any row)."""
    if window.kind == "tumbling":
        start = 0 if at is None else at // window.size * window.size
        return start, start + window.size - 1
    if window.kind == "sliding":
        last = 0 if at is None else at
        return last - window.size + 1, last
    return None, None


def with_frames(spec: Spec, change) -> Spec:
    """The same query over changed tables; change: from a Stream to a DataFrame."""
    return spec.over({n: change(s) for n, s in spec.streams.items()})


def live(spec: Spec, at: int) -> Spec:
    """The query over what its window holds at a time; the window is spent by that."""
    low, high = bounds(spec.window, at)

    def within(s: Stream) -> DataFrame:
        return s.frame if low is None else s.frame.filter(F.col(s.ts).between(low, high))

    out = with_frames(spec, within)
    out.window = WindowSpec()
    return out


def latest(spec: Spec) -> int | None:
    """The latest time of any stream's rows."""
    found = [s.frame.agg(F.max(s.ts)).first()[0] for s in spec.streams.values()]
    found = [x for x in found if x is not None]
    return max(found) if found else None
