"""Passes: read, transform, apply, publish, advance. And bulk loads that hand over to them.

The order of effects makes a pass safe to repeat: the position is found before rows are read,
the data is published before the position, and the source is acknowledged last. A crash in
between replays the pass. Writers by key or scope then give the same state; writers that
append are told by the pass number in the published version that they ran already.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame

from ..functions.transforms import Hook, run_hooks
from ..model import Hold, Intent, PositionExpired, Read, Segment
from ..operators.writers import Guard, in_scope, reconcile_deletes
from ..sources.readers import unchanged
from .buckets import KeyedTable
from .store import Positions, ReadState, VersionedTable, key_path

Reader = Callable[[Any, Intent], Read]
Writer = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Job:
    """key: (task, mapping, source). capture gives the position a pass would reach now, for
    sources that can tell; acknowledge lets the source forget what is applied. hooks: what runs
    at each point (see functions.transforms.POINTS). staging: a folder for the staged rows of a
    pass, which are then written once, however often the writer and its checks read them, and
    can't change between the reads; without it they are read from the source each time. A target in
    buckets (plans.buckets) is rewritten where staged keys hash to; it needs a writer by key."""

    key: tuple[str, str, str]
    read: Reader
    apply: Writer
    target: VersionedTable | KeyedTable
    positions: Positions
    transform: Callable[[DataFrame], DataFrame] = staticmethod(lambda rows: rows)
    capture: Callable[[], Any] | None = None
    acknowledge: Callable[[Any], None] | None = None
    hooks: dict[str, list[Hook]] = field(default_factory=dict)
    staging: str | None = None


def staged(job: Job, rows: DataFrame, number: int) -> DataFrame:
    """The rows of a pass, written once where the job has a place for them."""
    if job.staging is None:
        return rows
    path = f"{job.staging.rstrip('/')}/{key_path(job.key)}/{number:012d}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_pass(job: Job) -> ReadState:
    """One pass from the stored state. A held mapping isn't run, a source whose counter
    hasn't moved isn't read, and a position that has expired holds the mapping."""
    state = job.positions.get(job.key)
    if state.hold is not Hold.NONE:
        return state
    if job.capture and state.intent is Intent.CHANGES and unchanged(state.position, job.capture()):
        return state
    run_hooks(job.hooks, "before_stage")
    try:
        found = job.read(state.position, state.intent)
    except PositionExpired:
        held = replace(state, hold=Hold.EXPIRED)
        job.positions.put(job.key, held)
        raise
    number = state.pass_id + 1
    current = job.target.current()
    done = current.facts.get("pass", {}).get(key_path(job.key), 0) if current else 0
    if done < number:
        passes = (current.facts.get("pass", {}) if current else {}) | {key_path(job.key): number}
        rows = staged(job, job.transform(found.rows), number)
        run_hooks(job.hooks, "after_stage")
        run_hooks(job.hooks, "before_load")
        if isinstance(job.target, KeyedTable):
            job.target.apply(rows, job.apply)
        else:
            new = job.apply(job.target.read(), rows)
            job.target.publish(new, current.number if current else None, **{"pass": passes})
        run_hooks(job.hooks, "after_load")
    after = ReadState(Intent.CHANGES, Hold.NONE, found.position, None, number)
    job.positions.put(job.key, after)
    if job.acknowledge:
        job.acknowledge(found.position)
    return after


def run_until_idle(job: Job, most: int = 1000) -> list[ReadState]:
    """Passes until the position stays: micro-batches of a source with capped reads. Raises
    an error where it doesn't after most passes; what they applied stays."""
    found = []
    for _ in range(most):
        before = job.positions.get(job.key)
        after = run_pass(job)
        if after.hold is not Hold.NONE or (before.intent is Intent.CHANGES and after.position == before.position):
            return found
        found.append(after)
    raise RuntimeError(f"not idle after {most} passes")


def run_continuously(job: Job, frequency: float = 60, idle_after: float = 60, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """A pass every so many seconds, until none has moved the position for idle_after seconds
    or the mapping is held. Gives the number of passes that moved it."""
    moved, last = 0, clock()
    while True:
        before = job.positions.get(job.key)
        after = run_pass(job)
        if after.hold is not Hold.NONE:
            return moved
        if after.position != before.position or before.intent is not Intent.CHANGES:
            moved, last = moved + 1, clock()
        elif clock() - last >= idle_after:
            return moved
        wait(frequency)


def bulk_load(job: Job, segments: list[Segment], load: Callable[[list[Segment]], DataFrame], scope: Callable[[Segment], Column | None]) -> ReadState:
    """Loads a table segment by segment and hands over to incremental passes: the position is
    captured before the first read, kept as pending while the mapping is held, and becomes the
    live one when every segment is in. scope gives a segment's condition on the target, None for
    all of it; what lies in none of them stays. load reads all segments in one scan (readers.reload_segments),
    and one write publishes them: none is visible before all are."""
    pending = job.capture() if job.capture else None
    state = job.positions.get(job.key)
    job.positions.put(job.key, replace(state, hold=Hold.LOADING, pending=pending))
    current = job.target.current()
    scopes = [scope(s) for s in segments]
    table = job.target.read()
    if None in [s if s is None else 0 for s in scopes]:
        table = table.limit(0)
    elif scopes:
        table = table.filter(~reduce(lambda a, b: a | b, [in_scope(s) for s in scopes]))
    table = table.unionByName(load(segments).select(*table.columns))
    job.target.publish(table, current.number if current else None, **(current.facts if current else {}))
    loaded = ReadState(Intent.CHANGES, Hold.NONE, pending, None, state.pass_id)
    job.positions.put(job.key, loaded)
    return loaded


def status(job: Job) -> dict[str, Any]:
    """Where a job stands: its read state and the version of its target."""
    state, current = job.positions.get(job.key), job.target.current()
    told = {"intent": state.intent, "hold": state.hold, "position": state.position, "pending": state.pending, "passes": state.pass_id}
    return told | {"version": current.number if current else None}


def reconcile(job: Job, keys: DataFrame, names: list[str], scope: Column | None = None, guard: Guard = Guard("none")) -> None:
    """Deletes the target's rows in scope whose key the source no longer has, unless the guard refuses; the
    position stays. Only the affected buckets of a table in buckets are written."""
    if isinstance(job.target, KeyedTable):
        job.target.reconcile_deletes(keys, scope, guard)
        return
    current = job.target.current()
    kept = reconcile_deletes(job.target.read(), keys, names, scope, guard)
    job.target.publish(kept, current.number if current else None, **(current.facts if current else {}))


def pause(job: Job) -> None:
    job.positions.put(job.key, replace(job.positions.get(job.key), hold=Hold.PAUSED))


def resume(job: Job, intent: Intent | None = None) -> None:
    state = job.positions.get(job.key)
    job.positions.put(job.key, replace(state, hold=Hold.NONE, intent=intent or state.intent))


def preview(job: Job) -> str:
    """The plan of the next pass, without running it."""
    state = job.positions.get(job.key)
    plan = job.apply(job.target.read(), job.transform(job.read(state.position, state.intent).rows))
    return plan._jdf.queryExecution().explainString(plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
