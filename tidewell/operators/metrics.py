"""Reports over run logs: totals, percentiles, histograms, batches, retention, queue, lag.

A run has run_id, task, mapping, status, enqueued_at, started_at, ended_at, rows_read.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import block_of

SUCCEEDED, FAILED = "Succeeded", "Failed"
#: What a run read and wrote; runs that don't tell have no such totals.
ROWS = ("rows_read", "rows_written")
#: An item in flight keeps others of its key out of the queue.
QUEUE_KEY = ("task", "kind", "mapping", "segment")


def milliseconds(start: Column, end: Column) -> Column:
    """From start to end, never less than 0."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.greatest(F.floor(micros / 1000), F.lit(0)).cast("long")


def totals(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == SUCCEEDED).alias("succeeded"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ROWS if c in runs.columns],
    )


def percentiles(runs: DataFrame, value: str, *by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles and the maximum of a number: the value of rank ceil(p * n). Values
    are counted, then ranges of values; a running count over a group's ranges, which are by rank,
    tells the range that a rank lies in, and only that range's values are put in order."""
    block = block_of(runs, value)
    counts = runs.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("block", block("v"))
    ranges = counts.groupBy(*by, "block").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    ranges = ranges.select(*by, "block", (F.sum("n").over(group.orderBy("block")) - F.col("n")).alias("before"), F.col("n").alias("here"), F.sum("n").over(group).alias("all"))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.greatest(F.ceil(F.col("all") * p), F.lit(1)).alias("rank")) for p in shares]))
    ranges = ranges.select("*", wanted.alias("w")).filter("w.rank > before AND w.rank <= before + here")
    met = counts.join(ranges.drop("here", "all"), [*by, "block"])
    order = Window.partitionBy(*by, "w.share").orderBy("v")
    reached = met.withColumn("upto", F.col("before") + F.sum("n").over(order)).filter("upto >= w.rank")
    found = reached.groupBy(*by).agg(*[F.min(F.when(F.col("w.share") == p, F.col("v"))).cast("double").alias(f"p{round(p * 100)}") for p in shares])
    most = runs.groupBy(*by).agg(F.max(value).cast("double").alias("max"))
    return most.join(found, list(by), "left") if by else most.crossJoin(found)  # one row each


def overview(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """totals, percentiles of a number, last completion and last enqueueing of each group."""
    found = totals(runs, *by)
    for more in (percentiles(runs, value, *by), last_completed(runs, *by), latest_enqueued(runs, *by)):
        found = found.join(more, list(by), "left")
    return found


def histogram(runs: DataFrame, at: str, start: dt.datetime, end: dt.datetime, buckets: int) -> DataFrame:
    """Runs in so many equal spans from start to end (1 to 200), empty ones too."""
    n = min(max(buckets, 1), 200)
    width = max((end - start) // dt.timedelta(microseconds=1) // n, 1)
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    micros = F.timestamp_diff("MICROSECOND", low, F.col(at))
    number = F.least(F.greatest(F.floor(micros / width), F.lit(0)), F.lit(n - 1)).cast("int")
    written = [c for c in ROWS[1:] if c in runs.columns]
    inside = runs.filter((F.col(at) >= low) & (F.col(at) < high))
    counted = inside.groupBy(number.alias("bucket")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == FAILED).alias("failed"), *[F.sum(c).cast("long").alias(c) for c in written])
    every = runs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counted, "bucket", "left").select("bucket", zero("runs"), zero("failed"), *map(zero, written))


def last_completed(runs: DataFrame, *by: str) -> DataFrame:
    return runs.filter(F.col("status") == SUCCEEDED).groupBy(*by).agg(F.max("ended_at").alias("last_completed"))


def latest_enqueued(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.max("enqueued_at").alias("latest_enqueued"))


def read_since(runs: DataFrame, cutoffs: DataFrame, by: str) -> DataFrame:
    """Rows read by runs that ended strictly after their mapping's cutoff (column since)."""
    met = runs.join(cutoffs, by).filter(F.col("ended_at") > F.col("since"))
    return met.groupBy(by).agg(F.sum("rows_read").cast("long").alias("rows_read"))


def batch_progress(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """Each batch (batch_id, segments) with its runs' outcome: Running until all segments
    ended, then Completed or CompletedWithFailures."""
    met = batches.join(runs, "batch_id", "left").groupBy("batch_id", "segments").agg(
        F.count_if(F.col("status") == SUCCEEDED).alias("succeeded"), F.count_if(F.col("status") == FAILED).alias("failed")
    )
    state = (
        F.when(F.col("succeeded") + F.col("failed") < F.col("segments"), "Running")
        .when(F.col("failed") > 0, "CompletedWithFailures")
        .otherwise("Completed")
    )
    return met.withColumn("state", state)


def doomed(runs: DataFrame, by: list[str], older_than: dt.datetime | None = None, most: int | None = None) -> DataFrame:
    """Ended runs beyond a mapping's number of kept ones, or too old; none without a limit."""
    ended = runs.filter(F.col("ended_at").isNotNull())
    if older_than is None and most is None:
        return ended.limit(0)
    test = F.lit(False)
    if older_than is not None:
        test = test | (F.col("enqueued_at") < F.lit(older_than).cast("timestamp_ntz"))
    if most is None:
        return ended.filter(test)
    last = kept_from(ended, by, most).alias("l")
    met = ended.alias("r").join(last, reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]), "left")
    first = F.struct(F.col("r.enqueued_at"), F.col("r.run_id"))
    beyond = F.coalesce(first < F.struct(F.col("l.__at"), F.col("l.__id")), F.lit(False))
    return met.filter(test | beyond).select("r.*")


def kept_from(ended: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first run, in order of (enqueued_at, run_id), of each group's last most ones: __at and __id.
    Groups with no more than that have none. Runs are counted by ranges of time; a running count
    over a group's ranges, from the last, finds the range that the threshold lies in, and only that
    range's runs are ranked. No group is ever sorted whole."""
    if most < 1:
        groups = ended.select(*by).distinct()
        return groups.select(*by, F.lit("9999-12-31 00:00:00").cast("timestamp_ntz").alias("__at"), F.lit(2**63 - 1).alias("__id"))
    moment = F.unix_micros(F.col("enqueued_at").cast("timestamp"))
    timed = ended.select(*by, "enqueued_at", "run_id", moment.alias("__t"))
    timed = timed.withColumn("__range", block_of(timed, "__t")("__t"))
    ranges = timed.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy(F.desc("__range"))
    later = (F.sum("__n").over(order) - F.col("__n")).alias("__later")
    found = ranges.select(*by, "__range", later, "__n").filter((F.col("__later") < most) & (F.col("__later") + F.col("__n") >= most))
    met = timed.alias("r").join(
        F.broadcast(found).alias("f") if _few(found) else found.alias("f"),
        reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*by, "__range"]]),
    )
    inside = Window.partitionBy(*[F.col(f"r.{c}") for c in by]).orderBy(F.desc("r.enqueued_at"), F.desc("r.run_id"))
    ranked = met.withColumn("__rank", F.col("__later") + F.row_number().over(inside)).filter(F.col("__rank") == most)
    return ranked.select(*[F.col(f"r.{c}").alias(c) for c in by], F.col("r.enqueued_at").alias("__at"), F.col("r.run_id").alias("__id"))


def _few(groups: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one row for each group is small enough to broadcast; counted."""
    return groups.limit(most + 1).count() <= most


def retained(runs: DataFrame, by: list[str], older_than: dt.datetime | None = None, most: int | None = None) -> DataFrame:
    return runs.join(doomed(runs, by, older_than, most).select("run_id"), "run_id", "left_anti")


def keyset_page(rows: DataFrame, at: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The next rows, newest first, after a (time, key) cursor; one more than the limit tells
    that there are more. A top-n: nothing else is sorted."""
    if after is not None:
        t, k = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.filter((F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < k)))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)


def feed(rows: DataFrame, key: str, since: int) -> DataFrame:
    return rows.filter(F.col(key) > since)


def unread(notes: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each user's cursor (user, seen), how many notes (id) are beyond it. Cursors with one
    value are answered together; a value's answer is what follows it in the order of ids:
    within its block of ids, and in all later blocks, of which there is a bounded number."""
    marks = notes.select("id", F.lit(1).alias("note")).unionByName(
        cursors.select(F.col("seen").alias("id"), F.lit(0).alias("note")).distinct()
    )
    marks = marks.withColumn("block", block_of(marks, "id")("id"))
    after = Window.partitionBy("block").orderBy(F.desc("id")).rangeBetween(Window.unboundedPreceding, -1)
    here = marks.withColumn("here", F.coalesce(F.sum("note").over(after), F.lit(0))).filter("note = 0")
    blocks = marks.groupBy("block").agg(F.sum("note").alias("n"))
    later = F.sum("n").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("block", F.coalesce(later, F.lit(0)).alias("later"))
    answers = here.join(blocks, "block").select(F.col("id").alias("seen"), (F.col("here") + F.col("later")).alias("unread"))
    return cursors.join(answers, "seen").select("user", "seen", "unread")


def claim(queue: DataFrame, now: dt.datetime) -> DataFrame:
    """The next item to run: pending, available, and no other of its task, kind, mapping and
    segment is claimed or running; by priority, then age, then id."""
    busy = queue.filter(F.col("state").isin("Claimed", "Running")).select(*_key(queue)).distinct()
    free = queue.filter((F.col("state") == "Pending") & (F.col("available_at") <= F.lit(now).cast("timestamp_ntz")))
    return _without(free, busy).orderBy(F.desc("priority"), "enqueued_at", "item_id").limit(1)


def put(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with items added, but those whose (task, kind, mapping, segment) is in flight.
    Of several new items of one key the first by id goes in."""
    flying = queue.filter(F.col("state").isin("Pending", "Claimed", "Running")).select(*_key(queue)).distinct()
    first = F.min_by(F.struct(*[F.col(c) for c in items.columns]), "item_id").alias("first")
    once = items.groupBy(*_key(items)).agg(first).select("first.*")
    return queue.unionByName(_without(once, flying))


def _key(rows: DataFrame) -> list[Column]:
    """The key of items as columns __0 and on; no segment is a value, too."""
    some = [c for c in QUEUE_KEY if c in rows.columns]
    return [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c == "segment" else F.col(c)).alias(f"__{i}") for i, c in enumerate(some)]


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    named = rows.select("*", *_key(rows))
    return named.join(keys, keys.columns, "left_anti").select(*rows.columns)


def exact_lag(positions: DataFrame) -> DataFrame:
    """Milliseconds from what a mapping has applied to its source's last change, at least 0."""
    return positions.withColumn("lag_ms", milliseconds(F.col("applied_at"), F.col("source_at")))


def reader_lag(positions: DataFrame, checks: DataFrame) -> DataFrame:
    """One answer for each mapping of positions (id, grp, kind, applied, applied_at) from the checks of its
    source's group (grp, value, at, source_at): id, supported, exact_ms, versions_behind,
    estimated_ms, as_of.

    kind "log": the time of the group's latest check that has one, less the time applied; without either
    there is no figure. kind "version": the latest check's version less the applied one, and, where
    both their commit times are known, that time; else an estimate, from the first check that had reached
    the applied version to the latest one. Never less than 0. A mapping without a position, or whose
    group was never checked, has no figures; other kinds aren't supported.

    Each group's latest checks come from one aggregation, the crossings from one window over
    (grp, range of values)."""
    latest = checks.groupBy("grp").agg(
        F.max_by(F.struct("value", "at", "source_at"), F.struct("at", "value")).alias("last"),
        F.max_by("source_at", F.when(F.col("source_at").isNotNull(), F.struct("at", "value"))).alias("timed"),
    )
    met = positions.join(latest, "grp", "left")
    log, version = F.col("kind") == "log", F.col("kind") == "version"
    known, seen = F.col("applied").isNotNull(), F.col("last").isNotNull()
    source_at = F.when(log, F.col("timed")).otherwise(F.when(F.col("last.value").isNotNull(), F.col("last.source_at")))
    exact = F.when(known & (log | version) & F.col("applied_at").isNotNull() & source_at.isNotNull(), milliseconds(F.col("applied_at"), source_at))
    behind = F.when(known & version & F.col("last.value").isNotNull(), F.greatest(F.col("last.value") - F.col("applied"), F.lit(0)))
    as_of = F.when(known & log, F.col("timed")).when(known & version & seen, F.coalesce("last.source_at", "last.at"))
    told = met.select("id", "grp", "applied", (log | version).alias("supported"), exact.alias("exact_ms"), behind.alias("versions_behind"), as_of.alias("as_of"), F.col("last.at").alias("last_at"), (version & known & exact.isNull() & seen).alias("asks"))
    asked = told.filter("asks").select("id", "grp", F.col("applied").alias("value"))
    crossed = crossings(checks.select("grp", "value", "at"), asked)
    estimate = F.when(F.col("asks") & F.col("crossed_at").isNotNull(), milliseconds(F.col("crossed_at"), F.col("last_at")))
    return told.join(crossed, "id", "left").select("id", "supported", "exact_ms", "versions_behind", estimate.alias("estimated_ms"), "as_of")


def crossings(checks: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (id, grp, value): crossed_at, the time of the group's earliest check at or beyond the
    value. Values are put in ranges by rank: the earliest check of the later ranges comes from one row
    for each (grp, range), that of the value's own range from a window inside it."""
    none = F.lit(None)
    block = block_of(checks.select("value").unionByName(asked.select("value")), "value")
    marks = checks.filter("value IS NOT NULL").select("grp", "value", "at", none.cast("long").alias("id")).unionByName(
        asked.select("grp", "value", none.cast("timestamp_ntz").alias("at"), F.col("id").cast("long"))
    ).withColumn("b", block("value"))
    order = Window.partitionBy("grp", "b").orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, 0)
    here = marks.withColumn("here", F.min("at").over(order)).filter("id IS NOT NULL")
    heads = marks.groupBy("grp", "b").agg(F.min("at").alias("head"))
    beyond = Window.partitionBy("grp").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    later = heads.select("grp", "b", F.min("head").over(beyond).alias("later"))
    return here.join(later, ["grp", "b"]).select("id", F.least("here", "later").alias("crossed_at"))


def first_crossing(checks: DataFrame, positions: DataFrame) -> DataFrame:
    """For each target value of positions (id, target): the earliest check (value, at) that
    reached it, null where the oldest check had reached it already or none did. Checks grow
    with time, so the first one is that of the least value at or beyond the target. Values
    are put in ranges by rank: the range's own answer is found in it, or else it is the first
    check of a later one. Two shuffles, no range join."""
    lowest = checks.agg(F.min_by("value", "at").alias("v")).first()["v"]
    block = block_of(checks.select("value").unionByName(positions.select(F.col("target").alias("value"))), "value")
    marks = checks.select(block("value").alias("b"), "value", F.col("at"), F.lit(None).cast("long").alias("id")).unionByName(
        positions.select(block("target").alias("b"), F.col("target").alias("value"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("id").cast("long").alias("id"))
    )
    # within a block: the next check at or after the target
    order = Window.partitionBy("b").orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, 0)
    here = marks.withColumn("crossed", F.min("at").over(order)).filter("id IS NOT NULL")
    heads = checks.groupBy(block("value").alias("b")).agg(F.min("at").alias("head"))
    wanted = here.select("b").distinct().withColumn("head", F.lit(None).cast("timestamp_ntz"))
    both = heads.unionByName(wanted).groupBy("b").agg(F.max("head").alias("head"))
    later = both.withColumn("next", F.min("head").over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)))
    found = here.join(later.select("b", "next"), "b").withColumn("at", F.coalesce("crossed", "next"))
    known = F.col("value") > F.lit(lowest) if lowest is not None else F.lit(False)
    return found.select("id", F.col("value").alias("target"), F.when(known, F.col("at")).alias("crossed_at"))


def due(cron_next: dt.datetime | None, last: dt.datetime | None, now: dt.datetime) -> bool:
    """Whether a periodic job is to run: never run, or its next time after the last is past."""
    return last is None or (cron_next is not None and cron_next <= now)


def is_due(cron_next: Column, last: Column, now: dt.datetime) -> Column:
    """due() for each row."""
    return last.isNull() | F.coalesce(cron_next <= F.lit(now).cast("timestamp_ntz"), F.lit(False))


def reconcile_due(rows_since: int, last: dt.datetime | None, now: dt.datetime, trigger: str, cadence: dt.timedelta) -> bool:
    """Whether changes ask for a reconciliation: any rows since the last, but not too often."""
    if trigger == "none" or rows_since <= 0:
        return False
    return last is None or now - last >= cadence
