"""C. Run ledger: fold an event log to current state, refuse stale writers, follow ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

_KEY = ["migration_no", "step_no"]


def ledger_upsert(ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """A new snapshot of the ledger: planned steps that it lacks are added as pending; of the others only the kind is refreshed."""
    new = plan.select(*_KEY, F.col("kind").alias("__kind"), F.col("checksum").alias("__checksum"))
    both = ledger.withColumn("__there", F.lit(True)).join(new, _KEY, "full_outer")
    there = F.coalesce("__there", F.lit(False))
    keep = lambda c, fresh: F.when(there, F.col(c)).otherwise(fresh).alias(c)
    return both.select(*_KEY, F.coalesce("__kind", "kind").alias("kind"), keep("status", F.lit("pending")), keep("attempts", F.lit(0).cast("long")), keep("checksum", F.col("__checksum")))


def ledger_fold(events: DataFrame) -> DataFrame:
    """Current row of each step from its events. Partial aggregation only; the order of arrival does not matter.

    attempts counts transitions to running, and terminal ones that no running preceded count nothing; started is the
    last running, finished the last terminal event; error is that of the last status change.
    """
    seq, is_status = F.col("seq"), F.col("event") != "checkpoint"
    when = lambda cond, c: F.max_by(F.when(cond, F.col(c)), F.when(cond, seq))
    return events.groupBy(*_KEY).agg(
        F.coalesce(when(is_status, "event"), F.lit("pending")).alias("status"),
        F.count_if(F.col("event") == "running").alias("attempts"),
        F.coalesce(when(is_status, "error"), F.lit("")).alias("error"),
        when(F.col("event") == "running", "at_ts").alias("started"),
        when(F.col("event").isin("succeeded", "failed"), "at_ts").alias("finished"),
        when(F.col("position").isNotNull(), "position").alias("checkpoint"),
    )


def status_report(state: DataFrame | None, plan: DataFrame) -> DataFrame:
    """The ledger's rows in plan order, the checkpoint as JSON text. Without a ledger: empty."""
    if state is None:
        return plan.select(*_KEY).limit(0)
    text = F.coalesce(F.to_json(F.when(F.col("checkpoint").isNotNull(), F.struct(F.col("checkpoint").alias("cursor")))), F.lit(""))
    return state.select(*_KEY, "status", "attempts", "error", text.alias("checkpoint")).orderBy(*_KEY)


def run_summary(results: DataFrame) -> DataFrame:
    """(job, run_no, migrations, steps_total, applied, skipped, repaired, duration_us); a repair counts even if the step is then skipped.

    The steps themselves stay rows, those of results, so that a long run is no single value.
    """
    counts = {"applied": F.col("outcome") == "applied", "skipped": F.col("outcome") == "skipped", "repaired": F.col("repaired")}
    each = results.groupBy("job", "run_no", "migration_no").agg(F.count("*").alias("steps_total"), *[F.count_if(c).alias(name) for name, c in counts.items()], F.sum("took_us").alias("duration_us"))
    return each.groupBy("job", "run_no").agg(F.count("*").alias("migrations"), *[F.sum(c).alias(c) for c in ("steps_total", *counts, "duration_us")])


def convergence_check(summary: DataFrame) -> DataFrame:
    """(job, run_no, converged): a run after another applies and repairs nothing."""
    w = Window.partitionBy("job").orderBy("run_no")
    return summary.withColumn("__prior", F.lag("run_no").over(w)).where("__prior is not null").select("job", "run_no", ((F.col("applied") == 0) & (F.col("repaired") == 0)).alias("converged"))


def reconcile_candidates(ledger: DataFrame) -> DataFrame:
    """Steps that any runner has worked on: to be checked again, never proof."""
    return ledger.where((F.col("attempts") > 0) | F.col("status").isin("running", "failed"))


#: Consecutive rows by seq, and microseconds, that are one run: windows stay within runs, and what a run must know of
#: earlier ones comes from a table with a row for each run.
RUN_ROWS, RUN_US = 65_536, 3_600_000_000


def stale_writer_filter(writes: DataFrame, run: int = RUN_ROWS) -> DataFrame:
    """writes (seq, resource, owner, epoch) with accepted: the epoch is the highest so far and its first writer owns it.

    A resource with most of the rows is many runs, so it is no single task.
    """
    rows = writes.withColumn("__run", F.floor(F.col("seq") / run))
    earlier = Window.partitionBy("resource").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("resource", "__run").agg(F.max("epoch").alias("__m")).select("resource", "__run", F.max("__m").over(earlier).alias("__before"))
    takers = writes.groupBy("resource", "epoch").agg(F.min_by("owner", "seq").alias("__taker"))
    inside = Window.partitionBy("resource", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("__top", F.max("epoch").over(inside)).join(tops, ["resource", "__run"]).join(takers, ["resource", "epoch"])
    accepted = (F.col("epoch") == F.greatest("__top", "__before")) & (F.col("owner") == F.col("__taker"))
    return seen.withColumn("accepted", accepted).select(*writes.columns, "accepted")


def _last_before(rows: DataFrame, state: Column, counts: Column, run_us: int) -> DataFrame:
    """rows (resource, at_us, seq, __run) with __prior: the state of the last earlier row that counts.

    Rows look back within their run; the last state of earlier runs comes from a table with a row for each run.
    """
    key, place = ["resource", "__run"], F.struct("at_us", "seq")
    over_runs = Window.partitionBy("resource").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key).orderBy("at_us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key).agg(F.max_by(F.when(counts, state), F.when(counts, place)).alias("__s")).select(*key, F.last("__s", ignorenulls=True).over(over_runs).alias("__earlier"))
    here = F.last(F.when(counts, state), ignorenulls=True).over(inside)
    return rows.withColumn("__here", here).join(ends, key).withColumn("__prior", F.coalesce("__here", "__earlier")).drop("__here", "__earlier")


def releases(events: DataFrame, ttl_us: int, run_us: int = RUN_US) -> DataFrame:
    """The release events (kind 'release') with accepted, and held_at and held_seq, the beat that an accepted one ends.

    A release counts if its owner and epoch are those of the last beat before it, that beat is no older than the ttl,
    and it is the first release after it. Any other, a stale one, is refused and changes nothing.
    """
    rows = events.withColumn("__run", F.floor(F.col("at_us") / run_us))
    asked = _last_before(rows, F.struct("owner", "epoch", "at_us", "seq"), F.col("kind") != "release", run_us).where("kind = 'release'")
    fits = F.coalesce((F.col("__prior.owner") == F.col("owner")) & (F.col("__prior.epoch") == F.col("epoch")) & (F.col("at_us") - F.col("__prior.at_us") <= ttl_us), F.lit(False))
    beat = [F.when(fits, F.col("__prior.at_us")).alias("held_at"), F.when(fits, F.col("__prior.seq")).alias("held_seq")]
    asked = asked.select(*events.columns, *beat)
    first = asked.where("held_seq IS NOT NULL").groupBy("resource", "held_at", "held_seq").agg(F.min(F.struct("at_us", "seq")).alias("__first"))
    joined = asked.join(first, ["resource", "held_at", "held_seq"], "left")
    return joined.select(*events.columns, F.coalesce(F.col("__first") == F.struct("at_us", "seq"), F.lit(False)).alias("accepted"), "held_at", "held_seq")


def ownership_intervals(beats: DataFrame, ttl_us: int, run_us: int = RUN_US) -> DataFrame:
    """(resource, owner, epoch, started, ended, beats, how): who held what, from when to when; how: lost, expired or released.

    beats: seq, resource, owner, epoch, at_us and, if there are releases among them, kind. A beat by another owner or
    epoch, after a gap of more than the ttl, or after an accepted release, begins a new interval. An interval lasts
    until its release, its last beat plus the ttl, or until the next one begins. An interval is known by the place of
    its first beat; rows look back within their run, and to the last row and the last beginning of earlier runs, so
    that a resource with most of the beats is no single task.
    """
    place, key = F.struct("at_us", "seq"), ["resource", "__run"]
    over_runs = Window.partitionBy("resource").orderBy("__run")
    inside = Window.partitionBy(*key).orderBy("at_us", "seq")
    released = F.lit(None).cast("long")
    if "kind" in beats.columns:
        done = releases(beats, ttl_us, run_us).where("accepted").select("resource", F.col("held_at").alias("at_us"), F.col("held_seq").alias("seq"), F.col("at_us").alias("__released"))
        beats = beats.where("kind IS NULL OR kind <> 'release'").join(done, ["resource", "at_us", "seq"], "left")
        released = F.col("__released")
    rows = beats.withColumn("__released", released).withColumn("__run", F.floor(F.col("at_us") / run_us))
    rows = _last_before(rows, F.struct("owner", "epoch", "at_us", "__released"), F.lit(True), run_us)
    prior = F.col("__prior")
    fresh = F.coalesce((prior["owner"] != F.col("owner")) | (prior["epoch"] != F.col("epoch")) | (F.col("at_us") - prior["at_us"] > ttl_us) | prior["__released"].isNotNull(), F.lit(True))
    rows = rows.withColumn("__begun", F.when(fresh, place)).drop("__prior")
    begun = rows.groupBy(*key).agg(F.max("__begun").alias("__b")).select(*key, F.last("__b", ignorenulls=True).over(over_runs.rowsBetween(Window.unboundedPreceding, -1)).alias("__open"))
    rows = rows.withColumn("__own", F.last("__begun", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(begun, key)
    spans = rows.groupBy("resource", F.coalesce("__own", "__open").alias("__start")).agg(F.first("owner").alias("owner"), F.first("epoch").alias("epoch"), F.min("at_us").alias("started"), F.max("at_us").alias("__end"), F.max("__released").alias("__released"), F.count("*").alias("beats"))
    spans = spans.withColumn("__run", F.floor(F.col("started") / run_us))
    firsts = spans.groupBy(*key).agg(F.min("started").alias("__f")).select(*key, F.lead("__f").over(over_runs).alias("__after"))
    following = F.coalesce(F.lead("started").over(Window.partitionBy(*key).orderBy("__start")), "__after")
    spans = spans.join(firsts, key).withColumn("__next", following)
    expiry = F.col("__end") + ttl_us
    ended = F.coalesce("__released", F.least(expiry, F.coalesce("__next", expiry)))
    how = F.when(F.col("__released").isNotNull(), "released").when(F.col("__next") <= expiry, "lost").otherwise("expired")
    return spans.select("resource", "owner", "epoch", "started", ended.alias("ended"), "beats", how.alias("how"))


def overlapping_owners(intervals: DataFrame, run_us: int = RUN_US) -> DataFrame:
    """intervals that begin while an earlier one of another owner is open (must be none), with others_open.

    No theta join: beginnings and ends are put in order, and the open intervals of all owners and of the own one are
    counted as they pass, within runs of time.
    """
    begin = intervals.select("resource", "owner", "started", "ended", F.col("started").alias("t_"), F.lit(1).alias("d_"))
    finish = intervals.select("resource", "owner", "started", "ended", F.col("ended").alias("t_"), F.lit(-1).alias("d_"))
    order, run = ["t_", "d_", "started", "ended", "owner"], F.floor(F.col("t_") / run_us)
    both = running(begin.unionByName(finish), ["resource"], run, order, every_=("sum", F.col("d_")))
    both = running(both, ["resource", "owner"], run, order, own_=("sum", F.col("d_")))
    counted = both.withColumn("others_open", F.coalesce("every_", F.lit(0)) - F.coalesce("own_", F.lit(0)))
    return counted.where("d_ = 1 and others_open > 0").select("resource", "owner", "started", "ended", "others_open")


#: Consecutive migrations that are numbered together.
MIGRATIONS = 1024


def step_order_and_numbering(plan: DataFrame, width: int = MIGRATIONS) -> DataFrame:
    """plan with position and total within its database's plan; numbered within ranges of migrations."""
    placed = running(plan, ["db"], F.floor(F.col("migration_no") / width), ["migration_no", "step_no"], before_=("sum", F.lit(1)))
    totals = plan.groupBy(F.col("db").alias("db_")).agg(F.count("*").alias("total"))
    numbered = placed.withColumn("position", (F.coalesce("before_", F.lit(0)) + 1).cast("int")).drop("before_")
    return numbered.join(totals, F.col("db").eqNullSafe(F.col("db_"))).drop("db_")
