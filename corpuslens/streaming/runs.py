"""Maintenance runs: guarded state changes, start-up repair, idempotent enqueue, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("CANCELLED", "COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED")
ACTIVE = ("QUEUED", "RUNNING", "CANCELLING")
#: What a run may become from each state.
MOVES = {
    "QUEUED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("CANCELLING", "COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLED"),
    "CANCELLING": ("CANCELLED", "FAILED", "COMPLETED", "COMPLETED_WITH_WARNINGS"),
}


def may_move(state: Column, to: Column) -> Column:
    out = F.lit(False)
    for s, nexts in MOVES.items():
        out = out | ((state == s) & to.isin(*nexts))
    return out


def transition(runs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Runs after the changes in ``wanted`` (run_id, to) that their states allow; others are left as they are."""
    w = wanted.select("run_id", F.col("to").alias("_to"))
    ok = F.coalesce(may_move(F.col("status"), F.col("_to")), F.lit(False))
    rows = runs.join(w, "run_id", "left")
    started = F.when(ok & (F.col("_to") == "RUNNING"), now).otherwise(F.col("started_at"))
    ended = F.when(ok & F.col("_to").isin(*TERMINAL), now).otherwise(F.col("completed_at"))
    return rows.withColumns({"started_at": started, "completed_at": ended, "status": F.when(ok, F.col("_to")).otherwise(F.col("status"))}).drop("_to")


def repair(runs: DataFrame, now: Column) -> DataFrame:
    """After a restart: queued runs are cancelled, running ones have failed."""
    was = F.col("status")
    open_ = was.isin(*ACTIVE)
    status = F.when(was == "QUEUED", "CANCELLED").when(open_, "FAILED").otherwise(was)
    return runs.withColumns({"completed_at": F.when(open_, now).otherwise(F.col("completed_at")), "status": status})


def enqueue(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` that become runs: the first of each scope and operation that has no active run yet."""
    key = ["scope_type", "scope_id", "operation"]
    w = Window.partitionBy(*key).orderBy("queued_at", "run_id")
    first = requests.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    active = runs.filter(F.col("status").isin(*ACTIVE)).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = (F.col("scope_type") == F.col("_scope_type")) & F.col("scope_id").eqNullSafe(F.col("_scope_id")) & (F.col("operation") == F.col("_operation"))
    return first.join(active, same, "left_anti")


def delete_runs(runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs that are left, and (run_id, outcome) of each id asked for: deleted, skipped (it hasn't ended) or missing."""
    asked = ids.select("run_id").distinct()
    found = asked.join(runs.select("run_id", F.col("status").isin(*TERMINAL).alias("_ended")), "run_id", "left")
    outcomes = found.select("run_id", F.when(F.col("_ended").isNull(), "missing").when(F.col("_ended"), "deleted").otherwise("skipped").alias("outcome"))
    return runs.join(outcomes.filter("outcome = 'deleted'"), "run_id", "left_anti"), outcomes


def dispatch(runs: DataFrame) -> DataFrame:
    """The queued run that goes next, if none is running."""
    busy = runs.filter(F.col("status").isin("RUNNING", "CANCELLING")).limit(1).select(F.lit(True).alias("busy"))
    return runs.filter("status = 'QUEUED'").orderBy(F.col("queued_at").asc_nulls_first(), "created_at", "run_id").limit(1).join(F.broadcast(busy), how="left_anti", on=F.lit(True))


def outcome(counts: DataFrame) -> DataFrame:
    """Status, duration and failures of a finished run from its counts."""
    warned = (F.col("failed") > 0) & (F.col("parsed") + F.col("skipped") > 0)
    status = F.when(F.col("error").isNotNull(), "FAILED").when(warned, "COMPLETED_WITH_WARNINGS").when(F.col("failed") > 0, "FAILED").otherwise("COMPLETED")
    return counts.withColumns({"status": status, "duration_ms": F.greatest(F.lit(0), F.col("completed_at") - F.col("started_at")), "failures_json": F.to_json("failures")})


#: Milliseconds for which a cancellation that comes before its request is kept.
PENDING_MS = 30_000


def cancelled_requests(requests: DataFrame, cancels: DataFrame, pending: int = PENDING_MS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, started_at, cancelled): a request is cancelled by a cancel after its start, or within ``pending`` before it."""
    last = cancels.groupBy(F.col("request_id").alias("_r")).agg(F.max("at").alias("_at"))
    out = requests.join(last, F.col("request_id") == F.col("_r"), "left")
    return out.select("request_id", "started_at", *keep, F.coalesce(F.col("_at") >= F.col("started_at") - pending, F.lit(False)).alias("cancelled"))
