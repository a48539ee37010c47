"""Work states from events: tasks, checks, leases, queues; and trace and metric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import latest

# Which state each last event stands for.
TASK_STATES = {"closed": "closed", "ready": "ready", "review": "review", "blocked": "blocked", "check-failed": "blocked", "started": "running", "check-started": "running", "claimed": "claimed"}
CHANGE_STATES = {"closed": "closed", "ready": "ready", "check-passed": "ready", "review": "review", "blocked": "blocked", "check-failed": "blocked", "started": "running", "check-started": "running"}
CHECK_STATES = {"check-started": "running", "check-passed": "passed", "check-failed": "failed"}


def state_of(kind: Column, states: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in states.items()])


def active_leases(leases: DataFrame) -> DataFrame:
    """The lease of each task that was renewed last, of those that are active."""
    return latest(leases.where("status = 'active'"), ["task"], "updated_at", "lease_id")


def expired(leases: DataFrame, now: Column) -> DataFrame:
    """Active leases past their time become stale."""
    return leases.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") <= now), "stale").otherwise(F.col("status")))


def claims(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Requests (task, agent) with ``action``: claimed where no lease is
    active, renewed for its owner, else conflict."""
    held = active_leases(leases).select("task", F.col("agent").alias("holder"))
    action = F.when(F.col("holder").isNull(), "claimed").when(F.col("holder") == F.col("agent"), "renewed").otherwise("conflict")
    return requests.join(held, "task", "left").withColumn("action", action)


def task_states(tasks: DataFrame, events: DataFrame, leases: DataFrame) -> DataFrame:
    """(task, status): by an active lease that nothing but a claim followed,
    by the last event, by the checks, else planned.

    ``tasks``: task, checks array; ``events``: event_id, ts, task, check (null
    for the task's own), kind. All latest-of-key steps are aggregations.
    """
    own = latest(events.where(F.col("kind").isin(*TASK_STATES)), ["task"], "ts", "event_id").select("task", F.col("kind").alias("__last"))
    checks = latest(events.where(F.col("check").isNotNull()), ["task", "check"], "ts", "event_id").select("task", "check", state_of(F.col("kind"), CHECK_STATES).alias("__state"))
    each = tasks.select("task", F.explode("checks").alias("check")).join(checks, ["task", "check"], "left").groupBy("task")
    sums = each.agg(F.max((F.coalesce("__state", F.lit("")) == "failed").cast("int")).alias("__failed"), F.max((F.coalesce("__state", F.lit("")) == "running").cast("int")).alias("__running"), F.min((F.coalesce("__state", F.lit("")) == "passed").cast("int")).alias("__passed"))
    held = active_leases(leases).select("task", F.lit(True).alias("__held"))
    df = tasks.join(own, "task", "left").join(sums, "task", "left").join(held, "task", "left")
    by_checks = F.when(F.col("__failed") == 1, "blocked").when(F.col("__running") == 1, "running").when(F.col("__passed") == 1, "ready")
    claimed = F.col("__held") & (F.col("__last").isNull() | (F.col("__last") == "claimed"))
    status = F.when(claimed, "claimed").otherwise(F.coalesce(state_of(F.col("__last"), TASK_STATES), by_checks, F.lit("planned")))
    return df.select("task", status.alias("status"), F.coalesce("__held", F.lit(False)).alias("leased"))


def blockers(states: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(task, blocker, reason) of dependencies that are missing or not closed."""
    known = states.select(F.col("task").alias("needs"), F.col("status").alias("__status"))
    df = dependencies.join(known, "needs", "left").where("__status is null or __status <> 'closed'")
    return df.select("task", F.col("needs").alias("blocker"), F.when(F.col("__status").isNull(), "missing").otherwise("open").alias("reason"))


def queue(states: DataFrame, blocked_by: DataFrame) -> DataFrame:
    """(task, status, ready, n_blockers): planned, not leased and without blockers is ready."""
    n = blocked_by.groupBy("task").agg(F.count("blocker").alias("n_blockers"))
    df = states.join(n, "task", "left").withColumn("n_blockers", F.coalesce("n_blockers", F.lit(0)))
    return df.select("task", "status", ((F.col("status") == "planned") & ~F.col("leased") & (F.col("n_blockers") == 0)).alias("ready"), "n_blockers")


def sampled(parent: Column, trace_id: Column, ratio: float) -> Column:
    """As the parent span was, else by the trace id's low bits."""
    from ..functions.text import trace_sampled

    return F.coalesce(parent, trace_sampled(trace_id, ratio))


def bounded_attributes(attributes: Column, most: int = 64, overflow: str = "otel.metric.overflow") -> Column:
    """A map's first ``most`` entries by key; one fewer, and the overflow mark, where it has more."""
    entries = F.sort_array(F.map_entries(attributes))
    kept = F.map_from_entries(F.slice(entries, 1, most - 1))
    return F.when(F.size(entries) > most, F.map_concat(kept, F.create_map(F.lit(overflow), F.lit("true")))).otherwise(F.map_from_entries(entries))
