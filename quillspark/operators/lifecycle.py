"""Changes: their states, queue, board and allowed steps; and job lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import latest
from .search import clamp
from .work import CHANGE_STATES, state_of

# Which column each last event stands for.
BOARD = {"change-started": "running", "check-started": "running", "change-review": "review", "change-blocked": "blocked", "check-failed": "blocked", "change-ready": "ready", "check-passed": "ready", "change-closed": "closed"}
#: The states from which a task may take each step.
STEPS = {"claimed": ("planned",), "started": ("claimed",), "review": ("running", "ready"), "ready": ("blocked", "review"), "closed": ("review", "ready")}
#: The steps that open dependencies hold up.
HELD = ("claimed", "started", "closed")


def change_states(changes: DataFrame, events: DataFrame) -> DataFrame:
    """(change, status) by the last event of a change; planned without one. ``events``: event_id, ts, change, kind."""
    last = latest(events.where(F.col("kind").isin(*CHANGE_STATES)), ["change"], "ts", "event_id").select("change", state_of(F.col("kind"), CHANGE_STATES).alias("__status"))
    return changes.join(last, "change", "left").select("change", F.coalesce("__status", F.lit("planned")).alias("status"))


def change_queue(states: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(change, status, queue, n_blockers): planned changes whose dependencies
    (change, needs) are all closed are ready, unclosed ones with others are
    blocked, the rest is in no queue."""
    known = states.select(F.col("change").alias("needs"), F.col("status").alias("__needed"))
    open_ = dependencies.join(known, "needs", "left").where("__needed is null or __needed <> 'closed'").groupBy("change").agg(F.count("needs").alias("n_blockers"))
    df = states.join(open_, "change", "left").withColumn("n_blockers", F.coalesce("n_blockers", F.lit(0)).cast("long"))
    queue = F.when((F.col("status") == "planned") & (F.col("n_blockers") == 0), "ready").when((F.col("status") != "closed") & (F.col("n_blockers") > 0), "blocked")
    return df.select("change", "status", queue.alias("queue"), "n_blockers")


def work_queue(states: DataFrame, dependencies: DataFrame, tasks: DataFrame, task_needs: DataFrame) -> DataFrame:
    """(kind, change, task, status, queue, reasons): the tasks of changes that
    have any, and the other changes themselves, as far as they are ready or blocked.

    ``states``: change, status. ``dependencies``: change, needs. ``tasks``:
    change, task, status. ``task_needs``: change, task, needs (a task of the
    change). What holds a change up holds up its tasks; a missing or unclosed
    need is a reason. Planned items without reasons are ready, unclosed ones
    with reasons blocked.
    """

    def held(rows: DataFrame, known: DataFrame, by: list[str], on: list[str]) -> DataFrame:
        met = rows.join(known, on, "left").where("__needed is null or __needed <> 'closed'")
        reason = F.when(F.col("__needed").isNull(), F.concat(F.lit("missing "), F.col("needs").cast("string"))).otherwise(F.concat(F.lit("waits for "), F.col("needs").cast("string")))
        return met.groupBy(*by).agg(F.collect_set(reason).alias("reasons"))

    of_change = held(dependencies, states.select(F.col("change").alias("needs"), F.col("status").alias("__needed")), ["change"], ["needs"]).withColumnRenamed("reasons", "outer")
    of_task = held(task_needs, tasks.select("change", F.col("task").alias("needs"), F.col("status").alias("__needed")), ["change", "task"], ["change", "needs"])
    none = F.array().cast("array<string>")
    each = tasks.select(F.lit("task").alias("kind"), "change", "task", "status").join(of_task, ["change", "task"], "left")
    whole = states.join(tasks.select("change").distinct(), "change", "left_anti").select(F.lit("change").alias("kind"), "change", F.lit(None).cast(tasks.schema["task"].dataType).alias("task"), "status", F.lit(None).cast("array<string>").alias("reasons"))
    df = each.select(*whole.columns).unionByName(whole).join(of_change, "change", "left")
    df = df.withColumn("reasons", F.sort_array(F.array_distinct(F.concat(F.coalesce("reasons", none), F.coalesce("outer", none))))).drop("outer")
    queue = F.when((F.col("status") == "planned") & (F.size("reasons") == 0), "ready").when((F.col("status") != "closed") & (F.size("reasons") > 0), "blocked")
    return df.withColumn("queue", queue).where("queue is not null").select("kind", "change", "task", "status", "queue", "reasons")


def _listed(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def task_step_issues(kind: Column, change_status: Column, task_status: Column, n_blockers: Column, checks_passed: Column) -> Column:
    """All that keeps a task from taking a step; empty where nothing does. What
    ends the matter stands alone; else the status comes first, then the rest."""
    wrong = F.coalesce(*[F.when(kind == k, ~task_status.isin(*v)) for k, v in STEPS.items()], F.lit(False))
    held, unchecked = kind.isin(*HELD) & (n_blockers > 0), (kind == "closed") & ~checks_passed
    hint = (
        F.when((kind == "started") & ~held, "claim it first")
        .when(kind == "review", "start it and complete its checks first")
        .when(kind == "ready", "only blocked or reviewed tasks can be ready")
        .when((kind == "closed") & wrong, "move it to review first")
    )
    every = _listed(F.concat(F.lit("status is "), task_status), F.when(held, "open dependencies"), hint, F.when(unchecked, "checks must pass"))
    return (
        F.when(task_status.isNull(), F.array(F.lit("unknown task")))
        .when(change_status == "closed", F.array(F.lit("the change is closed")))
        .when(task_status == "closed", F.array(F.lit("the task is closed")))
        .when(wrong | held | unchecked, every)
        .otherwise(F.array().cast("array<string>"))
    )


def change_step_issues(kind: Column, status: Column, n_unfinished: Column) -> Column:
    """All that keeps a change from taking a step; empty where nothing does."""
    return _listed(
        F.when((kind == "started") & (status == "closed"), "the change is closed"),
        F.when(kind.isin("review", "closed") & (n_unfinished > 0), "unfinished tasks"),
        F.when((kind == "closed") & ~status.isin("review", "ready"), F.concat(F.lit("status is "), status, F.lit("; move it to review first"))),
        F.when(~kind.isin("started", "review", "closed", "ready") & (status == "closed"), "the change is closed"),
    )


def board(changes: DataFrame, events: DataFrame, errors: DataFrame, tasks: DataFrame) -> DataFrame:
    """(change, column) of a board. A change's own last event (by time alone;
    of equal times the greatest kind) counts first, unless it is none or
    blocked; then error findings (change), then its tasks (change, status, blocked).
    Events of tasks are left out. All sides are aggregated by change before they meet."""
    own = events.where(~F.col("kind").startswith("task-")).groupBy("change").agg(F.max(F.struct("ts", "kind")).alias("last")).select("change", state_of(F.col("last.kind"), BOARD).alias("__by_event"))
    has = lambda test: F.max(F.expr(test).cast("int"))
    sums = tasks.groupBy("change").agg(
        has("status = 'blocked' or blocked").alias("__blocked"), has("status in ('running', 'claimed')").alias("__running"), has("status = 'review'").alias("__review"),
        F.min(F.expr("status = 'closed'").cast("int")).alias("__closed"), has("status = 'ready'").alias("__ready"),
    )
    df = changes.join(own, "change", "left").join(errors.select("change", F.lit(1).alias("__error")).distinct(), "change", "left").join(sums, "change", "left")
    column = (
        F.when(F.col("__by_event").isin("closed", "ready", "review", "running"), F.col("__by_event"))
        .when(F.col("__error").isNotNull() | (F.col("__by_event") == "blocked") | (F.col("__blocked") == 1), "blocked")
        .when(F.col("__running") == 1, "running")
        .when(F.col("__review") == 1, "review")
        .when((F.col("__closed") == 1) | (F.col("__ready") == 1), "ready")
        .otherwise("planned")
    )
    return df.select("change", column.alias("column"))


def jobs(rows: DataFrame, limit: int, statuses: list[str] | None = None) -> DataFrame:
    """Jobs of some states (all, if none is named), last changed first; 1 to 500."""
    rows = rows if statuses is None else rows.where(F.col("status").isin(*statuses))
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(clamp(limit, 500))


def admitted_pairs(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs (position, id) with the event (position, job_id) of the same place, and whether it names the run."""
    return runs.join(events, "position", "full_outer").withColumn("valid", F.coalesce(F.col("id") == F.col("job_id"), F.lit(False)))
