"""The stream of task states against the batch form, whatever the order of rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import work
from quillspark.streaming import tasks

SCHEMA = "task string, kind string, id string, at string, what string, check string, until string"


def clock(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = [f"t{k}" for k in range(12)]
    rows = [(t, "task", t, clock(0), rng.choice(["", "c1", "c1,c2"]), None, None) for t in names]
    events, leases = [], []
    for k in range(60):
        t, at = rng.choice(names), rng.randrange(1, 50)
        check = rng.choice([None, "c1", "c2"])
        what = rng.choice(["check-started", "check-passed", "check-failed"]) if check else rng.choice(["claimed", "claimed", "started", "review", "blocked", "ready", "closed", "note"])
        events.append((t, "event", f"e{k:03d}", clock(at), what, check, None))
    for k, t in enumerate(names[:8]):
        for n in range(rng.randrange(1, 3)):
            leases.append((t, "lease", f"l{k}", clock(10 + n), rng.choice(["active", "active", "released"]), None, clock(rng.choice([40, 70, 400]))))
    shuffled = rows + events + leases
    rng.shuffle(shuffled)
    # Two rows of a task of no interest push the watermark to minute 140.
    parts = [shuffled[:30], shuffled[30:], [("zz", "task", "zz", clock(200), "", None, None)], [("zz", "task", "zz", clock(200), "", None, None)]]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("task", "kind", "id", "at", "what", "check", "until"), r))) for r in part))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = tasks.task_states(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"))
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        told = []
        query = writer.foreachBatch(lambda df, n: told.extend((n, *r) for r in df.collect())).start()
        query.awaitTermination(300)
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for n, task, status, leased, _ in sorted(told, key=lambda r: r[0]):
        last[task] = (status, leased)
    now = {}
    for r in sorted(leases, key=lambda r: r[3]):
        now.setdefault(r[2], []).append(r)
    # Of rows of a lease at one time either may be the last.
    held = [x[-1] for x in now.values()]
    df = lambda data, cols: spark.createDataFrame(data, cols)
    lease_table = work.expired(df([(r[0], r[2], r[4], r[3], r[6]) for r in held], "task string, lease_id string, status string, updated_at string, expires_at string"), F.lit(clock(140)))
    event_table = df([(r[2], r[3], r[0], r[5], r[4]) for r in events], "event_id string, ts string, task string, check string, kind string")
    task_table = df([(r[0], [c for c in r[4].split(",") if c]) for r in rows], "task string, checks array<string>")
    want = {r.task: (r.status, r.leased) for r in work.task_states(task_table, event_table, lease_table).collect()}
    assert {t: last[t] for t in names} == want
