"""The change log, undo, refinement and expiring state."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe import session
from lodeframe.operators import frames, history
from lodeframe.plans import screen_queries
from lodeframe.streaming import frames as streams


def test_undo_gives_back_the_table_before(spark):
    rng = random.Random(3)
    kind = "s int, k int, v int"
    log = spark.createDataFrame([], "s int, version long, k int, v int, gone boolean")
    state, past = {s: {} for s in range(4)}, []
    for _ in range(5):
        new = {s: dict(m) for s, m in state.items()}
        for m in new.values():
            for k in rng.sample(range(6), 3):
                m.pop(k, None) if rng.random() < 0.3 else m.update({k: rng.randrange(3)})
        table = lambda m: spark.createDataFrame([(s, k, v) for s, r in m.items() for k, v in r.items()], kind)
        log = spark.createDataFrame(history.logged(log, history.changes(table(state), table(new), ["s", "k"], ["v"]), "s").collect(), log.schema)
        past.append({s: dict(m) for s, m in state.items()})
        state = new
        assert {(r["s"], r["k"], r["v"]) for r in history.as_of(log, ["s", "k"], ["v"]).collect()} == {(s, k, v) for s, m in state.items() for k, v in m.items()}
    last = log.groupBy("s").agg(F.max("version").alias("version"))
    back = history.taken_back(log, last, "s", "k", ["v"])
    undone = log.unionByName(back.select(*log.columns))
    got = history.as_of(undone, ["s", "k"], ["v"])
    before = log.join(last.withColumnRenamed("version", "t"), "s").where("version < t").drop("t")
    want = history.as_of(before, ["s", "k"], ["v"])
    marks = lambda df: {tuple(r) for r in history.probe(df, "s", "k", ["v"]).collect()}
    assert {(r["s"], r["k"], r["v"]) for r in got.collect()} == {(r["s"], r["k"], r["v"]) for r in want.collect()}
    assert marks(got) == marks(want) != marks(history.as_of(log, ["s", "k"], ["v"]))
    redone = log.unionByName(back.select(*log.columns))
    again = history.taken_back(redone, redone.groupBy("s").agg(F.max("version").alias("version")), "s", "k", ["v"])
    assert marks(history.as_of(redone.unionByName(again.select(*log.columns)), ["s", "k"], ["v"])) == marks(history.as_of(log, ["s", "k"], ["v"]))


def test_what_changed_since_is_not_overwritten(spark):
    rows = [(1, 1, 1, 5, False), (1, 2, 1, 6, False), (1, 2, 2, 7, False), (1, 3, 2, 8, False), (2, 1, 1, None, False), (2, 2, 1, None, True), (2, 3, 9, 1, False)]
    log = spark.createDataFrame(rows, "s int, version int, k int, v int, gone boolean")
    take = lambda s, v: sorted(tuple(r) for r in history.taken_back(log, spark.createDataFrame([(s, v)], "s int, version int"), "s", "k", ["v"]).collect())
    assert take(1, 2) == [] and take(1, 7) == [] and take(3, 1) == []
    assert take(1, 3) == [(1, 4, 2, 7, False)]
    assert take(2, 2) == [(2, 4, 1, None, False)]
    assert take(2, 3) == [(2, 4, 9, None, True)]


def test_undo_reads_the_log_once_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = screen_queries.history_taken_back(spark, sf_dir)
    assert plan(df).count("Relation") == 2 and "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(session, "TASK_ROWS", rows // 10)
    log = screen_queries.change_log(spark, sf_dir)
    assert 10 <= log.rdd.getNumPartitions() <= 11 and max(log.rdd.glom().map(len).collect()) < rows // 4
    assert sorted(map(tuple, screen_queries.history_taken_back(spark, sf_dir).collect())) == sorted(map(tuple, df.collect()))


def test_targets_by_a_table_and_by_a_column(spark):
    rng = random.Random(8)
    rows = [(s, v, k, rng.choice([None, "a", "b"]), rng.choice([1.5, None]), rng.random() < 0.4) for s in range(40) for v in range(1, 6) for k in rng.sample(range(4), 2)]
    log = spark.createDataFrame(rows, "s int, version long, k int, a string, b double, gone boolean")
    last = F.max("version").over(Window.partitionBy("s")) - 1
    table = log.groupBy("s").agg((F.max("version") - 1).alias("version"))
    got = sorted(map(repr, history.taken_back(log, last, "s", "k", ["a", "b"]).collect()))
    want = []
    for s in range(40):
        held = lambda until: {k: (None, None, True) if gone else (a, b, False) for s_, v, k, a, b, gone in rows if s_ == s and v <= until}
        then, end, was = held(4), held(5), held(3)
        wrote = {k for s_, v, k, *_ in rows if s_ == s and v == 4}
        if all(then[k] == end[k] for k in wrote):
            want += [repr((s, 6, k, *was.get(k, (None, None, True)))) for k in wrote]
    assert sorted(repr(tuple(r)) for r in history.taken_back(log, table, "s", "k", ["a", "b"]).collect()) == sorted(want) and want
    assert got == sorted(map(repr, history.taken_back(log, table, "s", "k", ["a", "b"]).collect()))


def test_refinement_is_the_plain_recursion(spark):
    rng = random.Random(9)
    series = {w: [None if rng.random() < 0.1 else rng.choice([0.0, 1.0, 2.0, 9.0]) for _ in range(n)] for w, n in enumerate((1, 2, 9, 40, 41, 100))}
    df = spark.createDataFrame([(w, i, v) for w, vs in series.items() for i, v in enumerate(vs)], "w int, i long, v double")

    def plain(vs):
        taken = set(range(0, len(vs), 8))

        def split(a, b):
            if b - a > 1 and (vs[a] is None or vs[b] is None or abs(vs[a] - vs[b]) > 1):
                taken.add((a + b) // 2)
                split(a, (a + b) // 2)
                split((a + b) // 2, b)

        for a in range(0, len(vs) - 8, 8):
            split(a, a + 8)
        return taken

    got = {}
    for r in frames.refined(df, "w", "i", "v", 8, 1).collect():
        assert series[r["w"]][r["i"]] == r["v"] and r["i"] not in got.setdefault(r["w"], set())
        got[r["w"]].add(r["i"])
    assert got == {w: plain(vs) for w, vs in series.items()}


def test_state_expires_and_late_rows_count_nothing(spark, tmp_path):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    batches = [
        [(1, day(0)), (2, day(0)), (2, day(1)), (3, day(0))],
        [(1, day(3.5)), (4, day(5)), (2, day(2))],  # slot 1 finds its first write too old
        [(5, day(9)), (3, day(1)), (4, day(5.5))],  # slot 3's row is later than the watermark
        [(6, day(12.5)), (6, day(12.6))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "slot int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_STORE)
    got, kept = [], []
    try:
        for i in range(len(batches)):  # files arrive one by one; the state lives on in the checkpoint
            spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
            stream = spark.readStream.schema("slot int, ts timestamp").parquet(f"{tmp_path}/all")
            q = streams.drain(streams.expired(stream, "slot", "ts", 3, "1 day"), f"{tmp_path}/out", f"{tmp_path}/state")
            kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]))
    finally:
        spark.conf.set(key, before)
    got = sorted(((r["slot"], r["at"], r["writes"], r["how"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [
        (1, day(0), 1, "write"), (1, day(3.5), 1, "age"), (2, day(2), 3, "age"), (3, day(0), 1, "age"), (4, day(5.5), 2, "age"),
    ]
    assert kept[-1] <= kept[0] + kept[0]  # the store holds the living slots, not all that ever were


def test_writes_of_a_batch_read_and_set_the_state_once():
    import pandas as pd

    class Fake:
        def __init__(self):
            self.held, self.calls, self.timers = None, 0, set()

        def getValueState(self, *a):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.held

        def exists(self):
            self.calls += 1
            return self.held is not None

        def update(self, x):
            self.calls, self.held = self.calls + 1, x

        def listTimers(self):  # noqa: N802
            return iter(set(self.timers))

        def deleteTimer(self, t):  # noqa: N802
            self.timers.discard(t)

        def registerTimer(self, t):  # noqa: N802
            self.timers.add(t)

    f, kept = Fake(), streams._Kept("slot", 10)
    kept.init(f)
    got = [g for at in ([[0, 9_000]], [[5_000], [30_000, 20_000]]) for g in kept.handleInputRows((1,), iter(pd.DataFrame({"at": x}) for x in at), None)]
    assert [tuple(r) for g in got for r in g.itertuples(index=False)] == [(1, pd.Timestamp(9_000, unit="us"), 3, "write")]
    assert f.held == (30_000, 2) and f.timers == {40} and f.calls == 4
