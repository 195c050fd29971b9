"""Stateful streams: split, late and repeated input gives the batch twins' results; folds against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.streaming import event_order as EO
from strata.streaming import streams as ST

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
T0 = datetime(2024, 3, 1)


def plain_lockout(attempts):
    failed, locked, out = 0, None, []
    for t, good in attempts:
        if locked is not None and locked > t:
            outcome = "refused_locked"
        elif good:
            failed, locked, outcome = 0, None, "success"
        else:
            outcome = "failure"
            if failed >= ST.LOCK_AFTER:
                locked, outcome = t + ST.LOCK_MINUTES * 60_000_000, "failure_locked"
            failed += 1
        out.append((outcome, failed, -1 if locked is None else locked))
    return out, (failed, locked)


@pytest.mark.parametrize("seed", range(60))
def test_lockout_fold_against_a_loop(seed):
    draw = random.Random(seed)
    n, rate, gap = draw.randint(0, 60), draw.choice([0.02, 0.2, 0.6]), draw.choice([1, 120, 700])
    t, rows = 0, []
    for _ in range(n):
        t += draw.randint(0, gap) * 1_000_000
        rows.append((t, draw.random() < rate))
    want, _ = plain_lockout(rows)
    cut = draw.randint(0, n)  # the state after a part continues in the next one
    got, failed, locked = [], 0, None
    for part in (rows[:cut], rows[cut:]):
        us, good = np.array([r[0] for r in part], dtype=np.int64), np.array([r[1] for r in part], dtype=bool)
        outcome, count, until = ST._lockout_fold(failed, locked, us, good)
        got += list(zip(outcome.tolist(), count.tolist(), until.tolist(), strict=True))
        if len(part):
            failed, locked = int(count[-1]), int(until[-1]) if until[-1] >= 0 else None
    assert got == want


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def late_files(spark, folder, rows, lateness, files=4):
    """Rows in files by arrival, up to ``lateness`` after their event time; files are read one per batch in order."""
    import os
    import time
    draw = random.Random(7)
    rows = sorted(rows, key=lambda r: r[2] + draw.random() * lateness)
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1)
        path = os.path.join(folder, f"part{i}")
        part.write.parquet(path)
        for name in os.listdir(path):
            stamp = time.time() - 1000 + 10 * i
            os.utime(os.path.join(path, name), (stamp, stamp))
    return spark.createDataFrame(rows, SCHEMA), ST.dir_stream(spark, folder + "/*", part.schema, max_files=1)


def events(n=240):
    draw = random.Random(3)
    kinds = ["error"] * 7 + ["purchase", "view"]
    rows = []
    for i in range(n):
        t = T0 + timedelta(seconds=draw.randint(0, 4 * 86400) // (1 if i % 2 else 30))
        rows.append((i, draw.randint(1, 3), t, draw.choice(kinds), float(draw.randint(0, 9))))
    # ties in time, a user without a single success, and missing values
    return rows + [(n + i, 9, T0 + timedelta(minutes=i // 2), "error", None if i % 5 == 0 else 2.0) for i in range(30)]


def test_lockout_of_late_and_split_input(spark, tmp_path):
    every, stream = late_files(spark, str(tmp_path), events(), timedelta(hours=5))
    got = ST.run_lockout(stream, delay="6 hours").toPandas().sort_values("event_id", ignore_index=True)
    want = ST.lockout_batch(every).toPandas().sort_values("event_id", ignore_index=True)
    assert "failure_locked" in set(want["outcome"]) and "refused_locked" in set(want["outcome"])
    pd.testing.assert_frame_equal(got, want)


def test_rolling_anomaly_of_late_and_split_input(spark, tmp_path):
    every, stream = late_files(spark, str(tmp_path), events(), timedelta(hours=5))
    got = ST.run_rolling_anomaly(stream, window_size=5, bucket=timedelta(hours=8), delay="6 hours").toPandas()
    got = got.sort_values("event_id", ignore_index=True)
    want = every.toPandas().sort_values(["event_type", "ts", "event_id"])
    roll = want.groupby("event_type")["value"].rolling(5)
    want["mean"], want["sd"] = roll.mean().droplevel(0), roll.std().droplevel(0)
    want = want.sort_values("event_id", ignore_index=True)
    assert got["event_id"].tolist() == want["event_id"].tolist()
    assert np.allclose(got["rolling_mean"].astype(float), want["mean"], equal_nan=True)
    assert np.allclose(got["rolling_std"].astype(float), want["sd"], equal_nan=True, atol=1e-6)
    assert (got["is_anomaly"].isna() == want["mean"].isna()).all()


def test_closed_stream_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(str(tmp_path / "none"))
    stream = ST.dir_stream(spark, str(tmp_path / "none"), empty.schema)
    assert ST.run_lockout(stream).count() == 0


def test_idle_state_ends(spark, tmp_path):
    """A counter is forgotten after the stated idle time, and kept without it."""
    rows = [(i, 1, T0 + timedelta(minutes=i), "error", 1.0) for i in range(3)]
    rows += [(10, 2, T0 + timedelta(days=1), "error", 1.0), (11, 1, T0 + timedelta(days=2), "error", 1.0)]
    _, stream = late_files(spark, str(tmp_path / "in"), rows, timedelta(0), files=5)
    out = {}
    for name, idle in (("kept", None), ("forgotten", timedelta(hours=2))):
        folder = str(tmp_path / name)
        done = ST.run_closed(lambda s, idle=idle: ST.stream_lockout(s, "1 minute", idle), stream, folder)
        out[name] = done.where(F.col("event_id") == 11).first()["failed_attempts"]
    assert out == {"kept": 4, "forgotten": 1}


class Handle:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def state(self, name, schema):
        handle, kept = self, []

        class State:
            def get(self):
                handle.calls += 1
                return iter(list(kept)) if name == "waiting" else kept[0] if kept else None

            def update(self, value):
                self.put([value])

            def put(self, values):
                kept.clear()
                self.appendList(values)

            def appendList(self, values):
                handle.calls += 1
                kept.extend(values)

            def clear(self):
                self.put([])

        return State()

    getListState = getValueState = state

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("forget", [None, timedelta(hours=3)])
def test_lockout_states_are_buckets_of_users(spark, monkeypatch, forget):
    """One bucket of 400 users, in batches: a few exchanges with the state store, not some per user; the answers are the loop's."""
    made = []
    monkeypatch.setattr(ST, "many_in_event_order", lambda rows, time, columns, n_keys, fold, output, delay, n_carried, expire_after_ms=None:
                        made.append((columns, EO.ManyInEventOrder(fold, columns, n_keys, n_carried, expire_after_ms))) or
                        spark.createDataFrame([], output))
    ST.stream_lockout(spark.createDataFrame([], SCHEMA), "1 minute", forget)
    columns, processor = made[0]
    draw = random.Random(11)
    rows = [(draw.randint(0, 1), draw.randint(1, 200), draw.randint(0, 86_400) * 1_000_000, 0, i, int(draw.random() < 0.1)) for i in range(6000)]
    rows += [(1, 7, (80_000 + i) * 1_000_000, 0, 10_000 + i, 0) for i in range(40)]
    good = {r[4]: bool(r[5]) for r in rows}
    handle, got = Handle(), []
    processor.init(handle)
    for end in (20_000, 50_000, 90_000, 200_000):  # rows come up to 1000 s late
        class Times:
            getCurrentWatermarkInMs = staticmethod(lambda end=end: (end - 1000) * 1000)
        new = [r for r in rows if r[2] < end * 1_000_000]
        rows = [r for r in rows if r[2] >= end * 1_000_000]
        draw.shuffle(new)
        list(processor.handleInputRows((0,), iter([pd.DataFrame(new, columns=columns)]), Times))
        while handle.timers and min(handle.timers) <= Times.getCurrentWatermarkInMs():
            handle.timers.remove(min(handle.timers))
            got += [o for o in processor.handleExpiredTimer((0,), Times, None)]
    got = pd.concat(got).sort_values(columns[:5])
    assert len(got) == 6040 and handle.calls < 120
    for _, g in got.groupby(["known", "name"]):
        tries = list(zip(g["us"], g["number"], strict=True))
        want, part = [], []
        for i, (us, number) in enumerate(tries):
            if forget and i and us - tries[i - 1][0] > forget.total_seconds() * 1_000_000:
                want, part = want + plain_lockout(part)[0], []
            part.append((us, good[number]))
        want += plain_lockout(part)[0]
        assert list(zip(g["outcome"], g["failed_attempts"], g["until"], strict=True)) == want
