"""Lifecycles of a stream against a plain walk through its batches, timers, and jobs that are replayed or fail."""

import random
import time
from datetime import datetime, timedelta

import pytest

from quillon.streaming import stateful
from quillon.streaming.lifecycle import ENDED, LIFECYCLE

SCHEMA = "document long, event_id long, ts timestamp, status string"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    kept = {k: spark.conf.get(k, None) for k in [*stateful.STORE, "spark.sql.shuffle.partitions"]}
    for k, v in {**stateful.STORE, "spark.sql.shuffle.partitions": "2"}.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream(spark, tmp_path, batches, **how):
    """Rows of the verdicts over micro-batches, one file each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(d, e, START + timedelta(seconds=s), st) for d, e, s, st in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
        time.sleep(0.02)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"verdicts_{random.randrange(10**9)}"
    stateful.lifecycles(source, LIFECYCLE, ENDED, **how).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return [(r["document"], r["event_id"], r["verdict"], r["status"], r["events"]) for r in spark.table(name).collect()]


def plain(batches, idle, keep):
    """Verdicts by walking through the events of each batch in the order of time."""
    now, out = {}, []
    for rows in batches:
        for d, e, s, st in sorted(rows, key=lambda r: (r[2], r[1])):
            state = now.get(d)
            if state and s > state[2] + (keep if state[0] in ENDED else idle):
                out.append((d, None, "forgotten" if state[0] in ENDED else "expired", state[0], state[1]))
                state = None
            if st not in LIFECYCLE:
                verdict = "unknown"
            elif state and state[0] in ENDED:
                verdict = "refused"
            elif state and s < state[2]:
                verdict = "late"
            else:
                verdict = "back" if state and LIFECYCLE.index(st) < LIFECYCLE.index(state[0]) - 1 else "accepted"
                state = (st, (state[1] if state else 0) + 1, s)
            now[d] = state
            out.append((d, e, verdict, state[0] if state else None, state[1] if state else 0))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_two_batches_with_every_verdict(spark, tmp_path):
    rng = random.Random(2)
    events = [(rng.randrange(12), i, rng.randrange(4000), rng.choice([*LIFECYCLE[:4], *LIFECYCLE[:4], "tamamlandi", "nowhere"])) for i in range(160)]
    batches = [events[:80], events[80:]]
    expected = plain(batches, 600, 1500)
    assert {v for _, _, v, _, _ in expected} == {"accepted", "back", "late", "refused", "unknown", "expired", "forgotten"}
    assert ordered(stream(spark, tmp_path, batches, idle=600, keep=1500, delay="1000 days")) == ordered(expected)


def test_timers_end_state_without_further_events(spark, tmp_path):
    # The first two documents hear nothing more; others move the watermark past their ends.
    batches = [[(1, 1, 0, "alindi"), (2, 2, 5, "hata")], [(3, 3, 700, "alindi")], [(3, 4, 1200, "okunuyor")], [(3, 5, 1400, "okunuyor"), (1, 6, 1400, "alindi")]]
    out = stream(spark, tmp_path, batches, idle=300, keep=900, delay="10 seconds")
    assert (1, None, "expired", "alindi", 1) in out and (2, None, "forgotten", "hata", 1) in out
    # An event after the end begins a new lifecycle.
    assert (1, 6, "accepted", "alindi", 1) in out
    assert (3, None, "expired", "alindi", 1) in out and (3, 4, "accepted", "okunuyor", 1) in out
    assert len([r for r in out if r[2] == "expired" and r[0] == 1]) == 1


def test_late_and_refused_across_batches(spark, tmp_path):
    batches = [[(1, 1, 100, "okunuyor"), (2, 2, 100, "tamamlandi")], [(1, 3, 50, "okunuyor"), (2, 4, 200, "alindi"), (1, 5, 150, "hata")], [(1, 6, 160, "alindi")]]
    assert ordered(stream(spark, tmp_path, batches, delay="1 hour")) == ordered(plain(batches, 7 * 86_400, 90 * 86_400))


def test_restart_continues(spark, tmp_path):
    first = [[(1, 1, 0, "alindi")], [(1, 2, 10, "tamamlandi")]]
    stream(spark, tmp_path, first, delay="1 hour")
    spark.createDataFrame([(1, 3, START + timedelta(seconds=20), "alindi")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/900"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []
    query = stateful.lifecycles(source, LIFECYCLE, ENDED, delay="1 hour").writeStream.foreachBatch(lambda df, i: seen.extend(df.select("event_id", "verdict").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in seen] == [(3, "refused")]
