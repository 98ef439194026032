"""Document lifecycles: state from append-only events, in batches and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.storage import replace_text

TERMINAL = ["COMPLETED", "FAILED", "REJECTED"]
# The states of a document's lifecycle, in the order in which it goes through them.
LIFECYCLE = ["alindi", "okunuyor", "siniflandiriliyor", "mevzuat_araniyor", "kaynak_dogrulaniyor", "eksik_bilgi_bekleniyor", "yazi_turu_seciliyor", "birim_yonlendiriliyor", "yanit_stratejisi_bekleniyor", "taslak_hazirlaniyor", "uygunluk_kontrolunde", "kullanici_onayi_bekleniyor", "tamamlandi", "hata"]
ENDED = ["tamamlandi", "hata"]


def out_of_order(events: DataFrame, states: list[str], key: str = "document", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events of unknown states, and those that go back by more than one stage, with their previous state."""
    place = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))])
    steps = events.withColumn("previous", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))
    now, before = F.element_at(place, F.col("status")), F.element_at(place, F.col("previous"))
    return steps.filter(now.isNull() | (now < before - 1))


def accepted_events(events: DataFrame, terminal: list[str], key: str = "document", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events up to and including the first terminal one of each document; later ones are refused."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.when(F.col("status").isin(*terminal), 1).otherwise(0)).over(before), F.lit(0))
    return events.withColumn("_ended", ended).filter("_ended = 0").drop("_ended")


def latest_state(events: DataFrame, key: str = "document", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Status, number of events and time of the last event of each document."""
    return events.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("events"), F.max("ts").alias("updated_at"))


def transitions(events: DataFrame, key: str = "document", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """How often each status followed another."""
    steps = events.withColumn("previous", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))
    return steps.filter("previous is not null").groupBy("previous", "status").agg(F.count(F.lit(1)).alias("n"))


def user_updates(updates: DataFrame, allowed: list[str], key: str = "document") -> DataFrame:
    """The last value of each allowed field; (document, field, value, ts)."""
    return updates.filter(F.col("field").isin(*allowed)).groupBy(key, "field").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def may_approve(missing: Column, checks: Column, strategy: Column) -> Column:
    """Nothing missing, every check passed, a strategy chosen."""
    return (F.size(missing) == 0) & F.forall(checks, lambda c: c) & strategy.isNotNull()


STATE = "status string, events bigint, updated_at timestamp"


def streamed_state(events: DataFrame, terminal: list[str], key: str = "document", delay: str = "10 minutes") -> DataFrame:
    """The running state of each document of a stream (key, event_id, ts, status); terminal documents change no more.

    Within a batch events are taken in time order. State of terminal documents is small and stays, to refuse late events.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, at = state.get if state.exists else (None, 0, None)
        if status not in terminal:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            # Up to and including the first event that ends the document.
            ended = rows["status"].isin(terminal)
            rows = rows[ended.cumsum() - ended == 0]
            last = rows["ts"].max()
            status, n, at = rows["status"].iloc[-1], n + len(rows), last if at is None else max(at, last)
        state.update((status, n, at))
        yield pd.DataFrame({key: [name[0]], "status": [status], "events": [n], "updated_at": [at]})

    kind = dict(events.dtypes)[key]
    return events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; on a stream, late rows within the delay count."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return source.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions of users: a new one after a gap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > gap_minutes * 60_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, once, to Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def save_checkpoint(spark: SparkSession, path: str, state: dict) -> None:
    """A JSON checkpoint that a crash at any point leaves whole, the old one or the new one."""
    replace_text(spark, path, json.dumps(state, sort_keys=True))


def load_checkpoint(spark: SparkSession, path: str, identity: dict, overwrite: bool = False) -> dict | None:
    """The state saved at ``path``, or None if there is none or it is to be overwritten.

    A checkpoint of another identity, such as another corpus fingerprint or collection, is refused and not continued.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if overwrite or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    state = json.loads(spark.read.text(path, wholetext=True).first()[0])
    differs = sorted(k for k, v in identity.items() if state.get(k) != v)
    if differs:
        raise ValueError(f"the checkpoint belongs to another {', '.join(differs)}")
    return state
