"""Queries of the relational categories over the star schema, and of events, in batches and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import sketches, storage
from quillon.sources import readers
from quillon.streaming import lifecycle, stateful

from .base import Registry, table

R = Registry()


@R.add("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    orders = t("orders").filter(F.col("o_orderdate") >= F.to_timestamp(F.lit("1994-01-01"))).select("o_orderkey", "o_custkey")
    # Nations and regions are fixed tables of 25 and 5 rows.
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    rows = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.add("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.add("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@R.add("SELECT e.event_id, max(p.ts) AS purchased_at FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'error' GROUP BY 1")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """For each error the user's last purchase at or before it, by one window over both kinds of rows."""
    events = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").filter(F.col("event_type").isin("error", "purchase"))
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("purchased_at", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(upto))
    return seen.filter("event_type = 'error'").select("event_id", "purchased_at")


_AGG = "count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY"


def _totals(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add(f"SELECT o_orderstatus, o_orderpriority, {_AGG} CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return _totals(table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority"))


@R.add(f"SELECT o_orderstatus, o_orderpriority, {_AGG} ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _totals(table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority"))


@R.add(f"SELECT o_orderstatus, o_orderpriority, {_AGG} GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _totals(table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority"))


@R.add("SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.lag("o_orderkey").over(w).alias("before"))


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("_r", F.row_number().over(best)).filter("_r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


@R.add("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@R.add("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.intersect(b)


@R.add("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_partkey", "l_quantity")
    return rows.filter("l_quantity > 40").select(F.col("l_partkey").alias("k")).subtract(rows.filter("l_quantity < 5").select("l_partkey"))


@R.add("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@R.add("SELECT l_orderkey, l_linenumber, unnest(['discount', 'tax']) AS name, unnest([l_discount, l_tax]) AS value FROM lineitem")
def unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "name", "value")


@R.add("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    mean = orders.groupBy("o_custkey").agg((F.avg("o_totalprice") * 1.5).alias("m"))
    return orders.join(mean, "o_custkey").filter("o_totalprice > m").select("o_orderkey", "o_totalprice")


@R.add("SELECT event_id, user_id, value FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def keyset_scan(spark: SparkSession, d: str) -> DataFrame:
    """One page of a resumed scan; the page size is the feature."""
    return readers.read_after(table(spark, d, "events", "event_id", "user_id", "value"), "event_id", 500, 200)


@R.add("SELECT date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1, 2")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("month", F.col("month").cast("timestamp"))


@R.add("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.windowed(table(spark, d, "events"), "1 hour")


@R.add("SELECT b - INTERVAL '30 minutes' * k AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, event_type, value, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.windowed(table(spark, d, "events"), "1 hour", "30 minutes")


@R.add("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY 1, 2""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.sessions(table(spark, d, "events"))


#: The event log as lifecycles: a user is a document, a purchase ends it.
_ENDS = ["purchase"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("document"), "event_id", "ts", F.col("event_type").alias("status"))


_OK = "l AS (SELECT user_id AS document, event_id, ts, event_type AS status FROM events), ok AS (SELECT *, coalesce(max(CASE WHEN status = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM l)"


@R.add(f"WITH {_OK} SELECT document, event_id, status FROM ok WHERE ended = 0")
def terminal_guard(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.accepted_events(_log(spark, d), _ENDS).select("document", "event_id", "status")


@R.add(f"WITH {_OK} SELECT document, arg_max(status, (ts, event_id)) AS status, count(*) AS events, max(ts) AS updated_at FROM ok WHERE ended = 0 GROUP BY 1")
def lifecycle_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.latest_state(lifecycle.accepted_events(_log(spark, d), _ENDS))


@R.add(f"WITH {_OK}, s AS (SELECT status, lag(status) OVER (PARTITION BY document ORDER BY ts, event_id) AS previous FROM ok WHERE ended = 0) SELECT previous, status, count(*) AS n FROM s WHERE previous IS NOT NULL GROUP BY 1, 2")
def lifecycle_transitions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.transitions(lifecycle.accepted_events(_log(spark, d), _ENDS))


@R.add("SELECT user_id AS document, event_type AS field, arg_max(value, (ts, value)) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2")
def user_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("document"), F.col("event_type").alias("field"), "value", "ts")
    return lifecycle.user_updates(rows, ["view", "click"])


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")


@R.add(f"WITH {_OK} SELECT document, arg_max(status, (ts, event_id)) AS status, count(*) AS events, max(ts) AS updated_at FROM ok WHERE ended = 0 GROUP BY 1")
def events_stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The stateful stream over all events that are there; its last update of each document."""
    log = _streamed(spark, d).select(F.col("user_id").alias("document"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    name = f"state_{uuid.uuid4().hex}"
    lifecycle.streamed_state(log, _ENDS).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    latest = Window.partitionBy("document").orderBy(F.desc("events"))
    return spark.table(name).withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")


_STAGES, _IDLE, _KEEP = ["view", "click", "error", "signup", "purchase"], 2 * 86_400, 86_400


@R.add(f"""WITH RECURSIVE l AS (SELECT user_id AS document, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS status, list_position({_STAGES}, event_type) AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT document, n, event_id, ts, CASE WHEN place IS NULL THEN 'unknown' ELSE 'accepted' END AS verdict, CASE WHEN place IS NOT NULL THEN status END AS status, CASE WHEN place IS NULL THEN 0 ELSE 1 END AS events, place AS at_place, CASE WHEN place IS NOT NULL THEN ts END AS last FROM l WHERE n = 1
UNION ALL SELECT document, n, event_id, ts, verdict, CASE WHEN moved THEN status WHEN NOT gone THEN was END, CASE WHEN moved AND gone THEN 1 WHEN moved THEN events + 1 WHEN gone THEN 0 ELSE events END, CASE WHEN moved THEN place WHEN NOT gone THEN at_place END, CASE WHEN moved THEN ts WHEN NOT gone THEN last END
FROM (SELECT *, verdict IN ('accepted', 'back') AS moved FROM (SELECT *, CASE WHEN place IS NULL THEN 'unknown' WHEN gone THEN 'accepted' WHEN was = 'purchase' THEN 'refused' WHEN place < at_place - 1 THEN 'back' ELSE 'accepted' END AS verdict
FROM (SELECT l.*, w.status AS was, w.events, w.at_place, w.last, w.last IS NULL OR epoch(l.ts) > epoch(w.last) + CASE WHEN w.status = 'purchase' THEN {_KEEP} ELSE {_IDLE} END AS gone FROM w JOIN l ON l.document = w.document AND l.n = w.n + 1))))
SELECT document, event_id, verdict, status, CAST(events AS BIGINT) AS events FROM w""")
def lifecycle_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every event judged by the stateful stream; a user is a document, who ends with a purchase and expires in two days."""
    log = _streamed(spark, d).select(F.col("user_id").cast("long").alias("document"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    path, held = storage.new_folder(spark, "verdicts"), {k: spark.conf.get(k, None) for k in stateful.STORE}
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    try:
        lifecycle.run_available(stateful.lifecycles(log, _STAGES, _ENDS, idle=_IDLE, keep=_KEEP), f"{path}/rows", f"{path}/checkpoint")
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{path}/rows").filter("event_id IS NOT NULL").select("document", "event_id", "verdict", "status", "events")


@R.add("""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, user_id, value FROM events), x AS (SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, median(value) AS half FROM e GROUP BY 1)
SELECT event_type, rows, users, true AS users_fit, true AS median_fits FROM x""")
def sketched_events(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and median values of event types from sketches by day, merged, and whether they are within their bounds."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    kept = storage.written(sketches.sketched(events, ["event_type", "day"], "user_id", "value"), "sketches")
    whole = sketches.merged(kept, ["event_type"]).select("event_type", "rows", sketches.distinct_estimate(F.col("distinct_sketch")).alias("about"), sketches.quantile_estimate(F.col("quantile_sketch"), 0.5).alias("half"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    # The share of values up to the estimated median is near one half.
    below = events.join(F.broadcast(whole.select("event_type", "half")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("half")).cast("double")).alias("share"))
    both = whole.join(exact, "event_type").join(below, "event_type")
    return both.select("event_type", "rows", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1), 0.03 * F.col("users"))).alias("users_fit"), (F.abs(F.col("share") - 0.5) <= 0.02).alias("median_fits"))


_SAMPLE = 200


@R.add(f"""WITH p AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS w, o_totalprice / ((CAST('0x' || left(md5('7|' || o_orderkey), 13) AS BIGINT) + 1) / 4503599627370496.0) AS priority FROM orders WHERE o_totalprice > 0),
r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM p)
SELECT o_orderkey, o_orderpriority, round(greatest(w, coalesce((SELECT priority FROM r WHERE n = {_SAMPLE + 1}), 0)), 4) AS estimate FROM r WHERE n <= {_SAMPLE}""")
def priority_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred orders by priority of price, with what each stands for."""
    orders = table(spark, d, "orders")
    out = sketches.priority_sample(orders, F.col("o_orderkey"), F.col("o_totalprice"), _SAMPLE, seed=7)
    return out.select("o_orderkey", "o_orderpriority", F.round("estimate", 4).alias("estimate"))
