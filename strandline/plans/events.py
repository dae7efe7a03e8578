"""Queries over ordered logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import events as op, rows
from strandline.plans.registry import load, query
from strandline.streaming import event_log


@query("SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'active' ELSE 'cancelled' END AS state FROM orders")
def first_active_row(spark, d):
    """Each customer's first order stays active, the rest are cancelled."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rn = F.row_number().over(op.ordered(["o_custkey"], ["o_orderdate", "o_orderkey"]))
    return o.select("o_orderkey", "o_custkey", F.when(rn == 1, "active").otherwise("cancelled").alias("state"))


_W = """w AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 10 + (o_orderkey % 7) * 10 AS e FROM orders)"""


@query(f"""
WITH {_W}, n AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM w),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM n)
SELECT o_custkey, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY o_custkey, grp
""")
def coalesce_ranges(spark, d):
    """Each customer's order windows, merged where they overlap or touch."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    o = load(spark, d, "orders").select("o_custkey", day.alias("s"), (day + 10 + (F.col("o_orderkey") % 7) * 10).alias("e"))
    return op.merge_ranges(o, ["o_custkey"], "s", "e")


@query("""
WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS grp FROM x)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM g GROUP BY l_orderkey, grp
""")
def islands(spark, d):
    """Runs of consecutive line numbers."""
    return op.islands(load(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
SELECT conv_id, turn, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start",
  "start" + length(coalesce(text, '')) AS "end" FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn)
""")
def running_offsets(spark, d):
    """Where each turn stands when a conversation is written with two characters between turns."""
    c = load(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return op.running_offsets(c, ["conv_id"], ["turn"], F.length(F.coalesce("text", F.lit(""))), 2).drop("text")


@query("""
WITH r AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM r
""")
def no_progress_streak(spark, d):
    """How many errors in a row each user has had up to each event; any other event resets it."""
    return op.streaks(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "user_id", "streak")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT *, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 AS gap FROM e)
SELECT l_orderkey, l_linenumber, 'gap' AS fault FROM g WHERE gap UNION ALL SELECT l_orderkey, l_linenumber, 'conflict' FROM g WHERE n > 1
""")
def sequence_gaps(spark, d):
    """Gaps in the line numbers of orders, and numbers that two parts claim."""
    return op.feed_faults(load(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_partkey"))


@query("SELECT * FROM (SELECT event_id AS from_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id FROM events) WHERE to_id IS NOT NULL")
def next_edges(spark, d):
    """Edges between a user's consecutive events."""
    return op.next_edges(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id")


_FOLDED = """WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem), f AS MATERIALIZED (FROM n)"""


@query(f"""
{_FOLDED}, w AS (SELECT *, l_quantity AS used, 0 AS chunk FROM f WHERE k = 1 UNION ALL
  SELECT f.*, CASE WHEN used + f.l_quantity > 60 THEN f.l_quantity ELSE used + f.l_quantity END, CASE WHEN used + f.l_quantity > 60 THEN chunk + 1 ELSE chunk END FROM w JOIN f ON f.l_orderkey = w.l_orderkey AND f.k = w.k + 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, chunk FROM w
""")
def greedy_chunks(spark, d):
    """Lines of each order in chunks of at most 60 units."""
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return op.range_chunks(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 60)


@query(f"""
{_FOLDED}, w AS (SELECT *, l_quantity AS used, l_quantity <= 100 AS admitted FROM f WHERE k = 1 UNION ALL
  SELECT f.*, CASE WHEN used + f.l_quantity > 100 THEN used ELSE used + f.l_quantity END, used + f.l_quantity <= 100 FROM w JOIN f ON f.l_orderkey = w.l_orderkey AND f.k = w.k + 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, admitted FROM w
""")
def greedy_admission(spark, d):
    """Lines of each order admitted while they fit in 100 units, larger ones skipped."""
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return op.admit_within(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 100)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_last_wins(spark, d):
    """The newest event of each (user, type)."""
    return rows.latest(load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


#: The transitions between event types that the violation query allows.
ALLOWED = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("error", "view"), ("view", "error"), ("click", "error"), ("signup", "error"))


@query(f"""
WITH t AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT * FROM t WHERE old IS NOT NULL AND (old, event_type) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in ALLOWED)})
""")
def status_transition_violations(spark, d):
    """Events that may not follow the user's event before."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return op.bad_transitions(e, ["user_id"], ["ts", "event_id"], "event_type", spark.createDataFrame(list(ALLOWED), "old string, new string")).select("event_id", "user_id", "event_type", "old")


@query("""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_current,
  coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY hash, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts, false) AS late
FROM (SELECT *, (event_id * 7919) % 10007 AS hash FROM events)
""")
def out_of_order_current(spark, d):
    """Events that arrive out of order: which is current by time, and which came after a newer one."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") * 7919 % 10007).alias("hash"))
    # both ends tie on the id, so the newest is one row; lateness compares times alone
    w = op.ordered(["user_id"], ["hash", "event_id"])
    from pyspark.sql import Window

    late = F.coalesce(F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("ts"), F.lit(False))
    newest = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))
    return e.withColumn("late", late).join(newest, "user_id").select("event_id", "user_id", (F.col("event_id") == F.col("newest")).alias("is_current"), "late")


@query("SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders")
def supersession(spark, d):
    """Each order with the one that replaced it."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return op.supersession(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("""
SELECT event_id, user_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM events
""")
def marker_sessionization(spark, d):
    """Each user's events in sessions that an error closes."""
    return op.sessions_by_marker(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "session")


@query("""
SELECT event_id, user_id FROM (SELECT *, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events) WHERE ok = 1
""")
def safe_prefix(spark, d):
    """Each user's events before the first error."""
    return op.valid_prefix(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def occurrence_ordinal(spark, d):
    """The n-th event of its type for its user."""
    return op.occurrence(load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "ordinal")


@query("""
WITH x AS (SELECT *, event_id // 3 AS k FROM events)
SELECT user_id, k, min(event_id) AS event_id, count(*) AS deliveries, count(DISTINCT event_type) > 1 AS conflict FROM x GROUP BY user_id, k
""")
def idempotent_append(spark, d):
    """One row by (user, key) of a log with repeated deliveries, conflicting payloads marked."""
    e = load(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 3).alias("k"), "event_id", "event_type")
    return op.idempotent(e, ["user_id", "k"], ["event_id"], F.col("event_type")).drop("event_type")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 100 AS sequence FROM events")
def next_value_allocation(spark, d):
    """Sequence numbers by user, from one past those already given out (100)."""
    e = load(spark, d, "events")
    return e.select("event_id", (F.row_number().over(op.ordered(["user_id"], ["ts", "event_id"])) + 100).cast("bigint").alias("sequence"))


@query("""
WITH a AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, n, total, n AS stream_n, total AS stream_total FROM a
""")
def stream_equals_batch(spark, d):
    """Counts and sums by (user, type) from a stream run to its end, beside those of a batch."""
    e = load(spark, d, "events")
    batch = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    stream = event_log.totals(spark, f"{d}/events.parquet", e.schema)
    s = stream.select("user_id", "event_type", F.col("n").alias("stream_n"), F.round("total", 4).alias("stream_total"))
    return batch.join(s, ["user_id", "event_type"], "full")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS k, first_value(l_partkey) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey::VARCHAR)),
g AS (SELECT *, CASE WHEN k = 1 THEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k) END AS step FROM r)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN k = 1 THEN 'gap' WHEN l_partkey = p THEN 'replay' ELSE 'conflict' END AS fault FROM g WHERE k > 1 OR step > 1
""")
def stream_sequence_faults(spark, d):
    """Gaps, conflicts and replays in the line numbers of orders, found by a stateful stream."""
    return event_log.sequence_faults(spark, f"{d}/lineitem.parquet", load(spark, d, "lineitem").schema, "l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT date_trunc('hour', ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def windowed_stream(spark, d):
    """Hourly windows by type from a stream run to its end (an extension)."""
    e = load(spark, d, "events")
    x = event_log.hourly(spark, f"{d}/events.parquet", e.schema)
    return x.withColumn("total", F.round("total", 4))


@query("""
WITH t AS (SELECT conv_id, turn, min(role || ': ' || coalesce(text, '')) AS content FROM conversations GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t)
SELECT conv_id::VARCHAR AS "key", turn + 1 AS number, sha256(content) AS content_sha256, 'delivered' AS outcome FROM d WHERE turn + 1 = k
""")
def feed_caught_up(spark, d):
    """Every conversation's turns delivered in order by a stream that was stopped half-way: all replies arrive first, the rest after a restart."""
    import uuid

    from strandline.functions.tables import shared_dir
    from strandline.streaming import feed

    place = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    turns = load(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("number"), F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("content"))
    for n, part in enumerate((turns.where("number % 2 = 0"), turns.where("not number % 2 <=> 0"))):
        part.write.parquet(f"{place}/arrived/{n}")
        stream = spark.readStream.schema(turns.schema).option("recursiveFileLookup", "true").parquet(f"{place}/arrived")
        out = feed.catch_up(stream, f"{place}/feed", key="conv_id", number="number", content="content")
    return out.where("outcome = 'delivered'").select("key", "number", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "outcome")
