"""Event and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.resampling import POISSON, bootstrap_mean
from ..session import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))


def queue_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("ts").cast("string").alias("oldest"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 4).alias("heavy")
    )


def duration_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(table(spark, d, "events"), ["event_type"], F.round(F.col("value") * 100000).cast("long"))


def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns with what was said until the next one."""
    rows = table(spark, d, "conversations")
    starts = E.next_boundary(rows, "conv_id", "turn", F.col("role") == "user").select("conv_id", F.col("turn").alias("start"), "next_start")
    replies = rows.join(starts, "conv_id").where("turn > start AND (next_start IS NULL OR turn < next_start)")
    counted = replies.groupBy("conv_id", "start").agg(F.count("*").alias("replies"), F.sum(F.length("text")).alias("chars"))
    return starts.join(counted, ["conv_id", "start"], "left").select("conv_id", "start", "next_start", F.coalesce("replies", F.lit(0)).alias("replies"), F.coalesce("chars", F.lit(0)).alias("chars"))


def cell_projection(spark: SparkSession, d: str) -> DataFrame:
    cells = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", F.explode_outer(F.map_filter(cells, lambda k, v: k.isin("k"))).alias("cell", "number"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", v.alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


def span_union(spark: SparkSession, d: str) -> DataFrame:
    spans = _events(spark, d).select("user_id", "s", (F.col("s") + 3600 + F.col("event_id") % 7200).alias("e"))
    return E.merged_spans(spans, "user_id", "s", "e")


def section_islands(spark: SparkSession, d: str) -> DataFrame:
    out = E.islands(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("event_id", "user_id", F.col("island").cast("long").alias("island"))


def rate_window(spark: SparkSession, d: str) -> DataFrame:
    cost = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    return E.trailing(_events(spark, d), ["user_id"], F.col("s"), 21600, cost).select("event_id", F.col("used").cast("long").alias("used"))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    got = bootstrap_mean(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", replicates=100)
    return got.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


def rate_admitted(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "user_id", "s")
    return E.admitted(rows, "user_id", "s", "event_id", 3, 86400).select("event_id", "admitted")


def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return got.select(F.unix_seconds("w.start").alias("start"), "n")


def session_window(spark: SparkSession, d: str) -> DataFrame:
    got = E.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes")
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def event_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_id") % 97).alias("batch"), F.floor(F.col("event_id") / F.when(F.col("event_id") % 97 < 5, 200).otherwise(1)).alias("key"))
    return E.guarded(rows, "batch", "key")


def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    """First event of a user, type and day."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    first = rows.groupBy("user_id", "event_type", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.select("event_id", "user_id", "event_type")


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events"), "user_id", F.struct("ts", "event_id"), "event_id", "event_type", "value")


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id")).groupBy("user_id", "seen").agg(F.max("view_id").alias("view_id"))
    return E.as_of(left, right, "user_id", "ts", "seen", "view_id").select("event_id", "view_id")


def interval_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", F.col("event_id").alias("id"), "s", (F.col("s") + 1800).alias("e"), "event_type")
    return E.overlaps(rows.where("event_type = 'click'"), rows.where("event_type = 'error'"), "user_id", "s", "e", 3600)


QUERIES = {
    f.__name__: f
    for f in (
        queue_metrics, duration_histogram, conversation_turns, cell_projection, json_extract, span_union, section_islands, rate_window, bootstrap_interval, rate_admitted,
        tumbling_window, sliding_window, session_window, event_guard, dedup_events, latest_state, asof_join, interval_join,
    )
}

_S = "epoch(ts)::BIGINT"
_SPANS = "spans AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 + event_id % 7200 AS e FROM events)"
_H = "round(value * 100000)::BIGINT"
ORACLES = {
    "queue_metrics": """SELECT event_type, count(*) AS n, regexp_replace(regexp_replace(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') AS oldest,
round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS heavy FROM events GROUP BY event_type""",
    "duration_histogram": f"""SELECT event_type, count(*) AS n, sum({_H})::BIGINT AS total, max({_H}) AS most, count(*) FILTER ({_H} <= 10000) AS le_0,
count(*) FILTER ({_H} > 10000 AND {_H} <= 50000) AS le_1, count(*) FILTER ({_H} > 50000 AND {_H} <= 250000) AS le_2, count(*) FILTER ({_H} > 250000 AND {_H} <= 1000000) AS le_3,
count(*) FILTER ({_H} > 1000000 AND {_H} <= 5000000) AS le_4, count(*) FILTER ({_H} > 5000000 AND {_H} <= 30000000) AS le_5, count(*) FILTER ({_H} > 30000000) AS le_6
FROM events GROUP BY event_type""",
    "conversation_turns": """WITH u AS (SELECT conv_id, turn AS start, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_start FROM conversations WHERE role = 'user')
SELECT u.conv_id, start, next_start, count(c.turn) AS replies, coalesce(sum(length(c.text)), 0)::BIGINT AS chars
FROM u LEFT JOIN conversations c ON c.conv_id = u.conv_id AND c.turn > start AND (next_start IS NULL OR c.turn < next_start) GROUP BY ALL""",
    "cell_projection": "SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 'k' END AS cell, json_extract(props, '$.k')::BIGINT AS number FROM events",
    "json_extract": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    "span_union": f"""WITH {_SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
k AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS s, max(e) AS e FROM k GROUP BY user_id, k""",
    "section_islands": """SELECT event_id, user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island
FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events)""",
    "rate_window": """SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW)::BIGINT AS used FROM events""",
    "bootstrap_interval": f"""
WITH m AS (SELECT o_orderpriority, o_totalprice AS x, q, md5('7:' || o_orderkey || ':' || q) AS h FROM orders, (SELECT unnest(range(25)) AS q)),
u AS (SELECT o_orderpriority, x, q * 4 + k AS rep, ('0x' || substr(h, k::INT * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM m, (SELECT unnest(range(4)) AS k)),
w AS (SELECT *, {' + '.join(f'(u >= {p}::DOUBLE)::INT' for p in POISSON)} AS n FROM u),
r AS (SELECT o_orderpriority, rep, sum(n * x) / sum(n) AS m FROM w GROUP BY o_orderpriority, rep),
e AS (SELECT o_orderpriority, list(m ORDER BY m) AS l FROM r GROUP BY o_orderpriority)
SELECT o_orderpriority, round(mean, 4) AS mean, round(l[3], 4) AS low, round(l[98], 4) AS high FROM e JOIN (SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY 1) USING (o_orderpriority)""",
    "rate_admitted": """WITH RECURSIVE o AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, s, n, true AS admitted, [s] AS passed FROM o WHERE n = 1
UNION ALL SELECT o.event_id, o.user_id, o.s, o.n, len(list_filter(w.passed, lambda x: o.s - x < 86400)) < 3,
CASE WHEN len(list_filter(w.passed, lambda x: o.s - x < 86400)) < 3 THEN list_append(list_filter(w.passed, lambda x: o.s - x < 86400), o.s) ELSE list_filter(w.passed, lambda x: o.s - x < 86400) END
FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1) SELECT event_id, admitted FROM w""",
    "tumbling_window": "SELECT floor(epoch(date_trunc('hour', ts)))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_window": """SELECT start, count(*) AS n FROM (SELECT floor(epoch(date_trunc('hour', ts)))::BIGINT - 3600 * k AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY start""",
    "session_window": """WITH m AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n FROM k GROUP BY user_id, k""",
    "event_guard": """SELECT event_id % 97 AS batch, count(*) AS n, count(DISTINCT event_id // CASE WHEN event_id % 97 < 5 THEN 200 ELSE 1 END) = count(*) AS ok FROM events GROUP BY 1""",
    "dedup_events": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1",
    "latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "asof_join": """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT event_id, view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "interval_join": """WITH x AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS e, event_type FROM events)
SELECT l.user_id, l.id AS a, r.id AS b FROM x l JOIN x r ON l.user_id = r.user_id AND l.s <= r.e AND r.s <= l.e WHERE l.event_type = 'click' AND r.event_type = 'error'""",
}
