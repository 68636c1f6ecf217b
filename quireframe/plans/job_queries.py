"""Registered queries of stateful processing over the events table, with SQL that walks the events one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.plans.queries import _t, query
from quireframe.plans.value_queries import _sql
from quireframe.streaming import jobs as J

_DAY = 86_400_000
_EVENTS = """SELECT user_id AS job, CAST({ms} AS BIGINT) AS at, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN 'cancel' WHEN event_type = 'signup' THEN 'enqueue' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'view' THEN 'renew' WHEN event_type = 'purchase' THEN 'complete' ELSE 'fail' END AS action,
CAST(172800000 AS BIGINT) AS lease_ms, event_id % 3 <> 0 AS transient, CAST(3600000 AS BIGINT) AS delay_ms FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'signup' WHEN event_id % 5 < 3 THEN 'click' ELSE event_type END AS event_type_ FROM events) AS e"""
_SPARK_EVENTS = _EVENTS.replace("{ms}", "unix_seconds(CAST(ts AS TIMESTAMP)) * 1000").replace("event_type =", "event_type_ =")
_DUCK_EVENTS = _EVENTS.replace("{ms}", "epoch_us(ts) // 1000000 * 1000").replace("event_type =", "event_type_ =")


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "at", seq) AS n FROM ({_DUCK_EVENTS})),
w(job, n, status, attempts, expires, not_before, accepted) AS (
  SELECT job, 0::BIGINT, 'none', 0, NULL::BIGINT, NULL::BIGINT, true FROM (SELECT DISTINCT job FROM e)
  UNION ALL SELECT job, n,
    CASE WHEN action = 'enqueue' AND st = 'none' THEN 'pending' WHEN claims THEN 'running' WHEN action = 'complete' AND st = 'running' THEN 'completed' WHEN action = 'fail' AND st = 'running' THEN CASE WHEN transient AND attempts < 3 THEN 'pending' ELSE 'failed' END WHEN action = 'cancel' AND st IN ('pending', 'running') THEN 'cancelled' ELSE st END,
    CASE WHEN claims THEN attempts + 1 ELSE attempts END,
    CASE WHEN claims OR action = 'renew' AND st = 'running' THEN "at" + lease_ms WHEN action IN ('complete', 'fail', 'cancel') AND st = 'running' THEN NULL ELSE ex END,
    CASE WHEN claims THEN NULL WHEN action = 'fail' AND st = 'running' AND transient AND attempts < 3 THEN "at" + delay_ms WHEN action = 'fail' AND st = 'running' OR action = 'cancel' AND st IN ('pending', 'running') THEN NULL ELSE nb END,
    action = 'enqueue' OR claims OR action IN ('renew', 'complete', 'fail') AND st = 'running' OR action = 'cancel' AND st <> 'none'
  FROM (SELECT *, action = 'claim' AND st = 'pending' AND coalesce(nb <= "at", true) AS claims FROM (
    SELECT e.job, e.n, e."at", e.action, e.lease_ms, e.transient, e.delay_ms, w.attempts, w.status = 'running' AND w.expires <= e."at" AS ended,
      CASE WHEN w.status = 'running' AND w.expires <= e."at" THEN CASE WHEN w.attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE w.status END AS st,
      CASE WHEN w.status = 'running' AND w.expires <= e."at" THEN NULL ELSE w.expires END AS ex, CASE WHEN w.status = 'running' AND w.expires <= e."at" THEN NULL ELSE w.not_before END AS nb
    FROM w JOIN e ON e.job = w.job AND e.n = w.n + 1)))
SELECT w.job, e.seq, w.status, w.attempts, w.expires, w.not_before, w.accepted FROM w JOIN e ON e.job = w.job AND e.n = w.n"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_states(_sql(spark, sf_dir, _SPARK_EVENTS, "events")).select("job", "seq", "status", "attempts", "expires", "not_before", "accepted")


_TICKS = "SELECT user_id AS schedule, {ms} AS now, CAST(1704067200000 + user_id * 7200000 AS BIGINT) AS first_at, CASE WHEN user_id % 4 <> 0 THEN CAST(3600000 * (user_id % 40 + 1) AS BIGINT) END AS interval_ms FROM (SELECT DISTINCT user_id, ts FROM events) AS e"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY schedule ORDER BY now) AS n FROM ({_TICKS.replace("{ms}", "epoch_us(ts) // 1000000 * 1000")})),
w(schedule, n, due, scheduled_at, next_at, runs) AS (SELECT schedule, 0::BIGINT, false, NULL::BIGINT, min(first_at), 0 FROM e GROUP BY 1
  UNION ALL SELECT schedule, n, due, CASE WHEN due THEN at_ END, CASE WHEN due THEN at_ + interval_ms ELSE was END, runs + due::INT FROM (
    SELECT e.schedule, e.n, e.interval_ms, w.runs, w.next_at AS was, coalesce(w.next_at <= e.now, false) AS due, CASE WHEN e.interval_ms IS NOT NULL AND e.now - w.next_at > 3600000 THEN w.next_at + (e.now - w.next_at) // e.interval_ms * e.interval_ms ELSE w.next_at END AS at_ FROM w JOIN e ON e.schedule = w.schedule AND e.n = w.n + 1))
SELECT schedule, now, due, scheduled_at, CASE WHEN due THEN 'automation-schedule:' || schedule || ':' || scheduled_at END AS occurrence, next_at, runs FROM w JOIN e USING (schedule, n)"""
)
def schedule_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.schedule_ticks(_sql(spark, sf_dir, _TICKS.replace("{ms}", "unix_seconds(CAST(ts AS TIMESTAMP)) * 1000"), "events")).select("schedule", "now", "due", "scheduled_at", "occurrence", "next_at", "runs")


_LOCKS = "SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, CASE WHEN l_quantity > 25 THEN 'checkin' ELSE 'checkout' END AS action, l_suppkey % 2 AS owner FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({_LOCKS}), w(document, seq, holder, accepted) AS (SELECT document, 0::BIGINT, NULL::BIGINT, true FROM (SELECT DISTINCT document FROM e)
  UNION ALL SELECT e.document, e.seq, CASE WHEN e.action = 'checkout' AND coalesce(w.holder = e.owner, true) THEN e.owner WHEN e.action = 'checkin' AND w.holder = e.owner THEN NULL ELSE w.holder END, CASE WHEN e.action = 'checkout' THEN coalesce(w.holder = e.owner, true) ELSE coalesce(w.holder = e.owner, false) END FROM w JOIN e ON e.document = w.document AND e.seq = w.seq + 1)
SELECT document, seq, holder, accepted FROM w WHERE seq > 0"""
)
def checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sql(spark, sf_dir, _LOCKS, "lineitem").withColumn("seq", F.col("seq").cast("long"))
    return J.checkouts(e).select("document", "seq", "holder", "accepted")


_ROOMS = "SELECT user_id % 20 AS room, event_id AS seq, CASE WHEN event_type IN ('signup', 'view') THEN 'join' ELSE 'post' END AS action, user_id AS participant FROM events"


@query(
    f"""WITH e AS ({_ROOMS}), j AS (SELECT *, coalesce(bool_or(action = 'join') OVER (PARTITION BY room, participant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM e)
SELECT room, seq, action, participant, action = 'join' OR inside AS accepted, sum((CASE WHEN action = 'join' THEN NOT inside ELSE inside END)::INT) OVER (PARTITION BY room ORDER BY seq)::BIGINT AS revision FROM j"""
)
def review_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.review_rooms(_sql(spark, sf_dir, _ROOMS, "events"))


_MENTIONS = "SELECT 's' || p_size AS source, p_brand AS annotation, CASE WHEN p_partkey % 2 = 0 THEN 'c1' END AS comment, 'reviewer-a' AS actor, '2026-01-0' || (p_partkey % 3 + 1) AS at, 'hi @' || lower(substr(p_name, 1, 3)) || ' and @ann, x@bob @ann' AS text FROM part"


@query(
    f"""WITH m AS (SELECT *, 'reviewer-' || unnest(CASE WHEN regexp_matches(text, 'hi @[a-z0-9]') THEN [lower(regexp_extract(text, 'hi @([a-z0-9._-]+)', 1)), 'ann'] ELSE ['ann'] END) AS reviewer FROM ({_MENTIONS})),
h AS (SELECT *, sha256('{{"annotationId":"' || annotation || '","commentId":' || CASE WHEN comment IS NULL THEN 'null' ELSE '"' || comment || '"' END || ',"mentionedReviewer":"' || reviewer || '","schemaVersion":1,"sourceSha256":"' || source || '","timestamp":"' || "at" || '"}}') AS event_id FROM m)
SELECT DISTINCT event_id, reviewer, actor, annotation, comment FROM h"""
)
def mention_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.mentions(_sql(spark, sf_dir, _MENTIONS, "part"))


@query(
    """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 0), e AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS s FROM lineitem),
f AS (SELECT *, first_value(s) OVER (PARTITION BY k ORDER BY n) AS one FROM e)
SELECT f.k, f.n, CASE WHEN coalesce(l.s, CASE WHEN n > 1 THEN one END) IS NULL THEN 'appended' WHEN coalesce(l.s, one) = f.s THEN 'same' ELSE 'conflict' END AS status FROM f LEFT JOIN l ON l.k = f.k"""
)
def audit_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _t(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    events = _sql(spark, sf_dir, "SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS n, CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS s FROM lineitem", "lineitem")
    return J.appended(log, events, "k", "n", ["s"])


@query("SELECT user_id, event_id, CASE WHEN event_id > stop THEN 'not-attempted' WHEN event_id = stop THEN 'stopped' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM (SELECT *, min(event_id) FILTER (event_type = 'error' AND value > 50) OVER (PARTITION BY user_id) AS stop FROM events)")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "E").alias("error"), "value")
    return J.batch_results(e, "user_id", "event_id", "error", F.col("error").isNotNull() & (F.col("value") > 50)).select("user_id", "event_id", "status")


@query("""SELECT user_id, '{"complete":' || (count(*) FILTER (event_type = 'error') = 0)::VARCHAR || ',"events":' || count(*) || ',"failed":' || count(*) FILTER (event_type = 'error') || ',"ok":' || count(*) FILTER (event_type <> 'error') || '}' AS line FROM events GROUP BY 1""")
def event_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.event_manifest(_t(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status")), "user_id")


@query("SELECT user_id, event_id, row_number() OVER w::INT AS number, CASE WHEN event_id % 9 = 0 THEN false ELSE true END AS linked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = _t(spark, sf_dir, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    parent = F.lag("digest").over(Window.partitionBy("user_id").orderBy("event_id"))
    v = v.withColumn("parent", F.when(F.col("event_id") % 9 == 0, "other").otherwise(parent))
    return J.version_history(v, "user_id", "event_id").select("user_id", "event_id", "number", "linked")


@query("""SELECT DISTINCT ON (id) sha256(event_type || '|' || b) AS id, event_type AS kind, b AS body, strlen(b)::BIGINT AS n_bytes FROM (SELECT event_type, '{"user_id":' || user_id || '}' AS b FROM events)""")
def webhook_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.outbox(_t(spark, sf_dir, "events"), "event_id", "event_type", ["user_id"]).drop("event_id")


_POLLS = "SELECT CAST(l_linenumber AS INT) AS poll, 'f' || l_orderkey AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS signature FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) AS d"


@query(
    f"""WITH p AS ({_POLLS}), s AS (SELECT *, coalesce(lag(signature) OVER w = signature AND lag(poll) OVER w = poll - 1, false) AS same FROM p WINDOW w AS (PARTITION BY name ORDER BY poll)),
r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY poll) AS run FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY name, run ORDER BY poll) AS k FROM r),
c AS (SELECT poll, name, signature FROM n WHERE k = 2 AND NOT (signature = 'b' AND name LIKE '%7')) SELECT poll, name, signature FROM (SELECT *, row_number() OVER (PARTITION BY poll ORDER BY name) AS m FROM c) WHERE m <= 50"""
)
def stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireframe.streaming.events import stable_files as stable

    polls = _sql(spark, sf_dir, _POLLS, "lineitem")
    return stable(polls, polls.filter("name LIKE '%7' AND signature = 'b'").distinct(), 50)
