"""Registered queries of runs, decisions and scans, applied to columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import runs, scan
from marketlens.plans.queries import _t, query


@query("""WITH e AS (SELECT 'user' || user_id % 40 AS name, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'delete' WHEN 1 THEN 'revoke' WHEN 2 THEN 'enable' WHEN 3 THEN 'topup' WHEN 4 THEN 'reissue' ELSE 'add' END AS action, event_id % 50 + 1 AS amount, '2024-01-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS expires FROM events),
l AS (SELECT *, coalesce(sum((action = 'delete')::INT) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM e),
b AS (SELECT *, min(seq) FILTER (WHERE action = 'add') OVER (PARTITION BY name, life) AS born FROM l),
g AS (SELECT name, life, max(amount) FILTER (WHERE seq = born) + coalesce(sum(amount) FILTER (WHERE action = 'topup'), 0) AS "limit", max(expires) FILTER (WHERE seq = born) AS expires, coalesce(arg_max(action = 'revoke', seq) FILTER (WHERE action IN ('revoke', 'enable')), false) AS disabled, count(*) FILTER (WHERE action = 'reissue') + 1 AS codes, bool_or(action = 'delete') AS deleted FROM b WHERE seq >= born GROUP BY name, life)
SELECT name, "limit"::BIGINT AS "limit", expires, disabled, codes FROM g WHERE NOT deleted""")
def q37_invites(spark, d):
    """The invites that a log of admin commands leaves."""
    k = F.col("event_id")
    action = F.when(k % 9 == 0, "delete").when(k % 9 == 1, "revoke").when(k % 9 == 2, "enable").when(k % 9 == 3, "topup").when(k % 9 == 4, "reissue").otherwise("add")
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    return runs.invites(_t(spark, d, "events").select(F.concat(F.lit("user"), (F.col("user_id") % 40).cast("string")).alias("name"), k.alias("seq"), action.alias("action"), (k % 50 + 1).alias("amount"), day.alias("expires")))


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN '2024-06-30' ELSE '2024-' || (c_custkey % 12 + 1) || '-9' END AS expires, CASE WHEN c_custkey % 7 != 0 THEN c_custkey % 30 END AS lim, c_custkey % 11 = 0 AS off, c_custkey % 13 AS fails, c_custkey % 40 AS used, ' code' || c_custkey || ' ' AS code, c_name FROM customer)
SELECT c_custkey, CASE WHEN fails >= 10 THEN 'too_many_failures' WHEN lim IS NULL OR off THEN 'invite_invalid' WHEN expires != '' AND coalesce(DATE '2024-06-15' > try_strptime(expires, '%Y-%m-%d')::DATE, true) THEN 'invite_expired' END AS refusal, least(used, lim) AS used, sha256(trim(code)) AS hash,
substr(sha256(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '10.0.0.' || c_custkey % 9 END), 1, 16) AS caller FROM r""")
def q37_access(spark, d):
    """Whether a code gives access, what is left of it, and the keys that code and caller go by."""
    k = F.col("c_custkey")
    expires = F.when(k % 5 == 0, "").when(k % 5 == 1, "soon").when(k % 5 == 2, "2024-06-30").otherwise(F.concat(F.lit("2024-"), (k % 12 + 1).cast("string"), F.lit("-9")))
    limit = F.when(k % 7 != 0, k % 30)
    why = runs.refusal(k % 13, limit, k % 11 == 0, runs.expired(expires, F.lit("2024-06-15").cast("date")))
    caller = runs.client_key(F.when(k % 2 == 0, F.concat(F.lit(" "), "c_name", F.lit(", 10.1.1.1"))), F.concat(F.lit("10.0.0."), (k % 9).cast("string")))
    return _t(spark, d, "customer").select("c_custkey", why.alias("refusal"), runs.peeked(k % 40, limit).alias("used"), runs.code_hash(F.concat(F.lit(" code"), k.cast("string"), F.lit(" "))).alias("hash"), caller.alias("caller"))


@query("""WITH s AS (SELECT user_id, event_id, ts, 1 + event_id % 2 AS calls, event_type != 'click' AS answered FROM events),
b AS (SELECT *, coalesce(sum(calls) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM s),
f AS (SELECT user_id, NOT arg_min(answered, (ts, event_id)) AS refunded FROM s GROUP BY user_id)
SELECT user_id, event_id, spent::BIGINT AS spent, spent + 2 <= 30 AS ok, refunded FROM b JOIN f USING (user_id)""")
def q38_budget(spark, d):
    """Call budgets of runs, and which runs get their use back."""
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", (1 + F.col("event_id") % 2).alias("calls"), (F.col("event_type") != "click").alias("answered"))
    back = runs.refunded(e, ["user_id"], F.struct("ts", "event_id"), F.col("answered"))
    return runs.call_budget(e, ["user_id"], [F.col("ts"), F.col("event_id")], "calls").join(back, "user_id").select("user_id", "event_id", "spent", "ok", "refunded")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS phase FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, phase, event_type ORDER BY ts, event_id) AS done FROM e)
SELECT user_id, event_id, back::INTEGER AS back, phase::BIGINT AS phase, done::INTEGER AS done, CASE WHEN back = 1 THEN props END AS props FROM p WHERE back <= 30""")
def q38_history(spark, d):
    """Each run's last thirty events with their phase, of which the last keeps its details."""
    e = _t(spark, d, "events")
    up, down = [F.col("ts"), F.col("event_id")], [F.col("ts").desc(), F.col("event_id").desc()]
    rows = runs.phases(e, ["user_id"], up, F.col("event_type") == "purchase", F.col("event_type"))
    rows = runs.latest(runs.trimmed(rows, ["user_id"], down, ["props"]), ["user_id"], down)
    return rows.select("user_id", "event_id", "back", "phase", "done", "props")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: abs(x)::DOUBLE) AS a FROM embeddings), s AS (SELECT vec_id, a, list_sum(a) AS t FROM v),
p AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN vec_id % 5 = 0 THEN x ELSE x / t END) AS p FROM s), c AS (SELECT vec_id, p, list_position(p, list_max(p)) AS top, ['a', 'b', 'c', 'd'] AS ids FROM p),
q AS (SELECT vec_id, p, CASE WHEN vec_id % 7 = 0 THEN 'z' WHEN vec_id % 7 = 1 THEN 'a' ELSE ids[top] END AS choice, ids FROM c)
SELECT vec_id, choice, coalesce(choice != 'z' AND list_min(p) >= 0 AND list_max(p) <= 1 AND abs(list_sum(p) - 1) < 0.02 AND p[list_position(ids, choice)] >= list_max(p) - 1e-6, false) AS valid,
(SELECT string_agg(k, ',' ORDER BY x DESC, k) FROM (SELECT k, x FROM (SELECT unnest(ids) AS k, unnest(p) AS x) WHERE k != choice ORDER BY x DESC, k LIMIT 2)) AS others FROM q""")
def q39_choices(spark, d):
    """Whether answers are valid, and their two most probable alternatives."""
    a = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x).cast("double"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    k = F.col("vec_id")
    rows = _t(spark, d, "embeddings").select("vec_id", a.alias("a")).withColumn("p", F.when(k % 5 == 0, F.col("a")).otherwise(F.transform("a", lambda x: x / total)))
    ids = F.array(*[F.lit(x) for x in "abcd"])
    best = F.element_at(ids, F.array_position("p", F.array_max("p")).cast("int"))
    choice = F.when(k % 7 == 0, "z").when(k % 7 == 1, "a").otherwise(best)
    rows = rows.select("vec_id", F.map_from_arrays(ids, "p").alias("m"), choice.alias("choice"))
    return rows.select("vec_id", "choice", runs.valid_choice(F.col("choice"), F.col("m"), ids).alias("valid"), F.array_join(runs.alternatives(F.col("m"), F.col("choice")), ",").alias("others"))


@query("""WITH a AS (SELECT o_custkey, (o_orderkey % 3) AS chunk, CASE WHEN o_orderkey % 4 = 0 THEN 'NONE' ELSE 'o' || o_orderkey END AS option, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS probability FROM orders),
t AS (SELECT o_custkey, chunk, arg_min(option, (-probability, option)) AS option, max(probability) AS probability FROM a GROUP BY ALL),
b AS (SELECT o_custkey, arg_min(option, (-probability, chunk)) FILTER (WHERE option != 'NONE') AS choice, coalesce(max(probability) FILTER (WHERE option != 'NONE'), 0) AS probability FROM t GROUP BY o_custkey)
SELECT *, CASE WHEN probability >= 0.8 THEN choice END AS base FROM b""")
def q39_chunks(spark, d):
    """The best answer over several chunks of options."""
    k = F.col("o_orderkey")
    a = _t(spark, d, "orders").select("o_custkey", (k % 3).alias("chunk"), F.when(k % 4 == 0, runs.NONE_OF_THESE).otherwise(F.concat(F.lit("o"), k.cast("string"))).alias("option"), (k * 7919 % 1000 / F.lit(1000.0)).alias("probability"))
    return runs.best_of_chunks(a, ["o_custkey"])


@query("""SELECT event_id, event_id % 6 IN (0, 1, 2) AS ok, 0.01 * (event_id % 100) < 0.5 AS asked_again, (event_id % 10 + CASE WHEN event_id % 100 < 50 THEN event_id % 7 ELSE 0 END)::BIGINT AS tokens FROM events""")
def q39_replies(spark, d):
    """Shapes of replies, and the usage of a decision that was asked for again when its target was unsure."""
    k = F.col("event_id")
    shapes = ['{"answers": {"a": 1}, "usage": {"in": 3, "out": 1.5}}', '{"answers": {}}', '{"answers": {"a": {}}, "usage": {}}', '{"answers": [1]}', '{"answers": {}, "usage": {"in": "3"}}', "not json"]
    reply = F.element_at(F.array(*[F.lit(s) for s in shapes]), (k % 6 + 1).cast("int"))
    unsure = k % 100 / F.lit(100.0) < 0.5
    usage = runs.summed_usage(F.create_map(F.lit("in"), k % 10), F.when(unsure, F.create_map(F.lit("in"), k % 7)).otherwise(F.create_map(F.lit("out"), F.lit(0).cast("long"))))
    return _t(spark, d, "events").select("event_id", runs.provider_reply_ok(reply).alias("ok"), unsure.alias("asked_again"), usage["in"].alias("tokens"))


@query("""WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, CASE o_orderkey % 5 WHEN 0 THEN 'no_rows' WHEN 1 THEN 'row_mismatch' WHEN 2 THEN 'no_anchor' WHEN 3 THEN 'passed' ELSE 'login_required' END AS code, o_orderkey % 2 = 0 AS shown, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 500 ELSE 200 END AS status FROM orders),
a AS (SELECT o_custkey, coalesce(min(n) FILTER (WHERE NOT (code IN ('no_rows', 'row_mismatch', 'no_anchor') OR (code = 'passed' AND NOT shown))), max(n)) AS attempt FROM r WHERE n <= 6 GROUP BY o_custkey),
t AS (SELECT o_custkey, min(n) FILTER (WHERE status IS NOT NULL AND status NOT IN (429, 503, 529)) AS e, max(n) AS m FROM r WHERE n <= 3 GROUP BY o_custkey)
SELECT a.o_custkey, a.attempt::INTEGER AS attempt, r.code, coalesce(t.e, t.m)::INTEGER AS tries, CASE WHEN t.e IS NULL THEN 'unavailable' WHEN s.status < 400 THEN 'answered' ELSE 'error' END AS outcome, least(0.5 * 2 ** (coalesce(t.e, t.m) - 1), 1.5) AS pause
FROM a JOIN r ON r.o_custkey = a.o_custkey AND r.n = a.attempt JOIN t ON t.o_custkey = a.o_custkey LEFT JOIN r s ON s.o_custkey = t.o_custkey AND s.n = t.e""")
def q48_attempts(spark, d):
    """Bounded reads and retries: which attempt stands, and how long a failed one would wait."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(k % 5 == 0, "no_rows").when(k % 5 == 1, "row_mismatch").when(k % 5 == 2, "no_anchor").when(k % 5 == 3, "passed").otherwise("login_required").alias("code"), (k % 2 == 0).alias("shown"), F.when(k % 7 == 0, None).when(k % 7 == 1, 429).when(k % 7 == 2, 503).when(k % 7 == 3, 500).otherwise(200).alias("status"))
    read = runs.settled_read(o, ["o_custkey"], F.col("at"), F.col("code"), F.col("shown"))
    tried = runs.retried(o, ["o_custkey"], F.col("at"), F.col("status"))
    return read.join(tried, "o_custkey").withColumn("pause", runs.backoff(F.col("tries") - 1, 0.5, 1.5))


@query("""WITH r AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS n FROM events),
d AS (SELECT event_type, user_id, n // 2 AS pair, max(value) FILTER (WHERE n % 2 = 1) - max(value) FILTER (WHERE n % 2 = 0) AS delta FROM r GROUP BY ALL HAVING count(*) = 2),
g AS (SELECT event_type, user_id, count(*) AS pairs, count(*) FILTER (WHERE delta > 0) AS faster, round(quantile_cont(delta, 0.5), 6) AS median_delta FROM d GROUP BY ALL)
SELECT *, CASE WHEN faster = pairs OR (faster >= pairs - 1 AND median_delta > 0) THEN 'supported' WHEN faster <= pairs // 4 AND median_delta <= 0 THEN 'not supported' ELSE 'inconclusive' END AS verdict FROM g""")
def q42_paired(spark, d):
    """Verdicts over differences of adjacent runs."""
    deltas = runs.paired_deltas(_t(spark, d, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")], "value")
    return runs.delta_verdict(deltas, ["event_type", "user_id"]).withColumn("median_delta", F.round("median_delta", 6))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x) * 20) % 4)::INTEGER) AS l FROM embeddings)
SELECT vec_id, array_to_string(list_filter(list_transform(l, lambda x, i: CASE WHEN i = 1 OR x != l[i - 1] THEN x END), lambda x: x IS NOT NULL AND x != 0), '') AS read FROM v""")
def q47_collapse(spark, d):
    """Step-by-step labels collapsed to what was read."""
    # The product is a float, as the cells are: as a double, a cell just below a step would stay below it.
    labels = F.transform("embedding", lambda x: (F.floor(F.abs(x) * F.lit(20.0).cast("float")) % 4).cast("int"))
    rows = _t(spark, d, "embeddings").select("vec_id", labels.alias("l"))
    return rows.select("vec_id", F.array_join(F.transform(runs.collapsed(F.col("l")), lambda x: x.cast("string")), "").alias("read"))


@query("""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: least(255.0, abs(x)::DOUBLE * 500)) AS g FROM embeddings), k AS (SELECT vec_id, array_to_string(list_transform(g, lambda x: least(5, floor(x / (256 / 6.0)))::BIGINT), '') AS key, array_to_string(list_transform(g, lambda x: CASE WHEN x >= list_avg(g) THEN '1' ELSE '0' END), '') AS hash FROM c),
p AS (SELECT vec_id, key, hash, lag(key) OVER (ORDER BY vec_id) AS prev FROM k)
SELECT vec_id, key, CASE WHEN prev IS NOT NULL THEN len(list_filter(range(1, length(key) + 1), lambda i: substr(key, i, 1) != substr(prev, i, 1))) END::INTEGER AS moved FROM p""")
def q49_content_keys(spark, d):
    """Content keys of grids, and in how many cells they differ from the vector before."""
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.abs(x).cast("double") * 500))
    rows = _t(spark, d, "embeddings").select("vec_id", scan.content_key(grey).alias("key"))
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("key").alias("prev"))
    return rows.join(before, "vec_id", "left").select("vec_id", "key", T.key_distance(F.col("key"), F.col("prev")).alias("moved"))


@query("""WITH m AS (SELECT user_id, event_id, ts, value < 50 AS dark, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 50 ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, dark, island ORDER BY ts, event_id) AS streak FROM m) SELECT user_id, event_id, dark, streak::INTEGER AS streak, dark AND streak >= 3 AS black FROM s""")
def q40_dark_runs(spark, d):
    """Runs of dark frames."""
    rows = scan.dark_runs(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value"), 3, 50.0)
    return rows.select("user_id", "event_id", "dark", "streak", "black")


@query("""WITH s AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) - 1 AS frames, sum(value) AS secs FROM events GROUP BY ALL),
w AS (SELECT *, count(*) FILTER (WHERE frames > 0) OVER x AS n, avg(CASE WHEN frames > 0 THEN frames END) OVER x AS m FROM s WINDOW x AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT user_id, epoch(h)::BIGINT AS h, CASE WHEN n >= 3 THEN round(m, 6) END AS fps, greatest(1, CASE WHEN frames > 0 THEN round(12 * 7 / frames::DOUBLE)::BIGINT END) AS eta FROM w""")
def q41_rates(spark, d):
    """Frame rates of the last seconds that had frames, and how long a queue will take."""
    s = _t(spark, d, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg((F.count("*") - 1).alias("frames"))
    rows = scan.frame_rate(s, ["user_id"], [F.col("h")], F.col("frames"))
    return rows.select("user_id", F.unix_timestamp("h").alias("h"), F.round("fps", 6).alias("fps"), scan.queue_eta(F.lit(12), F.lit(7.0), F.col("frames")).alias("eta"))


@query()
def q49_admission(spark, d):
    """Keys admitted to a bounded queue, each user's events as a session."""
    k = F.col("event_id")
    key = F.rpad(F.conv(F.substring(F.sha2(F.concat("event_type", F.floor("value").cast("string")), 256), 1, 12), 16, 4), 24, "0")
    event = F.when(k % 11 == 0, "taken").when(k % 13 == 0, "failed").otherwise("add")
    return scan.admitted_keys(_t(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), k.alias("ts"), event.alias("event"), key.alias("key")), most=20)


@query("""WITH RECURSIVE v AS (SELECT user_id::VARCHAR AS session, event_id * 30 AS ts, floor(value / 40)::BIGINT AS v, event_id % 17 != 0 AS shown FROM events),
r AS (SELECT session, ts, CASE WHEN shown THEN v * 4 END AS x, v % 3 AS y, v::VARCHAR AS hash, rpad(v::VARCHAR, 16, '0') AS key, row_number() OVER (PARTITION BY session ORDER BY ts) AS n FROM v),
s AS (
  SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS ts, NULL::BIGINT AS used, 0::BIGINT AS streak, false AS told, NULL::BIGINT AS x, NULL::BIGINT AS y, NULL::VARCHAR AS hash, NULL::BIGINT AS hx, NULL::BIGINT AS hy, NULL::VARCHAR AS hkey, NULL::VARCHAR AS state FROM r
  UNION ALL
  SELECT session, n, ts, CASE WHEN state = 'skipped' THEN used ELSE ts END, CASE WHEN state = 'none' THEN 0 WHEN state IN ('skipped', 'held') THEN streak ELSE run END,
    CASE WHEN state IN ('skipped', 'held') THEN told ELSE state = 'emitted' OR state = 'waiting' AND same AND told END, CASE WHEN state = 'none' THEN NULL WHEN state IN ('skipped', 'held') OR same THEN x ELSE nx END,
    CASE WHEN state = 'none' THEN NULL WHEN state IN ('skipped', 'held') OR same THEN y ELSE ny END, CASE WHEN state = 'none' THEN NULL WHEN state IN ('skipped', 'held') OR same THEN hash ELSE nhash END,
    CASE state WHEN 'none' THEN NULL WHEN 'emitted' THEN nx ELSE hx END, CASE state WHEN 'none' THEN NULL WHEN 'emitted' THEN ny ELSE hy END, CASE state WHEN 'none' THEN NULL WHEN 'emitted' THEN nkey ELSE hkey END, state
  FROM (
    SELECT *, CASE WHEN coalesce(ts - used < 66, false) THEN 'skipped' WHEN nx IS NULL THEN 'none' WHEN held THEN 'held' WHEN run < 2 OR same AND told THEN 'waiting' ELSE 'emitted' END AS state FROM (
      SELECT *, CASE WHEN same THEN streak + 1 ELSE 1 END AS run FROM (
        SELECT r.session, r.n, r.ts, r.x AS nx, r.y AS ny, r.hash AS nhash, r.key AS nkey, s.used, s.streak, s.told, s.x, s.y, s.hash, s.hx, s.hy, s.hkey, coalesce(abs(s.x - r.x) <= 2 AND abs(s.y - r.y) <= 2 AND s.hash = r.hash, false) AS same,
          coalesce(abs(hx - r.x) <= 6 AND abs(hy - r.y) <= 6 AND len(list_filter(range(1, 17), lambda i: substr(r.key, i, 1) != substr(hkey, i, 1))) <= 4, false) AS held
        FROM s JOIN r ON r.session = s.session AND r.n = s.n + 1))))
SELECT session, ts, state FROM s WHERE n > 0""")
def q40_stable_frames(spark, d):
    """Stable and held panels, each user's events as a session of frames."""
    k = F.col("event_id")
    v = F.floor(F.col("value") / 40)
    frames = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), (k * 30).alias("ts"), F.when(k % 17 != 0, v * 4).alias("x"), (v % 3).alias("y"), F.lit(100).alias("width"), F.lit(50).alias("height"), v.cast("string").alias("hash"), F.rpad(v.cast("string"), 16, "0").alias("key"))
    return scan.stable_frames(frames)
