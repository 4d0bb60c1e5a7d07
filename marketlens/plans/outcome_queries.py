"""Registered queries of outcomes, sentences and search conditions, applied to columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import market, outcomes, stats_form
from marketlens.plans.queries import _t, query

_CHECK_CASE = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in outcomes.CHECKS.items()) + f" ELSE '{outcomes.OTHER_CHECK}' END"


@query("""WITH r AS (SELECT c_mktsegment, c_nationkey, CASE WHEN o_orderstatus IS NOT NULL AND o_orderstatus != 'F' OR o_orderpriority IS NOT NULL AND o_orderpriority != '1-URGENT' THEN 'hide' WHEN o_orderstatus IS NULL OR o_orderpriority IS NULL THEN 'unknown' ELSE 'keep' END AS v FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
g AS (SELECT c_mktsegment, c_nationkey, count(*) AS read, count(*) FILTER (WHERE v = 'keep') AS kept, count(*) FILTER (WHERE v != 'keep') AS hidden, count(*) FILTER (WHERE v = 'unknown') AS unknown, CASE c_nationkey % 4 WHEN 0 THEN 'NOT_RUN' WHEN 1 THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN c_nationkey % 8 = 1 THEN 'timeout' END AS reason FROM r GROUP BY ALL)
SELECT c_mktsegment, c_nationkey, CASE WHEN status = 'NOT_RUN' THEN '尚未讀取。' WHEN status != 'PASSED' THEN coalesce(reason, '讀取失敗') WHEN kept = 0 THEN '篩選後沒有符合的資料（原本讀到 ' || read || ' 筆）' ELSE '' END AS note,
CASE WHEN status = 'NOT_RUN' THEN '' WHEN c_nationkey % 3 = 0 THEN kept || '/' || read ELSE read || '' END AS tab,
'篩選中：F · 1-URGENT　隱藏 ' || hidden || ' 筆' || CASE WHEN unknown > 0 THEN '（其中 ' || unknown || ' 筆網站沒標示）' ELSE '' END || CASE WHEN kept < 10 AND c_nationkey % 2 = 0 THEN '　可到首頁調高「多讀幾批」' ELSE '' END AS line,
CASE status WHEN 'NOT_RUN' THEN '未讀取' WHEN 'FAILED' THEN '讀取失敗' ELSE '已讀取' END AS label FROM g""")
def q10_view_lines(spark, d):
    """What a view and its filter say."""
    filters = market.normal_filters({"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "other": "x"}, {"o_orderstatus": ("F", "O", "P"), "o_orderpriority": ("1-URGENT", "2-HIGH"), "c_name": ("",)})
    rows = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_nationkey")
    g = market.filter_counts(rows, filters, ["c_mktsegment", "c_nationkey"]).withColumn("read", F.col("kept") + F.col("hidden"))
    status, reason = F.when(k % 4 == 0, "NOT_RUN").when(k % 4 == 1, "FAILED").otherwise("PASSED"), F.when(k % 8 == 1, "timeout")
    line = outcomes.filter_line(F.lit(market.describe_filters(filters)), F.col("hidden"), F.col("unknown"), F.col("kept"), k % 2 == 0)
    return g.select("c_mktsegment", "c_nationkey", outcomes.view_note(status, reason, F.col("read"), F.col("kept")).alias("note"), outcomes.tab_count(status, F.col("read"), F.col("kept"), k % 3 == 0).alias("tab"), line.alias("line"), outcomes.status_label(status).alias("label"))


@query("""WITH p AS (SELECT user_id, event_type, CASE WHEN value > 50 THEN floor(value)::BIGINT END AS price FROM events),
g AS (SELECT user_id, event_type, count(*) AS n, count(price) AS priced, min(price) AS lo, quantile_disc(price, 0.5) AS med, CASE WHEN count(price) >= 4 THEN quantile_disc(price, 0.25) END AS q1, CASE WHEN count(price) >= 4 THEN quantile_disc(price, 0.75) END AS q3 FROM p GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN priced = 0 THEN '' ELSE '價格（High Rune Value）：最低 ' || lo || '、中位數 ' || med || CASE WHEN q1 IS NOT NULL THEN '、四分位 ' || q1 || '–' || q3 ELSE '' END || '（共 ' || n || ' 筆' || CASE WHEN priced < n THEN '，' || (n - priced) || ' 筆沒有標價' ELSE '' END || '）' END AS sentence FROM g""")
def q13_price_sentence(spark, d):
    """Price summaries as sentences."""
    rows = _t(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") > 50, F.floor("value")).alias("price"))
    g = market.price_summary(rows, "price", ["user_id", "event_type"])
    s = outcomes.price_sentence(F.col("rows"), F.col("priced"), *[F.col(c).cast("long").cast("string") for c in ("min_price", "median_price", "q1_price", "q3_price")])
    return g.select("user_id", "event_type", s.alias("sentence"))


@query(f"""WITH c AS (SELECT doc_id, q, list_filter([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'home_page' END, CASE WHEN n_chars < 1000 THEN 'trading_rows_ok' END, CASE WHEN n_chars < 500 THEN 'other' END, CASE WHEN n_chars < 300 THEN 'another' END], lambda x: x IS NOT NULL) AS failed FROM (SELECT d.*, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id))),
e AS (SELECT doc_id, q, len(failed) = 0 AS passed, list_transform(failed, lambda c: {_CHECK_CASE}) AS s FROM c),
u AS (SELECT doc_id, q, passed, list_filter(s, lambda x, i: list_position(s, x) = i) AS s FROM e)
SELECT doc_id, array_to_string(s, '|') AS reasons, CASE WHEN q IS NULL OR passed THEN NULL ELSE '部分資料沒通過核對：' || array_to_string(s, '；') END AS refusal FROM u""")
def q34_failed_checks(spark, d):
    """Failed checks in words, and why an export is refused."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    n = F.coalesce("n_chars", F.lit(1000))
    rows = docs.select("doc_id", "quality", *market.checks_summary({"home_page": F.col("lang") == "en", "trading_rows_ok": n >= 1000, "other": n >= 500, "another": n >= 300}))
    ran = F.when(F.col("quality").isNotNull(), F.col("passed"))
    return rows.select("doc_id", F.array_join(outcomes.explain_checks(F.col("failed_checks")), "|").alias("reasons"), outcomes.export_blocked(ran, F.col("failed_checks")).alias("refusal"))


_STATES = "CASE o_orderkey % 4 WHEN 0 THEN 'NOT_RUN' WHEN 1 THEN 'PASSED' WHEN 2 THEN 'FAILED' ELSE 'BLOCKED' END AS t, CASE o_custkey % 3 WHEN 0 THEN 'NOT_RUN' WHEN 1 THEN 'PASSED' ELSE 'BLOCKED' END AS r, o_orderkey % 5 < 3 AS running, CASE o_orderkey % 7 WHEN 0 THEN 'trading' WHEN 1 THEN 'recent_trades' END AS phase, CASE WHEN o_custkey % 5 = 0 THEN 'table' END AS layer, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 2 = 0 END AS ok"
_STEP = "CASE WHEN {0} = 'PASSED' THEN 'done' WHEN {0} IN ('FAILED', 'BLOCKED') THEN 'failed' WHEN {1} THEN 'active' ELSE 'pending' END"


@query(f"""WITH s AS (SELECT o_orderkey, o_custkey, {_STATES} FROM orders), f AS (SELECT *, layer IS NOT NULL OR phase IS NOT NULL OR t != 'NOT_RUN' OR r != 'NOT_RUN' AS found FROM s)
SELECT o_orderkey, CASE WHEN found THEN 'done' WHEN running THEN 'active' ELSE 'pending' END AS find, {_STEP.format("t", "running AND (coalesce(phase, '') = 'trading' OR (found AND phase IS NULL))")} AS trading, {_STEP.format("r", "running AND coalesce(phase, '') = 'recent_trades'")} AS recent_trades,
CASE WHEN ok THEN 'done' WHEN NOT ok THEN 'failed' WHEN running AND t != 'NOT_RUN' AND r != 'NOT_RUN' THEN 'active' ELSE 'pending' END AS verify,
CASE WHEN o_orderkey % 13 = 0 THEN 'stopped' WHEN o_custkey % 17 = 0 THEN 'problem: guard' WHEN o_custkey % 17 = 1 THEN 'problem: not found' WHEN o_orderkey % 19 = 0 AND o_custkey % 2 = 0 THEN 'problem: captcha' WHEN o_orderkey % 19 = 0 THEN 'problem: scope' WHEN t = 'BLOCKED' OR r = 'BLOCKED' THEN 'problem: blocked view' ELSE 'done' END AS outcome,
CASE WHEN o_custkey % 23 = 0 THEN 'settings' WHEN o_custkey % 29 = 0 THEN 'welcome' WHEN running THEN 'running' WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_custkey % 4 = 0 THEN 'listing' WHEN o_custkey % 4 = 1 THEN 'scan' WHEN o_custkey % 4 = 2 THEN 'scan' ELSE 'ready' END AS screen,
CASE WHEN o_custkey % 29 = 0 THEN '' WHEN o_custkey % 31 = 0 THEN 'no such code' WHEN o_orderkey % 40 >= 20 + o_custkey % 10 THEN '這組邀請碼的 ' || (20 + o_custkey % 10) || ' 次查詢已用完' ELSE '' END AS blocked FROM f""")
def q45_outcomes(spark, d):
    """Steps, outcome, screen and what blocks a start, for the states that orders stand for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.when(k % 4 == 0, "NOT_RUN").when(k % 4 == 1, "PASSED").when(k % 4 == 2, "FAILED").otherwise("BLOCKED")
    r = F.when(c % 3 == 0, "NOT_RUN").when(c % 3 == 1, "PASSED").otherwise("BLOCKED")
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey", t.alias("t"), r.alias("r"), (k % 5 < 3).alias("running"), F.when(k % 7 == 0, "trading").when(k % 7 == 1, "recent_trades").alias("phase"), F.when(c % 5 == 0, "table").alias("layer"), F.when(k % 11 == 0, k % 2 == 0).alias("ok"))
    col = F.col
    outcome = outcomes.run_outcome(k % 13 == 0, F.when(c % 17 == 0, "guard").when(c % 17 == 1, "not_found").otherwise("ran"), F.when(k % 19 == 0, "blocked").otherwise("done"), F.when(c % 2 == 0, "captcha"), (col("t") == "BLOCKED").cast("int") + (col("r") == "BLOCKED").cast("int"))
    screen = outcomes.derived_view(c % 23 == 0, c % 29 != 0, col("running"), F.when(k % 3 == 0, "done"), F.when(c % 4 == 0, "listing").when(c % 4 == 1, "scan").when(c % 4 == 3, "name"))
    blocked = outcomes.block_reason(c % 29 != 0, F.when(c % 31 == 0, "no such code"), k % 40, 20 + c % 10)
    return rows.select("o_orderkey", *outcomes.progress(col("layer"), col("phase"), col("running"), col("t"), col("r"), col("ok")), outcome.alias("outcome"), screen.alias("screen"), blocked.alias("blocked"))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'not_found' WHEN 2 THEN 'stop' WHEN 3 THEN 'not_found_or_slug' WHEN 4 THEN 'known_gap' ELSE 'pass' END AS expect, CASE o_custkey % 5 WHEN 0 THEN '已停止' WHEN 1 THEN '找不到這個裝備' WHEN 2 THEN '防護頁' ELSE '完成' END AS status,
o_orderkey % 37 = 0 AS late, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS rows, o_orderstatus = 'F' AS passed, o_custkey % 7 != 0 AS slug FROM orders)
SELECT o_orderkey, CASE WHEN late THEN 'FAIL' WHEN status = '防護頁' THEN 'BLOCKED' WHEN expect IN ('error', 'not_found') THEN CASE WHEN contains(status, '找不到') AND rows = 0 THEN 'PASS' ELSE 'FAIL' END WHEN expect = 'stop' THEN CASE WHEN status = '已停止' THEN 'PASS' ELSE 'FAIL' END
WHEN expect = 'not_found_or_slug' THEN CASE WHEN contains(status, '找不到這個裝備') AND rows = 0 OR passed AND slug THEN 'PASS' ELSE 'FAIL' END WHEN expect = 'known_gap' THEN 'GAP' WHEN passed AND slug THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def q45_verdicts(spark, d):
    """Verdicts of cases by what they expect."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    expect = F.when(k % 6 == 0, "error").when(k % 6 == 1, "not_found").when(k % 6 == 2, "stop").when(k % 6 == 3, "not_found_or_slug").when(k % 6 == 4, "known_gap").otherwise("pass")
    status = F.when(c % 5 == 0, "已停止").when(c % 5 == 1, "找不到這個裝備").when(c % 5 == 2, "防護頁").otherwise("完成")
    found = outcomes.verdict(expect, status, k % 37 == 0, F.lit("找不到"), F.when(c % 3 == 0, 0).otherwise(k % 4), F.col("o_orderstatus") == "F", c % 7 != 0)
    return _t(spark, d, "orders").select("o_orderkey", found.alias("verdict"))


@query(r"""WITH w AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS body, coalesce(source, '') AS source FROM documents),
p AS (SELECT doc_id, body, split_part(body, ' ', 2) AS item, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN array_to_string(string_split(body, ' ')[1:3], ' ') ELSE source END AS title FROM w)
SELECT doc_id, CASE WHEN title != '' THEN (item != '' AND contains(' ' || title || ' ', ' ' || item || ' ')) OR contains(' ' || item || ' ', ' ' || title || ' ') ELSE item != '' AND contains(' ' || body || ' ', ' ' || item || ' ') END AS matches FROM p""")
def q30_item_pages(spark, d):
    """Whether a page shows an item: its title decides unless it has no words."""
    k = F.col("doc_id")
    rows = _t(spark, d, "documents").select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce("source", F.lit("")).alias("source"))
    item = F.coalesce(F.try_element_at(F.split("body", " "), F.lit(2)), F.lit(""))
    title = F.when(k % 3 == 0, "").when(k % 3 == 1, F.array_join(F.slice(F.split("body", " "), 1, 3), " ")).otherwise(F.col("source"))
    return rows.select("doc_id", outcomes.item_matches(item, title, F.col("body")).alias("matches"))


_ENTRIES = [("brass", "number", "(?i)brass$"), ("small", "number", "^SMALL X"), ("steel", "bool", "(?i)promo.*steel"), ("none", "number", "no such"), ("tin", "number", "^STANDARD ANODIZED TIN$"), ("flag", "bool", "^LARGE BURNISHED COPPER")]
_SQL_ENTRIES = "e(key, kind, pattern) AS (VALUES " + ", ".join(f"('{k}', '{t}', '{p}')" for k, t, p in _ENTRIES) + ")"
_SQL_MAPPED = f"""{_SQL_ENTRIES}, pr AS (SELECT min(p_partkey) AS id, p_type AS label, CASE WHEN min(p_partkey) % 2 = 0 THEN 'number' ELSE 'bool' END AS type FROM part GROUP BY p_type),
m AS (SELECT key, count(*) AS n, min(id) AS property_id, min(label) AS property FROM e JOIN pr ON pr.type = CASE WHEN e.kind = 'bool' THEN 'bool' ELSE 'number' END AND regexp_matches(label, pattern) GROUP BY key HAVING count(*) = 1),
mapped AS (SELECT key, kind, property_id, property FROM e LEFT JOIN m USING (key))"""


def _mapped(spark, d):
    entries = spark.createDataFrame(_ENTRIES, "key string, kind string, pattern string")
    pr = _t(spark, d, "part").groupBy(F.col("p_type").alias("label")).agg(F.min("p_partkey").alias("id"))
    pr = pr.select("id", F.col("label").alias("name"), F.when(F.col("id") % 2 == 0, "number").otherwise("bool").alias("type"), stats_form.property_labels(F.col("label")).alias("label"))
    return stats_form.map_properties(entries, pr)


@query(f"WITH {_SQL_MAPPED} SELECT key, kind, property_id, property, property_id IS NULL AS unmapped FROM mapped")
def q11_properties(spark, d):
    """Dictionary entries and the one property that each stands for."""
    m = _mapped(spark, d)
    return m.join(stats_form.unmapped_keys(m).withColumn("unmapped", F.lit(True)), "key", "left").select("key", "kind", "property_id", "property", F.coalesce("unmapped", F.lit(False)).alias("unmapped"))


@query(f"""WITH {_SQL_MAPPED}, c AS (SELECT o_orderkey, key, kind, property_id, property, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END AS lo, CASE WHEN o_orderkey % 4 = 0 THEN 50 + o_orderkey % 50 END AS hi FROM orders CROSS JOIN mapped WHERE (o_orderkey + length(key)) % 2 = 0)
SELECT o_orderkey, key, CASE WHEN property_id IS NULL THEN 'unmapped' WHEN kind != 'bool' AND lo IS NULL AND hi IS NULL THEN 'no value' ELSE 'filter' END AS use,
CASE WHEN kind = 'bool' THEN coalesce('prop_' || replace(property, ' ', '%20') || '=true', '') ELSE concat_ws('&', 'prop_' || property_id || 'Min=' || lo, 'prop_' || property_id || 'Max=' || hi) END AS params,
CASE WHEN kind = 'bool' THEN key WHEN lo IS NOT NULL AND hi IS NOT NULL THEN key || ' ' || lo || '–' || hi WHEN hi IS NOT NULL THEN key || ' ≤' || hi WHEN lo IS NOT NULL THEN key || ' ≥' || lo END AS told FROM c""")
def q11_mapped_conditions(spark, d):
    """Conditions with their use, their address parameters and their words."""
    k = F.col("o_orderkey")
    m = _mapped(spark, d)
    on = _t(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(e[0]) for e in _ENTRIES])).alias("key"), F.when(k % 3 == 0, k % 50).alias("min"), F.when(k % 4 == 0, 50 + k % 50).alias("max"))
    rows = stats_form.active_conditions(on.withColumn("on", (k + F.length("key")) % 2 == 0), m)
    params = stats_form.condition_params(F.col("kind"), F.col("property_id"), F.col("property"), F.col("min"), F.col("max"))
    return rows.select("o_orderkey", "key", "use", F.array_join(params, "&").alias("params"), stats_form.describe_condition(F.col("kind"), F.col("key"), F.col("min"), F.col("max")).alias("told"))


@query("""WITH t AS (SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS q, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'rare' WHEN p_size % 4 = 1 THEN CASE WHEN p_size < 25 THEN 'normal,superior' END WHEN p_size % 4 = 2 THEN CASE WHEN p_size >= 25 THEN 'magic' END END AS quality,
CASE q WHEN 'small' THEN 'Small' WHEN 'economy' THEN 'ECONOMY' END AS type FROM t""")
def q11_quality_and_type(spark, d):
    """Options of a quality, where the property has them all, and the type of a base."""
    few, many = F.array(F.lit("rare"), F.lit("normal"), F.lit("superior")), F.array(F.lit("magic"), F.lit("rare"), F.lit("normal"))
    s = F.col("p_size")
    quality = F.when(s % 4 == 0, "rare").when(s % 4 == 1, "normal").when(s % 4 == 2, "magic").otherwise("any")
    base = F.split(F.concat(F.lit(" "), F.lower("p_type")), " ")[1]
    types = F.array(F.lit("Small"), F.lit("ECONOMY"), F.lit("small"))
    return _t(spark, d, "part").select("p_partkey", stats_form.quality_value(quality, F.when(s < 25, few).otherwise(many)).alias("quality"), stats_form.type_for_base(base, types).alias("type"))


@query(r"""WITH p AS (SELECT page_id, url, '?a=' || page_id % 3 || '&b=x%20y&a=9' AS q, CASE page_id % 4 WHEN 0 THEN '?b=x+y' WHEN 1 THEN '?a=1' WHEN 2 THEN '?a=9&b=x%20y' ELSE '?c' END AS w FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN page_id % 3 = 1 WHEN 2 THEN true ELSE false END AS kept FROM p""")
def q31_kept_params(spark, d):
    """Whether an address kept the parameters that were asked for."""
    k = F.col("page_id")
    base = F.regexp_extract("url", "^[^?#]*", 0)
    final = F.concat(base, F.lit("?a="), (k % 3).cast("string"), F.lit("&b=x%20y&a=9#top"))
    want = F.concat(base, F.when(k % 4 == 0, "?b=x+y").when(k % 4 == 1, "?a=1").when(k % 4 == 2, "?a=9&b=x%20y").otherwise("?c"))
    return _t(spark, d, "pages").where("url is not null").select("page_id", stats_form.keeps_params(final, want).alias("kept"))


@query("""WITH c AS (SELECT d.doc_id, d.lang, coalesce(d.text, '') AS text, coalesce(l.quality, 9) AS q, CASE d.doc_id % 5 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'FAILED' ELSE 'PASSED' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT doc_id, list_filter([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'home_page' END, CASE WHEN doc_id % 7 = 0 THEN 'filters_in_url' END, CASE WHEN NOT contains(text, 'the') OR NOT contains(text, 'an') THEN 'filters_shown' END, CASE WHEN status = 'PASSED' AND q = 0 THEN 'rows_match_filters' END, CASE WHEN status != 'PASSED' THEN 'trading_rows_ok' END, CASE WHEN status = 'BLOCKED' THEN 'not_blocked' END], lambda x: x IS NOT NULL) AS bad FROM c)
SELECT doc_id, len(bad) = 0 AS passed, array_to_string(bad, ',') AS failed FROM f""")
def q32_stats_checks(spark, d):
    """The six checks of a condition search."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    status = F.when(k % 5 == 0, "BLOCKED").when(k % 5 == 1, "FAILED").otherwise("PASSED")
    checks = stats_form.stats_checks(F.col("lang") == "en", k % 7 != 0, F.array(F.lit("the"), F.lit("an")), F.col("text"), F.when(F.col("quality") == 0, 3).otherwise(0), status)
    rows = docs.select("doc_id", *market.checks_summary(checks))
    return rows.select("doc_id", "passed", F.array_join("failed_checks", ",").alias("failed"))


@query("""SELECT o_orderkey, o_custkey::INTEGER AS id, 'p {{v}} %' AS name, 'number' AS type, 'p X %' AS label, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS required FROM orders WHERE o_orderkey % 3 != 0""")
def q03_property_lists(spark, d):
    """Property lists as a site sends them: rows without an integer id or a name are left out."""
    k = F.col("o_orderkey")
    row = '[{"id": %s, "name": %s, "type": "number", "required": %s, "format": {"syncOnly": %s}}, {"id": "x", "name": "bad", "type": "bool"}]'
    name = F.when(k % 3 == 0, "null").otherwise('"p {{v}} %"')
    parts = row.split("%s")
    raw = F.concat(F.lit(parts[0]), F.col("o_custkey").cast("string"), F.lit(parts[1]), name, F.lit(parts[2]), (F.col("o_orderstatus") == "F").cast("string"), F.lit(parts[3]), (k % 2 == 1).cast("string"), F.lit(parts[4]))
    return _t(spark, d, "orders").select("o_orderkey", F.explode(stats_form.normal_properties(raw)).alias("p")).select("o_orderkey", "p.*")
