"""Registered queries: each applies an operator to the tables, beside the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import affixes, dimension, evaluation, forms, ledger, market, matching, pages, ranks, runs, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_SQL_LINES = r"""lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i, trim(raw) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)) WHERE line != '')"""


@query(f"WITH {_SQL_LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, count(*) FILTER (WHERE lower(line) IN ('pro', 'marketplace', 'log in'))::BIGINT AS noise FROM lines GROUP BY doc_id")
def q01_page_lines(spark, d):
    """Lines of every document, noise counted."""
    lines = pages.page_lines(_t(spark, d, "documents"), "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.count_if(F.lower("line").isin("pro", "marketplace", "log in")).alias("noise"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def q02_json_parse(spark, d):
    """JSON that does not parse gives nulls, not errors."""
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("valid"))


@query(r"""WITH r AS (SELECT CASE WHEN p_partkey % 5 != 0 THEN p_partkey END AS id, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE '+{{x}}% ' || p_name || ' {{level}}' END AS name, CASE WHEN p_size > 25 THEN 'number' ELSE 'string' END AS type FROM part)
SELECT id, name, type, regexp_replace(name, '\{\{[^}]*\}\}', 'X', 'g') AS label FROM r WHERE id IS NOT NULL AND name IS NOT NULL""")
def q03_property_list(spark, d):
    """Well-formed properties with placeholders unified."""
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, None).when(k % 7 == 1, F.col("p_name")).otherwise(F.concat(F.lit("+{{x}}% "), "p_name", F.lit(" {{level}}")))
    rows = _t(spark, d, "part").select(F.when(k % 5 != 0, k).alias("id"), name.alias("name"), F.when(F.col("p_size") > 25, "number").otherwise("string").alias("type"))
    return rows.where("id IS NOT NULL AND name IS NOT NULL").withColumn("label", F.regexp_replace("name", r"\{\{[^}]*\}\}", "X"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, bool_or(o_orderstatus = 'F' AND o_orderpriority != '5-LOW') AS required FROM orders GROUP BY o_custkey")
def q04_first_record(spark, d):
    """The first record of each list, and a flag that needs one condition without another."""
    o = _t(spark, d, "orders")
    flag = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")
    return ledger.first_records(o, ["o_custkey"], "o_orderkey", F.struct("o_orderdate", "o_orderkey"), flag, "required").withColumnRenamed("o_orderkey", "first_order")


@query("""WITH p AS (SELECT p_partkey, list_concat(['Menu', p_name], CASE WHEN p_partkey % 3 != 0 THEN ['Item Type'] ELSE [] END, [p_type, p_brand], CASE WHEN p_partkey % 4 != 0 THEN ['Skills', 'more'] ELSE ['more'] END, ['Skills']) AS l FROM part),
lines AS (SELECT p_partkey, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM p), s AS (SELECT p_partkey, min(pos) AS a FROM lines WHERE line = 'Item Type' GROUP BY p_partkey),
e AS (SELECT p_partkey, min(pos) AS b, any_value(a) AS a FROM lines JOIN s USING (p_partkey) WHERE line = 'Skills' AND pos > a GROUP BY p_partkey) SELECT p_partkey, pos::INTEGER AS pos, line FROM lines JOIN e USING (p_partkey) WHERE pos > a AND pos < b""")
def q05_between_markers(spark, d):
    """Lines between two markers of each page; some pages lack the first."""
    k = F.col("p_partkey")
    text = F.concat_ws("\n", F.lit("Menu"), "p_name", F.when(k % 3 != 0, "Item Type"), "p_type", "p_brand", F.when(k % 4 != 0, F.lit("Skills\nmore")).otherwise(F.lit("more")), F.lit("Skills"))
    lines = pages.page_lines(_t(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return pages.between(lines, "p_partkey", F.col("line") == "Item Type", F.col("line") == "Skills")


@query(r"WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS pair FROM pages) SELECT page_id, split_part(pair, '=', 1) AS name, substr(pair, position('=' IN pair) + 1) AS value FROM q WHERE position('=' IN pair) > 1")
def q06_pairs_in_order(spark, d):
    """Name and value pairs of a separated string, repeats kept."""
    found = T.pairs(F.regexp_extract("url", r"\?([^#]*)", 1))
    return _t(spark, d, "pages").select("page_id", F.explode(found).alias("p")).select("page_id", "p.name", "p.value")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(s, '[",\r\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell, regexp_replace(source || '_' || lang, '[^A-Za-z0-9 _-]', '_', 'g') || '.csv' AS file
FROM (SELECT doc_id, source, lang, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS s FROM documents)""")
def q07_csv_cells(spark, d):
    """Cells of a spreadsheet file that cannot run as formulas."""
    return _t(spark, d, "documents").select("doc_id", T.csv_cell(F.col("text")).alias("cell"), T.file_name(F.col("source"), F.col("lang")).alias("file"))


@query(r"SELECT p_partkey, concat_ws(chr(9), p_name, p_brand, p_type) AS row, (SELECT string_agg(x, ' / ') FROM (SELECT unnest([nullif(p_brand, 'Brand#11'), nullif(p_type, ''), NULL]) AS x) WHERE x IS NOT NULL) AS env FROM part")
def q08_tsv_rows(spark, d):
    """Rows of a tab-separated text and labels joined without their empty parts."""
    cells = [T.tsv_cell(F.col(c)) for c in ("p_name", "p_brand", "p_type")]
    return _t(spark, d, "part").select("p_partkey", F.concat_ws("\t", *cells).alias("row"), F.concat_ws(" / ", F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.nullif(F.col("p_type"), F.lit("")), F.lit(None).cast("string")).alias("env"))


@query(r"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '—' ELSE regexp_replace(replace(text, '|', '\|'), '[\r\n]+', ' ', 'g') END AS cell, coalesce(list_max(list_transform(regexp_extract_all(text, '([|]+)', 1), lambda x: length(x))), 0)::INTEGER AS fence FROM documents")
def q09_markdown_cells(spark, d):
    """Cells of a report table, and the longest run of a mark that a fence must exceed."""
    return _t(spark, d, "documents").select("doc_id", T.markdown_cell(F.col("text")).alias("cell"), T.longest_run(F.col("text"), "[|]").alias("fence"))


@query("""WITH r AS (SELECT c_mktsegment, o_orderstatus, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
v AS (SELECT c_mktsegment, CASE WHEN o_orderstatus != 'F' OR o_orderpriority != '1-URGENT' THEN 'hide' WHEN o_orderstatus IS NULL OR o_orderpriority IS NULL THEN 'unknown' ELSE 'keep' END AS v FROM r)
SELECT c_mktsegment, count(*) FILTER (WHERE v = 'keep') AS kept, count(*) FILTER (WHERE v != 'keep') AS hidden, count(*) FILTER (WHERE v = 'unknown') AS unknown FROM v GROUP BY c_mktsegment""")
def q10_tristate_filter(spark, d):
    """Rows kept, hidden, and hidden for lack of a value."""
    rows = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return market.filter_counts(rows, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "c_name": ""}, ["c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, 'prop_quantityMin=10&prop_quantityMax=20&prop_flag=N' AS params FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag = 'N' AND l_discount >= 0.05")
def q11_conditions(spark, d):
    """Mapped conditions as one conjunction that reaches the scan, and as parameters of an address."""
    li = _t(spark, d, "lineitem").where("l_quantity >= 10 and l_quantity <= 20 and l_returnflag = 'N' and l_discount >= 0.05")
    params = F.concat_ws("&", *[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.replace(F.url_encode(F.lit(v)), F.lit("+"), F.lit("%20"))) for k, v in (("prop_quantityMin", "10"), ("prop_quantityMax", "20"), ("prop_flag", "N"))])
    return li.select("l_orderkey", "l_linenumber", params.alias("params"))


@query(f"""WITH {_SQL_LINES}, m AS (SELECT *, CASE WHEN ends_with(line, '.') THEN 1 ELSE 0 END AS c FROM lines),
s AS (SELECT doc_id, pos, line, coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, sum(c) OVER (PARTITION BY doc_id) AS n FROM m)
SELECT doc_id, seg::BIGINT AS seg, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(pos)::INTEGER AS last_pos FROM s WHERE seg < n GROUP BY doc_id, seg""")
def q12_segments(spark, d):
    """Every document's lines in segments that a terminator closes."""
    lines = pages.segments(pages.page_lines(_t(spark, d, "documents"), "doc_id"), F.endswith("line", F.lit(".")), "doc_id")
    return lines.groupBy("doc_id", F.col("seg").cast("long").alias("seg")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.max("pos").alias("last_pos"))


@query("""SELECT o_orderpriority, count(*) AS rows, count(o_totalprice) AS priced, count(*) - count(o_totalprice) AS unpriced, min(o_totalprice) AS min_price, quantile_disc(o_totalprice, 0.5) AS median_price,
CASE WHEN count(o_totalprice) >= 4 THEN quantile_disc(o_totalprice, 0.25) END AS q1_price, CASE WHEN count(o_totalprice) >= 4 THEN quantile_disc(o_totalprice, 0.75) END AS q3_price FROM orders GROUP BY o_orderpriority""")
def q13_price_summary(spark, d):
    """Asking prices of each group: counts, minimum, nearest-rank quartiles."""
    return market.price_summary(_t(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@query("""WITH p AS (SELECT user_id, try_cast(regexp_extract(props, '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS price FROM events)
SELECT user_id, count(*) AS rows, count(price) AS priced, count(*) - count(price) AS unpriced, min(price) AS min_price, quantile_disc(price, 0.5) AS median_price,
CASE WHEN count(price) >= 4 THEN quantile_disc(price, 0.25) END AS q1_price, CASE WHEN count(price) >= 4 THEN quantile_disc(price, 0.75) END AS q3_price FROM p GROUP BY user_id""")
def q13_price_of_text(spark, d):
    """Prices read from text, summarised for each user."""
    rows = _t(spark, d, "events").select("user_id", T.price_of(F.col("props")).alias("price"))
    return market.price_summary(rows, "price", ["user_id"])


@query("""WITH g AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS xs FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN len(xs) = 0 THEN 'Unknown' ELSE array_to_string(xs, ', ') END AS price FROM g""")
def q15_price_fold(spark, d):
    """Offers of each customer folded into one price text."""
    g = _t(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("xs"))
    return g.select("o_custkey", pages.or_price(F.col("xs")).alias("price"))


@query(f"""WITH {_SQL_LINES}, n AS (SELECT *, coalesce(lag(line) OVER w, 'Unknown') AS item, coalesce(lead(line) OVER w, '') AS price, coalesce(lead(line, 2) OVER w, '') AS trade_time FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INTEGER AS pos, item, price, trade_time FROM n WHERE ends_with(line, '!!')""")
def q16_neighbour_records(spark, d):
    """Records from the lines around a marker line."""
    return pages.marker_trades(pages.page_lines(_t(spark, d, "documents"), "doc_id"), "doc_id", F.endswith("line", F.lit("!!")))


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 AND bool_or(lower(text) LIKE '%sign in%' OR lower(text) LIKE '%login%') THEN 'login_required' WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'no_rows' WHEN count(*) FILTER (WHERE role = 'assistant') > 2 THEN 'B' ELSE 'A' END AS code FROM conversations GROUP BY conv_id""")
def q17_login_wall(spark, d):
    """What a view without rows means."""
    n, wall = F.count_if(F.col("role") == "assistant"), F.bool_or(F.lower("text").contains("sign in") | F.lower("text").contains("login"))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.when((n == 0) & wall, "login_required").when(n == 0, "no_rows").when(n > 2, "B").otherwise("A").alias("code"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, least(2, greatest(1, ceil(count(*) OVER (PARTITION BY o_custkey) / 10.0)))::INTEGER AS page FROM orders)
SELECT o_custkey, o_orderkey, page, rn::INTEGER AS rn FROM r WHERE rn > (page - 1) * 10 AND rn <= page * 10""")
def q18_page(spark, d):
    """The second page of each customer's orders, or the last there is."""
    rows = market.page_of(_t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2)
    return rows.select("o_custkey", "o_orderkey", "page", "rn")


@query(r"""WITH n AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_name AS name, p_partkey AS place FROM part),
t AS (SELECT DISTINCT substr(split_part(key, ' ', 1), 1, 3) AS typed FROM n WHERE length(split_part(key, ' ', 1)) >= 3),
m AS (SELECT typed, name, place, CASE WHEN starts_with(key, typed) THEN 0 WHEN contains(' ' || key, ' ' || typed) THEN 1 END AS rank FROM t, n WHERE key != typed),
r AS (SELECT typed, name, rank, row_number() OVER (PARTITION BY typed ORDER BY rank, length(name), place) AS rn FROM m WHERE rank IS NOT NULL)
SELECT typed, name, rank::INTEGER AS rank, rn::INTEGER AS rn FROM r WHERE rn <= 5""")
def q19_suggestions(spark, d):
    """Five suggestions for what is typed so far."""
    names = _t(spark, d, "part").select(T.words(F.col("p_name")).alias("key"), F.col("p_name").alias("name"), F.col("p_partkey").alias("at"))
    first = F.substring_index("key", " ", 1)
    typed = names.where(F.length(first) >= 3).select(F.substring(first, 1, 3).alias("key"))
    return matching.suggestions(typed, names).select("typed", "name", "rank", "rn")


@query(r"""WITH i AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN one END AS value, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status
FROM (SELECT p_partkey, trim(regexp_replace(lower(CASE WHEN p_size < 8 THEN p_name || ' x' ELSE upper(p_name) END), '[^a-z0-9]+', ' ', 'g')) AS k FROM part) p LEFT JOIN i ON k = key""")
def q20_exact_lookup(spark, d):
    """Names looked up by key; ambiguous keys give nothing."""
    part = _t(spark, d, "part")
    index = matching.index_names(part, T.words(F.col("p_name")), "p_partkey")
    asked = part.select("p_partkey", T.words(F.when(F.col("p_size") < 8, F.concat("p_name", F.lit(" x"))).otherwise(F.upper("p_name"))).alias("k"))
    return matching.look_up(asked, "k", index).select("p_partkey", "value", "status")


@query("""SELECT c_custkey, coalesce(s_name, p_name) AS value, CASE WHEN s_name IS NOT NULL THEN 'supplier' WHEN p_name IS NOT NULL THEN 'part' END AS layer
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN part ON c_custkey = p_partkey""")
def q21_cascade(spark, d):
    """The first layer that knows a key, and which it was."""
    supplier = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    return matching.cascade(_t(spark, d, "customer").select("c_custkey"), "c_custkey", [("supplier", supplier), ("part", part)])


_FUZZY = """WITH n AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part), p AS (SELECT DISTINCT replace(name, 'a', 'e') AS piece FROM n),
m AS (SELECT piece, name, levenshtein(piece, name) AS distance FROM p, n WHERE abs(length(piece) - length(name)) <= 2),
r AS (SELECT piece, name, distance, distance * 100 - least(length(name), 40) AS score FROM m WHERE distance <= CASE WHEN length(name) <= 5 THEN 1 ELSE 2 END)
SELECT * FROM (SELECT piece, name, distance::INTEGER AS distance, score::INTEGER AS score, (row_number() OVER (PARTITION BY piece ORDER BY score, name))::INTEGER AS rn FROM r) WHERE rn <= 3"""


@query(_FUZZY)
def q22_fuzzy_names(spark, d):
    """The three closest names to misread ones."""
    names = _t(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).distinct()
    pieces = names.select(F.replace("name", F.lit("a"), F.lit("e")).alias("piece"))
    return matching.fuzzy(pieces, names, T.allowed_edits(F.col("size")))


@query("""SELECT * FROM (SELECT l_orderkey, CASE WHEN mx < 150 THEN NULL WHEN sat < 0.15 THEN 'white' WHEN hue BETWEEN 190 AND 270 AND sat >= 0.3 THEN 'blue' WHEN hue BETWEEN 80 AND 160 AND sat >= 0.4 THEN 'green' WHEN hue BETWEEN 30 AND 52 AND sat <= 0.6 THEN 'gold' WHEN hue > 52 AND hue <= 65 THEN CASE WHEN sat < 0.31 THEN 'gold' ELSE 'yellow' END END AS quality, l_linenumber FROM (
SELECT *, CASE WHEN turn < 0 THEN turn + 360 ELSE turn END AS hue FROM (SELECT *, (CASE WHEN dl = 0 THEN NULL WHEN mx = r THEN (g - b) / dl WHEN mx = g THEN (b - r) / dl + 2 ELSE (r - g) / dl + 4 END) * 60 AS turn, dl / nullif(mx, 0)::DOUBLE AS sat FROM (
SELECT l_orderkey, l_linenumber, r, g, b, greatest(r, g, b) AS mx, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS dl FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 256)::INTEGER AS r, (l_suppkey * 13 % 256)::INTEGER AS g, (l_orderkey * 5 % 256)::INTEGER AS b FROM lineitem)))))""")
def q25_tone_bands(spark, d):
    """Colours read as item qualities."""
    c = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 256).cast("int").alias("r"), (F.col("l_suppkey") * 13 % 256).cast("int").alias("g"), (F.col("l_orderkey") * 5 % 256).cast("int").alias("b"))
    return c.select("l_orderkey", "l_linenumber", T.tone_quality(F.col("r"), F.col("g"), F.col("b")).alias("quality"))


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR prev IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i)
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, least(arg_max(streak, (ts, event_id)), 99)::INTEGER AS times FROM s GROUP BY user_id""")
def q29_trailing_choice(spark, d):
    """Each user's last choice and how often in a row it was made."""
    e = _t(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return ledger.trailing_choice(e, ["user_id"], F.col("at"), "event_type").withColumn("times", F.col("times").cast("int"))


@query(f"""WITH {_SQL_LINES}, c AS (SELECT d.doc_id, count(l.line) AS n_rows, count(l.line) FILTER (WHERE ends_with(l.line, '.')) AS markers, d.lang = 'en' AS trading FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id, d.lang)
SELECT doc_id, CASE WHEN n_rows = 0 THEN CASE WHEN markers = 0 AND NOT trading THEN 'empty' ELSE 'no_rows' END WHEN markers = 0 THEN 'no_anchor' WHEN (trading AND n_rows < markers) OR (NOT trading AND n_rows != markers) THEN 'row_mismatch' ELSE 'passed' END AS code FROM c""")
def q30_cross_check(spark, d):
    """Row counts against independent marker counts."""
    docs = _t(spark, d, "documents")
    counts = pages.page_lines(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.endswith("line", F.lit("."))).alias("markers"))
    both = docs.select("doc_id", (F.col("lang") == "en").alias("trading")).join(counts, "doc_id", "left").fillna(0, ["n_rows", "markers"])
    return both.select("doc_id", market.cross_check(F.col("n_rows"), F.col("markers"), ~F.col("trading"), F.col("trading")).alias("code"))


@query(r"""WITH p AS (SELECT page_id, url, length(html) AS n, regexp_extract(url, '://([^/?#]*)', 1) AS host, lower(html) AS low FROM pages)
SELECT page_id, CASE WHEN host LIKE '%.net' THEN 'out_of_scope' WHEN n < 3000 AND contains(low, 'captcha') THEN 'captcha' WHEN NOT contains(url, '/en/') THEN 'wrong_view' WHEN NOT contains(low, 'the') THEN 'wrong_item' ELSE 'passed' END AS reason FROM p""")
def q31_view_gate(spark, d):
    """The first reason that a page cannot be used."""
    host, low = F.regexp_extract("url", r"://([^/?#]*)", 1), F.lower("html")
    guard = F.when(F.endswith(host, F.lit(".net")), "out_of_scope").when((F.length("html") < 3000) & low.contains("captcha"), "captcha")
    gate = market.view_gate(F.lit(True), F.lit(True), guard, F.contains("url", F.lit("/en/")), low.contains("the"), F.lit(False), F.lit("passed"))
    return _t(spark, d, "pages").select("page_id", gate.alias("reason"))


@query("""SELECT doc_id, len(list_filter([CASE WHEN lang != 'en' THEN 'home' END, CASE WHEN n_chars < 1000 THEN 'rows' END, CASE WHEN q IS DISTINCT FROM 1 THEN 'quality' END], lambda x: x IS NOT NULL)) = 0 AS passed,
array_to_string(list_filter([CASE WHEN lang != 'en' THEN 'home' END, CASE WHEN n_chars < 1000 THEN 'rows' END, CASE WHEN q IS DISTINCT FROM 1 THEN 'quality' END], lambda x: x IS NOT NULL), ',') AS failed FROM (SELECT d.*, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id))""")
def q34_checks(spark, d):
    """Named checks, whether all hold, and which do not."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    checks = {"home": F.col("lang") == "en", "rows": F.col("n_chars") >= 1000, "quality": F.col("quality") == 1}
    rows = docs.select("doc_id", *market.checks_summary(checks))
    return rows.select("doc_id", "passed", F.array_join("failed_checks", ",").alias("failed"))


@query("""SELECT event_type, count(*)::BIGINT AS calls, sum(greatest(k, 0))::BIGINT AS input_tokens, sum(CASE WHEN v > 0 THEN v ELSE 0 END)::BIGINT AS output_tokens, round(sum(greatest(k, 0)) / 1e6 * 0.042 + sum(CASE WHEN v > 0 THEN v ELSE 0 END) / 1e6 * 0.2, 9) AS cost_usd,
round_even(sum(v)::DOUBLE / 1000, 1) AS seconds, round_even(sum(v)::DOUBLE / count(*), 0) AS avg_ms FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, floor(value)::BIGINT AS v FROM events) GROUP BY event_type""")
def q36_usage(spark, d):
    """Token, cost and latency sums of each kind of call."""
    e = _t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("input_tokens"), F.floor("value").alias("output_tokens"), F.floor("value").alias("latency_ms"), F.lit(None).cast("int").alias("model_calls"))
    return ledger.usage_summary(e, ["event_type"], 0.042, 0.2)


@query("SELECT event_id, user_id, n::INTEGER AS n, n <= 5 AS ok FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def q37_quota(spark, d):
    """The first five uses of a key are admitted."""
    return ledger.admitted(_t(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 5).drop("ts")


@query("""WITH RECURSIVE f AS (SELECT user_id AS key, epoch(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
s AS (SELECT key, ts, i, ts AS opened, 1 AS failures FROM f WHERE i = 1 UNION ALL
SELECT f.key, f.ts, f.i, CASE WHEN f.ts >= s.opened + 86400 THEN f.ts ELSE s.opened END, CASE WHEN f.ts >= s.opened + 86400 THEN 1 ELSE s.failures + 1 END FROM s JOIN f ON f.key = s.key AND f.i = s.i + 1)
SELECT key::VARCHAR AS key, ts, failures::INTEGER AS failures, failures > 2 AS refused FROM s""")
def q37_throttle(spark, d):
    """Refusals by a window that its first failure opens."""
    f = _t(spark, d, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return ledger.throttle(f, 2, 86400.0)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS replayed FROM events")
def q38_replays(spark, d):
    """Requests that repeat an earlier one."""
    return ledger.replays(_t(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "replayed")


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT user_id, event_type, c / sum(c) OVER (PARTITION BY user_id)::DOUBLE AS p FROM p)
SELECT user_id, arg_max(event_type, (p, event_type)) AS choice, round(max(p), 9) AS p, max(p) >= 0.8 AS sure, abs(sum(p) - 1) <= 0.02 AS valid FROM t GROUP BY user_id""")
def q39_choice(spark, d):
    """The most probable option, whether it is sure, and whether the answer is a distribution."""
    c = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("user_id")))
    return runs.most_probable(p, ["user_id"], "event_type", "p").withColumn("p", F.round("p", 9))


@query("""WITH r AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR prev IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r)
SELECT event_id, (row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id))::INTEGER AS streak, count(*) OVER l = 3 AND min((value < 100)::INTEGER) OVER l = 1 AS stalled FROM i WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def q40_streaks(spark, d):
    """Runs of the same event, and whether the last three made no progress."""
    at = [F.col("ts"), F.col("event_id")]
    rows = ledger.streaks(_t(spark, d, "events"), ["user_id"], at, ["event_type"])
    return ledger.stalled(rows, ["user_id"], at, F.col("value") < 100).select("event_id", "streak", "stalled")


@query("""WITH s AS (SELECT user_id, date_trunc('hour', ts) AS sec, count(*) AS f FROM events GROUP BY ALL)
SELECT user_id, sec, CASE WHEN count(*) OVER w >= 3 THEN round(avg(f) OVER w, 9) END AS fps FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sec ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def q41_running_rate(spark, d):
    """The running mean rate over the last six filled slots, once there are three."""
    s = _t(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("sec")).agg(F.count("*").alias("f"))
    return scan.frame_rate(s, ["user_id"], [F.col("sec")], F.col("f")).select("user_id", "sec", F.round("fps", 9).alias("fps"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 9) AS middle, quantile_disc(value, 0.5) AS nearest, list_sort(list(value))[count(*) // 2 + 1] AS upper FROM events GROUP BY event_type""")
def q42_medians(spark, d):
    """Three medians: interpolated, nearest rank, upper."""
    e = _t(spark, d, "events")
    other = ranks.at_ranks(e, ["event_type"], "value", {"nearest": ranks.nearest(0.5, F.col("n")), "upper": ranks.upper_median(F.col("n"))}).drop("n")
    middle = ranks.quantiles(e, ["event_type"], "value", {"middle": 0.5}).select("event_type", F.round("middle", 9).alias("middle"))
    return middle.join(other, "event_type")


@query("""SELECT lang, count(quality) AS scored, count(*) FILTER (WHERE quality = 1) AS right_n, round(count(*) FILTER (WHERE quality = 1) / nullif(count(quality), 0)::DOUBLE, 9) AS share, count(*) FILTER (WHERE quality IS NULL) AS skipped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def q43_scoreboard(spark, d):
    """Scored, right and skipped cases of each group."""
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    right = F.count_if(F.col("quality") == 1)
    return j.groupBy("lang").agg(F.count("quality").alias("scored"), right.alias("right_n"), F.round(F.try_divide(right, F.count("quality")), 9).alias("share"), F.count_if(F.col("quality").isNull()).alias("skipped"))


@query("SELECT o_orderkey, greatest(0, floor((epoch(TIMESTAMP '1998-09-01 00:00:00') - epoch(o_orderdate)) / 86400))::BIGINT AS age_days, floor((epoch(TIMESTAMP '1998-09-01 00:00:00') - epoch(o_orderdate)) / 86400) > 90 AS stale FROM orders")
def q44_table_age(spark, d):
    """Whole days since a table was made, and whether it is stale."""
    age, stale = evaluation.table_age(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.lit(904608000))
    return _t(spark, d, "orders").select("o_orderkey", age.alias("age_days"), stale.alias("stale"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q45_resume(spark, d):
    """Rows that no earlier run has finished."""
    return evaluation.unfinished(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query(r"""SELECT doc_id, NOT regexp_matches(text, '["\p{Cc}\p{Cf}]') AS safe, substr(text, 1, 6000) AS shown, CASE WHEN length(text) > 6000 THEN 'cut' ELSE 'whole' END AS how FROM documents""")
def q46_validation(spark, d):
    """Whether a text may go into a goal, and what is shown of it."""
    shown, how = T.shown(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", T.goal_safe(F.col("text")).alias("safe"), shown.alias("shown"), how.alias("how"))


@query("""WITH g AS (SELECT *, value - lag(value) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
b AS (SELECT *, sum(CASE WHEN gap >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id) AS band FROM g)
SELECT event_id, band::BIGINT AS band, (row_number() OVER (PARTITION BY user_id, band ORDER BY ts, event_id))::INTEGER AS place FROM b""")
def q47_reading_order(spark, d):
    """Bands that a gap of ten opens, and the order inside a band."""
    rows = runs.reading_order(_t(spark, d, "events"), ["user_id"], [F.col("value"), F.col("event_id")], [F.col("ts"), F.col("event_id")], 10)
    return rows.select("event_id", "band", "place")


@query("""WITH g AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def q48_quiet_sessions(spark, d):
    """Sessions that an hour of quiet ends."""
    s = ledger.quiet_sessions(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_NUMBER = r"""WITH l AS (SELECT l_orderkey, l_linenumber, '+' || l_partkey * l_suppkey || CASE WHEN l_linenumber = 1 THEN '%' ELSE '' END || ' Speed (FB)' AS line, (l_partkey * l_suppkey)::VARCHAR AS raw, CASE WHEN l_linenumber != 2 THEN 120 END AS ceiling FROM lineitem),
o AS (SELECT *, length(raw) AS n, CASE WHEN length(raw) = 3 AND right(raw, 1) = '6' THEN 1 WHEN length(raw) >= 3 AND right(raw, 2) IN ('96', '06', '09') THEN 2
  WHEN length(raw) >= 3 AND (right(raw, 1) IN ('0', '5') OR (right(raw, 1) IN ('6', '9') AND length(raw) >= 4)) AND left(raw, length(raw) - 1)::BIGINT >= 1 THEN 1 ELSE 0 END AS off FROM l),
s AS (SELECT *, left(raw, n - off) AS v0, coalesce(try_cast(left(raw, greatest(n - off - 1, 0)) AS BIGINT), 0) AS v1, coalesce(try_cast(left(raw, greatest(n - off - 2, 0)) AS BIGINT), 0) AS v2 FROM o),
r AS (SELECT l_orderkey, l_linenumber, ceiling, contains(line, '%') AS marked, CASE WHEN contains(line, '%') THEN raw::DOUBLE WHEN off > 0 AND v0::BIGINT > ceiling AND v1 >= 1 THEN CASE WHEN v1 > ceiling AND v2 >= 1 THEN v2 ELSE v1 END ELSE v0::BIGINT END::DOUBLE AS v FROM s)
SELECT l_orderkey, l_linenumber, v AS value, marked AND (ceiling IS NULL OR v <= ceiling) AS confident FROM r"""


@query(_NUMBER)
def q23_number_repair(spark, d):
    """Percentages whose sign was read as digits, repaired."""
    shown = F.concat(F.lit("+"), F.col("l_partkey") * F.col("l_suppkey"), F.when(F.col("l_linenumber") == 1, "%").otherwise(""), F.lit(" Speed (FB)"))
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("line"), F.when(F.col("l_linenumber") != 2, F.lit(120)).alias("ceiling"))
    read = affixes.read_numbers(rows, F.col("line"), F.lit(True), F.col("ceiling"))
    return read.select("l_orderkey", "l_linenumber", F.col("min").alias("value"), "confident")



_PRODUCTS = "products AS (SELECT p_name AS name, CASE min(p_partkey) % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'uniques' ELSE 'sets' END AS category FROM part GROUP BY p_name)"


def _products(spark, d):
    third = F.min("p_partkey") % 3
    return _t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.when(third == 0, "base").when(third == 1, "uniques").otherwise("sets").alias("category"))


@query(f"""WITH {_PRODUCTS}, pairs AS (SELECT DISTINCT p_brand || p_size AS chinese, p_name AS product FROM part WHERE p_partkey % 5 != 4),
g AS (SELECT chinese, count(*) AS n_products, count(*) FILTER (WHERE category = 'base') AS bases, min(product) AS one, min(product) FILTER (WHERE category = 'base') AS base FROM pairs JOIN products ON name = product GROUP BY chinese)
SELECT chinese, n_products, CASE WHEN n_products = 1 THEN one WHEN bases = 1 THEN base END AS product FROM g""")
def q26_combined_names(spark, d):
    """Names of two sources combined, with ambiguous ones resolved or left out."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("The "), F.upper("p_name"), F.lit(" Armor"))).when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("no "), "p_name")).otherwise(F.col("p_name"))
    pairs = _t(spark, d, "part").select(F.concat("p_brand", "p_size").alias("chinese"), name.alias("english"))
    return dimension.combine_names(dimension.find_products(pairs, _products(spark, d), ascii_only=True))


@query("SELECT p_partkey, p_name, nth FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part) WHERE nth <= 2")
def q27_two_names(spark, d):
    """At most two rows of each name."""
    return dimension.first_names(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", F.col("p_partkey"))


@query("SELECT s_nationkey, s_name, s_suppkey FROM supplier UNION ALL SELECT c_nationkey, c_name, c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)")
def q26_add_missing(spark, d):
    """Rows merged into a table that keeps its own."""
    old = _t(spark, d, "supplier").select("s_nationkey", "s_name", "s_suppkey")
    return dimension.add_missing(old, _t(spark, d, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_name").alias("s_name"), F.col("c_custkey").alias("s_suppkey")), "s_nationkey")


@query("SELECT p_brand AS category, count(*) AS total, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)) AS named FROM part GROUP BY p_brand")
def q28_coverage(spark, d):
    """How much of each category has a name."""
    return dimension.coverage(_t(spark, d, "part"), "p_brand", "p_partkey", _t(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")))


@query("SELECT p_name || ' ' || replace(lower(p_brand), '#', ' ') AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def q28_duplicate_keys(spark, d):
    """Keys that several products share."""
    return dimension.duplicate_keys(_t(spark, d, "part"), T.name_key(F.concat_ws(" ", "p_name", "p_brand"), ascii_only=True))


@query("""WITH w AS (SELECT o_custkey AS category, count(*) AS was FROM orders GROUP BY o_custkey), n AS (SELECT o_custkey AS category, count(*) AS now FROM orders WHERE o_totalprice > 30000 GROUP BY o_custkey),
j AS (SELECT category, was, coalesce(now, 0) AS now FROM w LEFT JOIN n USING (category))
SELECT category, was, now, CASE WHEN now = 0 THEN 'gone' ELSE 'shrunk' END AS problem FROM j WHERE now < was * (1 - 0.1)""")
def q28_shrinkage(spark, d):
    """Categories that lost more than a tenth of their rows."""
    o = _t(spark, d, "orders")
    return dimension.shrinkage(o, o.where("o_totalprice > 30000"), "o_custkey")


@query("""SELECT p_brand, count(*) FILTER (WHERE p_size % 3 = 0 OR p_type = 'ECONOMY') AS lacking FROM part GROUP BY p_brand""")
def q32_missing_conditions(spark, d):
    """Rows whose affixes lack at least one condition."""
    life = F.concat(F.lit("+"), F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")), F.lit(" TO life"))
    kind = F.when(F.col("p_type") != "ECONOMY", F.concat(F.lit("Brand (1): "), "p_brand"))
    lacks = affixes.lacks_condition(F.array(kind, life), ["+{{n}} to Life", "Brand (1): Brand#{{n}}"])
    return _t(spark, d, "part").groupBy("p_brand").agg(F.count_if(lacks).alias("lacking"))


@query("""WITH c AS (SELECT l_orderkey AS form_id, l_linenumber AS key, min(l_quantity) AS min, max(l_quantity) + 5 AS max FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
r AS (SELECT DISTINCT l_orderkey AS form_id, l_linenumber AS key, l_linenumber AS pos FROM lineitem WHERE l_linenumber != 3),
m AS (SELECT coalesce(c.form_id, r.form_id) AS form_id, coalesce(c.key, r.key) AS key, pos, min, max, c.key IS NOT NULL AS kept FROM r FULL JOIN c ON r.form_id = c.form_id AND r.key = c.key),
f AS (SELECT *, NOT kept AND key != 2 AS free FROM m),
n AS (SELECT *, sum(free::INT) OVER (PARTITION BY form_id ORDER BY pos NULLS FIRST, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth, 3 - sum(kept::INT) OVER (PARTITION BY form_id) AS room FROM f)
SELECT form_id, key, min, max, kept OR (free AND nth <= room) AS on, kept FROM n""".replace(" AS on,", ' AS "on",'))
def q33_merged_conditions(spark, d):
    """Conditions read anew beside those that the player had switched on."""
    li = _t(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "form_id", "l_linenumber": "key"}).withColumn("pos", F.col("key"))
    chosen = li.where("l_returnflag = 'R'").groupBy("form_id", "key", "pos").agg(F.min("l_quantity").alias("min"), (F.max("l_quantity") + 5).alias("max"))
    return forms.merge_conditions(chosen, li.select("form_id", "key", "pos").where("key != 3").distinct(), F.col("key") == 2, limit=3)



@query("""WITH r AS (SELECT l_orderkey AS form_id, l_linenumber AS pos, l_returnflag || l_linenumber AS label, CASE WHEN l_linestatus = 'F' THEN 'bool' ELSE 'number' END AS kind, CASE WHEN l_quantity > 20 THEN l_quantity END AS lo, CASE WHEN l_quantity > 20 THEN l_quantity + 20 - l_partkey % 22 END AS hi, CASE WHEN l_orderkey % 3 = 0 THEN ' ' ELSE 'Ring' END AS base FROM lineitem),
g AS (SELECT form_id, bool_or(coalesce(hi < lo, false)) AS crossed, string_agg(label, '、' ORDER BY pos, label) FILTER (WHERE kind != 'bool' AND lo IS NULL) AS blank, max(trim(base)) AS base FROM r GROUP BY form_id)
SELECT form_id, CASE WHEN crossed THEN 'limits' WHEN blank IS NOT NULL THEN 'values: ' || blank WHEN base = '' THEN 'base' ELSE '' END AS blocker FROM g""")
def q35_blockers(spark, d):
    """What keeps each form from starting."""
    low = F.when(F.col("l_quantity") > 20, F.col("l_quantity"))
    rows = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("form_id"), F.col("l_linenumber").alias("pos"), F.concat("l_returnflag", "l_linenumber").alias("label"), F.when(F.col("l_linestatus") == "F", "bool").otherwise("number").alias("kind"),
        F.lit(True).alias("on"), low.alias("min"), (low + 20 - F.col("l_partkey") % 22).alias("max"), F.when(F.col("l_orderkey") % 3 == 0, " ").otherwise("Ring").alias("base"),
    )
    return forms.start_blockers(rows)


@query("SELECT o_custkey, max(o_orderkey) AS newest FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY o_custkey")
def q35_own_listings(spark, d):
    """The newest of the orders that a listing has."""
    own = forms.already_listed(_t(spark, d, "orders"), _t(spark, d, "lineitem").where("l_quantity >= 49"), "o_orderkey", "l_orderkey")
    return forms.newest_listing(own.withColumn("id", F.col("o_orderkey").cast("string")), "o_custkey", "id").withColumn("newest", F.col("newest").cast("long"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', '', 'g') AS x FROM documents), s AS MATERIALIZED (SELECT doc_id, x, string_split(x, '') AS c FROM t),
c AS MATERIALIZED (SELECT doc_id, x, list_distinct(list_transform(list_zip(c[:-2], c[2:]), lambda z: z[1] || z[2])) AS g FROM s),
p AS (SELECT b.doc_id, a.x AS ax, b.x AS bx, a.g AS ag, b.g AS bg, len(list_intersect(a.g, b.g)) AS common FROM c b JOIN c a ON a.doc_id = b.doc_id - 1)
SELECT doc_id, ax = bx OR (length(ax) >= 40 AND length(bx) >= 40 AND common >= 0.6 * (len(ag) + len(bg) - common)) AS again FROM p""")
def q49_read_again(spark, d):
    """Records that show what the record before them shows."""
    rows = _t(spark, d, "documents").select("doc_id", T.reading("text").alias("x"))
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("x").alias("y"))
    return rows.join(before, "doc_id").select("doc_id", matching.same_reading(F.col("y"), F.col("x")).alias("again"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', '', 'g') AS x FROM documents), f AS (SELECT x, min(doc_id) AS first_id FROM t GROUP BY x)
SELECT doc_id, first_id, first_id != doc_id AS again FROM t JOIN f USING (x)""")
def q49_equal_before(spark, d):
    """Records whose text, blanks aside, another record with a smaller id has, wherever that one is."""
    return matching.first_with_text(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").drop("text")


_LOOSE = _FUZZY.replace("abs(length(piece) - length(name)) <= 2", "abs(length(piece) - length(name)) <= 9").replace("CASE WHEN length(name) <= 5 THEN 1 ELSE 2 END", "greatest(CASE WHEN length(name) <= 5 THEN 1 ELSE 2 END, round(length(name) * 0.4))").replace("replace(name, 'a', 'e')", "translate(name, 'aEo#1', 'eAu+7')")


@query(_LOOSE)
def q22_loose_names(spark, d):
    """The three closest names within two fifths of a name's length."""
    names = _t(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).distinct()
    pieces = names.select(F.translate("name", "aEo#1", "eAu+7").alias("piece"))
    return matching.fuzzy(pieces, names, T.allowed_edits(F.col("size"), loose=True))


@query("""WITH q AS (SELECT DISTINCT 'fine ' || lower(p_type) || ' ' || lower(p_brand) AS query FROM part), b AS (SELECT DISTINCT lower(p_type) || ' ' || lower(p_brand) AS base FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT lower(p_brand) FROM part WHERE p_partkey % 3 = 0),
r AS (SELECT query, i, array_to_string(string_split(query, ' ')[i:], ' ') AS rest FROM q, range(1, 12) t(i) WHERE i <= len(string_split(query, ' '))) SELECT query, arg_min(rest, i) AS base FROM r JOIN b ON rest = base GROUP BY query""")
def q21_strip_to_base(spark, d):
    """The longest remainder of a name that is a base."""
    part = _t(spark, d, "part")
    asked = part.select(F.concat_ws(" ", F.lit("fine"), F.lower("p_type"), F.lower("p_brand")).alias("query")).distinct()
    bases = part.where("p_partkey % 2 = 0").select(F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("base")).union(part.where("p_partkey % 3 = 0").select(F.lower("p_brand")))
    return matching.strip_to_base(asked, bases)


@query("""SELECT event_id, CASE WHEN v <= 0 THEN '$0' WHEN v >= 0.01 THEN printf('$%.2f', v) ELSE printf('$%.4f', v) || '（約 ' || printf('%.2f', v * 100) || ' 美分）' END AS cost FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN event_id % 97 / 12345.0 ELSE event_id % 1000 / 67.0 END::DOUBLE AS v FROM events)""")
def q36_money(spark, d):
    """Costs as they are told."""
    k = F.col("event_id")
    v = F.when(k % 3 == 0, 0.0).when(k % 3 == 1, k % 97 / F.lit(12345.0)).otherwise(k % 1000 / F.lit(67.0))
    return _t(spark, d, "events").select("event_id", T.money(v).alias("cost"))
