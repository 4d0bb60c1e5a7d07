"""The registered queries of this subpackage, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import chat, collocations, context_tree, exact_dedup, jaccard_join, language, media, mixing, packing, pieces, quality, repair, url_filter

#: Rules of the URL query: what a fitting rule decides, and its host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The list of the URL query: every subdomain of these.
URL_LIST = [f"{name}.example.{top}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n: what decides which rows are held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_tree.score_texts(_table(spark, sf_dir, "documents"), F.coalesce(remainder(7) != 2, F.lit(True)))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language.train(docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), language.identify(model, docs, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", F.size("p.spans").alias("n_spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(_table(spark, sf_dir, "documents"), trusted)


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(turns.unionByName(added))
    return chat.conversation_digests(chat.read_windows(windows))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = spark.createDataFrame([(e,) for e in URL_LIST], "entry string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, listing)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_media(media.read_media(media.store_media(_table(spark, sf_dir, "documents"))))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_texts(_table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.repair_digests(repair.damaged(turns), every=turns)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_context_tree_scores, op3_language_id, op4_exact_dedup, op5_quality_classifier,
        op6_chat_windows, op7_url_filter, op8_ngram_jaccard, op9_source_mixing, op10_media_columns, op11_sentencepiece, op12_conversation_repair, op13_collocations,
    )
}  # fmt: skip

_FIT = "CASE " + " ".join(
    f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN {{{i}}}"
    for i, (_, t) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][1]))
) + " END"
_LISTED = " OR ".join(f"host = '{e[:-1]}' OR ends_with(host, '.{e[:-1]}')" for e in URL_LIST)


def _edit(item: str, cost: str, audit: str) -> str:
    """SQL of a chart item after an edit; null if there is none."""
    return f"CASE WHEN {item} IS NOT NULL THEN {{'c': ({item}.c + {cost})::BIGINT, 'a': {item}.a || '{audit}'}} END"


def _read(item: str, initial: str) -> str:
    """SQL of a chart item after a row that has to become a role; null for a row that has to go."""
    reroled = _edit(item, "3 + extra", "R") if initial in "ua" else "NULL"
    return f"CASE WHEN NOT gone THEN CASE WHEN initial = '{initial}' THEN {_edit(item, 'extra', 'K')} ELSE {reroled} END END"


#: SQL of the edits of damaged conversations: a column of the chart is four items, of which an insert leads from the first two to ``m`` and between ``m`` and ``z``.
_REPAIR_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS codes FROM conversations),
fate AS (SELECT * EXCLUDE codes, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, codes), lambda acc, b:
  list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 20 AS fate FROM raw),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fate WHERE fate != 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
r AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut FROM n),
x AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM r),
g AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
    count_if(cut AND NOT gone) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
c AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS b, NULL::STRUCT(c BIGINT, a VARCHAR) AS n, NULL::STRUCT(c BIGINT, a VARCHAR) AS m, NULL::STRUCT(c BIGINT, a VARCHAR) AS z FROM g
  UNION ALL
  SELECT conv_id, i, {_edit('b', '4', 'D')}, list_min([{_edit('n', '4', 'D')}, {_read('b', 's')}]),
    list_min([{_edit('m', '4', 'D')}, {_read('b', 'u')}, {_read('n', 'u')}, {_read('z', 'u')}]), list_min([{_edit('z', '4', 'D')}, {_read('m', 'a')}])
  FROM (
    SELECT conv_id, i, b, n, m, list_min([z, {_edit('m', '3', 'I')}]) AS z, initial, gone, extra FROM (
      SELECT c.conv_id, x.i, b, n, list_min([m, {_edit('b', '3', 'I')}, {_edit('n', '3', 'I')}, {_edit('z', '3', 'I')}]) AS m, z, initial, gone, extra
      FROM c JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.i = c.i + 1))),
e AS (
  SELECT c.conv_id, list_min([b, z, {_edit('m', '3', 'I')}, {_edit('n', '6', 'II')}]) AS e FROM c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id AND c.i = g.size),
s AS (SELECT conv_id, e.a AS audit, unnest(range(1, length(e.a) + 1)) AS p FROM e),
o AS (
  SELECT *, length(regexp_replace(substr(audit, 1, p), 'I', '', 'g')) AS i, length(regexp_replace(substr(audit, 1, p), 'D', '', 'g')) AS j,
    length(regexp_replace(audit, 'D', '', 'g')) % 2 AS led, substr(audit, p, 1) AS edit FROM s),
t AS (
  SELECT o.conv_id, string_agg(CASE WHEN edit = 'K' THEN x.role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE x.text END, chr(10) ORDER BY p) AS whole
  FROM o LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM o.conv_id AND x.i = o.i AND edit != 'I' WHERE edit != 'D' GROUP BY o.conv_id)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.e.c, 0)::BIGINT AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
  LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS clean FROM documents),
g AS (SELECT clean, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY clean)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(clean) AS text_sha256 FROM t JOIN g USING (clean)""",
    "op6_chat_windows": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, ceil((strlen(role) + strlen(text) + 26) / 4.0)::BIGINT AS k,
  23 + length(regexp_replace(regexp_replace(role, '<(\\*(\||/?s>|/?SYS>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g'))
     + length(regexp_replace(regexp_replace(text, '<(\\*(\||/?s>|/?SYS>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')) AS chars FROM t),
f AS (SELECT *, first_value(role) OVER w = 'system' AS led, first_value(k) OVER w AS k1 FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
s AS (SELECT *, CASE WHEN led THEN k1 ELSE 0 END AS sys, led AND n = 1 AS leads, CASE WHEN led AND n = 1 THEN 0 ELSE k END AS own FROM f),
p AS (SELECT *, greatest(2048 - 512 - sys, 256) AS room, (sum(own) OVER (PARTITION BY conv_id ORDER BY n) - own)::BIGINT AS before FROM s),
c AS (SELECT *, own > 256 AND (before + own - 1) // room > before // room AS alone, before // room AS cell FROM p),
b AS (SELECT *, lag(cell) OVER w IS DISTINCT FROM cell OR lag(alone) OVER w IS DISTINCT FROM alone AS starts FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
r AS (
  SELECT w.conv_id, sum(i.chars) AS chars FROM b w JOIN b i ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.starts AND w.n > 1
    AND (i.leads OR i.before < w.before AND i.before >= w.before - CASE WHEN w.alone THEN least(256, greatest(0, 2048 - w.own - w.sys)) ELSE 256 END)
  GROUP BY w.conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '') AS loss, sum(chars) AS chars
  FROM b GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (g.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN r ON g.conv_id IS NOT DISTINCT FROM r.conv_id""",
    "op7_url_filter": rf"""
WITH u AS (SELECT page_id, url, position('://' IN coalesce(url, '')) AS p FROM pages),
h AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h)
SELECT page_id, host, path, {_FIT.format(*[f"'{t}'" for _, t in URL_RULES])} AS rule,
  coalesce({_FIT.format(*[f"'{v}'" for v, _ in URL_RULES])}, CASE WHEN {_LISTED} THEN 'block' ELSE 'allow' END) AS verdict
FROM s""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id != b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.b), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id, n.n""",
    "op12_conversation_repair": _REPAIR_SQL,
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3]) AS k FROM q))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
s AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(w[i : i + 1], ' ') AS phrase FROM (SELECT lang, a, w, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY lang, phrase),
h AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE c.k = 3 OR s.longest IS NULL OR 100 * s.longest < 50 * c.a),
u AS (
  SELECT h.lang, h.phrase, h.a, j, x.f AS l, y.f AS r, ((1000000::HUGEINT * h.a * h.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM h) h JOIN f x ON x.lang = h.lang AND x.phrase = array_to_string(h.w[1 : j], ' ') AND x.k = j
    JOIN f y ON y.lang = h.lang AND y.phrase = array_to_string(h.w[j + 1 : h.k], ' ') AND y.k = h.k - j),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000""",
}
