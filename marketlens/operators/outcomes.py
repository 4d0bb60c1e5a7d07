"""What a read, a check or a run amounts to, in codes and in the sentences that a user sees.

All are column expressions; the sentences are fixed values of the market's users' language.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of states and layers, and why a check failed.
STATUS = {"NOT_RUN": "未讀取", "PASSED": "已讀取", "FAILED": "讀取失敗", "BLOCKED": "被網站擋住"}
LAYERS = {"table": "查表直接開啟", "search": "站內搜尋", "base": "底材清單"}
CHECKS = {
    "product_page": "無法確認進到了商品頁面", "item_match": "這頁面不像是你找的商品", "same_product": "掛單和成交紀錄是不同商品的", "trading_view": "掛單頁不是預期的頁面",
    "recent_view": "沒有打開近期成交頁面", "trading_rows_ok": "無法讀取掛單", "recent_rows_ok": "無法讀取成交紀錄", "not_blocked": "網站擋住了讀取（可能需要登入）",
    "home_page": "沒有停在 Traderie 首頁", "filters_in_url": "網站沒有保留你設定的條件", "filters_shown": "頁面上看不到套用中的條件", "rows_match_filters": "掛單上看不到你設定的條件，網站可能沒有套用篩選",
}
OTHER_CHECK = "有一項檢查沒通過"


def of_map(value: Column, labels: dict[str, str], default: str | Column) -> Column:
    """The label of a value, or ``default``."""
    out = default if isinstance(default, Column) else F.lit(default)
    for k, v in labels.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _fill(template: str, *values: Column) -> Column:
    """``template`` with each ``{}`` replaced by the next value."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [v.cast("string"), F.lit(p)]
    return F.concat(*out)


def status_label(status: Column) -> Column:
    return of_map(status, STATUS, STATUS["NOT_RUN"])


def view_note(status: Column, reason: Column, read: Column, shown: Column) -> Column:
    """The one line under a view that needs explaining; empty where rows show."""
    gone = _fill("篩選後沒有符合的資料（原本讀到 {} 筆）", read)
    return (
        F.when(status == "NOT_RUN", "尚未讀取。").when(status != "PASSED", F.when(F.coalesce(reason, F.lit("")) == "", "讀取失敗").otherwise(reason))
        .when((read > 0) & (shown == 0), gone).when(read > 0, "").otherwise(F.coalesce(reason, F.lit("")))
    )


def tab_count(status: Column, read: Column, shown: Column, active: Column) -> Column:
    """Rows read, or ``shown/read`` while a filter is active; empty before the view was read."""
    return F.when(status == "NOT_RUN", "").when(active, F.concat_ws("/", shown.cast("string"), read.cast("string"))).otherwise(read.cast("string"))


def filter_line(description: Column, hidden: Column, unknown: Column, kept: Column, has_more: Column, few: int = 10) -> Column:
    """What an active filter hides, how much of it only for lack of a label, and a hint where little is left of more."""
    lacking = F.when(unknown > 0, _fill("（其中 {} 筆網站沒標示）", unknown)).otherwise("")
    hint = F.when((kept < few) & F.coalesce(has_more, F.lit(False)), "　可到首頁調高「多讀幾批」").otherwise("")
    return F.concat(_fill("篩選中：{}　隱藏 {} 筆", description, hidden), lacking, hint)


def price_sentence(count: Column, priced: Column, least: Column, median: Column, q1: Column, q3: Column) -> Column:
    """The conclusion of a price summary; empty where nothing is priced.  Values come as text."""
    quartiles = F.when(q1.isNotNull() & q3.isNotNull(), _fill("、四分位 {}–{}", q1, q3)).otherwise("")
    left = F.when(priced < count, _fill("，{} 筆沒有標價", count - priced)).otherwise("")
    return F.when(priced == 0, "").otherwise(F.concat(_fill("價格（High Rune Value）：最低 {}、中位數 {}", least, median), quartiles, _fill("（共 {} 筆", count), left, F.lit("）")))


def explain_checks(failed: Column) -> Column:
    """Sentences of failed checks, each once and in order; unknown ones have one sentence."""
    return F.array_distinct(F.transform(failed, lambda c: of_map(c, CHECKS, OTHER_CHECK)))


def export_blocked(passed: Column, failed: Column) -> Column:
    """Why rows must not be exported; null if the verification passed or did not run (``passed`` null)."""
    reasons = explain_checks(failed)
    head = F.lit("部分資料沒通過核對")
    return F.when(passed.isNull() | passed, None).otherwise(F.when(F.size(reasons) > 0, F.concat(head, F.lit("："), F.array_join(reasons, "；"))).otherwise(head))


def view_step(status: Column, active: Column) -> Column:
    return F.when(status == "PASSED", "done").when(status.isin("FAILED", "BLOCKED"), "failed").when(active, "active").otherwise("pending")


def progress(layer: Column, phase: Column, running: Column, trading: Column, recent: Column, passed: Column) -> list[Column]:
    """The states of the four steps of a name search: find, trading, recent_trades, verify; ``passed`` is null before the check."""
    found = layer.isNotNull() | phase.isNotNull() | (trading != "NOT_RUN") | (recent != "NOT_RUN")
    read = (trading != "NOT_RUN") & (recent != "NOT_RUN")
    now = F.coalesce(phase, F.lit(""))
    return [
        F.when(found, "done").when(running, "active").otherwise("pending").alias("find"),
        view_step(trading, running & ((now == "trading") | (found & phase.isNull()))).alias("trading"),
        view_step(recent, running & (now == "recent_trades")).alias("recent_trades"),
        F.when(passed, "done").when(~passed, "failed").when(running & read, "active").otherwise("pending").alias("verify"),
    ]


def run_outcome(stopped: Column, outcome: Column, status: Column, guard: Column, blocked_views: Column) -> Column:
    """How a run ended: the first of these rules that holds, else ``done``."""
    return (
        F.when(stopped, "stopped").when(outcome == "guard", "problem: guard").when(outcome == "not_found", "problem: not found")
        .when((status == "blocked") & guard.isNotNull(), F.concat(F.lit("problem: "), guard)).when(status == "blocked", "problem: scope").when(blocked_views > 0, "problem: blocked view").otherwise("done")
    )


def derived_view(settings_open: Column, has_invite: Column, running: Column, after: Column, mode: Column) -> Column:
    """Which screen shows."""
    return (
        F.when(settings_open, "settings").when(~has_invite, "welcome").when(running, "running").when(after.isNotNull(), after)
        .when(mode == "listing", "listing").when((mode == "scan") | mode.isNull() | (mode == ""), "scan").otherwise("ready")
    )


def block_reason(has_code: Column, refused: Column, used: Column, limit: Column) -> Column:
    """Why nothing can start: a refusal in its own words, or a quota that is used up; empty otherwise."""
    spent = _fill("這組邀請碼的 {} 次查詢已用完", limit)
    return F.when(~has_code, "").when(refused.isNotNull(), refused).when(used >= limit, spent).otherwise("")


def verdict(expect: Column, status: Column, timed_out: Column, contains: Column, rows: Column, passed: Column, on_slug: Column) -> Column:
    """PASS, FAIL, GAP or BLOCKED of one case: a timeout fails, a guard page blocks, then what the case expects decides."""
    told = status.contains(contains) & (rows == 0)
    as_told = F.when(told, "PASS").otherwise("FAIL")
    either = F.when(status.contains("找不到這個裝備") & (rows == 0), "PASS").when(passed & on_slug, "PASS").otherwise("FAIL")
    return (
        F.when(timed_out, "FAIL").when(status.rlike("防護頁|驗證碼"), "BLOCKED").when(expect.isin("error", "not_found"), as_told).when(expect == "stop", F.when(status == "已停止", "PASS").otherwise("FAIL"))
        .when(expect == "not_found_or_slug", either).when(expect == "known_gap", "GAP").otherwise(F.when(passed & on_slug, "PASS").otherwise("FAIL"))
    )


def item_matches(item: Column, title: Column, text: Column) -> Column:
    """Whether a page shows an item, all given as ``text.words``: the title decides by whole words either way, unless it has none."""
    from marketlens.functions.text import mentions

    return F.when(title != "", mentions(title, item) | mentions(item, title)).otherwise(mentions(text, item))


#: How a search page says that it found nothing, and what a search text may have besides.
NOTHING_FOUND = "(?i)no results (?:could be|were) found"
NOT_IN_QUERY = r"[^A-Za-z0-9 '\-.,:]"


def found_nothing(text: Column) -> Column:
    """Whether a search page says that nothing matched."""
    return F.coalesce(F.rlike(text, F.lit(NOTHING_FOUND)), F.lit(False))


def search_shows_item(url: Column, text: Column, links: Column, item: Column) -> Column:
    """Whether a search page lists a link with exactly the item's name; ``links`` (an array) and ``item`` are names as ``text.name_key`` gives them."""
    on_search = F.coalesce(F.rlike(url, F.lit("[?&]search=")), F.lit(False))
    return F.coalesce(item != "", F.lit(False)) & on_search & ~found_nothing(text) & F.coalesce(F.array_contains(links, item), F.lit(False))


def well_formed(query: Column) -> Column:
    """Whether a search text is plain Latin words with single blanks, so that a search which finds nothing is no typing problem."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(query, NOT_IN_QUERY, " "), r"\s+", " "))
    return F.coalesce((query != "") & (query == clean), F.lit(False))
