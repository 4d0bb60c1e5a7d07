"""The listing side: prices in rune order, what blocks a listing, its body, and what a site's reply means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the game's order of runes.
RUNES = (
    "El", "Eld", "Tir", "Nef", "Eth", "Ith", "Tal", "Ral", "Ort", "Thul", "Amn", "Sol", "Shael", "Dol", "Hel", "Io", "Lum",
    "Ko", "Fal", "Lem", "Pul", "Um", "Mal", "Ist", "Gul", "Vex", "Ohm", "Lo", "Sur", "Ber", "Jah", "Cham", "Zod",
)
#: The keys of a listing that are the same for all.
FALSE_KEYS = ("acceptListingPrice", "all", "captchaManaged", "diy", "free", "needMaterials", "offerBells", "offerNmt", "offerWishlist", "standingListing", "stockListing", "touchTrading")
MOST_GROUPS = 3


def rune_rank(name: Column) -> Column:
    """A rune's place in the game's order, with or without " Rune"; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(r) for r in RUNES]), F.regexp_replace(name, " Rune$", ""))
    return F.when(at > 0, at - 1).otherwise(len(RUNES)).cast("int")


def valid_quantity(quantity: Column) -> Column:
    """Whether a quantity (text) is a whole number from 1 on."""
    n = quantity.try_cast("double")
    return F.coalesce((n >= 1) & (n == F.floor(n)), F.lit(False))


def price_problem(prices: Column, make_offer: Column) -> Column:
    """What is wrong with the asked prices (an array of ``rune, quantity``), or empty: the first group that is incomplete, no whole number or a repeat."""
    good = F.filter(prices, lambda g: g["rune"].isNotNull() & valid_quantity(g["quantity"]))
    at = lambda i, tail: F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(f" 組{tail}"))
    wrong = F.transform(
        prices,
        lambda g, i: F.when(g["rune"].isNull(), at(i, "還沒選符文（不要的話按 ✕ 刪除）")).when(~valid_quantity(g["quantity"]), at(i, "的數量要是 1 以上的整數"))
        .when(F.array_position(F.transform(prices, lambda x: x["rune"]), g["rune"]) <= i, at(i, "和前面的組選了同一個符文")),
    )
    first = F.coalesce(F.try_element_at(F.filter(wrong, lambda x: x.isNotNull()), F.lit(1)), F.lit(""))
    return F.when(make_offer, "").when(F.size(good) == 0, "請選擇想換的符文和數量，或勾「接受出價」").otherwise(first)


def listing_blocker(product: Column, name: Column, known: Column, rarity: Column, blank_labels: Column, prices: Column, make_offer: Column, amount: Column) -> Column:
    """The first reason why a form cannot be posted, or empty.

    ``known`` is null before the item record was fetched, ``blank_labels`` the labels of ticked number conditions without digits, ``rarity`` empty where a
    base needs one, ``amount`` text.
    """
    price = price_problem(prices, make_offer)
    return (
        F.when(product.isNull(), F.concat(F.lit("「"), F.coalesce(name, F.lit("")), F.lit("」不在 Traderie 的物品表裡，無法上架"))).when(~known, "Traderie 沒有這件物品的資料").when(rarity == "", "請選擇品質（黃裝／藍裝／白裝）")
        .when(F.size(blank_labels) > 0, F.concat(F.lit("這些條件還沒有數值："), F.array_join(blank_labels, "、"))).when(F.size(prices) > MOST_GROUPS, f"最多 {MOST_GROUPS} 組").when(price != "", price)
        .when(~valid_quantity(amount), "數量要是 1 以上的整數").otherwise("")
    )


def price_items(forms: DataFrame, rune_ids: DataFrame) -> DataFrame:
    """``form_id, group, id, quantity``: one row for each complete price group, numbered as posted; none where offers are accepted.

    Forms have ``form_id, make_offer, prices``; ``rune_ids`` has ``rune, id``.
    """
    good = F.filter("prices", lambda g: g["rune"].isNotNull() & valid_quantity(g["quantity"]))
    rows = forms.where("not make_offer").select("form_id", F.posexplode(good).alias("group", "g"))
    return rows.join(rune_ids, F.col("g.rune") == F.col("rune"), "left").select("form_id", "group", F.col("id").cast("string").alias("id"), F.col("g.quantity").try_cast("double").cast("long").cast("string").alias("quantity"))


def listing_body(item: Column, mode: Column, kind: Column, make_offer: Column, amount: Column, properties: Column, items: Column) -> Column:
    """The body of a listing as JSON, with exactly the keys that the site takes.  It is never sent from here."""
    fixed = [F.lit(False).alias(k) for k in FALSE_KEYS] + [F.lit("").alias(k) for k in ("captcha", "offerWishlistId", "wishlist")]
    empty = [F.array().cast("array<string>").alias("currencyGroupPrices"), F.lit(None).cast("string").alias("endTime"), F.lit(True).alias("selling")]
    own = [item.alias("item"), mode.alias("itemMode"), kind.alias("itemType"), F.coalesce(make_offer, F.lit(False)).alias("makeOffer"), amount.try_cast("double").cast("long").cast("string").alias("amount"), properties.alias("properties"), items.alias("items")]
    return F.to_json(F.struct(*fixed, *empty, *own), {"ignoreNullFields": "false"})


def missing_required(required: Column, sent: Column) -> Column:
    """The names of required properties (an array of ``id, name``) that the sent ids lack."""
    return F.transform(F.filter(required, lambda p: ~F.array_contains(sent, p["id"])), lambda p: p["name"])


def reply_reason(status: Column, body: Column) -> Column:
    """Why a site's reply (status, body as text) is a refusal; empty for a good one."""
    error = F.get_json_object(body, "$.error")
    code = status.cast("string")
    return (
        F.when(status.isNull(), "Traderie 沒有回應").when(status.isin(401, 403), F.concat(F.lit("Traderie 要求登入或拒絕了這次上架（HTTP "), code, F.lit("）：請在 Traderie 登入後再試")))
        .when(status.between(400, 499) & F.rlike(body, F.lit("(?i)captcha")), "Traderie 要求驗證碼，無法代為上架").when(~status.between(200, 299), F.concat(F.lit("Traderie 回覆 HTTP "), code, F.lit("："), F.substring(body, 1, 120)))
        .when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("Traderie 拒絕了這次上架："), F.substring(error, 1, 120))).otherwise("")
    )


def listing_id(body: Column) -> Column:
    """The id in a reply: ``id``, ``listing.id``, ``listing`` or ``listing_id``, whichever comes first; null for an object."""
    first = F.coalesce(*[F.get_json_object(body, p) for p in ("$.id", "$.listing.id", "$.listing", "$.listing_id")])
    return F.when(~F.rlike(first, F.lit(r"^[\[{]")), first)


def captcha_required(features: Column, skip: Column, feature: str = "LISTINGS:CAPTCHA") -> Column:
    return F.coalesce(F.array_contains(features, feature), F.lit(False)) & ~F.coalesce(skip, F.lit(False))


def defaulted(value: Column, options: tuple[str, ...], default: str) -> Column:
    """A saved setting, or its default where it is none of the options."""
    return F.when(value.isin(*options), value).otherwise(default)
