"""Runs and their decisions: invites, call budgets, refunds, phases, probabilities, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators import ranks

#: Fixed value: what an answer is called that fits none of the options.
NONE_OF_THESE = "NONE"


def invites(events: DataFrame) -> DataFrame:
    """``name, limit, expires, disabled, codes``: the invites that a log of admin commands leaves.

    Expects ``name, seq, action, amount, expires``.  Adding a name that exists, and any other command on one that does not, is
    refused.  A deleted name may be added anew.  Reissuing gives a new code and carries everything over.
    """
    w = Window.partitionBy("name").orderBy("seq")
    gone = F.when(F.col("action") == "delete", 1).otherwise(0)
    life = F.coalesce(F.sum(gone).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("life", life)
    rows = rows.withColumn("born", F.min(F.when(F.col("action") == "add", F.col("seq"))).over(Window.partitionBy("name", "life"))).where("seq >= born")
    first = F.col("seq") == F.col("born")
    switch = F.col("action").isin("revoke", "enable")
    g = rows.groupBy("name", "life").agg(
        (F.max(F.when(first, F.col("amount"))) + F.coalesce(F.sum(F.when(F.col("action") == "topup", F.col("amount"))), F.lit(0))).alias("limit"),
        F.max(F.when(first, F.col("expires"))).alias("expires"),
        F.coalesce(F.max_by(F.col("action") == "revoke", F.when(switch, F.col("seq"))), F.lit(False)).alias("disabled"),
        (F.count_if(F.col("action") == "reissue") + 1).alias("codes"),
        F.bool_or(F.col("action") == "delete").alias("deleted"),
    )
    return g.where("not deleted").select("name", "limit", "expires", "disabled", "codes")


def expired(expires: Column, today: Column) -> Column:
    """Whether a last valid day (``YYYY-MM-DD``) is over; none never is, an unreadable one always."""
    day = F.try_to_date(expires, "yyyy-M-d")
    return F.when(F.coalesce(expires, F.lit("")) == "", False).otherwise(F.coalesce(today > day, F.lit(True)))


def refusal(failures: Column, limit: Column, disabled: Column, is_expired: Column, most: int = 10) -> Column:
    """Why a code gives no access, in this order; null if it does.  An unknown code has no limit."""
    return F.when(failures >= most, "too_many_failures").when(limit.isNull() | disabled, "invite_invalid").when(is_expired, "invite_expired")


def peeked(used: Column, limit: Column) -> Column:
    """Uses so far as they are told: never more than the limit."""
    return F.least(F.coalesce(used, F.lit(0)), limit)


def code_hash(code: Column) -> Column:
    return F.sha2(F.btrim(code), 256)


def client_key(forwarded: Column, address: Column) -> Column:
    """Sixteen hex digits of the caller's address, the leftmost forwarded one if there is any."""
    first = F.btrim(F.substring_index(forwarded, ",", 1))
    return F.substring(F.sha2(F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(address), 256), 1, 16)


def call_budget(steps: DataFrame, by: list[str], order: list[Column], calls: str, limit: int = 30, reserve: int = 2) -> DataFrame:
    """Adds ``spent`` and ``ok``: a step runs if ``reserve`` calls fit under the run's ``limit``; what it does not need goes back.

    A refused step spends nothing, so what is spent before a step never falls, and all steps after a refused one are refused.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("spent", F.coalesce(F.sum(calls).over(before), F.lit(0))).withColumn("ok", F.col("spent") + reserve <= limit)


def refunded(steps: DataFrame, by: list[str], order: Column, answered: Column) -> DataFrame:
    """``by, refunded``: a run whose first step that ended has failed gets its use back, once, and no more answers."""
    return steps.groupBy(*by).agg((~F.min_by(answered, order)).alias("refunded"))


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int = 30) -> DataFrame:
    """The last ``n`` rows of each key, with ``back``: 1 for the very last."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("back") <= n)


def phases(rows: DataFrame, by: list[str], order: list[Column], hands_over: Column, label: Column) -> DataFrame:
    """Adds ``phase`` (handovers before the row) and ``done``: how often the row's label, without regard to case, was met in its phase so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    phase = F.coalesce(F.sum(hands_over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("phase", phase).withColumn("_label", F.lower(label))
    return rows.withColumn("done", F.row_number().over(Window.partitionBy(*by, "phase", "_label").orderBy(*order))).drop("_label")


def trimmed(rows: DataFrame, by: list[str], order: list[Column], full: list[str]) -> DataFrame:
    """Only the last row of each key keeps the columns ``full``."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return rows.withColumn("_last", last).withColumns({c: F.when(F.col("_last"), F.col(c)) for c in full}).drop("_last")


def valid_choice(choice: Column, probabilities: Column, ids: Column) -> Column:
    """Whether an answer is one: a known choice, one probability per id, each finite and from 0 to 1, their sum 1 within 0.02, the
    choice the largest within a millionth."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    known = F.array_contains(ids, choice) & (F.size(F.array_except(F.map_keys(probabilities), ids)) == 0) & (F.size(F.array_except(ids, F.map_keys(probabilities))) == 0)
    in_range = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce(known & in_range & (F.abs(total - 1) < 0.02) & (F.try_element_at(probabilities, choice) >= F.array_max(values) - 1e-6), F.lit(False))


def alternatives(probabilities: Column, choice: Column, n: int = 2) -> Column:
    """The names of the most probable others, in order; ties go by name."""
    others = F.filter(F.map_entries(probabilities), lambda e: e["key"] != choice)
    ranked = F.array_sort(F.transform(others, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.transform(F.slice(ranked, 1, n), lambda e: e["k"])


def best_of_chunks(answers: DataFrame, by: list[str], least: float = 0.8) -> DataFrame:
    """``by, choice, probability, base`` from ``chunk, option, probability`` rows: each chunk answers with its most probable option, the best
    answer that is not ``NONE_OF_THESE`` wins, and counts as the base from ``least`` on."""
    top = answers.groupBy(*by, "chunk").agg(F.min(F.struct((-F.col("probability")).alias("p"), "option")).alias("t"))
    real = F.col("t.option") != NONE_OF_THESE
    g = top.groupBy(*by).agg(F.min(F.when(real, F.struct("t.p", "chunk", "t.option"))).alias("b"))
    rows = g.select(*by, F.col("b.option").alias("choice"), F.coalesce(-F.col("b.p"), F.lit(0.0)).alias("probability"))
    return rows.withColumn("base", F.when(F.col("probability") >= least, F.col("choice")))


def summed_usage(first: Column, second: Column) -> Column:
    """Two usage maps added by name."""
    return F.map_zip_with(first, second, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def provider_reply_ok(reply: Column) -> Column:
    """Whether a reply is an object with an object of answers, and a usage, if any, of numbers only."""
    v = F.try_parse_json(reply)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    numbers = F.rlike(kind("$.usage"), F.lit(r"^(VOID|OBJECT<>|OBJECT<[^:<>]+: (BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))(, [^:<>]+: (BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)))*>)$"))
    return F.coalesce(F.rlike(kind("$.answers"), F.lit("^OBJECT<")) & numbers, F.lit(False))


def settled_read(reads: DataFrame, by: list[str], order: Column, code: Column, labels_shown: Column, most: int = 6) -> DataFrame:
    """``by, attempt, code, tries``: the first of ``most`` reads that is finished, or the last one.

    A read is unfinished while rows or markers are missing, or it passed without the labels that were asked for.
    """
    open_read = code.isin("no_rows", "row_mismatch", "no_anchor") | ((code == "passed") & ~labels_shown)
    rows = reads.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= most)
    done = F.min(F.when(~open_read, F.col("_n")))
    g = rows.groupBy(*by).agg(F.coalesce(done, F.max("_n")).alias("attempt"), F.collect_list(F.struct("_n", code.alias("c"))).alias("cs"))
    return g.select(*by, "attempt", F.filter("cs", lambda x: x["_n"] == F.col("attempt"))[0]["c"].alias("code"))


def retried(attempts: DataFrame, by: list[str], order: Column, status: Column, most: int = 3) -> DataFrame:
    """``by, tries, outcome``: attempts go on after network errors (null) and statuses 429, 503 and 529 only, ``most`` times."""
    again = status.isNull() | status.isin(429, 503, 529)
    rows = attempts.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= most)
    g = rows.groupBy(*by).agg(F.min(F.when(~again, F.struct("_n", status.alias("s")))).alias("e"), F.max("_n").alias("n"))
    return g.select(*by, F.coalesce("e._n", "n").alias("tries"), F.when(F.col("e").isNull(), "unavailable").when(F.col("e.s") < 400, "answered").otherwise("error").alias("outcome"))


def backoff(attempt: Column, first: float, most: float, jitter: Column | None = None) -> Column:
    """Seconds before the next attempt, counted from 0; ``jitter``, from 0 to 1 (a random column), makes it up to a tenth longer."""
    pause = F.least(F.lit(float(first)) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))
    return pause if jitter is None else pause * (1 + 0.1 * jitter)


def paired_deltas(rows: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """``by, pair, delta``: the second less the first of each two rows in a row; an odd last one has no pair."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = rows.withColumn("pair", F.floor(n / 2)).withColumn("_odd", n % 2 == 1)
    g = rows.groupBy(*by, "pair").agg(F.max(F.when(F.col("_odd"), F.col(value))).alias("b"), F.max(F.when(~F.col("_odd"), F.col(value))).alias("a"), F.count("*").alias("n"))
    return g.where("n = 2").select(*by, "pair", (F.col("b") - F.col("a")).alias("delta"))


def delta_verdict(deltas: DataFrame, by: list[str]) -> DataFrame:
    """``by, pairs, faster, median_delta, verdict``: supported if all pairs, or all but one with a positive median, are faster; not
    supported if a quarter at most is, with none in the median; else inconclusive."""
    counts = deltas.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col("delta") > 0).alias("faster"))
    medians = ranks.quantiles(deltas, by, "delta", {"median_delta": 0.5}).drop("n").withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    g = counts.join(medians, same, "left").drop(*[f"_{c}" for c in by])
    m, p, f = F.col("median_delta"), F.col("pairs"), F.col("faster")
    return g.withColumn("verdict", F.when((f == p) | ((f >= p - 1) & (m > 0)), "supported").when((f <= F.floor(p / 4)) & (m <= 0), "not supported").otherwise("inconclusive"))


def collapsed(labels: Column, blank: int = 0) -> Column:
    """An array of labels read step by step: repeats are one, then blanks go."""
    n = F.size(labels)
    runs = F.filter(F.transform(labels, lambda x, i: F.when((i == 0) | (x != F.get(labels, i - 1)), x)), lambda x: x.isNotNull() & (x != blank))
    return F.when(n >= 0, runs)


def most_probable(options: DataFrame, by: list[str], option: str, p: str, sure: float = 0.8) -> DataFrame:
    """``by, choice, p, sure, valid``: the most probable option (the greatest of several), and whether the probabilities add up to 1 within 0.02."""
    g = options.groupBy(*by).agg(F.max_by(option, F.struct(p, option)).alias("choice"), F.max(p).alias("p"), F.sum(p).alias("_sum"))
    return g.select(*by, "choice", "p", (F.col("p") >= sure).alias("sure"), (F.abs(F.col("_sum") - 1) <= 0.02).alias("valid"))


def reasked(first: DataFrame, second: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """``by, choice, asked_again, usage`` of decisions ``by, choice, probability, usage``: a decision whose probability is below ``least`` is asked a second time, and the
    second answer stands, if there is one; the usage of both, a map of numbers, is added up.  A null probability is below any."""
    again = second.select(*by, F.col("choice").alias("_choice"), F.col("usage").alias("_usage"), F.lit(True).alias("_there"))
    rows = first.join(again, by, "left")
    asked = ~F.coalesce(F.col("probability") >= least, F.lit(False)) & F.coalesce("_there", F.lit(False))
    return rows.select(*by, F.when(asked, F.col("_choice")).otherwise(F.col("choice")).alias("choice"), asked.alias("asked_again"), F.when(asked, summed_usage(F.col("usage"), F.col("_usage"))).otherwise(F.col("usage")).alias("usage"))


def reading_order(rows: DataFrame, by: list[str], height: list[Column], across: list[Column], gap: float) -> DataFrame:
    """Adds ``band`` and ``place``: rows in order of ``height`` (whose first column is a number) are of one band until a step of ``gap`` or more; in a band they are read ``across``."""
    w = Window.partitionBy(*by).orderBy(*height)
    step = height[0] - F.lag(height[0]).over(w)
    banded = rows.withColumn("_step", step).withColumn("band", F.sum(F.when(F.col("_step") >= gap, 1).otherwise(0)).over(w)).drop("_step")
    return banded.withColumn("place", F.row_number().over(Window.partitionBy(*by, "band").orderBy(*across)))
