"""Seven explainable rules over each customer's ordered transactions.

A transaction is compared only with the customer's earlier ones. First the facts about the earlier
history are computed as columns, then the rules are plain expressions over them. Customers with an
ordinary number of transactions get their facts from window functions, all over one shuffle by
customer. Customers with very many get the same facts from a distributed scan (see `_facts_large`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numbers import exact_parts, haversine_km, micros, ratio
from riskloom.functions.text import present
from riskloom.operators.order_statistics import above_prior_median, above_prior_median_in_chunks
from riskloom.operators.scaling import in_tasks_of, measured_groups, running_in_chunks, small_side, spread_rows
from riskloom.session import materialize
from riskloom.sources.logical import has_usd_amount, history, logical_transactions, model_score_scale

# Channels with the card present and texts of a declined payment.
IN_PERSON_CHANNELS = ("atm", "branch", "pos")
DECLINED = ("declined", "rejected", "denied", "failed", "rechazada", "rechazado")


@dataclass(frozen=True)
class RuleSettings:
    """Thresholds and weights of the rules."""

    suspicious: float = 30
    high_risk: float = 60
    min_history: int = 5
    burst_minutes: int = 10
    amount_zscore: float = 3.0
    amount_times_mean: float = 2.0
    night_before_hour: int = 5
    night_share: float = 0.05
    burst_count: int = 2
    max_travel_kmh: float = 900
    min_travel_km: float = 300
    weight_amount: int = 40
    weight_country: int = 30
    weight_city: int = 15
    weight_category: int = 10
    weight_night: int = 15
    weight_burst: int = 25
    weight_declines: int = 20
    weight_travel: int = 35
    # Customers with more transactions than a task should sort leave the window functions.
    large_customer: int = 200_000
    # The windows of a task sort its rows in about ten orders at a time, 9 KB a row in all.
    rows_in_task: int = 100_000


DEFAULTS = RuleSettings()
FACTS = ["prior_n", "amt_n", "amt_mean", "amt_std", "above_median", "new_country", "new_city", "new_category",
         "night_prior", "has_time", "recent_n", "recent_declines", "last_lat", "last_lon", "last_us", "customer_last"]


def comparable_amount(usd: bool) -> Column:
    """Amount used for statistics: the USD one when the table has such a column."""
    return F.col("amount_usd") if usd else F.col("amount")


def in_person(channel: Column) -> Column:
    """Card present, or channel unknown."""
    return ~present(channel) | F.lower(F.trim(channel)).isin(*IN_PERSON_CHANNELS)


def _prepare(history_rows: DataFrame, usd: bool, settings: RuleSettings) -> DataFrame:
    night = F.hour("timestamp") < settings.night_before_hour
    declined = F.coalesce(F.lower(F.trim("status")).isin(*DECLINED), F.lit(False))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & in_person(F.col("channel"))
    return history_rows.filter(F.col("customer").isNotNull()).withColumns({
        "_us": micros(F.col("timestamp")),
        "_amt": comparable_amount(usd),
        "_night": night.cast("int"),
        "_timed": (F.hour("timestamp") > 0) | (F.minute("timestamp") > 0),
        "_declined": declined.cast("int"),
        "_located": located,
    })


def _burst_us(settings: RuleSettings) -> int:
    return settings.burst_minutes * 60 * 1_000_000


def _facts_ordinary(rows: DataFrame, settings: RuleSettings, in_tasks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts by window functions. All of them share the shuffle by customer; `in_tasks` shuffles the rows and brings the
    few rows of the medians to them, so that the facts are not shuffled again."""
    rows = in_tasks(rows)
    customer = Window.partitionBy("customer")
    ordered = customer.orderBy("_us", "id")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # The range frame also holds the row itself and later rows of the same moment; they are counted
    # by the second window and taken off.
    recent = customer.orderBy("_us").rangeBetween(-_burst_us(settings), 0)
    same_moment = (Window.partitionBy("customer", "_us").orderBy("id")
                   .rowsBetween(0, Window.unboundedFollowing))

    def first_of(name: str) -> Column:
        rank = F.row_number().over(Window.partitionBy("customer", name).orderBy("_us", "id"))
        return present(F.col(name)) & (rank == 1)

    one = F.lit(1)
    whole, rest = exact_parts(F.col("_amt"))
    last = F.last(F.when(F.col("_located"), F.struct("lat", "lon", "_us")), ignorenulls=True).over(before)
    facts = (rows.withColumns({
        "prior_n": F.row_number().over(ordered) - 1,
        "amt_n": F.count("_amt").over(before),
        "amt_mean": ratio(F.sum(whole).over(before) + F.sum(rest).over(before), F.count("_amt").over(before)),
        "amt_std": F.stddev_pop("_amt").over(before),
        "night_prior": F.coalesce(F.sum("_night").over(before), F.lit(0)),
        "has_time": F.max("_timed").over(customer),
        "customer_last": F.max("timestamp").over(customer),
        "recent_n": F.count(one).over(recent) - F.count(one).over(same_moment),
        "recent_declines": F.sum("_declined").over(recent) - F.sum("_declined").over(same_moment),
        "_last": last,
    }).withColumns({"new_country": first_of("country"), "new_city": first_of("city"),
                    "new_category": first_of("category")})
      .withColumns({"last_lat": F.col("_last.lat"), "last_lon": F.col("_last.lon"), "last_us": F.col("_last._us")})
      .drop("_last"))
    above = F.col("new_category") & F.coalesce(F.array_contains("_above", F.col("category")), F.lit(False))
    return facts.join(in_tasks(_categories_above_median(rows)), "customer", "left").withColumn("above_median", above).drop("_above")


def _first_occurrences(rows: DataFrame) -> DataFrame:
    """Rows that are the first of their country, city or category for the customer."""
    def firsts(name: str) -> DataFrame:
        first = (rows.filter(present(F.col(name))).groupBy("customer", name)
                     .agg(F.min(F.struct("_us", "id", "_row")).alias("f")))
        return first.select(F.col("f._row").alias("_row"),
                            *[F.lit(other == name).alias(f"new_{other}") for other in ("country", "city", "category")])

    stacked = firsts("country").unionByName(firsts("city")).unionByName(firsts("category"))
    return stacked.groupBy("_row").agg(*[F.max(f"new_{n}").alias(f"new_{n}") for n in ("country", "city", "category")])


def _above_prior_median(rows: DataFrame) -> DataFrame:
    """(_row, above_median) for the rows that start a category, the only rows that need it.

    A category may start with a row without amount; such a row is no probe, and no later one is.
    """
    starts = rows.filter(present(F.col("category"))).groupBy("customer", "category").agg(F.min(F.struct("_us", "id", "_row", "_amt")).alias("c"))
    probes = starts.filter("c._amt IS NOT NULL").select("customer", F.col("c._row").alias("_row"))
    found = above_prior_median_in_chunks(rows, materialize(probes, "category-starts"), "customer", ["_us", "id"], "_row", "_amt")
    return found.withColumnRenamed("above", "above_median")


def _categories_above_median(rows: DataFrame) -> DataFrame:
    """(customer, _above): the categories whose first transaction exceeds the median of the earlier ones, of
    customers that fit a task."""
    rank = F.row_number().over(Window.partitionBy("customer", "category").orderBy("_us", "id"))
    marked = rows.select("customer", "_us", "id", "_amt", "category").withColumn("_first", present(F.col("category")) & (rank == 1))
    found = above_prior_median(marked, "customer", ["_us", "id"], F.col("category"), F.col("_first"), "_amt")
    return found.filter("above").groupBy("customer").agg(F.collect_set("probe").alias("_above"))


def _facts_large(rows: DataFrame, customers: int, settings: RuleSettings) -> DataFrame:
    """The same facts for customers of any size, without bringing a customer into one task.

    * Running counts and sums: rows range-partitioned by (customer, time), scanned in chunks.
    * Bursts: every row also sends a probe to the start of its look-back time; the running count at
      the row minus the one at the probe is the number of transactions in between.
    * First occurrences: the minimum per value, matched back by row.
    * A deviation of zero is found by counting: no earlier amount differs from the customer's first.
    * Median: see `order_statistics`.
    """
    per_customer = rows.groupBy("customer").agg(
        F.count(F.lit(1)).alias("_size"), F.avg("_amt").alias("_level"),
        F.min_by("_amt", F.when(F.col("_amt").isNotNull(), F.struct("_us", "id"))).alias("_first"), F.max("_timed").alias("has_time"), F.max("timestamp").alias("customer_last"))
    # Written once: the scan, the first occurrences and the median all read it. Amounts are taken
    # relative to the customer's mean so that the running squares keep their precision.
    # Rows get a key of their own, since transaction ids may be missing.
    rows = materialize(rows.join(small_side(per_customer, customers), "customer").withColumn("_row", F.monotonically_increasing_id()),
                       "large-customers")
    shifted = F.col("_amt") - F.col("_level")
    whole, rest = (F.coalesce(part, F.lit(0.0)) for part in exact_parts(F.col("_amt")))
    zero, nothing = F.lit(0), F.lit(None)
    point = F.when(F.col("_located"), F.struct("lat", "lon", "_us"))
    own = rows.select("customer", F.col("_us").alias("_at"), F.lit(1).alias("_kind"), "id", "_row",
                      F.lit(1).alias("v_n"), F.col("_amt").isNotNull().cast("int").alias("v_amt"),
                      F.coalesce(F.col("_amt") != F.col("_first"), F.lit(False)).cast("int").alias("v_other"),
                      F.coalesce(shifted, F.lit(0.0)).alias("v_sum"),
                      F.coalesce(shifted * shifted, F.lit(0.0)).alias("v_squares"), whole.alias("v_whole"), rest.alias("v_rest"),
                      F.col("_night").alias("v_night"), F.col("_declined").alias("v_declined"), point.alias("v_point"))
    probes = rows.select("customer", (F.col("_us") - _burst_us(settings)).alias("_at"), F.lit(0).alias("_kind"), "id", "_row",
                         zero.alias("v_n"), zero.alias("v_amt"), zero.alias("v_other"), F.lit(0.0).alias("v_sum"),
                         F.lit(0.0).alias("v_squares"), F.lit(0.0).alias("v_whole"), F.lit(0.0).alias("v_rest"), zero.alias("v_night"), zero.alias("v_declined"),
                         nothing.cast(own.schema["v_point"].dataType).alias("v_point"))
    sums = {n: F.col(f"v_{n}") for n in ("n", "amt", "other", "sum", "squares", "whole", "rest", "night", "declined")}
    scan = running_in_chunks(own.unionByName(probes), ["customer"], [F.col("_at"), F.col("_kind"), F.col("id"), F.col("_row")],
                             sums, {"point": F.col("v_point")})
    at_row, at_probe = F.col("_kind") == 1, F.col("_kind") == 0

    def value(kind: Column, name: str) -> Column:
        return F.max(F.when(kind, F.col(f"before_{name}")))

    facts = scan.groupBy("_row").agg(
        value(at_row, "other").alias("_other"),
        value(at_row, "n").alias("prior_n"), value(at_row, "amt").alias("amt_n"), value(at_row, "sum").alias("_s"),
        value(at_row, "squares").alias("_q"), (value(at_row, "whole") + value(at_row, "rest")).alias("_total"), value(at_row, "night").alias("night_prior"),
        (value(at_row, "n") - value(at_probe, "n")).alias("recent_n"),
        (value(at_row, "declined") - value(at_probe, "declined")).alias("recent_declines"),
        value(at_row, "point").alias("_last"))
    firsts = _first_occurrences(rows)
    medians = _above_prior_median(rows)
    mean = ratio(F.col("_s"), F.col("amt_n"))
    variance = ratio(F.col("_q"), F.col("amt_n")) - mean * mean
    no = F.lit(False)
    constant = F.col("_other") == 0
    deviation = F.when(variance.isNotNull(), F.when(constant, F.lit(0.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))))
    level = F.when(mean.isNotNull(), F.when(constant, F.col("_first")).otherwise(ratio(F.col("_total"), F.col("amt_n"))))
    return (rows.join(facts, "_row").join(firsts, "_row", "left").join(medians, "_row", "left")
                .withColumns({"amt_std": deviation, "amt_mean": level,
                              "new_country": F.coalesce("new_country", no), "new_city": F.coalesce("new_city", no),
                              "new_category": F.coalesce("new_category", no),
                              "above_median": F.coalesce("above_median", no),
                              "last_lat": F.col("_last.lat"), "last_lon": F.col("_last.lon"),
                              "last_us": F.col("_last._us")})
                .drop("_last", "_s", "_q", "_total", "_level", "_size", "_first", "_other", "_row"))


def history_facts(history_rows: DataFrame, usd: bool, settings: RuleSettings = DEFAULTS,
                  sizes: DataFrame | None = None, measured: tuple[DataFrame | None, int, int] | None = None) -> DataFrame:
    """The history with the fact columns.

    `sizes` is any frame with the `customer` of every row, duplicates allowed; the raw table is
    cheaper to count than the history itself. `measured` has its `measured_groups` where they are known.
    """
    prepared = _prepare(history_rows, usd, settings)
    large, n, total = measured or measured_groups((sizes or history_rows).filter(F.col("customer").isNotNull()), ["customer"],
                                                  settings.large_customer)
    passed_on = [*prepared.columns, *FACTS]

    def in_tasks(rows: DataFrame) -> DataFrame:
        return in_tasks_of(rows, ["customer"], total, settings.rows_in_task)

    if large is None:
        return _facts_ordinary(prepared, settings, in_tasks).select(*passed_on)
    keys = small_side(large.select("customer"), n)
    ordinary = _facts_ordinary(prepared.join(keys, "customer", "left_anti"), settings, in_tasks)
    heavy = _facts_large(prepared.join(keys, "customer", "left_semi"), n, settings)
    return ordinary.select(*passed_on).unionByName(heavy.select(*passed_on))


def logical_facts(logical: DataFrame, usd: bool, settings: RuleSettings = DEFAULTS) -> DataFrame:
    """`history_facts` of logical transactions with all their versions. The newest version is picked in tasks sized by rows."""
    measured = measured_groups(logical.select("customer"), ["customer"], settings.large_customer)
    return history_facts(history(spread_rows(logical, measured[2], settings.rows_in_task)), usd, settings, measured=measured)


def risk_level(score: Column, settings: RuleSettings = DEFAULTS) -> Column:
    return (F.when(score >= settings.high_risk, "high").when(score >= settings.suspicious, "medium").otherwise("low"))


def rule_hits(facts: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    """One boolean column per rule, and the travel distance and time they are explained with."""
    s = settings
    amount, mean, std = F.col("_amt"), F.col("amt_mean"), F.col("amt_std")
    known = F.col("prior_n") >= s.min_history
    z = F.when(std > 0, (amount - mean) / std)
    country = known & F.col("new_country")
    km = haversine_km(F.col("last_lat"), F.col("last_lon"), F.col("lat"), F.col("lon"))
    hours = (F.col("_us") - F.col("last_us")) / F.lit(3_600_000_000.0)
    speed = ratio(F.col("travel_km"), F.when(F.col("travel_hours") > 0, F.col("travel_hours")))
    fast = (F.col("travel_hours") <= 0) | (speed > s.max_travel_kmh)
    timed = F.col("has_time")
    hits = {
        "hit_amount": (F.col("amt_n") >= s.min_history) & (z >= s.amount_zscore) & (amount > mean * s.amount_times_mean),
        "hit_country": country,
        "hit_city": known & F.col("new_city") & ~country,
        "hit_category": known & F.col("new_category") & (amount != 0) & F.col("above_median"),
        "hit_night": known & timed & (F.col("_night") == 1)
        & (ratio(F.col("night_prior"), F.col("prior_n")) < s.night_share),
        "hit_burst": timed & (F.col("recent_n") >= s.burst_count),
        "hit_declines": timed & (F.col("recent_declines") >= s.burst_count),
        "hit_travel": F.col("_located") & (F.col("travel_km") >= s.min_travel_km) & fast,
    }
    moved = facts.withColumns({"travel_km": F.when(F.col("_located"), km), "travel_hours": hours})
    return moved.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in hits.items()})


def rule_score(settings: RuleSettings = DEFAULTS) -> Column:
    weights = {"amount": settings.weight_amount, "country": settings.weight_country, "city": settings.weight_city,
               "category": settings.weight_category, "night": settings.weight_night, "burst": settings.weight_burst,
               "declines": settings.weight_declines, "travel": settings.weight_travel}
    total = sum((F.when(F.col(f"hit_{n}"), w).otherwise(0) for n, w in weights.items()), F.lit(0))
    return F.least(total, F.lit(100))


def reasons(usd: bool, settings: RuleSettings = DEFAULTS) -> Column:
    """Explanations of the rules that fired, in rule order. The wording is fixed.

    All numbers are rounded half to even by their exact value (`format_string` rounds their shortest text half up).
    """
    s = settings
    unit = " USD" if usd else ""
    minutes = F.greatest(F.col("travel_hours"), F.lit(0.0)) * 60
    texts = {
        "amount": F.concat(F.lit("Monto "), F.replace(F.format_number(ratio(F.col("_amt"), F.col("amt_mean")), 1), F.lit(","), F.lit("")),
                           F.lit(" veces mayor a su promedio ("), F.format_number("amt_mean", 0), F.lit(f"{unit})")),
        "country": F.concat(F.lit("Primera transacción registrada en "), F.col("country")),
        "city": F.concat(F.lit("Primera transacción registrada en "), F.col("city")),
        "category": F.concat(F.lit("Categoría nueva para el cliente: "), F.col("category")),
        "night": F.concat(F.lit("Hora inusual ("), F.date_format("timestamp", "HH:mm"), F.lit(") para sus hábitos")),
        "burst": F.concat((F.col("recent_n") + 1).cast("string"),
                          F.lit(f" transacciones en {s.burst_minutes} minutos")),
        "declines": F.concat(F.col("recent_declines").cast("string"), F.lit(" intentos rechazados justo antes")),
        "travel": F.concat(F.lit("Viaje imposible: "), F.format_number("travel_km", 0),
                           F.lit(" km desde la compra presencial anterior en "),
                           F.replace(F.format_number(minutes, 0), F.lit(","), F.lit("")), F.lit(" minutos")),
    }
    fired = [F.when(F.col(f"hit_{n}"), text) for n, text in texts.items()]
    bank = F.when(F.col("model_score") >= s.suspicious,
                  F.concat(F.lit("El modelo antifraude del banco le asignó "),
                           F.replace(F.format_number("model_score", 0), F.lit(","), F.lit("")), F.lit("/100")))
    return F.filter(F.array(*fired, bank), lambda text: text.isNotNull())


def apply_rules(facts: DataFrame, usd: bool, scale: Column, settings: RuleSettings = DEFAULTS,
                keep_hits: bool = False) -> DataFrame:
    """rule_score, model_score, score, level and reasons of every row."""
    known = F.col("model_score").isNotNull()       # least() would turn a missing score into 100
    model = F.when(known, F.bround(F.least(F.col("model_score") * scale, F.lit(100.0)), 1))
    scored = rule_hits(facts, settings).withColumns({"rule_score": rule_score(settings), "model_score": model})
    scored = scored.withColumn("score", F.greatest(F.col("rule_score").cast("double"),
                                                   F.coalesce("model_score", F.lit(0.0))))
    scored = scored.withColumns({"level": risk_level(F.col("score"), settings), "reasons": reasons(usd, settings)})
    internal = [c for c in scored.columns if c.startswith("_")]
    if not keep_hits:
        internal += [c for c in scored.columns if c.startswith(("hit_", "travel_")) or c in FACTS]
        internal.remove("customer_last")
    return scored.drop(*internal)


def score_since(scored: DataFrame, since: dt.date | dt.datetime | Column | None) -> DataFrame:
    """Rows from a moment on. The filter comes after the windows, so earlier rows still count."""
    if since is None:
        return scored
    return scored.filter(F.col("timestamp") >= (since if isinstance(since, Column) else F.lit(since)))


def score_transactions(transactions: DataFrame, settings: RuleSettings = DEFAULTS, customers: DataFrame | None = None,
                       keep_hits: bool = False) -> DataFrame:
    """Every transaction of a physical table scored against its customer's earlier history.

    `customers` (column `customer`) restricts the work to some customers. The label is passed on
    but never used.
    """
    logical = logical_transactions(transactions)
    scale = model_score_scale(logical).scalar()
    if customers is not None:
        logical = logical.join(customers.select("customer").distinct(), "customer", "left_semi")
    usd = has_usd_amount(transactions)
    facts = logical_facts(logical, usd, settings)
    return apply_rules(facts, usd, scale, settings, keep_hits)


def with_burst(minutes: int) -> RuleSettings:
    return replace(DEFAULTS, burst_minutes=minutes)
