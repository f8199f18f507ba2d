"""Reorder policies and the lost-sales replenishment backtest.

The horizon of each series is gathered into one array (one element per forecast day, so its size
is the horizon, not the data) and folded day by day inside the JVM. Policies are applied after the
gathering: the panel is shuffled once for any number of policies.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.stock import check_lead_time, reorder_point, safety_stock
from shelfcast.sources.schemas import SERIES


class Policy(NamedTuple):
    """`kind` selects the demand signal: rolling_mean, seasonal_naive or ml (forecast)."""

    name: str
    kind: str
    z: float = 0.0
    target_days: int = 14


# The four standard policies and the cost parameters.
STANDARD = (
    Policy("baseline_rolling_mean", "rolling_mean"),
    Policy("baseline_seasonal_naive", "seasonal_naive"),
    Policy("ML_95", "ml", 1.645),
    Policy("ML_99", "ml", 2.326),
)


class Costs(NamedTuple):
    lead_time_days: int = 7
    holding_cost_rate: float = 0.25
    stockout_cost_multiplier: float = 3.0
    initial_stock_days: int = 14
    unit_margin_rate: float = 0.30


HISTORY_ROWS = 28
ROLLING_ROWS = 7


def error_std(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Population deviation of y_true - y_pred per group, 0.0 where undefined."""
    error = F.col("y_true").cast("double") - F.col("y_pred").cast("double")
    spread = F.coalesce(F.stddev_pop(error), F.lit(0.0))
    return preds.groupBy(*(by or SERIES)).agg(spread.alias("forecast_error_std"))


def economics(prices: DataFrame, products: DataFrame | None) -> DataFrame:
    """Median price per series with product category and base price, each filling the other.

    A group of the exact median holds one series' weekly prices.
    """
    unit = prices.groupBy(*SERIES).agg(F.median("price").alias("unit_price"))
    if products is None:
        return unit.select(
            *SERIES, "unit_price", F.lit(None).cast("string").alias("category"), F.col("unit_price").alias("base_price")
        )
    one = products.groupBy("sku_id").agg(F.min(F.struct("category", "base_price")).alias("p"))
    joined = unit.join(one, "sku_id", "left")
    unit_price = F.coalesce("unit_price", "p.base_price")
    return joined.select(
        *SERIES,
        unit_price.alias("unit_price"),
        F.col("p.category").alias("category"),
        F.coalesce(F.col("p.base_price"), unit_price).alias("base_price"),
    )


def recent_history(actuals: DataFrame, preds: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The last `rows` actual rows of each series before the first forecast day of all series.
    The rank filter limits every series on the map side before the shuffle."""
    start = preds.agg(F.min("date")).scalar()
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("date").desc()))
    return (
        actuals.filter(F.col("date") < start)
        .select(*SERIES, "date", F.col("units_sold").cast("double").alias("y_true"))
        .withColumn("_newest", newest)
        .filter(F.col("_newest") <= rows)
        .drop("_newest")
    )


def demand_signals(
    preds: DataFrame,
    actuals: DataFrame,
    lead_time_days: int = 7,
    window: int = ROLLING_ROWS,
    season: int = ROLLING_ROWS,
    history: int = HISTORY_ROWS,
) -> DataFrame:
    """History tail and forecast days of each series with the mean demand every policy kind sees.

    rolling: mean of the last `window` actual rows; seasonal: the `season`th last, else rolling; ml:
    mean forecast of today and the lead time ahead, cut at the end. `in_horizon` marks forecast days.
    `history` rows before the horizon are read, and as many more as the window or season asks for;
    `in_history` marks the former.
    """
    check_lead_time(lead_time_days)
    for name, value in (("window", window), ("season", season), ("history", history)):
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    tail = recent_history(actuals, preds, max(history, window, season)).withColumns(
        {"y_pred": F.lit(None).cast("double"), "in_horizon": F.lit(False)}
    )
    days = preds.select(
        *SERIES,
        "date",
        F.col("y_true").cast("double").alias("y_true"),
        F.col("y_pred").cast("double").alias("y_pred"),
        F.lit(True).alias("in_horizon"),
    )
    w = Window.partitionBy(*SERIES).orderBy("date")
    rolling = F.coalesce(F.avg("y_true").over(w.rowsBetween(-window, -1)), F.lit(0.0))
    newest = F.row_number().over(Window.partitionBy(*SERIES, "in_horizon").orderBy(F.col("date").desc()))
    return tail.unionByName(days).withColumns(
        {
            "rolling_mean": rolling,
            "seasonal_naive": F.coalesce(F.lag("y_true", season).over(w), rolling),
            "ml": F.avg("y_pred").over(w.rowsBetween(0, lead_time_days - 1)),
            "in_history": ~F.col("in_horizon") & (newest <= history if history < max(window, season) else F.lit(True)),
        }
    )


def gather_series(signals: DataFrame, initial_stock_days: int = 14) -> DataFrame:
    """One row per series: mean daily demand, forecast-error deviation, opening stock and the
    horizon as an array in date order.

    Forecast tables hold one row per series and day, so an array is as long as the horizon has
    days, however large or skewed the sales behind it are.
    """
    inside = F.col("in_horizon")
    fields = ("date", "y_true", "y_pred", "rolling_mean", "seasonal_naive", "ml")
    mean = F.coalesce(
        F.avg(F.when(F.col("in_history"), F.col("y_true"))), F.avg(F.when(inside, F.col("y_true"))), F.lit(0.0)
    )
    error = F.when(inside, F.col("y_true") - F.col("y_pred"))
    grouped = signals.groupBy(*SERIES).agg(
        mean.alias("mean_daily"),
        F.coalesce(F.stddev_pop(error), F.lit(0.0)).alias("error_std"),
        F.array_sort(F.collect_list(F.when(inside, F.struct(*fields)))).alias("days"),
    )
    stock = F.ceil(F.col("mean_daily") * F.lit(float(initial_stock_days))).cast("long")
    return grouped.filter(F.size("days") > 0).withColumn("initial_stock", stock)


def with_policies(series: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """One row per series and policy, with the policy's z and target days as columns."""
    rows = [
        F.struct(
            F.lit(p.name).alias("policy"),
            F.lit(p.kind).alias("kind"),
            F.lit(float(p.z)).alias("z"),
            F.lit(p.target_days).alias("target_days"),
        )
        for p in policies
    ]
    return series.select("*", F.inline(F.array(*rows)))


def policy_mean(day: Column) -> Column:
    """The mean demand that a policy's kind sees on a day."""
    kind = F.col("kind")
    return (
        F.when(kind == "rolling_mean", day["rolling_mean"])
        .when(kind == "seasonal_naive", day["seasonal_naive"])
        .otherwise(day["ml"])
    )


def order_quantity(mean: Column, position: Column, lead_time_days: int) -> Column:
    """Units to order at an inventory position: order-up-to for the baselines, reorder point plus
    target stock for ml policies (columns kind, z, target_days, error_std)."""
    cover = F.col("target_days").cast("double") * mean
    point = reorder_point(
        mean, lead_time_days, safety_stock(F.col("error_std"), F.col("z"), lead_time_days)
    )
    is_ml = F.col("kind") == "ml"
    level = F.when(is_ml, point + cover).otherwise(cover)
    wanted = F.greatest(F.ceil(level - position).cast("long"), F.lit(0).cast("long"))
    return F.when(is_ml & (position >= point), F.lit(0).cast("long")).otherwise(wanted)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a struct once inside a lambda and use it by name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _zero() -> Column:
    return F.lit(0).cast("long")


def _day_step(state: Column, day: Column, lead_time_days: int) -> Column:
    """One day: decide on stock before the receipt, receive, serve, lose the rest."""
    position = state["on_hand"] + state["on_order"]
    facts = F.struct(
        order_quantity(policy_mean(day), position, lead_time_days).alias("order"),
        F.element_at(state["pipe"], 1).alias("received"),
        F.greatest(F.bround(day["y_true"], 0).cast("long"), _zero()).alias("demand"),
        (state["on_hand"] + F.element_at(state["pipe"], 1)).alias("stock"),
    )

    def settle(f: Column) -> Column:
        on_hand = F.greatest(f["stock"] - f["demand"], _zero())
        return F.struct(
            on_hand.alias("on_hand"),
            (state["on_order"] - f["received"] + f["order"]).alias("on_order"),
            F.concat(F.slice(state["pipe"], 2, lead_time_days), F.array(f["order"])).alias("pipe"),
            f["received"].alias("received"),
            f["order"].alias("order"),
            (f["stock"] - on_hand).alias("served"),
            F.greatest(f["demand"] - f["stock"], _zero()).alias("stockout"),
        )

    return _bind(facts, settle)


def _opening(lead_time_days: int) -> Column:
    empty = F.array_repeat(_zero(), lead_time_days)
    return F.struct(
        F.col("initial_stock").alias("on_hand"),
        _zero().alias("on_order"),
        empty.alias("pipe"),
        _zero().alias("received"),
        _zero().alias("order"),
        _zero().alias("served"),
        _zero().alias("stockout"),
    )


def replay_totals(cases: DataFrame, lead_time_days: int = 7) -> DataFrame:
    """Fold every case to its totals without keeping the daily trace."""
    start = F.struct(
        _opening(lead_time_days).alias("s"),
        _zero().alias("held"),
        _zero().alias("lost"),
        _zero().alias("events"),
    )

    def step(acc: Column, day: Column) -> Column:
        def add(s: Column) -> Column:
            return F.struct(
                s.alias("s"),
                (acc["held"] + s["on_hand"]).alias("held"),
                (acc["lost"] + s["stockout"]).alias("lost"),
                (acc["events"] + (s["stockout"] > 0).cast("long")).alias("events"),
            )

        return _bind(_day_step(acc["s"], day, lead_time_days), add)

    demand = F.aggregate("days", F.lit(0.0), lambda a, d: a + d["y_true"])
    folded = cases.withColumn("_r", F.aggregate("days", start, step))
    return folded.withColumns(
        {
            "held_units": F.col("_r.held"),
            "stockout_units": F.col("_r.lost"),
            "num_stockout_events": F.col("_r.events"),
            "total_demand": demand,
            "n_days": F.size("days"),
        }
    ).drop("_r")


def replay_days(cases: DataFrame, lead_time_days: int = 7) -> DataFrame:
    """Daily trace of every case: one row per series, policy and forecast day."""
    start = F.struct(
        _opening(lead_time_days).alias("s"), F.array().cast(_TRACE).alias("trace")
    )

    def step(acc: Column, day: Column) -> Column:
        def add(s: Column) -> Column:
            row = F.struct(
                F.size(acc["trace"]).alias("day"),
                day["date"].alias("date"),
                day["y_true"].alias("y_true"),
                day["y_pred"].alias("y_pred"),
                policy_mean(day).alias("mean_forecast"),
                s["received"].alias("received_qty"),
                s["on_hand"].alias("on_hand"),
                s["on_order"].alias("on_order"),
                s["served"].alias("served_units"),
                s["stockout"].alias("stockout_units"),
                s["order"].alias("reorder_qty"),
            )
            return F.struct(s.alias("s"), F.concat(acc["trace"], F.array(row)).alias("trace"))

        return _bind(_day_step(acc["s"], day, lead_time_days), add)

    trace = F.aggregate("days", start, step, lambda acc: acc["trace"])
    return cases.select(*SERIES, "policy", "error_std", F.inline(trace))


_TRACE = (
    "array<struct<day:int,date:bigint,y_true:double,y_pred:double,mean_forecast:double,"
    "received_qty:bigint,on_hand:bigint,on_order:bigint,served_units:bigint,"
    "stockout_units:bigint,reorder_qty:bigint>>"
)


def cost_rates(unit_price: Column, costs: Costs) -> dict[str, Column]:
    """Holding cost per unit and day, stockout cost per unit."""
    return {
        "h_cost": unit_price * F.lit(costs.holding_cost_rate) / F.lit(365.0),
        "s_cost": unit_price * F.lit(costs.unit_margin_rate) * F.lit(costs.stockout_cost_multiplier),
    }


def opening_positions(
    preds: DataFrame, actuals: DataFrame, prices: DataFrame, products: DataFrame | None, costs: Costs = Costs()
) -> DataFrame:
    """One row per series ready to replay: gathered horizon, opening stock and cost rates."""
    signals = demand_signals(preds, actuals, costs.lead_time_days)
    series = gather_series(signals, costs.initial_stock_days)
    priced = series.join(economics(prices, products), SERIES, "left")
    unit = F.coalesce("base_price", F.lit(1.0))
    return priced.withColumns(cost_rates(unit, costs)).drop("unit_price", "base_price")


def series_kpis(totals: DataFrame) -> DataFrame:
    """Costs, service level, turns and stock cover per series and policy."""
    floor = F.lit(1e-9)
    average = F.col("held_units") / F.col("n_days")
    service = F.when(F.col("total_demand") == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.col("stockout_units") / F.nullif(F.col("total_demand"), F.lit(0.0))
    )
    holding = F.col("held_units") * F.col("h_cost")
    stockout = F.col("stockout_units") * F.col("s_cost")
    return totals.select(
        *SERIES,
        "category",
        "policy",
        holding.alias("total_holding_cost"),
        stockout.alias("total_stockout_cost"),
        (holding + stockout).alias("total_cost"),
        service.alias("service_level"),
        (F.col("total_demand") / F.greatest(average, floor)).alias("inventory_turns"),
        (average / F.greatest(F.col("mean_daily"), floor)).alias("avg_days_of_stock"),
        average.alias("avg_inventory"),
        F.col("stockout_units").cast("double").alias("stockout_units"),
        F.col("num_stockout_events").cast("long").alias("num_stockout_events"),
    )


def backtest(
    preds: DataFrame,
    actuals: DataFrame,
    prices: DataFrame,
    products: DataFrame | None = None,
    policies: tuple[Policy, ...] = STANDARD,
    costs: Costs = Costs(),
) -> DataFrame:
    """KPIs per series and policy."""
    series = opening_positions(preds, actuals, prices, products, costs)
    return series_kpis(replay_totals(with_policies(series, policies), costs.lead_time_days))


def policy_summary(kpis: DataFrame) -> DataFrame:
    return (
        kpis.groupBy("policy")
        .agg(
            F.sum("total_holding_cost").alias("total_holding_cost"),
            F.sum("total_stockout_cost").alias("total_stockout_cost"),
            F.sum("total_cost").alias("total_cost"),
            F.avg("service_level").alias("mean_service_level"),
            F.sum("stockout_units").alias("total_stockout_units"),
            F.avg("avg_inventory").alias("mean_avg_inventory"),
            F.count("sku_id").alias("sku_count"),
        )
        .orderBy("total_cost", "policy")
    )


def compare_policies(kpis: DataFrame) -> DataFrame:
    """Per series and policy: cost, service, stock and stockout days on the same demand path."""
    return kpis.select(
        *SERIES, "policy", "total_cost", "service_level", "avg_inventory", "num_stockout_events"
    )


def service_sensitivity(kpis: DataFrame) -> DataFrame:
    """Total cost per service level from a backtest over `ML_<level>` policies."""
    totals = kpis.groupBy("policy").agg(F.sum("total_cost").alias("total_cost"))
    return totals.select(F.regexp_replace("policy", "^ML_", "").alias("service_level"), "total_cost")


def sensitivity_policies(levels: dict[str, float]) -> tuple[Policy, ...]:
    return tuple(Policy(f"ML_{name}", "ml", z) for name, z in levels.items())


def category_cost_delta(
    kpis: DataFrame, challenger: str = "ML_95", base: str = "baseline_rolling_mean"
) -> DataFrame:
    """Cost of one policy minus another per category. Signed sums replace a self-join of the KPIs."""
    signed = F.when(F.col("policy") == challenger, F.col("total_cost")).when(
        F.col("policy") == base, -F.col("total_cost")
    )
    return (
        kpis.filter(F.col("policy").isin(challenger, base))
        .groupBy("category")
        .agg(F.sum(signed).alias("cost_delta"))
        .orderBy("cost_delta")
    )


PolicyFunction = Callable[[int, float, float, int, int], int]


def replay_custom(
    cases: DataFrame, policies: dict[str, PolicyFunction], signal: str = "ml", lead_time_days: int = 7
) -> DataFrame:
    """Replay user-written policies `(day, mean, std, on_hand, on_order) -> units`.

    Arbitrary Python decisions cannot be columns, so each gathered series (one horizon array) is
    replayed in a pandas task. `cases` are opening positions; a case is one row, there is no
    further shuffle.
    """
    lead = check_lead_time(lead_time_days)

    def replay(row, decide: PolicyFunction) -> list[tuple]:
        on_hand, pipe, out = int(row.initial_stock), [0] * lead, []
        for i, day in enumerate(row.days):
            order = max(0, int(decide(i, float(day[signal]), float(row.error_std), on_hand, sum(pipe))))
            stock, demand = on_hand + pipe[0], max(0, round(day["y_true"]))
            on_hand, pipe = max(0, stock - demand), [*pipe[1:], order]
            out.append((i, day["date"], on_hand, max(0, demand - stock), order))
        return out

    def run(batches):
        for batch in batches:
            rows = [
                (row.store_id, row.sku_id, name, *day)
                for row in batch.itertuples(index=False)
                for name, decide in policies.items()
                for day in replay(row, decide)
            ]
            yield pd.DataFrame(rows, columns=names)

    names = ["store_id", "sku_id", "policy", "day", "date", "on_hand", "stockout_units", "reorder_qty"]
    schema = (
        "store_id string, sku_id string, policy string, day int, date long, on_hand long, "
        "stockout_units long, reorder_qty long"
    )
    slim = cases.select(*SERIES, "initial_stock", "error_std", "days")
    return slim.mapInPandas(run, schema)
