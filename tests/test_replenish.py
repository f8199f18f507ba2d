import math
import random

import pytest
from helpers import day, rows
from pyspark.sql import functions as F

from shelfcast.functions import stock
from shelfcast.operators import replenish as rp

PREDS = "store_id string, sku_id string, date long, y_true double, y_pred double"
ACTUALS = "store_id string, sku_id string, date long, units_sold long"
PRICES = "store_id string, sku_id string, price double"


def simulate(history, preds, policy, lead, std, initial):
    """Plain day loop of the backtest rules for one series."""
    on_hand, pipe, seen, out = initial, [0] * lead, list(history), []
    for i, (y, p) in enumerate(preds):
        rolling = sum(seen[-7:]) / len(seen[-7:]) if seen else 0.0
        if policy.kind == "rolling_mean":
            mean = rolling
        elif policy.kind == "seasonal_naive":
            mean = seen[-7] if len(seen) >= 7 else rolling
        else:
            ahead = [q for _, q in preds[i : i + lead]]
            mean = sum(ahead) / len(ahead)
        position = on_hand + sum(pipe)
        level = policy.target_days * mean
        if policy.kind == "ml":
            point = mean * lead + policy.z * std * math.sqrt(lead)
            order = max(0, math.ceil(point + level - position)) if position < point else 0
        else:
            order = max(0, math.ceil(level - position))
        on_hand, pipe = on_hand + pipe[0], [*pipe[1:], order]
        demand = max(0, round(y))
        short, on_hand = max(0, demand - on_hand), max(0, on_hand - demand)
        out.append((i, on_hand, short, order))
        seen.append(y)
    return out


def random_series(n_series=12, horizon=40, past=35):
    rng = random.Random(5)
    return {
        f"k{i}": (
            [rng.randint(0, 9) for _ in range(rng.choice([0, 3, past]))],
            [(rng.choice([rng.randint(0, 12), 2.5, 3.5]), rng.uniform(0, 8)) for _ in range(horizon)],
        )
        for i in range(n_series)
    }


def frames(spark, series):
    preds, actuals = [], []
    for sku, (past, ahead) in series.items():
        actuals += [("s", sku, day(-len(past) + i), u) for i, u in enumerate(past)]
        preds += [("s", sku, day(i), float(y), float(p)) for i, (y, p) in enumerate(ahead)]
    prices = [("s", sku, 2.0) for sku in list(series)[1:]]
    return (
        spark.createDataFrame(preds, PREDS),
        spark.createDataFrame(actuals, ACTUALS),
        spark.createDataFrame(prices, PRICES),
    )


def test_fold_equals_day_loop(spark):
    series = random_series()
    cases = rp.with_policies(rp.opening_positions(*frames(spark, series), None), rp.STANDARD)
    days = {}
    for r in rp.replay_days(cases).collect():
        days.setdefault((r.sku_id, r.policy), []).append((r.day, r.on_hand, r.stockout_units, r.reorder_qty))
    totals = {(r.sku_id, r.policy): r for r in rp.replay_totals(cases).collect()}
    for sku, (past, ahead) in series.items():
        errors = [y - p for y, p in ahead]
        std = math.sqrt(sum((e - sum(errors) / len(errors)) ** 2 for e in errors) / len(errors))
        tail = past[-28:] or [y for y, _ in ahead]
        initial = math.ceil(sum(tail) / len(tail) * 14)
        for policy in rp.STANDARD:
            want = simulate(past, ahead, policy, 7, std, initial)
            assert sorted(days[sku, policy.name]) == want
            t = totals[sku, policy.name]
            assert t.held_units == sum(w[1] for w in want)
            assert t.stockout_units == sum(w[2] for w in want)
            assert t.num_stockout_events == sum(w[2] > 0 for w in want)


def steady(spark, horizon=30, demand=10.0):
    return spark.createDataFrame([("s", "a", day(i), demand, demand) for i in range(horizon)], PREDS)


def test_never_ordering_runs_out_on_day_ten(spark):
    actuals = spark.createDataFrame([], ACTUALS)
    prices = spark.createDataFrame([("s", "a", 1.0)], PRICES)
    cases = rp.opening_positions(steady(spark), actuals, prices, None).withColumn("initial_stock", F.lit(100))
    out = rp.replay_custom(cases, {"never": lambda *a: 0}).orderBy("day").collect()
    short = [r.day for r in out if r.stockout_units > 0]
    assert short[0] == 10 and sum(r.stockout_units for r in out) == 200
    always = rp.replay_custom(cases, {"always": lambda *a: 50}).agg(F.sum("stockout_units")).first()[0]
    assert always < 200


def test_forward_mean_is_cut_at_the_end(spark):
    preds = spark.createDataFrame([("s", "a", day(i), 1.0, float(i)) for i in range(12)], PREDS)
    got = rp.demand_signals(preds, spark.createDataFrame([], ACTUALS), 7).orderBy("date").collect()
    assert got[4].ml == 7.0 and got[11].ml == 11.0 and got[0].rolling_mean == 0.0


def test_kpis_and_summaries(spark):
    preds, actuals, prices = frames(spark, random_series())
    products = spark.createDataFrame(
        [(f"k{i}", "even" if i % 2 == 0 else "odd", 4.0) for i in range(12)], "sku_id string, category string, base_price double"
    )
    kpis = rp.backtest(preds, actuals, prices, products).persist()
    assert kpis.count() == 48
    for r in kpis.collect():
        assert math.isclose(r.total_cost, r.total_holding_cost + r.total_stockout_cost)
        price = 1.0 if r.sku_id == "k0" else 4.0
        assert math.isclose(r.total_stockout_cost, r.stockout_units * price * 0.3 * 3)
        assert math.isclose(r.total_holding_cost, r.avg_inventory * 40 * price * 0.25 / 365, abs_tol=1e-9)
        assert 0.0 <= r.service_level <= 1.0
    by = {r.policy: r for r in rp.policy_summary(kpis).collect()}
    assert by["ML_99"].total_holding_cost >= by["ML_95"].total_holding_cost
    assert by["ML_99"].total_stockout_units <= by["ML_95"].total_stockout_units
    assert by["ML_95"].sku_count == 12
    costs = [r.total_cost for r in rp.policy_summary(kpis).collect()]
    assert costs == sorted(costs)
    delta = {r.category: r.cost_delta for r in rp.category_cost_delta(kpis).collect()}
    assert math.isclose(sum(delta.values()), by["ML_95"].total_cost - by["baseline_rolling_mean"].total_cost)
    assert None in delta
    grid = rp.sensitivity_policies(stock.SENSITIVITY_Z)
    levels = rp.service_sensitivity(rp.backtest(preds, actuals, prices, products, grid))
    assert {r.service_level for r in levels.collect()} == set(stock.SENSITIVITY_Z)
    kpis.unpersist()


def test_formulas(spark):
    row = spark.range(1).select(
        stock.safety_stock(F.lit(4.5355), 1.645, 7).alias("ss"),
        stock.reorder_point(F.lit(10.0), 7, F.lit(19.74)).alias("rop"),
        stock.economic_order_quantity(F.lit(10000.0), 50.0, 2.0).alias("eoq"),
        stock.economic_order_quantity(F.lit(0.0), 50.0, 2.0).alias("none"),
        stock.order_up_to(F.lit(80.0), 14, F.lit(10.0)).alias("level"),
    ).first()
    assert math.isclose(row.ss, 19.74, abs_tol=0.01) and math.isclose(row.rop, 89.74)
    assert math.isclose(row.eoq, math.sqrt(500000)) and row.none == 0.0 and row.level == 220.0
    for bad in (lambda: stock.safety_stock(F.lit(1.0), 1.0, 0), lambda: stock.economic_order_quantity(F.lit(1.0), -1.0, 1.0),
                lambda: stock.economic_order_quantity(F.lit(1.0), 1.0, 0.0), lambda: stock.order_up_to(F.lit(1.0), -1, F.lit(1.0))):
        with pytest.raises(ValueError):
            bad()


def test_error_std_is_population(spark):
    df = spark.createDataFrame([("s", "a", 0, 1.0, 0.0), ("s", "a", 1, 3.0, 0.0), ("s", "b", 0, 1.0, 0.0)], PREDS)
    assert sorted(rows(rp.error_std(df))) == [("s", "a", 1.0), ("s", "b", 0.0)]


def test_economics_fill_each_other(spark):
    prices = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 3.0), ("s", "b", None), ("s", "c", 5.0)], PRICES)
    products = spark.createDataFrame([("a", "x", 9.0), ("b", "y", 7.0)], "sku_id string, category string, base_price double")
    got = {r.sku_id: (r.unit_price, r.base_price, r.category) for r in rp.economics(prices, products).collect()}
    assert got == {"a": (2.0, 9.0, "x"), "b": (7.0, 7.0, "y"), "c": (5.0, 5.0, None)}


def test_window_and_history_are_parameters(spark):
    preds = spark.createDataFrame([("s", "a", day(100 + i), float(i), 1.0) for i in range(5)], PREDS)
    actuals = spark.createDataFrame([("s", "a", day(i), i % 13) for i in range(100)], ACTUALS)
    y = [float(i % 13) for i in range(100)] + [float(i) for i in range(5)]
    got = rp.demand_signals(preds, actuals, 7, window=35, season=14, history=10).orderBy("date").collect()
    ahead = [r for r in got if r.in_horizon]
    for i, r in enumerate(ahead):
        at = 100 + i
        assert math.isclose(r.rolling_mean, sum(y[at - 35 : at]) / 35) and r.seasonal_naive == y[at - 14]
    assert sum(r.in_history for r in got) == 10 and len(got) == 40
    series = rp.gather_series(rp.demand_signals(preds, actuals, 7, window=35, season=14, history=10)).first()
    assert math.isclose(series.mean_daily, sum(y[90:100]) / 10)
    with pytest.raises(ValueError, match="window"):
        rp.demand_signals(preds, actuals, 7, window=0)
