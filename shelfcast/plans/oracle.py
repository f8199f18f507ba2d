"""Equivalent SQL of the catalogue queries over the driver's tables.

Common table expressions are listed once with their dependencies; `query` puts the needed ones in
front of a body. `double` names the floating columns that both engines round to six digits.
"""

from __future__ import annotations

DAY = 86_400_000_000_000

CTE: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, text: str) -> None:
    CTE[name] = (needs, text)


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][0].split():
            add(need)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def rounded(column: str) -> str:
    """Six digits, in SQL that both engines read alike."""
    whole = f"floor({column} * cast(1e6 as double) + cast(4987e-4 as double))"
    return f"case when abs({column}) < cast(9e12 as double) then {whole} / cast(1e6 as double) else {column} end"


def query(needs: str, body: str, double: str = "") -> str:
    parts = [f"{n} as ({CTE[n][1]})" for n in _ordered(needs.split())]
    prefix = "with recursive " + ", ".join(parts) + " " if parts else ""
    if double:
        columns = ", ".join(f"{rounded(c)} as {c}" for c in double.split())
        body = f"select * replace ({columns}) from ({body}) result_rows"
    return prefix + body


def tier_sql(before: str, total: str) -> str:
    return (
        f"case when {before} * 10 < {total} * 2 then 'A_top20pct' "
        f"when {before} * 10 < {total} * 5 then 'B_middle30pct' else 'C_bottom50pct' end"
    )


cte(
    "base",
    "",
    """
select l_orderkey, l_linenumber,
  'store_' || lpad(cast(n_regionkey + 1 as varchar), 4, '0') as store_id,
  'sku_' || lpad(substring(p_brand, 7), 5, '0') as sku_id,
  cast(l_shipdate as date) as d, cast(l_quantity as bigint) as qty,
  cast(round(l_extendedprice * 100) as bigint) as cents,
  cast(round(l_discount * 100) as bigint) as disc_pct
from lineitem join supplier on l_suppkey = s_suppkey
join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey""",
)
cte(
    "sales",
    "base",
    f"""
select store_id, sku_id, cast(d - date '1970-01-01' as bigint) * {DAY} as date,
  cast(sum(qty) as bigint) as units_sold,
  cast(sum(cents * (100 - disc_pct)) as double) / cast(10000 as double) as revenue,
  cast(year(d) as int) as year, cast(month(d) as int) as month
from base group by store_id, sku_id, d""",
)
cte(
    "prices",
    "base",
    f"""
select store_id, sku_id, cast(w - date '1970-01-01' as bigint) * {DAY} as week_start,
  floor(cast(sum(cents) as double) / cast(sum(qty) as double)) / cast(100 as double) as price,
  sum(disc_pct) >= 6 * count(*) as is_promo, cast(year(w) as int) as year
from (select *, cast(date_trunc('week', d) as date) as w from base)
group by store_id, sku_id, w""",
)
cte(
    "stores",
    "",
    """
select 'store_' || lpad(cast(r_regionkey + 1 as varchar), 4, '0') as store_id, r_name as region,
  (select min(n_name) from nation where n_regionkey = r_regionkey) as state,
  case r_regionkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end as store_type,
  cast(r_regionkey as bigint) * 5000 + 10000 as sqft
from region""",
)
cte(
    "products",
    "",
    """
select 'sku_' || lpad(substring(p_brand, 7), 5, '0') as sku_id, arg_min(p_type, p_partkey) as category,
  arg_max(p_type, p_partkey) as subcategory,
  floor(avg(cast(round(p_retailprice * 100) as bigint))) / cast(100 as double) as base_price,
  min(p_size) < 2 as is_perishable, cast(min(p_size) as bigint) as pack_size
from part group by 1""",
)
cte(
    "calendar",
    "",
    f"""
select cast(d - date '1970-01-01' as bigint) * {DAY} as date, cast(isodow(d) - 1 as int) as dow,
  cast(week(d) as bigint) as week, cast(month(d) as int) as month,
  cast(quarter(d) as int) as quarter, cast(year(d) as int) as year, isodow(d) >= 6 as is_weekend,
  (month(d), day(d)) in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) as is_us_holiday
from (select cast(unnest(generate_series(min(l_shipdate), max(l_shipdate), interval 1 day)) as date) as d
  from lineitem)""",
)
cte(
    "dirty_sales",
    "base",
    f"""
select case when l_orderkey % 1000 = 7 then upper(store_id) else store_id end as store_id,
  case when l_orderkey % 900 <> 5 then sku_id end as sku_id,
  cast(d - date '1970-01-01' as bigint) * {DAY} as date,
  case when l_orderkey % 700 = 1 then 'n/a' when l_orderkey % 500 = 0 then cast(-qty - 1 as varchar)
    else cast(qty as varchar) end as units_sold,
  cast(cents * (100 - disc_pct) as double) / cast(10000 as double) as revenue,
  cast(year(d) as int) as year, cast(month(d) as int) as month, l_linenumber as ingested
from base, unnest(case when l_orderkey % 200 = 3 then [1, 2] else [1] end)""",
)
cte(
    "cast_sales",
    "dirty_sales",
    """
select store_id, sku_id, date, try_cast(units_sold as bigint) as units_sold, revenue, year, month,
  ingested from dirty_sales""",
)
cte(
    "valid_sales",
    "cast_sales",
    """
select * replace (lower(store_id) as store_id) from cast_sales
where sku_id is not null and units_sold is not null and units_sold >= 0""",
)
cte(
    "clean_sales",
    "valid_sales",
    """
select store_id, sku_id, date, units_sold, revenue, year, month from (
  select *, row_number() over (partition by store_id, sku_id, date
    order by ingested, units_sold, revenue) as nth from valid_sales) where nth = 1""",
)
cte(
    "dirty_prices",
    "prices",
    f"""
select case when mark % 90 = 7 then upper(store_id) else store_id end as store_id, sku_id,
  case when mark % 83 <> 1 then week_start end as week_start,
  case when mark % 11 <> 0 then price end as price, is_promo, year
from (select *, (week_start // {7 * DAY}) * 31 + cast(substring(sku_id, 5, 5) as int) * 7 as mark
  from prices), unnest(case when mark % 50 = 3 then [1, 2] else [1] end)""",
)
cte(
    "keyed_prices",
    "dirty_prices",
    "select * replace (lower(store_id) as store_id) from dirty_prices where week_start is not null",
)
cte(
    "filled_prices",
    "keyed_prices",
    """
select store_id, sku_id, week_start, is_promo, year, price is null as was_null,
  coalesce(price, last_value(price ignore nulls) over (partition by store_id, sku_id
    order by week_start, price nulls last rows between unbounded preceding and 1 preceding)) as price
from keyed_prices""",
)
cte(
    "clean_prices",
    "filled_prices",
    """
select store_id, sku_id, week_start, price, is_promo, year from (
  select *, row_number() over (partition by store_id, sku_id, week_start
    order by was_null, price, is_promo, year) as nth from filled_prices where price is not null)
where nth = 1""",
)
cte(
    "dirty_products",
    "",
    """
select 'sku_' || lpad(substring(p_brand, 7), 5, '0') as sku_id,
  case when p_partkey % 13 <> 0 then p_type end as category, p_name as subcategory,
  p_retailprice as base_price, p_size < 10 as is_perishable,
  case when p_partkey % 17 <> 0 then cast(p_size as bigint) end as pack_size
from part""",
)
cte(
    "clean_products",
    "dirty_products",
    """
select sku_id, category, subcategory, base_price, is_perishable, pack_size from (
  select *, row_number() over (partition by sku_id
    order by category, subcategory, base_price, is_perishable, pack_size) as nth
  from dirty_products where category is not null and pack_size is not null
    and subcategory is not null and base_price is not null) where nth = 1""",
)

_rolling = ",\n".join(
    f"avg(units_sold) over w{n} as rolling_mean_{n}, stddev_samp(units_sold) over w{n} as rolling_std_{n}, "
    f"avg(case when units_sold = 0 then 1.0::double else 0.0::double end) over w{n} as rolling_zero_rate_{n}"
    for n in (7, 14, 28, 91)
)
_lags = ", ".join(f"lag(units_sold, {n}) over w as lag_{n}_units" for n in (1, 7, 14, 28, 365))
_frames = ", ".join(
    f"w{n} as (partition by store_id, sku_id order by date rows between {n} preceding and 1 preceding)"
    for n in (7, 14, 28, 91)
)
cte(
    "history",
    "sales",
    f"""
select store_id, sku_id, date, units_sold, revenue, {_lags}, {_rolling},
  lag(units_sold, 365) over w as same_day_last_year_units,
  avg(units_sold) over wy as same_week_last_year_mean,
  case when avg(units_sold) over wy = 0 then null
    else lag(units_sold, 1) over w / avg(units_sold) over wy end as yoy_growth_ratio
from sales window w as (partition by store_id, sku_id order by date), {_frames},
  wy as (partition by store_id, sku_id order by date rows between 371 preceding and 365 preceding)""",
)
cte(
    "priced",
    "sales prices",
    f"""
select c.*, p4.price as price_4w_ago,
  case when p4.price <> 0 then current_price / p4.price end as price_ratio_4w,
  case when p4.price <> 0 then greatest(1 - current_price / p4.price, 0) end as discount_depth
from (
  select s.store_id, s.sku_id, s.date, p.week_start as price_week_start, p.price as current_price,
    p.is_promo as is_on_promo
  from sales s asof left join prices p on s.store_id = p.store_id and s.sku_id = p.sku_id
    and s.date >= p.week_start) c
left join prices p4 on c.store_id = p4.store_id and c.sku_id = p4.sku_id
  and c.price_week_start - p4.week_start = {28 * DAY}""",
)
cte(
    "promo",
    "priced",
    f"""
select store_id, sku_id, date,
  case when promoted then (date - min(date) over run) // {DAY} end as days_since_promo_start,
  case when promoted then (max(date) over run - date) // {DAY} end as days_until_promo_end,
  case when promoted then (date - min(date) over run) // {DAY} + 1 else 0 end as promo_streak_length
from (
  select *, row_number() over (partition by store_id, sku_id order by date)
    - row_number() over (partition by store_id, sku_id, promoted order by date) as island
  from (select store_id, sku_id, date, coalesce(is_on_promo, false) as promoted from priced))
window run as (partition by store_id, sku_id, promoted, island)""",
)
_turns = ", ".join(
    f"{fn}(2 * pi() * {value} / {period}) as {name}_{fn}"
    for name, value, period in (
        ("dow", "dow", "7.0::double"),
        ("month", "month", "12.0::double"),
        ("day_of_year", "doy", "365.0::double"),
    )
    for fn in ("sin", "cos")
)
cte(
    "calendar_features",
    "calendar",
    f"""
select date, dow, week, month, quarter, year, is_weekend, is_us_holiday, {_turns},
  (date - (select max(h.date) from calendar h where h.is_us_holiday
    and h.date between c.date - {370 * DAY} and c.date)) // {DAY} as days_since_last_holiday,
  ((select min(h.date) from calendar h where h.is_us_holiday
    and h.date between c.date and c.date + {370 * DAY}) - date) // {DAY} as days_to_next_holiday
from (select *, dayofyear(date '1970-01-01' + cast(date // {DAY} as int)) as doy from calendar) c""",
)
cte(
    "fold_days",
    "sales",
    "select date, row_number() over (order by date) as pos, count(*) over () as n "
    "from (select distinct date from sales)",
)


def folds(n: int, horizon: int) -> str:
    return f"""
select cast((pos - (n - {n * horizon}) - 1) // {horizon} as int) + 1 as fold_id,
  (select min(date) from fold_days) as train_start,
  (select max(date) from fold_days p where p.pos = min(f.pos) - 1) as train_end,
  min(date) as val_start, max(date) as val_end
from fold_days f where pos > n - {n * horizon} group by fold_id"""


cte("folds", "fold_days", folds(3, 60))
cte(
    "fallbacks",
    "sales folds",
    """
select fold_id, avg(units_sold) as fallback, count(*) as n_train_rows
from folds join sales on date between train_start and train_end group by fold_id""",
)
cte(
    "scored",
    "history folds fallbacks",
    """
select f.fold_id, h.store_id, h.sku_id, h.date, cast(units_sold as double) as y_true, m.model,
  coalesce(case m.model when 'naive' then lag_1_units when 'seasonal_naive' then lag_7_units
    else rolling_mean_28 end, fallback) as y_pred
from history h join folds f on h.date between f.val_start and f.val_end
join fallbacks b on b.fold_id = f.fold_id,
(values ('naive'), ('seasonal_naive'), ('moving_average')) m(model)""",
)
cte(
    "preds",
    "scored",
    "select store_id, sku_id, date, y_true, y_pred, fold_id from scored where model = 'moving_average'",
)

SCORES = """
coalesce(avg(abs(y_pred - y_true)), 0) as mae,
coalesce(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 0) as rmse,
coalesce(sum(abs(y_pred - y_true)) / greatest(sum(abs(y_true)), 1e-9), 0) as wape,
coalesce(avg(abs(y_pred - y_true) / greatest((abs(y_true) + abs(y_pred)) / 2, 1e-9)), 0) as smape,
coalesce(sum(y_pred - y_true) / greatest(sum(abs(y_true)), 1e-9), 0) as bias"""
REPORT = """
count(*) as n_rows, avg(y_true) as mean_actual, avg(abs(y_pred - y_true)) as mae,
sqrt(avg((y_pred - y_true) * (y_pred - y_true))) as rmse,
sum(abs(y_pred - y_true)) / greatest(sum(abs(y_true)), 1e-9) as wape,
avg(abs(y_pred - y_true) / greatest((abs(y_true) + abs(y_pred)) / 2, 1e-9)) as smape,
avg(y_pred - y_true) as bias"""
SCORE_NAMES = "mae rmse wape smape bias"
REPORT_NAMES = "mean_actual mae rmse wape smape bias"

cte(
    "volume",
    "sales",
    """
select store_id, sku_id, cast(sum(units_sold) as bigint) as total_units_sold
from sales group by store_id, sku_id""",
)
cte(
    "tiers",
    "volume",
    f"""
select store_id, sku_id, total_units_sold, total_units_sold / total as volume_share,
  upto / total as cumulative_volume_share,
  {tier_sql("(upto - total_units_sold)", "total")} as volume_tier
from (select *, sum(total_units_sold) over (order by total_units_sold desc, store_id, sku_id
    rows unbounded preceding) as upto, sum(total_units_sold) over () as total from volume)""",
)
cte(
    "dense",
    "sales prices calendar",
    """
select s.store_id, s.sku_id, c.date, coalesce(units_sold, 0) as units_sold,
  c.date - (c.dow * 86400000000000) as week_start
from (select distinct store_id, sku_id from prices) s cross join calendar c
left join sales on sales.store_id = s.store_id and sales.sku_id = s.sku_id and sales.date = c.date""",
)


def classes(source: str) -> str:
    return f"""
select *, case when adi < 1.32 and cv_squared < 0.49 then 'smooth' when adi < 1.32 then 'erratic'
  when cv_squared < 0.49 then 'intermittent' else 'lumpy' end as intermittency_class
from (
  select store_id, sku_id, count(*) as total_periods,
    count(*) filter (where units_sold > 0) as non_zero_periods,
    coalesce(count(*) / nullif(count(*) filter (where units_sold > 0), 0), 'infinity'::double) as adi,
    coalesce(var_pop(units_sold) filter (where units_sold > 0)
      / pow(avg(units_sold) filter (where units_sold > 0), 2), 'infinity'::double) as cv_squared
  from {source} group by store_id, sku_id)"""


cte("classes", "dense", classes("dense"))
cte(
    "promo_days",
    "preds prices",
    f"""
select p.*, coalesce(w.is_promo, false) as is_promo_day from (
  select *, date - ((date // {DAY} + 3) % 7) * {DAY} as week_start from preds) p
left join prices w on p.store_id = w.store_id and p.sku_id = w.sku_id and p.week_start = w.week_start""",
)
cte(
    "enriched",
    "promo_days products stores tiers classes",
    """
select p.*, category, subcategory, region, state, store_type, volume_tier, intermittency_class
from promo_days p left join products using (sku_id) left join stores using (store_id)
left join tiers using (store_id, sku_id) left join classes using (store_id, sku_id)""",
)
cte(
    "economics",
    "prices products",
    """
select store_id, sku_id, category, coalesce(unit_price, base_price) as unit_price,
  coalesce(base_price, unit_price) as base_price
from (select store_id, sku_id, median(price) as unit_price from prices group by 1, 2)
left join products using (sku_id)""",
)
cte(
    "signals",
    "preds sales",
    """
select *, coalesce(avg(y_true) over w7, 0) as rolling_mean,
  coalesce(lag(y_true, 7) over w, avg(y_true) over w7, 0) as seasonal_naive,
  avg(y_pred) over wl as ml
from (
  select store_id, sku_id, date, y_true, y_pred, true as in_horizon from preds
  union all
  select store_id, sku_id, date, cast(units_sold as double), null, false from (
    select *, row_number() over (partition by store_id, sku_id order by date desc) as newest
    from sales where date < (select min(date) from preds)) where newest <= 28)
window w as (partition by store_id, sku_id order by date),
  w7 as (partition by store_id, sku_id order by date rows between 7 preceding and 1 preceding),
  wl as (partition by store_id, sku_id order by date rows between current row and 6 following)""",
)
cte(
    "series",
    "signals economics",
    """
select g.*, cast(ceil(mean_daily * 14.0::double) as bigint) as initial_stock, category,
  coalesce(base_price, 1.0) * 0.25::double / 365.0::double as h_cost,
  coalesce(base_price, 1.0) * 0.30::double * 3.0::double as s_cost
from (
  select store_id, sku_id,
    coalesce(avg(y_true) filter (where not in_horizon), avg(y_true) filter (where in_horizon)) as mean_daily,
    coalesce(stddev_pop(y_true - y_pred) filter (where in_horizon), 0) as error_std,
    count(*) filter (where in_horizon) as n_days,
    sum(y_true) filter (where in_horizon) as total_demand
  from signals group by store_id, sku_id) g
left join economics using (store_id, sku_id) where n_days > 0""",
)
cte(
    "horizon",
    "signals",
    """
select *, row_number() over (partition by store_id, sku_id order by date) - 1 as day
from signals where in_horizon""",
)
STANDARD = (
    "('baseline_rolling_mean', 'rolling_mean', 0.0::double), "
    "('baseline_seasonal_naive', 'seasonal_naive', 0.0::double), "
    "('ML_95', 'ml', 1.645::double), ('ML_99', 'ml', 2.326::double)"
)
LEVELS = ", ".join(
    f"('ML_{k}', 'ml', {z}::double)"
    for k, z in (("85%", 1.036), ("90%", 1.282), ("95%", 1.645), ("97.5%", 1.960), ("99%", 2.326))
)


STANDARD_ORDER = """
case when kind <> 'ml' then greatest(0, cast(ceil(14.0::double * mean - position) as bigint))
  when position >= point then 0
  else greatest(0, cast(ceil(point + 14.0::double * mean - position) as bigint)) end"""


def simulation(policies: str, order: str = STANDARD_ORDER, name: str = "sim") -> str:
    """Day recursion for all series and policies at once, lead time 7."""
    return f"""
select store_id, sku_id, policy, kind, z, cast(-1 as bigint) as day, initial_stock as on_hand,
  cast(0 as bigint) as on_order, [cast(0 as bigint) for i in range(7)] as pipe,
  cast(0 as bigint) as received_qty, cast(0 as bigint) as served_units,
  cast(0 as bigint) as stockout_units, cast(0 as bigint) as reorder_qty
from series cross join (values {policies}) p(policy, kind, z)
union all
select store_id, sku_id, policy, kind, z, day, greatest(stock - demand, 0),
  on_order - received + qty, list_append(pipe[2:7], qty), received,
  least(stock, demand), greatest(demand - stock, 0), qty
from (
  select *, on_hand + pipe[1] as stock, pipe[1] as received,
    cast({order} as bigint) as qty
  from (
    select s.* exclude (day, received_qty, served_units, stockout_units, reorder_qty), h.day,
      greatest(0, cast(round_even(h.y_true, 0) as bigint)) as demand, on_hand + on_order as position,
      case kind when 'rolling_mean' then h.rolling_mean when 'seasonal_naive' then h.seasonal_naive
        else h.ml end as mean,
      (case kind when 'rolling_mean' then h.rolling_mean when 'seasonal_naive' then h.seasonal_naive
        else h.ml end) * 7.0::double + z * error_std * sqrt(7.0::double) as point
    from {name} s join horizon h on s.store_id = h.store_id and s.sku_id = h.sku_id and h.day = s.day + 1
    join series e on s.store_id = e.store_id and s.sku_id = e.sku_id))"""


KPIS = """
select store_id, sku_id, category, policy, held * h_cost as total_holding_cost,
  lost * s_cost as total_stockout_cost, held * h_cost + lost * s_cost as total_cost,
  case when total_demand = 0 then 1 else 1 - lost / total_demand end as service_level,
  total_demand / greatest(held / n_days, 1e-9) as inventory_turns,
  held / n_days / greatest(mean_daily, 1e-9) as avg_days_of_stock,
  held / n_days as avg_inventory, cast(lost as double) as stockout_units,
  cast(events as bigint) as num_stockout_events
from (
  select store_id, sku_id, policy, cast(sum(on_hand) as double) as held, cast(sum(stockout_units) as double) as lost,
    count(*) filter (where stockout_units > 0) as events
  from sim where day >= 0 group by 1, 2, 3) join series using (store_id, sku_id)"""
KPI_DOUBLES = (
    "total_holding_cost total_stockout_cost total_cost service_level inventory_turns "
    "avg_days_of_stock avg_inventory stockout_units"
)
cte("sim", "series horizon", simulation(STANDARD))
cte("kpis", "sim", KPIS)
cte("level_sim", "series horizon", simulation(LEVELS, name="level_sim"))
cte(
    "refill_sim",
    "series horizon",
    simulation("('refill', 'ml', 0.0::double)", "case when position < 40 then 60 else 0 end", "refill_sim"),
)
cte("level_kpis", "level_sim", KPIS.replace("from sim where", "from level_sim where"))
cte(
    "train_volume",
    "sales folds",
    """
select store_id, sku_id, cast(sum(units_sold) as bigint) as total_units_sold
from sales, folds where fold_id = 3 and date between train_start and train_end group by store_id, sku_id""",
)
cte(
    "bands",
    "train_volume",
    """
select store_id, sku_id, case when not (lo < q1 and q1 < q2 and q2 < hi) then 'medium'
  when v <= q1 then 'low' when v <= q2 then 'medium' else 'high' end as volume_tier
from (select *, cast(total_units_sold as double) as v from train_volume),
  (select min(total_units_sold) as lo, max(total_units_sold) as hi,
     quantile_cont(cast(total_units_sold as double), 1.0::double / 3) as q1,
     quantile_cont(cast(total_units_sold as double), 2.0::double / 3) as q2 from train_volume)""",
)
cte(
    "banded",
    "preds products stores bands",
    """
select p.*, category, store_type, volume_tier from preds p left join products using (sku_id)
left join stores using (store_id) left join bands using (store_id, sku_id) where fold_id = 3""",
)


def _log_part(column: str, limit: str) -> str:
    return (
        f"select * from (select '{column}' as segment, cast({column} as varchar) as value, {SCORES} "
        f"from banded where {column} is not null group by {column} "
        f"order by sum(y_true) desc, {column} {limit})"
    )


cte(
    "logged",
    "banded",
    " union all ".join(
        [
            _log_part("category", "limit 5"),
            _log_part("store_type", "limit 3"),
            _log_part("volume_tier", ""),
        ]
    ),
)
