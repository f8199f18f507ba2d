"""Named queries over the driver's tables, each with its oracle SQL where one exists.

Query functions take the retail frames derived from a table folder and return a DataFrame.
Doubles are rounded to six digits in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import errors, stock
from shelfcast.functions.dates import DAY_NS, week_start
from shelfcast.operators import (
    asof,
    audit,
    clean,
    evaluate,
    forecast,
    profile,
    quality,
    replenish,
    segments,
)
from shelfcast.operators import features as gold
from shelfcast.plans import experiments, oracle
from shelfcast.plans.medallion import Bronze, Gold, Silver
from shelfcast.plans.oracle import DAY, REPORT, REPORT_NAMES, SCORE_NAMES, SCORES
from shelfcast.session import freeze, saved, scratch_folder
from shelfcast.sources import nanos, raw
from shelfcast.sources.driver_tables import DriverTables
from shelfcast.sources.layers import Layer, check_load, scan_raw, stamp_load, with_year_month
from shelfcast.sources.schemas import SERIES, SERIES_DAY, TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

N_FOLDS, HORIZON, MIN_TRAIN = 3, 60, 365


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimal digits. The break lies off the midpoint: exact fractions such as k/128
    sit on the midpoint, where summation order alone would decide between the two neighbours.
    Values beyond 9e12 (whose sixth digit a double barely holds), infinities and NaN stay."""
    return df.selectExpr(*[f"{oracle.rounded(c)} as {c}" if t == "double" else c for c, t in df.dtypes])


_SETTLED: dict[tuple[str, str], DriverTables] = {}


def _settled(t: DriverTables) -> DriverTables:
    """The tables with their daily aggregate written, once a session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _SETTLED:
        _SETTLED[key] = t.settled()
    return _SETTLED[key]


def entry(
    name: str, needs: str = "", sql: str = "", double: str = "", text: str = "", settle: bool = False
):
    """Register a query; `sql` is the body over the named CTEs, `text` a complete statement.
    `settle` queries read sales or prices several times and get them from one written aggregate."""

    def wrap(build: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            t = DriverTables(spark, folder)
            return _rounded(build(_settled(t) if settle else t))

        QUERIES[name] = run
        if text:
            ORACLE[name] = text
        elif sql:
            ORACLE[name] = oracle.query(needs, sql, double)
        return build

    return wrap


# ---- shared frames ------------------------------------------------------------------------------


def history(t: DriverTables) -> DataFrame:
    return gold.add_demand_history(t.sales())


def master(t: DriverTables) -> DataFrame:
    return gold.features_master(t.sales(), t.prices(), t.calendar())


def scored(t: DriverTables) -> DataFrame:
    """Validation rows of three 60-date folds under all baselines."""
    labels = t.sales().withColumnRenamed("units_sold", "label_units_sold")
    days, folds = experiments.fold_context(labels, N_FOLDS, HORIZON, MIN_TRAIN)
    rows = history(t).withColumnRenamed("units_sold", "label_units_sold")
    return evaluate.score_baselines(rows.drop("year"), days, folds)


def preds(t: DriverTables) -> DataFrame:
    return scored(t).filter(F.col("model") == "moving_average").drop("model")


def forecast_table(t: DriverTables) -> DataFrame:
    """The forecasts as a written table, for readers that pass over them more than once."""
    return freeze(preds(t))


def dense(t: DriverTables) -> DataFrame:
    edges = F.struct(F.min("date").alias("first"), F.max("date").alias("last"))
    span = t.sales().agg(edges).scalar()
    spine = profile.panel_spine(t.prices(), span["first"], span["last"])
    return profile.dense_sales(spine, t.sales())


def enriched(t: DriverTables) -> DataFrame:
    return segments.enrich(preds(t), t.products(), t.stores(), t.sales(), t.prices(), dense(t))


def frames(t: DriverTables) -> dict[str, DataFrame]:
    return {
        "stores": t.stores(),
        "products": t.products(),
        "calendar": t.calendar(),
        "prices": t.prices(),
        "sales": t.sales(),
    }


def raw_zone(t: DriverTables, tables: tuple[str, ...] = TABLES) -> Layer:
    """The retail tables written as a raw zone in the shared scratch folder."""
    layer = Layer(t.spark, f"{scratch_folder(t.spark)}/raw")
    sources = frames(t)
    for table in tables:
        raw.write_raw(layer, sources[table], table)
    return layer


def sibling(layer: Layer, name: str) -> Layer:
    return Layer(layer.spark, f"{layer.root.rsplit('/', 1)[0]}/{name}", layer.fmt)


def check_schema(spark: SparkSession) -> None:
    """A schema of its own folder in the shared scratch space; the warehouse stays untouched."""
    spark.sql(f"create schema if not exists shelfcast_check location '{scratch_folder(spark)}/schema'")


# ---- sources and sinks --------------------------------------------------------------------------


@entry(
    "s01_schema_scan",
    "sales",
    "select store_id, year, month, count(*) as n, cast(sum(units_sold) as bigint) as units, "
    "sum(revenue) as revenue from sales group by store_id, year, month",
    "revenue",
)
def s01(t):
    zone = raw_zone(t, ("sales",))
    return scan_raw(t.spark, zone.root, "sales").groupBy("store_id", "year", "month").agg(
        F.count("*").alias("n"), F.sum("units_sold").alias("units"), F.sum("revenue").alias("revenue")
    )


@entry(
    "s02_epoch_ns",
    "sales",
    f"select store_id, min(date) as first_ns, max(date) as last_ns, count(distinct date // {DAY}) as days "
    "from sales group by store_id",
)
def s02(t):
    zone = raw_zone(t, ("sales",))
    return scan_raw(t.spark, zone.root, "sales").groupBy("store_id").agg(
        F.min("date").alias("first_ns"), F.max("date").alias("last_ns"), F.count_distinct("date").alias("days")
    )


@entry(
    "s02_physical_nanos",
    "sales",
    "select store_id, min(date + units_sold % 1000) as first_ns, max(date + units_sold % 1000) as last_ns, "
    "cast(sum(units_sold % 1000) as bigint) as below_microsecond, count(*) as n from sales group by store_id",
)
def s02_physical(t):
    """Files with timestamp[ns] columns whose values differ below the microsecond."""
    folder = f"{scratch_folder(t.spark)}/raw"
    dated = t.sales().withColumn("date", F.col("date") + F.col("units_sold") % 1000)
    nanos.write_nanos(dated, f"{folder}/sales", ["date"])
    return scan_raw(t.spark, folder, "sales").groupBy("store_id").agg(
        F.min("date").alias("first_ns"),
        F.max("date").alias("last_ns"),
        F.sum(F.col("date") % 1000).alias("below_microsecond"),
        F.count("*").alias("n"),
    )


@entry(
    "s03_load_lineage",
    text="select count(*) as n, count(*) as stamped, cast(1 as bigint) as runs, "
    "cast(1 as bigint) as files from lineitem",
)
def s03(t):
    stamped = stamp_load(t.table("lineitem").select("l_orderkey"), "run-1")
    return stamped.agg(
        F.count("*").alias("n"),
        F.count("_ingested_at").alias("stamped"),
        F.count_distinct("_ingest_run_id").alias("runs"),
        F.count_distinct("_source_path").alias("files"),
    )


@entry(
    "s04_static_overwrite",
    "sales",
    "select year, count(*) as n from sales where year >= 1998 group by year",
)
def s04(t):
    zone = raw_zone(t, ("sales",))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = t.spark.conf.get(mode)
    t.spark.conf.set(mode, "dynamic")
    try:
        later = t.sales().filter(F.col("year") >= 1998)
        zone.write(later, "sales", "overwrite", ["year", "month"])
    finally:
        t.spark.conf.set(mode, before)
    return zone.read("sales").groupBy("year").agg(F.count("*").alias("n"))


@entry("s05_external_table", "products", "select * from products", "base_price")
def s05(t):
    zone = raw_zone(t, ("products",))
    check_schema(t.spark)
    t.spark.sql("drop table if exists shelfcast_check.products")
    zone.register("shelfcast_check", "products")
    return t.spark.table("shelfcast_check.products")


@entry(
    "s05_partitioned_table",
    "sales",
    "select year, month, count(*) as n, cast(sum(units_sold) as bigint) as units from sales where year >= 1997 group by year, month",
    settle=True,
)
def s05_partitioned(t):
    """Sales by year and month as an external table; the last years' folders come after it was
    registered, and the read prunes the first ones."""
    zone = Layer(t.spark, f"{scratch_folder(t.spark)}/raw")
    early = F.col("year") < 1998
    zone.write(t.sales().filter(early), "sales", "overwrite", ["year", "month"])
    check_schema(t.spark)
    t.spark.sql("drop table if exists shelfcast_check.sales")
    zone.register("shelfcast_check", "sales")
    zone.write(t.sales().filter(~early), "sales", "append", ["year", "month"])
    zone.discover("shelfcast_check", "sales")
    late = t.spark.table("shelfcast_check.sales").filter(F.col("year") >= 1997)
    return late.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("units_sold").alias("units"))


@entry("s06_load_statistics", "prices", "select count(*) as rows_written from prices")
def s06(t):
    zone = raw_zone(t, ("prices",))
    bronze = Bronze(zone.root, sibling(zone, "bronze"))
    bronze.ingest("prices")
    second = bronze.ingest("prices", "append")
    loaded = bronze.layer.read("prices").filter(F.col("_ingest_run_id") == second["ingest_run_id"])
    return loaded.agg(F.count("*").alias("rows_written"))


_counts = " union all ".join(
    f"select '{name}' as table_name, count(*) as rows from {name}" for name in TABLES
)


@entry("s07_ingest_all", " ".join(TABLES), _counts, settle=True)
def s07(t):
    zone = raw_zone(t)
    bronze = Bronze(zone.root, sibling(zone, "bronze"))
    bronze.ingest_all()
    return raw.count_tables(bronze.layer, TABLES)


@entry(
    "s08_load_check",
    "prices",
    "select count(*) as rows, cast(1 as bigint) as distinct_ingest_run_ids, true as checks_passed from prices",
)
def s08(t):
    zone = raw_zone(t, ("prices",))
    bronze = Bronze(zone.root, sibling(zone, "bronze"))
    bronze.ingest("prices")
    return check_load(bronze.layer.read("prices")).drop("min_ingested_at", "max_ingested_at")


@entry(
    "s09_silver_lineage",
    "prices",
    "select year, count(*) as n, true as one_run, true as run_matches from prices group by year",
)
def s09(t):
    zone = raw_zone(t, ("prices",))
    bronze = Bronze(zone.root, sibling(zone, "bronze"))
    loaded = bronze.ingest("prices")
    silver = Silver(bronze.layer, sibling(zone, "silver"))
    silver.build("prices")
    return silver.layer.read("prices").groupBy("year").agg(
        F.count("*").alias("n"),
        (F.count_distinct("_silver_run_id") == 1).alias("one_run"),
        (F.min("_bronze_run_id") == loaded["ingest_run_id"]).alias("run_matches"),
    )


@entry("s10_silver_build", " ".join(TABLES), _counts, settle=True)
def s10(t):
    zone = raw_zone(t)
    bronze = Bronze(zone.root, sibling(zone, "bronze"))
    bronze.ingest_all()
    silver = Silver(bronze.layer, sibling(zone, "silver"))
    silver.build_all(check=True)
    return raw.count_tables(silver.layer, TABLES)


@entry(
    "s11_path_views",
    "sales prices",
    "select s.store_id, count(*) as n, count(p.price) as priced from sales s left join prices p "
    f"on s.store_id = p.store_id and s.sku_id = p.sku_id and p.week_start = s.date - ((s.date // {DAY} + 3) % 7) * {DAY} "
    "group by s.store_id",
)
def s11(t):
    zone = raw_zone(t, ("sales", "prices"))
    zone.views("silver", TABLES)
    return t.spark.sql(
        "select s.store_id, count(*) as n, count(p.price) as priced from silver_sales s "
        "left join silver_prices p on s.store_id = p.store_id and s.sku_id = p.sku_id "
        f"and p.week_start = s.date - pmod(s.date div {DAY_NS} + 3, 7) * {DAY_NS} group by s.store_id"
    )


_staged = "select {0}store_id, sku_id, date, units_sold, revenue, year, month from {1}"


@entry("s12_sql_template", "sales", _staged.format("", "sales"), "revenue")
def s12(t):
    zone = raw_zone(t, ("sales",))
    template = _staged.format("", "parquet.`{SILVER_ROOT}/sales`")
    layer = Gold(zone, sibling(zone, "gold"), {"stg_sales_daily": template})
    layer.build("stg_sales_daily")
    return layer.layer.read("stg_sales_daily").select(*SERIES_DAY, "units_sold", "revenue", "year", "month")


@entry(
    "s13_year_month",
    "sales",
    "select year, month, count(*) as n, cast(sum(units_sold) as bigint) as units from sales group by year, month",
)
def s13(t):
    dated = with_year_month(t.sales().drop("year", "month"))
    return dated.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("units_sold").alias("units"))


@entry(
    "s14_gold_build",
    "history priced promo",
    "select count(*) as n, count(lag_365_units) as lag_365, count(price_4w_ago) as price_4w, "
    "cast(sum(promo_streak_length) as bigint) as streaks, sum(rolling_mean_28) as mean_28 "
    "from history join priced using (store_id, sku_id, date) join promo using (store_id, sku_id, date)",
    "mean_28",
    settle=True,
)
def s14(t):
    zone = raw_zone(t)
    layer = Gold(zone, sibling(zone, "gold"))
    layer.build_all(check=True)
    return layer.layer.read("features_master").agg(
        F.count("*").alias("n"),
        F.count("lag_365_units").alias("lag_365"),
        F.count("price_4w_ago").alias("price_4w"),
        F.sum("promo_streak_length").alias("streaks"),
        F.sum("rolling_mean_28").alias("mean_28"),
    )


@entry(
    "s15_raw_write",
    "prices",
    "select year, 2 * count(*) as n, count(distinct week_start) as weeks from prices group by year",
)
def s15(t):
    zone = raw_zone(t, ("prices",))
    raw.write_raw(zone, t.prices(), "prices", "append")
    return zone.read("prices").groupBy("year").agg(
        F.count("*").alias("n"), F.count_distinct("week_start").alias("weeks")
    )


@entry("s16_manifest", " ".join(TABLES), _counts, settle=True)
def s16(t):
    zone = raw_zone(t)
    manifest = raw.write_manifest(zone, TABLES, {"folder": t.folder, "api_key": "x"})
    text = t.spark.read.text(manifest["manifest_uri"])
    kept = "struct<row_count:bigint,byte_size:bigint>"
    parsed = F.from_json("value", f"struct<tables:map<string,{kept}>>")
    rows = text.select(F.explode(parsed["tables"]).alias("table_name", "s"))
    return rows.filter(F.col("s.byte_size") > 0).select("table_name", F.col("s.row_count").alias("rows"))


@entry("s17_row_counts", " ".join(TABLES), _counts, settle=True)
def s17(t):
    return raw.count_tables(raw_zone(t), TABLES)


@entry(
    "s18_csv_source",
    "sales",
    f"select store_id, sku_id, date '1970-01-01' + cast(date // {DAY} as int) as day, units_sold, revenue from sales",
    "revenue",
)
def s18(t):
    path = f"{scratch_folder(t.spark)}/sales_csv"
    day = F.date_from_unix_date((F.col("date") / F.lit(DAY_NS)).cast("int")).alias("day")
    t.sales().select(*SERIES, day, "units_sold", "revenue").write.option("header", True).csv(path)
    return raw.read_csv(
        t.spark, path, "store_id string, sku_id string, day date, units_sold long, revenue double"
    )


@entry(
    "s19_report_sink",
    "enriched",
    f"select store_id, category, {REPORT} from enriched group by store_id, category",
    REPORT_NAMES,
    settle=True,
)
def s19(t):
    path = f"{scratch_folder(t.spark)}/segment_metrics_store_category"
    rows = preds(t).join(t.products().select("sku_id", "category"), "sku_id", "left")
    raw.write_report(segments.segment_report(rows, ["store_id", "category"], ordered=True), path)
    metrics = ", ".join(f"{m} double" for m in REPORT_NAMES.split())
    return raw.read_csv(t.spark, path, f"store_id string, category string, n_rows long, {metrics}")


_sample_sql = (
    "select least(1000, count(*)) as n, least(1000, count(*)) as distinct_keys, cast(0 as bigint) as not_in_table "
    "from sales"
)


def _sample_check(sales: DataFrame, sample: DataFrame) -> DataFrame:
    """Size, distinct keys and rows that do not occur in the table."""
    unknown = sample.join(sales.select(*SERIES_DAY, "units_sold"), [*SERIES_DAY, "units_sold"], "left_anti")
    return sample.agg(
        F.count("*").alias("n"),
        F.count_distinct(*SERIES_DAY).alias("distinct_keys"),
        unknown.agg(F.count("*")).scalar().alias("not_in_table"),
    )


@entry("s20_hash_sample", "sales", _sample_sql, settle=True)
def s20(t):
    return _sample_check(t.sales(), raw.hash_sample(t.sales(), SERIES_DAY, 1000))


@entry("s21_seeded_sample", "sales", _sample_sql, settle=True)
def s21(t):
    return _sample_check(t.sales(), raw.seeded_sample(t.sales(), SERIES_DAY, 1000))


# ---- Silver cleaning ----------------------------------------------------------------------------


@entry(
    "c01_typed_cast",
    "cast_sales",
    "select store_id, sku_id, date, units_sold, revenue, year, month from cast_sales",
    "revenue",
)
def c01(t):
    return clean.cast_business(t.dirty_sales(), "sales")


@entry(
    "c02_required_nulls",
    "cast_sales",
    "select store_id, sku_id, date, units_sold, revenue, year, month from cast_sales "
    "where sku_id is not null and units_sold is not null",
    "revenue",
)
def c02(t):
    cast = clean.cast_business(t.dirty_sales(), "sales")
    return clean.drop_required_nulls(cast, cast.columns)


@entry(
    "c03_duplicate_keys",
    "sales",
    "select store_id, sku_id, units_sold, revenue, year, month, date from sales",
    "revenue",
)
def c03(t):
    doubled = t.sales().withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return clean.drop_duplicate_keys(doubled, "sales")


@entry("c04_dimension_clean", "clean_products", "select * from clean_products", "base_price")
def c04(t):
    return clean.clean_dimension(t.dirty_products(), "products").frame


@entry(
    "c05_store_case",
    "dirty_sales",
    "select lower(store_id) as store_id, count(*) as n, count(distinct store_id) as spellings "
    "from dirty_sales group by lower(store_id)",
)
def c05(t):
    both = t.dirty_sales().select("store_id", F.lower("store_id").alias("low"))
    per_spelling = both.groupBy("low", "store_id").agg(F.count("*").alias("n"))
    return per_spelling.groupBy(F.col("low").alias("store_id")).agg(
        F.sum("n").alias("n"), F.count("*").alias("spellings")
    )


@entry("c06_price_carry_forward", "clean_prices", "select * from clean_prices", "price")
def c06(t):
    return clean.clean_prices(t.dirty_prices()).frame


_price_metrics = """
select (select count(*) from dirty_prices) as rows_in, (select count(*) from clean_prices) as rows_out,
  (select count(*) from filled_prices where price is not null) - (select count(*) from clean_prices)
    as dupes_dropped,
  (select count(*) from dirty_prices) - (select count(*) from filled_prices where price is not null)
    as nulls_dropped, cast(0 as bigint) as invalid_dropped,
  (select count(*) from filled_prices where was_null and price is not null) as imputations_applied"""


@entry("c07_imputation_count", "clean_prices", _price_metrics)
def c07(t):
    return clean.clean_prices(t.dirty_prices()).metrics


@entry(
    "c08_negative_units",
    "cast_sales valid_sales",
    "select store_id, sku_id, date, units_sold from valid_sales",
)
def c08(t):
    cast = clean.cast_business(t.dirty_sales(), "sales").withColumn("store_id", F.lower("store_id"))
    valid = clean.drop_required_nulls(cast, cast.columns).filter(F.col("units_sold") >= 0)
    return valid.select(*SERIES_DAY, "units_sold")


@entry("c09_earliest_load", "clean_sales", "select * from clean_sales", "revenue")
def c09(t):
    return clean.clean_sales(t.dirty_sales()).frame


_null_sales = "sku_id is null or units_sold is null"
_sales_metrics = f"""
select count(*) as rows_in, (select count(*) from clean_sales) as rows_out,
  count(*) filter (where not ({_null_sales}) and units_sold >= 0) - (select count(*) from clean_sales)
    as dupes_dropped,
  count(*) filter (where {_null_sales}) as nulls_dropped,
  count(*) filter (where not ({_null_sales}) and units_sold < 0) as invalid_dropped,
  cast(0 as bigint) as imputations_applied from cast_sales"""
_product_metrics = """
select count(*) as rows_in, (select count(*) from clean_products) as rows_out,
  count(*) filter (where category is not null and pack_size is not null)
    - (select count(*) from clean_products) as dupes_dropped,
  count(*) filter (where category is null or pack_size is null) as nulls_dropped,
  cast(0 as bigint) as invalid_dropped, cast(0 as bigint) as imputations_applied from dirty_products"""


@entry(
    "c10_cleaning_metrics",
    "clean_sales clean_products clean_prices cast_sales",
    f"select 'sales' as table_name, * from ({_sales_metrics}) a union all "
    f"select 'products', * from ({_product_metrics}) b union all select 'prices', * from ({_price_metrics}) c",
    settle=True,
)
def c10(t):
    parts = {
        "sales": clean.clean_sales(t.dirty_sales()),
        "products": clean.clean_dimension(t.dirty_products(), "products"),
        "prices": clean.clean_prices(t.dirty_prices()),
    }
    out = None
    for name, cleaned in parts.items():
        row = cleaned.metrics.select(F.lit(name).alias("table_name"), *clean.METRICS)
        out = row if out is None else out.unionByName(row)
    return out


# ---- data quality -------------------------------------------------------------------------------


@entry(
    "q01_no_nulls",
    "dirty_prices",
    "select count(*) = 0 as passed, count(*) as failures from dirty_prices "
    "where store_id is null or week_start is null or price is null",
)
def q01(t):
    return quality.no_nulls(t.dirty_prices(), ["store_id", "week_start", "price"])


@entry(
    "q02_unique",
    "dirty_sales",
    "select sum(n - 1) = 0 as passed, cast(sum(n - 1) as bigint) as failures from "
    "(select count(*) as n from dirty_sales group by store_id, sku_id, date)",
)
def q02(t):
    return quality.unique(t.dirty_sales(), SERIES_DAY)


@entry(
    "q03_references",
    "dirty_sales stores",
    "select count(*) = 0 as passed, count(*) as failures from (select distinct store_id from dirty_sales) c "
    "where not exists (select 1 from stores s where s.store_id = c.store_id)",
)
def q03(t):
    return quality.references(t.dirty_sales(), t.stores(), "store_id")


@entry(
    "q04_row_count",
    "sales",
    "select count(*) >= 1000 as passed, greatest(1000 - count(*), 0) as failures from sales",
)
def q04(t):
    return quality.min_rows(t.sales(), 1000)


@entry(
    "q05_suite",
    "sales prices stores products calendar",
    "select check_name, failures = 0 as passed, failures from ("
    + " union all ".join(
        [
            f"select '{t}_natural_key_no_nulls' as check_name, count(*) filter (where "
            + " or ".join(f"{k} is null" for k in keys)
            + f") as failures from {t} union all select '{t}_natural_key_unique', count(*) - count(distinct ("
            + ", ".join(keys)
            + f")) from {t}"
            for t, keys in quality.KEYS.items()
        ]
        + [
            f"select '{c}_{k}_in_{p}', count(distinct {k}) from {c} where {k} not in (select {k} from {p})"
            for c, k, p in quality.REFERENCES
        ]
    )
    + ") checks",
    settle=True,
)
def q05(t):
    return quality.suite(frames(t))


# ---- Gold features ------------------------------------------------------------------------------

_keys = "store_id, sku_id, date"
_rolling_names = " ".join(gold.ROLLING_COLUMNS)


@entry("g01_staged_sales", "sales", f"select {_keys}, units_sold, revenue, year, month from sales", "revenue")
def g01(t):
    return gold.staged_sales(t.sales())


@entry("g02_lags", "history", f"select {_keys}, {', '.join(gold.LAG_COLUMNS)} from history")
def g02(t):
    return gold.add_lags(t.sales()).select(*SERIES_DAY, *gold.LAG_COLUMNS)


@entry("g03_rolling", "history", f"select {_keys}, {', '.join(gold.ROLLING_COLUMNS)} from history", _rolling_names)
def g03(t):
    return gold.add_rolling(t.sales()).select(*SERIES_DAY, *gold.ROLLING_COLUMNS)


@entry(
    "g04_price_asof",
    "priced",
    f"select {_keys}, price_week_start, current_price, is_on_promo from priced",
    "current_price",
    settle=True,
)
def g04(t):
    values = {"price_week_start": "week_start", "current_price": "price", "is_on_promo": "is_promo"}
    return asof.asof_backward(t.sales().select(*SERIES_DAY), t.prices(), SERIES, "date", "week_start", values)


@entry(
    "g05_price_anchor",
    "priced",
    f"select {_keys}, price_4w_ago, price_ratio_4w, discount_depth from priced",
    "price_4w_ago price_ratio_4w discount_depth",
    settle=True,
)
def g05(t):
    priced = gold.add_prices(t.sales().select(*SERIES_DAY), t.prices())
    return priced.select(*SERIES_DAY, "price_4w_ago", "price_ratio_4w", "discount_depth")


@entry("g06_promo_islands", "promo", "select * from promo", settle=True)
def g06(t):
    priced = gold.add_prices(t.sales().select(*SERIES_DAY), t.prices())
    return gold.add_promo(priced).select(*SERIES_DAY, *gold.PROMO_COLUMNS)


@entry(
    "g07_holiday_distance",
    "calendar_features",
    "select date, is_us_holiday, days_since_last_holiday, days_to_next_holiday from calendar_features",
)
def g07(t):
    return gold.calendar_features(t.calendar()).select(
        "date", "is_us_holiday", "days_since_last_holiday", "days_to_next_holiday"
    )


_cycles = "dow_sin dow_cos month_sin month_cos day_of_year_sin day_of_year_cos"


@entry("g08_cyclic_calendar", "calendar_features", f"select date, {_cycles.replace(' ', ', ')} from calendar_features", _cycles)
def g08(t):
    return gold.calendar_features(t.calendar()).select("date", *_cycles.split())


@entry(
    "g09_seasonal",
    "history",
    f"select {_keys}, {', '.join(gold.SEASONAL_COLUMNS)} from history",
    "same_week_last_year_mean yoy_growth_ratio",
)
def g09(t):
    return gold.add_seasonal(t.sales()).select(*SERIES_DAY, *gold.SEASONAL_COLUMNS)


_master_sql = f"""
select {_keys}, units_sold as label_units_sold, revenue, {', '.join(gold.LAG_COLUMNS)},
  {', '.join(gold.ROLLING_COLUMNS)}, {', '.join(gold.PRICE_COLUMNS)}, {', '.join(gold.PROMO_COLUMNS)},
  {', '.join(gold.CALENDAR_COLUMNS)}, {', '.join(gold.SEASONAL_COLUMNS)}
from history join priced using ({_keys}) join promo using ({_keys})
left join calendar_features using (date)"""
oracle.cte("master", "history priced promo calendar_features", _master_sql)
oracle.cte(
    "held_master",
    "master folds",
    "select m.* from master m, folds f where fold_id = 3 and date between val_start and val_end",
)
oracle.cte(
    "recent_master",
    "held_master folds",
    "select m.* from master m, folds f where fold_id = 3 and date <= train_end "
    "and date >= train_end - (select max(date) - min(date) from held_master)",
)
_master_doubles = (
    f"revenue {_rolling_names} current_price price_4w_ago price_ratio_4w discount_depth {_cycles} "
    "same_week_last_year_mean yoy_growth_ratio"
)


@entry("g10_features_master", "history priced promo calendar_features", _master_sql, _master_doubles, settle=True)
def g10(t):
    return master(t)


#: The master table by feature family: narrow enough to be compared on any machine.
_families = {
    "demand": ["label_units_sold", "revenue", *gold.LAG_COLUMNS, *gold.SEASONAL_COLUMNS],
    "rolling": gold.ROLLING_COLUMNS,
    "prices": [*gold.PRICE_COLUMNS, *gold.PROMO_COLUMNS],
    "days": gold.CALENDAR_COLUMNS,
}


def _family(columns: list[str]):
    return lambda t: master(t).select(*SERIES_DAY, *columns)


for _name, _columns in _families.items():
    entry(
        f"g10_master_{_name}",
        "master",
        f"select {_keys}, {', '.join(_columns)} from master",
        " ".join(c for c in _master_doubles.split() if c in _columns),
        settle=True,
    )(_family(_columns))


_audited = [*gold.LAG_COLUMNS, *gold.ROLLING_COLUMNS, "current_price", "price_week_start"]


def _audit(t: DriverTables, rows: DataFrame, sample_size: int = 1000) -> DataFrame:
    return audit.audit_master(rows, t.sales(), gold.add_prices(t.sales().select(*SERIES_DAY), t.prices()), sample_size)


@entry(
    "g11_leakage_audit",
    "sales",
    "select feature, true as passes, least(1000, (select count(*) from sales)) as sample_size_checked, "
    "cast(0 as bigint) as mismatches from (values " + ", ".join(f"('{n}')" for n in _audited) + ") f(feature)",
    settle=True,
)
def g11(t):
    return _audit(t, written_master(t))


@entry(
    "g11_injected_leak",
    "history priced",
    "select feature, bad = 0 as passes, n as sample_size_checked, cast(bad as bigint) as mismatches from ("
    "select feature, (select count(*) from history) as n, case feature "
    "when 'lag_7_units' then (select count(*) from history where store_id = 'store_0003' and lag_7_units is distinct from units_sold) "
    "when 'current_price' then (select count(*) from priced where store_id = 'store_0002' and current_price is not null) "
    "else 0 end as bad from (values " + ", ".join(f"('{n}')" for n in _audited) + ") f(feature)) x",
    settle=True,
)
def g11_injected(t):
    """The audit of every row of a master in which one store's lag holds the label itself and
    another's prices are a cent too high."""
    lag = F.when(F.col("store_id") == "store_0003", F.col("label_units_sold")).otherwise(F.col("lag_7_units"))
    price = F.when(F.col("store_id") == "store_0002", F.col("current_price") + 0.01).otherwise(F.col("current_price"))
    leaky = written_master(t).withColumns({"lag_7_units": lag, "current_price": price})
    return _audit(t, leaky, sample_size=leaky.count())


# ---- forecasters --------------------------------------------------------------------------------


@entry("f01_fallback_mean", "sales", "select avg(units_sold) as global_mean from sales", "global_mean")
def f01(t):
    labelled = t.sales().withColumnRenamed("units_sold", "label_units_sold")
    return t.spark.range(1).select(forecast.fit_fallback(labelled).alias("global_mean"))


def _predict(t: DriverTables, name: str) -> DataFrame:
    fallback = t.sales().agg(F.avg("units_sold")).scalar()
    return forecast.predict(history(t), name, F.coalesce(fallback, F.lit(0.0)))


def _predict_sql(column: str) -> str:
    return (
        f"select {_keys}, coalesce(cast({column} as double), (select avg(units_sold) from sales)) as y_pred "
        "from history"
    )


@entry("f02_predict_frame", "history", _predict_sql("rolling_mean_7"), "y_pred", settle=True)
def f02(t):
    fallback = t.sales().agg(F.avg("units_sold")).scalar()
    return forecast.predict(history(t), "moving_average", fallback, window=7)


@entry("f03_naive", "history", _predict_sql("lag_1_units"), "y_pred", settle=True)
def f03(t):
    return _predict(t, "naive")


@entry("f04_seasonal_naive", "history", _predict_sql("lag_7_units"), "y_pred", settle=True)
def f04(t):
    return _predict(t, "seasonal_naive")


@entry("f05_moving_average", "history", _predict_sql("rolling_mean_28"), "y_pred", settle=True)
def f05(t):
    return _predict(t, "moving_average")


def _with_categories(t: DriverTables) -> DataFrame:
    rows = written_master(t).join(t.products().select("sku_id", "category"), "sku_id", "left")
    return rows.join(t.stores().select("store_id", "store_type"), "store_id", "left")


def _model_rows(t: DriverTables) -> DataFrame:
    """The master table with categories, written once: folds read it again."""
    return saved(_with_categories(t), "model-rows")


#: The learned run of a session and folder, written once; its queries read the same rows.
_LEARNED: dict[tuple[str, str], experiments.LearnedRun] = {}


def learned(t: DriverTables) -> experiments.LearnedRun:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _LEARNED:
        _LEARNED[key] = experiments.run_learned(_model_rows(t), n_folds=N_FOLDS, horizon=HORIZON, min_train=MIN_TRAIN)
    return _LEARNED[key]


@entry("f06_boosted_trees", settle=True)
def f06(t):
    """The trees' forecasts of the last fold."""
    rows = learned(t).scored.filter((F.col("model") == "boosted_trees") & (F.col("fold_id") == N_FOLDS))
    return rows.select(*SERIES_DAY, "y_true", "y_pred")


_deviance = "avg(case when y_true > 0 then y_true * ln(y_true / {0}) else 0 end - (y_true - {0}))"


@entry(
    "f06_boosted_facts",
    "scored folds",
    f"select {_keys}, y_true, true as known, true as better_than_train_mean from scored where model = 'naive' and fold_id = 3",
    "y_true",
    settle=True,
)
def f06_facts(t):
    """Each forecast's row, whether it is a number from zero on, and whether the trees' Poisson
    deviance lies below that of the training mean."""
    rows = f06(t)
    _, folds = experiments.fold_context(t.sales().withColumnRenamed("units_sold", "label_units_sold"), N_FOLDS, HORIZON, MIN_TRAIN)
    mean = evaluate.between_days(t.sales(), folds[-1].train_start, folds[-1].train_end).agg(F.avg("units_sold").alias("m"))
    scores = rows.withColumn("m", mean.scalar()).agg(
        (F.expr(_deviance.format("greatest(y_pred, 1e-9)")) < F.expr(_deviance.format("m"))).alias("better")
    )
    known = F.col("y_pred").isNotNull() & ~F.isnan("y_pred") & (F.col("y_pred") >= 0)
    return rows.select(*SERIES_DAY, "y_true", known.alias("known"), scores.scalar().alias("better_than_train_mean"))


# ---- evaluation ---------------------------------------------------------------------------------


def _one_score(name: str):
    column = dict(zip(errors.SCORES, (errors.mae, errors.rmse, errors.wape, errors.smape, errors.bias_ratio)))

    def build(t):
        return scored(t).groupBy("model").agg(column[name]().alias(name))

    return build


for _i, _name in enumerate(errors.SCORES, start=1):
    entry(
        f"e0{_i}_{_name}",
        "scored",
        f"select model, {_name} from (select model, {SCORES} from scored group by model)",
        _name,
        settle=True,
    )(_one_score(_name))


@entry("e06_all_scores", "preds", f"select {SCORES} from preds", SCORE_NAMES, settle=True)
def e06(t):
    return evaluate.score(preds(t))


@entry("e07_segment_scores", "preds", f"select store_id, {SCORES} from preds group by store_id", SCORE_NAMES, settle=True)
def e07(t):
    return evaluate.segment_scores(preds(t), ["store_id"])


@entry("e08_walk_forward_folds", "folds", "select * from folds")
def e08(t):
    return evaluate.walk_forward_folds(t.sales(), N_FOLDS, HORIZON, MIN_TRAIN)


@entry(
    "e09_last_days_holdout",
    "fold_days",
    f"select train_start, train_end, val_start, val_end from ({oracle.folds(1, 90)}) f",
)
def e09(t):
    return evaluate.last_days_holdout(t.sales(), 90)


@entry(
    "e10_fold_sides",
    "sales folds",
    "select fold_id, case when date >= val_start then 'val' else 'train' end as side, "
    f"{_keys}, units_sold from sales join folds on date between train_start and val_end",
    settle=True,
)
def e10(t):
    folds = evaluate.fold_list(evaluate.walk_forward_folds(t.sales(), N_FOLDS, HORIZON, MIN_TRAIN))
    return evaluate.label_folds(t.sales(), folds).select("fold_id", "side", *SERIES_DAY, "units_sold")


@entry("e11_actuals_join", "preds", f"select {_keys}, y_true, y_pred from preds", "y_true y_pred", settle=True)
def e11(t):
    actuals = t.sales().withColumnRenamed("units_sold", "label_units_sold")
    return evaluate.with_actuals(actuals, preds(t))


@entry(
    "e12_top_segments",
    "preds",
    f"select sku_id, sum(y_true) as total_actual, {SCORES} from preds group by sku_id "
    "order by total_actual desc, sku_id limit 5",
    "total_actual " + SCORE_NAMES,
    settle=True,
)
def e12(t):
    return evaluate.top_segment_scores(preds(t), "sku_id")


_per_fold_sql = f"select model, fold_id, {SCORES}, count(*) as n_val_rows from scored group by model, fold_id"


def per_fold(t: DriverTables) -> DataFrame:
    rows = scored(t).groupBy("model", "fold_id")
    return rows.agg(*errors.score_columns(), F.count("*").alias("n_val_rows"))


@entry("e13_baseline_folds", "scored", _per_fold_sql, SCORE_NAMES, settle=True)
def e13(t):
    return per_fold(t)


_means = ", ".join(f"avg({s}) as {s}" for s in SCORE_NAMES.split())


@entry("e13_baseline_comparison", "scored", f"select model, {_means} from ({_per_fold_sql}) p group by model", SCORE_NAMES, settle=True)
def e13b(t):
    return evaluate.mean_over_folds(per_fold(t))


@entry("e14_learned_folds", settle=True)
def e14(t):
    return learned(t).per_fold


@entry(
    "e14_learned_facts",
    "scored",
    "select m.model, fold_id, count(*) as n_val_rows, sum(y_true) as total_actual, cast(0 as bigint) as bad_forecasts, "
    "cast(0 as bigint) as repeated_keys, true as scores_agree, true as shares_sum_to_one "
    "from scored s, (values ('boosted_trees'), ('poisson')) m(model) where s.model = 'naive' group by m.model, fold_id",
    "total_actual",
    settle=True,
)
def e14_facts(t):
    """What can be known of learned forecasts without the models: rows, keys, actuals, no negative
    value; the per-fold scores follow from the rows, importances are shares."""
    run = learned(t)
    bad = F.col("y_pred").isNull() | F.isnan("y_pred") | (F.col("y_pred") < 0)
    facts = run.scored.groupBy("model", "fold_id").agg(
        F.count("*").alias("n_val_rows"),
        F.sum("y_true").alias("total_actual"),
        F.sum(bad.cast("long")).alias("bad_forecasts"),
        (F.count("*") - F.count_distinct(*SERIES_DAY)).alias("repeated_keys"),
        (F.sum(F.abs(F.col("y_pred") - F.col("y_true"))) / F.sum("y_true")).alias("own_wape"),
    )
    gains = F.aggregate(F.transform("importances", lambda x: x["gain"]), F.lit(0.0), lambda a, x: a + x)
    whole = F.when(F.col("model") == "boosted_trees", F.abs(gains - 1) < 1e-9).otherwise(F.col("importances").isNull())
    joined = facts.join(run.per_fold.select("model", "fold_id", "wape", whole.alias("shares_sum_to_one")), ["model", "fold_id"])
    agree = F.abs(F.col("wape") - F.col("own_wape")) < 1e-9
    return joined.withColumn("scores_agree", agree).drop("wape", "own_wape")


@entry("e15_learned_comparison", settle=True)
def e15_learned(t):
    """Learned models and baselines side by side."""
    names = ["model", "fold_id", *errors.SCORES]
    return evaluate.compare_models(learned(t).per_fold.select(*names).unionByName(per_fold(t).select(*names)))


@entry(
    "e15_model_comparison",
    "scored",
    f"select *, (0.65::double - wape) / 0.65::double as delta_wape_vs_baseline, "
    f"cast(dense_rank() over (order by wape) as int) as rank "
    f"from (select model, {_means} from ({_per_fold_sql}) p group by model)",
    SCORE_NAMES + " delta_wape_vs_baseline",
    settle=True,
)
def e15(t):
    return evaluate.compare_models(per_fold(t))


_draw = "(((x * x) % 2147483647) * ((x * x) % 2147483647) % 2147483647) * x % 2147483647"
_weight = " + ".join(f"cast({_draw} >= {step} as int)" for step in evaluate.poisson_steps())


@entry(
    "e16_bootstrap",
    "scored",
    "select avg(d) as mean_diff, quantile_cont(d, 0.025) as ci_lower_95, quantile_cont(d, 0.975) as ci_upper_95, "
    "avg(case when d >= 0 then 1.0::double else 0.0::double end) as p_value_a_better_than_b from ("
    "select (sum(w * abs(a - y)) - sum(w * abs(b - y))) / greatest(sum(w * abs(y)), 1e-9) as d from ("
    f"select rep, y, a, b, {_weight} as w from (select rep, y, a, b, "
    "(cast('0x' || substr(h, 1, 7) as bigint) + rep * (cast('0x' || substr(h, 8, 7) as bigint) + 1)) % 2147483647 as x "
    "from (select md5(concat_ws('|', '42', store_id, sku_id, date)) as h, max(y_true) as y, "
    "max(case when model = 'moving_average' then y_pred end) as a, max(case when model = 'naive' then y_pred end) as b "
    "from scored group by store_id, sku_id, date), (select unnest(range(1, 1001)) as rep) r)) group by rep)",
    "mean_diff ci_lower_95 ci_upper_95 p_value_a_better_than_b",
    settle=True,
)
def e16(t):
    pair = scored(t).groupBy(*SERIES_DAY).agg(
        F.max("y_true").alias("y_true"),
        F.max(F.when(F.col("model") == "moving_average", F.col("y_pred"))).alias("a"),
        F.max(F.when(F.col("model") == "naive", F.col("y_pred"))).alias("b"),
    )
    return evaluate.bootstrap_wape_difference(pair, SERIES_DAY, "a", "b")


# ---- guards and model frame ---------------------------------------------------------------------


_features = [*SERIES, *gold.LAG_COLUMNS, *gold.ROLLING_COLUMNS, *gold.PRICE_COLUMNS, *gold.PROMO_COLUMNS]
_features += [c for c in gold.CALENDAR_COLUMNS if c not in audit.NOT_FEATURES] + gold.SEASONAL_COLUMNS
_flags = ["is_on_promo", "is_weekend", "is_us_holiday"]
_numeric = [c for c in _features if c not in [*SERIES, *_flags]]


_MASTERS: dict[tuple[str, str], Layer] = {}


def written_master(t: DriverTables) -> DataFrame:
    """The master table of a session and folder, written once."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _MASTERS:
        zone = Layer(t.spark, f"{scratch_folder(t.spark)}/gold")
        zone.write(master(t), "features_master", "overwrite", ["year", "month"])
        _MASTERS[key] = zone
    return _MASTERS[key].read("features_master")


def _per_feature(names: list[str], source: str, **fields: str) -> str:
    """One row per feature from one pass; each field is an aggregate with {0} for the column."""
    cells = ", ".join(f"{e.format(c)} as {f}_{c}" for f, e in fields.items() for c in names)
    items = ", ".join(
        "{'feature': '" + c + "', " + ", ".join(f"'{f}': {f}_{c}" for f in fields) + "}" for c in names
    )
    return f"select r.* from (select unnest([{items}]) as r from (select {cells} from {source}) wide) listed"


@entry(
    "l01_feature_columns",
    "master",
    "select feature, feature in ('store_id', 'sku_id') as is_categorical, present from ("
    + _per_feature(_features, "master", present="count({0})")
    + ") p",
    settle=True,
)
def l01(t):
    return audit.feature_summary(written_master(t))


@entry(
    "l02_label_correlation",
    "master",
    _per_feature(
        _numeric,
        "master",
        correlation="case when min({0}) < max({0}) then corr({0}, label_units_sold) end",
    ),
    "correlation",
    settle=True,
)
def l02(t):
    rows = master(t)
    return audit.label_correlations(rows, audit.feature_columns(rows)[0])


_null_rate = "avg(case when {0} is null then 1.0::double else 0.0::double end)"


@entry(
    "l03_fold_null_rates",
    "held_master recent_master",
    "select feature, t.rate as train_null_rate, v.rate as val_null_rate, t.rate - v.rate > 0.05 as suspicious, "
    "(select max(date) from recent_master) >= (select min(date) from held_master) as dates_overlap from ("
    + _per_feature(_features, "recent_master", rate=_null_rate)
    + ") t join ("
    + _per_feature(_features, "held_master", rate=_null_rate)
    + ") v using (feature)",
    "train_null_rate val_null_rate",
    settle=True,
)
def l03(t):
    folds = evaluate.fold_list(evaluate.walk_forward_folds(t.sales(), N_FOLDS, HORIZON, MIN_TRAIN))
    rows = freeze(master(t))
    train = evaluate.between_days(rows, folds[2].train_start, folds[2].train_end)
    val = evaluate.between_days(rows, folds[2].val_start, folds[2].val_end)
    return audit.fold_null_rates(train, val, audit.feature_columns(rows)[0])


@entry(
    "l04_model_frame",
    "master products stores",
    f"select m.* replace (timestamp '1970-01-01' + to_days(cast(date // {DAY} as int)) as date, "
    + ", ".join(f"cast({c} as double) as {c}" for c in _flags)
    + "), category, store_type from master m left join products using (sku_id) left join stores using (store_id)",
    _master_doubles + " " + " ".join(_flags),
    settle=True,
)
def l04(t):
    return audit.model_frame(_with_categories(t))


@entry(
    "l04_frame_types",
    "master products stores",
    f"select {_keys.replace(', date', '')}, timestamp '1970-01-01' + to_days(cast(date // {DAY} as int)) as date, "
    + ", ".join(f"cast({c} as double) as {c}" for c in _flags)
    + ", label_units_sold, category, store_type from master left join products using (sku_id) left join stores using (store_id)",
    " ".join(_flags),
    settle=True,
)
def l04_types(t):
    """The columns whose types the model frame changes or asks for."""
    frame = audit.model_frame(_with_categories(t))
    return frame.select(*SERIES, "date", *_flags, "label_units_sold", "category", "store_type")


def _last_train(t: DriverTables) -> DataFrame:
    """The labels that the last fold trains on."""
    folds = evaluate.fold_list(evaluate.walk_forward_folds(t.sales(), N_FOLDS, HORIZON, MIN_TRAIN))
    train = evaluate.between_days(t.sales(), folds[-1].train_start, folds[-1].train_end)
    return train.withColumnRenamed("units_sold", "label_units_sold")


@entry("l05_volume_bands", "bands", "select * from bands", settle=True)
def l05(t):
    return segments.train_volume_tiers(_last_train(t))


@entry(
    "l06_segment_log",
    "logged",
    " union all ".join(
        f"select segment, value, '{m}' as metric, {m} as score from logged" for m in errors.SCORES
    ),
    "score",
    settle=True,
)
def l06(t):
    last = preds(t).filter(F.col("fold_id") == N_FOLDS)
    rows = last.join(t.products().select("sku_id", "category"), "sku_id", "left")
    rows = rows.join(t.stores().select("store_id", "store_type"), "store_id", "left")
    return segments.segment_metric_log(rows, _last_train(t))


@entry(
    "l06_learned_segments",
    "scored products stores folds sales",
    "select m.model, x.fold_id, x.segment, x.value, cast(5 as bigint) as metrics, true as all_known from ("
    + " union all ".join(
        f"select fold_id, '{c}' as segment, value from (select fold_id, value, row_number() over (partition by fold_id "
        f"order by total desc, value) as nth from (select fold_id, cast({c} as varchar) as value, sum(y_true) as total from "
        f"(select * from scored where model = 'naive') s left join products using (sku_id) left join stores using (store_id) "
        f"where {c} is not null group by fold_id, {c})) where nth <= {n}"
        for c, n in (("category", 5), ("store_type", 3))
    )
    + ") x, (values ('boosted_trees'), ('poisson')) m(model)",
    settle=True,
)
def l06_learned(t):
    """Which categories and store types each fold's log of the learned run holds, with all metrics."""
    log = learned(t).segments.filter(F.col("segment") != "volume_tier")
    return log.groupBy("model", "fold_id", "segment", "value").agg(
        F.count_distinct("metric").alias("metrics"),
        F.min(F.col("score").isNotNull() & ~F.isnan("score")).alias("all_known"),
    )


@entry(
    "l06_learned_tiers",
    "scored",
    "select m.model, fold_id, sum(y_true) as total_actual, true as weighted_mae_agrees from scored s, "
    "(values ('boosted_trees'), ('poisson')) m(model) where s.model = 'naive' group by m.model, fold_id",
    "total_actual",
    settle=True,
)
def l06_tiers(t):
    """The volume tiers of each fold cover its rows: their mean absolute errors, weighted by rows,
    give the fold's."""
    run = learned(t)
    tiers = None
    rows = run.scored
    _, folds = experiments.fold_context(t.sales().withColumnRenamed("units_sold", "label_units_sold"), N_FOLDS, HORIZON, MIN_TRAIN)
    for fold in folds:
        train = evaluate.between_days(t.sales(), fold.train_start, fold.train_end)
        own = segments.train_volume_tiers(train, "units_sold").withColumn("fold_id", F.lit(fold.fold_id))
        tiers = own if tiers is None else tiers.unionByName(own)
    sizes = rows.join(tiers, [*SERIES, "fold_id"]).groupBy("model", "fold_id", F.col("volume_tier").alias("value")).agg(
        F.count("*").alias("n"), F.sum("y_true").alias("total"), F.sum(F.abs(F.col("y_pred") - F.col("y_true"))).alias("error")
    )
    log = run.segments.filter("segment = 'volume_tier' and metric = 'mae'").drop("segment", "metric")
    known = rows.join(tiers, [*SERIES, "fold_id"], "left_anti").groupBy("model", "fold_id").agg(F.sum("y_true").alias("rest"))
    met = sizes.join(log, ["model", "fold_id", "value"]).groupBy("model", "fold_id").agg(
        F.sum("total").alias("inside"),
        (F.abs(F.sum(F.col("score") * F.col("n")) - F.sum("error")) < 1e-6 * F.sum("n")).alias("weighted_mae_agrees"),
    )
    whole = F.col("inside") + F.coalesce("rest", F.lit(0.0))
    return met.join(known, ["model", "fold_id"], "left").select("model", "fold_id", whole.alias("total_actual"), "weighted_mae_agrees")


# ---- segments -----------------------------------------------------------------------------------


@entry("a01_volume_tier", "tiers", "select * from tiers", "volume_share cumulative_volume_share")
def a01(t):
    return segments.volume_tiers(t.sales())


@entry("a02_intermittency", "classes", "select * from classes", "adi cv_squared", settle=True)
def a02(t):
    return segments.intermittency_classes(dense(t))


@entry(
    "a03_week_start",
    "sales",
    f"select {_keys}, cast(cast(date_trunc('week', date '1970-01-01' + cast(date // {DAY} as int)) as date) "
    f"- date '1970-01-01' as bigint) * {DAY} as week_start from sales",
)
def a03(t):
    return t.sales().select(*SERIES_DAY, week_start("date").alias("week_start"))


@entry("a04_promo_day", "promo_days", f"select {_keys}, week_start, is_promo_day from promo_days", settle=True)
def a04(t):
    return segments.with_promo_day(preds(t), t.prices()).select(*SERIES_DAY, "week_start", "is_promo_day")


@entry("a05_segment_report", "preds", f"select store_id, sku_id, {REPORT} from preds group by store_id, sku_id", REPORT_NAMES, settle=True)
def a05(t):
    return segments.segment_report(preds(t), SERIES)


@entry(
    "a06_bias_flags",
    "preds",
    "select *, case when bias_ratio > 0 then 'over' else 'under' end as bias_direction from ("
    "select *, bias / abs(mean_actual) as bias_ratio from ("
    f"select store_id, sku_id, {REPORT} from preds group by store_id, sku_id) r where abs(mean_actual) > 1e-9) f "
    "where abs(bias_ratio) > 0.10",
    REPORT_NAMES + " bias_ratio",
    settle=True,
)
def a06(t):
    return segments.bias_flags(segments.segment_report(preds(t), SERIES))


_ranked = (
    "select store_id, sku_id, category, sum(abs(y_pred - y_true)) / greatest(sum(abs(y_true)), 1e-9) as wape, "
    "count(*) as n_days from preds left join products using (sku_id) "
    "group by store_id, sku_id, category having sum(y_true) >= 10"
)


@entry(
    "a07_best_and_worst",
    "preds products",
    f"select 'best' as side, * from (select * from ({_ranked}) order by wape, store_id, sku_id limit 20) union all "
    f"select 'worst', * from (select * from ({_ranked}) order by wape desc, store_id, sku_id limit 20)",
    "wape",
    settle=True,
)
def a07(t):
    rows = preds(t).join(t.products().select("sku_id", "category"), "sku_id", "left")
    best, worst = segments.best_and_worst(rows)
    return best.select(F.lit("best").alias("side"), "*").unionByName(worst.select(F.lit("worst").alias("side"), "*"))


_enriched_columns = (
    "fold_id, store_id, sku_id, date, y_true, y_pred, category, subcategory, region, state, store_type, "
    "volume_tier, intermittency_class, week_start, is_promo_day"
)


@entry("a08_enriched", "enriched", f"select {_enriched_columns} from enriched", "y_true y_pred", settle=True)
def a08(t):
    return enriched(t).select(*_enriched_columns.split(", "))


def _report_sql(name: str, by: list[str], tail: str = "") -> str:
    columns = ["category", "store_id", "volume_tier", "is_promo_day", "intermittency_class"]
    types = {"is_promo_day": "boolean"}
    picked = ", ".join(c if c in by else f"cast(null as {types.get(c, 'varchar')}) as {c}" for c in columns)
    return f"select * from (select '{name}' as report, {picked}, {REPORT} from enriched group by {', '.join(by)} {tail})"


@entry(
    "a09_report_set",
    "enriched",
    " union all ".join(
        _report_sql(n, by, "order by sum(y_true) desc, category limit 10" if n == "category" else "")
        for n, by in segments.REPORT_SETS.items()
    ),
    REPORT_NAMES,
    settle=True,
)
def a09(t):
    return segments.report_set(enriched(t))


@entry(
    "a10_heatmap",
    "preds products stores",
    "select category, "
    + ", ".join(
        f"sum(abs(y_pred - y_true)) filter (where store_type = '{k}') "
        f"/ greatest(sum(abs(y_true)) filter (where store_type = '{k}'), 1e-9) as {k}"
        for k in "ABC"
    )
    + " from preds left join products using (sku_id) left join stores using (store_id) group by category",
    "A B C",
    settle=True,
)
def a10(t):
    rows = preds(t).join(t.products().select("sku_id", "category"), "sku_id", "left")
    rows = rows.join(t.stores().select("store_id", "store_type"), "store_id", "left")
    report = segments.segment_report(rows, ["category", "store_type"])
    return segments.heatmap(report, "store_type", "category")


# ---- inventory ----------------------------------------------------------------------------------


@entry(
    "i01_error_std",
    "preds",
    "select store_id, sku_id, coalesce(stddev_pop(y_true - y_pred), 0) as forecast_error_std from preds group by 1, 2",
    "forecast_error_std",
    settle=True,
)
def i01(t):
    return replenish.error_std(preds(t))


@entry("i02_economics", "economics", "select * from economics", "unit_price base_price")
def i02(t):
    return replenish.economics(t.prices(), t.products())


def _demand_stats(t: DriverTables) -> DataFrame:
    spread = F.stddev_pop(F.col("y_true") - F.col("y_pred")).alias("sd")
    return preds(t).groupBy(*SERIES).agg(F.avg("y_true").alias("mean"), spread)


_stats_sql = (
    "select store_id, sku_id, avg(y_true) as mean, stddev_pop(y_true - y_pred) as sd from preds group by 1, 2"
)


@entry(
    "i03_safety_stock",
    "preds",
    f"select store_id, sku_id, 1.645::double * sd * sqrt(7.0::double) as safety_stock from ({_stats_sql}) s",
    "safety_stock",
    settle=True,
)
def i03(t):
    return _demand_stats(t).select(*SERIES, stock.safety_stock(F.col("sd"), 1.645, 7).alias("safety_stock"))


@entry(
    "i04_reorder_point",
    "preds",
    f"select store_id, sku_id, mean * 7 + 1.645::double * sd * sqrt(7.0::double) as reorder_point from ({_stats_sql}) s",
    "reorder_point",
    settle=True,
)
def i04(t):
    safety = stock.safety_stock(F.col("sd"), 1.645, 7)
    return _demand_stats(t).select(*SERIES, stock.reorder_point(F.col("mean"), 7, safety).alias("reorder_point"))


@entry(
    "i05_order_quantity",
    "preds economics",
    "select store_id, sku_id, case when mean <= 0 then 0 else sqrt(2.0::double * (mean * 365) * 50 / (base_price * 0.25)) end "
    f"as eoq from ({_stats_sql}) s join economics using (store_id, sku_id)",
    "eoq",
    settle=True,
)
def i05(t):
    priced = _demand_stats(t).join(replenish.economics(t.prices(), t.products()), SERIES)
    annual, holding = F.col("mean") * 365, F.col("base_price") * 0.25
    return priced.select(*SERIES, stock.economic_order_quantity(annual, 50.0, holding).alias("eoq"))


@entry(
    "i06_order_up_to",
    "preds",
    "select store_id, sku_id, mean * 7 + 1.645::double * sd * sqrt(7.0::double) + 14 * mean as level "
    f"from ({_stats_sql}) s",
    "level",
    settle=True,
)
def i06(t):
    point = stock.reorder_point(F.col("mean"), 7, stock.safety_stock(F.col("sd"), 1.645, 7))
    return _demand_stats(t).select(*SERIES, stock.order_up_to(point, 14, F.col("mean")).alias("level"))


def _positions(t: DriverTables) -> DataFrame:
    return replenish.opening_positions(forecast_table(t), t.sales(), t.prices(), t.products())


@entry(
    "i07_opening_position",
    "series",
    "select store_id, sku_id, mean_daily, error_std, initial_stock from series",
    "mean_daily error_std",
    settle=True,
)
def i07(t):
    signals = replenish.demand_signals(forecast_table(t), t.sales())
    return replenish.gather_series(signals).select(*SERIES, "mean_daily", "error_std", "initial_stock")


@entry("i08_cost_rates", "series", "select store_id, sku_id, category, h_cost, s_cost from series", "h_cost s_cost", settle=True)
def i08(t):
    return _positions(t).select(*SERIES, "category", "h_cost", "s_cost")


@entry(
    "i09_demand_signals",
    "signals",
    f"select {_keys}, y_true, rolling_mean, seasonal_naive, ml from signals where in_horizon",
    "y_true rolling_mean seasonal_naive ml",
    settle=True,
)
def i09(t):
    rows = replenish.demand_signals(forecast_table(t), t.sales()).filter("in_horizon")
    return rows.select(*SERIES_DAY, "y_true", "rolling_mean", "seasonal_naive", "ml")


@entry(
    "i09_wide_window",
    "preds sales",
    f"select {_keys}, rolling_mean, seasonal_naive from (select *, coalesce(avg(y_true) over w35, 0) as rolling_mean, "
    "coalesce(lag(y_true, 14) over w, avg(y_true) over w35, 0) as seasonal_naive from ("
    "select store_id, sku_id, date, y_true, true as in_horizon from preds union all "
    "select store_id, sku_id, date, cast(units_sold as double), false from ("
    "select *, row_number() over (partition by store_id, sku_id order by date desc) as newest "
    "from sales where date < (select min(date) from preds)) where newest <= 35) "
    "window w as (partition by store_id, sku_id order by date), "
    "w35 as (partition by store_id, sku_id order by date rows between 35 preceding and 1 preceding)) where in_horizon",
    "rolling_mean seasonal_naive",
    settle=True,
)
def i09_wide(t):
    rows = replenish.demand_signals(forecast_table(t), t.sales(), window=35, season=14, history=28)
    return rows.filter("in_horizon").select(*SERIES_DAY, "rolling_mean", "seasonal_naive")


_mean_sql = (
    "case kind when 'rolling_mean' then rolling_mean when 'seasonal_naive' then seasonal_naive else ml end"
)
_point_sql = f"({_mean_sql}) * 7.0::double + z * error_std * sqrt(7.0::double)"


@entry(
    "i10_policy_orders",
    "horizon series",
    f"select {_keys}, policy, case when kind <> 'ml' then "
    f"greatest(0, cast(ceil(14.0::double * ({_mean_sql}) - initial_stock) as bigint)) "
    f"when initial_stock >= {_point_sql} then 0 else "
    f"greatest(0, cast(ceil({_point_sql} + 14.0::double * ({_mean_sql}) - initial_stock) as bigint)) end as reorder_qty "
    f"from horizon join series using (store_id, sku_id) cross join (values {oracle.STANDARD}) p(policy, kind, z)",
    settle=True,
)
def i10(t):
    cases = replenish.with_policies(_positions(t), replenish.STANDARD)
    rows = cases.withColumn("day", F.explode("days"))
    mean = (
        F.when(F.col("kind") == "rolling_mean", F.col("day.rolling_mean"))
        .when(F.col("kind") == "seasonal_naive", F.col("day.seasonal_naive"))
        .otherwise(F.col("day.ml"))
    )
    quantity = replenish.order_quantity(mean, F.col("initial_stock"), 7)
    return rows.select(*SERIES, F.col("day.date").alias("date"), "policy", quantity.alias("reorder_qty"))


@entry(
    "i10_orders_at_positions",
    "horizon series",
    f"select {_keys}, policy, position, case when kind <> 'ml' then "
    f"greatest(0, cast(ceil(14.0::double * ({_mean_sql}) - position) as bigint)) "
    f"when position >= {_point_sql} then 0 else "
    f"greatest(0, cast(ceil({_point_sql} + 14.0::double * ({_mean_sql}) - position) as bigint)) end as reorder_qty "
    "from (select *, unnest([0, initial_stock // 2, initial_stock, 3 * initial_stock]) as position, "
    "unnest([0, 1, 2, 3]) as nth from horizon join series using (store_id, sku_id)) h "
    f"cross join (values {oracle.STANDARD}) p(policy, kind, z)",
    settle=True,
)
def i10_positions(t):
    """Orders of every policy at stocks from none to three times the opening one."""
    stock = F.col("initial_stock")
    cases = replenish.with_policies(_positions(t), replenish.STANDARD)
    levels = F.array(F.lit(0).cast("long"), F.floor(stock / 2), stock, stock * 3)
    rows = cases.withColumn("day", F.explode("days")).withColumn("position", F.explode(levels))
    quantity = replenish.order_quantity(replenish.policy_mean(F.col("day")), F.col("position"), 7)
    return rows.select(*SERIES, F.col("day.date").alias("date"), "policy", "position", quantity.alias("reorder_qty"))


_trace = "received_qty, on_hand, on_order, served_units, stockout_units, reorder_qty"


@entry("i11_replay_days", "sim", f"select store_id, sku_id, policy, cast(day as int) as day, {_trace} from sim where day >= 0", settle=True)
def i11(t):
    cases = replenish.with_policies(_positions(t), replenish.STANDARD)
    return replenish.replay_days(cases).select(*SERIES, "policy", "day", *_trace.split(", "))


def _kpis(t: DriverTables) -> DataFrame:
    return replenish.backtest(forecast_table(t), t.sales(), t.prices(), t.products())


@entry("i12_series_kpis", "kpis", "select * from kpis", oracle.KPI_DOUBLES, settle=True)
def i12(t):
    return _kpis(t)


_summary_names = (
    "total_holding_cost total_stockout_cost total_cost mean_service_level total_stockout_units mean_avg_inventory"
)


@entry(
    "i13_policy_summary",
    "kpis",
    "select policy, sum(total_holding_cost) as total_holding_cost, sum(total_stockout_cost) as total_stockout_cost, "
    "sum(total_cost) as total_cost, avg(service_level) as mean_service_level, "
    "sum(stockout_units) as total_stockout_units, avg(avg_inventory) as mean_avg_inventory, "
    "count(sku_id) as sku_count from kpis group by policy",
    _summary_names,
    settle=True,
)
def i13(t):
    return replenish.policy_summary(_kpis(t))


@entry(
    "i14_compare_policies",
    "kpis",
    "select store_id, sku_id, policy, total_cost, service_level, avg_inventory, num_stockout_events from kpis",
    "total_cost service_level avg_inventory",
    settle=True,
)
def i14(t):
    return replenish.compare_policies(_kpis(t))


@entry(
    "i15_service_sensitivity",
    "level_kpis",
    "select substring(policy, 4) as service_level, sum(total_cost) as total_cost from level_kpis group by policy",
    "total_cost",
    settle=True,
)
def i15(t):
    levels = replenish.sensitivity_policies(stock.SENSITIVITY_Z)
    kpis = replenish.backtest(forecast_table(t), t.sales(), t.prices(), t.products(), levels)
    return replenish.service_sensitivity(kpis)


@entry(
    "i16_category_delta",
    "kpis",
    "select category, sum(case policy when 'ML_95' then total_cost when 'baseline_rolling_mean' then -total_cost end) "
    "as cost_delta from kpis where policy in ('ML_95', 'baseline_rolling_mean') group by category",
    "cost_delta",
    settle=True,
)
def i16(t):
    return replenish.category_cost_delta(_kpis(t))


def refill(day: int, mean: float, std: float, on_hand: int, on_order: int) -> int:
    """Example of a user policy: order 60 units when fewer than 40 are on hand or on order."""
    return 60 if on_hand + on_order < 40 else 0


@entry(
    "i17_custom_policy",
    "refill_sim",
    "select store_id, sku_id, policy, cast(day as int) as day, on_hand, stockout_units, reorder_qty "
    "from refill_sim where day >= 0",
    settle=True,
)
def i17(t):
    return replenish.replay_custom(_positions(t), {"refill": refill}).drop("date")


# ---- construction and profiles ------------------------------------------------------------------


@entry("d01_calendar", "calendar", "select * from calendar")
def d01(t):
    return t.calendar()


@entry("d02_panel_spine", "dense", "select store_id, sku_id, date, week_start, cast(units_sold as bigint) as units_sold from dense", settle=True)
def d02(t):
    return dense(t)


@entry(
    "d03_price_panel",
    "sales prices products",
    f"select s.store_id, s.sku_id, s.date, coalesce(p.price, base_price) as price, coalesce(is_promo, false) as is_promo, "
    "least(greatest(coalesce(p.price, base_price) / base_price, 0.4), 1.6) as price_ratio, "
    "round(units_sold * coalesce(p.price, base_price), 2) as revenue "
    f"from (select *, date - ((date // {DAY} + 3) % 7) * {DAY} as week_start from sales) s "
    "left join prices p on p.store_id = s.store_id and p.sku_id = s.sku_id and p.week_start = s.week_start "
    "left join products on products.sku_id = s.sku_id",
    "price price_ratio revenue",
    settle=True,
)
def d03(t):
    panel = t.sales().select(*SERIES_DAY, "units_sold", week_start("date").alias("week_start"))
    return profile.price_panel(panel, t.prices(), t.products()).select(
        *SERIES_DAY, "price", "is_promo", "price_ratio", "revenue"
    )


_lift_sql = (
    "select *, promo_mean / other_mean as lift from (select s.store_id, s.sku_id, "
    "avg(units_sold) filter (where is_promo) as promo_mean, avg(units_sold) filter (where not is_promo) as other_mean "
    f"from sales s join prices p on p.store_id = s.store_id and p.sku_id = s.sku_id "
    f"and p.week_start = s.date - ((s.date // {DAY} + 3) % 7) * {DAY} group by s.store_id, s.sku_id) m "
    "where promo_mean is not null and other_mean is not null"
)


@entry("d04_promo_lift", "sales prices", _lift_sql, "promo_mean other_mean lift", settle=True)
def d04(t):
    return profile.promo_lift(t.sales(), t.prices())


@entry(
    "d04_mean_promo_lift",
    "sales prices",
    f"select count(*) as n_series, avg(nullif(lift, 'inf'::double)) as mean_lift from ({_lift_sql}) l",
    "mean_lift",
    settle=True,
)
def d04b(t):
    return profile.mean_promo_lift(t.sales(), t.prices())


@entry(
    "d05_intermittent_share",
    "dense",
    "select count(*) as n_skus, avg(case when zero_rate > 0.5 then 1.0::double else 0.0::double end) as intermittent_share "
    "from (select sku_id, avg(case when units_sold = 0 then 1.0::double else 0.0::double end) as zero_rate from dense group by sku_id)",
    "intermittent_share",
    settle=True,
)
def d05(t):
    return profile.intermittent_share(dense(t))


@entry(
    "d06_dirtiness",
    "cast_sales dirty_prices",
    "select count(*) as n_rows, (count(*) - count(distinct (store_id, sku_id, date, units_sold, revenue)))::double / count(*) as duplicate_rate, "
    "count(*) filter (where units_sold < 0)::double / count(*) as negative_rate, "
    "count(*) filter (where regexp_matches(store_id, '[A-Z]'))::double / count(*) as wrong_case_rate, "
    "count(*)::double / count(distinct (store_id, sku_id, date)) as rows_per_key, "
    "(select avg(case when price is null then 1.0::double else 0.0::double end) from dirty_prices) as null_price_rate from cast_sales",
    "duplicate_rate negative_rate wrong_case_rate rows_per_key null_price_rate",
)
def d06(t):
    return profile.dirtiness(clean.cast_business(t.dirty_sales(), "sales"), t.dirty_prices())
