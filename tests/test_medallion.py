import re
from types import SimpleNamespace

import pytest
from helpers import DAY, day
from pyspark.sql import functions as F

from shelfcast.operators import clean, quality
from shelfcast.operators.profile import calendar
from shelfcast.plans.medallion import GOLD_TABLES, Bronze, Gold, Silver
from shelfcast.sources import raw
from shelfcast.sources.layers import Layer
from shelfcast.sources.schemas import TABLES


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    zone = Layer(spark, str(root / "raw"))
    keys = "store_id string, sku_id string, "
    stores = spark.createDataFrame([("store_1", "r", "st", "A", 100)], "store_id string, region string, state string, store_type string, sqft long")
    products = spark.createDataFrame([(k, "c", "x", 2.0, False, 6) for k in "ab"], "sku_id string, category string, subcategory string, base_price double, is_perishable boolean, pack_size long")
    days = calendar(spark.sql("select date'2025-10-06' first_day, date'2025-12-31' last_day"))
    prices = spark.createDataFrame(
        [("STORE_1" if w == 1 else "store_1", k, day(7 * w), None if w == 2 else 5.0 + w, w % 2 == 0) for k in "ab" for w in range(6)],
        keys + "week_start long, price double, is_promo boolean",
    )
    sales = spark.createDataFrame(
        [("store_1", k, day(i), -1 if i == 5 else i % 4, 1.0) for k in "ab" for i in range(40)]
        + [("STORE_1", "a", day(3), 9, 9.0)],
        keys + "date long, units_sold long, revenue double",
    )
    stores = stores.withColumn("open_date", F.lit("2020-01-01").cast("date"))
    for table, df in zip(TABLES, (stores, products, days, prices, sales), strict=True):
        raw.write_raw(zone, df, table)
    bronze = Bronze(zone.root, Layer(spark, str(root / "bronze")))
    silver = Silver(bronze.layer, Layer(spark, str(root / "silver")))
    gold = Gold(silver.layer, Layer(spark, str(root / "gold")))
    return bronze, silver, gold


def test_layers_end_to_end(layers):
    bronze, silver, gold = layers
    loaded = bronze.ingest_all()
    assert loaded["sales"]["rows_written"] == 81 and len({s["ingest_run_id"] for s in loaded.values()}) == 1
    built = silver.build_all(check=True)
    assert built["sales"]["rows_out"] == 78 and built["sales"]["invalid_dropped"] == 2
    assert built["sales"]["dupes_dropped"] == 1
    assert built["prices"]["imputations_applied"] == 2 and built["prices"]["rows_out"] == 12
    row = silver.layer.read("sales").first()
    assert row["_bronze_run_id"] == loaded["sales"]["ingest_run_id"]
    assert silver.checks().filter("passed").count() == 15
    made = gold.build_all(check=True)
    assert list(made) == list(GOLD_TABLES) and made["features_master"]["rows_written"] == 78
    master = gold.layer.read("features_master")
    assert master.filter(F.col("date") == day(6)).first().lag_1_units == 0
    assert (78, 50) == (master.count(), len(set(master.columns) - {"month"}) + 1)
    parts = [gold.layer.read(t) for t in ("features_lag", "features_rolling", "features_price", "features_promo", "features_seasonal")]
    for part in parts:
        shared = [c for c in part.columns if c in master.columns and not c.startswith("_")]
        assert master.select(*shared).exceptAll(part.select(*shared)).count() == 0


def test_append_counts_only_its_run(layers):
    bronze, _, _ = layers
    bronze.ingest("stores")
    again = bronze.ingest("stores", "append")
    assert again["rows_written"] == 1 and bronze.layer.read("stores").count() == 2


def test_failed_checks_raise(layers):
    bronze, silver, _ = layers
    silver.build("products")
    orphans = silver.layer.read("products").filter("sku_id = 'a'")
    frames = {t: silver.layer.read(t) for t in TABLES} | {"products": orphans}
    with pytest.raises(ValueError, match="sales_sku_id_in_products"):
        quality.require(quality.suite(frames))


def test_sql_template_table(layers, spark):
    _, silver, _ = layers
    other = Layer(spark, silver.layer.root + "_gold2")
    text = "select store_id, sku_id, date, units_sold * 2 as units_sold, revenue, year, month from silver_sales"
    made = Gold(silver.layer, other, {"stg_sales_daily": text}).build("stg_sales_daily")
    assert made["rows_written"] == 78
    assert other.read("stg_sales_daily").agg(F.max("units_sold")).first()[0] == 6


def test_unknown_names(layers):
    for layer, call in zip(layers, ("ingest", "build", "build"), strict=True):
        with pytest.raises(ValueError):
            getattr(layer, call)("nothing")
        with pytest.raises(ValueError):
            getattr(layer, call)("sales" if call == "ingest" else "features_lag", "upsert")
    assert DAY > 0


def plan_text(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cleaning_counts_while_it_writes(spark, layers, monkeypatch):
    """The metrics of the writing job equal those of a job of their own, which isn't run."""
    bronze, silver, _ = layers
    bronze.ingest_all()
    asked = {t: clean.clean(bronze.layer.read(t), t).metrics.first().asDict() for t in TABLES}
    monkeypatch.setattr(clean, "clean", lambda *a: pytest.fail("a second pass over Bronze"))
    for table in TABLES:
        built = silver.build(table)
        assert {m: built[m] for m in clean.METRICS} == asked[table]


def test_counts_of_a_repeated_stage_are_taken_again(spark, layers):
    bronze, _, _ = layers
    counted = clean.counted_clean(bronze.layer.read("sales"), "sales")
    counted.frame.write.format("noop").mode("overwrite").save()
    right = counted.metrics()
    doubled = SimpleNamespace(get={m: 2 * v for m, v in counted.before.get.items()})
    assert counted._replace(before=doubled).metrics() == right


def test_cleaning_scans_bronze_once(layers):
    bronze, _, _ = layers
    for table in TABLES:
        plan = plan_text(clean.counted_clean(bronze.layer.read(table), table).frame)
        assert plan.count("Relation [") == 1, plan


def test_feature_tables_are_columns_of_the_master(layers, monkeypatch):
    """One window pass: only the master's frame holds windows."""
    _, silver, gold = layers
    silver.build_all()
    plans = {}
    write = type(gold.layer).write

    def watched(self, df, table, *rest):
        plans[table] = df._jdf.queryExecution().optimizedPlan().toString()
        write(self, df, table, *rest)

    monkeypatch.setattr(type(gold.layer), "write", watched)
    made = gold.build_all()
    assert list(made) == list(GOLD_TABLES)
    by_series = {t for t, p in plans.items() if "Window [" in p and "store_id" in p}
    assert by_series == {"features_master"}
    single = Gold(silver.layer, Layer(gold.layer.spark, gold.layer.root + "_single"))
    for table in GOLD_TABLES:
        single.build(table)
        a, b = (x.read(table).drop("_gold_run_id") for x in (gold.layer, single.layer))
        b = b.select(*a.columns)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_checks_read_each_table_once(spark, layers):
    """Five key profiles: every further use of a profile is the same exchange."""
    _, silver, _ = layers
    silver.build_all()
    result = silver.checks()
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scanned = re.findall(r"FileScan parquet \[[^\]]*\][^\n]*Location: [^\n]*?/silver/(\w+)\]", final)
    reused = final.count("ReusedExchange")
    assert result.count() == 15
    assert all(scanned.count(t) <= 1 for t in TABLES) or reused >= 5, final
