from pyspark.sql import functions as F

from millgauge import session
from millgauge.plans import medallion, metrics
from millgauge.plans.shop import StagedShop
from millgauge.sources import documentation
from millgauge.sources.documentation import COLUMN_COMMENTS, TABLE_COMMENTS, dictionary, documented, undocumented

import datetime as dt

import pytest


def test_every_silver_and_gold_column_is_described(spark, data):
    shop = StagedShop(spark, data)
    frames = [shop.machines, shop.routings, shop.work_orders, shop.sensor_data, shop.utilization, shop.scheduling, shop.maintenance,
              shop.capacity, shop.farmout]
    assert len(frames) == len(TABLE_COMMENTS)
    for df in frames:
        assert undocumented(documented(df)) == []
    # The stored silver tables add two arrival columns each.
    assert sum(len(df.columns) for df in frames) + 8 == 145


def test_other_columns_stay_as_they_are(spark):
    df = spark.range(2).withColumn("machine_id", F.lit("MCH-001"))
    noted = documented(df)
    assert undocumented(noted) == ["id"]
    assert noted.schema["machine_id"].metadata["comment"] == COLUMN_COMMENTS["machine_id"]
    rows = {r.column_name: (r.documented, r.filled_rows) for r in dictionary(df, "t").collect()}
    assert rows == {"id": (False, 2), "machine_id": (True, 2)}


def test_catalog_comments(spark):
    documentation.create_schema(spark, "shop_docs")
    documentation.create_schema(spark, "shop_docs")
    spark.sql("DROP TABLE IF EXISTS shop_docs.silver_machines")
    spark.sql("CREATE TABLE shop_docs.silver_machines (machine_id STRING, status STRING, other INT) USING parquet")
    try:
        assert documentation.comment_on(spark, "shop_docs.silver_machines", {"machine_id": "it's a \\ key", "status": "State."}) == 2
        comments = {c.name: c.description for c in spark.catalog.listColumns("shop_docs.silver_machines")}
        assert comments == {"machine_id": "it's a \\ key", "status": "State.", "other": None}
    finally:
        spark.sql("DROP TABLE shop_docs.silver_machines")
        spark.sql("DROP SCHEMA shop_docs")


def test_silver_views_carry_comments_and_later_batches(spark, tmp_path):
    feeds = {"machines": "machine_id", "routings": "routing_id", "work_orders": "work_order_id", "sensor_data": "sensor_id"}
    for feed, key in feeds.items():
        spark.range(2).select(F.col("id").cast("string").alias(key), F.lit(1).alias("other")).write.parquet(f"{tmp_path}/silver_{feed}/batch_id=0")
    try:
        for _ in range(2):
            medallion.publish_silver(spark, str(tmp_path), "shop_silver")
        spark.range(5).select(F.col("id").cast("string").alias("sensor_id"), F.lit(2).alias("other")).write.parquet(
            f"{tmp_path}/silver_sensor_data/batch_id=1"
        )
        for feed, key in feeds.items():
            comments = {c.name: c.description for c in spark.catalog.listColumns(f"shop_silver.silver_{feed}")}
            assert comments == {key: COLUMN_COMMENTS[key], "other": None}
        spark.catalog.refreshByPath(str(tmp_path))
        assert spark.table("shop_silver.silver_sensor_data").count() == 7
        assert spark.table("shop_silver.silver_machines").count() == 2
    finally:
        spark.sql("DROP SCHEMA IF EXISTS shop_silver CASCADE")


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == configured
    assert session.fresh_folder(spark, "x").startswith(configured + "/x-")


def test_metric_registry(spark):
    kinds = [d.kind for d in metrics.REGISTRY.values()]
    assert [kinds.count(k) for k in (metrics.MEASURE, metrics.FILTER, metrics.EXPRESSION, metrics.AGGREGATE)] == [5, 6, 3, 1]
    df = spark.createDataFrame([("Active", dt.date(2024, 1, 1)), ("Idle", None)], "status string, last_pm_date date")
    assert metrics.where(df, "active_machines").count() == 1
    days = df.select(metrics.metric("days_since_last_pm_calc", as_of=dt.date(2024, 1, 31))).collect()
    assert [r[0] for r in days] == [30, None]
    with pytest.raises(ValueError):
        metrics.where(df, "month_display")
