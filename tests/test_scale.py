"""Plans that must hold at size, and results under heavy skew."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millgauge.operators import dispatch, gold
from millgauge.operators.latest import latest_per_key
from millgauge.operators.layout import CLUSTER_KEYS, clustered, write_clustered
from millgauge.plans import analytics, floor
from millgauge.plans.shop import StagedShop
from tests.frames import machines, readings, work_orders


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture(scope="module")
def shop(spark, data):
    return StagedShop(spark, data)


def test_rollups_read_only_the_tables_they_need(shop):
    text = plan(shop.utilization)
    assert "orders.parquet" not in text and "part.parquet" not in text and "nation.parquet" not in text
    assert "part.parquet" not in plan(shop.scheduling)
    assert "orders.parquet" not in plan(shop.farmout)


def test_rollups_read_only_the_columns_they_need(shop):
    scan = next(line for line in plan(shop.scheduling).splitlines() if "lineitem.parquet" in line)
    for unused in ("l_tax", "l_comment"):
        assert unused not in scan.split("ReadSchema")[1]


def test_rollups_combine_before_the_shuffle(shop):
    for name in ("utilization", "scheduling", "maintenance", "capacity", "farmout"):
        assert "partial_" in plan(getattr(shop, name))


def test_newest_rows_are_cut_before_the_shuffle(shop):
    for df in (floor.latest_reading(shop.sensor_data), analytics.latest_health(shop.maintenance)):
        text = plan(df)
        partial, final = text.index(", Final"), text.index(", Partial")
        assert partial < text.index("Exchange", partial) < final


def test_top_k_is_not_a_full_sort(shop):
    assert "TakeOrderedAndProject" in plan(analytics.top_machines(shop.utilization))
    assert "TakeOrderedAndProject" in plan(analytics.top_parts(shop.farmout))


def test_no_query_runs_python_rows_or_pairs(spark, data):
    import __spark_entry__ as entry

    skipped = {n for n in entry.queries() if n.startswith("ingest_") or n in ("write_landing", "quality_log")}
    for name in entry._SHOP_QUERIES:
        if name in skipped:
            continue
        text = plan(entry.queries()[name](spark, data))
        for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


@pytest.fixture(scope="module")
def skewed(spark):
    """Orders and readings of which a third belong to one machine."""
    rng = random.Random(7)
    ids = ["MCH-000"] * 10 + [f"MCH-{i:03d}" for i in range(1, 21)]
    orders = [
        dict(work_order_id=f"W{n}", machine_id=rng.choice(ids), standard_total_hrs=rng.randrange(1, 80) / 4,
             status=rng.choice(["Open", "Complete", "In Progress"]), part_description=f"part {rng.randrange(5)}",
             scheduled_start=dt.datetime(2024, 3, rng.randrange(1, 29)), is_late=rng.random() < 0.3)
        for n in range(1500)
    ]
    sensors = [
        dict(sensor_id=f"S{n}", machine_id=rng.choice(ids), health_score=rng.randrange(0, 101, 5),
             reading_timestamp=dt.datetime(2024, 3, rng.randrange(1, 29), rng.randrange(24)))
        for n in range(1500)
    ]
    fleet = [dict(machine_id=m, work_center="WC-MILL", status="Maintenance" if m == "MCH-000" else "Active") for m in sorted(set(ids))]
    return (orders, sensors, fleet), (work_orders(spark, *orders), readings(spark, *sensors), machines(spark, *fleet))


@pytest.mark.parametrize("broadcast", [True, False])
def test_skewed_results_equal_brute_force(spark, skewed, broadcast):
    (order_rows, sensor_rows, fleet_rows), (orders, sensors, fleet) = skewed
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

        hours = defaultdict(float)
        for row in order_rows:
            hours[row["machine_id"], row["scheduled_start"]] += row["standard_total_hrs"]
        got = {(r.machine_id, r.period_day): r.scheduled_hrs for r in gold.machine_utilization(orders, fleet).collect()}
        assert got == dict(hours)

        newest = {}
        for row in sensor_rows:
            key = (row["reading_timestamp"], row["sensor_id"])
            newest[row["machine_id"]] = max(newest.get(row["machine_id"], key), key)
        got = {r.machine_id: (r.reading_timestamp, r.sensor_id) for r in floor.latest_reading(sensors).collect()}
        assert got == newest

        active = [r for r in order_rows if r["status"] in ("Open", "In Progress")]
        fleet_view = {r.machine_id: r for r in floor.machine_fleet(fleet, orders, sensors).collect()}
        for machine in fleet_rows:
            mine = [r for r in active if r["machine_id"] == machine["machine_id"]]
            row = fleet_view[machine["machine_id"]]
            assert row.active_orders == len(mine)
            assert row.parts_in_progress == ", ".join(sorted({r["part_description"] for r in mine}))

        failed = fleet.filter(F.col("status") == "Maintenance").select("machine_id")
        moves = dispatch.choose_moves(fleet, orders, failed)
        target = moves.first().to_machine_id
        load = {m["machine_id"]: sum(r["machine_id"] == m["machine_id"] for r in active) for m in fleet_rows if m["status"] == "Active"}
        assert target == min(load, key=lambda m: (load[m], m))
        moved = {r.work_order_id: r.machine_id for r in dispatch.reassign_work_orders(orders, moves).collect()}
        assert moved == {
            r["work_order_id"]: target if r["machine_id"] == "MCH-000" and r["status"] != "Complete" else r["machine_id"]
            for r in order_rows
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ties_are_kept_on_request(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, t int, v string")
    tied = latest_per_key(df, ["k"], [F.col("t").desc()], ties=True)
    assert sorted(r.v for r in tied.collect()) == ["w", "y", "z"]
    assert latest_per_key(df, ["k"], [F.col("t").desc(), F.col("v")]).count() == 2


def test_clustered_files_cover_narrow_ranges_and_split_a_hot_key(spark, skewed, tmp_path):
    orders = skewed[1][0]
    laid_out = clustered(orders, ["machine_id"])
    sizes = laid_out.groupBy(F.spark_partition_id().alias("p"), "machine_id").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = clustered(orders, ["machine_id"]).withColumn("p", F.spark_partition_id())
        per_part = {r.p: r["count"] for r in parts.groupBy("p").count().collect()}
        hot = parts.filter("machine_id = 'MCH-000'").select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes and hot >= 2 and max(per_part.values()) < 0.45 * sum(per_part.values())

    write_clustered(orders, str(tmp_path / "orders"), CLUSTER_KEYS["silver_work_orders"])
    stored = spark.read.parquet(str(tmp_path / "orders"))
    assert stored.exceptAll(orders).isEmpty() and stored.count() == orders.count()


def test_partitioned_layout_prunes(spark, skewed, tmp_path):
    orders = skewed[1][0].withColumn("month", F.date_format("scheduled_start", "yyyy-MM"))
    path = str(tmp_path / "by_month")
    write_clustered(orders, path, ["work_order_id"], partition_by=["month"])
    pruned = spark.read.parquet(path).filter("month = '2024-03'")
    assert "PartitionFilters: [isnotnull(month" in plan(pruned) and pruned.count() == 1500


def test_lines_are_joined_without_their_prices(shop):
    text = plan(shop.feed("work_orders"), "optimizedPlan")
    below = text[text.index("Join"):]
    joined = [line for line in below.splitlines() if "Project" in line]
    assert joined and all("l_extendedprice" not in line.split("[")[1].split(" AS ")[0] for line in joined[:2])
    assert "o_orderpriority" not in joined[0]
