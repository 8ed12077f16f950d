import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millgauge.operators import dispatch
from millgauge.plans import floor
from tests.frames import machines, readings, work_orders


@pytest.fixture
def fleet(spark):
    return machines(
        spark,
        dict(machine_id="MCH-001", status="Maintenance"),
        dict(machine_id="MCH-002"),
        dict(machine_id="MCH-003"),
        dict(machine_id="MCH-004", work_center="WC-TURN"),
        dict(machine_id="MCH-005", work_center="WC-QC", status="Idle"),
    )


@pytest.fixture
def orders(spark):
    return work_orders(
        spark,
        dict(work_order_id="A", machine_id="MCH-001", priority="Low"),
        dict(work_order_id="B", machine_id="MCH-001", priority="High", due_date=dt.date(2024, 3, 9)),
        dict(work_order_id="C", machine_id="MCH-001", priority="High", status="In Progress"),
        dict(work_order_id="D", machine_id="MCH-001", status="Complete"),
        dict(work_order_id="E", machine_id="MCH-002"),
        dict(work_order_id="F", machine_id=None, status="Farm-Out"),
        dict(work_order_id="G", machine_id="MCH-004"),
    )


def failed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "machine_id string")


def test_affected_orders_by_priority_then_due_date(spark, orders):
    rows = dispatch.affected_work_orders(orders, failed(spark, "MCH-001", "MCH-001")).collect()
    assert [r.work_order_id for r in rows] == ["C", "B", "A"]


def test_candidates_least_loaded_first(spark, fleet, orders):
    rows = dispatch.replacement_candidates(fleet, orders, failed(spark, "MCH-001")).collect()
    assert [(r.machine_id, r.active_orders) for r in rows] == [("MCH-003", 0), ("MCH-002", 1)]


def test_machine_is_no_candidate_for_itself(spark, fleet, orders):
    rows = dispatch.replacement_candidates(fleet, orders, failed(spark, "MCH-002", "MCH-004")).collect()
    assert [(r.machine_id, r.stands_in_for) for r in rows] == [("MCH-003", 1)]


def test_move_takes_second_when_first_failed_itself(spark, fleet, orders):
    moves = {tuple(r) for r in dispatch.choose_moves(fleet, orders, failed(spark, "MCH-001", "MCH-003", "MCH-004")).collect()}
    assert moves == {("MCH-001", "MCH-003"), ("MCH-003", "MCH-002")}


def test_reassignment_changes_only_the_machine_of_active_orders(spark, orders):
    moves = spark.createDataFrame([("MCH-001", "MCH-003"), ("MCH-002", "MCH-004")], "from_machine_id string, to_machine_id string")
    moved = dispatch.reassign_work_orders(orders, moves)
    assert moved.columns == orders.columns and moved.count() == orders.count()
    machine = {r.work_order_id: r.machine_id for r in moved.collect()}
    assert machine == {"A": "MCH-003", "B": "MCH-003", "C": "MCH-003", "D": "MCH-001", "E": "MCH-004", "F": None, "G": "MCH-004"}
    rest = [c for c in orders.columns if c != "machine_id"]
    assert moved.select(rest).exceptAll(orders.select(rest)).isEmpty()
    counts = {r.from_machine_id: r.moved_orders for r in dispatch.move_counts(orders, moves).collect()}
    assert counts == {"MCH-001": 3, "MCH-002": 1}


def test_doubled_and_invalid_moves_change_nothing_twice(spark, fleet, orders):
    schema = "from_machine_id string, to_machine_id string"
    same = spark.createDataFrame([("MCH-001", "MCH-002"), ("MCH-001", "MCH-002"), ("MCH-002", "MCH-004")], schema)
    moved = dispatch.reassign_work_orders(orders, same, fleet)
    assert moved.count() == orders.count()
    machine = {r.work_order_id: r.machine_id for r in moved.collect()}
    before = {r.work_order_id: r.machine_id for r in orders.collect()}
    # MCH-004 is in another work center, so that move is left out.
    assert {k for k in machine if machine[k] != before[k]} <= {k for k in before if before[k] == "MCH-001"}
    two = spark.createDataFrame([("MCH-001", "MCH-002"), ("MCH-001", "MCH-003")], schema)
    with pytest.raises(PySparkException, match="two targets"):
        dispatch.reassign_work_orders(orders, two, fleet).collect()


def test_orders_are_read_once_and_no_key_is_hot(spark, orders, tmp_path):
    path = str(tmp_path / "orders")
    orders.write.parquet(path)
    stored = spark.read.parquet(path)
    moves = spark.createDataFrame([("MCH-001", "MCH-003")], "from_machine_id string, to_machine_id string")

    def plan():
        return dispatch.reassign_work_orders(stored, moves)._jdf.queryExecution().executedPlan().toString()

    assert plan().count("FileScan parquet") == 1
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert plan().count("FileScan parquet") == 1
        # Rows that cannot move, here most of the table, are dealt evenly whatever join is chosen.
        many = spark.range(4000).selectExpr("concat('WO-', id) AS work_order_id", "'Open' AS status", "cast(null AS string) AS machine_id")
        spread = dispatch.reassign_work_orders(many, moves).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(r["count"] for r in spread) == 4000 and max(r["count"] for r in spread) < 2000


def test_valid_moves(spark, fleet):
    schema = "from_machine_id string, to_machine_id string"
    asked = spark.createDataFrame(
        [("MCH-001", "MCH-002"), ("MCH-002", "MCH-004"), ("MCH-003", "MCH-001"), ("MCH-004", "MCH-404"), ("MCH-005", "MCH-005")], schema
    )
    assert [tuple(r) for r in dispatch.valid_moves(asked, fleet).collect()] == [("MCH-001", "MCH-002")]
    with pytest.raises(PySparkException, match="two targets"):
        dispatch.valid_moves(spark.createDataFrame([("MCH-001", "MCH-002"), ("MCH-001", "MCH-003")], schema), fleet).collect()


def test_alternatives(spark, fleet, orders):
    rows = dispatch.alternative_machines(fleet, orders).collect()
    assert [(r.work_center, r.machine_id, r.current_orders, r.available_hrs, r.availability) for r in rows] == [
        ("WC-MILL", "MCH-003", 0, 8.0, "green"), ("WC-MILL", "MCH-002", 1, 5.0, "green")
    ]
    one = dispatch.alternative_machines(fleet, orders, work_center="WC-MILL", exclude_id="MCH-003").collect()
    assert [r.machine_id for r in one] == ["MCH-002"]


def test_orders_of_one_machine(spark, orders):
    rows = dispatch.machine_orders(orders, "MCH-001").collect()
    assert [r.work_order_id for r in rows] == ["C", "B", "A"]
    assert rows[0].due_date == "2024-03-06"


def test_reports_to_machines(spark):
    reports = spark.createDataFrame([("mch 001 down",), ("MCH-001 again",), ("coffee machine",)], "report_text string")
    assert [r.machine_id for r in dispatch.reported_machines(reports).collect()] == ["MCH-001"]


def test_fleet_row(spark, fleet, orders):
    sensors = readings(
        spark,
        dict(sensor_id="1", machine_id="MCH-001", health_score=10),
        dict(sensor_id="2", machine_id="MCH-001", health_score=20),
        dict(sensor_id="9", machine_id="MCH-001", health_score=30, reading_timestamp=dt.datetime(2024, 3, 1)),
    )
    extra = work_orders(spark, dict(work_order_id="A", machine_id="MCH-001", part_description="bolt"))
    rows = {r.machine_id: r for r in floor.machine_fleet(fleet, orders.union(extra), sensors).collect()}
    row = rows["MCH-001"]
    assert (row.active_orders, row.total_qty_in_progress, row.parts_in_progress, row.latest_health_score) == (3, 40, "bolt, gear", 20)
    empty = rows["MCH-005"]
    assert (empty.active_orders, empty.total_qty_in_progress, empty.parts_in_progress, empty.latest_health_score, empty.sensor_status) == (0, 0, "", 0, None)
    assert [r.machine_id for r in floor.machine_fleet(fleet, orders, sensors, status="Idle").collect()] == ["MCH-005"]


def test_machine_kpi_defaults(spark, fleet, orders):
    from millgauge.operators import gold

    sensors = readings(spark, dict(machine_id="MCH-404"))
    rows = floor.machine_kpis(
        fleet, orders, gold.machine_utilization(orders, fleet), gold.predictive_maintenance(sensors, fleet), "MCH-005"
    ).collect()
    assert [tuple(r)[5:] for r in rows] == [(0.0, None, "Unknown", 0, 0, 0.0)]
