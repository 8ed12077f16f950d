import datetime as dt

import pytest

from millgauge.operators import gold
from tests.frames import machines, readings, work_orders

DAY = dt.datetime(2024, 3, 4)


def utilization(spark, order=None, machine=None):
    df = gold.machine_utilization(work_orders(spark, order or {}), machines(spark, machine or {}))
    return df.first()


@pytest.mark.parametrize(
    "actual, efficiency, revenue", [(None, None, 200.0), (0.0, None, 0.0), (5.0, 80.0, 250.0)]
)
def test_efficiency_and_revenue(spark, actual, efficiency, revenue):
    row = utilization(spark, dict(standard_total_hrs=4.0, actual_total_hrs=actual))
    assert (row.efficiency_pct, row.revenue_usd, row.utilization_pct) == (efficiency, revenue, 50.0)
    assert row.actual_hrs == (actual or 0.0)


def test_no_capacity_gives_no_utilization(spark):
    assert utilization(spark, machine=dict(capacity_hrs_per_day=0.0)).utilization_pct is None


def test_utilization_keeps_every_eligible_order(spark):
    orders = work_orders(
        spark, dict(), dict(), dict(machine_id=None), dict(scheduled_start=None), dict(machine_id="MCH-999"),
        dict(scheduled_start=dt.datetime(2024, 3, 5)),
    )
    rows = gold.machine_utilization(orders, machines(spark, dict())).collect()
    assert sorted(r.work_order_count for r in rows) == [1, 2]


def test_week_across_two_months_is_two_rows(spark):
    orders = work_orders(spark, dict(due_date=dt.date(2024, 2, 29)), dict(due_date=dt.date(2024, 3, 1)))
    rows = gold.scheduling_performance(orders).collect()
    assert len(rows) == 2 and len({r.period_week for r in rows}) == 1


def test_on_time_share(spark):
    done = dict(status="Complete", actual_total_hrs=2.0)
    orders = work_orders(spark, done, {**done, "is_late": True}, done, dict(), dict(due_date=None))
    row = gold.scheduling_performance(orders).first()
    assert (row.total_orders, row.completed_count, row.late_count, row.on_time_delivery_pct) == (4, 3, 1, 66.7)


def test_on_time_share_without_completed_orders(spark):
    assert gold.scheduling_performance(work_orders(spark, dict())).first().on_time_delivery_pct is None


def test_maintenance_day(spark):
    rows = gold.predictive_maintenance(
        readings(spark, dict(health_score=40, tool_wear_pct=90.0), dict(health_score=80, anomaly_flag=True), dict(anomaly_flag=None)),
        machines(spark, dict(last_pm_date=dt.date(2024, 3, 14))),
    ).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.min_health_score, row.max_tool_wear_pct, row.maintenance_urgency) == (40, 90.0, "Warning")
    assert (row.sensor_readings, row.anomaly_count, row.days_since_last_pm) == (3, 1, -10)
    assert row.avg_health_score == 73.3


@pytest.mark.parametrize(
    "hours, status", [(90.0, "High Load"), (90.5, "Overloaded"), (75.0, "Normal"), (75.5, "High Load"), (50.0, "Underutilized"), (50.5, "Normal")]
)
def test_load_status_limits(spark, hours, status):
    row = gold.capacity_planning(
        work_orders(spark, dict(standard_total_hrs=hours)), machines(spark, dict(capacity_hrs_per_day=5.0)), working_days=20
    ).first()
    assert row.load_status == status and row.available_hrs == 100.0


def test_center_without_active_machine(spark):
    row = gold.capacity_planning(work_orders(spark, dict()), machines(spark, dict(status="Idle"))).first()
    assert (row.load_status, row.available_hrs, row.machine_count, row.capacity_utilization_pct) == ("Underutilized", None, None, None)


def test_capacity_sums_and_machines_used(spark):
    out = dict(machine_id=None, is_farm_out=True, farm_out_cost_usd=100.0, standard_total_hrs=1.0)
    row = gold.capacity_planning(
        work_orders(spark, dict(), dict(), dict(machine_id="MCH-002"), out), machines(spark, dict())
    ).first()
    assert (row.demand_hrs, row.farm_out_hrs, row.farm_out_cost_usd, row.machines_used) == (10.0, 1.0, 100.0, 2)


def test_farmout_premium(spark):
    out = dict(is_farm_out=True, farm_out_vendor="V1", farm_out_cost_usd=100.0, standard_total_hrs=1.0)
    rows = gold.farmout_analysis(work_orders(spark, out, {**out, "farm_out_vendor": None}, dict())).collect()
    assert len(rows) == 1
    assert (rows[0].cost_premium_pct, rows[0].implied_internal_cost, rows[0].farm_out_orders) == (35.0, 65.0, 1)


def test_free_farmout_has_no_premium(spark):
    out = dict(is_farm_out=True, farm_out_vendor="V1", farm_out_cost_usd=0.0)
    assert gold.farmout_analysis(work_orders(spark, out)).first().cost_premium_pct is None


def test_result_does_not_depend_on_the_join_taken(spark):
    """Beyond the broadcast limit the join is another one; the rows are the same."""
    orders = work_orders(spark, *(dict(machine_id=f"MCH-{i % 7:03d}", standard_total_hrs=i / 4) for i in range(50)))
    fleet = machines(spark, *(dict(machine_id=f"MCH-{i:03d}") for i in range(7)))
    small = sorted(map(tuple, gold.machine_utilization(orders, fleet).collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = gold.machine_utilization(orders, fleet)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_invariants_on_supplied_data(spark, data):
    from pyspark.sql import functions as F

    from millgauge.plans.shop import StagedShop

    shop = StagedShop(spark, data)
    known = shop.machines.select("machine_id")
    eligible = shop.bare_orders.filter("scheduled_start IS NOT NULL").join(known, "machine_id", "left_semi").count()
    assert shop.utilization.agg(F.sum("work_order_count")).first()[0] == eligible
    assert shop.scheduling.filter("late_count > completed_count").count() == 0
    demand = shop.capacity.agg(F.sum("demand_hrs")).first()[0]
    assert demand == pytest.approx(shop.bare_orders.agg(F.sum("standard_total_hrs")).first()[0])
    assert shop.scheduling.agg(F.sum("total_orders")).first()[0] == shop.bare_orders.count()
