"""Queries behind the shop-floor application: fleet, inspector, command centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.functions import health
from millgauge.functions.numeric import percent, rnd, tally
from millgauge.functions.periods import month_label
from millgauge.operators.dispatch import is_active_order
from millgauge.operators.latest import latest_per_key, newest_rows
from millgauge.plans.analytics import latest_health


def machine_status_counts(machines: DataFrame) -> DataFrame:
    status = F.col("status")
    return machines.agg(
        F.count(F.lit(1)).alias("total"),
        tally(status == "Active").alias("active"),
        tally(status == "Maintenance").alias("maintenance"),
        tally(status == "Idle").alias("idle"),
    )


def performance_kpis(
    work_orders: DataFrame, utilization: DataFrame, farmout: DataFrame, maintenance: DataFrame
) -> DataFrame:
    """Fleet KPIs in one row.

    "Latest" figures group by period and keep the newest group, so each source is
    computed once instead of a second time to find its newest period. The parts
    are scalar subqueries, each a single row.
    """
    by_month = utilization.groupBy("period_month").agg(F.avg("utilization_pct").alias("value"))
    util = by_month.agg(F.max_by("value", "period_month")).scalar()

    complete = F.col("status") == "Complete"
    orders = work_orders.agg(
        F.struct(
            percent(tally(complete & ~F.col("is_late")), tally(complete)).alias("otd"),
            tally(is_active_order()).alias("open"),
        )
    ).scalar()

    by_year = farmout.groupBy("period_year").agg(
        F.struct(F.sum("total_farm_out_cost").alias("cost"), F.avg("cost_premium_pct").alias("premium")).alias("value")
    )
    year = by_year.agg(F.max_by("value", "period_year")).scalar()

    urgency = F.col("maintenance_urgency")
    by_day = maintenance.groupBy("reading_date").agg(
        F.struct(tally(urgency == "Critical").alias("critical"), tally(urgency == "Warning").alias("warning")).alias("value")
    )
    day = by_day.agg(F.max_by("value", "reading_date")).scalar()

    one_row = work_orders.sparkSession.range(1)
    parts = one_row.select(util.alias("util"), orders.alias("orders"), year.alias("year"), day.alias("day"))
    return parts.select(
        rnd(F.col("util"), 1).alias("avg_utilization_pct"),
        F.col("orders.otd").alias("avg_otd_pct"),
        rnd(F.col("year.cost"), 0).alias("ytd_farmout_cost"),
        rnd(F.col("year.premium"), 1).alias("avg_cost_premium_pct"),
        F.col("day.critical").alias("critical_machines"),
        F.col("day.warning").alias("warning_machines"),
        F.col("orders.open").alias("orders_in_progress"),
    )


def utilization_by_machine(utilization: DataFrame, machines: DataFrame) -> DataFrame:
    means = utilization.groupBy("machine_id").agg(
        rnd(F.avg("utilization_pct"), 1).alias("avg_utilization_pct"),
        rnd(F.avg("efficiency_pct"), 1).alias("avg_efficiency_pct"),
    )
    names = machines.select("machine_id", "machine_name", "work_center")
    return (
        means.join(names, "machine_id")
        .select("machine_id", "machine_name", "work_center", "avg_utilization_pct", "avg_efficiency_pct")
        .orderBy(F.col("avg_utilization_pct").desc(), "machine_id")
    )


def scheduling_trend(scheduling: DataFrame) -> DataFrame:
    return (
        scheduling.filter(F.col("period_month").isNotNull())
        .groupBy(month_label(F.col("period_month")).alias("month"))
        .agg(
            rnd(F.avg("on_time_delivery_pct"), 1).alias("avg_otd_pct"),
            F.sum("total_orders").alias("total_orders"),
            F.sum("late_count").alias("late_orders"),
            F.sum("farm_out_count").alias("farm_out_orders"),
            rnd(F.sum("total_farm_out_cost"), 0).alias("farm_out_cost"),
        )
        .orderBy("month")
    )


def farmout_by_vendor(farmout: DataFrame) -> DataFrame:
    return (
        farmout.groupBy("farm_out_vendor")
        .agg(
            rnd(F.sum("total_farm_out_cost"), 0).alias("total_farmout_cost"),
            rnd(F.sum("implied_internal_cost"), 0).alias("implied_inhouse_cost"),
            rnd(F.avg("cost_premium_pct"), 1).alias("avg_premium_pct"),
            F.sum("farm_out_orders").alias("total_orders"),
        )
        .orderBy(F.col("total_farmout_cost").desc(), "farm_out_vendor")
    )


def maintenance_summary(maintenance: DataFrame) -> DataFrame:
    """Machines with readings on the newest day of the whole fleet."""
    return (
        newest_rows(maintenance, "reading_date")
        .groupBy("machine_id", "machine_name", "work_center", "maintenance_urgency")
        .agg(
            F.min("min_health_score").alias("worst_health_score"),
            rnd(F.max("max_tool_wear_pct"), 1).alias("max_tool_wear_pct"),
            F.sum("anomaly_count").alias("total_anomalies"),
        )
        .orderBy(health.urgency_order(F.col("maintenance_urgency")), "worst_health_score", "machine_id")
    )


def capacity_latest(capacity: DataFrame) -> DataFrame:
    return (
        newest_rows(capacity, "period_month")
        .groupBy("work_center", "load_status")
        .agg(rnd(F.avg("capacity_utilization_pct"), 1).alias("avg_capacity_pct"))
        .orderBy(F.col("avg_capacity_pct").desc(), "work_center")
    )


def machine_kpis(
    machines: DataFrame,
    work_orders: DataFrame,
    utilization: DataFrame,
    maintenance: DataFrame,
    machine_id: str | None = None,
) -> DataFrame:
    """KPIs of one machine, or of every machine.

    Every part is one row per machine before it is joined. The farm-out cost is
    that of the machine's work center.
    """
    wanted = machines if machine_id is None else machines.filter(F.col("machine_id") == machine_id)
    means = utilization.groupBy("machine_id").agg(rnd(F.avg("utilization_pct"), 1).alias("util"))
    complete = F.col("status") == "Complete"
    orders = (
        work_orders.filter(F.col("machine_id").isNotNull())
        .groupBy("machine_id")
        .agg(
            percent(tally(complete & ~F.col("is_late")), tally(complete)).alias("otd"),
            tally(is_active_order()).alias("open"),
        )
    )
    condition = (
        latest_health(maintenance)
        .groupBy("machine_id")
        .agg(
            F.min_by("maintenance_urgency", health.urgency_order(F.col("maintenance_urgency"))).alias("urgency"),
            F.min("min_health_score").alias("worst"),
        )
    )
    center_cost = (
        work_orders.filter(F.col("due_date").isNotNull())
        .groupBy("work_center")
        .agg(rnd(F.sum("farm_out_cost_usd"), 0).alias("cost"))
    )
    return (
        wanted.select("machine_id", "machine_name", "machine_type", "work_center", F.col("status").alias("machine_status"))
        .join(means, "machine_id", "left")
        .join(orders, "machine_id", "left")
        .join(condition, "machine_id", "left")
        .join(center_cost, "work_center", "left")
        .select(
            "machine_id", "machine_name", "machine_type", "work_center", "machine_status",
            F.coalesce("util", F.lit(0.0)).alias("avg_utilization_pct"),
            F.col("otd").alias("avg_otd_pct"),
            F.coalesce("urgency", F.lit("Unknown")).alias("maintenance_urgency"),
            F.coalesce("worst", F.lit(0)).alias("health_score"),
            F.coalesce("open", F.lit(0)).alias("orders_in_progress"),
            F.coalesce("cost", F.lit(0.0)).alias("wc_farmout_cost"),
        )
    )


def latest_reading(sensor_data: DataFrame) -> DataFrame:
    """Newest reading per machine; readings of the same second go by sensor id."""
    return latest_per_key(sensor_data, ["machine_id"], [F.col("reading_timestamp").desc(), F.col("sensor_id").desc()])


def _work_on_machine(work_orders: DataFrame) -> DataFrame:
    """Distinct active orders, their quantity and the names of their parts, per machine.

    One pass over the orders. Names are kept as a set from the first task on, so what
    a machine's task holds is the printed list itself, however many orders stand behind it.
    """
    active = work_orders.filter(is_active_order() & F.col("machine_id").isNotNull())
    return active.groupBy("machine_id").agg(
        F.count_distinct("work_order_id").alias("active_orders"),
        F.sum("order_qty").alias("total_qty"),
        F.array_join(F.sort_array(F.collect_set("part_description")), ", ").alias("parts"),
    )


def machine_fleet(
    machines: DataFrame, work_orders: DataFrame, sensor_data: DataFrame, status: str | None = None
) -> DataFrame:
    """Every machine with its active load and newest reading."""
    fleet = machines if status is None else machines.filter(F.col("status") == status)
    reading = latest_reading(
        sensor_data.select(
            "machine_id", "reading_timestamp", "sensor_id", "health_score",
            F.col("machine_status").alias("sensor_status"), "tool_wear_pct", "anomaly_flag",
        )
    )
    return (
        fleet.join(_work_on_machine(work_orders), "machine_id", "left")
        .join(reading, "machine_id", "left")
        .orderBy("work_center", "status", "machine_id")
        .select(
            "machine_id", "machine_name", "machine_type", "work_center", "status", "num_shifts",
            rnd(F.col("hourly_rate_usd"), 2).alias("hourly_rate_usd"),
            rnd(F.col("capacity_hrs_per_day"), 1).alias("capacity_hrs_per_day"),
            F.coalesce("active_orders", F.lit(0)).alias("active_orders"),
            F.coalesce("total_qty", F.lit(0)).alias("total_qty_in_progress"),
            F.coalesce("parts", F.lit("")).alias("parts_in_progress"),
            F.coalesce("health_score", F.lit(0)).alias("latest_health_score"),
            "sensor_status", "tool_wear_pct", "anomaly_flag",
        )
    )


def machines_list(machines: DataFrame, status: str | None = None) -> DataFrame:
    wanted = machines if status is None else machines.filter(F.col("status") == status)
    return wanted.select("machine_id", "machine_name", "machine_type", "work_center", "status").orderBy(
        "work_center", "machine_id"
    )


def machine_detail(machines: DataFrame, sensor_data: DataFrame, machine_id: str | None = None) -> DataFrame:
    """Master data and newest reading of one machine, or of every machine."""
    if machine_id is not None:
        machines = machines.filter(F.col("machine_id") == machine_id)
        sensor_data = sensor_data.filter(F.col("machine_id") == machine_id)

    def reading(name: str, digits: int) -> Column:
        return rnd(F.col(name), digits).alias(name)

    newest = latest_reading(
        sensor_data.select(
            "machine_id", "reading_timestamp", "sensor_id", "temperature_celsius", "vibration_mm_s",
            "spindle_speed_rpm", "power_consumption_kw", "coolant_flow_lpm", "tool_wear_pct",
            "health_score", F.col("machine_status").alias("sensor_machine_status"), "anomaly_flag", "anomaly_type",
        )
    )
    return machines.join(newest, "machine_id", "left").select(
        "machine_id", "machine_name", "machine_type", "work_center", "status", "num_shifts",
        "vendor", "installation_year",
        reading("hourly_rate_usd", 2),
        reading("capacity_hrs_per_day", 1),
        "preventive_maint_interval_hrs",
        F.col("last_pm_date").cast("string").alias("last_pm_date"),
        "notes",
        reading("temperature_celsius", 2),
        reading("vibration_mm_s", 3),
        reading("spindle_speed_rpm", 0),
        reading("power_consumption_kw", 2),
        reading("coolant_flow_lpm", 2),
        reading("tool_wear_pct", 1),
        "health_score", "sensor_machine_status", "anomaly_flag", "anomaly_type",
        F.col("reading_timestamp").cast("string").alias("last_reading_ts"),
    )


def gauge_bands(machines: DataFrame, sensor_data: DataFrame) -> DataFrame:
    """Green, amber or red per gauge of each machine's newest reading."""
    newest = latest_reading(
        sensor_data.select(
            "machine_id", "reading_timestamp", "sensor_id", "health_score",
            "temperature_celsius", "vibration_mm_s", "tool_wear_pct",
        )
    )
    return machines.select("machine_id").join(newest, "machine_id", "left").select(
        "machine_id",
        health.health_band(F.col("health_score")).alias("health_band"),
        health.temperature_band(F.col("temperature_celsius")).alias("temperature_band"),
        health.vibration_band(F.col("vibration_mm_s")).alias("vibration_band"),
        health.wear_band(F.col("tool_wear_pct")).alias("wear_band"),
    )
