"""Business rollups over the silver tables.

All measures are sums, counts, minima, maxima or averages, so Spark combines them
before the shuffle and a hot machine, week or vendor reaches its task as one
partial row per upstream task. Machine attributes are joined after aggregation,
by broadcast if their size is within the session's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.functions.health import DEFAULT_LIMITS, HealthLimits, urgency
from millgauge.functions.numeric import percent, ratio, rnd, tally
from millgauge.functions.periods import day_of, month_of, week_of

# Planning days per month, internal cost per hour, load limits.
WORKING_DAYS = 22
INTERNAL_RATE_USD = 65.0
LOAD_LIMITS = ((0.90, "Overloaded"), (0.75, "High Load"), (0.50, "Normal"))
LOAD_DEFAULT = "Underutilized"


def machine_utilization(work_orders: DataFrame, machines: DataFrame) -> DataFrame:
    """Scheduled against available hours per machine and day.

    Week, month and year follow from the day, so they are added after grouping
    and the shuffle carries two key columns.
    """
    per_day = (
        work_orders.filter(F.col("machine_id").isNotNull() & F.col("scheduled_start").isNotNull())
        .groupBy("machine_id", day_of(F.col("scheduled_start")).alias("period_day"))
        .agg(
            F.sum("standard_total_hrs").alias("scheduled_hrs"),
            F.sum("actual_total_hrs").alias("worked"),
            F.count(F.lit(1)).alias("work_order_count"),
        )
    )
    capacity = machines.select("machine_id", "capacity_hrs_per_day", "hourly_rate_usd")
    day, planned, worked = F.col("period_day"), F.col("scheduled_hrs"), F.col("worked")
    measurable = (worked > 0) & (planned > 0)
    return per_day.join(capacity, "machine_id").select(
        "machine_id", "capacity_hrs_per_day", "hourly_rate_usd",
        "period_day",
        week_of(day).alias("period_week"),
        month_of(day).alias("period_month"),
        F.year(day).alias("period_year"),
        "scheduled_hrs",
        F.coalesce(worked, F.lit(0.0)).alias("actual_hrs"),
        "work_order_count",
        percent(planned, F.col("capacity_hrs_per_day")).alias("utilization_pct"),
        F.when(measurable, percent(planned, worked)).alias("efficiency_pct"),
        rnd(F.coalesce(worked, planned) * F.col("hourly_rate_usd"), 2).alias("revenue_usd"),
    )


def scheduling_performance(work_orders: DataFrame) -> DataFrame:
    """Order counts, lateness, farm-out cost and on-time delivery by due week.

    A week may span two months, so week and month are both keys.
    """
    due = F.col("due_date")
    complete = F.col("status") == "Complete"
    on_time = tally(complete & ~F.col("is_late"))
    return (
        work_orders.filter(due.isNotNull())
        .groupBy(
            week_of(due).alias("period_week"),
            month_of(due).alias("period_month"),
            F.year(due).alias("period_year"),
            "work_center",
            "priority",
        )
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            tally(F.col("is_farm_out")).alias("farm_out_count"),
            tally(F.col("is_late")).alias("late_count"),
            tally(complete).alias("completed_count"),
            rnd(F.sum(F.coalesce("farm_out_cost_usd", F.lit(0.0))), 2).alias("total_farm_out_cost"),
            rnd(F.avg(F.when(complete, F.col("actual_total_hrs"))), 2).alias("avg_actual_hrs"),
            rnd(F.sum("standard_total_hrs"), 2).alias("total_standard_hrs"),
            percent(on_time, tally(complete)).alias("on_time_delivery_pct"),
        )
    )


# The measures of a machine's day, rounded as they are shown; peak wear is rounded later.
SENSOR_MEASURES = (
    "sensor_readings", "avg_temp_c", "max_temp_c", "avg_vibration", "max_vibration", "avg_spindle_rpm", "avg_power_kw",
    "avg_coolant_lpm", "peak_wear", "avg_health_score", "min_health_score", "anomaly_count",
)


def sensor_measures() -> list[Column]:
    """Aggregates over a machine's readings of a day, named as ``SENSOR_MEASURES``."""
    made = (
        F.count(F.lit(1)),
        rnd(F.avg("temperature_celsius"), 2),
        rnd(F.max("temperature_celsius"), 2),
        rnd(F.avg("vibration_mm_s"), 3),
        rnd(F.max("vibration_mm_s"), 3),
        rnd(F.avg("spindle_speed_rpm"), 0),
        rnd(F.avg("power_consumption_kw"), 2),
        rnd(F.avg("coolant_flow_lpm"), 2),
        F.max("tool_wear_pct"),
        rnd(F.avg("health_score"), 1),
        F.min("health_score"),
        tally(F.col("anomaly_flag")),
    )
    return [column.alias(name) for name, column in zip(SENSOR_MEASURES, made)]


def predictive_maintenance(
    sensor_data: DataFrame, machines: DataFrame, limits: HealthLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Sensor condition per machine and day with maintenance urgency."""
    per_day = sensor_data.groupBy("machine_id", day_of(F.col("reading_timestamp")).alias("reading_date")).agg(*sensor_measures())
    return with_maintenance(per_day, machines, limits)


def with_maintenance(per_day: DataFrame, machines: DataFrame, limits: HealthLimits = DEFAULT_LIMITS) -> DataFrame:
    """The measures of machines and days with the machines' attributes and the urgency that follows."""
    attributes = machines.select("machine_id", "machine_name", "machine_type", "work_center", "last_pm_date")
    day = F.col("reading_date")
    return per_day.join(attributes, "machine_id").select(
        "machine_id", "machine_name", "machine_type", "work_center",
        F.year(day).alias("reading_year"),
        F.month(day).alias("reading_month"),
        F.weekofyear(day).alias("reading_week"),
        "reading_date", "sensor_readings", "avg_temp_c", "max_temp_c", "avg_vibration",
        "max_vibration", "avg_spindle_rpm", "avg_power_kw", "avg_coolant_lpm",
        rnd(F.col("peak_wear"), 2).alias("max_tool_wear_pct"),
        "avg_health_score", "min_health_score", "anomaly_count",
        urgency(F.col("min_health_score"), F.col("peak_wear"), limits).alias("maintenance_urgency"),
        F.datediff(day, F.col("last_pm_date")).alias("days_since_last_pm"),
    )


def load_status(demand: Column, available: Column, limits=LOAD_LIMITS) -> Column:
    """Load class from the unrounded ratio; an unknown ratio counts as idle."""
    load = ratio(demand, available)
    label = None
    for limit, name in limits:
        label = F.when(load > limit, name) if label is None else label.when(load > limit, name)
    return label.otherwise(LOAD_DEFAULT)


def capacity_planning(
    work_orders: DataFrame, machines: DataFrame, working_days: int = WORKING_DAYS
) -> DataFrame:
    """Monthly demand against the capacity of active machines per work center.

    Demand is first summed per machine, which makes the number of machines used a
    plain count in the second step instead of a distinct count.
    """
    outsourced = F.col("is_farm_out")
    month = month_of(F.col("scheduled_start")).alias("period_month")
    per_machine = (
        work_orders.filter(F.col("scheduled_start").isNotNull())
        .groupBy("work_center", month, "machine_id")
        .agg(
            F.sum("standard_total_hrs").alias("hrs"),
            F.sum(F.when(outsourced, F.col("standard_total_hrs")).otherwise(0.0)).alias("out_hrs"),
            F.sum(F.when(outsourced, F.coalesce("farm_out_cost_usd", F.lit(0.0))).otherwise(0.0)).alias("out_cost"),
        )
    )
    demand = per_machine.groupBy("work_center", "period_month").agg(
        F.sum("hrs").alias("demand"),
        F.sum("out_hrs").alias("farmed_hrs"),
        F.sum("out_cost").alias("farmed_cost"),
        F.count("machine_id").alias("machines_used"),
    )
    capacity = (
        machines.filter(F.col("status") == "Active")
        .groupBy("work_center")
        .agg(
            (F.sum("capacity_hrs_per_day") * working_days).alias("available"),
            F.count(F.lit(1)).alias("machine_count"),
        )
    )
    return demand.join(capacity, "work_center", "left").select(
        "work_center",
        "period_month",
        F.year("period_month").alias("period_year"),
        rnd(F.col("demand"), 2).alias("demand_hrs"),
        rnd(F.col("available"), 2).alias("available_hrs"),
        rnd(F.col("farmed_hrs"), 2).alias("farm_out_hrs"),
        rnd(F.col("farmed_cost"), 2).alias("farm_out_cost_usd"),
        "machine_count",
        "machines_used",
        percent(F.col("demand"), F.col("available")).alias("capacity_utilization_pct"),
        percent(F.col("farmed_hrs"), F.col("demand")).alias("farm_out_rate_pct"),
        load_status(F.col("demand"), F.col("available")).alias("load_status"),
    )


def farmout_analysis(work_orders: DataFrame, internal_rate: float = INTERNAL_RATE_USD) -> DataFrame:
    """Vendor cost per part and month against doing the work in-house."""
    month = month_of(F.col("due_date"))
    totals = (
        work_orders.filter(F.col("is_farm_out") & F.col("farm_out_vendor").isNotNull())
        .groupBy("farm_out_vendor", "part_number", "part_description", month.alias("period_month"))
        .agg(
            F.count(F.lit(1)).alias("farm_out_orders"),
            F.sum("order_qty").alias("total_qty_farmed"),
            F.sum("farm_out_cost_usd").alias("cost"),
            F.avg("farm_out_cost_usd").alias("mean_cost"),
            F.sum("standard_total_hrs").alias("hrs"),
        )
    )
    cost, internal = F.col("cost"), F.col("hrs") * internal_rate
    return totals.select(
        "farm_out_vendor", "part_number", "part_description", "period_month",
        F.year("period_month").alias("period_year"),
        "farm_out_orders", "total_qty_farmed",
        rnd(cost, 2).alias("total_farm_out_cost"),
        rnd(F.col("mean_cost"), 2).alias("avg_cost_per_order"),
        rnd(F.col("hrs"), 2).alias("equivalent_internal_hrs"),
        rnd(internal, 2).alias("implied_internal_cost"),
        percent(cost - internal, cost).alias("cost_premium_pct"),
    )
