"""Curated analytics over the gold tables.

Each function takes one gold table and returns the report in its display order.
Ties in the order are settled by the keys so that a top-k is the same every time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millgauge.functions.health import urgency_order
from millgauge.functions.numeric import rnd
from millgauge.functions.periods import month_label, week_label
from millgauge.operators.latest import latest_per_key

# Fixed value: days after which preventive maintenance is due.
PM_DUE_DAYS = 180
STRAINED = ("Overloaded", "High Load")


def _mean(name: str, digits: int = 1):
    return rnd(F.avg(name), digits)


def _total(name: str, digits: int):
    return rnd(F.sum(name), digits)


# --- machine utilization ---------------------------------------------------------


def utilization_by_machine(utilization: DataFrame) -> DataFrame:
    """Average utilization and efficiency, revenue and orders per machine."""
    return utilization.groupBy("machine_id").agg(
        _mean("utilization_pct").alias("avg_monthly_utilization_pct"),
        _mean("efficiency_pct").alias("avg_efficiency_pct"),
        _total("revenue_usd", 2).alias("total_revenue_usd"),
        F.sum("work_order_count").alias("total_work_orders"),
    )


def top_machines(utilization: DataFrame, k: int = 5) -> DataFrame:
    ranked = utilization_by_machine(utilization).orderBy(F.col("avg_monthly_utilization_pct").desc(), "machine_id")
    return ranked.limit(k)


def utilization_trend(utilization: DataFrame) -> DataFrame:
    """Day-grain utilization labelled with its month."""
    return utilization.orderBy("period_month", "machine_id", "period_day").select(
        month_label(F.col("period_month")).alias("month"),
        "machine_id",
        rnd(F.col("utilization_pct"), 1).alias("utilization_pct"),
        rnd(F.col("efficiency_pct"), 1).alias("efficiency_pct"),
        "work_order_count",
        rnd(F.col("revenue_usd"), 2).alias("revenue_usd"),
    )


def utilization_yearly(utilization: DataFrame) -> DataFrame:
    return (
        utilization.groupBy("period_year", "machine_id")
        .agg(
            _mean("utilization_pct").alias("avg_utilization_pct"),
            _total("revenue_usd", 0).alias("total_revenue_usd"),
            F.sum("work_order_count").alias("total_work_orders"),
        )
        .orderBy(F.col("period_year").desc(), F.col("avg_utilization_pct").desc(), "machine_id")
    )


# --- scheduling ------------------------------------------------------------------


def on_time_monthly(scheduling: DataFrame) -> DataFrame:
    """On-time delivery rows (week and priority grain) labelled with their month."""
    return scheduling.orderBy(F.col("period_month").desc(), "work_center", "period_week", "priority").select(
        month_label(F.col("period_month")).alias("month"),
        "work_center", "total_orders", "completed_count", "late_count",
        rnd(F.col("on_time_delivery_pct"), 1).alias("otd_pct"),
        rnd(F.col("total_farm_out_cost"), 2).alias("farm_out_cost_usd"),
    )


def weekly_pressure(scheduling: DataFrame, priority: str = "High") -> DataFrame:
    return (
        scheduling.filter(F.col("priority") == priority)
        .orderBy(F.col("period_week").desc(), "work_center", "period_month")
        .select(
            week_label(F.col("period_week")).alias("week"),
            "work_center", "priority", "total_orders", "late_count", "farm_out_count",
            rnd(F.col("total_farm_out_cost"), 2).alias("farm_out_cost_usd"),
            rnd(F.col("on_time_delivery_pct"), 1).alias("otd_pct"),
        )
    )


def yearly_summary(scheduling: DataFrame) -> DataFrame:
    return (
        scheduling.groupBy("period_year")
        .agg(
            F.sum("total_orders").alias("total_orders"),
            F.sum("completed_count").alias("total_completed"),
            F.sum("late_count").alias("total_late"),
            F.sum("farm_out_count").alias("total_farm_out"),
            _total("total_farm_out_cost", 0).alias("total_farm_out_cost_usd"),
            _mean("on_time_delivery_pct").alias("avg_otd_pct"),
            _total("total_standard_hrs", 0).alias("total_standard_hrs"),
        )
        .orderBy(F.col("period_year").desc())
    )


# --- machine health --------------------------------------------------------------


def latest_health(maintenance: DataFrame) -> DataFrame:
    """Each machine's newest day."""
    dated = maintenance.filter(F.col("reading_date").isNotNull())
    return latest_per_key(dated, ["machine_id"], [F.col("reading_date").desc()], ties=True)


def health_snapshot(maintenance: DataFrame) -> DataFrame:
    return (
        latest_health(maintenance)
        .orderBy(urgency_order(F.col("maintenance_urgency")), "avg_health_score", "machine_id")
        .select(
            "machine_id", "machine_name", "machine_type", "work_center",
            F.col("reading_date").alias("last_reading_date"),
            "avg_health_score", "min_health_score", "max_tool_wear_pct", "anomaly_count",
            "maintenance_urgency", "days_since_last_pm",
        )
    )


def health_trend(maintenance: DataFrame) -> DataFrame:
    """Day-grain health labelled with its ISO week."""
    return maintenance.orderBy("machine_id", "reading_year", "reading_week", "reading_date").select(
        "machine_id", "machine_name", "reading_week", "reading_year",
        rnd(F.col("avg_health_score"), 1).alias("avg_health_score"),
        rnd(F.col("avg_vibration"), 3).alias("avg_vibration_mm_s"),
        rnd(F.col("avg_temp_c"), 1).alias("avg_temp_celsius"),
        rnd(F.col("max_tool_wear_pct"), 1).alias("max_tool_wear_pct"),
        "anomaly_count", "maintenance_urgency",
    )


def pm_due(maintenance: DataFrame, days: int = PM_DUE_DAYS) -> DataFrame:
    """Machines whose last preventive maintenance lies more than ``days`` back."""
    return (
        maintenance.groupBy("machine_id", "machine_name", "machine_type", "work_center")
        .agg(
            F.max("days_since_last_pm").alias("days_since_last_pm"),
            _mean("avg_health_score").alias("recent_avg_health"),
            F.sum("anomaly_count").alias("total_anomalies_30d"),
            F.max("max_tool_wear_pct").alias("peak_tool_wear_pct"),
        )
        .filter(F.col("days_since_last_pm") > days)
        .orderBy(F.col("days_since_last_pm").desc(), "machine_id")
    )


# --- capacity --------------------------------------------------------------------


def capacity_monthly(capacity: DataFrame) -> DataFrame:
    return capacity.orderBy(
        F.col("period_month").desc(), F.col("capacity_utilization_pct").desc(), "work_center"
    ).select(
        month_label(F.col("period_month")).alias("month"),
        "work_center", "demand_hrs", "available_hrs", "farm_out_hrs",
        rnd(F.col("farm_out_cost_usd"), 2).alias("farm_out_cost_usd"),
        "machine_count",
        rnd(F.col("capacity_utilization_pct"), 1).alias("capacity_utilization_pct"),
        rnd(F.col("farm_out_rate_pct"), 1).alias("farm_out_rate_pct"),
        "load_status",
    )


def capacity_yearly(capacity: DataFrame) -> DataFrame:
    return (
        capacity.groupBy("period_year", "work_center")
        .agg(
            _total("demand_hrs", 0).alias("total_demand_hrs"),
            _mean("available_hrs", 0).alias("avg_available_hrs_per_month"),
            _total("farm_out_hrs", 0).alias("total_farm_out_hrs"),
            _total("farm_out_cost_usd", 0).alias("total_farm_out_cost"),
            _mean("capacity_utilization_pct").alias("avg_utilization_pct"),
            _mean("farm_out_rate_pct").alias("avg_farm_out_rate_pct"),
        )
        .orderBy(F.col("period_year").desc(), F.col("total_farm_out_cost").desc(), "work_center")
    )


def overloaded_centers(capacity: DataFrame) -> DataFrame:
    """Work centers by number of strained months (one gold row per center and month)."""
    return (
        capacity.filter(F.col("load_status").isin(*STRAINED))
        .groupBy("work_center")
        .agg(
            F.count("period_month").alias("months_overloaded"),
            _mean("capacity_utilization_pct").alias("avg_util_pct"),
            _total("farm_out_cost_usd", 0).alias("total_farm_out_cost"),
            rnd(F.sum("demand_hrs") - F.sum("available_hrs"), 0).alias("total_hrs_over_capacity"),
        )
        .orderBy(F.col("months_overloaded").desc(), F.col("total_farm_out_cost").desc(), "work_center")
    )


# --- farm-out --------------------------------------------------------------------


def vendor_cost(farmout: DataFrame) -> DataFrame:
    return (
        farmout.groupBy("farm_out_vendor")
        .agg(
            F.sum("farm_out_orders").alias("total_orders"),
            F.sum("total_qty_farmed").alias("total_qty"),
            _total("total_farm_out_cost", 0).alias("total_farm_out_cost"),
            _total("implied_internal_cost", 0).alias("total_internal_equivalent_cost"),
            _mean("cost_premium_pct").alias("avg_cost_premium_pct"),
        )
        .orderBy(F.col("total_farm_out_cost").desc(), "farm_out_vendor")
    )


def farmout_trend(farmout: DataFrame) -> DataFrame:
    return (
        farmout.groupBy("period_month")
        .agg(
            _total("total_farm_out_cost", 0).alias("total_farm_out_cost"),
            _total("implied_internal_cost", 0).alias("implied_internal_cost"),
            F.sum("farm_out_orders").alias("total_farm_out_orders"),
            F.sum("total_qty_farmed").alias("total_qty_farmed"),
        )
        .orderBy("period_month")
        .select(
            month_label(F.col("period_month")).alias("month"),
            "total_farm_out_cost", "implied_internal_cost", "total_farm_out_orders", "total_qty_farmed",
        )
    )


def top_parts(farmout: DataFrame, k: int = 10) -> DataFrame:
    return (
        farmout.groupBy("part_number", "part_description")
        .agg(
            F.sum("farm_out_orders").alias("total_farm_out_orders"),
            _total("total_farm_out_cost", 0).alias("total_farm_out_cost"),
            _mean("cost_premium_pct").alias("avg_premium_pct"),
            _total("equivalent_internal_hrs", 1).alias("total_internal_hrs_equivalent"),
        )
        .orderBy(F.col("total_farm_out_cost").desc(), "part_number", "part_description")
        .limit(k)
    )
