"""Dashboard datasets and the aggregates its widgets show.

Widgets aggregate the rounded dataset values, so each aggregate here starts from
the same rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millgauge.functions.health import urgency_order
from millgauge.functions.numeric import rnd
from millgauge.functions.periods import month_label
from millgauge.operators.latest import newest_rows
from millgauge.plans.analytics import latest_health

# --- datasets --------------------------------------------------------------------


def utilization_monthly(utilization: DataFrame) -> DataFrame:
    return utilization.orderBy("period_month", "machine_id", "period_day").select(
        month_label(F.col("period_month")).alias("month"),
        "machine_id",
        rnd(F.col("utilization_pct"), 1).alias("utilization_pct"),
        rnd(F.col("revenue_usd"), 0).alias("revenue_usd"),
        "work_order_count",
    )


def scheduling_monthly(scheduling: DataFrame) -> DataFrame:
    return scheduling.orderBy(F.col("period_month").desc(), "work_center", "period_week", "priority").select(
        month_label(F.col("period_month")).alias("month"),
        "work_center", "total_orders", "late_count", "farm_out_count",
        rnd(F.col("total_farm_out_cost"), 0).alias("farm_out_cost_usd"),
        rnd(F.col("on_time_delivery_pct"), 1).alias("otd_pct"),
    )


def health_snapshot(maintenance: DataFrame) -> DataFrame:
    return (
        latest_health(maintenance)
        .orderBy(urgency_order(F.col("maintenance_urgency")), "machine_id")
        .select(
            "machine_id", "machine_name", "work_center",
            rnd(F.col("avg_health_score"), 1).alias("avg_health_score"),
            rnd(F.col("max_tool_wear_pct"), 1).alias("max_tool_wear_pct"),
            "anomaly_count", "maintenance_urgency", "days_since_last_pm",
        )
    )


def capacity_monthly(capacity: DataFrame) -> DataFrame:
    return capacity.orderBy(F.col("period_month").desc(), "work_center").select(
        month_label(F.col("period_month")).alias("month"),
        "work_center",
        rnd(F.col("demand_hrs"), 0).alias("demand_hrs"),
        rnd(F.col("available_hrs"), 0).alias("available_hrs"),
        rnd(F.col("capacity_utilization_pct"), 1).alias("capacity_util_pct"),
        rnd(F.col("farm_out_cost_usd"), 0).alias("farm_out_cost_usd"),
        "load_status",
    )


def vendor_costs(farmout: DataFrame) -> DataFrame:
    return (
        farmout.groupBy("farm_out_vendor")
        .agg(
            F.sum("farm_out_orders").alias("total_orders"),
            rnd(F.sum("total_farm_out_cost"), 0).alias("total_farm_out_cost"),
            rnd(F.sum("implied_internal_cost"), 0).alias("implied_internal_cost"),
            rnd(F.avg("cost_premium_pct"), 1).alias("avg_cost_premium_pct"),
        )
        .orderBy(F.col("total_farm_out_cost").desc(), "farm_out_vendor")
    )


# --- utilization page ------------------------------------------------------------


def kpi_summary(utilization: DataFrame) -> DataFrame:
    """One row over all machines. Summing per machine first turns the distinct
    count into a plain count."""
    per_machine = utilization.groupBy("machine_id").agg(
        F.sum("utilization_pct").alias("utilization"),
        F.count("utilization_pct").alias("measured"),
        F.sum("revenue_usd").alias("revenue"),
        F.sum("work_order_count").alias("orders"),
    )
    return per_machine.agg(
        F.count("machine_id").alias("total_machines"),
        rnd(F.sum("utilization") / F.nullif(F.sum("measured"), F.lit(0)), 1).alias("avg_utilization_pct"),
        rnd(F.sum("revenue"), 0).alias("total_revenue_usd"),
        F.sum("orders").alias("total_work_orders"),
    )


def revenue_by_machine(utilization: DataFrame) -> DataFrame:
    return (
        utilization.groupBy("machine_id")
        .agg(rnd(F.sum("revenue_usd"), 0).alias("revenue"))
        .orderBy(F.col("revenue").desc(), "machine_id")
    )


def _by_month(df: DataFrame, **measures) -> DataFrame:
    grouped = df.groupBy("period_month").agg(*(m.alias(name) for name, m in measures.items()))
    return grouped.orderBy("period_month").select(month_label(F.col("period_month")).alias("month"), *measures)


def utilization_trend_fleet(utilization: DataFrame) -> DataFrame:
    return _by_month(utilization, avg_util=rnd(F.avg("utilization_pct"), 1))


# --- scheduling page -------------------------------------------------------------


def scheduling_kpis(scheduling: DataFrame) -> DataFrame:
    return scheduling.agg(
        F.sum("total_orders").alias("total_wo"),
        rnd(F.sum("total_farm_out_cost"), 0).alias("total_farmout"),
        rnd(F.avg("on_time_delivery_pct"), 1).alias("avg_otd"),
    )


def otd_trend(scheduling: DataFrame) -> DataFrame:
    return _by_month(scheduling, avg_otd=rnd(F.avg("on_time_delivery_pct"), 1))


def farmout_by_work_center(scheduling: DataFrame) -> DataFrame:
    return (
        scheduling.groupBy("work_center")
        .agg(rnd(F.sum("total_farm_out_cost"), 0).alias("farmout"))
        .orderBy(F.col("farmout").desc(), "work_center")
    )


# --- maintenance page ------------------------------------------------------------


def health_kpis(maintenance: DataFrame) -> DataFrame:
    return health_snapshot(maintenance).agg(
        rnd(F.avg("avg_health_score"), 1).alias("avg_health_score"),
        F.sum("anomaly_count").alias("total_anomalies"),
        rnd(F.avg("max_tool_wear_pct"), 1).alias("avg_tool_wear_pct"),
    )


def urgency_distribution(maintenance: DataFrame) -> DataFrame:
    return (
        latest_health(maintenance)
        .groupBy("maintenance_urgency")
        .agg(F.count("machine_id").alias("machines"))
        .orderBy(urgency_order(F.col("maintenance_urgency")))
    )


# --- capacity page ---------------------------------------------------------------


def capacity_kpis(capacity: DataFrame) -> DataFrame:
    return capacity_monthly(capacity).agg(
        rnd(F.avg("capacity_util_pct"), 1).alias("avg_capacity_util_pct"),
        rnd(F.sum("farm_out_cost_usd"), 0).alias("total_farm_out_cost"),
        rnd(F.sum("demand_hrs"), 0).alias("total_demand_hrs"),
    )


def demand_vs_capacity(capacity: DataFrame) -> DataFrame:
    return (
        capacity_monthly(capacity)
        .groupBy("work_center")
        .agg(F.sum("demand_hrs").alias("demand_hrs"), F.sum("available_hrs").alias("available_hrs"))
        .orderBy("work_center")
    )


def demand_vs_capacity_latest(capacity: DataFrame) -> DataFrame:
    monthly = capacity_monthly(capacity)
    return newest_rows(monthly, "month").select("month", "work_center", "demand_hrs", "available_hrs")


def load_status_distribution(capacity: DataFrame) -> DataFrame:
    return capacity.groupBy("load_status").agg(F.count("work_center").alias("center_months")).orderBy("load_status")


# --- farm-out page ---------------------------------------------------------------


def farmout_kpis(farmout: DataFrame) -> DataFrame:
    return vendor_costs(farmout).agg(
        F.sum("total_farm_out_cost").alias("total_farm_out_cost"),
        F.sum("implied_internal_cost").alias("implied_internal_cost"),
        rnd(F.avg("avg_cost_premium_pct"), 1).alias("avg_cost_premium_pct"),
    )
