"""Named measures, filters and expressions, and the questions asked with them.

A definition is a function returning a Column, so the same one can be used in
any select, filter or aggregate. Anything relative to today takes ``as_of``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.functions.health import score_class
from millgauge.functions.numeric import percent, rnd, tally
from millgauge.functions.periods import month_label
from millgauge.operators.dispatch import is_active_order, priority_order
from millgauge.operators.gold import load_status
from millgauge.plans.analytics import latest_health

MEASURE, FILTER, EXPRESSION, AGGREGATE = "measure", "filter", "expression", "aggregate"


@dataclass(frozen=True)
class Definition:
    name: str
    kind: str
    build: Callable[..., Column]

    def column(self, **parameters) -> Column:
        return self.build(**parameters).alias(self.name)


def _days_since_last_pm(as_of: dt.date) -> Column:
    return F.datediff(F.lit(as_of), F.col("last_pm_date"))


def _premium() -> Column:
    return percent(F.col("total_farm_out_cost") - F.col("implied_internal_cost"), F.col("total_farm_out_cost"))


def _on_time_share() -> Column:
    complete = F.col("status") == "Complete"
    return percent(tally(complete & ~F.col("is_late")), tally(complete))


_DEFINITIONS = (
    Definition("utilization_pct_rounded", MEASURE, lambda: rnd(F.col("utilization_pct"), 1)),
    Definition("farm_out_rate_pct", MEASURE, lambda: percent(F.col("farm_out_hrs"), F.col("demand_hrs"))),
    Definition(
        "standard_total_hrs",
        MEASURE,
        lambda: rnd(F.col("setup_time_hrs") + F.col("run_time_hrs_per_unit") * F.col("order_qty"), 2),
    ),
    Definition("days_since_last_pm_calc", MEASURE, _days_since_last_pm),
    Definition("cost_premium_pct_calc", MEASURE, _premium),
    Definition("farm_out_orders", FILTER, lambda: F.col("is_farm_out")),
    Definition("late_orders", FILTER, lambda: F.col("is_late")),
    Definition("active_machines", FILTER, lambda: F.col("status") == "Active"),
    Definition("critical_health", FILTER, lambda: F.col("maintenance_urgency") == "Critical"),
    Definition("overloaded_wc", FILTER, lambda: F.col("load_status") == "Overloaded"),
    Definition("high_priority_orders", FILTER, lambda: F.col("priority") == "High"),
    Definition("health_category", EXPRESSION, lambda: score_class(F.col("avg_health_score"))),
    Definition("load_status_derived", EXPRESSION, lambda: load_status(F.col("demand_hrs"), F.col("available_hrs"))),
    Definition("month_display", EXPRESSION, lambda: month_label(F.col("period_month"))),
    Definition("otd_pct_computed", AGGREGATE, _on_time_share),
)

REGISTRY: dict[str, Definition] = {d.name: d for d in _DEFINITIONS}


def metric(name: str, **parameters) -> Column:
    """The named definition as an aliased column."""
    return REGISTRY[name].column(**parameters)


def where(df: DataFrame, *names: str) -> DataFrame:
    """Rows that satisfy every named filter."""
    for name in names:
        if REGISTRY[name].kind != FILTER:
            raise ValueError(f"{name} is a {REGISTRY[name].kind}, not a filter")
        df = df.filter(REGISTRY[name].build())
    return df


# --- questions -------------------------------------------------------------------


def critical_machines(maintenance: DataFrame) -> DataFrame:
    """Machines in critical condition on their newest day."""
    return (
        where(latest_health(maintenance), "critical_health")
        .orderBy("avg_health_score", "machine_id")
        .select(
            "machine_id", "machine_name", "work_center",
            rnd(F.col("avg_health_score"), 1).alias("health_score"),
            rnd(F.col("max_tool_wear_pct"), 1).alias("tool_wear_pct"),
            "anomaly_count", "maintenance_urgency", "days_since_last_pm",
        )
    )


def otd_by_work_center_year(scheduling: DataFrame, as_of: dt.date) -> DataFrame:
    return (
        scheduling.filter(F.col("period_year") == as_of.year)
        .groupBy("work_center")
        .agg(
            F.sum("total_orders").alias("total_orders"),
            F.sum("late_count").alias("late_orders"),
            rnd(F.avg("on_time_delivery_pct"), 1).alias("avg_otd_pct"),
            rnd(F.sum("total_farm_out_cost"), 0).alias("farm_out_cost"),
        )
        .orderBy("avg_otd_pct", "work_center")
    )


def work_order_detail(work_orders: DataFrame) -> DataFrame:
    return work_orders.orderBy("due_date", F.col("priority").desc(), "work_order_id").select(
        "work_order_id", "part_number", "part_description", "work_center", "machine_id",
        F.date_format("due_date", "yyyy-MM-dd").alias("due_date"),
        "status", "priority", "is_farm_out", "is_late", "farm_out_vendor",
        rnd(F.col("farm_out_cost_usd"), 2).alias("farm_out_cost"),
    )


def open_orders_by_work_center(work_orders: DataFrame) -> DataFrame:
    return (
        work_orders.filter(is_active_order())
        .groupBy("work_center")
        .agg(F.count(F.lit(1)).alias("open_orders"), rnd(F.sum("standard_total_hrs"), 2).alias("open_hrs"))
        .orderBy(F.col("open_orders").desc(), "work_center")
    )


def orders_due_within(
    work_orders: DataFrame, as_of: dt.date, days: int = 7, priority: str | None = "High"
) -> DataFrame:
    """Active orders due from ``as_of`` on, within the given days."""
    until = as_of + dt.timedelta(days=days - 1)
    due = work_orders.filter(is_active_order() & F.col("due_date").between(F.lit(as_of), F.lit(until)))
    if priority is not None:
        due = due.filter(F.col("priority") == priority)
    return due.orderBy("due_date", priority_order(), "work_order_id").select(
        "work_order_id", "part_number", "work_center", "machine_id", "due_date", "status", "priority"
    )


def scheduled_vs_actual(utilization: DataFrame, as_of: dt.date) -> DataFrame:
    """Scheduled and worked hours per machine in the month of ``as_of``."""
    month = dt.datetime(as_of.year, as_of.month, 1)
    return (
        utilization.filter(F.col("period_month") == F.lit(month.isoformat(sep=" ")).cast("timestamp"))
        .groupBy("machine_id")
        .agg(
            rnd(F.sum("scheduled_hrs"), 2).alias("scheduled_hrs"),
            rnd(F.sum("actual_hrs"), 2).alias("actual_hrs"),
            rnd(F.sum("actual_hrs") - F.sum("scheduled_hrs"), 2).alias("difference_hrs"),
        )
        .orderBy("machine_id")
    )


def late_orders(work_orders: DataFrame) -> DataFrame:
    return (
        where(work_orders, "late_orders")
        .orderBy(priority_order(), "due_date", "work_order_id")
        .select("work_order_id", "part_number", "work_center", "priority", "due_date", "actual_end")
    )


def otd_last_months(scheduling: DataFrame, as_of: dt.date, months: int = 12) -> DataFrame:
    """On-time delivery per month for the months up to that of ``as_of``."""
    newest = F.trunc(F.lit(as_of), "MONTH")
    inside = F.col("period_month").cast("date").between(F.add_months(newest, 1 - months), newest)
    return (
        scheduling.filter(inside)
        .groupBy("period_month")
        .agg(
            rnd(F.avg("on_time_delivery_pct"), 1).alias("avg_otd_pct"),
            F.sum("completed_count").alias("completed"),
            F.sum("late_count").alias("late"),
        )
        .orderBy("period_month")
        .select(metric("month_display").alias("month"), "avg_otd_pct", "completed", "late")
    )


def top_utilization_year(utilization: DataFrame, as_of: dt.date, k: int = 10) -> DataFrame:
    return (
        utilization.filter(F.col("period_year") == as_of.year)
        .groupBy("machine_id")
        .agg(rnd(F.avg("utilization_pct"), 1).alias("avg_utilization_pct"))
        .orderBy(F.col("avg_utilization_pct").desc(), "machine_id")
        .limit(k)
    )


def vendor_cost_year(farmout: DataFrame, as_of: dt.date) -> DataFrame:
    return (
        farmout.filter(F.col("period_year") == as_of.year)
        .groupBy("farm_out_vendor")
        .agg(
            F.sum("farm_out_orders").alias("total_orders"),
            rnd(F.sum("total_farm_out_cost"), 0).alias("total_farm_out_cost"),
        )
        .orderBy(F.col("total_farm_out_cost").desc(), "farm_out_vendor")
    )
