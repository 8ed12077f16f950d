"""Figures at their true grain: months, years and totals from additive parts, and hours by routing.

Sums and counts are combined up the periods and ratios formed last, so a year's rate is
that of its orders and not a mean of its months' rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.functions.numeric import percent, rnd, tally
from millgauge.functions.periods import month_of


def _levels(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """The parts, already one row per finest key, summed for every level of the keys.

    The rows that the levels multiply are those of the finest one, not the table's.
    """
    level = F.grouping_id().cast("int").alias("grouping_id")
    return parts.rollup(*keys).agg(level, *(F.sum(name).alias(name) for name in sums))


def kpi_rollup(work_orders: DataFrame) -> DataFrame:
    """Orders, lateness and farm-out by due year, month and work center, with subtotals.

    ``grouping_id`` is 0 for a work center's month, 1 for a month, 3 for a year and 7
    for all, which tells a subtotal from a null key.
    """
    complete = F.col("status") == "Complete"
    due = F.col("due_date")
    sums = {
        "total_orders": F.count(F.lit(1)),
        "completed": tally(complete),
        "on_time": tally(complete & ~F.col("is_late")),
        "farm_out": tally(F.col("is_farm_out")),
        "standard": F.sum(F.coalesce("standard_total_hrs", F.lit(0.0))),
        "actual": F.sum(F.when(complete, F.col("actual_total_hrs")).otherwise(0.0)),
    }
    parts = (
        work_orders.where(due.isNotNull())
        .groupBy(F.year(due).alias("period_year"), month_of(due).alias("period_month"), "work_center")
        .agg(*(column.alias(name) for name, column in sums.items()))
    )
    return _levels(parts, ["period_year", "period_month", "work_center"], list(sums)).select(
        "grouping_id", "period_year", "period_month", "work_center", "total_orders", "completed",
        rnd(F.col("standard"), 2).alias("standard_hrs"),
        rnd(F.col("actual"), 2).alias("completed_hrs"),
        percent(F.col("on_time"), F.col("completed")).alias("on_time_delivery_pct"),
        percent(F.col("farm_out"), F.col("total_orders")).alias("farm_out_pct"),
    )


def utilization_rollup(utilization: DataFrame) -> DataFrame:
    """Scheduled against available hours by machine, year and month, with subtotals.

    Available are the hours of the days a machine has orders scheduled on.
    """
    sums = ["scheduled", "available", "orders", "revenue"]
    parts = utilization.groupBy("machine_id", "period_year", "period_month").agg(
        F.sum("scheduled_hrs").alias("scheduled"),
        F.sum("capacity_hrs_per_day").alias("available"),
        F.sum("work_order_count").alias("orders"),
        F.sum("revenue_usd").alias("revenue"),
    )
    return _levels(parts, ["machine_id", "period_year", "period_month"], sums).select(
        "grouping_id", "machine_id", "period_year", "period_month",
        F.col("orders").alias("work_order_count"),
        rnd(F.col("scheduled"), 2).alias("scheduled_hrs"),
        rnd(F.col("revenue"), 2).alias("revenue_usd"),
        percent(F.col("scheduled"), F.col("available")).alias("utilization_pct"),
    )


def with_routing(work_orders: DataFrame, routings: DataFrame) -> DataFrame:
    """Orders with the hours their part's routing gives, and how it was found.

    ``routing_match`` is ``operation`` if a step of the part has the order's operation
    code, ``part`` if only others exist, whose first one then counts, and ``none``. Of
    several steps the one with the lowest sequence and id is taken. The few steps of a
    part are one row, so the join adds no rows to the orders.
    """
    step = F.struct("operation_sequence", "routing_id", "operation_code", "setup_time_hrs", "run_time_hrs_per_unit")
    by_part = (
        routings.where(F.col("part_number").isNotNull())
        .groupBy(F.col("part_number").alias("routed_part"))
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
    )
    joined = work_orders.join(by_part, F.col("part_number") == F.col("routed_part"), "left")
    same = F.filter("steps", lambda s: s["operation_code"] == F.col("operation_code"))
    exact: Column = F.size(same) > 0
    chosen = F.when(exact, F.get(same, F.lit(0))).otherwise(F.get("steps", F.lit(0)))
    match = F.when(exact, "operation").when(F.col("steps").isNotNull(), "part").otherwise("none")
    hours = F.col("_step.setup_time_hrs") + F.col("_step.run_time_hrs_per_unit") * F.col("order_qty")
    return (
        joined.withColumns({"_step": chosen, "routing_match": match})
        .withColumn("routing_hrs", F.round(hours, 2))
        .drop("_step", "steps", "routed_part")
    )


def routing_hours_variance(work_orders: DataFrame, routings: DataFrame) -> DataFrame:
    """Standard hours of orders against their routings' per work center and kind of match; unmatched orders are counted."""
    return (
        with_routing(work_orders, routings)
        .groupBy("work_center", "routing_match")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("standard_total_hrs").alias("standard"), F.sum("routing_hrs").alias("routing"))
        .select(
            "work_center", "routing_match", "orders",
            rnd(F.col("standard"), 2).alias("standard_hrs"),
            rnd(F.col("routing"), 2).alias("routing_hrs"),
            percent(F.col("standard") - F.col("routing"), F.col("routing")).alias("variance_pct"),
        )
    )
