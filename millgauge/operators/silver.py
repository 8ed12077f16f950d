"""Typed, derived and gated tables from the raw feeds.

Each function takes a bronze-shaped frame, text or already typed, keeps rows with
their key, and adds the derived columns. Rules are applied separately so that a
stream can observe them and a query can leave the counting out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.functions.casts import lenient, lenient_date, lenient_timestamp
from millgauge.functions.health import DEFAULT_LIMITS, HealthLimits, health_score
from millgauge.operators.quality import RULES, drop_violations

_INGEST = ("_ingested_at", "_source_file", "_file_ts")
DATE_FORMAT = "yyyy-MM-dd"
MOMENT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _keep(df: DataFrame, *names: str) -> list[Column]:
    """The named columns that the feed carries."""
    return [F.col(name) for name in names if name in df.columns]


def _numbers(df: DataFrame, target: str, *names: str) -> dict[str, Column]:
    return {name: lenient(df, name, target) for name in names}


def type_machines(feed: DataFrame) -> DataFrame:
    typed = feed.filter(F.col("machine_id").isNotNull()).withColumns(
        {
            **_numbers(feed, "int", "num_shifts", "installation_year", "preventive_maint_interval_hrs"),
            **_numbers(feed, "double", "capacity_hrs_per_shift", "hourly_rate_usd"),
            "last_pm_date": lenient_date(feed, "last_pm_date", DATE_FORMAT),
        }
    )
    return typed.select(
        "machine_id", "machine_name", "machine_type", "work_center", "num_shifts",
        "capacity_hrs_per_shift", "vendor", "installation_year", "status",
        "hourly_rate_usd", "preventive_maint_interval_hrs", "last_pm_date", "notes",
        (F.col("num_shifts") * F.col("capacity_hrs_per_shift")).alias("capacity_hrs_per_day"),
        *_keep(feed, *_INGEST),
    )


def type_routings(feed: DataFrame) -> DataFrame:
    keyed = feed.filter(F.col("routing_id").isNotNull() & F.col("part_number").isNotNull())
    typed = keyed.withColumns(
        {
            **_numbers(feed, "int", "operation_sequence"),
            **_numbers(feed, "double", "setup_time_hrs", "run_time_hrs_per_unit", "scrap_rate_pct"),
        }
    )
    return typed.select(
        "routing_id", "part_number", "part_description", "operation_sequence",
        "operation_code", "operation_description", "work_center", "preferred_machine_id",
        "setup_time_hrs", "run_time_hrs_per_unit", "scrap_rate_pct",
        *_keep(feed, *_INGEST),
    )


def type_work_orders(feed: DataFrame) -> DataFrame:
    moments = ("scheduled_start", "scheduled_end", "actual_start", "actual_end")
    keyed = feed.filter(F.col("work_order_id").isNotNull() & F.col("part_number").isNotNull())
    typed = keyed.withColumns(
        {
            **_numbers(feed, "int", "order_qty"),
            **_numbers(
                feed, "double",
                "setup_time_hrs", "run_time_hrs_per_unit", "actual_total_hrs", "farm_out_cost_usd",
            ),
            **{name: lenient_timestamp(feed, name, DATE_FORMAT) for name in moments},
            "due_date": lenient_date(feed, "due_date", DATE_FORMAT),
        }
    )
    # Late means finished after midnight at the start of the due day.
    overrun = (F.col("status") == "Complete") & (F.col("actual_end") > F.col("due_date").cast("timestamp"))
    standard = F.col("setup_time_hrs") + F.col("run_time_hrs_per_unit") * F.col("order_qty")
    return typed.select(
        "work_order_id", "part_number", *_keep(feed, "part_description"), "order_qty",
        "operation_code", "operation_description", "work_center", "machine_id",
        "due_date", *moments, "setup_time_hrs", "run_time_hrs_per_unit",
        "actual_total_hrs", "status", *_keep(feed, "priority"),
        "farm_out_vendor", "farm_out_cost_usd", "source_system",
        F.coalesce(F.col("status") == "Farm-Out", F.lit(False)).alias("is_farm_out"),
        F.coalesce(overrun, F.lit(False)).alias("is_late"),
        F.round(standard, 2).alias("standard_total_hrs"),
        *_keep(feed, *_INGEST),
    )


def type_sensor_data(feed: DataFrame, limits: HealthLimits = DEFAULT_LIMITS) -> DataFrame:
    measures = (
        "temperature_celsius", "vibration_mm_s", "spindle_speed_rpm",
        "power_consumption_kw", "coolant_flow_lpm", "tool_wear_pct",
    )
    keyed = feed.filter(F.col("sensor_id").isNotNull() & F.col("machine_id").isNotNull())
    typed = keyed.withColumns(
        {
            **_numbers(feed, "double", *measures),
            **_numbers(feed, "boolean", "anomaly_flag"),
            "reading_timestamp": lenient_timestamp(feed, "reading_timestamp", MOMENT_FORMAT),
        }
    )
    moment = F.col("reading_timestamp")
    score = health_score(
        wear=F.col("tool_wear_pct"),
        vibration=F.col("vibration_mm_s"),
        temperature=F.col("temperature_celsius"),
        coolant=F.col("coolant_flow_lpm"),
        machine_status=F.col("machine_status"),
        anomaly=F.col("anomaly_flag"),
        limits=limits,
    )
    return typed.select(
        "sensor_id", "machine_id", "reading_timestamp", *measures,
        "machine_status", "anomaly_flag", "anomaly_type",
        score.alias("health_score"),
        F.year(moment).alias("reading_year"),
        F.month(moment).alias("reading_month"),
        F.weekofyear(moment).alias("reading_week"),
        *_keep(feed, *_INGEST),
    )


TYPERS = {
    "machines": type_machines,
    "routings": type_routings,
    "work_orders": type_work_orders,
    "sensor_data": type_sensor_data,
}


def refine(feed_name: str, feed: DataFrame) -> DataFrame:
    """Typed rows of a feed that pass its DROP rules, without counting."""
    return drop_violations(TYPERS[feed_name](feed), RULES[f"silver_{feed_name}"])
