"""Column lists of the four feeds and the schemas used to read them from text.

A streaming CSV source needs its schema up front. Every column is read as text,
so a malformed number reaches the quality rules instead of vanishing in the
parser; typing happens in :mod:`millgauge.operators.silver`.
"""

from __future__ import annotations

from pyspark.sql import types as T

FEED_COLUMNS: dict[str, tuple[str, ...]] = {
    "machines": (
        "machine_id", "machine_name", "machine_type", "work_center", "num_shifts",
        "capacity_hrs_per_shift", "vendor", "installation_year", "status",
        "hourly_rate_usd", "preventive_maint_interval_hrs", "last_pm_date", "notes",
    ),
    "routings": (
        "routing_id", "part_number", "part_description", "operation_sequence",
        "operation_code", "operation_description", "work_center",
        "preferred_machine_id", "setup_time_hrs", "run_time_hrs_per_unit",
        "scrap_rate_pct",
    ),
    "work_orders": (
        "work_order_id", "part_number", "part_description", "order_qty",
        "operation_code", "operation_description", "work_center", "machine_id",
        "due_date", "scheduled_start", "scheduled_end", "actual_start", "actual_end",
        "setup_time_hrs", "run_time_hrs_per_unit", "actual_total_hrs", "status",
        "priority", "farm_out_vendor", "farm_out_cost_usd", "source_system",
    ),
    "sensor_data": (
        "sensor_id", "machine_id", "reading_timestamp", "temperature_celsius",
        "vibration_mm_s", "spindle_speed_rpm", "power_consumption_kw",
        "coolant_flow_lpm", "tool_wear_pct", "machine_status", "anomaly_flag",
        "anomaly_type",
    ),
}

FEEDS = tuple(FEED_COLUMNS)

# What a file brought beyond the feed's columns, by name.
RESCUED = "_rescued_data"

# Only the machine master keeps the time its file was written: it is re-delivered
# whole, and the newest delivery of a machine wins.
_INGEST_FIELDS = [
    T.StructField("_ingested_at", T.TimestampType()),
    T.StructField("_source_file", T.StringType()),
    T.StructField(RESCUED, T.MapType(T.StringType(), T.StringType())),
]
_FILE_TIME_FIELD = T.StructField("_file_ts", T.TimestampType())


def landing_schema(feed: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in FEED_COLUMNS[feed]])


def bronze_schema(feed: str) -> T.StructType:
    extra = list(_INGEST_FIELDS) + ([_FILE_TIME_FIELD] if feed == "machines" else [])
    return T.StructType(landing_schema(feed).fields + extra)
