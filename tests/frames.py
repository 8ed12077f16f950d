"""Small frames in the shape of the silver tables, with defaults for the rest."""

import datetime as dt

from pyspark.sql import types as T

TYPES = {
    "work_order_id": "string", "part_number": "string", "part_description": "string", "order_qty": "int",
    "operation_code": "string", "operation_description": "string", "work_center": "string",
    "machine_id": "string", "due_date": "date", "scheduled_start": "timestamp", "scheduled_end": "timestamp",
    "actual_start": "timestamp", "actual_end": "timestamp", "setup_time_hrs": "double",
    "run_time_hrs_per_unit": "double", "actual_total_hrs": "double", "status": "string", "priority": "string",
    "farm_out_vendor": "string", "farm_out_cost_usd": "double", "source_system": "string",
    "is_farm_out": "boolean", "is_late": "boolean", "standard_total_hrs": "double",
    "machine_name": "string", "machine_type": "string", "num_shifts": "int", "capacity_hrs_per_shift": "double",
    "vendor": "string", "installation_year": "int", "hourly_rate_usd": "double",
    "preventive_maint_interval_hrs": "int", "last_pm_date": "date", "notes": "string",
    "capacity_hrs_per_day": "double", "sensor_id": "string", "reading_timestamp": "timestamp",
    "temperature_celsius": "double", "vibration_mm_s": "double", "spindle_speed_rpm": "double",
    "power_consumption_kw": "double", "coolant_flow_lpm": "double", "tool_wear_pct": "double",
    "machine_status": "string", "anomaly_flag": "boolean", "anomaly_type": "string", "health_score": "int",
}

WORK_ORDER = dict(
    work_order_id="WO-1", part_number="PN-1", part_description="gear", order_qty=10, operation_code="OP-010",
    operation_description="Roughing", work_center="WC-MILL", machine_id="MCH-001", due_date=dt.date(2024, 3, 6),
    scheduled_start=dt.datetime(2024, 3, 4), scheduled_end=dt.datetime(2024, 3, 5), actual_start=None,
    actual_end=None, setup_time_hrs=0.5, run_time_hrs_per_unit=0.25, actual_total_hrs=None, status="Open",
    priority="High", farm_out_vendor=None, farm_out_cost_usd=None, source_system="ERP", is_farm_out=False,
    is_late=False, standard_total_hrs=3.0,
)
MACHINE = dict(
    machine_id="MCH-001", machine_name="Mill", machine_type="Machining Center", work_center="WC-MILL", num_shifts=1,
    capacity_hrs_per_shift=8.0, vendor="V", installation_year=2015, status="Active", hourly_rate_usd=50.0,
    preventive_maint_interval_hrs=500, last_pm_date=dt.date(2024, 1, 1), notes=None, capacity_hrs_per_day=8.0,
)
READING = dict(
    sensor_id="S-1", machine_id="MCH-001", reading_timestamp=dt.datetime(2024, 3, 4, 10), temperature_celsius=40.0,
    vibration_mm_s=1.0, spindle_speed_rpm=1000.0, power_consumption_kw=10.0, coolant_flow_lpm=5.0,
    tool_wear_pct=10.0, machine_status="Running", anomaly_flag=False, anomaly_type=None, health_score=100,
)


def frame(spark, defaults, rows):
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(TYPES[c])) for c in defaults])
    data = [tuple({**defaults, **row}[c] for c in defaults) for row in rows]
    return spark.createDataFrame(data, schema)


def work_orders(spark, *rows):
    return frame(spark, WORK_ORDER, rows)


def machines(spark, *rows):
    return frame(spark, MACHINE, rows)


def readings(spark, *rows):
    return frame(spark, READING, rows)


def text_feed(spark, feed, *rows):
    """Rows of a landing feed, every column as text."""
    from millgauge.sources.schemas import landing_schema

    schema = landing_schema(feed)
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema)
