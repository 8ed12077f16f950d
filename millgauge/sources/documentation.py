"""Table and column descriptions, carried as schema metadata and as comments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_COMMENTS: dict[str, str] = {
    "silver_machines": "Machine master: one typed row per delivered machine record.",
    "silver_routings": "Routing steps: which operation a part needs, where, and for how long.",
    "silver_work_orders": "Work orders with lateness, farm-out flag and standard hours.",
    "silver_sensor_data": "Sensor readings with a health score per reading.",
    "gold_machine_utilization": "Scheduled and worked hours against capacity per machine and day.",
    "gold_scheduling_performance": "Order counts, lateness and on-time delivery per due week, center and priority.",
    "gold_predictive_maintenance": "Sensor condition and maintenance urgency per machine and day.",
    "gold_capacity_planning": "Demand against available hours per work center and month.",
    "gold_farmout_analysis": "Outsourced work per vendor, part and month against doing it in-house.",
}

# One description per column name; a name means the same in every table.
COLUMN_COMMENTS: dict[str, str] = {
    "_ingested_at": "When the row entered the bronze table.",
    "_source_file": "Landing file the row came from.",
    "actual_end": "When work finished.",
    "actual_hrs": "Hours worked; 0 when none were booked.",
    "actual_start": "When work began.",
    "actual_total_hrs": "Hours booked on the completed order.",
    "anomaly_count": "Readings flagged as anomalous.",
    "anomaly_flag": "Whether the controller flagged the reading.",
    "anomaly_type": "Kind of anomaly, if flagged.",
    "available_hrs": "Monthly hours of the center's active machines.",
    "avg_actual_hrs": "Mean booked hours of completed orders.",
    "avg_coolant_lpm": "Mean coolant flow in litres per minute.",
    "avg_cost_per_order": "Mean vendor charge per order in USD.",
    "avg_health_score": "Mean health score of the day.",
    "avg_power_kw": "Mean power draw in kW.",
    "avg_spindle_rpm": "Mean spindle speed in rpm.",
    "avg_temp_c": "Mean temperature in degrees Celsius.",
    "avg_vibration": "Mean vibration in mm/s.",
    "capacity_hrs_per_day": "Shifts times hours per shift.",
    "capacity_hrs_per_shift": "Productive hours of one shift.",
    "capacity_utilization_pct": "Demand as a share of available hours.",
    "completed_count": "Orders completed.",
    "coolant_flow_lpm": "Coolant flow in litres per minute.",
    "cost_premium_pct": "Vendor cost above in-house cost, as a share of vendor cost.",
    "days_since_last_pm": "Days from the last preventive maintenance to the reading day; negative if it came later.",
    "demand_hrs": "Standard hours scheduled in the month.",
    "due_date": "Day the order is due.",
    "efficiency_pct": "Scheduled as a share of worked hours; null when nothing was worked.",
    "equivalent_internal_hrs": "Standard hours the outsourced orders would take in-house.",
    "farm_out_cost_usd": "Vendor charge in USD.",
    "farm_out_count": "Orders given to a vendor.",
    "farm_out_hrs": "Standard hours given to vendors.",
    "farm_out_orders": "Orders given to the vendor.",
    "farm_out_rate_pct": "Outsourced share of demand hours.",
    "farm_out_vendor": "Vendor of an outsourced order.",
    "health_score": "100 less penalty points for wear, vibration, heat, coolant and anomaly.",
    "hourly_rate_usd": "Machine cost per hour in USD.",
    "implied_internal_cost": "In-house hours at the blended internal rate in USD.",
    "installation_year": "Year the machine entered service.",
    "is_farm_out": "Whether the order went to a vendor.",
    "is_late": "Completed after the start of its due day.",
    "last_pm_date": "Day of the last preventive maintenance.",
    "late_count": "Orders completed late.",
    "load_status": "Load class of the center's month.",
    "machine_count": "Active machines in the center.",
    "machine_id": "Machine key; null on outsourced orders.",
    "machine_name": "Name of the machine.",
    "machine_status": "What the machine was doing at the reading.",
    "machine_type": "Kind of machine.",
    "machines_used": "Machines with scheduled orders in the month.",
    "maintenance_urgency": "Critical, Warning or Normal.",
    "max_temp_c": "Highest temperature in degrees Celsius.",
    "max_tool_wear_pct": "Highest tool wear in percent.",
    "max_vibration": "Highest vibration in mm/s.",
    "min_health_score": "Lowest health score of the day.",
    "notes": "Free text on the machine.",
    "num_shifts": "Shifts run per day.",
    "on_time_delivery_pct": "Share of completed orders that were not late; null if none completed.",
    "operation_code": "Operation key.",
    "operation_description": "What the operation does.",
    "operation_sequence": "Position of the step in the routing.",
    "order_qty": "Pieces ordered.",
    "part_description": "Name of the part.",
    "part_number": "Part key.",
    "period_day": "Day of the scheduled start.",
    "period_month": "First day of the month.",
    "period_week": "Monday of the week.",
    "period_year": "Calendar year.",
    "power_consumption_kw": "Power draw in kW.",
    "preferred_machine_id": "Machine the step is planned for.",
    "preventive_maint_interval_hrs": "Hours between preventive maintenance.",
    "priority": "High, Medium or Low.",
    "reading_date": "Day of the readings.",
    "reading_month": "Calendar month of the reading.",
    "reading_timestamp": "When the reading was taken.",
    "reading_week": "ISO week of the reading.",
    "reading_year": "Calendar year of the reading.",
    "revenue_usd": "Hours worked, or else scheduled, at the machine's rate.",
    "routing_id": "Routing step key.",
    "run_time_hrs_per_unit": "Run hours per piece.",
    "scheduled_end": "Planned end.",
    "scheduled_hrs": "Standard hours scheduled on the day.",
    "scheduled_start": "Planned start.",
    "scrap_rate_pct": "Expected scrap in percent.",
    "sensor_id": "Reading key.",
    "sensor_readings": "Readings taken on the day.",
    "setup_time_hrs": "Setup hours.",
    "source_system": "System the order came from.",
    "spindle_speed_rpm": "Spindle speed in rpm.",
    "standard_total_hrs": "Setup plus run hours for the whole quantity.",
    "status": "State of the machine or order.",
    "temperature_celsius": "Temperature in degrees Celsius.",
    "tool_wear_pct": "Tool wear in percent.",
    "total_farm_out_cost": "Vendor charges in USD.",
    "total_orders": "Orders due.",
    "total_qty_farmed": "Pieces ordered from the vendor.",
    "total_standard_hrs": "Standard hours of the orders due.",
    "utilization_pct": "Scheduled hours as a share of the day's capacity.",
    "vendor": "Maker of the machine.",
    "vibration_mm_s": "Vibration in mm/s.",
    "work_center": "Work center code.",
    "work_order_count": "Orders scheduled.",
    "work_order_id": "Order key.",
}


def documented(df: DataFrame, comments: Mapping[str, str] = COLUMN_COMMENTS) -> DataFrame:
    """The frame with comments on the columns that have one; others stay as they are."""
    described = []
    for field in df.schema.fields:
        if field.name in comments:
            metadata = {**field.metadata, "comment": comments[field.name]}
            described.append(F.col(field.name).alias(field.name, metadata=metadata))
        else:
            described.append(F.col(field.name))
    return df.select(*described)


def undocumented(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if "comment" not in field.metadata]


def dictionary(df: DataFrame, table: str) -> DataFrame:
    """One row per column: whether it is documented and how many rows fill it.

    Counts come from one pass over the table, then turn into rows.
    """
    noted = documented(df)
    missing = set(undocumented(noted))
    counts = noted.agg(*(F.count(F.col(c)).alias(c) for c in noted.columns))
    entries = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(c not in missing).alias("documented"),
            F.col(c).alias("filled_rows"),
        )
        for c in noted.columns
    ]
    return counts.select(F.inline(F.array(*entries)))


def quoted(text: str) -> str:
    """The text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def comment_on(spark: SparkSession, table: str, comments: Mapping[str, str] = COLUMN_COMMENTS) -> int:
    """Put the descriptions on a catalog table; returns how many columns matched."""
    name = table.split(".")[-1].strip("`")
    if name in TABLE_COMMENTS:
        spark.sql(f"COMMENT ON TABLE {table} IS {quoted(TABLE_COMMENTS[name])}")
    matched = [c for c in spark.table(table).columns if c in comments]
    for column in matched:
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{column}` COMMENT {quoted(comments[column])}")
    return len(matched)


def create_schema(spark: SparkSession, schema: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
