"""The four feeds derived from the supplied order, part, supplier and event tables.

One supplier is one machine, one part has three routing steps, one order line is
one work order and one event is one sensor reading. Columns come out typed, so
the typing step downstream passes them through without parsing. The mappings are
written as SQL expressions, one per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six work centers with the machine type of each, the routing
# operations, and the anomaly names.
WORK_CENTERS = ("WC-MILL", "WC-TURN", "WC-DRILL", "WC-MULTITASK", "WC-TRANSFER", "WC-QC")
MACHINE_TYPES = (
    "Machining Center", "CNC Lathe", "Drilling Center",
    "Multitask Machine", "Transfer Line", "Measuring Machine",
)
OPERATIONS = ("Roughing", "Finishing", "Inspection")
ANOMALIES = ("High Temperature", "Excessive Vibration", "High Tool Wear", "Low Coolant Flow")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: tuple[str, ...], position: str) -> str:
    """Element of a short fixed list at a zero-based position."""
    listed = ", ".join(f"'{value}'" for value in values)
    return f"element_at(array({listed}), cast(({position}) + 1 AS int))"


def _padded(key: str) -> str:
    """At least three digits; longer keys keep all of theirs."""
    text = f"cast({key} AS string)"
    return f"CASE WHEN {key} < 1000 THEN lpad({text}, 3, '0') ELSE {text} END"


def machine_id_of(key: str) -> str:
    return f"concat('MCH-', {_padded(key)})"


def _machine_total(spark: SparkSession, folder: str) -> Column:
    """Number of machines, as a scalar subquery evaluated once per query."""
    return table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()


def machines(spark: SparkSession, folder: str) -> DataFrame:
    # One row per nation, said so that the optimizer can leave the join out where
    # the vendor is not read.
    nation = table(spark, folder, "nation").dropDuplicates(["n_nationkey"])
    supplier = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return supplier.join(nation, "n_nationkey", "left").selectExpr(
        f"{machine_id_of('s_suppkey')} AS machine_id",
        "s_name AS machine_name",
        f"{_pick(MACHINE_TYPES, 's_suppkey % 6')} AS machine_type",
        f"{_pick(WORK_CENTERS, 's_suppkey % 6')} AS work_center",
        "cast(1 + s_suppkey % 3 AS int) AS num_shifts",
        "8D AS capacity_hrs_per_shift",
        "n_name AS vendor",
        "cast(1998 + s_suppkey % 25 AS int) AS installation_year",
        "CASE s_suppkey % 12 WHEN 7 THEN 'Maintenance' WHEN 11 THEN 'Idle' ELSE 'Active' END AS status",
        "s_acctbal / 100 AS hourly_rate_usd",
        "cast(500 + 250 * (s_suppkey % 3) AS int) AS preventive_maint_interval_hrs",
        "date_add(date'2023-01-01', cast(s_suppkey * 37 % 365 AS int)) AS last_pm_date",
        "concat('In service since ', cast(1998 + s_suppkey % 25 AS string)) AS notes",
    )


def routings(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "part").selectExpr("p_partkey", "p_name", "p_size", "explode(array(1, 2, 3)) AS step")
    preferred = (F.col("p_partkey") + F.col("step")) % _machine_total(spark, folder)
    return steps.withColumn("machine_key", preferred).selectExpr(
        "concat_ws('-', 'RTG', p_partkey, step) AS routing_id",
        "concat('PN-', p_partkey) AS part_number",
        "p_name AS part_description",
        "10 * step AS operation_sequence",
        "concat('OP-0', 10 * step) AS operation_code",
        f"{_pick(OPERATIONS, 'step - 1')} AS operation_description",
        f"{_pick(WORK_CENTERS, 'machine_key % 6')} AS work_center",
        f"{machine_id_of('machine_key')} AS preferred_machine_id",
        "0.5D AS setup_time_hrs",
        "0.5D + (p_partkey % 3) * 0.25D AS run_time_hrs_per_unit",
        "p_size / 2D - 1 AS scrap_rate_pct",
    )


# A line's state comes from its two flags; what follows from state, ship day and
# quantity is worked out once.
_LINE_STATE = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Farm-Out'
    WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Open'
    WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'In Progress'
    ELSE 'Complete' END AS status"""
_PRIORITY = """CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'High'
    WHEN substring(o_orderpriority, 1, 1) = '3' THEN 'Medium'
    WHEN substring(o_orderpriority, 1, 1) IN ('4', '5') THEN 'Low' END AS priority"""


def work_orders(
    spark: SparkSession, folder: str, priority: bool = True, description: bool = True
) -> DataFrame:
    """One row per order line.

    Priority lives on the order and the part description on the part. Both keys
    are unique there, so leaving either join out changes no other column and no
    row; a caller that does not need the column saves shuffling every line.
    """
    # What the joins shuffle: a line's keys, and of the rest what is needed further on. The
    # cost is null unless farmed out; prices and discounts, of all lines, hardly compress.
    states = table(spark, folder, "lineitem").selectExpr("*", _LINE_STATE)
    lines = states.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "status",
        "cast(l_shipdate AS date) AS ship",
        "cast(l_quantity AS int) AS quantity",
        """CASE WHEN status = 'Farm-Out'
            THEN round(round(l_extendedprice * (1 - l_discount) / 12, 6), 2) END AS cost""",
    )
    if priority:
        order = table(spark, folder, "orders").selectExpr("o_orderkey AS l_orderkey", _PRIORITY)
        lines = lines.join(order, "l_orderkey", "left")
    if description:
        part = table(spark, folder, "part").selectExpr("p_partkey AS l_partkey", "p_name")
        lines = lines.join(part, "l_partkey", "left")
    prepared = lines.selectExpr(
        "*",
        "0.5D + (l_partkey % 3) * 0.25D AS run_hrs",
        "date_add(ship, cast(3 + l_partkey % 12 AS int)) AS due",
    )
    return prepared.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(cast(ship AS string), '-', '')) AS work_order_id",
        "concat('PN-', l_partkey) AS part_number",
        *(["p_name AS part_description"] if description else []),
        "quantity AS order_qty",
        "concat('OP-0', 10 * (l_linenumber % 3 + 1)) AS operation_code",
        f"{_pick(OPERATIONS, 'l_linenumber % 3')} AS operation_description",
        f"{_pick(WORK_CENTERS, 'l_suppkey % 6')} AS work_center",
        f"CASE WHEN status <> 'Farm-Out' THEN {machine_id_of('l_suppkey')} END AS machine_id",
        "due AS due_date",
        "ship AS scheduled_start",
        "date_add(ship, cast(1 + l_partkey % 3 AS int)) AS scheduled_end",
        "CASE WHEN status IN ('Complete', 'In Progress') THEN ship END AS actual_start",
        "CASE WHEN status = 'Complete' THEN date_add(due, cast(l_orderkey % 10 - 7 AS int)) END AS actual_end",
        "0.5D AS setup_time_hrs",
        "run_hrs AS run_time_hrs_per_unit",
        "CASE WHEN status = 'Complete' THEN (0.5D + run_hrs * quantity) * (0.75D + (l_linenumber % 3) * 0.25D) END AS actual_total_hrs",
        "status",
        *(["priority"] if priority else []),
        "CASE WHEN status = 'Farm-Out' THEN concat('VENDOR-', l_partkey % 4) END AS farm_out_vendor",
        "cost AS farm_out_cost_usd",
        "'ERP' AS source_system",
    )


def sensor_data(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.withColumn("machine_key", F.col("user_id") % _machine_total(spark, folder)).selectExpr(
        "cast(event_id AS string) AS sensor_id",
        f"{machine_id_of('machine_key')} AS machine_id",
        "date_trunc('SECOND', cast(ts AS timestamp)) AS reading_timestamp",
        "20D + 0.35D * value AS temperature_celsius",
        "value / 40 AS vibration_mm_s",
        "cast(800 + event_id % 2700 AS double) AS spindle_speed_rpm",
        "cast(10 + event_id % 35 AS double) AS power_consumption_kw",
        "cast(event_id % 16 AS double) AS coolant_flow_lpm",
        "try_cast(get_json_object(props, '$.k') AS double) AS tool_wear_pct",
        "CASE WHEN event_type = 'view' THEN 'Idle' ELSE 'Running' END AS machine_status",
        "event_type = 'error' AS anomaly_flag",
        f"CASE WHEN event_type = 'error' THEN {_pick(ANOMALIES, 'event_id % 4')} END AS anomaly_type",
    )


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text failure reports, one per error event."""
    errors = table(spark, folder, "events").filter("event_type = 'error'")
    return errors.withColumn("machine_key", F.col("user_id") % _machine_total(spark, folder)).selectExpr(
        "event_id AS incident_id",
        "cast(ts AS timestamp) AS reported_at",
        f"concat('Machine mch ', {_padded('machine_key')}, ' is down') AS report_text",
    )
