"""DuckDB definitions of the staged, silver and gold tables, as named CTEs.

Written independently of the Spark code: filters in aggregates, list indexing and
window clauses of DuckDB are used where they state the meaning most directly.
"""

from __future__ import annotations

import re


def rnd(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,6)), {digits}) AS DOUBLE)"


CENTERS = "['WC-MILL', 'WC-TURN', 'WC-DRILL', 'WC-MULTITASK', 'WC-TRANSFER', 'WC-QC']"
TYPES = (
    "['Machining Center', 'CNC Lathe', 'Drilling Center',"
    " 'Multitask Machine', 'Transfer Line', 'Measuring Machine']"
)
OPERATIONS = "['Roughing', 'Finishing', 'Inspection']"
ANOMALIES = "['High Temperature', 'Excessive Vibration', 'High Tool Wear', 'Low Coolant Flow']"


def machine_id(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"'MCH-' || lpad({text}, greatest(3, CAST(length({text}) AS INTEGER)), '0')"


FLEET_SIZE = "(SELECT count(*) FROM supplier)"
OPEN = "status IN ('Open', 'In Progress')"
ON_TIME = "count(*) FILTER (WHERE status = 'Complete' AND NOT is_late)"
DONE = "count(*) FILTER (WHERE status = 'Complete')"


def month(value: str) -> str:
    return f"CAST(date_trunc('month', {value}) AS TIMESTAMP)"


def week(value: str) -> str:
    return f"CAST(date_trunc('week', {value}) AS TIMESTAMP)"


def day(value: str) -> str:
    return f"CAST(date_trunc('day', {value}) AS TIMESTAMP)"


CTES: dict[str, str] = {
    "feed_machines": f"""
        SELECT {machine_id('s_suppkey')} AS machine_id,
               s_name AS machine_name,
               {TYPES}[s_suppkey % 6 + 1] AS machine_type,
               {CENTERS}[s_suppkey % 6 + 1] AS work_center,
               CAST(1 + s_suppkey % 3 AS INTEGER) AS num_shifts,
               CAST(8 AS DOUBLE) AS capacity_hrs_per_shift,
               n_name AS vendor,
               CAST(1998 + s_suppkey % 25 AS INTEGER) AS installation_year,
               CASE s_suppkey % 12 WHEN 7 THEN 'Maintenance' WHEN 11 THEN 'Idle' ELSE 'Active' END AS status,
               s_acctbal / 100 AS hourly_rate_usd,
               CAST(500 + 250 * (s_suppkey % 3) AS INTEGER) AS preventive_maint_interval_hrs,
               DATE '2023-01-01' + CAST(s_suppkey * 37 % 365 AS INTEGER) AS last_pm_date,
               'In service since ' || CAST(1998 + s_suppkey % 25 AS VARCHAR) AS notes
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "feed_routings": f"""
        SELECT 'RTG-' || p_partkey || '-' || step AS routing_id,
               'PN-' || p_partkey AS part_number,
               p_name AS part_description,
               CAST(10 * step AS INTEGER) AS operation_sequence,
               'OP-0' || 10 * step AS operation_code,
               {OPERATIONS}[step] AS operation_description,
               {CENTERS}[(p_partkey + step) % {FLEET_SIZE} % 6 + 1] AS work_center,
               {machine_id(f'((p_partkey + step) % {FLEET_SIZE})')} AS preferred_machine_id,
               CAST(0.5 AS DOUBLE) AS setup_time_hrs,
               CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (p_partkey % 3) AS run_time_hrs_per_unit,
               p_size / CAST(2 AS DOUBLE) - 1 AS scrap_rate_pct
        FROM part, range(1, 4) AS steps(step)""",
    "order_lines": """
        SELECT l.*, o_orderpriority, p_name,
               CAST(l_shipdate AS DATE) AS ship,
               CAST(l_shipdate AS DATE) + CAST(3 + l_partkey % 12 AS INTEGER) AS due,
               CAST(l_quantity AS INTEGER) AS qty,
               CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (l_partkey % 3) AS run,
               CASE l_returnflag || l_linestatus
                   WHEN 'RO' THEN 'Farm-Out' WHEN 'NO' THEN 'Open' WHEN 'NF' THEN 'In Progress'
                   ELSE 'Complete' END AS state
        FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey""",
    "feed_work_orders": f"""
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
                   || strftime(ship, '%Y%m%d') AS work_order_id,
               'PN-' || l_partkey AS part_number,
               p_name AS part_description,
               qty AS order_qty,
               'OP-0' || 10 * (1 + l_linenumber % 3) AS operation_code,
               {OPERATIONS}[1 + l_linenumber % 3] AS operation_description,
               {CENTERS}[1 + l_suppkey % 6] AS work_center,
               CASE WHEN state <> 'Farm-Out' THEN {machine_id('l_suppkey')} END AS machine_id,
               due AS due_date,
               CAST(ship AS TIMESTAMP) AS scheduled_start,
               CAST(ship + CAST(1 + l_partkey % 3 AS INTEGER) AS TIMESTAMP) AS scheduled_end,
               CASE WHEN state IN ('Complete', 'In Progress') THEN CAST(ship AS TIMESTAMP) END AS actual_start,
               CASE WHEN state = 'Complete'
                    THEN CAST(due + CAST(l_orderkey % 10 - 7 AS INTEGER) AS TIMESTAMP) END AS actual_end,
               CAST(0.5 AS DOUBLE) AS setup_time_hrs,
               run AS run_time_hrs_per_unit,
               CASE WHEN state = 'Complete'
                    THEN (CAST(0.5 AS DOUBLE) + run * qty)
                         * (CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (l_linenumber % 3)) END AS actual_total_hrs,
               state AS status,
               CASE o_orderpriority[1] WHEN '1' THEN 'High' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium'
                   WHEN '4' THEN 'Low' WHEN '5' THEN 'Low' END AS priority,
               CASE WHEN state = 'Farm-Out' THEN 'VENDOR-' || l_partkey % 4 END AS farm_out_vendor,
               CASE WHEN state = 'Farm-Out'
                    THEN {rnd('l_extendedprice * (1 - l_discount) / 12', 2)} END AS farm_out_cost_usd,
               'ERP' AS source_system
        FROM order_lines""",
    "feed_sensor_data": f"""
        SELECT CAST(event_id AS VARCHAR) AS sensor_id,
               {machine_id(f'(user_id % {FLEET_SIZE})')} AS machine_id,
               date_trunc('second', ts) AS reading_timestamp,
               CAST(20 AS DOUBLE) + CAST(0.35 AS DOUBLE) * value AS temperature_celsius,
               value / 40 AS vibration_mm_s,
               CAST(800 + event_id % 2700 AS DOUBLE) AS spindle_speed_rpm,
               CAST(10 + event_id % 35 AS DOUBLE) AS power_consumption_kw,
               CAST(event_id % 16 AS DOUBLE) AS coolant_flow_lpm,
               CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS tool_wear_pct,
               CASE event_type WHEN 'view' THEN 'Idle' ELSE 'Running' END AS machine_status,
               event_type = 'error' AS anomaly_flag,
               CASE WHEN event_type = 'error' THEN {ANOMALIES}[event_id % 4 + 1] END AS anomaly_type
        FROM events""",
    "incidents": f"""
        SELECT event_id AS incident_id, ts AS reported_at,
               'Machine mch ' || substr({machine_id(f'(user_id % {FLEET_SIZE})')}, 5) || ' is down' AS report_text
        FROM events WHERE event_type = 'error'""",
    "typed_machines": """
        SELECT *, num_shifts * capacity_hrs_per_shift AS capacity_hrs_per_day FROM feed_machines""",
    "typed_work_orders": """
        SELECT *, status = 'Farm-Out' AS is_farm_out,
               status = 'Complete' AND actual_end > CAST(due_date AS TIMESTAMP) AS is_late,
               round(setup_time_hrs + run_time_hrs_per_unit * order_qty, 2) AS standard_total_hrs
        FROM feed_work_orders""",
    "typed_sensor_data": """
        SELECT *,
               CAST(greatest(0, 100
                   - 30 * CAST(coalesce(tool_wear_pct > 80, false) AS INTEGER)
                   - 25 * CAST(coalesce(vibration_mm_s > 4, false) AS INTEGER)
                   - 20 * CAST(coalesce(temperature_celsius > 80, false) AS INTEGER)
                   - 15 * CAST(coalesce(coolant_flow_lpm < 3 AND machine_status = 'Running', false) AS INTEGER)
                   - 10 * CAST(coalesce(anomaly_flag, false) AS INTEGER)) AS INTEGER) AS health_score,
               CAST(year(reading_timestamp) AS INTEGER) AS reading_year,
               CAST(month(reading_timestamp) AS INTEGER) AS reading_month,
               CAST(weekofyear(reading_timestamp) AS INTEGER) AS reading_week
        FROM feed_sensor_data""",
    "machines": "SELECT * FROM typed_machines WHERE capacity_hrs_per_shift > 0 AND hourly_rate_usd > 0",
    "routings": "SELECT * FROM feed_routings WHERE operation_sequence > 0 AND scrap_rate_pct >= 0",
    "work_orders": """
        SELECT * FROM typed_work_orders
        WHERE order_qty > 0 AND coalesce(farm_out_cost_usd, 0) >= 0 AND setup_time_hrs >= 0""",
    "sensor_data": """
        SELECT * FROM typed_sensor_data
        WHERE sensor_id IS NOT NULL AND temperature_celsius < 130 AND vibration_mm_s < 8 AND tool_wear_pct <= 100""",
    "utilization": f"""
        SELECT w.machine_id, capacity_hrs_per_day, hourly_rate_usd,
               {day('scheduled_start')} AS period_day, {week('scheduled_start')} AS period_week,
               {month('scheduled_start')} AS period_month,
               CAST(year(scheduled_start) AS INTEGER) AS period_year,
               sum(standard_total_hrs) AS scheduled_hrs,
               coalesce(sum(actual_total_hrs), 0) AS actual_hrs,
               count(*) AS work_order_count,
               {rnd('sum(standard_total_hrs) / nullif(capacity_hrs_per_day, 0) * 100', 1)} AS utilization_pct,
               CASE WHEN sum(actual_total_hrs) > 0 AND sum(standard_total_hrs) > 0
                    THEN {rnd('sum(standard_total_hrs) / sum(actual_total_hrs) * 100', 1)} END AS efficiency_pct,
               {rnd('coalesce(sum(actual_total_hrs), sum(standard_total_hrs)) * hourly_rate_usd', 2)} AS revenue_usd
        FROM work_orders w JOIN machines m ON m.machine_id = w.machine_id
        WHERE scheduled_start IS NOT NULL
        GROUP BY w.machine_id, capacity_hrs_per_day, hourly_rate_usd, scheduled_start""",
    "scheduling": f"""
        SELECT {week('due_date')} AS period_week, {month('due_date')} AS period_month,
               CAST(year(due_date) AS INTEGER) AS period_year, work_center, priority,
               count(*) AS total_orders,
               count(*) FILTER (WHERE is_farm_out) AS farm_out_count,
               count(*) FILTER (WHERE is_late) AS late_count,
               {DONE} AS completed_count,
               {rnd('sum(coalesce(farm_out_cost_usd, 0))', 2)} AS total_farm_out_cost,
               {rnd("avg(actual_total_hrs) FILTER (WHERE status = 'Complete')", 2)} AS avg_actual_hrs,
               {rnd('sum(standard_total_hrs)', 2)} AS total_standard_hrs,
               {rnd(f'{ON_TIME} / nullif({DONE}, 0) * 100', 1)} AS on_time_delivery_pct
        FROM work_orders WHERE due_date IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
    "maintenance": f"""
        SELECT s.machine_id, machine_name, machine_type, work_center, reading_year, reading_month, reading_week,
               {day('reading_timestamp')} AS reading_date,
               count(*) AS sensor_readings,
               {rnd('avg(temperature_celsius)', 2)} AS avg_temp_c,
               {rnd('max(temperature_celsius)', 2)} AS max_temp_c,
               {rnd('avg(vibration_mm_s)', 3)} AS avg_vibration,
               {rnd('max(vibration_mm_s)', 3)} AS max_vibration,
               {rnd('avg(spindle_speed_rpm)', 0)} AS avg_spindle_rpm,
               {rnd('avg(power_consumption_kw)', 2)} AS avg_power_kw,
               {rnd('avg(coolant_flow_lpm)', 2)} AS avg_coolant_lpm,
               {rnd('max(tool_wear_pct)', 2)} AS max_tool_wear_pct,
               {rnd('avg(health_score)', 1)} AS avg_health_score,
               min(health_score) AS min_health_score,
               count(*) FILTER (WHERE anomaly_flag) AS anomaly_count,
               CASE WHEN min(health_score) < 40 OR max(tool_wear_pct) > 90 THEN 'Critical'
                    WHEN min(health_score) < 65 OR max(tool_wear_pct) > 75 THEN 'Warning'
                    ELSE 'Normal' END AS maintenance_urgency,
               CAST(date_diff('day', last_pm_date, CAST({day('reading_timestamp')} AS DATE)) AS INTEGER)
                   AS days_since_last_pm
        FROM sensor_data s JOIN machines m ON m.machine_id = s.machine_id
        GROUP BY ALL""",
    "available": """
        SELECT work_center, sum(capacity_hrs_per_day) * 22 AS hrs, count(*) AS machine_count
        FROM machines WHERE status = 'Active' GROUP BY work_center""",
    "demand": f"""
        SELECT work_center, {month('scheduled_start')} AS period_month,
               sum(standard_total_hrs) AS hrs,
               coalesce(sum(standard_total_hrs) FILTER (WHERE is_farm_out), 0) AS out_hrs,
               coalesce(sum(farm_out_cost_usd) FILTER (WHERE is_farm_out), 0) AS out_cost,
               count(DISTINCT machine_id) AS machines_used
        FROM work_orders WHERE scheduled_start IS NOT NULL GROUP BY 1, 2""",
    "capacity": f"""
        SELECT d.work_center, period_month, CAST(year(period_month) AS INTEGER) AS period_year,
               {rnd('d.hrs', 2)} AS demand_hrs, {rnd('a.hrs', 2)} AS available_hrs,
               {rnd('out_hrs', 2)} AS farm_out_hrs, {rnd('out_cost', 2)} AS farm_out_cost_usd,
               machine_count, machines_used,
               {rnd('d.hrs / nullif(a.hrs, 0) * 100', 1)} AS capacity_utilization_pct,
               {rnd('out_hrs / nullif(d.hrs, 0) * 100', 1)} AS farm_out_rate_pct,
               CASE WHEN d.hrs / nullif(a.hrs, 0) > CAST(0.9 AS DOUBLE) THEN 'Overloaded'
                    WHEN d.hrs / nullif(a.hrs, 0) > CAST(0.75 AS DOUBLE) THEN 'High Load'
                    WHEN d.hrs / nullif(a.hrs, 0) > CAST(0.5 AS DOUBLE) THEN 'Normal'
                    ELSE 'Underutilized' END AS load_status
        FROM demand d LEFT JOIN available a ON a.work_center = d.work_center""",
    "farmout": f"""
        SELECT farm_out_vendor, part_number, part_description, {month('due_date')} AS period_month,
               CAST(year(due_date) AS INTEGER) AS period_year,
               count(*) AS farm_out_orders, CAST(sum(order_qty) AS BIGINT) AS total_qty_farmed,
               {rnd('sum(farm_out_cost_usd)', 2)} AS total_farm_out_cost,
               {rnd('avg(farm_out_cost_usd)', 2)} AS avg_cost_per_order,
               {rnd('sum(standard_total_hrs)', 2)} AS equivalent_internal_hrs,
               {rnd('sum(standard_total_hrs) * 65', 2)} AS implied_internal_cost,
               {rnd('(sum(farm_out_cost_usd) - sum(standard_total_hrs) * 65) / nullif(sum(farm_out_cost_usd), 0) * 100', 1)}
                   AS cost_premium_pct
        FROM work_orders WHERE is_farm_out AND farm_out_vendor IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
    "health_now": """
        SELECT p.* FROM maintenance p
        WHERE reading_date = (SELECT max(q.reading_date) FROM maintenance q WHERE q.machine_id = p.machine_id)""",
    "newest_reading": """
        SELECT * FROM sensor_data
        QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY reading_timestamp DESC, sensor_id DESC) = 1""",
    "load": f"""
        SELECT machine_id, count(*) AS active_orders, sum(standard_total_hrs) AS hrs
        FROM work_orders WHERE {OPEN} AND machine_id IS NOT NULL GROUP BY machine_id""",
    "mentioned": """
        SELECT incident_id, report_text,
               CASE WHEN regexp_matches(upper(report_text), '\\bMCH[-\\s]?[0-9]{3,}\\b')
                    THEN 'MCH-' || regexp_extract(upper(report_text), '\\bMCH[-\\s]?([0-9]{3,})\\b', 1) END AS machine_id
        FROM incidents""",
    "reported": "SELECT DISTINCT machine_id FROM mentioned WHERE machine_id IS NOT NULL",
    "out_of_service": """
        SELECT machine_id FROM machines
        WHERE status IN ('Maintenance', 'Idle') AND machine_id IN (SELECT machine_id FROM reported)""",
    "active_load": """
        SELECT m.*, coalesce(active_orders, 0) AS active_orders
        FROM machines m LEFT JOIN load l ON l.machine_id = m.machine_id WHERE status = 'Active'""",
    "moves": """
        SELECT f.machine_id AS from_machine_id, c.machine_id AS to_machine_id
        FROM out_of_service o JOIN machines f ON f.machine_id = o.machine_id
             JOIN active_load c ON c.work_center = f.work_center AND c.machine_id <> f.machine_id
        QUALIFY row_number() OVER (PARTITION BY f.machine_id ORDER BY c.active_orders, c.machine_id) = 1""",
}

_BASE = {"lineitem", "orders", "part", "supplier", "nation", "events"}


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", sql))
    return [name for name in CTES if name in words and name not in _BASE]


def with_tables(select: str) -> str:
    """The select preceded by the CTEs it needs, each after those it reads."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in _uses(sql):
            if name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(select)
    if not ordered:
        return select
    defined = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {defined}\n{select}"
