"""DuckDB statement per registered query, over the same tables."""

from __future__ import annotations

from checks.rules_sql import RULES
from checks.tables_sql import DONE, ON_TIME, OPEN, rnd, with_tables
from millgauge.sources.schemas import FEED_COLUMNS

PRIORITY = "CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"


def _columns(feed: str, *extra: str) -> str:
    return ", ".join(FEED_COLUMNS[feed] + extra)


_SILVER_COLUMNS = {
    "machines": _columns("machines", "capacity_hrs_per_day"),
    "routings": _columns("routings"),
    "work_orders": _columns("work_orders", "is_farm_out", "is_late", "standard_total_hrs"),
    "sensor_data": _columns("sensor_data", "health_score", "reading_year", "reading_month", "reading_week"),
}

# What each table is in front of the gate.
_GATED = {
    "bronze_machines": "feed_machines",
    "bronze_routings": "feed_routings",
    "bronze_work_orders": "feed_work_orders",
    "bronze_sensor_data": "feed_sensor_data",
    "silver_machines": "typed_machines",
    "silver_routings": "feed_routings",
    "silver_work_orders": "typed_work_orders",
    "silver_sensor_data": "typed_sensor_data",
}


def _events(table: str, *actions: str) -> list[str]:
    return [
        f"""SELECT '{table}' AS table_name, '{name}' AS rule, '{action}' AS action,
            count(*) FILTER (WHERE coalesce({holds}, false)) AS passed,
            count(*) FILTER (WHERE NOT coalesce({holds}, false)) AS failed
            FROM {_GATED[table]}"""
        for name, action, holds in RULES[table]
        if not actions or action in actions
    ]


def _event_log(*actions: str) -> str:
    return " UNION ALL ".join(part for table in _GATED for part in _events(table, *actions))


def _kept(table: str) -> str:
    drops = [holds for _, action, holds in RULES[f"silver_{table}"] if action == "DROP"]
    keep = " AND ".join(f"coalesce({p}, false)" for p in drops)
    return f"""SELECT 'silver_{table}' AS table_name, count(*) AS rows_in,
               count(*) FILTER (WHERE {keep}) AS rows_kept,
               count(*) FILTER (WHERE NOT ({keep})) AS rows_dropped FROM {_GATED[f'silver_{table}']}"""


def _fail_check(table: str) -> str:
    return f"SELECT 'silver_{table}' AS table_name, count(*) AS rows_passed FROM {_GATED[f'silver_{table}']}"


# Per relation of tables_sql: the gold table's name and columns.
_GOLD_COLUMNS = {
    "utilization": ("gold_machine_utilization", """machine_id capacity_hrs_per_day hourly_rate_usd period_day period_week period_month
        period_year scheduled_hrs actual_hrs work_order_count utilization_pct efficiency_pct revenue_usd"""),
    "scheduling": ("gold_scheduling_performance", """period_week period_month period_year work_center priority total_orders farm_out_count
        late_count completed_count total_farm_out_cost avg_actual_hrs total_standard_hrs on_time_delivery_pct"""),
    "maintenance": ("gold_predictive_maintenance", """machine_id machine_name machine_type work_center reading_year reading_month
        reading_week reading_date sensor_readings avg_temp_c max_temp_c avg_vibration max_vibration avg_spindle_rpm avg_power_kw
        avg_coolant_lpm max_tool_wear_pct avg_health_score min_health_score anomaly_count maintenance_urgency days_since_last_pm"""),
    "capacity": ("gold_capacity_planning", """work_center period_month period_year demand_hrs available_hrs farm_out_hrs
        farm_out_cost_usd machine_count machines_used capacity_utilization_pct farm_out_rate_pct load_status"""),
    "farmout": ("gold_farmout_analysis", """farm_out_vendor part_number part_description period_month period_year farm_out_orders
        total_qty_farmed total_farm_out_cost avg_cost_per_order equivalent_internal_hrs implied_internal_cost cost_premium_pct"""),
}


def _dictionary(table: str, name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, '{c}' AS column_name, true AS documented,
            count({c}) AS filled_rows FROM {table}"""
        for c in columns
    )


def _as_of(date: str) -> str:
    return f"DATE '{date}'"


def _selects(as_of: str) -> dict[str, str]:
    year = as_of[:4]
    label = "strftime(period_month, '%Y-%m')"
    snapshot = f"""SELECT machine_id, machine_name, work_center, {rnd('avg_health_score', 1)} AS avg_health_score,
        {rnd('max_tool_wear_pct', 1)} AS max_tool_wear_pct, anomaly_count, maintenance_urgency, days_since_last_pm
        FROM health_now"""
    capacity_display = f"""SELECT {label} AS month, work_center, {rnd('demand_hrs', 0)} AS demand_hrs,
        {rnd('available_hrs', 0)} AS available_hrs, {rnd('capacity_utilization_pct', 1)} AS capacity_util_pct,
        {rnd('farm_out_cost_usd', 0)} AS farm_out_cost_usd, load_status FROM capacity"""
    vendors = f"""SELECT farm_out_vendor, CAST(sum(farm_out_orders) AS BIGINT) AS total_orders,
        {rnd('sum(total_farm_out_cost)', 0)} AS total_farm_out_cost,
        {rnd('sum(implied_internal_cost)', 0)} AS implied_internal_cost,
        {rnd('avg(cost_premium_pct)', 1)} AS avg_cost_premium_pct FROM farmout GROUP BY 1"""
    detail = [
        ("hourly_rate_usd", 2), ("capacity_hrs_per_day", 1), ("temperature_celsius", 2), ("vibration_mm_s", 3),
        ("spindle_speed_rpm", 0), ("power_consumption_kw", 2), ("coolant_flow_lpm", 2), ("tool_wear_pct", 1),
    ]
    return {
        # sources
        "ingest_machines": f"SELECT {_SILVER_COLUMNS['machines']} FROM typed_machines",
        "ingest_routings": f"SELECT {_SILVER_COLUMNS['routings']} FROM feed_routings",
        "ingest_work_orders": f"SELECT {_SILVER_COLUMNS['work_orders']} FROM typed_work_orders",
        "ingest_sensor_data": f"SELECT {_SILVER_COLUMNS['sensor_data']} FROM typed_sensor_data",
        "write_landing": f"SELECT {_SILVER_COLUMNS['routings']} FROM feed_routings",
        "ingest_by_header": f"""
            SELECT * REPLACE (CASE WHEN operation_sequence % 20 = 0 THEN scrap_rate_pct END AS scrap_rate_pct),
                   CASE WHEN operation_sequence % 20 <> 0 THEN work_center END AS rescued_plant
            FROM (SELECT {_SILVER_COLUMNS['routings']} FROM feed_routings)""",
        "describe_columns": " UNION ALL ".join(_dictionary(t, f"silver_{t}", c.split(", ")) for t, c in _SILVER_COLUMNS.items()),
        "describe_gold_columns": " UNION ALL ".join(_dictionary(t, name, c.split()) for t, (name, c) in _GOLD_COLUMNS.items()),
        # quality
        **{f"ingest_silver_{feed}": f"SELECT {columns} FROM {feed}" for feed, columns in _SILVER_COLUMNS.items()},
        "quality_log": _event_log(),
        "dq_warn_report": _event_log("WARN"),
        "dq_drop_rows": " UNION ALL ".join(_kept(t) for t in _SILVER_COLUMNS),
        "dq_fail_check": " UNION ALL ".join(_fail_check(t) for t in _SILVER_COLUMNS),
        "dq_event_log": _event_log(),
        # silver
        **{f"silver_{t}": f"SELECT {c} FROM {t}" for t, c in _SILVER_COLUMNS.items()},
        "health_score": "SELECT health_score, count(*) AS readings FROM sensor_data GROUP BY 1",
        # gold
        "gold_machine_utilization": "SELECT * FROM utilization",
        "gold_scheduling_performance": "SELECT * FROM scheduling",
        "gold_predictive_maintenance": "SELECT * FROM maintenance",
        "gold_capacity_planning": "SELECT * FROM capacity",
        "gold_farmout_analysis": "SELECT * FROM farmout",
        # analytics
        "q1_1_top_machines": f"""SELECT machine_id, {rnd('avg(utilization_pct)', 1)} AS avg_monthly_utilization_pct,
            {rnd('avg(efficiency_pct)', 1)} AS avg_efficiency_pct, {rnd('sum(revenue_usd)', 2)} AS total_revenue_usd,
            CAST(sum(work_order_count) AS BIGINT) AS total_work_orders
            FROM utilization GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
        "q1_2_utilization_trend": f"""SELECT {label} AS month, machine_id, utilization_pct, efficiency_pct,
            work_order_count, revenue_usd FROM utilization""",
        "q1_3_utilization_yearly": f"""SELECT period_year, machine_id, {rnd('avg(utilization_pct)', 1)} AS avg_utilization_pct,
            {rnd('sum(revenue_usd)', 0)} AS total_revenue_usd, CAST(sum(work_order_count) AS BIGINT) AS total_work_orders
            FROM utilization GROUP BY 1, 2""",
        "q2_1_otd_monthly": f"""SELECT {label} AS month, work_center, total_orders, completed_count, late_count,
            on_time_delivery_pct AS otd_pct, total_farm_out_cost AS farm_out_cost_usd FROM scheduling""",
        "q2_2_weekly_pressure": """SELECT strftime(period_week, '%G-W%V') AS week, work_center, priority, total_orders,
            late_count, farm_out_count, total_farm_out_cost AS farm_out_cost_usd, on_time_delivery_pct AS otd_pct
            FROM scheduling WHERE priority = 'High'""",
        "q2_3_yearly_summary": f"""SELECT period_year, CAST(sum(total_orders) AS BIGINT) AS total_orders,
            CAST(sum(completed_count) AS BIGINT) AS total_completed, CAST(sum(late_count) AS BIGINT) AS total_late,
            CAST(sum(farm_out_count) AS BIGINT) AS total_farm_out,
            {rnd('sum(total_farm_out_cost)', 0)} AS total_farm_out_cost_usd,
            {rnd('avg(on_time_delivery_pct)', 1)} AS avg_otd_pct,
            {rnd('sum(total_standard_hrs)', 0)} AS total_standard_hrs FROM scheduling GROUP BY 1""",
        "q3_1_health_snapshot": """SELECT machine_id, machine_name, machine_type, work_center,
            reading_date AS last_reading_date, avg_health_score, min_health_score, max_tool_wear_pct,
            anomaly_count, maintenance_urgency, days_since_last_pm FROM health_now""",
        "q3_2_health_trend": f"""SELECT machine_id, machine_name, reading_week, reading_year, avg_health_score,
            avg_vibration AS avg_vibration_mm_s, {rnd('avg_temp_c', 1)} AS avg_temp_celsius,
            {rnd('max_tool_wear_pct', 1)} AS max_tool_wear_pct, anomaly_count, maintenance_urgency FROM maintenance""",
        "q3_3_pm_due": f"""SELECT machine_id, machine_name, machine_type, work_center,
            max(days_since_last_pm) AS days_since_last_pm, {rnd('avg(avg_health_score)', 1)} AS recent_avg_health,
            CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies_30d, max(max_tool_wear_pct) AS peak_tool_wear_pct
            FROM maintenance GROUP BY 1, 2, 3, 4 HAVING max(days_since_last_pm) > 180""",
        "q4_1_capacity_monthly": f"""SELECT {label} AS month, work_center, demand_hrs, available_hrs, farm_out_hrs,
            farm_out_cost_usd, machine_count, capacity_utilization_pct, farm_out_rate_pct, load_status FROM capacity""",
        "q4_2_capacity_yearly": f"""SELECT period_year, work_center, {rnd('sum(demand_hrs)', 0)} AS total_demand_hrs,
            {rnd('avg(available_hrs)', 0)} AS avg_available_hrs_per_month,
            {rnd('sum(farm_out_hrs)', 0)} AS total_farm_out_hrs,
            {rnd('sum(farm_out_cost_usd)', 0)} AS total_farm_out_cost,
            {rnd('avg(capacity_utilization_pct)', 1)} AS avg_utilization_pct,
            {rnd('avg(farm_out_rate_pct)', 1)} AS avg_farm_out_rate_pct FROM capacity GROUP BY 1, 2""",
        "q4_3_overloaded": f"""SELECT work_center, count(DISTINCT period_month) AS months_overloaded,
            {rnd('avg(capacity_utilization_pct)', 1)} AS avg_util_pct,
            {rnd('sum(farm_out_cost_usd)', 0)} AS total_farm_out_cost,
            {rnd('sum(demand_hrs) - sum(available_hrs)', 0)} AS total_hrs_over_capacity
            FROM capacity WHERE load_status IN ('Overloaded', 'High Load') GROUP BY 1""",
        "q5_1_vendor_cost": f"""SELECT farm_out_vendor, CAST(sum(farm_out_orders) AS BIGINT) AS total_orders,
            CAST(sum(total_qty_farmed) AS BIGINT) AS total_qty, {rnd('sum(total_farm_out_cost)', 0)} AS total_farm_out_cost,
            {rnd('sum(implied_internal_cost)', 0)} AS total_internal_equivalent_cost,
            {rnd('avg(cost_premium_pct)', 1)} AS avg_cost_premium_pct FROM farmout GROUP BY 1""",
        "q5_2_farmout_trend": f"""SELECT {label} AS month, {rnd('sum(total_farm_out_cost)', 0)} AS total_farm_out_cost,
            {rnd('sum(implied_internal_cost)', 0)} AS implied_internal_cost,
            CAST(sum(farm_out_orders) AS BIGINT) AS total_farm_out_orders,
            CAST(sum(total_qty_farmed) AS BIGINT) AS total_qty_farmed FROM farmout GROUP BY 1""",
        "q5_3_top_parts": f"""SELECT part_number, part_description,
            CAST(sum(farm_out_orders) AS BIGINT) AS total_farm_out_orders,
            {rnd('sum(total_farm_out_cost)', 0)} AS total_farm_out_cost,
            {rnd('avg(cost_premium_pct)', 1)} AS avg_premium_pct,
            {rnd('sum(equivalent_internal_hrs)', 1)} AS total_internal_hrs_equivalent
            FROM farmout GROUP BY 1, 2 ORDER BY 4 DESC, 1, 2 LIMIT 10""",
        # dashboard
        "dashboard_utilization_monthly": f"""SELECT {label} AS month, machine_id, utilization_pct,
            {rnd('revenue_usd', 0)} AS revenue_usd, work_order_count FROM utilization""",
        "dashboard_scheduling_monthly": f"""SELECT {label} AS month, work_center, total_orders, late_count, farm_out_count,
            {rnd('total_farm_out_cost', 0)} AS farm_out_cost_usd, on_time_delivery_pct AS otd_pct FROM scheduling""",
        "dashboard_health_snapshot": snapshot,
        "dashboard_capacity_monthly": capacity_display,
        "dashboard_vendor_costs": vendors,
        "kpi_summary": f"""SELECT count(DISTINCT machine_id) AS total_machines,
            {rnd('avg(utilization_pct)', 1)} AS avg_utilization_pct, {rnd('sum(revenue_usd)', 0)} AS total_revenue_usd,
            CAST(sum(work_order_count) AS BIGINT) AS total_work_orders FROM utilization""",
        "revenue_by_machine": f"SELECT machine_id, {rnd('sum(revenue_usd)', 0)} AS revenue FROM utilization GROUP BY 1",
        "utilization_trend_fleet": f"""SELECT {label} AS month, {rnd('avg(utilization_pct)', 1)} AS avg_util
            FROM utilization GROUP BY 1""",
        "scheduling_kpis": f"""SELECT CAST(sum(total_orders) AS BIGINT) AS total_wo,
            {rnd('sum(total_farm_out_cost)', 0)} AS total_farmout, {rnd('avg(on_time_delivery_pct)', 1)} AS avg_otd
            FROM scheduling""",
        "otd_trend": f"""SELECT {label} AS month, {rnd('avg(on_time_delivery_pct)', 1)} AS avg_otd
            FROM scheduling GROUP BY 1""",
        "farmout_by_work_center": f"""SELECT work_center, {rnd('sum(total_farm_out_cost)', 0)} AS farmout
            FROM scheduling GROUP BY 1""",
        "health_kpis": f"""SELECT {rnd('avg(avg_health_score)', 1)} AS avg_health_score,
            CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, {rnd('avg(max_tool_wear_pct)', 1)} AS avg_tool_wear_pct
            FROM (SELECT {rnd('avg_health_score', 1)} AS avg_health_score, anomaly_count,
                         {rnd('max_tool_wear_pct', 1)} AS max_tool_wear_pct FROM health_now)""",
        "urgency_distribution": "SELECT maintenance_urgency, count(*) AS machines FROM health_now GROUP BY 1",
        "capacity_kpis": f"""SELECT {rnd('avg(capacity_util_pct)', 1)} AS avg_capacity_util_pct,
            {rnd('sum(farm_out_cost_usd)', 0)} AS total_farm_out_cost, {rnd('sum(demand_hrs)', 0)} AS total_demand_hrs
            FROM ({capacity_display})""",
        "demand_vs_capacity": f"""SELECT work_center, sum(demand_hrs) AS demand_hrs, sum(available_hrs) AS available_hrs
            FROM ({capacity_display}) GROUP BY 1""",
        "demand_vs_capacity_latest": f"""SELECT month, work_center, demand_hrs, available_hrs FROM ({capacity_display})
            QUALIFY month = max(month) OVER ()""",
        "load_status_distribution": "SELECT load_status, count(*) AS center_months FROM capacity GROUP BY 1",
        "farmout_kpis": f"""SELECT sum(total_farm_out_cost) AS total_farm_out_cost,
            sum(implied_internal_cost) AS implied_internal_cost, {rnd('avg(avg_cost_premium_pct)', 1)} AS avg_cost_premium_pct
            FROM ({vendors})""",
        # shop-floor application
        "machine_status_counts": """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Active') AS active,
            count(*) FILTER (WHERE status = 'Maintenance') AS maintenance,
            count(*) FILTER (WHERE status = 'Idle') AS idle FROM machines""",
        "performance_kpis": f"""SELECT
            (SELECT {rnd('avg(utilization_pct)', 1)} FROM utilization
              WHERE period_month = (SELECT max(period_month) FROM utilization)) AS avg_utilization_pct,
            (SELECT {rnd(f'{ON_TIME} / nullif({DONE}, 0) * 100', 1)} FROM work_orders) AS avg_otd_pct,
            (SELECT {rnd('sum(total_farm_out_cost)', 0)} FROM farmout
              WHERE period_year = (SELECT max(period_year) FROM farmout)) AS ytd_farmout_cost,
            (SELECT {rnd('avg(cost_premium_pct)', 1)} FROM farmout
              WHERE period_year = (SELECT max(period_year) FROM farmout)) AS avg_cost_premium_pct,
            (SELECT count(*) FILTER (WHERE maintenance_urgency = 'Critical') FROM maintenance
              WHERE reading_date = (SELECT max(reading_date) FROM maintenance)) AS critical_machines,
            (SELECT count(*) FILTER (WHERE maintenance_urgency = 'Warning') FROM maintenance
              WHERE reading_date = (SELECT max(reading_date) FROM maintenance)) AS warning_machines,
            (SELECT count(*) FROM work_orders WHERE {OPEN}) AS orders_in_progress""",
        "utilization_by_machine": f"""SELECT m.machine_id, m.machine_name, m.work_center,
            {rnd('avg(utilization_pct)', 1)} AS avg_utilization_pct, {rnd('avg(efficiency_pct)', 1)} AS avg_efficiency_pct
            FROM utilization u JOIN machines m ON m.machine_id = u.machine_id GROUP BY 1, 2, 3""",
        "scheduling_trend": f"""SELECT {label} AS month, {rnd('avg(on_time_delivery_pct)', 1)} AS avg_otd_pct,
            CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(late_count) AS BIGINT) AS late_orders,
            CAST(sum(farm_out_count) AS BIGINT) AS farm_out_orders,
            {rnd('sum(total_farm_out_cost)', 0)} AS farm_out_cost FROM scheduling GROUP BY 1""",
        "farmout_by_vendor": f"""SELECT farm_out_vendor, {rnd('sum(total_farm_out_cost)', 0)} AS total_farmout_cost,
            {rnd('sum(implied_internal_cost)', 0)} AS implied_inhouse_cost,
            {rnd('avg(cost_premium_pct)', 1)} AS avg_premium_pct,
            CAST(sum(farm_out_orders) AS BIGINT) AS total_orders FROM farmout GROUP BY 1""",
        "maintenance_summary": f"""SELECT machine_id, machine_name, work_center, maintenance_urgency,
            min(min_health_score) AS worst_health_score, {rnd('max(max_tool_wear_pct)', 1)} AS max_tool_wear_pct,
            CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies FROM maintenance
            WHERE reading_date = (SELECT max(reading_date) FROM maintenance) GROUP BY 1, 2, 3, 4""",
        "capacity_latest": f"""SELECT work_center, load_status, {rnd('avg(capacity_utilization_pct)', 1)} AS avg_capacity_pct
            FROM capacity WHERE period_month = (SELECT max(period_month) FROM capacity) GROUP BY 1, 2""",
        "machine_kpis": f"""SELECT m.machine_id, machine_name, machine_type, m.work_center, m.status AS machine_status,
            coalesce((SELECT {rnd('avg(utilization_pct)', 1)} FROM utilization u WHERE u.machine_id = m.machine_id), 0)
                AS avg_utilization_pct,
            (SELECT {rnd(f'{ON_TIME} / nullif({DONE}, 0) * 100', 1)} FROM work_orders w
              WHERE w.machine_id = m.machine_id) AS avg_otd_pct,
            coalesce((SELECT any_value(maintenance_urgency) FROM health_now h WHERE h.machine_id = m.machine_id), 'Unknown')
                AS maintenance_urgency,
            coalesce((SELECT min(min_health_score) FROM health_now h WHERE h.machine_id = m.machine_id), 0) AS health_score,
            (SELECT count(*) FROM work_orders w WHERE w.machine_id = m.machine_id AND w.{OPEN}) AS orders_in_progress,
            coalesce((SELECT {rnd('sum(total_farm_out_cost)', 0)} FROM scheduling s WHERE s.work_center = m.work_center), 0)
                AS wc_farmout_cost FROM machines m""",
        "machine_fleet": f"""SELECT m.machine_id, machine_name, machine_type, work_center, status, num_shifts,
            {rnd('hourly_rate_usd', 2)} AS hourly_rate_usd, {rnd('capacity_hrs_per_day', 1)} AS capacity_hrs_per_day,
            coalesce(n, 0) AS active_orders, coalesce(qty, 0) AS total_qty_in_progress,
            coalesce(parts, '') AS parts_in_progress, coalesce(r.health_score, 0) AS latest_health_score,
            r.machine_status AS sensor_status, r.tool_wear_pct, r.anomaly_flag
            FROM machines m LEFT JOIN (SELECT machine_id, count(DISTINCT work_order_id) AS n,
                    CAST(sum(order_qty) AS BIGINT) AS qty,
                    array_to_string(list_sort(list_distinct(list(part_description))), ', ') AS parts
                FROM work_orders WHERE {OPEN} GROUP BY 1) w ON w.machine_id = m.machine_id
            LEFT JOIN newest_reading r ON r.machine_id = m.machine_id""",
        "machines_list": "SELECT machine_id, machine_name, machine_type, work_center, status FROM machines",
        "machine_detail": f"""SELECT m.machine_id, machine_name, machine_type, work_center, status, num_shifts, vendor,
            installation_year, preventive_maint_interval_hrs, CAST(last_pm_date AS VARCHAR) AS last_pm_date, notes,
            {', '.join(f'{rnd(c, d)} AS {c}' for c, d in detail)}, health_score,
            machine_status AS sensor_machine_status, anomaly_flag, anomaly_type,
            strftime(reading_timestamp, '%Y-%m-%d %H:%M:%S') AS last_reading_ts
            FROM machines m LEFT JOIN newest_reading r ON r.machine_id = m.machine_id""",
        "machine_orders": f"""SELECT machine_id, work_order_id, part_number, part_description, order_qty,
            operation_description, status, priority, CAST(due_date AS VARCHAR) AS due_date,
            strftime(scheduled_start, '%Y-%m-%d %H:%M:%S') AS scheduled_start, standard_total_hrs
            FROM work_orders WHERE {OPEN} AND machine_id IS NOT NULL""",
        "alternative_machines": f"""SELECT work_center, m.machine_id, machine_name, machine_type,
            {rnd('hourly_rate_usd', 2)} AS hourly_rate_usd, {rnd('capacity_hrs_per_day', 1)} AS capacity_hrs_per_day,
            coalesce(active_orders, 0) AS current_orders,
            {rnd('capacity_hrs_per_day - coalesce(l.hrs, 0)', 1)} AS available_hrs,
            CASE WHEN {rnd('capacity_hrs_per_day - coalesce(l.hrs, 0)', 1)} > 4 THEN 'green'
                 WHEN {rnd('capacity_hrs_per_day - coalesce(l.hrs, 0)', 1)} > 0 THEN 'amber' ELSE 'red' END AS availability
            FROM machines m LEFT JOIN load l ON l.machine_id = m.machine_id
            WHERE status = 'Active'
              AND work_center IN (SELECT work_center FROM machines WHERE status IN ('Maintenance', 'Idle'))""",
        "gauge_bands": """SELECT m.machine_id,
            CASE WHEN coalesce(health_score, 0) >= 70 THEN 'green' WHEN coalesce(health_score, 0) >= 40 THEN 'amber'
                 ELSE 'red' END AS health_band,
            CASE WHEN coalesce(temperature_celsius, 0) < 80 THEN 'green'
                 WHEN coalesce(temperature_celsius, 0) < 100 THEN 'amber' ELSE 'red' END AS temperature_band,
            CASE WHEN coalesce(vibration_mm_s, 0) < 3 THEN 'green' WHEN coalesce(vibration_mm_s, 0) < 5 THEN 'amber'
                 ELSE 'red' END AS vibration_band,
            CASE WHEN coalesce(tool_wear_pct, 0) < 60 THEN 'green' WHEN coalesce(tool_wear_pct, 0) < 80 THEN 'amber'
                 ELSE 'red' END AS wear_band
            FROM machines m LEFT JOIN newest_reading r ON r.machine_id = m.machine_id""",
        # failures and reassignment
        "extract_machine_id": "SELECT incident_id, report_text, machine_id FROM mentioned",
        "machine_lookup": """SELECT machine_id, machine_name, machine_type, work_center, status FROM machines
            WHERE machine_id IN (SELECT machine_id FROM reported)""",
        "affected_work_orders": f"""SELECT machine_id, work_order_id, part_description, order_qty, priority, due_date, status
            FROM work_orders WHERE {OPEN} AND machine_id IN (SELECT machine_id FROM reported)""",
        "replacement_candidates": """SELECT c.work_center, c.machine_id, c.machine_name, c.status, c.active_orders,
            count(*) AS stands_in_for
            FROM reported r JOIN machines f ON f.machine_id = r.machine_id
                 JOIN active_load c ON c.work_center = f.work_center AND c.machine_id <> f.machine_id
            GROUP BY 1, 2, 3, 4, 5""",
        "active_order_counts": "SELECT machine_id, active_orders FROM load",
        "replacement_moves": """SELECT from_machine_id, to_machine_id, coalesce(active_orders, 0) AS moved_orders
            FROM moves LEFT JOIN load ON machine_id = from_machine_id""",
        "reassign_work_orders": f"""SELECT * EXCLUDE (from_machine_id, to_machine_id) REPLACE (
                CASE WHEN {OPEN} AND to_machine_id IS NOT NULL THEN to_machine_id ELSE machine_id END AS machine_id)
            FROM work_orders LEFT JOIN moves ON from_machine_id = machine_id""",
        "reassigned_orders_stored": f"""SELECT * EXCLUDE (from_machine_id, to_machine_id) REPLACE (
                CASE WHEN {OPEN} AND order_qty % 2 = 0 AND to_machine_id IS NOT NULL THEN to_machine_id ELSE machine_id END AS machine_id)
            FROM work_orders LEFT JOIN moves ON from_machine_id = machine_id""",
        "gold_stored_utilization": "SELECT * FROM utilization",
        "machines_stored_current": f"""SELECT {_SILVER_COLUMNS['machines']} FROM (SELECT * REPLACE (
            CASE WHEN machine_id[-1] IN ('5', '7') THEN 'Moved' WHEN machine_id[-1] IN ('2', '8') THEN 'Serviced' ELSE notes END AS notes)
            FROM machines)""",
        "orders_looked_up_by_machine": f"""SELECT {_SILVER_COLUMNS['work_orders']} FROM work_orders
            WHERE machine_id BETWEEN 'MCH-003' AND 'MCH-005'""",
        "gold_incremental_maintenance": "SELECT * FROM maintenance",
        "gold_incremental_scheduling": "SELECT * FROM scheduling",
        "gold_incremental_farmout": "SELECT * FROM farmout",
        # true periods and routings
        "kpi_rollup": f"""SELECT CAST(grouping(y, m, work_center) AS INTEGER) AS grouping_id, CAST(y AS INTEGER) AS period_year,
                m AS period_month, work_center, CAST(count(*) AS BIGINT) AS total_orders,
                CAST(count_if(status = 'Complete') AS BIGINT) AS completed,
                {rnd('sum(coalesce(standard_total_hrs, 0))', 2)} AS standard_hrs,
                {rnd("sum(CASE WHEN status = 'Complete' THEN actual_total_hrs ELSE 0 END)", 2)} AS completed_hrs,
                {rnd("count_if(status = 'Complete' AND NOT is_late) * 100.0 / nullif(count_if(status = 'Complete'), 0)", 1)} AS on_time_delivery_pct,
                {rnd('count_if(is_farm_out) * 100.0 / count(*)', 1)} AS farm_out_pct
            FROM (SELECT *, year(due_date) AS y, CAST(date_trunc('month', due_date) AS TIMESTAMP) AS m FROM work_orders WHERE due_date IS NOT NULL)
            GROUP BY ROLLUP (y, m, work_center)""",
        "utilization_rollup": f"""SELECT CAST(grouping(machine_id, period_year, period_month) AS INTEGER) AS grouping_id,
                machine_id, period_year, period_month, CAST(sum(work_order_count) AS BIGINT) AS work_order_count,
                {rnd('sum(scheduled_hrs)', 2)} AS scheduled_hrs, {rnd('sum(revenue_usd)', 2)} AS revenue_usd,
                {rnd('sum(scheduled_hrs) / nullif(sum(capacity_hrs_per_day), 0) * 100', 1)} AS utilization_pct
            FROM utilization GROUP BY ROLLUP (machine_id, period_year, period_month)""",
        "routing_hours_variance": f"""SELECT * FROM (WITH steps AS (
                SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY operation_sequence, routing_id) AS place,
                       row_number() OVER (PARTITION BY part_number, operation_code ORDER BY operation_sequence, routing_id) AS place_of_code
                FROM routings WHERE part_number IS NOT NULL
            ), routed AS (
                SELECT w.work_center, w.standard_total_hrs, w.order_qty,
                       CASE WHEN e.routing_id IS NOT NULL THEN 'operation' WHEN p.routing_id IS NOT NULL THEN 'part' ELSE 'none' END AS routing_match,
                       coalesce(e.setup_time_hrs, p.setup_time_hrs)
                           + coalesce(e.run_time_hrs_per_unit, p.run_time_hrs_per_unit) * w.order_qty AS hrs
                FROM work_orders w
                LEFT JOIN steps e ON e.part_number = w.part_number AND e.operation_code = w.operation_code AND e.place_of_code = 1
                LEFT JOIN steps p ON p.part_number = w.part_number AND p.place = 1
            )
            SELECT work_center, routing_match, count(*) AS orders, {rnd('sum(standard_total_hrs)', 2)} AS standard_hrs,
                {rnd('sum(hrs)', 2)} AS routing_hrs,
                {rnd('(sum(standard_total_hrs) - sum(hrs)) / nullif(sum(hrs), 0) * 100', 1)} AS variance_pct
            FROM routed GROUP BY work_center, routing_match)""",
        # streams with state
        "stream_daily_health": """SELECT * FROM maintenance
            WHERE reading_date + INTERVAL 1 DAY <= (SELECT max(reading_timestamp) - INTERVAL 2 DAY FROM sensor_data)""",
        "stream_newest_reading": """SELECT machine_id, reading_timestamp, sensor_id, health_score, machine_status,
                reading_timestamp + INTERVAL 30 DAY <= newest - INTERVAL 2 DAY AS silent
            FROM (SELECT *, max(reading_timestamp) OVER () AS newest,
                      row_number() OVER (PARTITION BY machine_id ORDER BY reading_timestamp DESC, sensor_id DESC) AS place
                  FROM sensor_data WHERE reading_timestamp IS NOT NULL) WHERE place = 1""",
        "stream_unique_readings": "SELECT * FROM sensor_data",
        "stream_dropped_readings": """SELECT 'unique_readings' AS stream, CAST(2 * count(*) AS BIGINT) AS rows_in,
                CAST(count_if(reading_timestamp <= newest - INTERVAL 2 DAY) AS BIGINT) AS late,
                CAST(count_if(reading_timestamp > newest - INTERVAL 2 DAY) AS BIGINT) AS duplicates
            FROM (SELECT *, max(reading_timestamp) OVER () AS newest FROM sensor_data)""",
        # named metrics
        "measure_utilization_pct_rounded": """SELECT machine_id, period_day,
            utilization_pct AS utilization_pct_rounded FROM utilization""",
        "measure_farm_out_rate_pct": f"""SELECT work_center, period_month,
            {rnd('farm_out_hrs / nullif(demand_hrs, 0) * 100', 1)} AS farm_out_rate_pct FROM capacity""",
        "measure_standard_total_hrs": """SELECT work_order_id, standard_total_hrs FROM work_orders""",
        "measure_days_since_last_pm": f"""SELECT machine_id,
            CAST({_as_of(as_of)} - last_pm_date AS INTEGER) AS days_since_last_pm_calc FROM machines""",
        "measure_cost_premium_pct": f"""SELECT farm_out_vendor, part_number, period_month,
            {rnd('(total_farm_out_cost - implied_internal_cost) / nullif(total_farm_out_cost, 0) * 100', 1)}
                AS cost_premium_pct_calc FROM farmout""",
        "filter_farm_out_orders": "SELECT work_order_id, farm_out_vendor FROM work_orders WHERE is_farm_out",
        "filter_late_orders": "SELECT work_order_id, due_date, actual_end FROM work_orders WHERE is_late",
        "filter_active_machines": "SELECT machine_id, status FROM machines WHERE status = 'Active'",
        "filter_critical_health": """SELECT machine_id, reading_date, maintenance_urgency FROM maintenance
            WHERE maintenance_urgency = 'Critical'""",
        "filter_overloaded_wc": """SELECT work_center, period_month, load_status FROM capacity
            WHERE load_status = 'Overloaded'""",
        "filter_high_priority_orders": "SELECT work_order_id, priority FROM work_orders WHERE priority = 'High'",
        "expr_health_category": """SELECT machine_id, reading_date, CASE WHEN avg_health_score < 40 THEN 'Critical'
            WHEN avg_health_score < 65 THEN 'Warning' ELSE 'Normal' END AS health_category FROM maintenance""",
        "expr_load_status_derived": """SELECT work_center, period_month,
            CASE WHEN demand_hrs / nullif(available_hrs, 0) > CAST(0.9 AS DOUBLE) THEN 'Overloaded'
                 WHEN demand_hrs / nullif(available_hrs, 0) > CAST(0.75 AS DOUBLE) THEN 'High Load'
                 WHEN demand_hrs / nullif(available_hrs, 0) > CAST(0.5 AS DOUBLE) THEN 'Normal'
                 ELSE 'Underutilized' END AS load_status_derived FROM capacity""",
        "expr_month_display": f"SELECT DISTINCT {label} AS month_display FROM capacity",
        "expr_otd_pct_computed": f"""SELECT work_center, {rnd(f'{ON_TIME} / nullif({DONE}, 0) * 100', 1)} AS otd_pct_computed
            FROM work_orders GROUP BY 1""",
        "critical_machines": f"""SELECT machine_id, machine_name, work_center, avg_health_score AS health_score,
            {rnd('max_tool_wear_pct', 1)} AS tool_wear_pct, anomaly_count, maintenance_urgency, days_since_last_pm
            FROM health_now WHERE maintenance_urgency = 'Critical'""",
        "otd_by_work_center_year": f"""SELECT work_center, CAST(sum(total_orders) AS BIGINT) AS total_orders,
            CAST(sum(late_count) AS BIGINT) AS late_orders, {rnd('avg(on_time_delivery_pct)', 1)} AS avg_otd_pct,
            {rnd('sum(total_farm_out_cost)', 0)} AS farm_out_cost FROM scheduling WHERE period_year = {year} GROUP BY 1""",
        "work_order_detail": """SELECT work_order_id, part_number, part_description, work_center, machine_id,
            CAST(due_date AS VARCHAR) AS due_date, status, priority, is_farm_out, is_late, farm_out_vendor,
            farm_out_cost_usd AS farm_out_cost FROM work_orders""",
        "open_orders_by_work_center": f"""SELECT work_center, count(*) AS open_orders,
            {rnd('sum(standard_total_hrs)', 2)} AS open_hrs FROM work_orders WHERE {OPEN} GROUP BY 1""",
        "orders_due_within": f"""SELECT work_order_id, part_number, work_center, machine_id, due_date, status, priority
            FROM work_orders WHERE {OPEN} AND priority = 'High'
              AND due_date >= {_as_of(as_of)} AND due_date < {_as_of(as_of)} + 7""",
        "scheduled_vs_actual": f"""SELECT machine_id, {rnd('sum(scheduled_hrs)', 2)} AS scheduled_hrs,
            {rnd('sum(actual_hrs)', 2)} AS actual_hrs, {rnd('sum(actual_hrs) - sum(scheduled_hrs)', 2)} AS difference_hrs
            FROM utilization WHERE period_month = date_trunc('month', {_as_of(as_of)}) GROUP BY 1""",
        "late_orders": """SELECT work_order_id, part_number, work_center, priority, due_date, actual_end
            FROM work_orders WHERE is_late""",
        "otd_last_months": f"""SELECT {label} AS month, {rnd('avg(on_time_delivery_pct)', 1)} AS avg_otd_pct,
            CAST(sum(completed_count) AS BIGINT) AS completed, CAST(sum(late_count) AS BIGINT) AS late FROM scheduling
            WHERE period_month > date_trunc('month', {_as_of(as_of)}) - INTERVAL 12 MONTH
              AND period_month <= {_as_of(as_of)} GROUP BY 1""",
        "top_utilization_year": f"""SELECT machine_id, {rnd('avg(utilization_pct)', 1)} AS avg_utilization_pct
            FROM utilization WHERE period_year = {year} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "vendor_cost_year": f"""SELECT farm_out_vendor, CAST(sum(farm_out_orders) AS BIGINT) AS total_orders,
            {rnd('sum(total_farm_out_cost)', 0)} AS total_farm_out_cost FROM farmout WHERE period_year = {year} GROUP BY 1""",
    }


def statements(as_of: str) -> dict[str, str]:
    return {name: with_tables(select) for name, select in _selects(as_of).items()}
