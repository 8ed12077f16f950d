"""The quality rules (name, action, predicate in DuckDB form) per table, written out apart from the engine's own."""

# Fixed values.
RULES = {
    "bronze_machines": (
        ("bz_machine_id_not_null", "WARN", "machine_id IS NOT NULL"),
        ("bz_machine_id_format", "WARN", "regexp_matches(machine_id, '^MCH-[0-9]')"),
        ("bz_status_not_null", "WARN", "status IS NOT NULL"),
        ("bz_hourly_rate_positive", "WARN", "hourly_rate_usd > 0"),
    ),
    "bronze_routings": (
        ("bz_routing_id_not_null", "WARN", "routing_id IS NOT NULL"),
        ("bz_part_number_not_null", "WARN", "part_number IS NOT NULL"),
        ("bz_op_sequence_positive", "WARN", "operation_sequence > 0"),
        ("bz_run_time_non_negative", "WARN", "run_time_hrs_per_unit >= 0"),
    ),
    "bronze_work_orders": (
        ("bz_wo_id_not_null", "WARN", "work_order_id IS NOT NULL"),
        ("bz_wo_part_not_null", "WARN", "part_number IS NOT NULL"),
        ("bz_wo_qty_positive", "WARN", "order_qty > 0"),
        ("bz_wo_status_not_null", "WARN", "status IS NOT NULL"),
        ("bz_wo_due_date_not_null", "WARN", "due_date IS NOT NULL"),
    ),
    "bronze_sensor_data": (
        ("bz_sensor_id_not_null", "WARN", "sensor_id IS NOT NULL"),
        ("bz_sensor_machine_id", "WARN", "machine_id IS NOT NULL"),
        ("bz_temp_parseable", "WARN", "temperature_celsius IS NOT NULL"),
        ("bz_ts_not_null", "WARN", "reading_timestamp IS NOT NULL"),
        ("bz_machine_ref_required", "DROP", "machine_id IS NOT NULL"),
    ),
    "silver_machines": (
        ("sv_machine_pk_never_null", "FAIL", "machine_id IS NOT NULL"),
        ("sv_machine_capacity_positive", "DROP", "capacity_hrs_per_shift > 0"),
        ("sv_hourly_rate_positive", "DROP", "hourly_rate_usd > 0"),
        ("sv_machine_status_valid", "WARN", "status IN ('Active', 'Maintenance', 'Idle')"),
        ("sv_shifts_in_range", "WARN", "num_shifts IN (1, 2, 3)"),
        ("sv_capacity_shift_range", "WARN", "capacity_hrs_per_shift >= 4 AND capacity_hrs_per_shift <= 12"),
        ("sv_installation_year_recent", "WARN", "installation_year >= 2000"),
        ("sv_pm_interval_reasonable", "WARN", "preventive_maint_interval_hrs >= 100 AND preventive_maint_interval_hrs <= 3000"),
        ("sv_last_pm_date_set", "WARN", "last_pm_date IS NOT NULL"),
    ),
    "silver_routings": (
        ("sv_routing_pk_never_null", "FAIL", "routing_id IS NOT NULL AND part_number IS NOT NULL"),
        ("sv_routing_seq_positive", "DROP", "operation_sequence > 0"),
        ("sv_scrap_rate_non_negative", "DROP", "scrap_rate_pct >= 0"),
        ("sv_setup_time_non_negative", "WARN", "setup_time_hrs >= 0"),
        ("sv_run_time_positive", "WARN", "run_time_hrs_per_unit > 0"),
        ("sv_scrap_rate_reasonable", "WARN", "scrap_rate_pct >= 0 AND scrap_rate_pct <= 30"),
        ("sv_routing_work_center_set", "WARN", "work_center IS NOT NULL"),
    ),
    "silver_work_orders": (
        ("sv_wo_pk_never_null", "FAIL", "work_order_id IS NOT NULL AND part_number IS NOT NULL"),
        ("sv_wo_qty_positive", "DROP", "order_qty > 0"),
        ("sv_farmout_cost_non_negative", "DROP", "coalesce(farm_out_cost_usd, 0) >= 0"),
        ("sv_setup_time_non_negative", "DROP", "setup_time_hrs >= 0"),
        ("sv_wo_status_valid", "WARN", "status IN ('Open', 'In Progress', 'Complete', 'Farm-Out')"),
        ("sv_wo_priority_valid", "WARN", "priority IN ('High', 'Medium', 'Low')"),
        ("sv_wo_work_center_known", "WARN", "work_center IN ('WC-MILL', 'WC-TURN', 'WC-DRILL', 'WC-MULTITASK', 'WC-TRANSFER', 'WC-QC')"),
        ("sv_wo_due_date_set", "WARN", "due_date IS NOT NULL"),
        ("sv_wo_sched_dates_ordered", "WARN", "coalesce(scheduled_end >= scheduled_start, true)"),
        ("sv_farmout_has_vendor", "WARN", "CASE WHEN status = 'Farm-Out' THEN farm_out_vendor IS NOT NULL ELSE status IS NOT NULL OR farm_out_vendor IS NOT NULL END"),
        ("sv_complete_has_actual_end", "WARN", "CASE WHEN status = 'Complete' THEN actual_end IS NOT NULL ELSE status IS NOT NULL OR actual_end IS NOT NULL END"),
        ("sv_run_time_positive", "WARN", "run_time_hrs_per_unit > 0"),
    ),
    "silver_sensor_data": (
        ("sv_sensor_machine_never_null", "FAIL", "machine_id IS NOT NULL"),
        ("sv_sensor_id_required", "DROP", "sensor_id IS NOT NULL"),
        ("sv_temp_not_extreme", "DROP", "temperature_celsius < 130"),
        ("sv_vibration_not_extreme", "DROP", "vibration_mm_s < 8"),
        ("sv_tool_wear_max_100", "DROP", "tool_wear_pct <= 100"),
        ("sv_temp_operational_range", "WARN", "temperature_celsius >= 15 AND temperature_celsius <= 95"),
        ("sv_vibration_warning_limit", "WARN", "vibration_mm_s <= 5"),
        ("sv_spindle_speed_reasonable", "WARN", "spindle_speed_rpm >= 0"),
        ("sv_power_non_negative", "WARN", "power_consumption_kw >= 0"),
        ("sv_coolant_flow_running", "WARN", "coolant_flow_lpm >= 1 OR machine_status <> 'Running'"),
        ("sv_tool_wear_advisory", "WARN", "tool_wear_pct < 80"),
        ("sv_machine_status_valid", "WARN", "machine_status IN ('Running', 'Idle', 'Maintenance')"),
        ("sv_reading_ts_not_null", "WARN", "reading_timestamp IS NOT NULL"),
    ),
}
