"""Row-quality gate: count, drop or fail on rules given as predicates.

A rule holds for a row when its predicate is true; false and unknown (null) are
both violations. Three actions exist: WARN counts, DROP counts and removes, FAIL
aborts the job at the first violating row.

The gate fixes the order FAIL, then metrics, then DROP. Were DROP allowed below
FAIL, a row violating both could be removed before FAIL saw it. The metrics node
in between is what keeps the optimizer from moving DROP down into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millgauge.functions.numeric import tally

WARN, DROP, FAIL = "WARN", "DROP", "FAIL"

ROWS = "rows_seen"


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    action: str = WARN

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))

    @property
    def metric(self) -> str:
        return f"failed_{self.name}_{self.action.lower()}"


# Rule names, predicates and actions per table.
RULES: dict[str, tuple[Rule, ...]] = {
    "bronze_machines": (
        Rule("bz_machine_id_not_null", "machine_id IS NOT NULL"),
        Rule("bz_machine_id_format", "machine_id RLIKE '^MCH-[0-9]+'"),
        Rule("bz_status_not_null", "status IS NOT NULL"),
        Rule("bz_hourly_rate_positive", "try_cast(hourly_rate_usd AS DOUBLE) > 0"),
    ),
    "bronze_routings": (
        Rule("bz_routing_id_not_null", "routing_id IS NOT NULL"),
        Rule("bz_part_number_not_null", "part_number IS NOT NULL"),
        Rule("bz_op_sequence_positive", "try_cast(try_cast(operation_sequence AS DOUBLE) AS INT) > 0"),
        Rule("bz_run_time_non_negative", "try_cast(run_time_hrs_per_unit AS DOUBLE) >= 0"),
    ),
    "bronze_work_orders": (
        Rule("bz_wo_id_not_null", "work_order_id IS NOT NULL"),
        Rule("bz_wo_part_not_null", "part_number IS NOT NULL"),
        Rule("bz_wo_qty_positive", "try_cast(try_cast(order_qty AS DOUBLE) AS INT) > 0"),
        Rule("bz_wo_status_not_null", "status IS NOT NULL"),
        Rule("bz_wo_due_date_not_null", "due_date IS NOT NULL"),
    ),
    "bronze_sensor_data": (
        Rule("bz_sensor_id_not_null", "sensor_id IS NOT NULL"),
        Rule("bz_sensor_machine_id", "machine_id IS NOT NULL"),
        Rule("bz_temp_parseable", "try_cast(temperature_celsius AS DOUBLE) IS NOT NULL"),
        Rule("bz_ts_not_null", "reading_timestamp IS NOT NULL"),
        Rule("bz_machine_ref_required", "machine_id IS NOT NULL", DROP),
    ),
    "silver_machines": (
        Rule("sv_machine_pk_never_null", "machine_id IS NOT NULL", FAIL),
        Rule("sv_machine_capacity_positive", "capacity_hrs_per_shift > 0", DROP),
        Rule("sv_hourly_rate_positive", "hourly_rate_usd > 0", DROP),
        Rule("sv_machine_status_valid", "status IN ('Active', 'Maintenance', 'Idle')"),
        Rule("sv_shifts_in_range", "num_shifts BETWEEN 1 AND 3"),
        Rule("sv_capacity_shift_range", "capacity_hrs_per_shift BETWEEN 4 AND 12"),
        Rule("sv_installation_year_recent", "installation_year >= 2000"),
        Rule("sv_pm_interval_reasonable", "preventive_maint_interval_hrs BETWEEN 100 AND 3000"),
        Rule("sv_last_pm_date_set", "last_pm_date IS NOT NULL"),
    ),
    "silver_routings": (
        Rule("sv_routing_pk_never_null", "routing_id IS NOT NULL AND part_number IS NOT NULL", FAIL),
        Rule("sv_routing_seq_positive", "operation_sequence > 0", DROP),
        Rule("sv_scrap_rate_non_negative", "scrap_rate_pct >= 0", DROP),
        Rule("sv_setup_time_non_negative", "setup_time_hrs >= 0"),
        Rule("sv_run_time_positive", "run_time_hrs_per_unit > 0"),
        Rule("sv_scrap_rate_reasonable", "scrap_rate_pct BETWEEN 0 AND 30"),
        Rule("sv_routing_work_center_set", "work_center IS NOT NULL"),
    ),
    "silver_work_orders": (
        Rule("sv_wo_pk_never_null", "work_order_id IS NOT NULL AND part_number IS NOT NULL", FAIL),
        Rule("sv_wo_qty_positive", "order_qty > 0", DROP),
        Rule("sv_farmout_cost_non_negative", "farm_out_cost_usd IS NULL OR farm_out_cost_usd >= 0", DROP),
        Rule("sv_setup_time_non_negative", "setup_time_hrs >= 0", DROP),
        Rule("sv_wo_status_valid", "status IN ('Open', 'In Progress', 'Complete', 'Farm-Out')"),
        Rule("sv_wo_priority_valid", "priority IN ('High', 'Medium', 'Low')"),
        Rule(
            "sv_wo_work_center_known",
            "work_center IN ('WC-MILL', 'WC-TURN', 'WC-DRILL', 'WC-MULTITASK', 'WC-TRANSFER', 'WC-QC')",
        ),
        Rule("sv_wo_due_date_set", "due_date IS NOT NULL"),
        Rule(
            "sv_wo_sched_dates_ordered",
            "scheduled_start IS NULL OR scheduled_end IS NULL OR scheduled_start <= scheduled_end",
        ),
        Rule("sv_farmout_has_vendor", "status <> 'Farm-Out' OR farm_out_vendor IS NOT NULL"),
        Rule("sv_complete_has_actual_end", "status <> 'Complete' OR actual_end IS NOT NULL"),
        Rule("sv_run_time_positive", "run_time_hrs_per_unit > 0"),
    ),
    "silver_sensor_data": (
        Rule("sv_sensor_machine_never_null", "machine_id IS NOT NULL", FAIL),
        Rule("sv_sensor_id_required", "sensor_id IS NOT NULL", DROP),
        Rule("sv_temp_not_extreme", "temperature_celsius < 130", DROP),
        Rule("sv_vibration_not_extreme", "vibration_mm_s < 8.0", DROP),
        Rule("sv_tool_wear_max_100", "tool_wear_pct <= 100", DROP),
        Rule("sv_temp_operational_range", "temperature_celsius BETWEEN 15 AND 95"),
        Rule("sv_vibration_warning_limit", "vibration_mm_s <= 5.0"),
        Rule("sv_spindle_speed_reasonable", "spindle_speed_rpm >= 0"),
        Rule("sv_power_non_negative", "power_consumption_kw >= 0"),
        Rule("sv_coolant_flow_running", "coolant_flow_lpm >= 1.0 OR machine_status <> 'Running'"),
        Rule("sv_tool_wear_advisory", "tool_wear_pct < 80"),
        Rule("sv_machine_status_valid", "machine_status IN ('Running', 'Idle', 'Maintenance')"),
        Rule("sv_reading_ts_not_null", "reading_timestamp IS NOT NULL"),
    ),
}


def _with_action(rules: Iterable[Rule], action: str) -> list[Rule]:
    return [rule for rule in rules if rule.action == action]


def _metric_columns(rules: Iterable[Rule]) -> list[Column]:
    counts = [tally(~rule.holds()).alias(rule.metric) for rule in rules]
    return [F.count(F.lit(1)).alias(ROWS), *counts]


def fail_on_violation(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Pass every row through, raising on the first that breaks a FAIL rule."""
    for rule in _with_action(rules, FAIL):
        stop = F.raise_error(F.lit(f"quality rule {rule.name} violated: {rule.predicate}"))
        df = df.filter(F.when(rule.holds(), F.lit(True)).otherwise(stop.cast("boolean")))
    return df


def drop_violations(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Only the rows that satisfy every DROP rule.

    A filter takes an unknown predicate for false, as a rule does, so the bare
    predicates are used: those Spark can push down to a scan.
    """
    checks = [F.expr(rule.predicate) for rule in _with_action(rules, DROP)]
    return df.filter(reduce(Column.__and__, checks)) if checks else df


def gate(df: DataFrame, rules: Iterable[Rule], metrics: Observation | str) -> DataFrame:
    """Apply FAIL, observe all rules in the same pass, then apply DROP.

    ``metrics`` is an :class:`Observation` for a batch job, or a name under which
    a streaming query reports the counts in its progress.
    """
    rules = tuple(rules)
    checked = fail_on_violation(df, rules)
    observed = checked.observe(metrics, *_metric_columns(rules))
    return drop_violations(observed, rules)


def event_rows(table: str, rules: Iterable[Rule], counts: Mapping[str, int | None]) -> list[tuple]:
    """Observed counts as (table, rule, action, passed, failed) rows."""
    total = counts.get(ROWS) or 0
    rows = []
    for rule in rules:
        failed = counts.get(rule.metric) or 0
        rows.append((table, rule.name, rule.action, total - failed, failed))
    return rows


def report(df: DataFrame, table: str, rules: Iterable[Rule]) -> DataFrame:
    """The same rows computed as a query: one aggregate pass, then one row per rule."""
    rules = tuple(rules)
    counts = df.agg(*_metric_columns(rules))
    total = F.col(ROWS)
    entries = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(rule.name).alias("rule"),
            F.lit(rule.action).alias("action"),
            (total - F.coalesce(F.col(rule.metric), F.lit(0))).alias("passed"),
            F.coalesce(F.col(rule.metric), F.lit(0)).cast("bigint").alias("failed"),
        )
        for rule in rules
    ]
    return counts.select(F.inline(F.array(*entries)))


def rules_with(table: str, *actions: str) -> tuple[Rule, ...]:
    return tuple(rule for rule in RULES[table] if rule.action in actions)
