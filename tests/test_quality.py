import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from millgauge.operators.quality import DROP, FAIL, RULES, WARN, Rule, event_rows, gate, report
from millgauge.operators.silver import refine, type_machines, type_sensor_data, type_work_orders
from tests.frames import machines, readings, text_feed, work_orders

RULE_SET = (
    Rule("key_set", "machine_id IS NOT NULL", FAIL),
    Rule("rate_positive", "hourly_rate_usd > 0", DROP),
    Rule("shifts_in_range", "num_shifts BETWEEN 1 AND 3"),
)


def test_rule_totals():
    actions = [rule.action for rules in RULES.values() for rule in rules]
    assert (len(actions), actions.count(WARN), actions.count(DROP), actions.count(FAIL)) == (59, 43, 12, 4)


def test_gate_counts_all_rules_and_drops(spark):
    df = machines(
        spark,
        dict(machine_id="MCH-001"),
        dict(machine_id="MCH-002", hourly_rate_usd=-1.0, num_shifts=9),
        dict(machine_id="MCH-003", hourly_rate_usd=None),
        dict(machine_id="MCH-004", num_shifts=None),
    )
    seen = Observation()
    kept = {r.machine_id for r in gate(df, RULE_SET, seen).select("machine_id").collect()}
    assert kept == {"MCH-001", "MCH-004"}
    assert event_rows("t", RULE_SET, seen.get) == [
        ("t", "key_set", FAIL, 4, 0),
        ("t", "rate_positive", DROP, 2, 2),  # negative, and unknown
        ("t", "shifts_in_range", WARN, 2, 2),
    ]


def test_report_equals_observed_counts(spark):
    df = machines(spark, dict(hourly_rate_usd=0.0), dict(num_shifts=4), dict())
    seen = Observation()
    gate(df, RULE_SET, seen).count()
    reported = sorted(tuple(r) for r in report(df, "t", RULE_SET).collect())
    assert reported == sorted(event_rows("t", RULE_SET, seen.get))


def test_report_of_empty_table(spark):
    rows = report(machines(spark, dict()).limit(0), "t", RULE_SET).collect()
    assert [(r.passed, r.failed) for r in rows] == [(0, 0)] * 3


def test_fail_rule_stops_the_job(spark):
    df = machines(spark, dict(), dict(machine_id=None))
    with pytest.raises(PySparkException, match="key_set"):
        gate(df, RULE_SET, Observation()).collect()


def test_fail_sees_rows_that_drop_would_remove(spark, tmp_path):
    """Also from Parquet, where a pushed-down DROP could skip the violating row."""
    path = str(tmp_path / "machines")
    machines(spark, dict(machine_id=None, hourly_rate_usd=-5.0)).coalesce(1).write.parquet(path)
    with pytest.raises(PySparkException, match="key_set"):
        gate(spark.read.parquet(path), RULE_SET, Observation()).collect()


def test_failed_write_is_not_committed(spark, tmp_path):
    target = tmp_path / "out"
    with pytest.raises(PySparkException):
        gate(machines(spark, dict(machine_id=None)), RULE_SET, Observation()).write.parquet(str(target))
    assert not (target / "_SUCCESS").exists()


def test_drop_stays_above_the_metrics(spark, tmp_path):
    path = str(tmp_path / "machines")
    machines(spark, dict()).write.parquet(path)
    plan = gate(spark.read.parquet(path), RULE_SET, "metrics")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    metrics = next(i for i, line in enumerate(lines) if "CollectMetrics" in line)
    drop = next(i for i, line in enumerate(lines) if "Filter" in line and "hourly_rate_usd" in line)
    assert drop < metrics


@pytest.mark.parametrize("table", RULES)
def test_all_fail_rules_fire_on_unfiltered_frames(spark, table):
    """The key filter hides FAIL violations in the flow, so check the rules alone."""
    from millgauge.operators.quality import fail_on_violation

    frames = {"silver_machines": machines(spark, dict(machine_id=None)), "silver_work_orders": work_orders(spark, dict(part_number=None)),
              "silver_sensor_data": readings(spark, dict(machine_id=None))}
    if table in frames:
        with pytest.raises(PySparkException):
            fail_on_violation(frames[table], RULES[table]).collect()


def test_malformed_text_becomes_null_and_is_dropped_or_counted(spark):
    feed = text_feed(
        spark, "sensor_data",
        dict(sensor_id="1", machine_id="MCH-001", reading_timestamp="2024-01-01 00:00:00", temperature_celsius="hot", vibration_mm_s="1", tool_wear_pct="5"),
        dict(sensor_id="2", machine_id="MCH-001", reading_timestamp="yesterday", temperature_celsius="20", vibration_mm_s="1", tool_wear_pct="5"),
        dict(sensor_id=None, machine_id="MCH-001"),
    )
    typed = {r.sensor_id: r for r in type_sensor_data(feed).collect()}
    assert set(typed) == {"1", "2"}
    assert typed["1"].temperature_celsius is None and typed["2"].reading_timestamp is None
    assert [r.sensor_id for r in refine("sensor_data", feed).collect()] == ["2"]


@pytest.mark.parametrize(
    "status, actual_end, due_date, late",
    [
        ("Complete", "2024-03-06", "2024-03-06", False),
        ("Complete", "2024-03-07", "2024-03-06", True),
        ("Open", "2024-03-09", "2024-03-06", False),
        ("Complete", "2024-03-09", None, False),
        ("Complete", None, "2024-03-06", False),
        (None, "2024-03-09", "2024-03-06", False),
    ],
)
def test_lateness(spark, status, actual_end, due_date, late):
    feed = text_feed(
        spark, "work_orders",
        dict(work_order_id="WO-1", part_number="PN-1", order_qty="10", setup_time_hrs="0.5", run_time_hrs_per_unit="0.25",
             status=status, actual_end=actual_end, due_date=due_date),
    )
    row = type_work_orders(feed).first()
    assert row.is_late is late and row.is_farm_out is False and row.standard_total_hrs == 3.0


def test_standard_hours_need_every_input(spark):
    feed = text_feed(spark, "work_orders", dict(work_order_id="WO-1", part_number="PN-1", order_qty="many", status="Farm-Out"))
    row = type_work_orders(feed).first()
    assert row.standard_total_hrs is None and row.is_farm_out is True


def test_daily_capacity(spark):
    feed = text_feed(spark, "machines", dict(machine_id="MCH-001", num_shifts="2", capacity_hrs_per_shift="8.0", last_pm_date="2024-01-05"))
    row = type_machines(feed).first()
    assert row.capacity_hrs_per_day == 16.0 and str(row.last_pm_date) == "2024-01-05"


def test_statements_have_the_same_rules_in_their_own_words():
    from checks.rules_sql import RULES as stated

    engine = {table: [(rule.name, rule.action) for rule in rules] for table, rules in RULES.items()}
    assert engine == {table: [rule[:2] for rule in rules] for table, rules in stated.items()}
