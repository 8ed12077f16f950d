"""Registered queries, the statements they are checked against, and the flagship."""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The packages lie next to this file, from wherever it is loaded.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.oracle_sql import statements
from millgauge import session
from millgauge.functions.numeric import tally
from millgauge.operators import dispatch, quality
from millgauge.operators.quality import DROP, RULES, WARN
from millgauge.operators.silver import TYPERS
from millgauge.plans import analytics, dashboard, floor, medallion, metrics, rollups
from millgauge.plans.metrics import metric, where
from millgauge.plans.shop import StagedShop, StoredShop
from millgauge.sources import documentation, staging
from millgauge.sources.landing import read_landing, write_landing
from millgauge.sources.schemas import FEED_COLUMNS, FEEDS
from millgauge.streaming import ingest, state

# Present unless the subpackage of training-data operators has been taken out. Only its own
# absence passes; a package that it needs and that is missing is an error.
_TAKEN_OUT = ("millgauge.llm", "millgauge.llm.queries", "corpus_pipeline")
try:
    from millgauge.llm import queries as llm
except ImportError as error:
    if error.name not in _TAKEN_OUT:
        raise
    llm = None
try:
    import corpus_pipeline
except ImportError as error:
    if error.name not in _TAKEN_OUT:
        raise
    corpus_pipeline = None

# The day that date-relative questions are asked on.
AS_OF = dt.date(2000, 6, 15)

Query = Callable[[SparkSession, str], DataFrame]

# Deliveries come compressed: as plain text they would take several times the room of all tables made from them.
_deliver = partial(write_landing, codec="gzip")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _typed_feed(feed: str, rows: DataFrame) -> DataFrame:
    """Typed rows without the arrival time and file, which differ on every run."""
    typed = TYPERS[feed](rows)
    return typed.drop("_ingested_at", "_source_file", "_file_ts")


def _ingested(shop: StagedShop, feed: str) -> DataFrame:
    """Feed to CSV landing files, streamed to bronze, read back and typed."""
    base = session.fresh_folder(shop.spark, f"ingest-{feed}")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    _deliver(shop.feed(feed), feed, folders.feed(feed))
    ingest.refresh_bronze(shop.spark, feed, folders)
    return _typed_feed(feed, shop.spark.read.parquet(folders.table(f"bronze_{feed}")))


def _streamed_to_silver(shop: StagedShop, feed: str) -> tuple[SparkSession, ingest.Folders]:
    """Feed to CSV landing files, streamed through both gates."""
    base = session.fresh_folder(shop.spark, f"stream-{feed}")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    _deliver(shop.feed(feed), feed, folders.feed(feed))
    ingest.refresh(shop.spark, folders, (feed,))
    return shop.spark, folders


def _silver_of(shop: StagedShop, feed: str) -> DataFrame:
    spark, folders = _streamed_to_silver(shop, feed)
    silver = spark.read.parquet(folders.table(f"silver_{feed}"))
    return silver.drop("_ingested_at", "_source_file", "_file_ts", "batch_id")


def _quality_log(shop: StagedShop) -> DataFrame:
    """The log that streaming every feed through the gate has written, read back."""
    logs = [ingest.quality_log(*_streamed_to_silver(shop, feed)) for feed in FEEDS]
    return _union(logs).groupBy("table_name", "rule", "action").agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


def _reassigned(shop: StagedShop) -> DataFrame:
    """Orders in two deliveries with a stored reassignment between: only those of the first move."""
    base = session.fresh_folder(shop.spark, "reassigned")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    moves, orders, first = _moves(shop), shop.feed("work_orders"), F.col("order_qty") % 2 == 0
    _deliver(shop.feed("machines"), "machines", folders.feed("machines"))
    _deliver(orders.where(first), "work_orders", folders.feed("work_orders"))
    ingest.refresh(shop.spark, folders, ("machines", "work_orders"))
    medallion.reassign(shop.spark, folders.root, moves)
    _deliver(orders.where(~first), "work_orders", folders.feed("work_orders"), mode="append")
    ingest.refresh(shop.spark, folders, ("work_orders",))
    return StoredShop(shop.spark, folders.root).work_orders.drop("_ingested_at", "_source_file")


def _stored_gold(shop: StagedShop) -> DataFrame:
    """The utilization table, written by a refresh of all gold tables and read back in its current version."""
    base = session.fresh_folder(shop.spark, "gold")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    for feed in FEEDS:
        _deliver(shop.feed(feed), feed, folders.feed(feed))
    ingest.refresh(shop.spark, folders)
    return medallion.refresh_gold(shop.spark, folders.root).utilization


def _current_machines(shop: StagedShop) -> DataFrame:
    """Machines delivered three times, some with other notes; the last delivery is not merged into the stored master."""
    base = session.fresh_folder(shop.spark, "master")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    feed, last = shop.feed("machines"), F.substring("machine_id", -1, 1)
    later = [feed.where(last.isin("2", "5", "8")).withColumn("notes", F.lit("Serviced")), feed.where(last.isin("5", "7")).withColumn("notes", F.lit("Moved"))]
    for number, rows in enumerate([feed, *later]):
        _deliver(rows, "machines", folders.feed("machines"), mode="append")
        ingest.refresh(shop.spark, folders, ("machines",))
        if number < len(later):
            medallion.refresh_master(shop.spark, folders.root)
    return StoredShop(shop.spark, folders.root).machines.drop("_ingested_at", "_source_file", "_file_ts")


def _looked_up(shop: StagedShop) -> DataFrame:
    """Orders in two deliveries, laid out by order and machine, looked up by machine."""
    base = session.fresh_folder(shop.spark, "zones")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    for part in range(2):
        rows = shop.feed("work_orders").where(F.col("order_qty") % 2 == part)
        _deliver(rows, "work_orders", folders.feed("work_orders"), mode="append")
        ingest.refresh(shop.spark, folders, ("work_orders",))
        medallion.lay_out(shop.spark, folders.root, "silver_work_orders")
    found = medallion.lookup(shop.spark, folders.root, "silver_work_orders", machine_id=("MCH-003", "MCH-005"))
    return found.drop("_ingested_at", "_source_file")


def _in_thirds(shop: StagedShop, feed: str, number: str, *tables: str) -> tuple[SparkSession, str]:
    """A feed delivered in three parts, the rollups brought up to date after each."""
    base = session.fresh_folder(shop.spark, "thirds")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    _deliver(shop.feed("machines"), "machines", folders.feed("machines"))
    ingest.refresh(shop.spark, folders, ("machines",))
    for part in range(3):
        rows = shop.feed(feed).where(F.pmod(F.xxhash64(number), F.lit(3)) == part)
        _deliver(rows, feed, folders.feed(feed), mode="append")
        ingest.refresh(shop.spark, folders, (feed,))
        medallion.refresh_incremental(shop.spark, folders.root, tables)
    return shop.spark, folders.root


def _incremental(feed: str, number: str, table: str):
    return lambda shop: medallion.incremental(*_in_thirds(shop, feed, number, table), table)


def _stream_of_readings(shop: StagedShop, deliveries: int, refresh) -> ingest.Folders:
    """The sensor feed delivered so often, each time through both gates and into a stream with state, which restarts in between."""
    base = session.fresh_folder(shop.spark, "readings")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    for _ in range(deliveries):
        _deliver(shop.feed("sensor_data"), "sensor_data", folders.feed("sensor_data"), mode="append")
        ingest.refresh(shop.spark, folders, ("sensor_data",))
        refresh(state.silver_readings(shop.spark, folders), folders)
    return folders


def _daily_health(shop: StagedShop) -> DataFrame:
    return state.daily_health(shop.spark, _stream_of_readings(shop, 1, state.refresh_daily_health), shop.machines)


def _newest_readings(shop: StagedShop) -> DataFrame:
    return state.newest(shop.spark, _stream_of_readings(shop, 1, state.refresh_newest))


def _unique_readings(shop: StagedShop) -> DataFrame:
    folders = _stream_of_readings(shop, 2, state.refresh_readings)
    rows = shop.spark.read.parquet(folders.table("unique_readings"))
    return rows.drop("_ingested_at", "_source_file", "batch_id")


def _dropped_readings(shop: StagedShop) -> DataFrame:
    return state.dropped(shop.spark, _stream_of_readings(shop, 2, state.refresh_readings))


def _landed(shop: StagedShop, feed: str) -> DataFrame:
    """Feed written as CSV and read back as one batch."""
    folder = session.fresh_folder(shop.spark, f"landing-{feed}")
    _deliver(shop.feed(feed), feed, folder)
    return _typed_feed(feed, read_landing(shop.spark, feed, folder))


def _mapped_by_header(shop: StagedShop) -> DataFrame:
    """Routings in two layouts: the feed's own, and turned round with one column less and one more, which is rescued."""
    base = session.fresh_folder(shop.spark, "headers")
    folders = ingest.Folders(landing=f"{base}/landing", root=f"{base}/tables")
    routings, own = shop.feed("routings"), F.col("operation_sequence") % 20 == 0
    turned = [name for name in reversed(FEED_COLUMNS["routings"]) if name != "scrap_rate_pct"]
    other = routings.where(~own).withColumn("plant", F.col("work_center"))
    _deliver(routings.where(own), "routings", folders.feed("routings"))
    _deliver(other, "routings", folders.feed("routings"), mode="append", columns=["plant", *turned])
    ingest.refresh_bronze(shop.spark, "routings", folders)
    bronze = shop.spark.read.parquet(folders.table("bronze_routings"))
    plant = bronze.select("routing_id", F.col("_rescued_data")["plant"].alias("rescued_plant"))
    return _typed_feed("routings", bronze).join(plant, "routing_id")


def _gate_feed(shop: StagedShop, feed: str, priority: bool = False) -> DataFrame:
    """A feed with the columns its rules read. No rule reads the part description."""
    if feed == "work_orders":
        return staging.work_orders(shop.spark, shop.folder, priority=priority, description=False)
    return shop.feed(feed)


def _before_gate(shop: StagedShop) -> dict[str, DataFrame]:
    """Each table as its rules see it."""
    bronze = {f"bronze_{feed}": _gate_feed(shop, feed) for feed in FEEDS}
    silver = {f"silver_{feed}": TYPERS[feed](_gate_feed(shop, feed, priority=True)) for feed in FEEDS}
    return {**bronze, **silver}


def _event_log(shop: StagedShop, *actions: str) -> DataFrame:
    reports = []
    for table, frame in _before_gate(shop).items():
        rules = quality.rules_with(table, *actions) if actions else RULES[table]
        if rules:
            reports.append(quality.report(frame, table, rules))
    return _union(reports)


def _drop_counts(shop: StagedShop) -> DataFrame:
    """Rows in, kept and dropped per silver table."""
    counts = []
    for feed in FEEDS:
        table, typed = f"silver_{feed}", TYPERS[feed](_gate_feed(shop, feed))
        keep = reduce(lambda a, b: a & b, (rule.holds() for rule in quality.rules_with(table, DROP)))
        counts.append(
            typed.agg(F.count(F.lit(1)).alias("rows_in"), tally(keep).alias("rows_kept"), tally(~keep).alias("rows_dropped"))
            .select(F.lit(table).alias("table_name"), "rows_in", "rows_kept", "rows_dropped")
        )
    return _union(counts)


def _fail_check(shop: StagedShop) -> DataFrame:
    """Rows of each silver table after its FAIL rules; a violation stops the job."""
    passed = []
    for feed in FEEDS:
        table = f"silver_{feed}"
        checked = quality.fail_on_violation(TYPERS[feed](_gate_feed(shop, feed)), RULES[table])
        passed.append(checked.agg(F.count(F.lit(1)).alias("rows_passed")).select(F.lit(table).alias("table_name"), "rows_passed"))
    return _union(passed)


def _dictionary(shop: StagedShop) -> DataFrame:
    return _union([documentation.dictionary(getattr(shop, feed), f"silver_{feed}") for feed in FEEDS])


def _gold_dictionary(shop: StagedShop) -> DataFrame:
    gold = [(name, attribute) for name, attribute in medallion.TABLES.items() if name.startswith("gold_")]
    return _union([documentation.dictionary(getattr(shop, attribute), name) for name, attribute in gold])


def _failed(shop: StagedShop) -> DataFrame:
    return dispatch.reported_machines(shop.incidents)


def _moves(shop: StagedShop) -> DataFrame:
    down = dispatch.out_of_service(shop.machines, _failed(shop))
    return dispatch.choose_moves(shop.machines, shop.bare_orders, down)


_SHOP_QUERIES: dict[str, Callable[[StagedShop], DataFrame]] = {
    # sources
    **{f"ingest_{feed}": (lambda s, feed=feed: _ingested(s, feed)) for feed in FEEDS},
    **{f"ingest_silver_{feed}": (lambda s, feed=feed: _silver_of(s, feed)) for feed in FEEDS},
    "quality_log": _quality_log,
    # streams with state
    "stream_daily_health": _daily_health,
    "stream_newest_reading": _newest_readings,
    "stream_unique_readings": _unique_readings,
    "stream_dropped_readings": _dropped_readings,
    "write_landing": lambda s: _landed(s, "routings"),
    "ingest_by_header": _mapped_by_header,
    "describe_columns": _dictionary,
    "describe_gold_columns": _gold_dictionary,
    # quality
    "dq_warn_report": lambda s: _event_log(s, WARN),
    "dq_drop_rows": _drop_counts,
    "dq_fail_check": _fail_check,
    "dq_event_log": _event_log,
    # silver
    "silver_machines": lambda s: s.machines,
    "silver_routings": lambda s: s.routings,
    "silver_work_orders": lambda s: s.work_orders,
    "silver_sensor_data": lambda s: s.sensor_data,
    "health_score": lambda s: s.sensor_data.groupBy("health_score").agg(F.count(F.lit(1)).alias("readings")),
    # gold
    "gold_machine_utilization": lambda s: s.utilization,
    "gold_scheduling_performance": lambda s: s.scheduling,
    "gold_predictive_maintenance": lambda s: s.maintenance,
    "gold_capacity_planning": lambda s: s.capacity,
    "gold_farmout_analysis": lambda s: s.farmout,
    "gold_stored_utilization": _stored_gold,
    "gold_incremental_maintenance": _incremental("sensor_data", "sensor_id", "gold_predictive_maintenance"),
    "gold_incremental_scheduling": _incremental("work_orders", "work_order_id", "gold_scheduling_performance"),
    "gold_incremental_farmout": _incremental("work_orders", "work_order_id", "gold_farmout_analysis"),
    # analytics
    "q1_1_top_machines": lambda s: analytics.top_machines(s.utilization),
    "q1_2_utilization_trend": lambda s: analytics.utilization_trend(s.utilization),
    "q1_3_utilization_yearly": lambda s: analytics.utilization_yearly(s.utilization),
    "q2_1_otd_monthly": lambda s: analytics.on_time_monthly(s.scheduling),
    "q2_2_weekly_pressure": lambda s: analytics.weekly_pressure(s.scheduling),
    "q2_3_yearly_summary": lambda s: analytics.yearly_summary(s.scheduling),
    "q3_1_health_snapshot": lambda s: analytics.health_snapshot(s.maintenance),
    "q3_2_health_trend": lambda s: analytics.health_trend(s.maintenance),
    "q3_3_pm_due": lambda s: analytics.pm_due(s.maintenance),
    "q4_1_capacity_monthly": lambda s: analytics.capacity_monthly(s.capacity),
    "q4_2_capacity_yearly": lambda s: analytics.capacity_yearly(s.capacity),
    "q4_3_overloaded": lambda s: analytics.overloaded_centers(s.capacity),
    "q5_1_vendor_cost": lambda s: analytics.vendor_cost(s.farmout),
    "q5_2_farmout_trend": lambda s: analytics.farmout_trend(s.farmout),
    "q5_3_top_parts": lambda s: analytics.top_parts(s.farmout),
    # dashboard
    "dashboard_utilization_monthly": lambda s: dashboard.utilization_monthly(s.utilization),
    "dashboard_scheduling_monthly": lambda s: dashboard.scheduling_monthly(s.scheduling),
    "dashboard_health_snapshot": lambda s: dashboard.health_snapshot(s.maintenance),
    "dashboard_capacity_monthly": lambda s: dashboard.capacity_monthly(s.capacity),
    "dashboard_vendor_costs": lambda s: dashboard.vendor_costs(s.farmout),
    "kpi_summary": lambda s: dashboard.kpi_summary(s.utilization),
    "revenue_by_machine": lambda s: dashboard.revenue_by_machine(s.utilization),
    "utilization_trend_fleet": lambda s: dashboard.utilization_trend_fleet(s.utilization),
    "scheduling_kpis": lambda s: dashboard.scheduling_kpis(s.scheduling),
    "otd_trend": lambda s: dashboard.otd_trend(s.scheduling),
    "farmout_by_work_center": lambda s: dashboard.farmout_by_work_center(s.scheduling),
    "health_kpis": lambda s: dashboard.health_kpis(s.maintenance),
    "urgency_distribution": lambda s: dashboard.urgency_distribution(s.maintenance),
    "capacity_kpis": lambda s: dashboard.capacity_kpis(s.capacity),
    "demand_vs_capacity": lambda s: dashboard.demand_vs_capacity(s.capacity),
    "demand_vs_capacity_latest": lambda s: dashboard.demand_vs_capacity_latest(s.capacity),
    "load_status_distribution": lambda s: dashboard.load_status_distribution(s.capacity),
    "farmout_kpis": lambda s: dashboard.farmout_kpis(s.farmout),
    # true periods and routings
    "kpi_rollup": lambda s: rollups.kpi_rollup(s.bare_orders),
    "utilization_rollup": lambda s: rollups.utilization_rollup(s.utilization),
    "routing_hours_variance": lambda s: rollups.routing_hours_variance(s.bare_orders, s.routings),
    # shop-floor application
    "machine_status_counts": lambda s: floor.machine_status_counts(s.machines),
    "performance_kpis": lambda s: floor.performance_kpis(s.bare_orders, s.utilization, s.farmout, s.maintenance),
    "utilization_by_machine": lambda s: floor.utilization_by_machine(s.utilization, s.machines),
    "scheduling_trend": lambda s: floor.scheduling_trend(s.scheduling),
    "farmout_by_vendor": lambda s: floor.farmout_by_vendor(s.farmout),
    "maintenance_summary": lambda s: floor.maintenance_summary(s.maintenance),
    "capacity_latest": lambda s: floor.capacity_latest(s.capacity),
    "machine_kpis": lambda s: floor.machine_kpis(s.machines, s.bare_orders, s.utilization, s.maintenance),
    "machine_fleet": lambda s: floor.machine_fleet(s.machines, s.described_orders, s.sensor_data),
    "machines_list": lambda s: floor.machines_list(s.machines),
    "machine_detail": lambda s: floor.machine_detail(s.machines, s.sensor_data),
    "machine_orders": lambda s: dispatch.machine_orders(s.work_orders),
    "alternative_machines": lambda s: dispatch.alternative_machines(s.machines, s.bare_orders),
    "gauge_bands": lambda s: floor.gauge_bands(s.machines, s.sensor_data),
    # failures and reassignment
    "extract_machine_id": lambda s: dispatch.extract_machine_ids(s.incidents).select("incident_id", "report_text", "machine_id"),
    "machine_lookup": lambda s: dispatch.machine_lookup(s.machines, _failed(s)),
    "affected_work_orders": lambda s: dispatch.affected_work_orders(s.work_orders, _failed(s)),
    "replacement_candidates": lambda s: dispatch.replacement_candidates(s.machines, s.bare_orders, _failed(s)),
    "active_order_counts": lambda s: dispatch.active_order_counts(s.bare_orders),
    "replacement_moves": lambda s: dispatch.move_counts(s.bare_orders, _moves(s), s.machines),
    "reassign_work_orders": lambda s: dispatch.reassign_work_orders(s.work_orders, _moves(s), s.machines),
    "reassigned_orders_stored": _reassigned,
    # stored layouts
    "machines_stored_current": _current_machines,
    "orders_looked_up_by_machine": _looked_up,
    # named metrics
    "measure_utilization_pct_rounded": lambda s: s.utilization.select("machine_id", "period_day", metric("utilization_pct_rounded")),
    "measure_farm_out_rate_pct": lambda s: s.capacity.select("work_center", "period_month", metric("farm_out_rate_pct")),
    "measure_standard_total_hrs": lambda s: s.bare_orders.select("work_order_id", metric("standard_total_hrs")),
    "measure_days_since_last_pm": lambda s: s.machines.select("machine_id", metric("days_since_last_pm_calc", as_of=AS_OF)),
    "measure_cost_premium_pct": lambda s: s.farmout.select(
        "farm_out_vendor", "part_number", "period_month", metric("cost_premium_pct_calc")
    ),
    "filter_farm_out_orders": lambda s: where(s.bare_orders, "farm_out_orders").select("work_order_id", "farm_out_vendor"),
    "filter_late_orders": lambda s: where(s.bare_orders, "late_orders").select("work_order_id", "due_date", "actual_end"),
    "filter_active_machines": lambda s: where(s.machines, "active_machines").select("machine_id", "status"),
    "filter_critical_health": lambda s: where(s.maintenance, "critical_health").select(
        "machine_id", "reading_date", "maintenance_urgency"
    ),
    "filter_overloaded_wc": lambda s: where(s.capacity, "overloaded_wc").select("work_center", "period_month", "load_status"),
    "filter_high_priority_orders": lambda s: where(s.ranked_orders, "high_priority_orders").select("work_order_id", "priority"),
    "expr_health_category": lambda s: s.maintenance.select("machine_id", "reading_date", metric("health_category")),
    "expr_load_status_derived": lambda s: s.capacity.select("work_center", "period_month", metric("load_status_derived")),
    "expr_month_display": lambda s: s.capacity.select(metric("month_display")).distinct(),
    "expr_otd_pct_computed": lambda s: s.bare_orders.groupBy("work_center").agg(metric("otd_pct_computed")),
    "critical_machines": lambda s: metrics.critical_machines(s.maintenance),
    "otd_by_work_center_year": lambda s: metrics.otd_by_work_center_year(s.scheduling, AS_OF),
    "work_order_detail": lambda s: metrics.work_order_detail(s.work_orders),
    "open_orders_by_work_center": lambda s: metrics.open_orders_by_work_center(s.bare_orders),
    "orders_due_within": lambda s: metrics.orders_due_within(s.ranked_orders, AS_OF),
    "scheduled_vs_actual": lambda s: metrics.scheduled_vs_actual(s.utilization, AS_OF),
    "late_orders": lambda s: metrics.late_orders(s.ranked_orders),
    "otd_last_months": lambda s: metrics.otd_last_months(s.scheduling, AS_OF),
    "top_utilization_year": lambda s: metrics.top_utilization_year(s.utilization, AS_OF),
    "vendor_cost_year": lambda s: metrics.vendor_cost_year(s.farmout, AS_OF),
}


def entry(spark: SparkSession) -> DataFrame:
    """Top machines by utilization on the smallest supplied data."""
    return queries()["q1_1_top_machines"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    shop = {
        name: (lambda spark, folder, build=build: build(StagedShop(spark, folder)))
        for name, build in _SHOP_QUERIES.items()
    }
    corpus = dict(llm.QUERIES) if llm else {}
    if corpus_pipeline:
        corpus["pipeline"] = corpus_pipeline.run
    return {**shop, **corpus}


def oracle_sql() -> dict[str, str]:
    return {**statements(AS_OF.isoformat()), **(llm.STATEMENTS if llm else {})}
