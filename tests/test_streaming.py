import datetime as dt
import glob
import os
import shutil
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter

from millgauge import session
from millgauge.operators import gold
from millgauge.operators.silver import refine
from millgauge.plans import analytics, medallion
from millgauge.plans.shop import StagedShop, StoredShop
from millgauge.sources import landing
from millgauge.sources.landing import header_names, read_landing, write_landing
from millgauge.sources.schemas import FEEDS
from millgauge.streaming import ingest
from tests.frames import text_feed


@pytest.fixture
def folders(tmp_path):
    return ingest.Folders(landing=str(tmp_path / "landing"), root=str(tmp_path / "tables"))


def reading(number, **changes):
    row = dict(
        sensor_id=f"S-{number}", machine_id="MCH-001", reading_timestamp="2024-01-01 00:00:00", temperature_celsius="40",
        vibration_mm_s="1", spindle_speed_rpm="900", power_consumption_kw="9", coolant_flow_lpm="5", tool_wear_pct="10",
        machine_status="Running", anomaly_flag="false",
    )
    return {**row, **changes}


def deliver(spark, folders, feed, number, *rows):
    """Add one more CSV file to the feed's landing folder."""
    part = f"{folders.root}-delivery-{number}"
    write_landing(text_feed(spark, feed, *rows), feed, part, files=1)
    os.makedirs(folders.feed(feed), exist_ok=True)
    for file in glob.glob(f"{part}/part-*.csv"):
        shutil.copy(file, f"{folders.feed(feed)}/delivery-{number}.csv")


def log_of(spark, folders, table):
    rows = ingest.quality_log(spark, folders).filter(f"table_name = '{table}'").collect()
    return {(r.batch_id, r.rule): (r.passed, r.failed) for r in rows}


def test_two_deliveries(spark, folders):
    deliver(spark, folders, "sensor_data", 1, reading(1), reading(2, machine_id=None), reading(3, temperature_celsius="hot"))
    ingest.refresh(spark, folders, ("sensor_data",))
    deliver(spark, folders, "sensor_data", 2, reading(4), reading(5, vibration_mm_s="9"), reading(6, sensor_id=None))
    ingest.refresh(spark, folders, ("sensor_data",))
    ingest.refresh(spark, folders, ("sensor_data",))  # nothing new

    bronze = spark.read.parquet(folders.table("bronze_sensor_data"))
    silver = spark.read.parquet(folders.table("silver_sensor_data"))
    assert sorted(r.sensor_id or "" for r in bronze.collect()) == ["", "S-1", "S-3", "S-4", "S-5"]
    assert sorted(r.sensor_id for r in silver.collect()) == ["S-1", "S-4"]
    assert all(r._source_file.endswith(".csv") and r._ingested_at for r in bronze.collect())

    bronze_log = log_of(spark, folders, "bronze_sensor_data")
    assert bronze_log[(0, "bz_machine_ref_required")] == (2, 1)
    assert bronze_log[(0, "bz_sensor_machine_id")] == (2, 1)
    assert bronze_log[(0, "bz_temp_parseable")] == (2, 1)
    assert bronze_log[(1, "bz_sensor_id_not_null")] == (2, 1)
    silver_log = log_of(spark, folders, "silver_sensor_data")
    assert silver_log[(0, "sv_temp_not_extreme")] == (1, 1)
    assert silver_log[(1, "sv_vibration_not_extreme")] == (1, 1)
    assert {batch for batch, _ in bronze_log} == {0, 1}


def test_one_log_entry_per_batch(spark, folders):
    for number in range(3):
        deliver(spark, folders, "sensor_data", number, reading(number))
    ingest.refresh_bronze(spark, "sensor_data", folders, files_per_batch=1)
    log = log_of(spark, folders, "bronze_sensor_data")
    assert {batch for batch, _ in log} == {0, 1, 2}
    assert all(counts == (1, 0) for counts in log.values())


def test_failed_batch_leaves_nothing_and_runs_again(spark, folders, monkeypatch):
    from millgauge.operators.quality import FAIL, RULES, Rule

    deliver(spark, folders, "sensor_data", 1, reading(1))
    ingest.refresh_bronze(spark, "sensor_data", folders)
    deliver(spark, folders, "sensor_data", 2, reading(2), reading(3, sensor_id=None))
    strict = (*RULES["bronze_sensor_data"], Rule("id_required", "sensor_id IS NOT NULL", FAIL))
    monkeypatch.setitem(RULES, "bronze_sensor_data", strict)
    with pytest.raises(PySparkException):
        ingest.refresh_bronze(spark, "sensor_data", folders)
    assert [r.sensor_id for r in spark.read.parquet(folders.table("bronze_sensor_data")).collect()] == ["S-1"]
    monkeypatch.undo()
    ingest.refresh_bronze(spark, "sensor_data", folders)
    assert spark.read.parquet(folders.table("bronze_sensor_data")).count() == 3


def test_stream_equals_batch_and_gold_equals_staged(spark, data, folders):
    staged = StagedShop(spark, data)
    for feed in FEEDS:
        write_landing(staged.feed(feed), feed, folders.feed(feed), files=2)
    ingest.refresh(spark, folders)

    for feed in FEEDS:
        batch = refine(feed, read_landing(spark, feed, folders.feed(feed))).drop("_ingested_at", "_source_file")
        stream = spark.read.parquet(folders.table(f"silver_{feed}")).select(*batch.columns)
        assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()

    shop = medallion.refresh_gold(spark, folders.root)
    for name in ("utilization", "scheduling", "maintenance", "capacity", "farmout"):
        stored, derived = getattr(shop, name), getattr(staged, name)
        assert set(stored.columns) == set(derived.columns)
        stored = stored.select(*derived.columns)
        assert stored.exceptAll(derived).isEmpty() and derived.exceptAll(stored).isEmpty()
    top = [tuple(r) for r in analytics.top_machines(shop.utilization).collect()]
    assert top == [tuple(r) for r in analytics.top_machines(staged.utilization).collect()]

    scans = gold.farmout_analysis(shop.work_orders)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_farm_out,true)" in scans and "actual_start" not in scans

    medallion.register_views(shop)
    asked = """SELECT w.work_center, count(*) AS n, max(u.period_day) AS newest
               FROM silver_work_orders w JOIN gold_machine_utilization u ON u.machine_id = w.machine_id GROUP BY 1"""
    assert spark.sql(asked).count() > 0

    medallion.publish_gold(spark, folders.root, "published")
    medallion.publish_gold(spark, folders.root, "published")
    try:
        table = spark.table("published.gold_capacity_planning")
        assert table.count() == staged.capacity.count()
        described = {c.name: c.description for c in spark.catalog.listColumns("published.gold_capacity_planning")}
        assert described["load_status"] == "Load class of the center's month."
    finally:
        spark.sql("DROP SCHEMA published CASCADE")


def test_redelivered_master_does_not_multiply_orders(spark, folders):
    master = dict(machine_id="MCH-001", machine_name="old", work_center="WC-MILL", num_shifts="1", capacity_hrs_per_shift="8",
                  hourly_rate_usd="50", status="Active", last_pm_date="2024-01-01")
    order = dict(work_order_id="WO-1", part_number="PN-1", order_qty="10", machine_id="MCH-001", work_center="WC-MILL",
                 setup_time_hrs="0.5", run_time_hrs_per_unit="0.25", scheduled_start="2024-03-04", due_date="2024-03-06", status="Open")
    deliver(spark, folders, "machines", 1, master)
    ingest.refresh(spark, folders, ("machines",))
    deliver(spark, folders, "machines", 2, {**master, "machine_name": "new", "num_shifts": "2"})
    deliver(spark, folders, "work_orders", 3, order)
    deliver(spark, folders, "sensor_data", 4, reading(1))
    ingest.refresh(spark, folders, ("machines", "work_orders", "sensor_data"))

    assert spark.read.parquet(folders.table("silver_machines")).count() == 2
    shop = StoredShop(spark, folders.root)
    assert [r.machine_name for r in shop.machines.collect()] == ["new"]
    rows = medallion.refresh_gold(spark, folders.root).utilization.collect()
    assert [(r.work_order_count, r.capacity_hrs_per_day) for r in rows] == [(1, 16.0)]


def test_failure_keeps_the_log_of_earlier_batches(spark, folders, monkeypatch):
    from millgauge.operators.quality import FAIL, RULES, Rule

    strict = (*RULES["bronze_sensor_data"], Rule("id_required", "sensor_id IS NOT NULL", FAIL))
    monkeypatch.setitem(RULES, "bronze_sensor_data", strict)
    deliver(spark, folders, "sensor_data", 1, reading(1))
    ingest.refresh_bronze(spark, "sensor_data", folders)
    deliver(spark, folders, "sensor_data", 2, reading(2))
    # Files go oldest first, and one of a month ago is still taken.
    month_ago = time.time() - 30 * 86400
    os.utime(f"{folders.feed('sensor_data')}/delivery-2.csv", (month_ago, month_ago))
    deliver(spark, folders, "sensor_data", 3, reading(3, sensor_id=None))
    with pytest.raises(PySparkException):
        ingest.refresh_bronze(spark, "sensor_data", folders, files_per_batch=1)
    log = log_of(spark, folders, "bronze_sensor_data")
    assert {batch for batch, _ in log} == {0, 1}
    assert spark.read.parquet(folders.table("bronze_sensor_data")).count() == 2


def test_no_entry_is_lost_when_the_driver_stops_between_rows_and_entry(spark, folders, monkeypatch):
    for number in range(3):
        deliver(spark, folders, "sensor_data", number, reading(number), reading(10 + number, temperature_celsius="hot"))
    real, calls = ingest.log_batch, []

    def stops(spark, folders, table, batch, counts):
        calls.append(batch)
        if batch == 1:
            raise RuntimeError("the driver stops here")
        real(spark, folders, table, batch, counts)

    monkeypatch.setattr(ingest, "log_batch", stops)
    with pytest.raises(PySparkException):
        ingest.refresh_bronze(spark, "sensor_data", folders, files_per_batch=1)
    assert calls == [0, 1]
    monkeypatch.undo()
    ingest.refresh_bronze(spark, "sensor_data", folders, files_per_batch=1)
    log = log_of(spark, folders, "bronze_sensor_data")
    assert {batch for batch, _ in log} == {0, 1, 2}
    assert all(log[batch, "bz_temp_parseable"] == (1, 1) for batch in range(3))
    assert spark.read.parquet(folders.table("bronze_sensor_data")).count() == 6
    # A batch that has its entry is complete: running it once more changes nothing.
    before = spark.read.parquet(folders.table("bronze_sensor_data")).inputFiles()
    ingest.write_batch(spark.read.parquet(folders.table("bronze_sensor_data")), 1, "bronze_sensor_data", folders)
    assert sorted(spark.read.parquet(folders.table("bronze_sensor_data")).inputFiles()) == sorted(before)


def test_reassignment_is_stored_and_later_orders_follow(spark, folders, monkeypatch):
    machine = dict(work_center="WC-MILL", num_shifts="1", capacity_hrs_per_shift="8", hourly_rate_usd="50", last_pm_date="2024-01-01")
    deliver(spark, folders, "machines", 1, dict(machine, machine_id="MCH-001", status="Maintenance"), dict(machine, machine_id="MCH-002", status="Active"))

    def order(number):
        return dict(work_order_id=f"WO-{number}", part_number="PN-1", order_qty="10.0", machine_id="MCH-001", work_center="WC-MILL", setup_time_hrs="0.5",
                    run_time_hrs_per_unit="0.25", scheduled_start="2024-03-04", due_date="2024-03-06", status="Open")

    deliver(spark, folders, "work_orders", 2, order(1))
    ingest.refresh(spark, folders, ("machines", "work_orders"))
    moves = spark.createDataFrame([("MCH-001", "MCH-002"), ("MCH-001", "MCH-002")], "from_machine_id string, to_machine_id string")
    assert {r.work_order_id: r.machine_id for r in medallion.reassign(spark, folders.root, moves).work_orders.collect()} == {"WO-1": "MCH-002"}
    deliver(spark, folders, "work_orders", 3, order(2))
    ingest.refresh(spark, folders, ("work_orders",))
    now = {r.work_order_id: (r.machine_id, r.order_qty) for r in StoredShop(spark, folders.root).work_orders.collect()}
    assert now == {"WO-1": ("MCH-002", 10), "WO-2": ("MCH-001", 10)}

    def fails(*_):
        raise OSError("no space left")

    monkeypatch.setattr("millgauge.operators.moves.valid_moves", fails)
    with pytest.raises(OSError):
        medallion.reassign(spark, folders.root, moves)
    monkeypatch.undo()
    assert {r.work_order_id: r.machine_id for r in StoredShop(spark, folders.root).work_orders.collect()} == {k: v[0] for k, v in now.items()}


def test_clustered_copy_of_a_silver_table(spark, folders):
    deliver(spark, folders, "sensor_data", 1, *(reading(n) for n in range(20)))
    ingest.refresh(spark, folders, ("sensor_data",))
    path = medallion.recluster(spark, folders.root, "silver_sensor_data")
    copy, table = spark.read.parquet(path), spark.read.parquet(folders.table("silver_sensor_data"))
    assert copy.count() == 20 and copy.exceptAll(table.select(*copy.columns)).isEmpty()


def land(folders, name, *lines):
    os.makedirs(folders.feed("sensor_data"), exist_ok=True)
    with open(f"{folders.feed('sensor_data')}/{name}", "w") as file:
        file.writelines(f"{line}\n" for line in lines)


def bronze_by_sensor(spark, folders):
    return {r.sensor_id: r for r in spark.read.parquet(folders.table("bronze_sensor_data")).collect()}


def test_columns_are_found_by_the_header_of_each_file(spark, folders):
    deliver(spark, folders, "sensor_data", 1, reading(1))
    # Another order, other case and blanks; a column missing; columns more; names that look like patterns.
    land(folders, "another order.csv", "machine_id, SENSOR_ID ,temperature_celsius", "MCH-002,S-2,55")
    land(folders, "a[b]{c}*?.csv", "sensor_id,plant,machine_id,note.x,plant", "S-3,north,MCH-003,,south", "S-4,,MCH-004,,")
    land(folders, "ragged.csv", "sensor_id,machine_id,anomaly_type", "S-5,MCH-005,,lost", "S-6,MCH-006", '"S-7","MCH,007",')
    land(folders, "empty.csv")
    land(folders, "blank_then_header.csv", "", "machine_id,sensor_id", "MCH-008,S-8")
    land(folders, "header_only.csv", "machine_id,sensor_id")
    ingest.refresh_bronze(spark, "sensor_data", folders)
    rows = bronze_by_sensor(spark, folders)
    assert {key: (r.machine_id, r.temperature_celsius) for key, r in rows.items()} == {
        "S-1": ("MCH-001", "40"), "S-2": ("MCH-002", "55"), "S-3": ("MCH-003", None), "S-4": ("MCH-004", None),
        "S-5": ("MCH-005", None), "S-6": ("MCH-006", None), "S-7": ("MCH,007", None), "S-8": ("MCH-008", None),
    }
    assert {key: r._rescued_data for key, r in rows.items() if r._rescued_data is not None} == {
        "S-3": {"plant": "north", "plant#2": "south"}, "S-5": {"_line": "S-5,MCH-005,,lost"}, "S-6": {"_line": "S-6,MCH-006"},
    }
    # The batch reader agrees, and does so when only few columns are asked for.
    batch = read_landing(spark, "sensor_data", folders.feed("sensor_data"))
    assert {(r.sensor_id, r.n) for r in batch.selectExpr("sensor_id", "size(_rescued_data) AS n").where("n > 0").collect()} == {
        ("S-3", 2), ("S-5", 1), ("S-6", 1)
    }


def test_later_files_may_have_another_header(spark, folders):
    land(folders, "one.csv", "sensor_id,machine_id", "S-1,MCH-001")
    ingest.refresh_bronze(spark, "sensor_data", folders)
    land(folders, "two.csv", "machine_id,line,sensor_id", "MCH-002,7,S-2")
    ingest.refresh_bronze(spark, "sensor_data", folders)
    rows = bronze_by_sensor(spark, folders)
    assert (rows["S-1"].machine_id, rows["S-2"].machine_id, rows["S-2"]._rescued_data) == ("MCH-001", "MCH-002", {"line": "7"})


def test_a_header_of_another_feed_stops_the_batch(spark, folders):
    land(folders, "wrong.csv", "S-1,MCH-001,40")
    with pytest.raises(PySparkException):
        ingest.refresh_bronze(spark, "sensor_data", folders)
    with pytest.raises(ValueError):
        read_landing(spark, "sensor_data", folders.feed("sensor_data"))
    assert not glob.glob(f"{folders.table('bronze_sensor_data')}/batch_id=*")


def test_rows_without_anything_to_rescue_cost_no_map(spark, folders):
    land(folders, "a.csv", "sensor_id,machine_id", "S1,MCH-001", "S2,MCH-002,extra")
    rows = read_landing(spark, "sensor_data", folders.feed("sensor_data"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "_metadata" not in plan
    found = {r.sensor_id: (r._rescued_data, r._source_file) for r in rows.collect()}
    assert found["S1"][0] is None and found["S2"][0] == {"_line": "S2,MCH-002,extra"}
    assert all(name.endswith("/a.csv") for _, name in found.values())


def test_a_stage_has_several_splits_for_each_slot(spark, folders, monkeypatch):
    seen, write = [], ingest.write_batch
    monkeypatch.setattr(ingest, "write_batch", lambda rows, *rest: (seen.append(rows.sparkSession.conf.get(ingest._MIN_SPLITS)), write(rows, *rest)))
    before = spark.conf.get(ingest._MIN_SPLITS, None)
    deliver(spark, folders, "sensor_data", 1, reading(1))
    ingest.refresh(spark, folders, ("sensor_data",))
    assert {int(n) for n in seen} == {ingest.SPLITS_PER_SLOT * spark.sparkContext.defaultParallelism}
    assert spark.conf.get(ingest._MIN_SPLITS, None) == before


def test_header_names():
    assert header_names('\ufeffA, b ,"c,d",,a,_line') == ["a", "b", "c,d", "_c3", "a#2", "_line#2"]


def test_a_file_of_any_age_is_taken(spark, folders):
    deliver(spark, folders, "machines", 1, dict(machine_id="MCH-001"))
    ingest.refresh_bronze(spark, "machines", folders)
    deliver(spark, folders, "machines", 2, dict(machine_id="MCH-002"))
    os.utime(f"{folders.feed('machines')}/delivery-2.csv", (0, 0))
    ingest.refresh_bronze(spark, "machines", folders)
    assert spark.read.parquet(folders.table("bronze_machines")).count() == 2


def test_newest_file_wins_within_a_batch(spark, folders):
    master = dict(machine_id="MCH-001", work_center="WC-MILL", num_shifts="1", capacity_hrs_per_shift="8", hourly_rate_usd="50",
                  status="Active", last_pm_date="2024-01-01")
    deliver(spark, folders, "machines", "a", {**master, "machine_name": "newer"}, {**master, "machine_name": "newer, again"})
    deliver(spark, folders, "machines", "b", {**master, "machine_name": "older"})
    day_ago = time.time() - 86400
    os.utime(f"{folders.feed('machines')}/delivery-b.csv", (day_ago, day_ago))
    ingest.refresh(spark, folders, ("machines",))
    names = {tuple(r.machine_name for r in StoredShop(spark, folders.root).machines.collect()) for _ in range(3)}
    assert len(names) == 1 and names.pop()[0].startswith("newer")


def test_bronze_machines_carry_file_time(spark, folders):
    deliver(spark, folders, "machines", 1, dict(machine_id="MCH-001"))
    ingest.refresh_bronze(spark, "machines", folders)
    row = spark.read.parquet(folders.table("bronze_machines")).first()
    assert isinstance(row._file_ts, dt.datetime)


def test_compressed_deliveries_are_taken_whole_and_in_bounded_files(spark, folders, monkeypatch):
    monkeypatch.setattr(landing, "ROWS_PER_FILE", 20)
    rows = [reading(n) for n in range(50)]
    write_landing(text_feed(spark, "sensor_data", *rows).coalesce(1), "sensor_data", folders.feed("sensor_data"), codec="gzip")
    assert len(glob.glob(f"{folders.feed('sensor_data')}/part-*.csv.gz")) == 3
    ingest.refresh(spark, folders, ("sensor_data",))
    silver = spark.read.parquet(folders.table("silver_sensor_data"))
    assert sorted(r.sensor_id for r in silver.collect()) == sorted(row["sensor_id"] for row in rows)
    assert all(".zstd." in path for table in ("bronze", "silver") for path in spark.read.parquet(folders.table(f"{table}_sensor_data")).inputFiles())


def test_a_delivery_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.csv
    key = session._SHUFFLE_CLEANUP
    before = spark.conf.get(key, None)
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, path: (seen.append(spark.conf.get(key)), write(self, path))[1])
    rows = text_feed(spark, "sensor_data", *(reading(n) for n in range(20))).repartition(3, "sensor_id")
    write_landing(rows, "sensor_data", str(tmp_path / "landing"))
    assert seen == ["true"] and spark.conf.get(key, None) == before
    assert rows.count() == 20 == rows.count()


def test_queries_deliver_compressed(spark, data, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(session, "fresh_folder", lambda spark, purpose: str(tmp_path / purpose))
    entry.queries()["ingest_work_orders"](spark, data)
    names = os.listdir(tmp_path / "ingest-work_orders" / "landing" / "work_orders")
    assert [name for name in names if name.endswith(".csv.gz")] and not [name for name in names if name.endswith(".csv")]
