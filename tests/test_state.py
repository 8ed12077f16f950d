"""Streams with state, and the log of reassignments, over several deliveries and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millgauge.operators import moves
from millgauge.plans import medallion
from millgauge.plans.shop import StoredShop
from millgauge.streaming import ingest, state
from tests.test_streaming import deliver, reading


@pytest.fixture
def folders(tmp_path):
    return ingest.Folders(landing=str(tmp_path / "landing"), root=str(tmp_path / "tables"))


def at(number, moment, **changes):
    return reading(number, reading_timestamp=f"2024-01-{moment}:00", **changes)


def take_in(spark, folders, number, refresh, *rows, **options):
    deliver(spark, folders, "sensor_data", number, *rows)
    ingest.refresh(spark, folders, ("sensor_data",))
    refresh(state.silver_readings(spark, folders), folders, **options)


def drops(spark, folders):
    return {r.stream: (r.rows_in, r.late, r.duplicates) for r in state.dropped(spark, folders).collect()}


def test_doubled_readings_are_kept_once(spark, folders):
    take_in(spark, folders, 1, state.refresh_readings, at(1, "01 08:00"), at(2, "03 08:00"), at(2, "03 08:00"))
    # Restarted: the state comes from the checkpoint. S-2 again, an early new one within the delay, and a late one.
    take_in(spark, folders, 2, state.refresh_readings, at(2, "03 08:00"), at(3, "02 08:00"), at(4, "01 07:00"))
    take_in(spark, folders, 3, state.refresh_readings, at(3, "02 08:00"), at(5, "09 08:00"))
    rows = spark.read.parquet(folders.table("unique_readings"))
    assert sorted(r.sensor_id for r in rows.collect()) == ["S-1", "S-2", "S-3", "S-5"]
    assert drops(spark, folders) == {"unique_readings": (8, 1, 3)}


def test_days_are_written_once_when_closed(spark, folders):
    refresh = state.refresh_daily_health

    def days():
        rows = spark.read.parquet(folders.table("daily_health")).collect()
        return sorted((r.machine_id, r.reading_date.day, r.sensor_readings, r.max_temp_c) for r in rows)

    take_in(spark, folders, 1, refresh, at(1, "01 08:00"), at(2, "02 08:00", temperature_celsius="50"), at(3, "01 23:59", machine_id="MCH-002"))
    assert days() == []
    # The first day closes two days after its end, with what came out of order until then.
    take_in(spark, folders, 2, refresh, at(4, "01 09:00", temperature_celsius="60"), at(5, "03 23:00"))
    assert days() == []
    take_in(spark, folders, 3, refresh, at(6, "04 00:00"))
    assert days() == [("MCH-001", 1, 2, 60.0), ("MCH-002", 1, 1, 40.0)]
    # Too late for the first day, in time for the second.
    take_in(spark, folders, 4, refresh, at(7, "01 10:00"), at(8, "02 10:00"), at(9, "05 00:00"))
    assert days() == [("MCH-001", 1, 2, 60.0), ("MCH-001", 2, 2, 50.0), ("MCH-002", 1, 1, 40.0)]
    assert drops(spark, folders)["daily_health"][:2] == (9, 1)


def test_newest_reading_out_of_order_and_silence(spark, folders):
    refresh = state.refresh_newest

    def now():
        return {r.machine_id: (r.sensor_id, r.reading_timestamp, r.silent) for r in state.newest(spark, folders).collect()}

    two = dict(machine_id="MCH-002")
    take_in(spark, folders, 1, refresh, at(3, "05 08:00"), at(2, "04 08:00"), at(7, "05 08:00", **two), at(8, "05 08:00", **two), silent_days=3)
    take_in(spark, folders, 2, refresh, at(4, "05 07:00"), at(5, "04 09:00", **two), silent_days=3)
    five = dt.datetime(2024, 1, 5, 8)
    assert now() == {"MCH-001": ("S-3", five, False), "MCH-002": ("S-8", five, False)}
    # MCH-002 falls silent once the watermark, two days behind, is three days past its newest reading.
    take_in(spark, folders, 3, refresh, at(9, "10 09:00"), silent_days=3)
    assert now() == {"MCH-001": ("S-9", dt.datetime(2024, 1, 10, 9), False), "MCH-002": ("S-8", five, True)}
    take_in(spark, folders, 4, refresh, at(10, "11 08:00", **two), silent_days=3)
    assert now()["MCH-002"] == ("S-10", dt.datetime(2024, 1, 11, 8), False)


# reassignments


MASTER = dict(work_center="WC-MILL", num_shifts="1", capacity_hrs_per_shift="8", hourly_rate_usd="50", last_pm_date="2024-01-01", status="Active")


def order(number, machine=1, status="Open"):
    return dict(work_order_id=f"WO-{number}", part_number="PN-1", order_qty="10", machine_id=machine and f"MCH-00{machine}", work_center="WC-MILL",
                setup_time_hrs="0.5", run_time_hrs_per_unit="0.25", due_date="2024-03-06", status=status)


@pytest.fixture
def shop(spark, folders):
    deliver(spark, folders, "machines", "m", *(dict(MASTER, machine_id=f"MCH-00{k}") for k in range(1, 5)))
    ingest.refresh(spark, folders, ("machines",))

    class Shop:
        def arrive(self, number, *orders):
            deliver(spark, folders, "work_orders", number, *orders)
            ingest.refresh(spark, folders, ("work_orders",))

        def move(self, *pairs):
            rows = [(f"MCH-00{a}", f"MCH-00{b}") for a, b in pairs]
            medallion.reassign(spark, folders.root, spark.createDataFrame(rows, "from_machine_id string, to_machine_id string"))

        def places(self, after=None):
            rows = StoredShop(spark, folders.root).work_orders_after(after).collect()
            assert len({r.work_order_id for r in rows}) == len(rows)
            return {int(r.work_order_id[3:]): int(r.machine_id[-1]) if r.machine_id else None for r in rows}

    return Shop()


def test_orders_follow_a_reassignment_of_nothing(spark, folders, shop):
    shop.arrive(1, order(0, status="Complete"))
    shop.move((1, 2))
    shop.arrive(2, order(1), order(2, machine=None))
    assert shop.places() == {0: 1, 1: 1, 2: None}
    # An arrival time is not looked at: equal or null ones lose nothing.
    silver = spark.read.parquet(folders.table("silver_work_orders"))
    log = moves.read_log(spark, f"{folders.root}/move_log")
    assert moves.apply_log(silver.withColumn("_ingested_at", F.lit(None).cast("timestamp")), log).count() == 3


def test_a_log_before_the_first_order(spark, folders, shop):
    machines = StoredShop(spark, folders.root).machines
    path = f"{folders.root}/move_log"
    pairs = spark.createDataFrame([("MCH-001", "MCH-002")], "from_machine_id string, to_machine_id string")
    assert moves.log_moves(spark, path, pairs, machines, None) == 1
    shop.arrive(1, order(1))
    assert shop.places() == {1: 1}
    shop.move((1, 3))
    assert shop.places() == {1: 3}


def test_chains_of_moves_in_turn_with_arrivals(shop):
    shop.arrive(1, order(1), order(2, 2), order(3, status="Complete"))
    shop.move((1, 2))
    shop.arrive(2, order(4), order(5, 2))
    shop.move((2, 3))
    shop.arrive(3, order(6), order(7, 2), order(8, 3))
    shop.move((3, 1), (1, 4))
    shop.arrive(4, order(9), order(10, 4))
    shop.move((4, 2))
    shop.arrive(5, order(11, 4))

    def replay(last):
        """The same, order by order."""
        arrivals = {0: {1: 1, 2: 2, 3: 1}, 1: {4: 1, 5: 2}, 2: {6: 1, 7: 2, 8: 3}, 3: {9: 1, 10: 4}, 4: {11: 4}}
        steps = [{1: 2}, {2: 3}, {3: 1, 1: 4}, {4: 2}]
        at = {}
        for batch, arrived in arrivals.items():
            at.update(arrived)
            if batch < min(last, len(steps)):
                at = {n: m if n == 3 else steps[batch].get(m, m) for n, m in at.items()}
        return at

    assert shop.places() == replay(4)
    assert [shop.places(after) for after in range(4)] == [replay(after) for after in range(4)]


def test_invalid_moves_are_not_logged(shop):
    shop.arrive(1, order(1))
    shop.move((1, 9), (1, 9))
    shop.move((1, 1))
    assert shop.places() == {1: 1}
