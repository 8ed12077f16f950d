"""Rollups kept by period: equal to a full computation, touching only the periods of a delivery."""

import pytest

from millgauge.operators import gold, partials
from millgauge.plans import medallion
from millgauge.plans.shop import StoredShop
from millgauge.streaming import ingest
from tests.test_state import MASTER, at
from tests.test_streaming import deliver, reading

TABLE = "gold_predictive_maintenance"


@pytest.fixture
def folders(spark, tmp_path):
    made = ingest.Folders(landing=str(tmp_path / "landing"), root=str(tmp_path / "tables"))
    deliver(spark, made, "machines", "m", dict(MASTER, machine_id="MCH-001"), dict(MASTER, machine_id="MCH-002"))
    ingest.refresh(spark, made, ("machines",))
    return made


def arrive(spark, folders, number, *rows):
    deliver(spark, folders, "sensor_data", number, *rows)
    ingest.refresh(spark, folders, ("sensor_data",))


def files(spark, folders):
    """Names of the stored files by period."""
    out = {}
    for path in spark.read.parquet(partials.path_of(folders.root, TABLE)).inputFiles():
        out.setdefault(path.split("period=")[1].split("/")[0], set()).add(path)
    return out


def check(spark, folders):
    shop = StoredShop(spark, folders.root)
    expected = gold.predictive_maintenance(shop.sensor_data, shop.machines).collect()
    got = medallion.incremental(spark, folders.root, TABLE).select(*gold.predictive_maintenance(shop.sensor_data, shop.machines).columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and got


def february(number, **changes):
    return reading(number, reading_timestamp="2024-02-05 10:00:00", **changes)


def test_only_touched_periods_are_written(spark, folders):
    arrive(spark, folders, 1, at(1, "01 08:00"), at(2, "01 09:00", temperature_celsius="50.5"), february(3))
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    check(spark, folders)
    first = files(spark, folders)
    arrive(spark, folders, 2, at(4, "01 10:00", coolant_flow_lpm="bad", anomaly_flag="true"), at(5, "02 10:00", machine_id="MCH-002"))
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    check(spark, folders)
    second = files(spark, folders)
    assert second["2024-02"] == first["2024-02"] and second["2024-01"] != first["2024-01"]
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    assert files(spark, folders) == second
    arrive(spark, folders, 3, reading(6, reading_timestamp=None), february(7, tool_wear_pct="95"))
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    check(spark, folders)
    assert files(spark, folders)["2024-01"] == second["2024-01"]


def test_a_refresh_that_stopped_counts_nothing_twice(spark, folders, monkeypatch):
    arrive(spark, folders, 1, at(1, "01 08:00"), february(2))
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    arrive(spark, folders, 2, at(3, "01 08:30"), february(4))
    # As if the driver had stopped after the periods were replaced, before that was noted.
    monkeypatch.setattr(partials, "_taken_in", lambda *_: -1)
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    check(spark, folders)
    medallion.refresh_incremental(spark, folders.root, (TABLE,))
    check(spark, folders)


def test_read_before_any_refresh(spark, folders):
    with pytest.raises(ValueError):
        partials.read(spark, folders.root, TABLE)


def test_a_period_of_many_keys_is_no_single_task(spark, folders, tmp_path):
    rows = [reading(n, machine_id=f"MCH-{n:03d}", reading_timestamp=f"2024-01-{1 + n % 28:02d} 00:00:00") for n in range(2000)]
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, setting in settings.items():
        spark.conf.set(key, setting)
    try:
        arrive(spark, folders, 1, *rows[:1000])
        partials.refresh(spark, folders.root, TABLE)
        arrive(spark, folders, 2, *rows[500:])
        partials.refresh(spark, folders.root, TABLE)
        stored = partials.stored_partials(spark, folders.root, TABLE)
        assert stored.count() == 2000
        partials.by_period(partials.ROLLUPS[TABLE].merge(stored)).write.parquet(str(tmp_path / "merged"))
    finally:
        for key, setting in before.items():
            spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
    # Each task has written a file.
    assert len(spark.read.parquet(str(tmp_path / "merged")).inputFiles()) > 1
    check(spark, folders)
