"""Layouts on several keys, and the machine master kept current."""

import pytest
from pyspark.sql import functions as F

from millgauge.operators import master, zones
from millgauge.operators.latest import current_machines
from tests.frames import machines

KEYS = ("work_order_id", "machine_id")


def orders(spark, start, stop):
    """Orders of which a third belong to one machine; one without a machine, one without an id."""
    n = F.col("id")
    machine = F.when(n % 3 == 0, "MCH-050").otherwise(F.format_string("MCH-%03d", F.pmod(F.xxhash64(n), F.lit(100))))
    made = spark.range(start, stop).select(
        F.when(n != 7, F.format_string("WO-%06d", F.pmod(F.xxhash64(n, F.lit(1)), F.lit(100_000)))).alias("work_order_id"),
        F.when(n != 11, machine).alias("machine_id"),
        n.alias("qty"),
    )
    return made


def arrive(frame, path, batch):
    frame.write.parquet(f"{path}/batch_id={batch}")


def files_read(df):
    """Rows of the frame and the number of files its scan has read."""
    rows = df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return rows, metrics.apply("numFiles").value()


@pytest.fixture
def laid_out(spark, tmp_path):
    source, path = str(tmp_path / "orders"), str(tmp_path / "zoned")
    arrive(orders(spark, 0, 6000), source, 0)
    zones.refresh(spark, source, path, KEYS)
    return source, path


def expected(spark, source, condition):
    return sorted(map(str, spark.read.parquet(source).where(condition).select(*KEYS, "qty").collect()))


@pytest.mark.parametrize(
    "between, condition",
    [
        ({"machine_id": ("MCH-020", "MCH-020")}, "machine_id = 'MCH-020'"),
        ({"work_order_id": ("WO-030000", "WO-030400")}, "work_order_id BETWEEN 'WO-030000' AND 'WO-030400'"),
    ],
)
def test_a_lookup_on_either_key_reads_a_tenth_of_the_files(spark, laid_out, between, condition):
    source, path = laid_out
    everything = spark.read.parquet(*[folder for folder, _ in zones.deliveries(spark, path)])
    found = zones.lookup(spark, path, between)
    rows, files = files_read(found.select(*KEYS, "qty"))
    assert sorted(map(str, rows)) == expected(spark, source, condition) and rows
    assert files <= len(everything.inputFiles()) / 10
    assert everything.count() == 6000


def test_hot_keys_wide_ranges_and_no_rows(spark, laid_out):
    source, path = laid_out
    for between, condition in [
        ({"machine_id": ("MCH-050", "MCH-050")}, "machine_id = 'MCH-050'"),
        ({"machine_id": ("A", "Z")}, "machine_id IS NOT NULL"),
        ({"machine_id": ("MCH-010", "MCH-060"), "work_order_id": ("WO-02", "WO-07")}, "machine_id BETWEEN 'MCH-010' AND 'MCH-060' AND work_order_id BETWEEN 'WO-02' AND 'WO-07'"),
        ({"machine_id": ("MCH-060", "MCH-010")}, "false"),
        ({"machine_id": ("MCH-0205", "MCH-0207")}, "false"),
    ]:
        assert sorted(map(str, zones.lookup(spark, path, between).select(*KEYS, "qty").collect())) == expected(spark, source, condition)
    with pytest.raises(ValueError):
        zones.lookup(spark, path, {"qty": (1, 2)})


def test_only_new_batches_are_written_and_a_stopped_refresh_leaves_nothing(spark, laid_out, monkeypatch):
    source, path = laid_out
    first = zones.deliveries(spark, path)
    zones.refresh(spark, source, path, KEYS)
    assert zones.deliveries(spark, path) == first
    arrive(orders(spark, 6000, 7000).withColumn("machine_id", F.lit("MCH-999")), source, 1)
    with monkeypatch.context() as stopped:
        stopped.setattr(zones, "LOG", "no schema")
        with pytest.raises(Exception):
            zones.lay_out(spark.read.parquet(source).where("batch_id = 1"), path, KEYS, 1)
    assert zones.lookup(spark, path, {"machine_id": ("MCH-999", "MCH-999")}).count() == 0
    zones.refresh(spark, source, path, KEYS)
    assert zones.deliveries(spark, path)[: len(first)] == first
    assert zones.lookup(spark, path, {"machine_id": ("MCH-999", "MCH-999")}).count() == 1000


def test_nothing_laid_out(spark, tmp_path):
    with pytest.raises(ValueError):
        zones.lookup(spark, str(tmp_path / "none"), {"machine_id": ("a", "b")})


def test_numbers_and_moments_as_keys(spark, tmp_path):
    source, path = str(tmp_path / "t"), str(tmp_path / "z")
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    arrive(spark.range(2000).select((F.lit(1000) - F.col("id")).alias("n"), moment.alias("at")), source, 0)
    zones.refresh(spark, source, path, ("n", "at"))
    assert zones.lookup(spark, path, {"n": (-5, 10)}).count() == 16
    assert zones.lookup(spark, path, {"at": ("2023-11-15 00:00:00", "2023-11-15 00:09:59")}).count() == 10


def test_empty_first_delivery(spark, tmp_path):
    source, path = str(tmp_path / "t"), str(tmp_path / "z")
    arrive(orders(spark, 0, 5), source, 1)
    zones.lay_out(orders(spark, 0, 0), path, KEYS, 0)
    zones.refresh(spark, source, path, KEYS)
    assert zones.lookup(spark, path, {"machine_id": ("A", "Z")}).count() == 5


def deliver(spark, source, batch, *rows):
    frame = machines(spark, *(dict(machine_id=m, notes=n) for m, n in rows)).withColumn("_file_ts", F.lit(batch).cast("timestamp"))
    arrive(frame, source, batch)


def check(spark, source, path):
    got = sorted(map(str, master.read(spark, source, path).collect()))
    want = current_machines(spark.read.parquet(source).drop("batch_id"))
    assert got == sorted(map(str, want.select(*master.read(spark, source, path).columns).collect()))
    return master.state(spark, path)


def test_master_is_current_and_untouched_buckets_stay(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "machines"), str(tmp_path / "master")
    deliver(spark, source, 0, *((f"MCH-{i:03d}", "first") for i in range(60)), (None, "no id"))
    check(spark, source, path)
    master.refresh(spark, source, path)
    first, through = check(spark, source, path)
    assert through == 0 and len(first) > 20
    deliver(spark, source, 1, ("MCH-003", "second"), ("MCH-003", "again"), ("MCH-003", "again"), ("MCH-900", "new"))
    check(spark, source, path)  # arrived, not merged
    with monkeypatch.context() as stopped:
        stopped.setattr(master.time, "time_ns", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            master.refresh(spark, source, path)
    assert check(spark, source, path) == (first, 0)
    master.refresh(spark, source, path)
    second, through = check(spark, source, path)
    assert through == 1 and 1 <= sum(second[b] != first.get(b) for b in second) <= 2
    master.refresh(spark, source, path)
    assert check(spark, source, path) == (second, 1)
    deliver(spark, source, 2)
    master.refresh(spark, source, path)
    assert check(spark, source, path)[0] == second


def test_a_large_delivery_is_laid_out_in_groups_and_whole(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "orders"), str(tmp_path / "zoned")
    arrive(orders(spark, 0, 3000), source, 0)
    monkeypatch.setattr(zones, "ROWS_AT_ONCE", 500)
    frame = type(spark.range(1))
    shuffled, place = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *by: (shuffled.append(df.count()), place(df, *by))[1])
    zones.refresh(spark, source, path, KEYS)
    assert len(shuffled) == zones.MOST_GROUPS and sum(shuffled) == 3000 and max(shuffled) < 1500
    (folder, _), = zones.deliveries(spark, path)
    stored, arrived = spark.read.parquet(folder), spark.read.parquet(source)
    assert sorted(map(str, stored.select(*KEYS, "qty").collect())) == sorted(map(str, arrived.select(*KEYS, "qty").collect()))
    assert sorted(map(str, zones.lookup(spark, path, {"machine_id": ("MCH-050", "MCH-050")}).select(*KEYS, "qty").collect())) == expected(
        spark, source, "machine_id = 'MCH-050'"
    )


def test_a_delivery_without_any_first_key_is_one_group(spark, tmp_path):
    source, path = str(tmp_path / "orders"), str(tmp_path / "zoned")
    arrive(orders(spark, 0, 50).withColumn("work_order_id", F.lit(None).cast("string")), source, 0)
    zones.lay_out(spark.read.parquet(source), path, KEYS, 0, groups=4)
    assert spark.read.parquet(*[folder for folder, _ in zones.deliveries(spark, path)]).count() == 50
