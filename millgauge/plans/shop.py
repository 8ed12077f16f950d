"""The shop's tables, each built on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millgauge import session
from millgauge.operators import gold, master, moves, silver
from millgauge.operators.layout import current_version
from millgauge.sources import staging

# The log of reassignments, below the root.
MOVE_LOG = "move_log"
# The current machine master, below the root.
MASTER = "machine_master"


class StagedShop:
    """Tables derived from the supplied data of one folder.

    Work orders come in variants, because the priority and the part description
    each cost a join of every order line; a rollup asks for what it reads.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = session.prepare(spark)
        self.folder = folder

    def feed(self, name: str) -> DataFrame:
        return getattr(staging, name)(self.spark, self.folder)

    def _orders(self, priority: bool, description: bool) -> DataFrame:
        feed = staging.work_orders(self.spark, self.folder, priority=priority, description=description)
        return silver.refine("work_orders", feed)

    @cached_property
    def machines(self) -> DataFrame:
        return silver.refine("machines", self.feed("machines"))

    @cached_property
    def routings(self) -> DataFrame:
        return silver.refine("routings", self.feed("routings"))

    @cached_property
    def sensor_data(self) -> DataFrame:
        return silver.refine("sensor_data", self.feed("sensor_data"))

    @cached_property
    def work_orders(self) -> DataFrame:
        return self._orders(priority=True, description=True)

    @cached_property
    def bare_orders(self) -> DataFrame:
        """Work orders without priority and part description."""
        return self._orders(priority=False, description=False)

    @cached_property
    def ranked_orders(self) -> DataFrame:
        """Work orders with priority only."""
        return self._orders(priority=True, description=False)

    @cached_property
    def described_orders(self) -> DataFrame:
        """Work orders with part description only."""
        return self._orders(priority=False, description=True)

    @cached_property
    def incidents(self) -> DataFrame:
        return self.feed("incidents")

    @cached_property
    def utilization(self) -> DataFrame:
        return gold.machine_utilization(self.bare_orders, self.machines)

    @cached_property
    def scheduling(self) -> DataFrame:
        return gold.scheduling_performance(self.ranked_orders)

    @cached_property
    def maintenance(self) -> DataFrame:
        return gold.predictive_maintenance(self.sensor_data, self.machines)

    @cached_property
    def capacity(self) -> DataFrame:
        return gold.capacity_planning(self.bare_orders, self.machines)

    @cached_property
    def farmout(self) -> DataFrame:
        return gold.farmout_analysis(self.described_orders)


class StoredShop:
    """Tables read from the silver and gold folders below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = session.prepare(spark)
        self.root = root

    def table(self, name: str) -> DataFrame:
        """A stored table in its current version, without the number of the batch that brought a row."""
        path = current_version(self.spark, self.root, name) or f"{self.root}/{name}"
        return self.spark.read.parquet(path).drop("batch_id")

    @cached_property
    def machines(self) -> DataFrame:
        """Newest delivery of each machine; re-deliveries must not multiply orders."""
        return master.read(self.spark, f"{self.root}/silver_machines", f"{self.root}/{MASTER}")

    @cached_property
    def routings(self) -> DataFrame:
        return self.table("silver_routings")

    @cached_property
    def sensor_data(self) -> DataFrame:
        return self.table("silver_sensor_data")

    @cached_property
    def work_orders(self) -> DataFrame:
        """All orders that have arrived, on the machines that reassignments have left them on."""
        return self.work_orders_after(None)

    def work_orders_after(self, number: int | None) -> DataFrame:
        """The orders that have arrived, as if the reassignment of this number had been the last; 0 is before all."""
        arrived = self.spark.read.parquet(f"{self.root}/silver_work_orders")
        log = moves.read_log(self.spark, f"{self.root}/{MOVE_LOG}")
        return (arrived if log is None else moves.apply_log(arrived, log, number)).drop("batch_id")

    def last_batch(self) -> int | None:
        """The number of the newest batch of work orders."""
        return self.spark.read.parquet(f"{self.root}/silver_work_orders").agg(F.max("batch_id")).first()[0]

    # Stored columns are pruned by the reader, so one table serves all variants.
    @property
    def bare_orders(self) -> DataFrame:
        return self.work_orders

    @property
    def ranked_orders(self) -> DataFrame:
        return self.work_orders

    @property
    def described_orders(self) -> DataFrame:
        return self.work_orders

    @cached_property
    def utilization(self) -> DataFrame:
        return self.table("gold_machine_utilization")

    @cached_property
    def scheduling(self) -> DataFrame:
        return self.table("gold_scheduling_performance")

    @cached_property
    def maintenance(self) -> DataFrame:
        return self.table("gold_predictive_maintenance")

    @cached_property
    def capacity(self) -> DataFrame:
        return self.table("gold_capacity_planning")

    @cached_property
    def farmout(self) -> DataFrame:
        return self.table("gold_farmout_analysis")
