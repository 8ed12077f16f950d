"""Recompute the gold tables from stored silver and lay them out for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millgauge.operators import gold, master, partials, zones
from millgauge.operators import moves as move_log
from millgauge.operators.layout import CLUSTER_KEYS, current_version, write_clustered, write_version
from millgauge.plans.shop import MASTER, MOVE_LOG, StagedShop, StoredShop
from millgauge.sources.documentation import COLUMN_COMMENTS, TABLE_COMMENTS, comment_on, create_schema, quoted

# Table name to the shop's attribute of it.
TABLES = {
    "silver_machines": "machines",
    "silver_routings": "routings",
    "silver_work_orders": "work_orders",
    "silver_sensor_data": "sensor_data",
    "gold_machine_utilization": "utilization",
    "gold_scheduling_performance": "scheduling",
    "gold_predictive_maintenance": "maintenance",
    "gold_capacity_planning": "capacity",
    "gold_farmout_analysis": "farmout",
}


def gold_frames(shop: StoredShop) -> dict[str, DataFrame]:
    """Every gold table as a query over the shop's silver tables."""
    return {
        "gold_machine_utilization": gold.machine_utilization(shop.work_orders, shop.machines),
        "gold_scheduling_performance": gold.scheduling_performance(shop.work_orders),
        "gold_predictive_maintenance": gold.predictive_maintenance(shop.sensor_data, shop.machines),
        "gold_capacity_planning": gold.capacity_planning(shop.work_orders, shop.machines),
        "gold_farmout_analysis": gold.farmout_analysis(shop.work_orders),
    }


def refresh_gold(spark: SparkSession, root: str) -> StoredShop:
    """Write new versions of the gold tables, each current once it is whole; returns the shop that reads them."""
    for name, frame in gold_frames(StoredShop(spark, root)).items():
        write_version(frame, root, name, CLUSTER_KEYS[name])
    return StoredShop(spark, root)


def refresh_incremental(spark: SparkSession, root: str, tables: tuple[str, ...] = tuple(partials.ROLLUPS)) -> None:
    """Bring the rollups that are kept by period up to date with the batches that have arrived."""
    for name in tables:
        partials.refresh(spark, root, name)


def incremental(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A rollup that is kept by period, as its gold table."""
    rows = partials.read(spark, root, table)
    return gold.with_maintenance(rows, StoredShop(spark, root).machines) if table == "gold_predictive_maintenance" else rows


def reassign(spark: SparkSession, root: str, moves: DataFrame) -> StoredShop:
    """Log the valid moves for the orders that have arrived so far; returns the shop that reads them so."""
    shop = StoredShop(spark, root)
    move_log.log_moves(spark, f"{root}/{MOVE_LOG}", moves, shop.machines, shop.last_batch())
    return StoredShop(spark, root)


def refresh_master(spark: SparkSession, root: str) -> None:
    """Merge the machine masters that have arrived into the current one."""
    master.refresh(spark, f"{root}/silver_machines", f"{root}/{MASTER}")


def lay_out(spark: SparkSession, root: str, table: str) -> None:
    """Lay out the batches of an appended table that have arrived by all of its clustering keys at once."""
    zones.refresh(spark, f"{root}/{table}", f"{root}/zoned/{table}", CLUSTER_KEYS[table])


def lookup(spark: SparkSession, root: str, table: str, **between: tuple) -> DataFrame:
    """Rows of a table that is laid out, by ranges of one or more of its keys, as of the last ``lay_out``."""
    return zones.lookup(spark, f"{root}/zoned/{table}", between).drop("batch_id")


def recluster(spark: SparkSession, root: str, table: str) -> str:
    """Write a clustered copy of an appended table and return its path.

    A stream appends rows in order of arrival; the copy is for readers that look
    up key ranges.
    """
    target = f"{root}/clustered/{table}"
    write_clustered(spark.read.parquet(f"{root}/{table}"), target, CLUSTER_KEYS[table])
    return target


def register_views(shop: StagedShop | StoredShop) -> None:
    """Make the shop's tables available to SQL under their own names."""
    for name, attribute in TABLES.items():
        getattr(shop, attribute).createOrReplaceTempView(name)


def publish_gold(spark: SparkSession, root: str, schema: str) -> None:
    """Catalog tables, with comments, over the current versions of the gold tables.

    A table that is already there is pointed at the version of now.
    """
    create_schema(spark, schema)
    for name in TABLES:
        if not name.startswith("gold_"):
            continue
        table, path = f"{schema}.{name}", current_version(spark, root, name) or f"{root}/{name}"
        if spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
            spark.catalog.refreshTable(table)
        else:
            spark.catalog.createTable(table, path=path, source="parquet")
            comment_on(spark, table)


def publish_silver(spark: SparkSession, root: str, schema: str) -> None:
    """Catalog views, with comments, over the silver folders; batches that arrive later are in them.

    Orders are shown on the machines they arrived with; reassignments are kept in the log of moves.
    """
    create_schema(spark, schema)
    for name in TABLES:
        if not name.startswith("silver_"):
            continue
        folder = f"parquet.`{root}/{name}`"
        columns = [c for c in spark.table(folder).columns if c != "batch_id"]
        described = ", ".join(f"`{c}` COMMENT {quoted(COLUMN_COMMENTS[c])}" if c in COLUMN_COMMENTS else f"`{c}`" for c in columns)
        chosen = ", ".join(f"`{c}`" for c in columns)
        spark.sql(
            f"CREATE OR REPLACE VIEW {schema}.{name} ({described}) "
            f"COMMENT {quoted(TABLE_COMMENTS[name])} AS SELECT {chosen} FROM {folder}"
        )
