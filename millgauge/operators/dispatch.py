"""Moving work off machines: open load, failure reports, candidates, reassignment.

Everything is driven by tables, so many failures are handled in one plan. Pairs
of failed and candidate machines are never formed: candidates depend only on the
work center, so they are listed per work center and looked up from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millgauge.functions.health import availability_band
from millgauge.functions.numeric import rnd
from millgauge.functions.text import machine_id_in

# Statuses of orders that still need a machine, and of machines
# that cannot work.
ACTIVE_ORDER_STATUSES = ("Open", "In Progress")
DOWN_STATUSES = ("Maintenance", "Idle")


def is_active_order() -> Column:
    return F.col("status").isin(*ACTIVE_ORDER_STATUSES)


def priority_order() -> Column:
    priority = F.col("priority")
    return F.when(priority == "High", 1).when(priority == "Medium", 2).otherwise(3)


def open_load(work_orders: DataFrame) -> DataFrame:
    """Active orders and their standard hours per machine, in one pass."""
    return (
        work_orders.filter(is_active_order() & F.col("machine_id").isNotNull())
        .groupBy("machine_id")
        .agg(F.count(F.lit(1)).alias("active_orders"), F.sum("standard_total_hrs").alias("hrs_loaded"))
    )


def active_order_counts(work_orders: DataFrame) -> DataFrame:
    return open_load(work_orders).select("machine_id", "active_orders")


def machine_orders(work_orders: DataFrame, machine_id: str | None = None) -> DataFrame:
    """Active orders of one machine, or of all, most pressing first."""
    orders = work_orders.filter(is_active_order() & F.col("machine_id").isNotNull())
    if machine_id is not None:
        orders = orders.filter(F.col("machine_id") == machine_id)
    return orders.orderBy("machine_id", priority_order(), "due_date", "work_order_id").select(
        "machine_id", "work_order_id", "part_number", "part_description", "order_qty",
        "operation_description", "status", "priority",
        F.col("due_date").cast("string").alias("due_date"),
        F.col("scheduled_start").cast("string").alias("scheduled_start"),
        F.round("standard_total_hrs", 2).alias("standard_total_hrs"),
    )


def alternative_machines(
    machines: DataFrame,
    work_orders: DataFrame,
    work_center: str | None = None,
    exclude_id: str | None = None,
) -> DataFrame:
    """Active machines with their free hours, freest first within a work center.

    Given a work center this lists its machines but for the excluded one. Without
    one it covers every work center that has a machine out of service; such a
    machine is never itself active, so nothing need be excluded.
    """
    active = machines.filter(F.col("status") == "Active")
    if work_center is not None:
        active = active.filter(F.col("work_center") == work_center)
    else:
        down = machines.filter(F.col("status").isin(*DOWN_STATUSES)).select("work_center").distinct()
        active = active.join(down, "work_center", "left_semi")
    if exclude_id is not None:
        active = active.filter(F.col("machine_id") != exclude_id)
    free = rnd(F.col("capacity_hrs_per_day") - F.coalesce("hrs_loaded", F.lit(0.0)), 1)
    return (
        active.join(open_load(work_orders), "machine_id", "left")
        .select(
            "work_center", "machine_id", "machine_name", "machine_type",
            rnd(F.col("hourly_rate_usd"), 2).alias("hourly_rate_usd"),
            rnd(F.col("capacity_hrs_per_day"), 1).alias("capacity_hrs_per_day"),
            F.coalesce("active_orders", F.lit(0)).alias("current_orders"),
            free.alias("available_hrs"),
        )
        .withColumn("availability", availability_band(F.col("available_hrs")))
        .orderBy("work_center", F.col("available_hrs").desc(), "machine_id")
    )


def extract_machine_ids(reports: DataFrame, text: str = "report_text") -> DataFrame:
    """The reports with the machine id their text mentions, or null."""
    return reports.withColumn("machine_id", machine_id_in(F.col(text)))


def reported_machines(reports: DataFrame) -> DataFrame:
    """One row per machine mentioned in a failure report."""
    return extract_machine_ids(reports).filter(F.col("machine_id").isNotNull()).select("machine_id").distinct()


def machine_lookup(machines: DataFrame, wanted: DataFrame) -> DataFrame:
    return machines.join(wanted, "machine_id", "left_semi").select(
        "machine_id", "machine_name", "machine_type", "work_center", "status"
    )


def affected_work_orders(work_orders: DataFrame, failed: DataFrame) -> DataFrame:
    """Active orders on failed machines, most pressing first."""
    return (
        work_orders.filter(is_active_order())
        .join(failed.select("machine_id").distinct(), "machine_id", "left_semi")
        .orderBy(priority_order(), "due_date", "work_order_id")
        .select("machine_id", "work_order_id", "part_description", "order_qty", "priority", "due_date", "status")
    )


def _active_with_load(machines: DataFrame, work_orders: DataFrame) -> DataFrame:
    return (
        machines.filter(F.col("status") == "Active")
        .join(active_order_counts(work_orders), "machine_id", "left")
        .withColumn("active_orders", F.coalesce("active_orders", F.lit(0)))
    )


def replacement_candidates(machines: DataFrame, work_orders: DataFrame, failed: DataFrame) -> DataFrame:
    """Active machines that can take over, least loaded first.

    ``stands_in_for`` is the number of failed machines of the work center other
    than the candidate itself; machines that stand in for none are left out.
    """
    known = machines.join(failed.select("machine_id").distinct(), "machine_id", "left_semi")
    per_center = known.groupBy("work_center").agg(F.count(F.lit(1)).alias("failures"))
    itself = known.select("machine_id", F.lit(1).alias("also_failed"))
    served = F.col("failures") - F.coalesce("also_failed", F.lit(0))
    return (
        _active_with_load(machines, work_orders)
        .join(per_center, "work_center")
        .join(itself, "machine_id", "left")
        .withColumn("stands_in_for", served)
        .filter(F.col("stands_in_for") > 0)
        .orderBy("work_center", "active_orders", "machine_id")
        .select("work_center", "machine_id", "machine_name", "status", "active_orders", "stands_in_for")
    )


def choose_moves(machines: DataFrame, work_orders: DataFrame, failed: DataFrame) -> DataFrame:
    """The least loaded other active machine of the work center, per failed machine.

    The two least loaded machines of a work center are enough: if the first is the
    failed machine itself, the second takes its place.
    """
    by_load = Window.partitionBy("work_center").orderBy("active_orders", "machine_id")
    leaders = (
        _active_with_load(machines, work_orders)
        .select("work_center", "machine_id", "active_orders")
        .withColumn("place", F.row_number().over(by_load))
        .filter(F.col("place") <= 2)
        .groupBy("work_center")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("machine_id"))).alias("first"),
            F.max(F.when(F.col("place") == 2, F.col("machine_id"))).alias("second"),
        )
    )
    target = F.when(F.col("first") != F.col("machine_id"), F.col("first")).otherwise(F.col("second"))
    return (
        machines.join(failed.select("machine_id").distinct(), "machine_id", "left_semi")
        .select("machine_id", "work_center")
        .join(leaders, "work_center")
        .select(F.col("machine_id").alias("from_machine_id"), target.alias("to_machine_id"))
        .filter(F.col("to_machine_id").isNotNull())
    )


def out_of_service(machines: DataFrame, reported: DataFrame) -> DataFrame:
    """Reported machines that the master also lists as not working."""
    down = machines.filter(F.col("status").isin(*DOWN_STATUSES))
    return down.join(reported, "machine_id", "left_semi").select("machine_id")


def single_moves(moves: DataFrame) -> DataFrame:
    """One row per machine; two different targets are ambiguous and stop the job."""
    return (
        moves.groupBy("from_machine_id")
        .agg(F.min("to_machine_id").alias("to_machine_id"), F.max("to_machine_id").alias("other"))
        .filter(
            F.when(F.col("to_machine_id") == F.col("other"), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("two targets for machine "), F.col("from_machine_id"))).cast("boolean")
            )
        )
        .select("from_machine_id", "to_machine_id")
    )


def valid_moves(moves: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """Moves to an active machine of the same work center, one per machine.

    Without the machines only the targets' number is checked.
    """
    single = single_moves(moves)
    if machines is None:
        return single
    source = machines.select(F.col("machine_id").alias("from_machine_id"), "work_center")
    target = machines.filter(F.col("status") == "Active").select(
        F.col("machine_id").alias("to_machine_id"), F.col("work_center").alias("target_center")
    )
    return (
        single.join(source, "from_machine_id")
        .join(target, "to_machine_id")
        .filter((F.col("work_center") == F.col("target_center")) & (F.col("from_machine_id") != F.col("to_machine_id")))
        .select("from_machine_id", "to_machine_id")
    )


def reassign_work_orders(work_orders: DataFrame, moves: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """The work-order snapshot with active orders moved; all else unchanged.

    Moves are validated first. The orders are read once: those that cannot move join
    under a key of their own, which no machine has, so that they are no hot key.
    """
    valid = valid_moves(moves, machines)
    movable = F.coalesce(is_active_order() & F.col("machine_id").isNotNull(), F.lit(False))
    key = F.when(movable, F.col("machine_id")).otherwise(F.concat(F.lit("\0"), F.xxhash64("work_order_id").cast("string")))
    target = F.coalesce("to_machine_id", "machine_id").alias("machine_id")
    joined = work_orders.withColumn("_key", key).join(valid, F.col("_key") == F.col("from_machine_id"), "left")
    return joined.select(*(target if name == "machine_id" else F.col(name) for name in work_orders.columns))


def move_counts(work_orders: DataFrame, moves: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """How many orders each valid move takes along, counted on the same rows it moves."""
    valid = valid_moves(moves, machines)
    return valid.join(active_order_counts(work_orders), F.col("from_machine_id") == F.col("machine_id"), "left").select(
        "from_machine_id", "to_machine_id", F.coalesce("active_orders", F.lit(0)).alias("moved_orders")
    )
