"""The log of reassignments, and work orders as it leaves them.

A reassignment is one numbered entry: its moves, and the last batch of work orders that
had arrived. A move takes the active orders of one machine that arrived up to that batch
to another machine; orders of later batches keep theirs until a later entry. The orders
themselves stay as they arrived, so none is lost whatever the sequence of arrivals and
moves, and leaving out the last entries gives the state before them.

An order meets its first move by an as-of join on its machine and batch: the moves off a
machine divide the batches into intervals. Where later moves take it from there does not
depend on the order, so chains of moves are resolved once, in the log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millgauge import session
from millgauge.operators.dispatch import is_active_order, valid_moves

LOG = "number bigint, last_batch bigint, from_machine_id string, to_machine_id string"
# The batch of an entry made before any order has arrived.
NO_BATCH = -1


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """All moves so far, or None if there was no reassignment."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def log_moves(spark: SparkSession, path: str, moves: DataFrame, machines: DataFrame, last_batch: int | None) -> int:
    """Append the valid moves as the next entry and return its number.

    The entry is one file, which Spark commits as a whole or not at all.
    """
    so_far = read_log(spark, path)
    newest = so_far.agg(F.max("number")).first()[0] if so_far is not None else None
    number = 1 if newest is None else newest + 1
    batch = NO_BATCH if last_batch is None else last_batch
    entry = valid_moves(moves, machines).select(
        F.lit(number).cast("long").alias("number"), F.lit(batch).cast("long").alias("last_batch"), "from_machine_id", "to_machine_id"
    )
    entry.coalesce(1).write.mode("append").parquet(path)
    return number


def resolved(log: DataFrame) -> DataFrame:
    """(from_machine_id, after_batch, up_to_batch, machine_id): where an order of a machine and batch ends up.

    A chain grows by one move a round: the machine reached is looked up among the later
    entries, and the earliest that leaves it is followed. Numbers only rise, so the
    rounds end, after as many as the longest chain has moves.
    """
    by_machine = Window.partitionBy("from_machine_id").orderBy("number")
    chains = log.select(
        "from_machine_id",
        F.coalesce(F.lag("last_batch").over(by_machine), F.lit(NO_BATCH).cast("long")).alias("after_batch"),
        F.col("last_batch").alias("up_to_batch"),
        F.col("to_machine_id").alias("machine_id"),
        F.col("number").alias("reached_at"),
    ).where("after_batch < up_to_batch")
    onward = log.select(F.col("from_machine_id").alias("machine_id"), F.col("number").alias("leaves_at"), F.col("to_machine_id").alias("next_machine"))
    while True:
        later = chains.join(onward, "machine_id").where("leaves_at > reached_at")
        step = later.groupBy("from_machine_id", "after_batch", "up_to_batch").agg(F.min(F.struct("leaves_at", "next_machine")).alias("step"))
        if step.isEmpty():
            return chains.drop("reached_at")
        chains = chains.join(step, ["from_machine_id", "after_batch", "up_to_batch"], "left").select(
            "from_machine_id",
            "after_batch",
            "up_to_batch",
            F.coalesce("step.next_machine", "machine_id").alias("machine_id"),
            F.coalesce("step.leaves_at", "reached_at").alias("reached_at"),
        )
        # The log is small, but its plan would double every round.
        path = session.fresh_folder(log.sparkSession, "move-chains")
        chains.write.parquet(path)
        chains = log.sparkSession.read.schema(chains.schema).parquet(path)


def apply_log(orders: DataFrame, log: DataFrame, up_to: int | None = None) -> DataFrame:
    """Orders with a ``batch_id``, on the machines that the entries, up to a number if one is given, leave them on.

    Orders that cannot move join under a key of their own, which no machine has, so that
    they are no hot key and every order is read once.
    """
    entries = log if up_to is None else log.where(F.col("number") <= up_to)
    moved = resolved(entries).select("from_machine_id", "after_batch", "up_to_batch", F.col("machine_id").alias("moved_to"))
    movable = F.coalesce(is_active_order() & F.col("machine_id").isNotNull(), F.lit(False))
    key = F.when(movable, F.col("machine_id")).otherwise(F.concat(F.lit("\0"), F.xxhash64("work_order_id").cast("string")))
    met = (F.col("_key") == F.col("from_machine_id")) & (F.col("batch_id") > F.col("after_batch")) & (F.col("batch_id") <= F.col("up_to_batch"))
    target = F.coalesce("moved_to", "machine_id").alias("machine_id")
    joined = orders.withColumn("_key", key).join(moved, met, "left")
    return joined.select(*(target if name == "machine_id" else F.col(name) for name in orders.columns))
