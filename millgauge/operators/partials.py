"""Gold rollups kept current by what has arrived: stored sums, counts, minima and maxima per period.

A rollup's measures come from a few partial values that can be combined, so a delivery
is aggregated alone and merged into the stored partials. These lie in one folder per
period; only the periods that a delivery has rows of are read and written again, and the
files of all others stay as they are. What the partials mean is computed when the table
is read, from as many rows as the table has.

Every period knows the last batch that is in it. Should a refresh stop after some of its
periods have been replaced, the next one leaves out, period by period, the batches that
are already in. A batch number is never reused, and rows of a batch never change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millgauge import session
from millgauge.functions.numeric import percent, rnd, tally
from millgauge.functions.periods import day_of, month_of, week_of
from millgauge.operators import gold

_COMBINE: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Rollup:
    """One gold table: its source, its keys, and how its measures are made of partial values.

    ``partials`` names per value how two of it combine (sum, min or max) and the aggregate
    over a delivery's rows. ``period`` is the key whose month divides the stored table.
    """

    source: str
    rows: Callable[[], Column]
    keys: Callable[[], dict[str, Column]]
    period: str
    partials: Callable[[], dict[str, tuple[str, Column]]]
    finish: Callable[[DataFrame], DataFrame]

    def partial(self, rows: DataFrame) -> DataFrame:
        """Partial values of the rows per period and key, with the newest batch among them."""
        keyed = rows.where(self.rows()).select("*", *(key.alias(f"_{name}") for name, key in self.keys().items()))
        names = [F.col(f"_{name}").alias(name) for name in self.keys()]
        period = F.date_format(F.col(f"_{self.period}"), "yyyy-MM").alias("period")
        values = (column.alias(name) for name, (_, column) in self.partials().items())
        return keyed.groupBy(period, *names).agg(*values, F.max("batch_id").cast("long").alias("through_batch"))

    def merge(self, partials: DataFrame) -> DataFrame:
        """Partial values of the same key combined."""
        values = (_COMBINE[how](name).alias(name) for name, (how, _) in self.partials().items())
        return partials.groupBy("period", *self.keys()).agg(*values, F.max("through_batch").alias("through_batch"))


def _count(value: str) -> tuple[str, Column]:
    return "sum", F.count(value)


def _total(value: str) -> tuple[str, Column]:
    return "sum", F.sum(value)


def _mean(name: str) -> Column:
    return F.col(f"{name}_sum") / F.col(f"{name}_n")


_AVERAGED = {
    "temp": ("temperature_celsius", 2), "vibration": ("vibration_mm_s", 3), "spindle": ("spindle_speed_rpm", 0),
    "power": ("power_consumption_kw", 2), "coolant": ("coolant_flow_lpm", 2), "health": ("health_score", 1),
}
_SHOWN = {"temp": "avg_temp_c", "vibration": "avg_vibration", "spindle": "avg_spindle_rpm", "power": "avg_power_kw",
          "coolant": "avg_coolant_lpm", "health": "avg_health_score"}


def _health_partials() -> dict[str, tuple[str, Column]]:
    made = {"sensor_readings": ("sum", F.count(F.lit(1))), "anomaly_count": ("sum", tally(F.col("anomaly_flag")))}
    for name, (column, _) in _AVERAGED.items():
        made[f"{name}_sum"], made[f"{name}_n"] = ("sum", F.sum(F.col(column).cast("double"))), _count(column)
    made |= {f"max_{name}": ("max", F.max(_AVERAGED[name][0])) for name in ("temp", "vibration")}
    return made | {"peak_wear": ("max", F.max("tool_wear_pct")), "min_health_score": ("min", F.min("health_score"))}


def _health(merged: DataFrame) -> DataFrame:
    """Machines and days as ``gold.with_maintenance`` takes them."""
    means = (rnd(_mean(name), digits).alias(_SHOWN[name]) for name, (_, digits) in _AVERAGED.items())
    highest = (rnd(F.col("max_temp"), 2).alias("max_temp_c"), rnd(F.col("max_vibration"), 3).alias("max_vibration"))
    return merged.select("machine_id", "reading_date", "sensor_readings", *means, *highest, "peak_wear", "min_health_score", "anomaly_count")


def _scheduling_partials() -> dict[str, tuple[str, Column]]:
    complete = F.col("status") == "Complete"
    done = F.when(complete, F.col("actual_total_hrs"))
    return {
        "total_orders": ("sum", F.count(F.lit(1))),
        "farm_out_count": ("sum", tally(F.col("is_farm_out"))),
        "late_count": ("sum", tally(F.col("is_late"))),
        "completed_count": ("sum", tally(complete)),
        "on_time": ("sum", tally(complete & ~F.col("is_late"))),
        "cost": ("sum", F.sum(F.coalesce("farm_out_cost_usd", F.lit(0.0)))),
        "actual_sum": ("sum", F.sum(done)),
        "actual_n": ("sum", F.count(done)),
        "standard": _total("standard_total_hrs"),
    }


def _scheduling(merged: DataFrame) -> DataFrame:
    return merged.select(
        "period_week", "period_month", F.year("period_month").alias("period_year"), "work_center", "priority",
        "total_orders", "farm_out_count", "late_count", "completed_count",
        rnd(F.col("cost"), 2).alias("total_farm_out_cost"),
        rnd(_mean("actual"), 2).alias("avg_actual_hrs"),
        rnd(F.col("standard"), 2).alias("total_standard_hrs"),
        percent(F.col("on_time"), F.col("completed_count")).alias("on_time_delivery_pct"),
    )


def _farmout_partials() -> dict[str, tuple[str, Column]]:
    return {
        "farm_out_orders": ("sum", F.count(F.lit(1))),
        "total_qty_farmed": _total("order_qty"),
        "cost_sum": _total("farm_out_cost_usd"),
        "cost_n": _count("farm_out_cost_usd"),
        "hrs": _total("standard_total_hrs"),
    }


def _farmout(merged: DataFrame, internal_rate: float = gold.INTERNAL_RATE_USD) -> DataFrame:
    cost, internal = F.col("cost_sum"), F.col("hrs") * internal_rate
    return merged.select(
        "farm_out_vendor", "part_number", "part_description", "period_month", F.year("period_month").alias("period_year"),
        "farm_out_orders", "total_qty_farmed",
        rnd(cost, 2).alias("total_farm_out_cost"),
        rnd(_mean("cost"), 2).alias("avg_cost_per_order"),
        rnd(F.col("hrs"), 2).alias("equivalent_internal_hrs"),
        rnd(internal, 2).alias("implied_internal_cost"),
        percent(cost - internal, cost).alias("cost_premium_pct"),
    )


# The rollups that do not depend on the machine an order is on, which a reassignment changes.
ROLLUPS: dict[str, Rollup] = {
    "gold_predictive_maintenance": Rollup(
        "silver_sensor_data",
        lambda: F.lit(True),
        lambda: {"machine_id": F.col("machine_id"), "reading_date": day_of(F.col("reading_timestamp"))},
        "reading_date",
        _health_partials,
        _health,
    ),
    "gold_scheduling_performance": Rollup(
        "silver_work_orders",
        lambda: F.col("due_date").isNotNull(),
        lambda: {
            "period_week": week_of(F.col("due_date")), "period_month": month_of(F.col("due_date")),
            "work_center": F.col("work_center"), "priority": F.col("priority"),
        },
        "period_month",
        _scheduling_partials,
        _scheduling,
    ),
    "gold_farmout_analysis": Rollup(
        "silver_work_orders",
        lambda: F.col("is_farm_out") & F.col("farm_out_vendor").isNotNull(),
        lambda: {
            "farm_out_vendor": F.col("farm_out_vendor"), "part_number": F.col("part_number"),
            "part_description": F.col("part_description"), "period_month": month_of(F.col("due_date")),
        },
        "period_month",
        _farmout_partials,
        _farmout,
    ),
}


def path_of(root: str, table: str) -> str:
    return f"{root}/partials/{table}"


def stored_partials(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The stored partial values, or None before the first refresh."""
    try:
        # Periods look like numbers or dates to the reader; they are names.
        return spark.read.parquet(path_of(root, table)).withColumn("period", F.col("period").cast("string"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _taken_in(spark: SparkSession, root: str, table: str) -> int:
    try:
        return spark.read.schema("last_batch bigint").parquet(f"{path_of(root, table)}_through").agg(F.max("last_batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def by_period(merged: DataFrame) -> DataFrame:
    """The rows of a period together, in several tasks where the rollup has many keys in a month."""
    return merged.hint("rebalance", "period")


def refresh(spark: SparkSession, root: str, table: str) -> None:
    """Merge the batches that have arrived since the last refresh into the periods they have rows of."""
    rollup = ROLLUPS[table]
    arrived = spark.read.parquet(f"{root}/{rollup.source}").where(F.col("batch_id") > _taken_in(spark, root, table))
    last = arrived.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    known = stored_partials(spark, root, table)
    fresh = arrived
    if known is not None:
        # Batches that a refresh which did not end has brought into some of the periods.
        through = known.groupBy("period").agg(F.max("through_batch").alias("through"))
        period = F.date_format(rollup.keys()[rollup.period], "yyyy-MM")
        marked = arrived.withColumn("_period", period).join(through, F.col("_period").eqNullSafe(F.col("period")), "left")
        fresh = marked.where(F.coalesce(F.col("batch_id") > F.col("through"), F.lit(True))).drop("_period", "period", "through")
    partial = rollup.partial(fresh)
    scratch = session.fresh_folder(spark, "partials")
    partial.write.parquet(scratch)
    partial = spark.read.schema(partial.schema).parquet(scratch)
    if known is not None:
        touched = partial.select(F.col("period").alias("touched")).distinct()
        same = known.join(touched, F.col("period").eqNullSafe(F.col("touched")), "left_semi")
        partial = partial.unionByName(same.select(*partial.columns))
    merged = session.fresh_folder(spark, "merged")
    by_period(rollup.merge(partial)).write.parquet(merged)
    spark.read.parquet(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path_of(root, table))
    spark.createDataFrame([(last,)], "last_batch bigint").coalesce(1).write.mode("append").parquet(f"{path_of(root, table)}_through")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rollup from its stored partial values; sensor days still without the machines' attributes."""
    stored = stored_partials(spark, root, table)
    if stored is None:
        raise ValueError(f"{table} has not been refreshed yet")
    return ROLLUPS[table].finish(stored)
