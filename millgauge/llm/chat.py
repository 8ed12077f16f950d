"""Chat formatting with a least-cost repair of roles.

A legal conversation is an optional system turn, then user and assistant turns in
alternation. An automaton with four states (start, after system, after user, after
assistant) reads a conversation's turns in order. For each turn it may

* take it in its role,
* merge it into the turn before, if that has the same role,
* relabel it, taken or merged,
* insert an empty turn of the role that is missing, and then take it;

``COSTS`` prices these. The repair of least total cost is chosen by dynamic programming.

A turn is a 4 x 4 table of costs between states, and tables combine by the least sum, in
any grouping. The rows of a conversation are numbered in their order: all rows are dealt
by ranges of that order, numbered in each range, and the numbers of a conversation that
began in an earlier range are raised by its rows there. Conversations are cut into
stretches of ``STRETCH`` rows by that number, whatever their turn numbers are: each
stretch is one table, tables are combined ``FAN`` at a time, level by level, and the
states at the ends of each are handed down in the same way; every stretch then repairs
itself alone. A conversation with a third of all rows is so as many stretches as it
needs, never one task.

Defined results. Turns are ordered by turn number (null first), then role (null first),
the first ``PREFIX`` characters of the text and a hash of the whole, so ties have one
order; repeated rows are alike and dealt by their number. A null or unknown role fits no state and is
always relabelled, at ``COSTS['unknown']``. A null text is empty. Rows without a
conv_id are a conversation of their own. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millgauge.llm.common import stored

STRETCH = 256
# Tables combined in one step.
FAN = 256
# Characters of a text that order it; bounds of ranges are held by the driver.
PREFIX = 128
ROLES = ("system", "user", "assistant")
# States: 0 is the start, 1 + k is after a turn of role k.
STATES = 1 + len(ROLES)
# Roles that may follow a state without an insertion.
NEXT = ((0, 1), (1,), (2,), (1,))
COSTS = {"take": 0, "merge": 2, "relabel": 3, "insert": 4, "unknown": 1}
FAR = 1 << 40

# How a repaired turn is rendered.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def _moves(role: str | None) -> list[list[tuple[int, int, tuple]]]:
    """From each state: (cost, next state, action) of the ways to read a turn of this role."""
    ways: list[list[tuple[int, int, tuple]]] = []
    for state in range(STATES):
        here = []
        for target, name in enumerate(ROLES):
            if role not in ROLES:
                label = COSTS["unknown"]
            else:
                label = 0 if role == name else COSTS["relabel"]
            if target in NEXT[state]:
                here.append((label + COSTS["take"], 1 + target, ("take", target, None)))
            if state == 1 + target:
                here.append((label + COSTS["merge"], state, ("merge", target, None)))
            for between in NEXT[state]:
                # One empty turn opens the way to the role.
                if target not in NEXT[state] and target in NEXT[1 + between]:
                    here.append((label + COSTS["insert"], 1 + target, ("insert", target, between)))
        ways.append(sorted(here))
    return ways


MOVES = {role: _moves(role) for role in (*ROLES, None)}


def _known(role) -> str | None:
    return role if role in ROLES else None


def _costs(role: str | None) -> np.ndarray:
    table = np.full((STATES, STATES), FAR, np.int64)
    for state, ways in enumerate(MOVES[role]):
        for cost, target, _ in ways:
            table[state, target] = min(table[state, target], cost)
    return table


TABLES = {role: _costs(role) for role in MOVES}


def _combined(roles: Iterator[str | None]) -> np.ndarray:
    """Least costs over a run of turns, from each state to each."""
    total = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for role in roles:
        total = np.minimum(FAR, (total[:, :, None] + TABLES[role][None, :, :]).min(axis=1))
    return total


def repair(roles: list[str | None], begin: int = 0, end: int | None = None) -> tuple[int, list[tuple]]:
    """Least cost and actions (what, role, inserted role) that read the turns from state to state.

    ``end`` of None is any state. Equal costs are settled by the order of the moves.
    """
    cost = [FAR] * STATES
    cost[begin] = 0
    back: list[list] = []
    for role in roles:
        new, via = [FAR] * STATES, [None] * STATES
        for state in range(STATES):
            if cost[state] < FAR:
                for price, target, action in MOVES[_known(role)][state]:
                    if cost[state] + price < new[target]:
                        new[target], via[target] = cost[state] + price, (state, action)
        cost = new
        back.append(via)
    state = min(range(STATES), key=lambda s: (cost[s], s)) if end is None else end
    total, actions = cost[state], []
    for via in reversed(back):
        state, action = via[state]
        actions.append(action)
    return total, actions[::-1]


KEY = ["lacks", "conv", "stretch"]
NUMBERED = "lacks boolean, conv long, role string, text string, part int, nth long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their number in their conversation, as far as it lies in this partition."""
    last, done = None, 0
    for batch in batches:
        lacks, conv = (np.asarray(batch[name].to_numpy(zero_copy_only=False)) for name in ("lacks", "conv"))
        n = batch.num_rows
        if not n:
            continue
        opens = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (lacks[1:] != lacks[:-1])])
        nth = np.arange(n) - np.repeat(opens, np.diff(np.r_[opens, n]))
        if last == (bool(lacks[0]), int(conv[0])):
            nth[: opens[1] if len(opens) > 1 else n] += done
        last, done = (bool(lacks[-1]), int(conv[-1])), int(nth[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(nth.astype(np.int64))], [*batch.schema.names, "nth"])


def _stretched(turns: DataFrame) -> DataFrame:
    """(lacks, conv, stretch, nth, role, text) of all rows; ``lacks`` marks rows without a conv_id."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").isNull().alias("lacks"),
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        text.alias("text"),
        F.substring(text, 1, PREFIX).alias("prefix"),
        F.xxhash64(text).alias("hash"),
        # Only parts rows that are alike, so that many of them fill several ranges.
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["lacks", "conv", "turn", "role", "prefix", "hash", "salt"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(
        dealt.select("lacks", "conv", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(_numbered, NUMBERED), "numbered-turns"
    )
    counts = numbered.groupBy("lacks", "conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("lacks", "conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes on into each partition.
    raised = stored(counts.withColumn("earlier", F.sum("n").over(earlier)).where("earlier > 0").drop("n"), "turns-in-earlier-parts")
    nth = F.col("nth") + F.coalesce("earlier", F.lit(0).cast("long"))
    joined = numbered.join(raised, ["lacks", "conv", "part"], "left")
    return joined.select("lacks", "conv", F.floor(nth / STRETCH).alias("stretch"), nth.alias("nth"), "role", "text")


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values("nth")


def _tables(rows: pd.DataFrame) -> pd.DataFrame:
    total = _combined(map(_known, _in_order(rows)["role"]))
    first = rows.iloc[0]
    return pd.DataFrame({**{name: [first[name]] for name in KEY}, "costs": [total.ravel().tolist()]})


def _far(value: int = FAR):
    return F.lit(value).cast("long")


def _states():
    return F.sequence(F.lit(0), F.lit(STATES - 1))


def _families(tables: DataFrame) -> DataFrame:
    """At most FAN consecutive tables of a conversation in a row, in order."""
    in_order = F.sort_array(F.collect_list(F.struct("stretch", "costs")))
    return tables.groupBy("lacks", "conv", F.floor(F.col("stretch") / FAN).alias("family")).agg(in_order.alias("parts"))


def _step(costs, table):
    """Costs to reach each state after the table."""
    return F.transform(_states(), lambda to: F.array_min(F.transform(_states(), lambda at: F.least(_far(), F.get(costs, at) + F.get(table, at * STATES + to)))))


def _up(tables: DataFrame) -> DataFrame:
    """One table for each family."""

    def from_state(begin: int):
        unit = F.array(*(_far(0 if s == begin else FAR) for s in range(STATES)))
        return F.aggregate("parts", unit, lambda costs, part: _step(costs, part["costs"]))

    return _families(tables).select("lacks", "conv", F.col("family").alias("stretch"), F.concat(*(from_state(s) for s in range(STATES))).alias("costs"))


def _cheapest(costs):
    return F.array_position(costs, F.array_min(costs)).cast("int") - 1


def _down(tables: DataFrame, ends: DataFrame) -> DataFrame:
    """The states before and after each table on a cheapest way between those of its family.

    The way is found forward, by the costs to reach each state, and then backward.
    """
    ends = ends.withColumnRenamed("stretch", "family")
    grouped = _families(tables).join(ends, ["lacks", "conv", "family"])
    start = F.transform(_states(), lambda s: F.when(s == F.col("begin"), _far(0)).otherwise(_far()))
    # Costs to reach each state before each table, and after the last.
    reached = F.aggregate("parts", F.array(start), lambda done, part: F.concat(done, F.array(_step(F.element_at(done, -1), part["costs"]))))
    walked = grouped.withColumn("reached", reached)

    def before(path, k):
        """The state before table k that leads to the first of the path so far at least cost."""
        to = F.get(path, F.lit(0))
        return _cheapest(F.transform(_states(), lambda at: F.get(F.get("reached", k), at) + F.get(F.get("parts", k)["costs"], at * STATES + to)))

    path = F.aggregate(
        F.reverse(F.sequence(F.lit(0), F.size("parts") - 1)), F.array("end"), lambda path, k: F.concat(F.array(before(path, k)), path)
    )
    return (
        walked.withColumn("path", path)
        .select("lacks", "conv", "path", F.posexplode("parts").alias("k", "part"))
        .select(
            "lacks",
            "conv",
            F.col("part")["stretch"].alias("stretch"),
            F.get("path", F.col("k")).alias("begin"),
            F.get("path", F.col("k") + 1).alias("end"),
        )
    )


def _entries(tables: DataFrame) -> DataFrame:
    """The states before and after each stretch on a cheapest way through its conversation."""
    levels, last = [tables], tables.agg(F.max("stretch")).first()[0] or 0
    while last:
        levels.append(stored(_up(levels[-1]), "combined-tables"))
        last //= FAN
    top = levels.pop()
    ends = top.select("lacks", "conv", "stretch", F.lit(0).alias("begin"), _cheapest(F.slice("costs", 1, STATES)).alias("end"))
    for tables in reversed(levels):
        ends = stored(_down(tables, ends), "states")
    return ends.withColumn("leads", F.col("stretch") == 0)


REPAIRED = "lacks boolean, conv long, stretch long, place int, role string, text string, merged boolean, leads boolean, cost int, n_merged int, n_relabelled int, n_inserted int"


def _repaired(rows: pd.DataFrame) -> pd.DataFrame:
    """Turns of one stretch after its repair. ``merged``: the first continues the stretch before."""
    ordered = _in_order(rows)
    first = ordered.iloc[0]
    cost, actions = repair(list(ordered["role"]), int(first["begin"]), int(first["end"]))
    out: list[list] = []
    relabelled = sum(role != ROLES[target] for role, (_, target, _) in zip(ordered["role"], actions))
    for text, (what, target, between) in zip(ordered["text"], actions):
        if what == "insert":
            out.append([ROLES[between], "", False])
        if what == "merge" and out:
            out[-1][1] += "\n" + text
        else:
            out.append([ROLES[target], text, what == "merge"])
    counts = {"cost": cost, "n_merged": sum(a[0] == "merge" for a in actions), "n_relabelled": relabelled, "n_inserted": sum(a[0] == "insert" for a in actions)}
    frame = pd.DataFrame(out, columns=["role", "text", "merged"])
    for at, name in enumerate(KEY):
        frame.insert(at, name, first[name])
    frame.insert(len(KEY), "place", range(len(out)))
    frame["leads"] = [bool(first["leads"])] + [False] * (len(out) - 1)
    for name, value in counts.items():
        frame[name] = [value] + [0] * (len(out) - 1)
    return frame


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired turns in pieces, ordered by (conv_id, stretch, place).

    A piece with ``merged`` set continues the last turn of the stretch before; the one
    with ``leads`` set begins its conversation.
    """
    rows = _stretched(turns)
    roles = rows.select(*KEY, "nth", "role")
    tables = stored(roles.groupBy(*KEY).applyInPandas(_tables, "lacks boolean, conv long, stretch long, costs array<long>"), "role-tables")
    ways = stored(_entries(tables), "role-states")
    pieces = rows.join(ways, KEY).groupBy(*KEY).applyInPandas(_repaired, REPAIRED)
    return pieces.select(F.when(~F.col("lacks"), F.col("conv")).alias("conv_id"), *pieces.columns[2:])


def rendered_pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, stretch, rendered, counts): the rendering of each stretch.

    The pieces of a conversation, joined in order of stretch, are its rendering: a turn
    is closed where the next begins, so a turn over a border of stretches is whole.
    """
    pieces = repaired_turns(turns)
    opened = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    shown = (
        F.when(F.col("merged"), F.concat(F.lit("\n"), F.col("text")))
        .when(F.col("leads"), opened)
        .otherwise(F.concat(F.lit(CLOSE), opened))
    )
    each = pieces.withColumn("shown", shown)
    return each.groupBy("conv_id", "stretch").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "shown"))), lambda p: p["shown"]), "").alias("rendered"),
        *(F.sum(name).cast("long").alias(name) for name in ("cost", "n_merged", "n_relabelled", "n_inserted")),
        F.sum((~F.col("merged")).cast("long")).alias("n_turns"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: counts of the repair and the digests of its rendered stretches.

    ``rendered_sha256`` hashes the SHA-256 of each stretch's rendering in order, so a
    long conversation is never joined into one value.
    """
    pieces = rendered_pieces(turns)
    digests = F.transform(F.sort_array(F.collect_list(F.struct("stretch", F.sha2("rendered", 256).alias("sha")))), lambda p: p["sha"])
    return pieces.groupBy("conv_id").agg(
        *(F.sum(name).alias(name) for name in ("n_turns", "cost", "n_merged", "n_relabelled", "n_inserted")),
        F.sum(F.char_length("rendered") + 0).alias("n_chars"),
        F.count(F.lit(1)).alias("n_stretches"),
        F.sha2(F.array_join(digests, ","), 256).alias("rendered_sha256"),
    )
