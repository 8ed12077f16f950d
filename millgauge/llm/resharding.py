"""Resharding at minimum cost: which blocks to move so that new shards are full and few bytes move.

Each old shard is cut into blocks by a hash of the document, more the larger it is, so
that a block holds about one part in ``BLOCKS`` of all bytes; a hot shard is just more
blocks. Only the sizes of the blocks reach the driver, at most ``BLOCKS`` plus the
number of shards, whatever the size of the data.

A flow network between old shards and new capacities is solved for the least cost of
moved bytes: staying costs nothing, moving costs what ``cost`` says a byte (1 by default).
Whole blocks then realise the flow, the largest first, and the rest is evened out with
the smallest ones. Last, the files of the shards that gained or lost a block are
rewritten, and the others left alone.

The law is ``bytes``: sizes of new shards are near equal, within about a block.

Defined results. A null text has no bytes; a document's size is its bytes plus 16. A
null doc_id is hashed like any value and equal rows get consecutive slots. Extra
columns are kept; those named old_shard, block, size, shard, slot, first_slot or file
are replaced. An empty table gives empty shards.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVERHEAD = 16
BLOCKS = 8192
# Rows of a rewritten file, up to the end of its last block.
FILE_ROWS = 20_000


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long")


def move_cost(old: int, new: int) -> int:
    """Cost of a moved byte between any two shards."""
    return 0 if old == new else 1


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost: Callable[[int, int], int] = move_cost) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least total cost.

    Successive shortest paths over the two sides: each round finds, by label
    correction over residual arcs, the cheapest way from an old shard with bytes left
    to a new one with room left, and sends all it can.
    """
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = dict(supply), dict(capacity)
    while True:
        start = [old for old, amount in left.items() if amount > 0]
        if not start:
            return {arc: amount for arc, amount in flow.items() if amount}
        best: dict[tuple[str, int], int] = {("old", old): 0 for old in start}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        work = list(best)
        while work:
            side, shard = node = work.pop(0)
            if side == "old":
                arcs = [(("new", new), cost(shard, new)) for new in room]
            else:
                arcs = [(("old", old), -cost(old, shard)) for old in left if flow.get((old, shard), 0) > 0]
            for to, price in arcs:
                if best[node] + price < best.get(to, 1 << 60):
                    best[to], came[to] = best[node] + price, node
                    work.append(to)
        ends = [new for new in room if room[new] > 0 and ("new", new) in best]
        if not ends:
            raise ValueError("the new capacities are too small")
        node = ("new", min(ends, key=lambda new: (best[("new", new)], new)))
        path = [node]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[path[-1][1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "new":
                amount = min(amount, flow[(b[1], a[1])])
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                flow[(a[1], b[1])] += amount
            else:
                flow[(b[1], a[1])] -= amount
        left[path[0][1]] -= amount
        room[path[-1][1]] -= amount


def place_blocks(blocks: list[tuple[int, int, int]], capacity: dict[int, int], cost: Callable[[int, int], int] = move_cost) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes)."""
    supply: dict[int, int] = defaultdict(int)
    members: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for old, block, size in blocks:
        supply[old] += size
        members[old].append((size, block))
    wanted: dict[int, dict[int, int]] = defaultdict(dict)
    for (old, new), amount in min_cost_flow(supply, capacity, cost).items():
        wanted[old][new] = amount
    filled = dict.fromkeys(capacity, 0)
    placed = {}
    for old in sorted(members):
        # Largest block first, to the arc with the most bytes still to send.
        heap = [(-amount, new) for new, amount in wanted[old].items()]
        heapq.heapify(heap)
        for size, block in sorted(members[old], key=lambda x: (-x[0], x[1])):
            amount, new = heapq.heappop(heap)
            placed[(old, block)] = new
            filled[new] += size
            heapq.heappush(heap, (amount + size, new))
    return _evened(blocks, placed, filled, capacity)


def _evened(blocks, placed, filled, capacity) -> dict[tuple[int, int], int]:
    """Move or swap single blocks from the fullest to the emptiest shard while that evens them out."""
    inside: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for old, block, size in blocks:
        inside[placed[(old, block)]].append((size, old, block))
    over = {new: filled[new] - capacity[new] for new in capacity}
    fine = sum(capacity.values()) // 1_000_000
    for _ in range(8 * len(capacity)):
        full, empty = max(over, key=lambda s: (over[s], s)), min(over, key=lambda s: (over[s], s))
        gap = over[full] - over[empty]
        if gap <= fine:
            break


        def more(block: tuple[int, int, int], source: int, target: int) -> int:
            """Bytes moved more, or fewer, than before if the block goes from source to target."""
            return block[0] * ((block[1] != target) - (block[1] != source))

        # What has to move is half the gap: one block, or the difference of two. Blocks
        # that have left their old shard anyway come first.
        options = [(abs(gap / 2 - one[0]) + more(one, full, empty) / 4, one, None) for one in inside[full] if one[0] < gap]
        few = sorted(inside[empty], key=lambda other: (more(other, empty, full), other))[:64]
        options += [
            (abs(gap / 2 - (one[0] - other[0])) + (more(one, full, empty) + more(other, empty, full)) / 4, one, other)
            for one in inside[full]
            for other in few
            if 0 < one[0] - other[0] < gap
        ]
        if not options:
            break
        _, one, other = min(options, key=lambda option: option[0])
        for moved, source, target in ((one, full, empty), (other, empty, full)):
            if moved is not None:
                inside[source].remove(moved)
                inside[target].append(moved)
                over[source] -= moved[0]
                over[target] += moved[0]
                placed[(moved[1], moved[2])] = target
    return placed


@dataclass(frozen=True)
class Plan:
    """``layout`` has (old_shard, block, shard, first_slot, file), a row per block; ``affected`` the shards to rewrite."""

    layout: DataFrame
    affected: list[int]


def _blocked(docs: DataFrame, doc: str, text: str, old_shard: Column, parts: dict[int, int]) -> DataFrame:
    """The rows with ``old_shard``, ``block`` and ``size``."""
    cuts = F.create_map(*(F.lit(x) for pair in sorted(parts.items()) for x in pair)) if parts else F.create_map().cast("map<int,int>")
    rows = docs.withColumns({"old_shard": old_shard.cast("int"), "size": size_of(F.col(text))}).drop("shard", "slot", "first_slot", "file")
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), doc, text), F.coalesce(F.try_element_at(cuts, "old_shard"), F.lit(1))).cast("int"))


def plan(docs: DataFrame, old_shard: Column, n_new: int, doc: str = "doc_id", text: str = "text", cost=move_cost) -> tuple[DataFrame, Plan]:
    """The rows cut into blocks, and the layout that fills ``n_new`` shards evenly."""
    spark = docs.sparkSession
    totals = {row[0]: row[1] for row in docs.select(old_shard.cast("int").alias("s"), size_of(F.col(text)).alias("b")).groupBy("s").agg(F.sum("b")).collect()}
    everything = sum(totals.values())
    parts = {old: 1 + amount * BLOCKS // max(1, everything) for old, amount in totals.items()}
    rows = _blocked(docs, doc, text, old_shard, parts)
    sizes = [tuple(row) for row in rows.groupBy("old_shard", "block").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    capacity = {new: everything // n_new + (new < everything % n_new) for new in range(n_new)}
    placed = place_blocks([(old, block, size) for old, block, size, _ in sizes], capacity, cost)
    slots, layout, affected = [0] * n_new, [], set()
    for old, block, _, n in sorted(sizes):
        new = placed[(old, block)]
        layout.append((old, block, new, slots[new], slots[new] // FILE_ROWS))
        slots[new] += n
        if new != old:
            affected |= {old, new}
    schema = "old_shard int, block int, shard int, first_slot long, file long"
    return rows, Plan(spark.createDataFrame(layout, schema), sorted(affected))


def reshard(docs: DataFrame, old_shard: Column, n_new: int, doc: str = "doc_id", text: str = "text", cost=move_cost) -> tuple[DataFrame, list[int]]:
    """The rows with ``size``, ``old_shard``, ``shard`` and ``slot``, and the shards that change.

    Slots number a shard's rows from 0 without gaps: blocks follow one another, and
    rows are numbered within their block, which is small however hot a shard is. Rows
    are dealt out by new shard and file, once; the numbering needs no other order. The
    layout is broadcast: it has no more rows than BLOCKS and the number of old shards.
    """
    rows, found = plan(docs, old_shard, n_new, doc, text, cost)
    placed = rows.join(F.broadcast(found.layout), ["old_shard", "block"]).repartition("shard", "file")
    order = Window.partitionBy("shard", "file", "old_shard", "block").orderBy(doc, F.xxhash64(text))
    out = placed.withColumn("slot", F.col("first_slot") + F.row_number().over(order) - 1)
    return out.drop("first_slot", "block", "file"), found.affected


def rewrite_affected(placed: DataFrame, affected: list[int], path: str) -> None:
    """Write the files of the shards that change, one folder a shard, in slot order.

    The rows come dealt by shard and file, so a shard fills as many files as it needs
    and no task writes a whole shard.
    """
    rows = placed.where(F.col("shard").isin(affected)) if affected else placed.limit(0)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, placed: DataFrame) -> DataFrame:
    """The rows of the rewritten shards, as ``placed`` had them."""
    return spark.read.schema(placed.schema).parquet(path)
