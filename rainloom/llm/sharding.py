"""Resharding by minimum-cost flow.

Old shards are supplies of bytes, new shards have capacities; a byte that stays in its shard costs
nothing, one that moves costs one.  The network has a node for each shard and one hub, so it has
as many arcs as shards, and successive shortest paths solve it on the driver: its size is the
number of shards, not of documents.  Each old shard then gives away the documents at the end of
its order (the small ones, so that cuts fall between small documents) by running byte sums.  Only
shards that lose or gain documents have to be written again.

Documents move one by one: equal texts may lie in several shards.  A group of copies can hold a third
of all bytes, more than one of eight shards, so groups kept whole could not have near-equal shards.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .ranks import deal, deals, ranked, size_class
from .scratch import keep


class Network:
    """Minimum-cost flow by successive shortest paths (queue-based Bellman-Ford)."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        n = len(self.out)
        while True:
            far, by, queued = [None] * n, [-1] * n, [False] * n
            far[source], queue = 0, deque([source])
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and (far[b] is None or far[a] + self.cost[e] < far[b]):
                        far[b], by[b] = far[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if far[sink] is None:
                return
            path, a = [], sink
            while a != source:
                path.append(by[a])
                a = self.to[by[a] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def transfers(old: dict[int, int], capacity: dict[int, int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) that move the fewest bytes; what stays is listed too.

    ``capacity`` has to hold all bytes of ``old``.
    """
    if sum(old.values()) > sum(capacity.values()):
        raise ValueError("the new shards do not have room for all bytes")
    olds, news = sorted(old), sorted(capacity)
    source, sink, hub = 0, 1, 2
    at_old, at_new = {s: 3 + k for k, s in enumerate(olds)}, {s: 3 + len(olds) + k for k, s in enumerate(news)}
    net = Network(3 + len(olds) + len(news))
    stay, leave, enter = {}, {}, {}
    for s in olds:
        net.arc(source, at_old[s], old[s], 0)
        if s in at_new:
            stay[s] = net.arc(at_old[s], at_new[s], old[s], 0)
        leave[s] = net.arc(at_old[s], hub, old[s], 1)
    for s in news:
        enter[s] = net.arc(hub, at_new[s], capacity[s], 0)
        net.arc(at_new[s], sink, capacity[s], 0)
    net.solve(source, sink)
    flow = lambda e: net.room[e ^ 1]
    out = [(s, s, flow(e)) for s, e in stay.items() if flow(e)]
    wanted = deque((s, flow(e)) for s, e in enter.items() if flow(e))
    for s, e in leave.items():
        rest = flow(e)
        while rest:
            to, room = wanted.popleft()
            part = min(rest, room)
            out.append((s, to, part))
            rest -= part
            if room > part:
                wanted.appendleft((to, room - part))
    return sorted(out, key=lambda x: (x[0], x[0] != x[1], x[1]))


def even_capacities(total: int, shards: int) -> dict[int, int]:
    """Capacities that sum to ``total`` and differ by at most one byte."""
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def reshard(rows: DataFrame, capacity: dict[int, int] | int, old: str = "old_shard", size: str = "size", doc_id: str = "doc_id") -> DataFrame:
    """``rows``, which have an old shard and a size in bytes, with shard and slot.

    ``capacity``: bytes by new shard, or a number of new shards of equal size.  A shard's bytes
    come within about one small document of its capacity for each transfer it takes part in.
    slot numbers the documents of a shard without gaps from 0, by a hash of doc_id.  Repeated
    rows are rows of their own, a null doc_id sorts first; rows without an old shard count as
    those of shard -1, which does not stay.  Columns named shard or slot are replaced; an empty
    table gives an empty one.
    """
    rows = keep(rows.drop("shard", "slot").withColumn("__old", F.coalesce(F.col(old).cast("int"), F.lit(-1))), "rows")
    count = rows.count()
    have = {r[0]: r[1] for r in rows.groupBy("__old").agg(F.sum(size).cast("long")).collect()}
    plan = transfers(have, even_capacities(sum(have.values()), capacity) if isinstance(capacity, int) else capacity)
    cuts: dict[int, list[tuple[int, int]]] = {}
    for s, to, amount in plan:
        mine = cuts.setdefault(s, [])
        mine.append(((mine[-1][0] if mine else 0) + amount, to))
    binned = rows.withColumns({"__class": -size_class(F.col(size)), "__deal": deal(F.col(doc_id), deals(count))})
    placed = ranked(binned, ["__old"], ["__class", "__deal"], [F.col(size).desc(), F.col(doc_id)], "__start", value=F.col(size))
    middle = F.col("__start") * 2 + F.col(size)

    def target() -> Column:
        # Cuts for each old shard, in order, as a literal map: as many entries as transfers.
        ends = F.create_map(*[x for s, c in cuts.items() for x in (F.lit(s), F.array(*[F.struct(F.lit(2 * end).cast("long").alias("end"), F.lit(to).alias("to")) for end, to in c]))])
        mine = F.element_at(ends, F.col("__old"))
        return F.coalesce(F.element_at(F.filter(mine, lambda x: middle < x["end"]), 1)["to"], F.element_at(mine, -1)["to"])

    shard = target() if cuts else F.lit(None).cast("int")
    placed = keep(placed.withColumn("shard", shard.cast("int")).drop("__class", "__start"), "placed")
    slots = ranked(placed, ["shard"], ["__deal"], [F.col(doc_id)], "slot")
    return slots.withColumn("slot", F.col("slot") - 1).drop("__deal", "__old")


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size (UTF-8 bytes and 1, null none) and text_crc32 (unsigned; null as empty)."""
    return docs.withColumns({"size": (F.octet_length(text_of(text)) + 1).cast("long"), "text_crc32": F.crc32(text_of(text).cast("binary")).cast("long")})


def write_affected(placed: DataFrame, path: str, old: str = "old_shard") -> DataFrame:
    """Write the shards that lost or gained rows, each to a folder shard=N; returns (shard, rows).

    Shards whose rows all stayed and that got no other keep their files.  ``path`` must not exist, as
    for any Spark writer.  Rows without an old shard have moved; an empty table writes no shard.
    """
    moved = placed.filter(~F.col(old).eqNullSafe(F.col("shard")))
    touched = [r[0] for r in moved.select(F.explode(F.array(F.col(old).cast("int"), "shard")).alias("s")).distinct().collect() if r[0] is not None]
    out = placed.filter(F.col("shard").isin(touched)) if touched else placed.limit(0)
    out.write.partitionBy("shard").parquet(path)
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
