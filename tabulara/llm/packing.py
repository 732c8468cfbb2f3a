"""Filling containers of fixed capacity with texts, by a swap-based local search.

A text longer than the capacity is cut into full parts, which are containers by themselves, and a rest; every other text stays whole. The items of a capacity are dealt evenly, by a hash of their row,
to shards of about SHARD_ITEMS: a shard is packed by one task, and what sharding can cost is less than one container a shard. In a shard the items first lie as they come, in an order fixed by chance, each in the last container or a new
one. Then a local search over the underfull containers, emptiest first, moves an item to a fuller container or exchanges one for one or one for two with it, whichever leaves the least room there; each step
raises the sum of squared fills, so that containers empty, and the search ends when no step is left.

Nulls and edge cases: null and empty texts have no tokens and lie, with 0 tokens, in the shard's first container; a row stands for itself, so repeated rows and repeated doc_ids are packed each; ties are
settled by row; capacities below 1 or null are left out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulara.session import cut, ship_code

#: Items a shard aims at. More fill better by less than a container a shard, and take longer in one task.
SHARD_ITEMS = 20_000


class _Bins:
    """Containers of one shard. `reach` finds the one that an item fills best: a container with room r that can give back items of sum s (none, one or two of them) takes an item of up to s + r, its reach."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill, self.sums = capacity, [], [], []
        self.reach: dict[int, dict[int, dict[tuple[int, int], set[int]]]] = {}  # reach -> sum given back -> (items, less of the largest) -> containers
        self.reached = 0  # bit k: reach k is there

    def start(self, items: list[tuple[int, int]]) -> None:
        """Fills containers with (size, row) as they come."""
        for item in items:
            if not self.fill or self.fill[-1] + item[0] > self.capacity:
                self.items.append([])
                self.fill.append(0)
                self.sums.append(())
            self.items[-1].append(item)
            self.fill[-1] += item[0]
        for b, inside in enumerate(self.items):
            inside.sort()
            self.index(b)

    def _rank(self, b: int) -> tuple[int, int]:
        return len(self.items[b]), -self.items[b][-1][0]

    def index(self, b: int) -> None:
        """Enters an underfull container."""
        room = self.capacity - self.fill[b]
        if not room or not self.fill[b]:
            return
        inside = [x for x, _ in self.items[b]]
        sizes = sorted(set(inside))  # at most the root of twice the capacity, so pairs of them are at most the capacity
        self.sums[b] = {0, *sizes, *map(sum, combinations(sizes, 2)), *(2 * x for x, y in zip(inside, inside[1:], strict=False) if x == y)}
        rank = self._rank(b)
        for s in self.sums[b]:
            k = s + room
            if k not in self.reach:
                self.reach[k] = {}
                self.reached |= 1 << k
            self.reach[k].setdefault(s, {}).setdefault(rank, set()).add(b)

    def unindex(self, b: int) -> None:
        room, rank = self.capacity - self.fill[b], self._rank(b)
        for s in self.sums[b]:
            by_sum = self.reach[s + room]
            by_rank = by_sum[s]
            by_rank[rank].discard(b)
            if not by_rank[rank]:
                del by_rank[rank]
                if not by_rank:
                    del by_sum[s]
                    if not by_sum:
                        del self.reach[s + room]
                        self.reached &= ~(1 << s + room)
        self.sums[b] = ()

    def best(self, a: int, size: int, most: int) -> tuple[int, int] | None:
        """(container other than a, sum it gives back) that `size` leaves least room in, then for the least sum, the fewest items and the largest item. most: the largest room."""
        reached, k = self.reached >> size, size - 1
        while reached:
            step = (reached & -reached).bit_length()
            reached, k = reached >> step, k + step
            if k - size >= most:
                break
            by_sum = self.reach[k]
            for s in sorted(s for s in by_sum if s < size):
                by_rank = by_sum[s]
                for rank in [min(by_rank)] if len(by_rank) == 1 else sorted(by_rank):
                    for b in by_rank[rank]:
                        if b != a:
                            return b, s
        return None

    def _taken(self, b: int, total: int) -> list[tuple[int, int]]:
        """Takes none, one or two items of this sum out of b."""
        if not total:
            return []
        inside = self.items[b]
        i = bisect_left(inside, (total, -1))
        if i < len(inside) and inside[i][0] == total:
            return [inside.pop(i)]
        lo, hi = 0, len(inside) - 1
        while inside[lo][0] + inside[hi][0] != total:
            if inside[lo][0] + inside[hi][0] < total:
                lo += 1
            else:
                hi -= 1
        return [inside.pop(hi), inside.pop(lo)]

    def exchange(self, a: int, b: int, item: tuple[int, int], back: int) -> None:
        self.unindex(a)
        self.unindex(b)
        self.items[a].remove(item)
        for x in self._taken(b, back):
            insort(self.items[a], x)
        insort(self.items[b], item)
        self.fill[a] -= item[0] - back
        self.fill[b] += item[0] - back
        self.index(a)
        self.index(b)


def _step(bins: _Bins, a: int, most: int) -> bool:
    """Makes container a emptier in favour of a fuller one, its largest item first, if that raises the sum of squared fills."""
    last = 0
    for item in reversed(bins.items[a]):
        if item[0] == last:
            continue
        last = item[0]
        found = bins.best(a, item[0], most)
        if found and bins.fill[found[0]] + item[0] - found[1] > bins.fill[a]:
            bins.exchange(a, found[0], item, found[1])
            return True
    return False


def search(bins: _Bins) -> None:
    """Steps until none is left: each sweep takes every underfull container as donor, the emptiest first."""
    changed = True
    while changed:
        changed = False
        under = sorted((b for b, f in enumerate(bins.fill) if 0 < f < bins.capacity), key=bins.fill.__getitem__)
        most = bins.capacity - bins.fill[under[0]] if under else 0
        for a in under:
            while 0 < bins.fill[a] < bins.capacity and _step(bins, a, most):
                changed, most = True, max(most, bins.capacity - bins.fill[a])


def pack_items(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The container of each item (sizes from 0 to capacity), numbered from 0 without gaps, and the one it began in."""
    bins = _Bins(capacity)
    bins.start([(s, i) for i, s in enumerate(sizes) if s])

    def places() -> list[int]:
        place = [0] * len(sizes)
        for no, b in enumerate(b for b in range(len(bins.fill)) if bins.items[b]):
            for _, i in bins.items[b]:
                place[i] = no
        return place

    before = places()
    search(bins)
    return places(), before


def fill_containers(sizes: DataFrame, capacities: DataFrame, started: bool = False) -> DataFrame:
    """sizes: doc_id, n_tokens; capacities: capacity_id, max_tokens. (capacity_id, container_no, doc_id, part, first_token, n_tokens): which tokens of which row lie in which container; with started also start_no,
    the container before the search."""
    ship_code(sizes.sparkSession)
    sizes = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    limits = sorted({(r[0], r[1]) for r in capacities.select("capacity_id", "max_tokens").collect() if r[1] and r[1] > 0})  # a fixed table of container kinds
    if not limits:
        limits, sizes = [(0, 1)], sizes.limit(0)
    shards = max(1, -(-sizes.count() // SHARD_ITEMS))
    kinds = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(m).cast("int").alias("max_tokens")) for i, m in limits)))
    rows = sizes.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    items = rows.select("doc_id", "n_tokens", "row", "shard", kinds.alias("k")).select("k.*", "doc_id", "n_tokens", "row", "shard")

    def pack(table: pa.Table) -> pa.Table:
        capacity = table.column("max_tokens")[0].as_py()
        kind, shard = table.column("capacity_id")[0].as_py(), table.column("shard")[0].as_py()
        table = table.sort_by("row")
        doc = table.column("doc_id").combine_chunks()
        n = table.column("n_tokens").to_numpy()
        full, rest = n // capacity, n % capacity
        full -= (rest == 0) & (full > 0)  # a text of exactly the capacity, or the last part of a multiple of it, is an item as any other
        rest = n - full * capacity
        order = np.random.default_rng(0).permutation(len(rest))  # the search is weak where sizes arrive sorted
        place, before = np.zeros((2, len(rest)), np.int64)
        place[order], before[order] = pack_items(rest[order].tolist(), capacity)
        of = np.repeat(np.arange(len(n)), full)  # the row of each full part
        part = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)

        def numbers(place: np.ndarray) -> pa.Array:
            used = int(place.max()) + 1 if len(place) else 0
            return pa.array(np.concatenate([place, used + np.arange(len(of))]) + (np.int64(shard) << 32), pa.int64())

        number = numbers(place)
        return pa.table(
            {
                "capacity_id": pa.array(np.full(len(number), kind), pa.int32()),
                "container_no": number,
                "doc_id": pa.concat_arrays([doc, doc.take(pa.array(of))]),
                "part": pa.array(np.concatenate([full, part]), pa.int32()),
                "first_token": pa.array(np.concatenate([full * capacity, part * capacity]), pa.int64()),
                "n_tokens": pa.array(np.concatenate([rest, np.full(len(of), capacity)]), pa.int64()),
            }
            | ({"start_no": numbers(before)} if started else {})
        )

    return items.groupBy("capacity_id", "shard").applyInArrow(pack, "capacity_id int, container_no bigint, doc_id bigint, part int, first_token bigint, n_tokens bigint" + (", start_no bigint" if started else ""))


def container_fill(containers: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: n_containers, n_tokens, fill (share of the capacity used), at_least (containers that any packing needs) and, of containers with start_no, n_at_start (containers before the search)."""
    start = [F.count_distinct("start_no").alias("n_at_start")] if "start_no" in containers.columns else []
    per = containers.groupBy("capacity_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("container_no").alias("n_containers"), F.count("*").alias("n_parts"), *start)
    found = per.join(capacities.select("capacity_id", "max_tokens").distinct(), "capacity_id")
    return found.select("*", F.ceil(F.col("n_tokens") / F.col("max_tokens")).alias("at_least"), F.try_divide("n_tokens", F.col("n_containers") * F.col("max_tokens")).alias("fill"))


def container_faults(containers: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: n_documents, n_over (containers beyond the capacity) and n_cut (texts in several parts though the capacity holds them whole)."""
    limits = capacities.select("capacity_id", "max_tokens").distinct()
    over = containers.groupBy("capacity_id", "container_no").agg(F.sum("n_tokens").alias("n")).join(limits, "capacity_id").groupBy("capacity_id").agg(F.count_if(F.col("n") > F.col("max_tokens")).alias("n_over"))
    texts = containers.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts")).join(limits, "capacity_id")
    return texts.groupBy("capacity_id").agg(F.count("*").alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("max_tokens"))).alias("n_cut")).join(over, "capacity_id")
