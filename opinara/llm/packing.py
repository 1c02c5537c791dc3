"""Best-fit packing into sequences of several permitted lengths.

Only lengths move.  Documents longer than the largest capacity are cut into pieces of it;
pieces are dealt by hash into shards of about ``SHARD`` pieces.  A shard packs its pieces from the
longest on: each goes to the open bin with the least room that takes it, and where none does a
new bin is opened at the capacity that costs least per unit of what is still to come for it.  That
is weighed against opening no bin below a given capacity, for each of them; the plan whose bins,
downsized to their contents, cost least in all is taken.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its length, attention in proportion to its square, and a constant.
ATTENTION, PER_SEQUENCE = 1 / 65536, 8
SHARD = 50_000


def cost(capacity: int) -> float:
    return PER_SEQUENCE + capacity + ATTENTION * capacity**2


def length_in_words(text: Column) -> Column:
    """Words of a text and one for the end mark; null and empty texts have length 1."""
    return (F.coalesce(F.regexp_count(text, F.lit("[^\\x09-\\x0D\\x20]+")), F.lit(0)) + 1).cast("int")


def best_fit(lengths: Counter, opened: Callable[[int, int, int], int]) -> list[list[int]]:
    """Bins of pieces, packed from the longest on; of open bins with equal room the earliest takes a piece.

    ``opened(n, more, room)`` is the size of a new bin for a piece of length ``n``, where ``more``
    pieces of that length follow and the open bins have ``room`` left in all.
    """
    bins: list[list[int]] = []
    rooms, by_room, free = [], {}, 0  # distinct rooms in order, and a heap of bins for each
    for n in sorted((n for n, c in lengths.items() if c > 0), reverse=True):
        for more in range(lengths[n] - 1, -1, -1):
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                taken = heapq.heappop(by_room[room])
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, taken = opened(n, more, free), len(bins)
                bins.append([])
                free += room
            bins[taken].append(n)
            free -= n
            room -= n
            if room:
                if room not in by_room:
                    by_room[room] = []
                    rooms.insert(bisect_left(rooms, room), room)
                heapq.heappush(by_room[room], taken)
    return bins


def _least_cost(lengths: Counter, capacities: tuple[int, ...]) -> Callable[[int, int, int], int]:
    """The size of a new bin that costs least per unit, if what fits and finds no room elsewhere goes there."""
    order = sorted(n for n, c in lengths.items() if c > 0)
    mass = [0, *accumulate(n * lengths[n] for n in order)]

    def opened(n: int, more: int, room: int) -> int:
        def rate(size: int) -> float:
            spare = size - n
            to_come = mass[bisect_right(order, min(spare, n - 1))] + (n * more if spare >= n else 0)
            filled = n + min(spare, max(0, to_come - room))
            return cost(capacities[bisect_left(capacities, filled)]) / filled
        return min(capacities[bisect_left(capacities, n):], key=rate)
    return opened


def _at_least(floor: int, capacities: tuple[int, ...]) -> Callable[[int, int, int], int]:
    return lambda n, more, room: capacities[bisect_left(capacities, max(n, floor))]


def plan(lengths: Counter, capacities: tuple[int, ...]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """``(capacity, bins, [(length, pieces)])`` patterns that use up a histogram of piece lengths, in order of opening."""
    best = None
    for opened in [_least_cost(lengths, capacities), *(_at_least(c, capacities) for c in capacities)]:
        bins = best_fit(lengths, opened)
        sizes = [capacities[bisect_left(capacities, sum(b))] for b in bins]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = (total, sizes, bins)
    _, sizes, bins = best
    return [(size, len(list(same)), [(n, len(list(g))) for n, g in groupby(pieces)])
            for (size, pieces), same in groupby(zip(sizes, bins))]


def _pack(capacities: tuple[int, ...]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ignore_index=True)
        first = rows.groupby("length").apply(lambda g: g.index[0], include_groups=False).to_dict()
        taken, bins, sizes, offsets = [], [], [], []
        number = int(rows["shard"].iloc[0]) << 32
        for size, times, pieces in plan(Counter(rows["length"].tolist()), capacities):
            for _ in range(times):
                offset = 0
                for n, k in pieces:
                    taken.extend(range(first[n], first[n] + k))
                    bins.extend([number] * k)
                    sizes.extend([size] * k)
                    offsets.extend(range(offset, offset + n * k, n))
                    first[n] += k
                    offset += n * k
                number += 1
        out = rows.iloc[taken][["doc_id", "piece", "start", "length"]].reset_index(drop=True)
        return out.assign(bin_id=bins, capacity=sizes, offset=offsets)
    return run


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, bin_id, capacity, offset)``.

    ``length`` is a column of positive lengths (null or less than 1 counts as 1), by default the
    words of ``text`` and an end mark.  Piece ``k`` of a document starts at ``k`` times the
    largest capacity.  Every piece lies in exactly one bin, bins are never overfull and no
    smaller permitted capacity would hold their contents.  Rows are packed one by one, so
    repeated and null ids keep their rows; other columns are ignored; no rows give no bins.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    size = F.greatest(F.coalesce(length if length is not None else length_in_words(F.col("text")), F.lit(1)), F.lit(1))
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("n"))
    pieces = saved(lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))))
                   .select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"),
                           F.least(F.col("n") - F.col("piece") * most, F.lit(most)).cast("int").alias("length")), "pieces")
    shards = max(1, -(-pieces.count() // SHARD))
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(
        _pack(capacities), "doc_id long, piece int, start long, length int, bin_id long, capacity int, offset int")
