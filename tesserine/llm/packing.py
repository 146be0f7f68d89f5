"""Problem 8: documents of varying length in containers of fixed capacity.

Method: Martello-Toth dominance reduction, then best fit.  With a gap of g tokens
between two items a container of capacity C holds items of sizes s with
sum(s + g) <= C + g, so gaps vanish into sizes and capacity.  Items of one size
are alike: the instance of a container type is its histogram of sizes, which the
capacity bounds (C + 1 entries) however many documents there are, and only it
comes to the driver.  From the largest size down sets are fixed that dominate all
others their largest item could be in:

* the item alone, if the smallest other does not fit with it;
* the item and the largest one that fits, if they fill the container, if no two
  items fit beside it, or if no three do and that partner is at least as large as
  any two that do.

What is left is packed best fit, largest sizes first, whole groups of containers
at a time.  The plan, ranges of ranks within a size, is bounded like the
histogram.  Ranks are counted in Spark, salted within a size so that no size
forms one task; an item's container follows from its size and rank.

A document longer than the container becomes full pieces and one rest.

Defined results: blank and NULL texts are not assigned; container types of
capacity NULL or below 1 hold nothing; a NULL or negative gap counts as 0; types
listed twice count once; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a size ranked in one task, on average at most.
RANKED = 200_000


def _take(left: Counter, sizes: list[int], items: list[int], times: int) -> None:
    for s in items:
        left[s] -= times
        if not left[s]:
            del left[s]
            del sizes[bisect_left(sizes, s)]


def reduce(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], Counter]:
    """((times, sizes) of the fixed containers, histogram of what is left)."""
    left = Counter({s: n for s, n in hist.items() if n > 0})
    sizes = sorted(left)
    fixed: list[tuple[int, tuple[int, ...]]] = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            n = left[j]
            small = _smallest(left, sizes, j, 1)
            if small is None or small > room:
                _take(left, sizes, [j], n)
                fixed.append((n, (j,)))
                continue
            # The largest partner that fits; j itself only if there are two.
            at = bisect_left(sizes, room + 1) - 1
            if sizes[at] == j and n < 2:
                at -= 1
            if at < 0:
                _take(left, sizes, [j], n)
                fixed.append((n, (j,)))
                continue
            i = sizes[at]
            two, three = (_smallest(left, sizes, j, k) for k in (2, 3))
            pairs = three is None or three > room  # no more than two fit beside j
            if not (i == room or two is None or two > room or (pairs and i >= _best_two(left, sizes, j, room))):
                break
            times = n // 2 if i == j else min(n, left[i])
            _take(left, sizes, [j, j] if i == j else [j, i], times)
            fixed.append((times, (j, i)))
    return fixed, left


def _smallest(left: Counter, sizes: list[int], j: int, k: int) -> int | None:
    """Sum of the k smallest items besides one of size j, None if there are fewer."""
    got: list[int] = []
    for s in sizes:
        got += [s] * min(k - len(got), left[s] - (s == j))
        if len(got) == k:
            return sum(got)
    return None


def _best_two(left: Counter, sizes: list[int], j: int, room: int) -> int:
    """The largest sum of two other items within room, 0 if no two fit."""
    lo, hi, best = 0, bisect_left(sizes, room + 1) - 1, 0
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room:
            hi -= 1
            continue
        free = left[a] - (a == j) > (a == b) and left[b] - (b == j) > 0
        if free:
            best = max(best, a + b)
            if best == room:
                return best
        if lo == hi:
            break
        if not free and left[b] - (b == j) <= 0:
            hi -= 1
        else:
            lo += 1
    return best


def best_fit(left: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on a histogram: groups of like containers are filled
    together and split where items run out."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, n: int, items: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((n, items))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                k = capacity // s  # new containers, each filled with as many as fit
                full, rest = divmod(n, k)
                if full:
                    put(capacity - k * s, full, (s,) * k)
                if rest:
                    put(capacity - rest * s, 1, (s,) * rest)
                break
            room = rooms[at]
            m, items = groups[room].pop()
            if not groups[room]:
                del groups[room]
                del rooms[at]
            k = room // s
            if n >= m * k:
                put(room - k * s, m, items + (s,) * k)
                n -= m * k
            else:
                full, rest = divmod(n, k)
                if full:
                    put(room - k * s, full, items + (s,) * k)
                if rest:
                    put(room - rest * s, 1, items + (s,) * rest)
                if m - full - (rest > 0):
                    put(room, m - full - (rest > 0), items)
                n = 0
    return [g for room in rooms for g in groups[room]]


def plan(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((size, first rank, items of the size a container, first container), number
    of containers).  Sizes and capacity include the gap."""
    fixed, left = reduce(hist, capacity)
    rows, used, base = [], Counter(), 0
    for times, items in fixed + best_fit(left, capacity):
        for s, k in sorted(Counter(items).items()):
            rows.append((s, used[s], k, base))
            used[s] += times * k
        base += times
    return rows, base


def items(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, cap, gap, doc_id, piece, tokens) of all pieces."""
    s = (
        specs.where("capacity_tokens >= 1 and spec_id is not null")
        .groupBy("spec_id")
        .agg(F.max("capacity_tokens").cast("long").alias("cap"), F.greatest(F.max(F.coalesce("gap_tokens", F.lit(0))), F.lit(0)).cast("long").alias("gap"))
    )
    # The container types are a small given table: each document is read once for all.
    types = [(r["spec_id"], r["cap"], r["gap"]) for r in s.orderBy("spec_id").collect()]
    if not types:
        return counts.select(F.lit("").alias("spec_id"), F.lit(0).cast("long").alias("cap"), F.lit(0).cast("long").alias("gap"), "doc_id", F.lit(0).cast("long").alias("piece"), F.col("n").alias("tokens")).where("false")
    spec = F.array(*[F.struct(F.lit(a).alias("spec_id"), F.lit(b).cast("long").alias("cap"), F.lit(c).cast("long").alias("gap")) for a, b, c in types])
    each = counts.select("doc_id", "n", F.explode(spec).alias("s")).select("s.*", "doc_id", "n")
    piece = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div cap"))))
    return piece.select("spec_id", "cap", "gap", "doc_id", "piece", F.least("cap", F.col("n") - F.col("piece") * F.col("cap")).alias("tokens"))


def assign(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, tokens) of every piece."""
    salts = 32 + counts.count() // RANKED
    it = items(counts, specs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    sized = it.groupBy("spec_id", "cap", "gap", "tokens", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("spec_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = sized.select("spec_id", "tokens", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    hist = sized.groupBy("spec_id", "cap", "gap", "tokens").agg(F.sum("c").alias("c")).collect()
    by: dict[str, tuple[int, int, dict[int, int]]] = {}
    for r in hist:
        by.setdefault(r["spec_id"], (r["cap"], r["gap"], {}))[2][r["tokens"] + r["gap"]] = r["c"]
    names = sorted(by)
    code, start, per, base, width = [], [], [], [], 1 + max((c + g for c, g, _ in by.values()), default=0)
    for x, name in enumerate(names):
        cap, gap, h = by[name]
        for s, first, k, b in plan(h, cap + gap)[0]:
            code.append(x * width + s - gap)
            start.append(first)
            per.append(k)
            base.append(b)
    order = np.lexsort((start, code)) if code else np.empty(0, np.int64)
    table = tuple(np.array(v, np.int64)[order] for v in (code, start, per, base))
    index = {n: x for x, n in enumerate(names)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, start, per, base = table
        span = int(start.max()) + 2 if len(start) else 1
        # Ranks of a size start at 0 and have no gaps, so the range a rank falls in is the last that starts at or before it.
        flat = code.astype(object) * span + start if len(code) and int(code.max()) * span > 2**62 else code * span + start
        for b in batches:
            key = b["spec_id"].map(index).to_numpy(np.int64) * width + b["tokens"].to_numpy(np.int64)
            rank = b["rank"].to_numpy(np.int64)
            at = np.searchsorted(flat, key * span + np.minimum(rank, span - 1), side="right") - 1
            yield pd.DataFrame({"spec_id": b["spec_id"], "container_id": base[at] + (rank - start[at]) // per[at], "doc_id": b["doc_id"], "piece": b["piece"], "tokens": b["tokens"]})

    within = Window.partitionBy("spec_id", "tokens", "salt").orderBy("doc_id", "piece")
    ranked = (
        it.withColumn("r", F.row_number().over(within) - 1)
        .join(offset, ["spec_id", "tokens", "salt"])
        .select("spec_id", "doc_id", "piece", "tokens", (F.col("r") + F.col("offset")).cast("long").alias("rank"))
    )
    return ranked.mapInPandas(place, "spec_id string, container_id long, doc_id long, piece long, tokens long")


def summary(assigned: DataFrame, specs: DataFrame) -> DataFrame:
    """Per container type: pieces, containers, the least number that could hold
    them by volume, tokens, and the share of the capacity used."""
    box = assigned.groupBy("spec_id", "container_id").agg(F.count("*").alias("k"), F.sum("tokens").alias("tokens"))
    s = specs.where("capacity_tokens >= 1").groupBy("spec_id").agg(F.max("capacity_tokens").alias("cap"), F.greatest(F.max(F.coalesce("gap_tokens", F.lit(0))), F.lit(0)).alias("gap"))
    g = box.groupBy("spec_id").agg(F.sum("k").alias("pieces"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(F.broadcast(s), "spec_id")
    return g.select(
        "spec_id", "pieces", "containers", "tokens",
        F.ceil((F.col("tokens") + F.col("gap") * F.col("pieces")) / (F.col("cap") + F.col("gap"))).cast("long").alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("cap")), 6).alias("fill"),
    )
