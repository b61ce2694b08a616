"""Filling containers of a fixed capacity, never splitting an item unless it is longer than a container.

Items are spread over partitions of a bounded number of items.  Each partition is packed by best-fit
decreasing and gets a lower bound of its bin count from dual feasible functions.  Where both agree, the
partition is *certified*: no packing of its items needs fewer bins.  Partitions with a gap give the items of
their unfilled bins into exchange groups of several partitions, which are packed anew; the result is kept
where it needs fewer bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialize


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, into the fullest bin that holds it, else into a new one.

    Bins are kept by free room, and the rooms in use are bits of one integer, so that the best bin is the
    lowest set bit from the size on.
    """
    bins = np.zeros(len(sizes), np.int64)
    rooms: dict[int, list[int]] = {}
    mask, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i] = b
        left = room - size
        rooms.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


def lower_bound(sizes: np.ndarray, capacity: int, steps: int = 32) -> int:
    """No packing needs fewer bins: the largest sum over two families of dual feasible functions.

    Thresholds k: items above ``capacity - k`` count as full, those below k as nothing.  Steps k: sizes are
    rounded down to multiples of 1/k by ``floor((k + 1) x / C) / k``, exact multiples of C/(k + 1) kept.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 1
    total, number = np.cumsum(count * x), np.cumsum(count)
    k = np.arange(capacity // 2 + 1)
    below = np.where(k > 0, total[k - 1], 0)
    value = (number[-1] - number[capacity - k]) * capacity + total[capacity - k] - below
    best = max(best, int(-(-value.max() // capacity)))
    for n in range(1, steps + 1):
        part = np.where((n + 1) * x % capacity == 0, x * n, (n + 1) * x // capacity * capacity)
        best = max(best, int(-(-int((count * part).sum()) // (n * capacity))))
    return best


def pieces(sizes: DataFrame, row_id: str, size: str, kinds: list[tuple[str, int]]) -> DataFrame:
    """Each row for each kind: whole containers a longer item fills, and the rest (or the item) to be packed.

    ``(kind, capacity, row_id, piece, first, size, whole)``; an item without size is one piece of size 0.
    """
    kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).alias("capacity")) for k, c in kinds])
    rows = sizes.select(row_id, F.coalesce(F.col(size), F.lit(0)).alias("n"), F.explode(kind).alias("k")).select(row_id, "n", "k.*")
    number = F.greatest(F.ceil(F.col("n") / F.col("capacity")).cast("int"), F.lit(1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    return rows.select(
        "kind", "capacity", row_id, "piece", first.alias("first"), F.least("capacity", F.col("n") - first).alias("size")
    ).withColumn("whole", F.col("size") == F.col("capacity"))


def pack(
    sizes: DataFrame, row_id: str, size: str, kinds: list[tuple[str, int]], per_partition: int = 20_000, fan: int = 4, rounds: int = 2
) -> tuple[DataFrame, DataFrame]:
    """``(kind, container, row_id, piece, first, size)`` of every piece, and per kind and partition
    ``(kind, part, bins, bound, round)``.

    Every row is there for every kind; sizes of a row's pieces sum to its size; no container holds more than its
    capacity.  Containers are named by round, partition and number.  Nulls and zeros are packed with size 0, an
    empty input gives empty results.  Memory: a task packs about ``per_partition`` items, in the exchange those
    of ``fan`` partitions.
    """
    items = pieces(sizes, row_id, size, kinds)
    capacity = dict(kinds)
    id_type = sizes.schema[row_id].dataType.simpleString()
    cols = ["kind", "part", row_id, "piece", "first", "size"]
    ddl = f"kind string, part long, `{row_id}` {id_type}, piece int, first int, size int, bin long, fill long, bins long, bound long"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        cap = capacity[rows["kind"].iloc[0]]
        rows = rows.sort_values([row_id, "piece"]).reset_index(drop=True)
        x = rows["size"].to_numpy(np.int64)
        new = best_fit_decreasing(x, cap)
        out = rows[cols].copy()
        out["bound"] = lower_bound(x, cap)
        if "old" in rows:  # an exchange: what the partitions had stands unless there is a better packing
            old = pd.factorize(rows["old"])[0]
            new = old if old.max() <= new.max() else new
        out["bin"], out["bins"] = new, int(new.max()) + 1
        out["fill"] = np.bincount(new, weights=x)[new].astype(np.int64)
        return out[[*cols, "bin", "fill", "bins", "bound"]]

    total = sizes.count()
    parts = max(1, -(-total // per_partition))
    loose = items.filter("not whole").withColumn("part", F.pmod(F.xxhash64(row_id), F.lit(parts)))
    now = materialize(loose.groupBy("kind", "part").applyInPandas(fit, ddl), "packed")
    whole = items.filter("whole").select("kind", F.concat(F.lit("w-"), row_id, F.lit("-"), "piece").alias("container"), row_id, "piece", "first", "size")
    done, bounds = [whole], []
    for r in range(1, rounds + 1):
        full = F.create_map(*[F.lit(v) for k, c in kinds for v in (k, int(c))])[F.col("kind")]
        open_ = (F.col("bins") > F.col("bound")) & (F.col("fill") < full)
        last = r == rounds or now.filter(open_).isEmpty()
        bounds.append(now.groupBy("kind", "part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")).withColumn("round", F.lit(r)))
        name = F.concat(F.lit(f"{r}-"), "part", F.lit("-"), "bin")
        closed = now if last else now.filter(~open_)
        done.append(closed.select("kind", name.alias("container"), row_id, "piece", "first", "size"))
        if last:
            break
        moved = now.filter(open_).select("kind", F.floor(F.col("part") / fan).alias("part"), row_id, "piece", "first", "size", F.concat("part", F.lit("-"), "bin").alias("old"))
        now = materialize(moved.groupBy("kind", "part").applyInPandas(fit, ddl), "packed")
    return _union(done), _union(bounds)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
