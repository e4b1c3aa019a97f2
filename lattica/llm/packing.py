"""Filling fixed-capacity containers with items."""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import settle

#: Windows filled, and parts packed, together in one task at least, about: each shard may leave a window partly empty.
PER_SHARD, LEAST_PARTS = 200, 512
#: Parts times windows of a shard at most, about, whatever the sizes; what differencing takes grows with it.
MOST_CELLS = 20_000_000
SHARDS_PER_TASK, MOST_TASKS = 12, 20_000
#: Shares of the smallest items held back from differencing, to fill gaps; the best one is taken shard by shard.
HELD_BACK = (0.0, 0.03, 0.2)
#: Kinds of windows that one call fills.
MOST_WINDOWS = 1000
#: Where the public tokenizers' vocabularies lie on the driver, unless the session's option says otherwise, and the one for texts in many languages.
OPTION = "spark.lattica.tokenizers"
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of documents (doc_id, text), in tokens of a byte-level vocabulary in a folder of the driver, which is sent to all executors.

    folder: by default what the session's option names. Whole texts; null and empty ones have no tokens. A
    map without a shuffle.
    """
    spark = documents.sparkSession
    spark.sparkContext.addFile(os.path.join(folder or spark.conf.get(OPTION, TOKENIZERS), vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"].tolist()]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, tokens long")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp multiway differencing: the part, of k, of each item.

    Every item starts as a partial partition with one part filled. The two partitions with the greatest
    spread are merged again and again, the fullest part of one with the emptiest of the other. Only filled
    parts are kept, so memory is proportional to the items.
    """
    n = len(sizes)
    left: list[int] = []
    right: list[int] = []
    # of each partial partition: minus its spread, a serial, its filled parts' loads in falling order, and their trees of items
    heap = [(-size, i, np.array([size], dtype=np.int64), np.array([i], dtype=np.int64)) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, load, tree = heapq.heappop(heap)
        _, _, load2, tree2 = heapq.heappop(heap)
        if len(load) + len(load2) <= k:
            load, merged = np.concatenate([load, load2]), np.concatenate([tree, tree2])
        else:
            at = np.zeros(k, dtype=np.int64)
            merged = np.full(k, -1, dtype=np.int64)
            at[: len(load)] = load
            merged[: len(load)] = tree
            at[k - len(load2) :] += load2[::-1]
            tree2 = np.concatenate([np.full(k - len(tree2), -1, dtype=np.int64), tree2[::-1]])
            both = np.flatnonzero((merged >= 0) & (tree2 >= 0))
            joined = merged[both]
            merged = np.where(merged >= 0, merged, tree2)
            merged[both] = np.arange(len(left), len(left) + len(both)) + n
            left.extend(joined.tolist())
            right.extend(tree2[both].tolist())
            load = at
        order = np.argsort(-load, kind="stable")
        load, merged = load[order], merged[order]
        if len(load) == k:
            load = load - load[-1]
        heapq.heappush(heap, (-int(load[0]), serial, load, merged))
        serial += 1
    part = np.zeros(n, dtype=np.int64)
    for b, root in enumerate(heap[0][3].tolist() if heap else []):
        stack = [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                part[x] = b
            else:
                stack += (left[x - n], right[x - n])
    return part


def _relieve(sizes: np.ndarray, part: np.ndarray, load: np.ndarray, capacity: int) -> bool:
    """Swaps or moves items out of windows over capacity where another window has room; whether all fit then."""
    while True:
        over = np.flatnonzero(load > capacity)
        if not len(over):
            return True
        moved = False
        for w in over[np.argsort(-load[over])]:
            if load[w] <= capacity:
                continue
            room = capacity - load
            inside = np.flatnonzero(part == w)
            enough = inside[(sizes[inside] >= load[w] - capacity) & (sizes[inside] <= room.max())]
            if len(enough):  # one item goes where it leaves least room
                i = int(enough[np.argmin(sizes[enough])])
                to = int(np.argmin(np.where(room >= sizes[i], room, 1 << 60)))
                part[i] = to
                load[w] -= sizes[i]
                load[to] += sizes[i]
                moved = True
                continue
            best = None
            for i in inside:
                # an exchange for item j lowers this window by d and raises j's by d
                d = sizes[i] - sizes
                gain = np.where((d > 0) & (d <= room[part]) & (part != w), d, 0)
                j = int(np.argmin(np.where(gain >= load[w] - capacity, gain, 1 << 60)))
                if gain[j] < load[w] - capacity:
                    j = int(gain.argmax())
                if gain[j] > 0:
                    rest = max(0, int(load[w] - gain[j] - capacity))
                    if best is None or (rest, int(gain[j])) < best[0]:
                        best = ((rest, int(gain[j])), i, j, None)
                fits = int(np.argmin(np.where(room >= sizes[i], room, 1 << 60)))
                if room[fits] >= sizes[i] and fits != w:
                    rest = max(0, int(load[w] - sizes[i] - capacity))
                    if best is None or (rest, int(sizes[i])) < best[0]:
                        best = ((rest, int(sizes[i])), i, None, fits)
            if best is None:
                continue
            _, i, j, to = best
            to = int(part[j]) if to is None else to
            d = int(sizes[i] - (sizes[j] if j is not None else 0))
            part[i] = to
            if j is not None:
                part[j] = w
            load[w] -= d
            load[to] += d
            moved = True
        if not moved:
            return False


def _place(items: list[int], sizes: np.ndarray, part: np.ndarray, load: np.ndarray, capacity: int) -> None:
    """Puts items, the largest first, where they leave least room, else into further windows."""
    loads = load.tolist()
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        size = int(sizes[i])
        room = [(capacity - x - size, w) for w, x in enumerate(loads) if x + size <= capacity]
        if room:
            part[i] = min(room)[1]
            loads[part[i]] += size
        else:
            part[i] = len(loads)
            loads.append(size)


def _fill(sizes: np.ndarray, capacity: int, k: int, held_back: float) -> np.ndarray:
    """fill() with the smallest items, up to a share of all, held back to close the gaps that the others leave."""
    order = np.argsort(sizes, kind="stable")
    small = order[np.cumsum(sizes[order]) <= held_back * sizes.sum()]
    large = np.setdiff1d(np.arange(len(sizes)), small)
    among = differencing(sizes[large], k)
    load = np.bincount(among, weights=sizes[large], minlength=k).astype(np.int64)
    _relieve(sizes[large], among, load, capacity)
    part = np.full(len(sizes), -1, dtype=np.int64)
    part[large] = among
    out = small.tolist()
    for w in np.flatnonzero(load > capacity).tolist():
        while load[w] > capacity:
            inside = np.flatnonzero(part == w)
            enough = inside[sizes[inside] >= load[w] - capacity]
            i = int(enough[np.argmin(sizes[enough])] if len(enough) else inside[np.argmax(sizes[inside])])
            part[i] = -1
            load[w] -= sizes[i]
            out.append(i)
    _place(out, sizes, part, load, capacity)
    return np.unique(part, return_inverse=True)[1]


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none of which is larger than capacity; no window is filled beyond it.

    Differencing gives near-equal windows, as few as could hold the sum. Where some exceed the capacity,
    items are exchanged with windows that have room; where that doesn't help, the number of windows rises.
    This is tried with several shares of the smallest items held back; the fewest windows win.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    best = None
    for share in HELD_BACK:
        part = _fill(sizes, capacity, k, share)
        if best is None or part.max() < best.max():
            best = part
        if best.max() < k:
            break
    return best


def pack(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of a fixed capacity, as full as possible, for items of varying size.

    sizes: (item, size); windows: (window_name, capacity), each of which gets all items. Result: one row for
    each part of each item: (window_name, window_no, item, part, start, size). An item is cut only if it
    exceeds the capacity, then into as many full parts as it holds and a rest. window_no names a window
    within its window_name; parts without size (null and empty texts) need none and have a null window_no.
    Defined cases: of repeated items the largest size holds; null items are nothing; a null name or a null
    or non-positive capacity is no window, and more than MOST_WINDOWS windows are refused, since windows are
    parameters; empty tables yield no rows. Other columns are not read.

    Method and scale: parts are dealt at random into shards that fill about PER_SHARD windows, each of which
    is packed on its own by multiway differencing, so no task holds more, and only (item, size) is shuffled. Each shard
    leaves at most its last window partly empty: a loss of well under one window in a hundred.
    """
    item = sizes.select("item", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")).where("item is not null").groupBy("item").agg(F.max("size").alias("size"))
    item = settle(item)
    kinds = windows.select("window_name", F.col("capacity").cast("long").alias("capacity")).where("window_name is not null and capacity > 0").distinct().limit(MOST_WINDOWS + 1).collect()
    if len(kinds) > MOST_WINDOWS:
        raise ValueError(f"windows are parameters, at most {MOST_WINDOWS} of them")
    each = F.array(*[F.struct(F.lit(w["window_name"]).alias("window_name"), F.lit(w["capacity"]).alias("capacity")) for w in kinds]) if kinds else F.array().cast("array<struct<window_name:string,capacity:bigint>>")
    cut = item.select("item", "size", F.explode(each).alias("w")).select("item", "size", "w.*")
    parts = (
        cut.where("size > 0")
        .select("window_name", "capacity", "item", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / F.col("capacity")).cast("int"))).alias("part"))
        .select("window_name", "capacity", "item", "part", (F.col("part") * F.col("capacity")).alias("start"), F.least(F.col("capacity"), F.col("size") - F.col("part") * F.col("capacity")).alias("size"))
    )
    parts = settle(parts)
    # as many shards of each kind as leave PER_SHARD windows and LEAST_PARTS parts to each, but no more than MOST_CELLS parts times windows; one row a kind of window is read
    needed = parts.groupBy("window_name", "capacity").agg(F.sum("size").alias("total"), F.count("*").alias("parts")).collect()
    shards, total = F.lit(1), 0
    for r in needed:
        filled = r["total"] / r["capacity"]
        n = max(1, round(min(filled / PER_SHARD, r["parts"] / LEAST_PARTS)), math.ceil(math.sqrt(filled * r["parts"] / MOST_CELLS)))
        shards = F.when((F.col("window_name") == r["window_name"]) & (F.col("capacity") == r["capacity"]), n).otherwise(shards)
        total += n
    # a shard weighs few bytes but much time, so their number, not their size, says how many tasks there are
    tasks = max(1, min(total, max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total // SHARDS_PER_TASK, MOST_TASKS))))
    kind = sizes.schema["item"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "part"], kind="stable")
        capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        size = pdf["size"].to_numpy()
        part_full = size == capacity
        window = np.zeros(len(pdf), dtype=np.int64)
        n_full = int(part_full.sum())
        window[part_full] = np.arange(n_full)
        window[~part_full] = n_full + fill(size[~part_full], capacity)
        pdf["window_no"] = window + shard * (1 << 24)
        return pdf[["window_name", "window_no", "item", "part", "start", "size"]]

    packed = (
        parts.withColumn("shard", F.pmod(F.xxhash64("item", "part"), shards))
        .repartition(tasks, "window_name", "capacity", "shard")
        .groupBy("window_name", "capacity", "shard")
        .applyInPandas(run, f"window_name string, window_no long, item {kind}, part int, start long, size long")
    )
    nothing = cut.where("size <= 0").select("window_name", F.lit(None).cast("long").alias("window_no"), "item", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"))
    return packed.unionByName(nothing)
