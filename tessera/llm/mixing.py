"""Mixing sources to target weights.

The words of each source, its documents in hashed order, are packed into blocks of fixed length. Targets fix how many
block slots each source has in the mix. Slots are dealt to output shards by multinomial draws of source counts, made
from the top of a binary tree over the shards and conditioned on the totals: a shard finds its own counts, and the
numbers of its slots within each source, by one path of draws from seeds, and no list of shards exists anywhere. A
slot's number goes through its source's pseudorandom permutation of block numbers, another one for every repeat of the
source, and blocks are joined to slots by index.

Defined results: a null text has size 0 and is taken 0 times; a null source is one more source and comes last; a source
without words has target 0; rows that repeat a doc_id are each counted; an empty table gives an empty result; other
columns are ignored, whatever their names. Results depend on ids, texts and sources only, so reruns agree.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Lists, carried, fields, kind, map_rows, materialize, named, others

BLOCK, SHARD, REPEATS = 64, 4096, 3
#: The sources' weights in turn, by code point, null last.
WEIGHTS = (1, 2, 3)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Words of each source in a mix of the same size: by weight, none above ``repeats`` times its size, the excess reshared."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(sum(sizes))
    while free:
        unit = rest / sum(own[i] for i in free)
        over = {i for i in free if unit * own[i] > repeats * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * own[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            rest -= out[i]
        free -= over
    return out


def slots(sizes: list[int], wanted: list[float], block: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and slots of each source; a last block that is short is allowed for by the mean length."""
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    count = np.array([round(t * b / n) if n else 0 for t, b, n in zip(wanted, blocks, sizes)], np.int64)
    return blocks, np.minimum(count, repeats * blocks)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn of ``good + bad`` without replacement, by inversion; totals may have any size.

    Probabilities are summed over twelve standard deviations on either side of the mean; what lies beyond is below
    the resolution of a double."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = float(good + bad)
    mean = n * (good / total)
    reach = 12 * (mean * (bad / total) * ((total - n) / max(1.0, total - 1))) ** 0.5 + 12
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1)))])
    below = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


@lru_cache(maxsize=4096)
def _draw(counts: tuple[int, ...], n: int, seed: tuple[int, ...]) -> tuple[int, ...]:
    """Source counts of ``n`` slots out of ``counts``, one source after the other; shards share the draws above them."""
    rng, rest, out = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))), sum(counts), []
    for c in counts:
        out.append(hypergeometric(rng, c, rest - c, n))
        rest, n = rest - c, n - out[-1]
    return tuple(out)


def shard_counts(shard: int, counts: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot number in each source, and slots of each source, of one shard."""
    lo, hi = 0, max(1, -(-int(counts.sum()) // size))
    first, here = np.zeros(len(counts), np.int64), counts.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.array(_draw(tuple(here.tolist()), min((mid - lo) * size, int(here.sum())), (seed, lo, hi)), np.int64)
        if shard < mid:
            here, hi = left, mid
        else:
            first, here, lo = first + left, here - left, mid
    return first, here


def permute(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a Feistel network on the next even number of bits, walked until it is below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = at.astype(np.uint64).copy(), np.arange(len(at))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(4):
            h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _layout(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...], with_text: bool) -> DataFrame:
    """In the shared folder: row, id, source, size in words, carried columns."""
    read = docs.select(named(id_col).alias("_doc"), named(source_col).cast("string").alias("_source"), named(text_col).cast("string").alias("_text"), *carried(docs, carry)[0])
    sized = read.withColumn("_size", F.coalesce(F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")).withColumn("_hash", F.xxhash64("_doc", "_text")).withColumn("_row", F.monotonically_increasing_id())
    return materialize(sized if with_text else sized.drop("_text"), "mix")


def plan(rows: DataFrame, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sources, taken): one row per source with size and target; one per row, repeat and taken block range.

    Sources come to the driver, one row each. Places within a source are sums over range partitions: only the partitions'
    totals are summed in one order, one row for each source in each partition."""
    spark = rows.sparkSession
    found = sorted(((r["_source"] is None, r["_source"] or "", int(r["n"])) for r in rows.groupBy("_source").agg(F.sum("_size").alias("n")).collect()))
    sizes = [n for _, _, n in found]
    wanted = targets(sizes, repeats)
    blocks, counts = slots(sizes, wanted, block, repeats)
    sources = spark.createDataFrame(pa.table({
        "_source": pa.array([None if none else name for none, name, _ in found], pa.string()), "_s": pa.array(range(len(found)), pa.int32()),
        "source_size": pa.array(sizes, pa.int64()), "target": pa.array(wanted, pa.float64()),
    }))
    keyed = rows.where("_size > 0").select("_row", "_source", "_doc", "_size", "_hash")
    keyed = keyed.join(sources.select(F.col("_source").alias("_name"), "_s"), F.col("_source").eqNullSafe(F.col("_name")))
    order = ["_s", "_hash", "_doc", "_size", "_row"]
    n = max(1, -(-rows.count() // 1_000_000))

    def local(parts):
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), {}
        for b in parts:
            s, size = b.column("_s").to_numpy(), b.column("_size").to_numpy()
            start = np.zeros(len(s), np.int64)
            for v in np.unique(s):
                own = s == v
                run = np.cumsum(size[own])
                start[own] = at.get(v, 0) + run - size[own]
                at[v] = at.get(v, 0) + int(run[-1])
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(s, pa.int32()), pa.array(size, pa.int64()), pa.array(start), pa.array(np.full(len(s), pid, np.int32))], names=["_row", "_s", "_size", "_start", "_pid"])

    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_row", "_s", "_size")
    placed = materialize(ranged.mapInArrow(local, "_row long, _s int, _size long, _start long, _pid int"), "places")
    totals = placed.groupBy("_s", "_pid").agg(F.sum("_size").alias("_all"))
    before = totals.select("_s", "_pid", F.coalesce(F.sum("_all").over(W.partitionBy("_s").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = placed.join(before, ["_s", "_pid"]).select("_row", "_s", (F.col("_start") + F.col("_before")).alias("_start"), "_size")
    pieces = placed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block)))).select(
        "_row", "_s", "_block", F.greatest(F.lit(0), F.col("_block") * block - F.col("_start")).alias("_from"), F.least("_size", (F.col("_block") + 1) * block - F.col("_start")).alias("_till"))

    def deal(part: Lists) -> dict[str, list]:
        out: dict[str, list[np.ndarray]] = {"_shard": [], "_s": [], "_repeat": [], "_block": []}
        for k in part["id"]:
            first, here = shard_counts(k, counts, shard, seed)
            for s in np.flatnonzero(here):
                at = np.arange(first[s], first[s] + here[s])
                repeat, place = at // blocks[s], at % blocks[s]
                for r in np.unique(repeat):
                    own = place[repeat == r]
                    out["_block"].append(permute(own, int(blocks[s]), seed * 1_000_003 + int(s) * 101 + int(r)))
                    for c, x in (("_shard", k), ("_s", s), ("_repeat", r)):
                        out[c].append(np.full(len(own), x, np.int64))
        return {c: np.concatenate(x) if x else [] for c, x in out.items()}

    shards = -(-int(counts.sum()) // shard) if len(counts) else 0
    dealt = map_rows(spark.range(0, shards, numPartitions=max(1, min(10_000, shards // 16))), deal, "_shard long, _s int, _repeat int, _block long")
    # Merged by force: a planner can't know how many slots a short range of shards makes, and would broadcast them.
    return sources, pieces.hint("merge").join(dealt.hint("merge"), ["_s", "_block"]).select("_row", "_repeat", "_shard", "_from", "_till")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words of it in the mix, repeats counted)."""
    rows = _layout(docs, id_col, text_col, source_col, (), False)
    sources, taken = plan(rows, block, shard, repeats, seed)
    by_row = taken.groupBy("_row").agg(F.sum(F.col("_till") - F.col("_from")).alias("taken"))
    named = rows.join(sources.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name")), "left")
    return named.join(by_row, "_row", "left").select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """The mixture in the columns of ``docs``: a row for each repeat in which blocks of a document are drawn, with the text
    of those blocks in order; the whole text, as it was, where all are drawn. A column ``n_chars`` follows the text."""
    carry = others(docs, text_col)
    types = carried(docs, carry)[1]
    rows = _layout(docs, id_col, text_col, source_col, carry, True)
    _, taken = plan(rows, block, shard, repeats, seed)
    ranges = taken.groupBy("_row", "_repeat").agg(F.sort_array(F.collect_list(F.struct("_from", "_till"))).alias("_ranges"))

    def cut(part: Lists) -> dict[str, list]:
        texts = []
        for text, size, ranges in zip(part["_text"], part["_size"], part["_ranges"]):
            if sum(r["_till"] - r["_from"] for r in ranges) == size:
                texts.append(text)
                continue
            ends = [(m.start(), m.end()) for m in WORD.finditer(text)]
            joined: list[list[int]] = []
            for r in ranges:
                if joined and joined[-1][1] == r["_from"]:
                    joined[-1][1] = r["_till"]
                else:
                    joined.append([r["_from"], r["_till"]])
            texts.append("\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in joined))
        return {"_text": texts, "_chars": [len(x) for x in texts]}

    full = rows.join(ranges, "_row").select("_text", "_size", "_ranges", *[name for name, _ in types])
    out = map_rows(full, cut, fields("_text string, _chars long", *types))
    own = dict(zip(carry, (F.col(name) for name, _ in types)))
    if "n_chars" in own:
        own["n_chars"] = F.col("_chars").cast(kind(docs, "n_chars"))
    return out.select(*[own.get(c, F.col("_text")).alias(c) for c in docs.columns])
