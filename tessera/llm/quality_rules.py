"""Quality rules: the contract's base counts, and robust multivariate outliers by minimum covariance determinant.

Every document gives a vector of transformed statistics. For each language and source, and for each language, a robust
centre and scatter are found by concentration steps over all rows: keep the half of the rows that are nearest by
Mahalanobis distance, take their mean and covariance, and repeat until the determinant, which falls with each step, stops
falling. Two steps are made from each of several starts, and the one of least determinant goes on. Rows whose distances
are within 0.3 percent of the half's edge enter by the share that fills it. A factor makes the covariance of the half that
of all rows, if they are normal. A language and source is judged by its own estimates and those of its language, mixed by
its number of rows against ``prior`` ones. Rows whose distance is beyond the cutoff are rejected.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null language or source is a
group of its own; a group of which no row passes the base rules needs no estimates; repeated rows are judged each for
itself; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Lists, carried, fields, kind, map_rows, materialize, named, others

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The judged vector; each statistic is near normal for prose, with a floor under its spread as many are 0 for most rows.
STATS = {"word_length": 0.25, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.20, "upper": 0.08, "distinct": 0.08}

#: A determinant that falls by no larger share of itself has stopped falling.
FALL = 1e-4
#: Distances are cut at bins, so many to a doubling: rows are counted by bin, and those of the half's last bin enter by share.
BINS = 256
#: Concentration steps that are made from each start.
TRIAL_STEPS = 2
Params = dict[str, tuple[np.ndarray, np.ndarray]]


def n_repeat_words(words: list[bytes]) -> int:
    """Words that lie in an eight-word window found twice or more in the text, the first find included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (seq[j : j + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The contract's counts, then the transformed statistics."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOLS.findall(text)), 0, 0), (0.0,) * len(STATS)
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(text) - blanks
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    repeats = n_repeat_words(words)
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text)) if upper > 0.1 * chars else chars
    # A text of n words has about n ** 0.8 different ones; the share beyond that is what repetition costs, whatever n.
    distinct = min(1.0, len(set(words)) / n ** 0.8)
    stats = (np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dups / len(lines)), np.sqrt(repeats / n), np.sqrt(upper / max(1, letters)), distinct)
    return (n, chars, symbols, dups, repeats), tuple(map(float, stats))


def _measure(rows: Lists) -> dict[str, list]:
    made = [measure(x or "") for x in rows["_text"]]
    return {k: [c[i] for c, _ in made] for i, k in enumerate(COUNTS)} | {k: [s[i] for _, s in made] for i, k in enumerate(STATS)}


def half(n: int) -> int:
    """Rows that enter the estimates of ``n`` rows: the fewest that outvote all others."""
    return min(n, (n + len(STATS) + 1) // 2)


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all."""
    k = len(STATS)  # an even number, for which the chi-square distribution is a finite sum
    below = lambda x, dims: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))
    low, high = 0.0, 200.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid, k) < share else (low, mid)
    return share / below(high, k + 2)


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Short batches, joined to longer ones."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _groups(rows: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """The statistics of each group's rows: those of a language and source, and those of a language."""
    x = np.stack([rows.column(c).to_numpy() for c in STATS], axis=1)
    for column, kind_ in (("_group", "group "), ("_lang", "lang ")):
        codes = rows.column(column).combine_chunks().dictionary_encode()
        at = codes.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(codes.dictionary) + 1))
        for i, name in enumerate(codes.dictionary.to_pylist()):
            yield kind_ + name, x[order[ends[i] : ends[i + 1]]]


def _bins(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    apart = x - mean
    return np.floor(np.log2(np.maximum(((apart @ inverse) * apart).sum(axis=1), 0) + 1e-9) * BINS).astype(np.int32)


def _distance(params: Params, spark, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with ``_d2``, the squared Mahalanobis distance by the parameters (centre, inverse scatter) of the row's group."""
    names = list(STATS)
    k = len(names)
    pairs = list(combinations_with_replacement(range(k), 2))
    frame = spark.createDataFrame(pa.table({
        "_by": pa.array(params, pa.string()),
        "_mean": pa.array([mean.tolist() for mean, _ in params.values()], pa.list_(pa.float64())),
        "_inv": pa.array([[float(inv[i, j]) * (1 if i == j else 2) for i, j in pairs] for _, inv in params.values()], pa.list_(pa.float64())),
    }))
    diff = [F.col(names[i]) - F.col("_mean")[i] for i in range(k)]
    d2: Column = sum((F.col("_inv")[x] * diff[i] * diff[j] for x, (i, j) in enumerate(pairs)), F.lit(0.0))
    return rows.join(F.broadcast(frame), "_by", how).withColumn("_d2", d2).drop("_mean", "_inv")


def _step(passed: DataFrame, params: dict[str, Params], sizes: dict[str, int]) -> dict[tuple[str, str], tuple[float, np.ndarray, np.ndarray]]:
    """One concentration step from each (centre, inverse scatter) of each group: log determinant, centre and scatter of the nearest half.

    Two passes over the rows: they are counted by bin of distance, and the half's are summed up, by task first."""
    spark = passed.sparkSession
    held = spark.sparkContext.broadcast(params)
    names = list(STATS)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    left, right = np.array(pairs).T

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, int], int] = {}
        for rows in _chunks(batches):
            for g, x in _groups(rows):
                for start, (mean, inverse) in held.value.get(g, {}).items():
                    for k, n in zip(*(v.tolist() for v in np.unique(_bins(x, mean, inverse), return_counts=True))):
                        found[g, start, k] = found.get((g, start, k), 0) + n
        by, start, at = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(by, pa.string()), pa.array(start, pa.string()), pa.array(at, pa.int32()), pa.array(found.values(), pa.int64())], names=["_by", "_start", "_bin", "n"])

    key = ["_by", "_start"]
    counts = passed.mapInArrow(count, "_by string, _start string, _bin int, n long").groupBy(*key, "_bin").agg(F.sum("n").alias("n"))
    halves = F.broadcast(spark.createDataFrame(pa.table({"_by": pa.array(params, pa.string()), "_half": pa.array([half(sizes[g]) for g in params], pa.int64())})))
    upto = counts.withColumn("_upto", F.sum("n").over(W.partitionBy(*key).orderBy("_bin"))).join(halves, "_by")
    cuts = {(r["_by"], r["_start"]): r["cut"] for r in upto.where("_upto >= _half").groupBy(*key).agg(F.min("_bin").alias("cut")).collect()}
    cut = spark.sparkContext.broadcast(cuts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, bool], np.ndarray] = {}
        for rows in _chunks(batches):
            for g, x in _groups(rows):
                for start, (mean, inverse) in held.value.get(g, {}).items():
                    at, edge = _bins(x, mean, inverse), cut.value[g, start]
                    for on, own in ((False, x[at < edge]), (True, x[at == edge])):
                        sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[left, right]])
                        found[g, start, on] = found.get((g, start, on), 0) + sums
        by, start, on = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(by, pa.string()), pa.array(start, pa.string()), pa.array(on, pa.bool_()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.float64()))], names=["_by", "_start", "_edge", "s"])

    sums = passed.mapInArrow(add, "_by string, _start string, _edge boolean, s array<double>").groupBy(*key, "_edge").agg(*[F.sum(F.col("s")[i]) for i in range(1 + len(names) + len(pairs))])
    parts: dict[tuple[str, str], dict[bool, np.ndarray]] = {}
    for r in sums.collect():
        parts.setdefault((r[0], r[1]), {})[r[2]] = np.array(r[3:])
    floors, out = np.diag(np.array(list(STATS.values())) ** 2), {}
    for k, part in parts.items():
        inner, edge, most = part[False], part[True], half(sizes[k[0]])
        n, *rest = inner + edge * min(1.0, max(0.0, most - inner[0]) / max(1.0, edge[0]))
        mean, cov = np.array(rest[: len(names)]) / n, np.zeros((len(names),) * 2)
        for (i, j), x in zip(pairs, rest[len(names) :]):
            cov[i, j] = cov[j, i] = x / n - mean[i] * mean[j]
        scatter = cov * consistency(most / sizes[k[0]]) + floors
        out[k] = (float(np.linalg.slogdet(scatter)[1]), mean, scatter)
    return out


def _starts(passed: DataFrame) -> dict[str, Params]:
    """Starts of each group: its medians with the floors, and with its quartiles' spread; its lower and its upper quartiles."""
    floors = np.array(list(STATS.values()))
    fit = passed.withColumn("_by", F.explode(F.array(F.concat(F.lit("group "), "_group"), F.concat(F.lit("lang "), "_lang"))))
    out = {}
    for r in fit.groupBy("_by").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in STATS]).collect():
        low, mid, high = np.array([r[c] for c in STATS]).T
        narrow = np.diag(1 / floors**2)
        out[r["_by"]] = {"0": (mid, narrow), "1": (mid, np.diag(1 / (floors**2 + ((high - low) / 1.349) ** 2))), "2": (low, narrow), "3": (high, narrow)}
    return out


def estimate(passed: DataFrame, sizes: dict[str, int]) -> Params:
    """Minimum covariance determinant of each group of ``sizes`` ("group " or "lang " and its name): centre and scatter, from the best of several starts."""
    turned = lambda made: {k: (mean, np.linalg.inv(scatter)) for k, (_, mean, scatter) in made.items()}
    params = _starts(passed)
    if not params:
        return {}
    for _ in range(TRIAL_STEPS):
        tried = _step(passed, params, sizes)
        params = {}
        for (g, start), p in turned(tried).items():
            params.setdefault(g, {})[start] = p
    best = {g: min((tried[g, start] for start in sorted(own)), key=lambda x: x[0]) for g, own in params.items()}
    falling = set(best)
    while falling:
        made = {g: x for (g, _), x in _step(passed, {g: {"": p} for g, p in turned({g: best[g] for g in falling}).items()}, sizes).items()}
        falling = {g for g, x in made.items() if x[0] < best[g][0] - FALL}
        best |= {g: x for g, x in made.items() if x[0] < best[g][0]}
    return {g: (mean, scatter) for g, (_, mean, scatter) in best.items()}


def mixed(own: tuple[np.ndarray, np.ndarray], lang: tuple[np.ndarray, np.ndarray], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of a mixture of two groups."""
    apart = own[0] - lang[0]
    return weight * own[0] + (1 - weight) * lang[0], weight * own[1] + (1 - weight) * lang[1] + weight * (1 - weight) * np.outer(apart, apart)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, the counts, ``base_failed``, ``distance2`` and ``kept``; options are those of ``verdicts``."""
    rows = verdicts(docs, id_col, text_col, lang_col, source_col, **options)
    return rows.select(F.col("_doc").alias("doc_id"), *COUNTS, "base_failed", F.col("_d2").alias("distance2"), "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they were."""
    carry = others(docs, text_col)
    rows = verdicts(docs, id_col, text_col, lang_col, source_col, carry=carry, with_text=True, **options).where("kept")
    own = {c: F.col(f"_c_{i}") for i, c in enumerate(carry)}
    return rows.select(*[own.get(c, F.col("_text")).alias(c) for c in docs.columns])


def verdicts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: tuple[str, ...] = (), with_text: bool = False, cutoff: float = 25.0, prior: int = 30) -> DataFrame:
    """Counts, distance and verdict of each row, with carried columns.

    ``cutoff`` bounds the squared distance that is kept: the chi-square quantile of 0.9997 for six statistics. ``prior``
    is what a language's estimates weigh in each of its sources, in rows. Plan: one scan writes a short vector for each
    row to the shared folder; every step reads those vectors twice and sums them up in each task before its shuffle. The
    driver holds one mean and matrix for each language and source."""
    spark = docs.sparkSession
    group = F.to_json(F.struct(named(lang_col).cast("string").alias("l"), named(source_col).cast("string").alias("s")))
    lang = F.to_json(F.struct(named(lang_col).cast("string").alias("l")))
    extra, types = carried(docs, carry)
    read = docs.select(named(id_col).alias("_doc"), named(text_col).cast("string").alias("_text"), group.alias("_group"), lang.alias("_lang"), *extra)
    kinds = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in STATS)
    measured = map_rows(read, _measure, fields(("_doc", kind(docs, id_col)), "_text string, _group string, _lang string", kinds, *types))
    rows = materialize(measured if with_text else measured.drop("_text"), "quality")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    passed = rows.where(~F.col("base_failed")).select("_group", "_lang", *STATS)
    groups = passed.groupBy("_group", "_lang").agg(F.count("*").alias("n")).collect()
    sizes: dict[str, int] = {}
    for r in groups:
        sizes["group " + r["_group"]] = r["n"]
        sizes["lang " + r["_lang"]] = sizes.get("lang " + r["_lang"], 0) + r["n"]
    found = estimate(passed, sizes)
    params = {}
    for r in groups:
        mean, scatter = mixed(found["group " + r["_group"]], found["lang " + r["_lang"]], r["n"] / (r["n"] + prior))
        params[r["_group"]] = (mean, np.linalg.inv(scatter))
    judged = _distance(params, spark, rows.withColumn("_by", F.col("_group")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("_d2") <= cutoff, F.lit(False)))
