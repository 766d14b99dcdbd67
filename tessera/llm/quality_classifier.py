"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: character trigrams; n-grams of the runs of character classes, with
whether they take more than 2 and 10 percent of the text's runs; and repeats of a word by the next one, likewise.
Indicators are scaled by the class log-count ratios of naive Bayes, and a linear hinge-loss model is fitted to them by
dual coordinate descent. A sigmoid over held-back margins makes scores of them.

Defined results: a null or empty text has the one feature that every text has, and gets its score; a null id is never
held out nor learned from; null labels are not learned, and of a document's several labels the least counts; with labels
of one class or none all scores are that class's (0.5 without any); repeated rows are each scored for themselves; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Lists, discard, fields, kind, map_rows, materialize, named, remainder, text_or_empty

BITS = 18
_P = np.uint32(0x9E3779B1)
SHARES = (0.02, 0.10)
PIECE = 1 << 18


def _classes() -> np.ndarray:
    """Class of a character by code point below 0x250, the last class for all above."""
    kinds = np.full(0x251, 9, np.uint32)
    for c in range(0x250):
        x = chr(c)
        kinds[c] = 0 if x.isspace() and x != "\n" else 1 if x == "\n" else 2 if x.islower() else 3 if x.isupper() else 4 if x.isdigit() else 5 if x in ".,;:'\"()-" else 6 if x in "!?" else 7 if x in "#*$%&" else 8 if x in "|<>" else 9
    kinds[0x250] = 2
    return kinds


_CLASS = _classes()


def _mix(parts: list[np.ndarray], seed: int) -> np.ndarray:
    h = np.full(len(parts[0]), seed, np.uint32)
    for p in parts:
        h = (h ^ p) * _P
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the trigrams, and of the others, of which every text has the first."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, max(0, len(c) - 2), PIECE):
        part = c[at : at + PIECE + 2]
        seen[_mix([part[:-2], part[1:-1], part[2:]], 1)] = True
    grams = np.flatnonzero(seen)
    rest = [np.array([0], np.int64)]
    if len(c):
        kind = _CLASS[np.minimum(c, 0x250)]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        length = np.minimum(np.diff(np.append(starts, len(c))), 3).astype(np.uint32)
        runs = kind[starts] * np.uint32(4) + length
        for size in (1, 2, 4):
            if len(runs) >= size:
                h, n = np.unique(_mix([runs[j : len(runs) - size + 1 + j] for j in range(size)], 10 + size), return_counts=True)
                rest.append(h)
                rest += [_mix([h[n >= share * len(runs)].astype(np.uint32)], 100 + i) for i, share in enumerate(SHARES)]
    words = text.split()
    if len(words) > 1:
        same = sum(map(str.__eq__, words, words[1:])) / (len(words) - 1)
        rest.append(_mix([np.array([i for i, x in enumerate((1e-9, 0.02, 0.1, 0.3, 0.6)) if same >= x], np.uint32)], 200))
    return grams, np.unique(np.concatenate(rest).astype(np.int64))


def vector(grams: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights before scaling; each of the two kinds has length 1, so long texts weigh as short ones do."""
    at = np.concatenate([grams, rest + (1 << BITS)])
    return at, np.concatenate([np.full(len(grams), 1 / np.sqrt(max(1, len(grams)))), np.full(len(rest), 1 / np.sqrt(len(rest)))])


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = 1.0, epochs: int = 20):
        size = 2 << BITS
        self.flat = None
        if not len(labels) or labels.min() == labels.max():
            self.flat = float(labels[0]) if len(labels) else 0.5
            return
        p, q = np.ones(size), np.ones(size)
        for (at, _), y in zip(rows, labels):
            (p if y else q)[at] += 1
        p, q = p / (labels.sum() + 2), q / ((1 - labels).sum() + 2)
        ratio = np.log(p) - np.log(q)
        scaled = [(at, x * ratio[at]) for at, x in rows]
        order = np.random.RandomState(7).permutation(len(labels))
        back = order[: max(2, len(order) // 5)]
        fit = order[len(back) :] if len(set(labels[order[len(back) :]])) > 1 else order
        sign = np.where(labels > 0, 1.0, -1.0)
        # Both classes weigh the same, whatever their sizes.
        limit = np.where(labels > 0, cost / max(1, labels[fit].sum()), cost / max(1, (1 - labels[fit]).sum())) * len(fit) / 2
        w, alpha = np.zeros(size), np.zeros(len(labels))
        square = np.array([float(x @ x) for _, x in scaled])
        draw = np.random.RandomState(11)
        for _ in range(epochs):
            for i in draw.permutation(fit):
                at, x = scaled[i]
                if square[i] > 0:
                    new = min(max(alpha[i] - (sign[i] * float(w[at] @ x) - 1) / square[i], 0.0), limit[i])
                    if new != alpha[i]:
                        w[at] += (new - alpha[i]) * sign[i] * x
                        alpha[i] = new
        margin = np.array([float(w[at] @ x) for at, x in (scaled[i] for i in back)])
        y = labels[back]
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton steps of the two-parameter logistic fit, damped
            s = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            g = np.array([((s - t) * margin).sum() + 1e-3 * (a - 1), (s - t).sum()])
            v = np.maximum(s * (1 - s), 1e-6)
            h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.weights, self.a, self.b = (w * ratio).astype(np.float64), max(float(a), 1e-3), float(b)

    def score(self, text: str) -> float:
        if self.flat is not None:
            return self.flat
        at, x = vector(*features(text))
        return float(1 / (1 + np.exp(-np.clip(self.a * float(self.weights[at] @ x) + self.b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, sample: int) -> Model:
    """Fit on about ``sample`` labelled texts outside the held-out fold, chosen by a hash of the id; where ids repeat with
    several texts, by a hash of both, so that no more come to the driver then."""
    usable = labels.select(named(id_col).alias("_id"), named(label_col).alias("_label"), remainder(id_col, folds).alias("_fold"))
    usable = usable.where((F.col("_fold") != held) & F.col("_label").isNotNull()).groupBy("_id").agg(F.min("_label").cast("int").alias("_y"))
    among = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, sample / max(1, n))))
    chosen = usable.where(among(usable.count(), "_id"))
    read = docs.select(named(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"))
    rows = materialize(read.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_y", "_text").distinct(), "labelled")

    def run(part: Lists) -> dict[str, list]:
        made = [features(x) for x in part["_text"]]
        return {"_grams": [a.astype("<i4").tobytes() for a, _ in made], "_rest": [b.astype("<i4").tobytes() for _, b in made]}

    some = rows.where(among(rows.count(), F.lit(1), "_doc", "_text"))
    got = map_rows(some, run, fields(("_doc", kind(rows, "_doc")), "_y int, _grams binary, _rest binary")).toArrow().to_pydict()
    discard(rows)
    order = sorted(range(len(got["_y"])), key=lambda i: (got["_doc"][i], got["_grams"][i], got["_rest"][i]))
    read_ids = lambda x: np.frombuffer(x, "<i4").astype(np.int64)
    return Model([vector(read_ids(got["_grams"][i]), read_ids(got["_rest"][i])) for i in order], np.array([int(got["_y"][i] > 0) for i in order], np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, sample: int = 6000, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out (``crc32(id) mod folds = held``), score, predicted.

    Plan: the sampled ids, about ``sample``, are broadcast to find their texts, of which as many are fitted; then one scan
    scores every text against the broadcast weights, which have 4 MB whatever the input."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, folds, held, sample))

    def run(part: Lists) -> dict[str, list]:
        scores = [model.value.score(x) for x in part["_text"]]
        return {"score": scores, "predicted": [int(x >= threshold) for x in scores]}

    read = docs.select(named(id_col).alias("doc_id"), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("_text"))
    return map_rows(read, run, fields(("doc_id", kind(docs, id_col)), "held_out boolean, score double, predicted int"))
