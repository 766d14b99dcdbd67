"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3. A byte's code length in a context is that of PPM with method C:
the escape probability is the number of different successors over that number plus the context's count, and what a
context has seen is excluded below it; below order 0 all 256 bytes are alike. Statistics are frozen after training, so the
code length of every byte in every kept context is one entry of a table, and a text's exact code length is a sum of table
entries. The language with the shortest code is predicted.

Bytes are those of the lower-cased text. Bytes that no language has seen share one column of the tables, as they cost the
same. A space stands before each text.

Defined results: ``und`` with score 0 for a null text, one without a letter, and if there is nothing to learn from; a
null id is never held out nor learned from; a null language is not learned; ties go to the first language by code point;
repeated rows are each predicted for themselves; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Lists, fields, kind, map_rows, named, remainder, text_or_empty

ORDER = 3
LETTER = regex.compile(r"\p{L}")
#: A text is scored in pieces of so many bytes, with the context carried over.
PIECE = 1 << 18
SPACE = 32


def data(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def grams(s: np.ndarray, size: int, base: int = 256, blank: int = SPACE) -> np.ndarray:
    """Codes of the ``size``-grams that end at each byte; blanks stand before the text."""
    padded = np.concatenate([np.full(size - 1, blank, np.int64), s])
    code = np.zeros(len(s), np.int64)
    for j in range(size):
        code = code * base + padded[j : j + len(s)]
    return code


class Model:
    """Frozen statistics: ``state`` gives for each three symbols the longest kept context, ``bits`` the code lengths there by symbol and language.

    A symbol is a byte that was seen in training, in order, or the last one for all others."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], contexts: int):
        self.langs = langs
        if not langs:
            return
        seen = np.zeros(256, bool)
        seen[SPACE] = True
        for code, _ in counts.values():
            for j in range(ORDER + 1):
                seen[code >> (8 * j) & 255] = True
        self.size = size = int(seen.sum()) + 1
        self.symbol = np.where(seen, np.cumsum(seen) - 1, size - 1).astype(np.int64)
        alike = 256 - size + 1  # bytes of the last symbol
        base = np.full(size, 1 / 256)
        base[-1] = alike / 256
        trees = []
        for lang in langs:
            raw, n = counts[lang]
            code = np.zeros(len(raw), np.int64)
            for j in range(ORDER, -1, -1):
                code = code * size + self.symbol[raw >> (8 * j) & 255]
            tree: dict[tuple[int, int], np.ndarray] = {}
            for order in range(ORDER + 1):
                at, back = np.unique(code // size % size**order, return_inverse=True)
                table = np.zeros((len(at), size))
                np.add.at(table, (back, code % size), n)
                tree |= {(order, int(c)): row for c, row in zip(at, table)}
            trees.append(tree)
        weight: dict[tuple[int, int], float] = {}
        for tree in trees:
            for key, row in tree.items():
                weight[key] = weight.get(key, 0) + row.sum()
        kept = [(0, 0)] + sorted((k for k in weight if k[0]), key=lambda k: (-weight[k], k))[: contexts - 1]
        # A context is kept only with its shorter ones, and stands after them.
        whole = {(0, 0)}
        for order, code in sorted(kept):
            if not order or (order - 1, code % size ** (order - 1)) in whole:
                whole.add((order, code))
        ordered = sorted(whole)
        place = {k: i for i, k in enumerate(ordered)}
        self.bits = np.zeros((len(ordered), size, len(langs)), np.float32)
        for j, tree in enumerate(trees):
            p = np.zeros((len(ordered), size))
            for i, (order, code) in enumerate(ordered):
                below = p[place[order - 1, code % size ** (order - 1)]] if order else base
                row = tree.get((order, code))
                if row is None:
                    p[i] = below
                    continue
                known, n, kinds = row > 0, row.sum(), (row > 0).sum()
                rest = below[~known].sum()
                p[i] = np.where(known, row / (n + kinds), below / max(rest, 1e-300) * kinds / (n + kinds)) if rest > 0 else row / n
            p[:, -1] /= max(1, alike)
            self.bits[:, :, j] = -np.log2(np.maximum(p, 1e-300))
        self.bits = self.bits.reshape(-1, len(langs))
        self.state = np.zeros(size**ORDER, np.int32)
        for i, (order, code) in enumerate(ordered):  # longer contexts overwrite shorter ones
            if order == ORDER:
                self.state[code] = i
            elif order:
                self.state.reshape(-1, size**order)[:, code] = i

    def code_length(self, text: str) -> np.ndarray:
        s = data(text)
        total = np.zeros(len(self.langs))
        before = np.full(ORDER, self.symbol[SPACE])
        for at in range(0, len(s), PIECE):
            piece = np.concatenate([before, self.symbol[s[at : at + PIECE]]])
            before = piece[-ORDER:]
            context = (piece[:-3] * self.size + piece[1:-2]) * self.size + piece[2:-1]
            total += self.bits[self.state[context] * np.int64(self.size) + piece[ORDER:]].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str) -> tuple[str, float]:
        """The language of the shortest code, and its weight among all if each code were worth 64 characters at most."""
        if not self.langs or not LETTER.search(text):
            return "und", 0.0
        bits = self.code_length(text)
        best = int(np.argmin(bits))
        scale = min(1.0, 64 / max(1, len(text)))
        return self.langs[best], float(1 / np.exp2(np.clip((bits[best] - bits) * scale, -200, 0)).sum())


def train(rows: DataFrame, lang_col: str, text_col: str, id_col: str, per_lang: int = 1500, contexts: int = 24_000) -> Model:
    """Fit on about ``per_lang`` rows of each language, chosen by a hash of the id; the ``contexts`` of most weight in all
    languages are kept, whose tables take about 14 MB a language. Only distinct 4-grams of that sample come to the driver."""
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], {}, 1)
    share = F.create_map(*(F.lit(x) for pair in ((k, min(1.0, per_lang / n)) for k, n in sizes.items()) for x in pair))
    sample = rows.where((F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)) < share[F.col(lang_col)])

    def count(part: Lists) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "code": [], "n": []}
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part["_lang"], part["_text"]):
            by.setdefault(lang, []).append(grams(data(text), ORDER + 1))
        for lang, found in by.items():
            code, n = np.unique(np.concatenate(found), return_counts=True)
            out["lang"] += [lang] * len(code)
            out["code"] += code.tolist()
            out["n"] += n.tolist()
        return out

    made = map_rows(sample.select(F.col(lang_col).alias("_lang"), text_or_empty(text_col).alias("_text")), count, "lang string, code long, n long")
    frame = made.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = {lang: (g["code"].to_numpy(), g["n"].to_numpy(float)) for lang, g in frame.groupby("lang")}
    langs = sorted(counts)
    return Model(langs, counts, contexts)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_lang: int = 1500) -> DataFrame:
    """One row per document: doc_id, held_out (``crc32(id) mod folds = held``, never learned from), lang_pred, score.

    Plan: a count by language, a sample's 4-gram counts, then one scan without a shuffle against the broadcast tables,
    whose size is fixed by the number of kept contexts and languages."""
    spark = docs.sparkSession
    rest = remainder(id_col, folds)
    learn = docs.where((rest != held) & named(lang_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).alias("_doc"), named(lang_col).cast("string").alias("_lang"), named(text_col).alias("_text"))
    model = spark.sparkContext.broadcast(train(learn, "_lang", "_text", "_doc", per_lang))

    def run(part: Lists) -> dict[str, list]:
        made = [model.value.predict(x) for x in part["_text"]]
        return {"lang_pred": [x for x, _ in made], "score": [y for _, y in made]}

    read = docs.select(named(id_col).alias("doc_id"), F.coalesce(rest == held, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("_text"))
    return map_rows(read, run, fields(("doc_id", kind(docs, id_col)), "held_out boolean, lang_pred string, score double"))
