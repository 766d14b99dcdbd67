"""Packing along a space-filling curve.

Each document becomes token ids and one closing id. Its hashed vector, log-damped counts of its ids scaled to length 1,
is projected to a few dimensions by a fixed pseudorandom matrix; the normal distribution function spreads each
coordinate over a grid, and the cell's place on the Hilbert curve is the document's key. Documents are range-sorted by
key, and the stream of their ids along the curve is cut into sequences, so neighbours share sequences.

Defined results: a null or empty text is the closing id alone; exact copies have one key and follow each other by id and
row; repeated rows are each packed; an empty table gives an empty result; other columns are ignored, whatever their
names. Each range partition ends with one sequence that may be short; all others are full.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Lists, fields, kind, map_rows, materialize, named, text_or_empty

DIMS, GRID_BITS = 4, 12
#: Ids of a range partition: 8 MB, more only if there would be over MAX_PARTS partitions.
PART_TOKENS, MAX_PARTS = 1 << 22, 100_000


def _file(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level BPE vocabulary.

    The rank file of the same vocabulary is several times as fast as the tokenizer file and gives its ids, for all
    characters that both libraries class alike; texts with any other character, and those that spell one of the
    tokenizer file's added tokens, which the rank file does not know, go to the tokenizer file itself."""

    def __init__(self, vocabulary: str, odd: frozenset[str] = frozenset()):
        self.vocabulary, self.fast = vocabulary, None
        ranks = os.path.splitext(_file(vocabulary))[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.odd = odd
        self.added = [x.content for x in self.slow.get_added_tokens_decoder().values()] if self.fast else []

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(_file(self.vocabulary))

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(x in text for x in self.added) and (not self.odd or self.odd.isdisjoint(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def odd_characters(vocabulary: str) -> tuple[frozenset[str], int]:
    """Characters that the two encoders cut differently, and the number of ids; the first are found by trial of blocks of characters, halved where they differ."""
    encoder = Encoder(vocabulary)
    slow, fast = encoder.slow, encoder.fast
    if fast is None:
        return frozenset(), slow.get_vocab_size()
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200))]
    say = lambda part: "".join(f"a{c}b {c}{c} 1{c}.{c}\n" for c in part)
    same = lambda part: slow.encode(say(part), add_special_tokens=False).ids == fast.encode_ordinary(say(part))
    todo, found = [chars[i : i + 4096] for i in range(0, len(chars), 4096)], []
    while todo:
        part = todo.pop()
        if same(part):
            continue
        if len(part) == 1:
            found += part
        else:
            todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    return frozenset(found), slow.get_vocab_size()


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, odd: frozenset[str]) -> Encoder:
    return Encoder(vocabulary, odd)


@lru_cache(maxsize=2)
def _projection(size: int) -> np.ndarray:
    return np.random.RandomState(1_891).standard_normal((size, DIMS))


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x.ravel()]).reshape(x.shape)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates.

    From the highest bit down, the cube that a point lies in is undone: where its bit is set the lower bits of the first
    axis are inverted, else they are exchanged with those of the axis. A Gray code of what is left gives the place."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        top, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(dims):
            is_set = (x[i] & top) > 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << b)) > 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place.astype(np.int64)


def curve_keys(docs: list[np.ndarray], size: int) -> np.ndarray:
    matrix = _projection(size)
    points = np.zeros((len(docs), DIMS))
    for k, ids in enumerate(docs):
        at, n = np.unique(ids, return_counts=True)
        v = 1 + np.log(n)
        points[k] = v @ matrix[at] / math.sqrt(float(v @ v))
    cells = np.minimum(_normal_cdf(points) * (1 << GRID_BITS), (1 << GRID_BITS) - 1).astype(np.int64)
    return hilbert(cells, GRID_BITS)


def tokenize(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """In the shared folder: row, id, number of ids, curve key and the ids, two bytes each if the vocabulary allows it."""
    odd, size = odd_characters(vocabulary)

    def run(rows: Lists) -> dict[str, list]:
        encoder = _encoder(vocabulary, odd)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        ids = [np.array([*encoder.ids(x), end_id], kind) for x in rows["_text"]]
        return {"_n": [len(x) for x in ids], "_wide": [x.itemsize for x in ids], "_key": curve_keys(ids, size), "_ids": [x.tobytes() for x in ids]}

    read = docs.select(named(id_col).alias("_doc"), text_or_empty(text_col).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    return materialize(map_rows(read, run, fields("_row long", ("_doc", kind(docs, id_col)), "_n long, _wide int, _key long, _ids binary")), "tokens")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit).

    Plan: texts are read once; ids move in one range shuffle. A sequence's number is its partition's and its own place
    in it, so no global order is needed and each task holds one batch of documents."""
    tokens = tokenize(docs, id_col, text_col, vocabulary, end_id)
    total = tokens.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = max(1, min(MAX_PARTS, -(-total // PART_TOKENS)))
    order = ["_key", "_doc", "_row"]
    id_type = kind(docs, id_col)
    kinds = pa.schema([("doc_id", _arrow(id_type)), *[(c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: dict[str, list] = {c: [] for c in kinds.names}
                for doc, n, wide, raw in zip(*(part.column(c).to_pylist() for c in ("_doc", "_n", "_wide", "_ids"))):
                    ids, start = np.frombuffer(raw, f"<u{wide}"), 0
                    while start < n:
                        take = min(n - start, length - at % length)
                        for c, x in zip(kinds.names, (doc, start, take, n, first + at // length, at % length, ids[start : start + take].astype("<u4").tobytes())):
                            out[c].append(x)
                        start += take
                        at += take
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    ranged = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_doc", "_n", "_wide", "_ids")
    return ranged.mapInArrow(cut, fields(("doc_id", id_type), "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"))


def _arrow(of) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(of)
