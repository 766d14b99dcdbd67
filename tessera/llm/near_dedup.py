"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts with equal word sequences form a class; one of each class goes on, so copies are never expanded into pairs.
2. Signatures of 128 hashes in 32 bands of 4 bring classes into buckets: at a similarity of 0.75 a pair shares no bucket
   once in 190,000 times.
3. Each bucket's members are paired with one pivot, which is found by a pre-aggregated minimum. Pairs are compared by
   batches of 32 hashes, and dropped as soon as the posterior chance of a similarity of 0.75 or more, under a uniform
   prior, is below ``miss``. Survivors are verified on their full shingle sets, and links are joined to components.
4. Members of a bucket that are still in different components are compared in blocks by the same posterior bounds, so no
   link between different texts is lost to the pivots; the batches go on over 512 more hashes, so that few pairs but
   those near the threshold are left. A bucket's largest component has blocks of its own, which meet those of other
   members only. What is left of a block is verified where its members' shingle sets meet, the most alike first; pairs of
   components that a link has joined there need no look. Sets move once for each block and member, not for each pair.

``loss`` sums the chances of a pair to fall out on the way, which are largest at a similarity of 0.75 exactly: less than
1 in 150,000 pairs.

Defined results: a null or empty text has no shingles and is linked with nothing; rows that repeat a doc_id are linked
by their texts as any others; a null doc_id never is a component's smallest, and a component of null ids only has a null
component_id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Lists, carried, discard, fields, kind, map_rows, materialize, named, others, text_or_empty

HASHES, BANDS, ROWS, BATCH, SHINGLE = 128, 32, 4, 32, 5
#: Classes whose texts are looked up by a broadcast of their row numbers; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a bucket that one task compares with as many others.
BLOCK = 4096
#: Further hashes of the members of open buckets, in batches; of each 8 bits are kept, which may only make pairs look more alike.
WIDE, WIDE_BATCH = 512, 128
#: Members of either side of a block whose sets meet in one task at once.
MEET = 512
_A = np.random.RandomState(20_011).randint(1, 2**63 - 1, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE = np.random.RandomState(20_029).randint(1, 2**63 - 1, WIDE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)
_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > 100_000:
        _words.clear()
    known, digest = _words, xxhash.xxh64_intdigest
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence, if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    size = min(SHINGLE, len(words))
    key = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        key = (key ^ h[j : j + len(key)]) * _M1
        key ^= key >> _S
    key *= _M2
    key ^= key >> _S
    return np.unique(key)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def signature(keys: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 256):
        np.minimum(low, (keys[at : at + 256, None] * _A).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def wide_signature(keys: np.ndarray) -> np.ndarray:
    low = np.full(WIDE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 64):
        np.minimum(low, (keys[at : at + 64, None] * _WIDE).min(axis=0), out=low)
    return (low >> np.uint64(56)).astype("u1")


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, ends: tuple[int, ...] = tuple(range(BATCH, HASHES + 1, BATCH))) -> tuple[int, ...]:
    """For each batch end, the fewest equal hashes at which P(similarity >= threshold | matches) is ``miss`` or more.

    With a uniform prior the posterior is a beta distribution, whose upper tail is the binomial sum below."""
    out = []
    for n in ends:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indices of the row pairs of two signature matrices that no batch rules out."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (a[alive, part] == b[alive, part]).sum(axis=1)
        alive, equal = alive[equal >= least], equal[equal >= least]
    return alive


def loss(similarity: float = 0.75, threshold: float = 0.75, miss: float = 1e-7) -> float:
    """Upper bound on the chance that a pair of this similarity is lost: by sharing no band, or below a batch's bound."""
    below = lambda n, least: sum(math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(similarity) + (n - m) * math.log1p(-similarity)) for m in range(least))
    ends = (*range(BATCH, HASHES + 1, BATCH), *range(HASHES + WIDE_BATCH, HASHES + WIDE + 1, WIDE_BATCH))
    return (1 - similarity**ROWS) ** BANDS + sum(map(below, ends, least_matches(threshold, miss, ends)))


def _mixed(numbers: list[int]) -> np.ndarray:
    """Row numbers, one to one, as numbers in no order: the least of some is a random choice among them."""
    x = np.array(numbers, np.int64).view(np.uint64) * _M1
    return ((x ^ (x >> np.uint64(32))) * _M2).view(np.int64)


def _sketch(rows: Lists) -> dict[str, list]:
    out: dict[str, list] = {"_row": _mixed(rows["_row"]), "_class": [], "_n": [], "_sig": []}
    for text in rows["_text"]:
        words = words_of(text)
        keys = shingles(words)
        out["_class"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
        out["_n"].append(len(keys))
        out["_sig"].append(signature(keys).tobytes() if words else None)
    return out


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u4").reshape(len(sigs), HASHES)


def _bands(sigs: np.ndarray) -> np.ndarray:
    """The bucket of each signature in each band."""
    m = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _M2 + np.zeros((len(m), 1), np.uint64)
    for j in range(ROWS):
        key = (key ^ m[:, :, j]) * _M1
        key ^= key >> _S
    return key.view(np.int64)


def _buckets(rows: Lists) -> dict[str, list]:
    return {"_rid": np.repeat(np.array(rows["_rid"], np.int64), BANDS), "_bucket": _bands(_matrix(rows["_sig"])).ravel()}


def _explode_buckets(classes: DataFrame) -> DataFrame:
    return map_rows(classes.select("_rid", "_sig"), _buckets, "_rid long, _bucket long")


def _bayes(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    side = lambda x: classes.select(F.col("_rid").alias(f"_{x}"), F.col("_sig").alias(f"_sig_{x}"))

    def check(rows: Lists) -> dict[str, list]:
        at = plausible(_matrix(rows["_sig_a"]), _matrix(rows["_sig_b"]), threshold, miss) if rows["_a"] else []
        return {k: [rows[k][i] for i in at] for k in ("_a", "_b")}

    return map_rows(pairs.join(side("a"), "_a").join(side("b"), "_b").select("_a", "_b", "_sig_a", "_sig_b"), check, "_a long, _b long")


def _sets(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_row, _set) of the wanted rows' texts."""
    few = wanted.count() <= BROADCAST_ROWS
    texts = base.select("_row", "_text").join(F.broadcast(wanted) if few else wanted, "_row", "left_semi")
    return materialize(map_rows(texts, lambda rows: {"_set": [shingles(words_of(x)).tobytes() for x in rows["_text"]]}, "_row long, _set binary"), "sets")


def _alike(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= threshold * union."""
    if min(len(x), len(y)) * 100 < threshold * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, base: DataFrame, threshold: int) -> DataFrame:
    """The pairs of rows whose full shingle sets have 100 * intersection >= threshold * union."""
    pairs = materialize(pairs, "pairs", narrow=True)
    wanted = materialize(pairs.select(F.col("_a").alias("_row")).union(pairs.select("_b")).distinct(), "wanted", narrow=True)
    sets = _sets(base, wanted)
    side = lambda x: sets.select(F.col("_row").alias(f"_{x}"), F.col("_set").alias(f"_set_{x}"))

    def check(rows: Lists) -> dict[str, list]:
        out: dict[str, list] = {"_a": [], "_b": []}
        for a, b, x, y in zip(rows["_a"], rows["_b"], rows["_set_a"], rows["_set_b"]):
            if _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold):
                out["_a"].append(a)
                out["_b"].append(b)
        return out

    found = materialize(map_rows(pairs.join(side("a"), "_a").join(side("b"), "_b").select("_a", "_b", "_set_a", "_set_b"), check, "_a long, _b long"), "found", narrow=True)
    discard(pairs, wanted, sets)
    return found


def components(links: DataFrame) -> DataFrame:
    """(_rid, _comp) of every row in ``links`` (_a, _b): each round maps a row to its least neighbour, numbers being random, and
    contracts the links, until none is left. Minima are pre-aggregated, so a row with many links is no hot group."""
    edges = materialize(links.select("_a", "_b").distinct(), "links", narrow=True)
    names = materialize(edges.select(F.col("_a").alias("_rid")).union(edges.select("_b")).distinct().select("_rid", F.col("_rid").alias("_comp")), "names", narrow=True)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        step = both.groupBy(F.col("_a").alias("_from")).agg(F.min("_b").alias("_to")).select("_from", F.least("_from", "_to").alias("_to"))
        step = materialize(step, "step", narrow=True)
        before, names = (edges, names), materialize(names.join(step, F.col("_comp") == F.col("_from"), "left").select("_rid", F.coalesce("_to", "_comp").alias("_comp")), "names", narrow=True)
        a, b = (step.select(F.col("_from").alias(f"_{x}"), F.col("_to").alias(f"_to_{x}")) for x in "ab")
        edges = edges.join(a, "_a").join(b, "_b").select(F.col("_to_a").alias("_a"), F.col("_to_b").alias("_b")).where("_a <> _b")
        edges = materialize(edges.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links", narrow=True)
        discard(*before, step)
    discard(edges)
    return names


def _named(buckets: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components and more than two members, with the bucket's largest component and its members in and outside of that."""
    named = buckets.join(names, "_rid", "left").withColumn("_comp", F.coalesce("_comp", "_rid"))
    sizes = named.groupBy("_bucket", "_comp").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("_bucket").agg(F.max_by("_comp", "n").alias("_top"), F.max("n").alias("_n_top"), F.sum("n").alias("all")).where("_n_top < all and all > 2")
    return named.join(open_.select("_bucket", "_top", "_n_top", (F.col("all") - F.col("_n_top")).alias("_n_rest")), "_bucket")


def _wide(opened: DataFrame, base: DataFrame) -> DataFrame:
    """(_rid, _more): the further hashes of the members of buckets that hold several components."""
    wanted = materialize(opened.select(F.col("_rid").alias("_row")).distinct(), "wanted", narrow=True)
    few = wanted.count() <= BROADCAST_ROWS
    texts = base.select("_row", "_text").join(F.broadcast(wanted) if few else wanted, "_row", "left_semi")

    def make(rows: Lists) -> dict[str, list]:
        return {"_rid": rows["_row"], "_more": [wide_signature(shingles(words_of(x))).tobytes() for x in rows["_text"]]}

    made = materialize(map_rows(texts, make, "_rid long, _more binary"), "wide")
    discard(wanted)
    return made


def _by_key(keys: list[str], fn):
    """A mapInPandas function that gives ``fn`` the rows of each key, which follow each other, and concatenates what it returns."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for part in parts:
            if not len(part):
                continue
            key = part[keys].to_numpy()
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(part)]
            done = []
            for lo, hi in zip(edge, edge[1:]):
                if last is not None and tuple(key[lo]) != last:
                    done.append(fn(pd.concat(held, ignore_index=True)))
                    held = []
                held.append(part.iloc[lo:hi])
                last = tuple(key[lo])
            done = [x for x in done if x is not None]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held and (x := fn(pd.concat(held, ignore_index=True))) is not None:
            yield x

    return run


def _residual(opened: DataFrame, classes: DataFrame, wide: DataFrame, base: DataFrame, threshold: int, miss: float) -> DataFrame:
    """Links across components within buckets that hold several, in full but for pairs of components that a link in the
    same block joins; pairs with the pivot are done already. A pair counts in the first band that it shares only."""
    rows = opened.withColumn("_in", F.col("_comp") == F.col("_top"))
    rows = rows.withColumn("_tops", F.ceil(F.col("_n_top") / BLOCK).cast("int")).withColumn("_rests", F.ceil(F.col("_n_rest") / BLOCK).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("_rid"), n).cast("int")
    rows = rows.withColumn("_own", F.when(F.col("_in"), place(F.col("_tops"))).otherwise(F.col("_tops") + place(F.col("_rests"))))
    # The largest component's blocks meet the others' only: within it there is nothing to find.
    rows = rows.join(classes.select("_rid", "_sig"), "_rid").join(wide, "_rid").withColumn("_other", F.explode(F.sequence(F.when(F.col("_in"), F.col("_tops")).otherwise(F.lit(0)), F.col("_tops") + F.col("_rests") - 1)))
    rows = rows.select("_bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_rid", "_comp", "_sig", "_more")
    least = least_matches(threshold / 100, miss)
    least_wide = least_matches(threshold / 100, miss, tuple(range(HASHES + WIDE_BATCH, HASHES + WIDE + 1, WIDE_BATCH)))

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        """The members of a block with plausible partners, in parts of up to ``MEET`` members of either side."""
        own, rid, comp = (g[c].to_numpy() for c in ("_own", "_rid", "_comp"))
        alone = g["_i"].iat[0] == g["_j"].iat[0]
        if comp.min() == comp.max() or not alone and own.min() == own.max():
            return None
        sig, more = _matrix(list(g["_sig"])), np.frombuffer(b"".join(g["_more"]), "u1").reshape(len(g), WIDE)
        left = np.flatnonzero(own == own.min())
        right = left if alone else np.flatnonzero(own != own.min())
        band = int(np.argmax(_bands(sig[:1])[0] == g["_bucket"].iat[0]))
        a, b, n = [], [], []
        for i in left:
            at = right[(comp[right] != comp[i]) & ((right > i) | (not alone))]
            equal = np.zeros(len(at), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal = equal + (sig[at, part] == sig[i, part]).sum(axis=1)
                at, equal = at[equal >= m], equal[equal >= m]
                if not len(at):
                    break
            if len(at):
                own_band = (sig[at] == sig[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                at, equal = at[own_band], equal[own_band]
            for k, m in enumerate(least_wide):
                if not len(at):
                    break
                part = slice(k * WIDE_BATCH, (k + 1) * WIDE_BATCH)
                equal = equal + (more[at, part] == more[i, part]).sum(axis=1)
                at, equal = at[equal >= m], equal[equal >= m]
            if len(at):
                a.append(np.full(len(at), i))
                b.append(at)
                n.append(equal)
        if not a:
            return None
        a, b, n = map(np.concatenate, (a, b, n))
        chunk = lambda x: np.unique(x, return_inverse=True)[1] // MEET
        sub = chunk(a) * (1 << 20) + chunk(b)
        out: dict[str, list] = {"_sub": [], "_at": [], "_with": [], "_equal": []}
        for k in np.unique(sub):
            here = sub == k
            x, y, z = a[here], b[here], n[here]
            for i in np.unique(np.concatenate([x, y])):
                own_pairs = x == i
                for c, v in zip(out, (int(k), int(i), rid[y[own_pairs]].tolist(), z[own_pairs].tolist())):
                    out[c].append(v)
        at = np.array(out.pop("_at"))
        key = {c: g[c].iat[0] for c in ("_bucket", "_i", "_j")}
        return pd.DataFrame({**key, "_rid": rid[at], "_comp": comp[at], **out})

    def check(g: pd.DataFrame) -> pd.DataFrame | None:
        """Links of a part, the most alike pairs first; components that are joined here are one from then on."""
        sets = dict(zip(g["_rid"], (np.frombuffer(x, np.uint64) for x in g["_set"])))
        comp = dict(zip(g["_rid"], g["_comp"]))
        pairs = sorted((-e, min(i, j), max(i, j)) for i, js, es in zip(g["_rid"], g["_with"], g["_equal"]) for j, e in zip(js, es))
        into: dict[int, int] = {}

        def root(c: int) -> int:
            while c in into:
                c = into[c]
            return c

        found = []
        for _, i, j in pairs:
            x, y = root(comp[i]), root(comp[j])
            if x != y and _alike(sets[i], sets[j], threshold):
                into[max(x, y)] = min(x, y)
                found.append((i, j))
        return pd.DataFrame(found, columns=["_a", "_b"]) if found else None

    block, part = ["_bucket", "_i", "_j"], ["_bucket", "_i", "_j", "_sub"]
    near = rows.repartition(*block).sortWithinPartitions(*block).mapInPandas(_by_key(block, compare), "_bucket long, _i int, _j int, _rid long, _comp long, _sub long, _with array<long>, _equal array<long>")
    near = materialize(near, "near", narrow=True)
    wanted = materialize(near.select(F.col("_rid").alias("_row")).distinct(), "wanted", narrow=True)
    sets = _sets(base, wanted)
    met = near.join(sets.withColumnRenamed("_row", "_rid"), "_rid").repartition(*part).sortWithinPartitions(*part)
    links = materialize(met.mapInPandas(_by_key(part, check), "_a long, _b long").distinct(), "found", narrow=True)
    discard(near, wanted, sets)
    return links


def sketch(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs`` in the shared folder: number, id, text, carried columns, class, set size, signature."""
    extra, types = carried(docs, carry)
    read = docs.select(named(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"), named(text_col).isNull().alias("_null"), *extra).withColumn("_row", F.monotonically_increasing_id())
    return materialize(map_rows(read, _sketch, fields(("_doc", kind(docs, id_col)), "_text string, _null boolean", *types, "_row long, _class binary, _n long, _sig binary")), "sketch")


def group(base: DataFrame, threshold: int = 75, miss: float = 1e-7) -> DataFrame:
    """``base``, as ``sketch`` makes it, with ``_component``: the smallest id that a row's text is linked with, directly or not, and ``_first``: one row of the component that has this id."""
    share = threshold / 100
    known = base.where(F.col("_class").isNotNull())
    classes = materialize(known.groupBy("_class").agg(F.min("_row").alias("_rid"), F.first("_sig").alias("_sig"), F.min(F.struct(F.col("_doc").isNull().alias("no"), F.col("_doc").alias("id"), F.col("_row").alias("row"))).alias("_least")), "classes")
    buckets = _explode_buckets(classes)
    pivots = buckets.groupBy("_bucket").agg(F.min("_rid").alias("_pivot"), F.count("*").alias("n")).where("n > 1").select("_bucket", "_pivot")
    stars = buckets.join(pivots, "_bucket").where("_rid <> _pivot").select(F.least("_rid", "_pivot").alias("_a"), F.greatest("_rid", "_pivot").alias("_b")).distinct()
    links = _verify(_bayes(stars, classes, share, miss), base, threshold)
    names = components(links)
    opened = materialize(_named(buckets, names), "open")
    wide = _wide(opened, base)
    more = _residual(opened, classes, wide, base, threshold, miss)
    if not more.isEmpty():
        links, old = materialize(links.union(more), "found", narrow=True), (links, names)
        names = components(links)
        discard(*old)
    discard(more)
    comp = classes.join(names, "_rid", "left").select("_class", F.coalesce("_comp", "_rid").alias("_comp"), "_least")
    least = comp.groupBy("_comp").agg(F.min("_least").alias("_least"))
    by_class = materialize(comp.select("_class", "_comp").join(least, "_comp").select("_class", F.col("_least.id").alias("_cid"), F.col("_least.row").alias("_crow")), "groups")
    discard(classes, names, links, opened, wide)
    out = base.join(by_class, "_class", "left")
    alone = F.col("_class").isNull()
    return out.withColumn("_component", F.when(alone, F.col("_doc")).otherwise(F.col("_cid"))).withColumn("_first", alone | (F.col("_row") == F.col("_crow"))).drop("_cid", "_crow")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, miss: float = 1e-7) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    The largest things that move are signatures of 512 bytes a distinct text and 32 bucket rows of 16; texts stay where
    they were written, but for those of verified pairs."""
    found = group(sketch(docs, id_col, text_col), threshold, miss)
    return found.select(F.col("_doc").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_doc").eqNullSafe(F.col("_component")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, miss: float = 1e-7) -> DataFrame:
    """The rows of ``docs`` with one of each group: the one of smallest id, one such row if ids repeat."""
    carry = others(docs, text_col)
    found = group(sketch(docs, id_col, text_col, carry), threshold, miss).where("_first")
    own = {c: F.col(f"_c_{i}") for i, c in enumerate(carry)}
    return found.select(*[own.get(c, F.when(~F.col("_null"), F.col("_text"))).alias(c) for c in docs.columns])
