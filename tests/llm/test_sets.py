"""Near-duplicates, packing, mixing, search and the models, against brute force, round trips and held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language_id, mixing, near_dedup, packing, quality_classifier, vector_search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    s = list(map(sets, texts))
    comp = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return s, comp


def near_texts(seed, groups, copies, changes):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(120)]
        for _ in range(copies):
            w = list(base)
            for _ in range(draw.randint(0, changes)):
                w[draw.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("groups,copies,changes", [(25, 4, 6), (1, 90, 9)])
def test_near_duplicates_are_exact(docs, odd_texts, groups, copies, changes):
    texts = near_texts(groups, groups, copies, changes) + odd_texts
    s, comp = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, s))
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(texts)))


def test_repeated_and_null_ids(docs):
    same = "one two three four five six"
    got = near_dedup.near_duplicates(docs([same, same, same, "other words stand here in this one", None], [7, 7, None, None, None])).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == {(7, 7, True): 2, (None, 7, False): 1, (None, None, True): 2}
    assert near_dedup.deduplicate(docs([same, same, same, None], [7, 7, None, None])).count() == 2


def test_posterior_bounds():
    assert all(0 < m < n for m, n in zip(near_dedup.least_matches(0.75, 1e-6), (32, 64, 96, 128)))
    a = np.zeros((2, 128), np.uint32)
    b = a.copy()
    b[1] = 1
    assert near_dedup.plausible(a, b, 0.75, 1e-6).tolist() == [0]
    assert 1e-6 < near_dedup.loss() < 1 / 140_000 and near_dedup.loss(0.8) < 1e-7


@pytest.mark.parametrize("block,meet", [(7, 3), (7, 512), (4096, 5), (4096, 512)])
def test_blocks_of_large_buckets_lose_no_link(docs, monkeypatch, block, meet):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MEET", meet)
    draw = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    chain = []  # one component of many, and outliers that share buckets with it and link with one member or none
    for i in range(60):
        w = list(base)
        w[i % 60] = f"x{i}"
        chain.append(" ".join(w))
    for i in range(25):
        w = list(base)
        for _ in range(draw.randint(2, 4)):
            w[draw.randrange(60)] = f"y{i}{draw.random()}"
        chain.append(" ".join(w))
    _, comp = brute_components(chain)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(chain)).collect()}
    assert [got[i] for i in range(len(chain))] == comp and len(set(comp)) > 3


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_round_trip(docs, odd_texts, tokenizer):
    texts = odd_texts + ["<|endoftext|> stands here, isn't it?", "a <|endoftext|> b <|endoftext", "<|endoftext|><|endoftext|>"] + near_texts(3, 30, 2, 40)
    pieces = [r.asDict() for r in packing.pack(docs(texts)).collect()]
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist()
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist() and {p["doc_tokens"] for p in own} == {len(ids)}
        assert all(zlib.crc32(p["ids"]) >= 0 and len(p["ids"]) == 4 * p["length"] for p in own)
    lengths = []
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        lengths.append(sum(p["length"] for p in own))
    assert max(lengths) <= 1024 and sum(n < 1024 for n in lengths) <= 1


def test_encoders_agree(tokenizer):
    assert packing.odd_characters("byte_bpe_50k.json")[0] == frozenset()


def test_hilbert_steps_are_unit_steps():
    import itertools

    for dims, bits in ((2, 4), (4, 2), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_copies_pack_side_by_side(docs):
    texts = near_texts(8, 20, 2, 0)
    got = sorted(packing.pack(docs(texts)).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    order = list(dict.fromkeys(r["doc_id"] // 2 for r in got))
    assert len(order) == 20 and [r["doc_id"] // 2 for r in got if r["start"] == 0] == [k for k in order for _ in range(2)]


def test_targets():
    assert mixing.targets([10, 10, 10]) == pytest.approx([5, 10, 15])
    assert mixing.targets([100, 1, 0]) == pytest.approx([98, 3, 0])
    assert mixing.targets([]) == [] and sum(mixing.targets([5, 500, 7, 9])) == pytest.approx(521)


def test_permutation_and_shards():
    for n in (1, 2, 3, 100, 1025):
        assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    counts = np.array([500, 0, 1300, 77])
    parts = [mixing.shard_counts(k, counts, 64, 3) for k in range(-(-int(counts.sum()) // 64))]
    assert (sum(h for _, h in parts) == counts).all() and all(h.sum() == 64 for _, h in parts[:-1])
    for s in range(4):
        assert [int(f[s]) for f, _ in parts] == np.cumsum([0, *[int(h[s]) for _, h in parts]])[:-1].tolist()


def test_draws_are_hypergeometric():
    from math import comb

    rng = np.random.Generator(np.random.Philox(3))
    for good, bad, n in ((5, 7, 4), (3, 100, 50), (40, 40, 80), (6, 0, 3), (0, 6, 3), (9, 9, 0)):
        got = Counter(mixing.hypergeometric(rng, good, bad, n) for _ in range(4000))
        for k in range(max(0, n - bad), min(n, good) + 1):
            p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
            assert abs(got[k] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-3
        assert all(max(0, n - bad) <= k <= min(n, good) for k in got)


def test_one_way_of_drawing_for_any_number_of_slots():
    counts = np.array([3 * 10**11, 10**10, 7, 10**12])
    assert mixing._draw(tuple(counts.tolist()), int(counts.sum()), (1, 2, 3)) == tuple(counts.tolist())
    last = -(-int(counts.sum()) // 4096) - 1
    first, here = mixing.shard_counts(last, counts, 4096, 5)
    assert (first + here == counts).all() and here.sum() == counts.sum() - last * 4096
    spread = [mixing.shard_counts(k, counts, 4096, 5) for k in (0, 1, 12_345_678, 12_345_679)]
    assert all(h.sum() == 4096 and abs(h[0] - 4096 * 0.229) < 150 for _, h in spread)
    assert (spread[0][0] == 0).all() and (spread[0][1] == spread[1][0]).all() and (spread[2][0] + spread[2][1] == spread[3][0]).all()
    half = np.array(mixing._draw(tuple(counts.tolist()), int(counts.sum()) // 2, (9,)), float)
    sd = (counts * 0.25 * (1 - counts / counts.sum())) ** 0.5
    assert (np.abs(half - counts / 2) < 6 * sd + 1).all() and (np.abs(half - counts / 2)[[0, 1, 3]] > 0).all()


def test_mixing(docs, odd_texts):
    texts = near_texts(4, 120, 2, 60) + odd_texts
    df = docs(texts)
    got = [r.asDict() for r in mixing.take(df).collect()]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in got)
    for s in set(source.values()):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 64
    again = {r["doc_id"]: r["taken"] for r in mixing.take(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    mixed = mixing.mix(df)
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert mixed.columns == df.columns and words == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})


def test_search(spark):
    rng = np.random.RandomState(2)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.randint(30, size=3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32).astype(float)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(5000, None, "s"), (5050, [0.0] * 16, "s"), (5100, [float("nan")] * 16, "s"), (5150, [1.0, None] * 8, "s"), (None, [1.0] * 16, "s"), (5200, [1.0] * 3, "s"), (5250, [], "s")]
    got = {}
    for r in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        own = [(v, s) for _, v, s in sorted(got[q])]
        s = unit @ unit[q]
        s[q] = -9
        true = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hit += len(set(true) & {v for v, _ in own})
        assert len(own) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in own) and [c for _, c in own] == sorted((c for _, c in own), reverse=True)
    assert set(got) == set(range(0, 3000, 50)) and hit >= 0.9 * 300
    assert [v for _, v, _ in sorted(got[0])] == [100, 101, 102, 103, 104] and [v for _, v, _ in sorted(got[100])][0] == 0


def test_search_of_few(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert vector_search.search(make([])).count() == 0 and vector_search.search(make([(0, [1.0, 2.0])])).count() == 0
    assert [r["vec_id"] for r in vector_search.search(make([(0, [1.0, 0.0]), (3, [1.0, 0.1]), (2, [0.0, 1.0])])).orderBy("rank").collect()] == [3, 2]


def test_repeated_rows_hide_no_neighbours(spark):
    rows = [(0, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in range(1, 8)] * 2 + [(i, [2.0, -1.0 - i]) for i in range(8, 12)]
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, i) for i in range(1, 6)] and all(abs(r["score"] - 1) < 1e-12 for r in got)


def test_extreme_components(spark):
    for size in (1e200, 1e-200, 5e-324, 1.7e308):
        rows = [(0, [size, size]), (1, [size, 0.9 * size]), (2, [size, -size]), (3, [size, 0.0]), (4, [1.0, 0.5])]
        got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
        assert got[0]["vec_id"] == 1 and got[0]["score"] > 0.99 and [r["vec_id"] for r in got][-1] == 2 and all(np.isfinite(r["score"]) for r in got)


def test_deep_trees(spark):
    rng = np.random.RandomState(6)
    x = rng.standard_normal((40, 12))[rng.randint(40, size=6000)] + 0.4 * rng.standard_normal((6000, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(vectors, leaf=16, sample=150, split_sample=120).collect():  # 150 rows give few leaves of over 64 rows: two levels are added
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert set(got) == set(range(0, 6000, 50)) and hit >= 0.9 * 600


def test_every_vector_stays_in_the_index(spark):
    rows = [(i, [1.0 + i * 1e-9, 1.0]) for i in range(700)] + [(i, [1.0, float(i)]) for i in range(700, 1500)]  # the first are all but alike
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    import tessera.llm.shared as shared

    read = df.select("vec_id", "embedding")
    indexed = shared.map_rows(read, lambda r: {"_ids": [[i] for i in r["vec_id"]], "_v": r["embedding"], "_leaf": [1] * len(r["vec_id"]), "_whole": [False] * len(r["vec_id"])}, vector_search.INDEXED)
    asked = shared.map_rows(read.where("vec_id % 100 = 0"), lambda r: {"_id": r["vec_id"], "_v": r["embedding"], "_leaf": [1] * len(r["vec_id"])}, vector_search.ASKED)
    indexed, asked = vector_search._deepen(shared.materialize(indexed), shared.materialize(asked), 2, 5, 0.97, 16, 200)
    got = indexed.selectExpr("_ids[0] AS id", "_leaf", "_whole").collect()
    assert sorted(r["id"] for r in got) == list(range(1500)) and len({r["_leaf"] for r in got}) > 20
    assert {r["_leaf"] for r in asked.collect()} <= {r["_leaf"] for r in got} and {r["_id"] for r in asked.collect()} == set(range(0, 1500, 100))


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language(docs, odd_texts, spark):
    draw = random.Random(3)
    parts = {"en": ["the", "and", "ing", "tion", "wh", "th"], "fr": ["le", "que", "eau", "é", "ou", "ment"], None: ["zzz"]}
    texts = [" ".join("".join(draw.choice(parts[("en", "fr", None)[i % 3]]) for _ in range(2)) for _ in range(40)) for i in range(240)] + odd_texts
    got = {r["doc_id"]: r for r in language_id.predict(docs(texts)).collect()}
    assert all(got[i]["held_out"] == (crc(i) % 3 == 1) and 0 <= got[i]["score"] <= 1 for i in range(len(texts)))
    held = [i for i in range(240) if got[i]["held_out"] and i % 3 < 2]
    assert all(got[i]["lang_pred"] == ("en", "fr")[i % 3] for i in held) and {got[240 + i]["lang_pred"] for i in range(3)} == {"und"}
    assert language_id.predict(docs([])).count() == 0


def test_letters_are_those_of_unicode(docs):
    texts = ["² ½ Ⅷ", "१२३ 123 ٣", "a", "ª", "中", "١x", "😀 !?"] + ["the cat sat on that mat and then the other"] * 30
    got = {r["doc_id"]: r for r in language_id.predict(docs(texts)).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(7)] == [True, True, False, False, False, False, True]


def plain_code_length(train, text, orders=3):
    """Bits of PPM, method C with exclusion, over all 256 bytes, straight from its definition."""
    import math
    from functools import lru_cache

    counts = {}
    for t in train:
        raw = b" " * orders + t.lower().encode()
        for i in range(orders, len(raw)):
            for k in range(orders + 1):
                counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1

    @lru_cache(maxsize=None)
    def chances(context):
        below = {b: 1 / 256 for b in range(256)} if context is None else None
        if below:
            return below
        below = chances(context[1:] if context else None)
        seen = counts.get(context)
        if not seen:
            return below
        n, kinds = sum(seen.values()), len(seen)
        rest = sum(p for b, p in below.items() if b not in seen)
        return {b: seen[b] / (n + kinds) if b in seen else p / rest * kinds / (n + kinds) for b, p in below.items()}

    raw = b" " * orders + text.lower().encode()
    return -sum(math.log2(chances(raw[i - orders : i])[raw[i]]) for i in range(orders, len(raw)))


def test_code_lengths_are_exact():
    train = {"x": ["the cat and the hat that sat", "Then 12, that hat?"], "y": ["le chat était là", "çà et là; été"]}
    counts = {}
    for lang, texts in train.items():
        code, n = np.unique(np.concatenate([language_id.grams(language_id.data(t), 4) for t in texts]), return_counts=True)
        counts[lang] = (code, n.astype(float))
    m = language_id.Model(["x", "y"], counts, 10_000)
    for text in ("the hat", "là, le chat!", "zebra \u4e2d\x00", "", "THAT cat " * 40):
        assert np.allclose(m.code_length(text), [plain_code_length(train["x"], text), plain_code_length(train["y"], text)], rtol=1e-5, atol=1e-3)
    whole = m.code_length("the rat " * 100)
    language_id.PIECE, old = 64, language_id.PIECE
    assert np.allclose(m.code_length("the rat " * 100), whole)
    language_id.PIECE = old
    few = language_id.Model(["x", "y"], counts, 12)  # with any number of kept contexts each is a distribution over bytes
    weight = np.ones(few.size)
    weight[-1] = 256 - few.size + 1
    assert np.allclose((np.exp2(-few.bits.reshape(-1, few.size, 2).astype(float)) * weight[:, None]).sum(1), 1, atol=1e-4)


def test_many_languages(docs, spark):
    draw = random.Random(5)
    syllables = {f"l{k}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for k in range(9)}
    rows = [(i, " ".join(draw.choice(syllables[f"l{i % 9}"]) for _ in range(30)), f"l{i % 9}") for i in range(900)]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == f"l{i % 9}" for i in held) >= 0.98 * len(held)


def test_classifier(docs, odd_texts, spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    texts = [" ".join(word() for _ in range(draw.randint(10, 80))) if i % 4 else " | ".join(word() + "%%" for _ in range(30)) for i in range(400)] + odd_texts
    labels = spark.createDataFrame([(i, int(i % 4 > 0) if i % 50 else None, "x") for i in range(400)] + [(None, 1, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    got = {r["doc_id"]: r for r in quality_classifier.score(docs(texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (crc(i) % 4 == 2) for i, r in got.items())
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 > 0) for i in held) >= 0.95 * len(held)
    none = quality_classifier.score(docs(texts[:5]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_classifier_of_odd_tables(docs, spark):
    """Clashing names, one id in a third of all rows, with one text and with many, and empty tables."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    rows = [(i, ("good clean words " if i % 2 else "%% || ## ") * (3 + i % 7), "a", "b", "c", "d") for i in range(300)]
    rows += [(8, "%% || ## " * 4, "a", "b", "c", "d")] * 150 + [(9, f"good clean words {i}", "a", "b", "c", "d") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _y string, _text string, _doc string")
    got = quality_classifier.score(df, labels, sample=100).collect()
    assert len(got) == 600 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)
    assert quality_classifier.score(df.limit(0), labels).count() == 0 and quality_classifier.score(df.limit(5), labels.limit(0)).count() == 5


def test_classifier_solves_its_problem():
    """Dual coordinate descent against many steps of plain projected ascent on the same dual."""
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma", "%%", "||"][:: 1 if i % 2 else -1][:4]) for _ in range(12)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    rows = [quality_classifier.vector(*quality_classifier.features(t)) for t in texts]
    model = quality_classifier.Model(rows, y, epochs=400)
    size = 2 << quality_classifier.BITS
    p, q = np.ones(size), np.ones(size)
    for (at, _), label in zip(rows, y):
        for j in at:
            (p if label else q)[j] += 1
    ratio = np.log(p / (y.sum() + 2)) - np.log(q / ((1 - y).sum() + 2))
    order = np.random.RandomState(7).permutation(60)
    fit = order[12:]
    dense = {}
    for i in fit:
        dense[i] = {int(j): float(x * ratio[j]) for j, x in zip(*rows[i])}
    gram = np.array([[sum(v * dense[b].get(j, 0.0) for j, v in dense[a].items()) for b in fit] for a in fit])
    sign = np.where(y[fit] > 0, 1.0, -1.0)
    limit = np.where(y[fit] > 0, 1 / y[fit].sum(), 1 / (1 - y[fit]).sum()) * len(fit) / 2
    k = gram * sign[:, None] * sign[None, :]
    alpha = np.zeros(len(fit))
    for _ in range(20_000):
        alpha = np.clip(alpha + (1 - k @ alpha) / np.linalg.eigvalsh(k).max() if _ == 0 else alpha + (1 - k @ alpha) * step, 0, limit)
        step = 1 / np.linalg.norm(k, 2) if _ == 0 else step
    want = gram @ (alpha * sign)
    got = np.array([float(model.weights[rows[i][0]] @ rows[i][1]) for i in fit])
    assert np.allclose(got, want, atol=0.02 * np.abs(want).max())


@pytest.mark.parametrize("run", [near_dedup.deduplicate, mixing.mix])
def test_any_column_goes_along(spark, run):
    rows = [(i, f"some words that stand here {i} " * 9, "s", (i, [f"v{i}"]), {"k": i}) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `odd col.umn` struct<`a b`:int,`c.d``e`:array<string>>, m map<string,int>")
    out = run(df)
    assert out.columns == df.columns and out.count() >= 4 and {r["odd col.umn"]["a b"] for r in out.collect()} <= set(range(5))
    assert packing.pack(df, "DOC_ID", "TEXT").select("doc_id").distinct().count() == 5


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, near_dedup.deduplicate, packing.pack, mixing.take, mixing.mix])
def test_empty_tables(docs, run):
    assert run(docs([])).count() == 0
