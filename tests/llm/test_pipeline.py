"""Each stage keeps the documents' columns and does what it says; the run packs what is left."""

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.count())
    assert kept[0] >= kept[1] == kept[2] and kept[3] > 0 and docs.select("sequence_id").distinct().count() > 0


def test_run(spark, sf_dir):
    import __spark_entry__
    from tessera.llm.shared import open_tables

    before = open_tables()
    out = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    pieces = out.collect()
    assert len(set(open_tables()) - set(before)) == 1  # nothing but the result stays
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    full = {}
    for r in pieces:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in full.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_run_against_brute_force(spark, tmp_path):
    """Documents whose fate in each stage is known, and the run's pieces against plain computations of what each stage leaves."""
    import random
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_scans import brute_quality
    from tests.llm.test_sets import brute_components

    draw = random.Random(14)
    vocab = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(500)]
    prose = lambda: " ".join(draw.choice(vocab) for _ in range(draw.randint(40, 160)))
    clean = [prose() for _ in range(150)]
    near = [" ".join(w if k != 7 else "other" for k, w in enumerate(t.split())) for t in clean[:12]] + clean[12:20]
    secret = "a8Fk39sQ0xZpL27vB6"
    texts = clean + near + [None, "", "short one", "a b c d e f g h " * 9] + ["#| $% " + " &* ".join(draw.choice(vocab) for _ in range(60)) for _ in range(5)] + [prose() + f' token = "{secret}{i}" ' + prose() for i in range(2)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{len(left)}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left.append([r.asDict() for r in docs.collect()])
    base = [i for i, t in enumerate(texts) if (n := brute_quality(t))[0] >= 20 and 100 * n[4] <= 30 * n[0]]
    junk = set(range(len(clean) + len(near) + 4, len(clean) + len(near) + 9))
    assert sorted(r["doc_id"] for r in left[0]) == sorted(set(base) - junk)
    own = {r["doc_id"]: r["text"] for r in left[0]}
    ids = sorted(own)
    _, comp = brute_components([own[i] for i in ids])
    assert sorted(r["doc_id"] for r in left[1]) == [i for k, i in enumerate(ids) if comp[k] == k]
    assert {r["doc_id"]: r["text"] for r in left[2]} == {r["doc_id"]: r["text"].replace(secret + str(r["doc_id"] - len(texts) + 2), "[SECRET]") if r["doc_id"] >= len(texts) - 2 else r["text"] for r in left[1]}
    assert sum("[SECRET]" in r["text"] for r in left[2]) == 2 and not any(secret in r["text"] for r in left[3])
    words = sum(len(r["text"].split()) for r in left[2])
    assert abs(sum(len(r["text"].split()) for r in left[3]) - words) <= 0.02 * words + 64 * 3
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in left[3])
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(p["length"] for p in pieces) == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in left[3])
    whole = [(p["doc_id"], p["ids_crc32"]) for p in pieces if p["length"] == p["doc_tokens"]]
    assert len(whole) > len(want) / 2 and set(whole) <= set(want)
    assert sum(p["start"] == 0 for p in pieces) == len(want)


def test_run_again_is_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = [sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, docs.repartition(n), sf_dir).collect()) for n in (1, 5)]
    assert once[0] == once[1]


def test_stages_in_sequence_without_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
        docs = out


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
