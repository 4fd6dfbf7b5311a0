"""Tree search, SentencePiece codec, line field, chat formatting and the pipeline against brute force."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from small import docs, edge_rows, words

import __spark_entry__ as entry
import corpus_pipeline
from ringsight.llm import ann_tree, chat_format, crf_quality, quality_rules, sentencepiece_codec, simhash_dedup

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_neighbours(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    dims = [len(v) for _, v in ok]
    top = max(sorted(set(dims)), key=dims.count) if dims else 0
    ok = [(i, v) for i, v in ok if len(v) == top]
    out = {}
    for q in {i for i, _ in ok if i % 100 == 0}:
        v = next(v for i, v in ok if i == q)
        near = {}
        for i, w in ok:
            if i != q:
                d = float(np.sqrt(((w - v) ** 2).sum()))
                near[i] = min(near.get(i, d), d)
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def vectors(n, dim=8, seed=0, clusters=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, (centres[i % clusters] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_small_tables_are_exact(spark):
    rows = vectors(300)
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] + [1.0] * 7), (1300, [float("inf")] * 8), (1400, [1.0, 2.0]), (1500, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(2000 + i, [1.0] * 8) for i in range(30)] + [(5, rows[5][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({"query_id": F.lit("x"), "rank": F.lit(1), "leaf": F.lit(0), "v": F.lit(0)})
    got = {}
    for r in ann_tree.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute_neighbours(rows, 10)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [i for *_, i in sorted(found)] == [i for _, i in want[q]]
        assert [d for _, d, _ in sorted(found)] == pytest.approx([d for d, _ in want[q]])
        assert [r for r, *_ in sorted(found)] == list(range(1, len(found) + 1))


@pytest.mark.parametrize("hot", [0, 1200])
def test_recall_of_the_tree(spark, hot, monkeypatch):
    """Many leaves, and a third of all rows with one vector, in cells that must be split."""
    monkeypatch.setattr(ann_tree, "CELL_ROWS", 200)
    monkeypatch.setattr(ann_tree, "CELL_QUERIES", 5)
    rows = vectors(3000, 16) + [(10_000 + i, [0.5] * 16) for i in range(hot)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = {}
    for r in ann_tree.search(df, F.col("vec_id") % 100 == 0, leaf_rows=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_neighbours(rows, 10)
    assert set(got) == set(want)
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_given_embeddings_reach_the_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    got = {}
    for r in ann_tree.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_no_vectors_and_few(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ann_tree.search(empty, F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], VECTORS)
    assert [r["vec_id"] for r in ann_tree.search(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [2, 1]


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = ann_tree.grow(x, 30)
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves == 30
    assert order[0] == tree.assign(x[:1])[0]
    assert ann_tree.grow(np.ones((50, 3)), 10).leaves == 1


# ---------------------------------------------------------------- SentencePiece

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces  ", "Hello world", "é ü 漢字 😀", "tab\tand\nnew\r\nline", "▁mark ▁ a▁b", "a▁ b", "<s> </s> <unk> <0x0A>", "x" * 3000, "ÅÅ ﬁ ①", "a\x00b", "trailing "]


def message(pieces, kind, fallback, **normal):
    """A model file written by hand: (piece, score, type) rows and the options."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def put(number, value):
        if isinstance(value, bytes):
            return varint(number << 3 | 2) + varint(len(value)) + value
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3) + varint(value)

    out = b"".join(put(1, put(1, p.encode()) + put(2, s) + put(3, t)) for p, s, t in pieces)
    out += put(2, put(3, kind) + put(35, int(fallback)) + put(40, 0) + put(41, 1) + put(42, 2) + put(43, (1 << 64) - 1))
    return out + put(3, put(1, b"identity") + put(3, normal.get("prefix", 1)) + put(4, normal.get("squeeze", 1)) + put(5, 1))


def unigram(fallback, **normal):
    rng = random.Random(2)
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    letters = [(c, -8.0 - rng.random(), 1) for c in "▁abcdefghijklmnopqrstuvwxyzé"]
    made = {"".join(rng.choices("abcdefgh", k=rng.randrange(2, 5))) for _ in range(150)}
    longer = [(p, -4.0 - 3 * rng.random(), 1) for p in sorted(made)] + [("▁" + p, -3.0 - 3 * rng.random(), 1) for p in sorted(made)]
    spaces = [("▁▁", -3.5, 1)]
    raw = [(f"<0x{i:02X}>", -12.0, 6) for i in range(256)] if fallback else []
    return message([*special, *raw, *letters, *longer, *spaces], 1, fallback, **normal)


def test_parse_reads_the_given_model():
    model = sentencepiece_codec.parse(open(PIECES, "rb").read())
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(model.pieces) == own.get_piece_size() and model.kind == sentencepiece_codec.BPE and model.byte_fallback
    assert [p for p, _, _ in model.pieces] == [own.id_to_piece(i) for i in range(len(model.pieces))]
    assert all(abs(s - own.get_score(i)) < 1e-6 for i, (_, s, _) in enumerate(model.pieces))
    assert sentencepiece_codec.words_stand_alone(model)


def test_ids_equal_the_original(spark):
    rows = list(enumerate(TEXTS)) + [(100, None), (101, " ".join(TEXTS)), (3, TEXTS[3]), (None, "x y")]
    df = docs(spark, rows, extra=True)
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.digest(df, PIECES).collect()
    want = [(d, own.encode(t or "")) for d, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    made = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=order)
    assert made == sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want), key=order)
    assert all(r["parity"] for r in got)
    lossless = {d for d, t in rows if t is None or "▁" not in t}
    assert all(r["round_trip"] for r in got if r["doc_id"] in lossless)
    encoded = sentencepiece_codec.encode(df, PIECES)
    texts = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, PIECES).collect()}
    assert all(texts[d] == (t or "") for d, t in rows if d in lossless)
    assert sentencepiece_codec.digest(df.filter("doc_id = -1"), PIECES).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_models(fallback, squeeze):
    data = unigram(fallback, squeeze=squeeze)
    codec = sentencepiece_codec.Codec(data)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghxyzé漢", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(100)]
    texts += ["", "a  b", " lead", "trail ", "<s> a"]
    for text, (ids, parity) in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        assert parity and ids.tolist() == own.encode(text), text
    assert codec.by_word == (not squeeze)


def test_models_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        sentencepiece_codec.parse(message([("<unk>", 0.0, 2)], 3, False))


def test_words_are_forgotten_and_learnt_again():
    codec = sentencepiece_codec.Codec(open(PIECES, "rb").read())
    codec.lexicon.limit = 5
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for texts in (["a b c d", "e"], ["f a", ""], ["a b"]):
        assert [i.tolist() for i, _ in codec.encode([t.encode() for t in texts])] == own.encode(texts)


# ---------------------------------------------------------------- the line field


def brute_marginals(field, x):
    """Sum over all labellings."""
    n = len(x)
    total, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        s = sum(y[t] * float(x[t] @ field.weights) for t in range(n)) + sum(field.steps[y[t - 1], y[t]] for t in range(1, n))
        total += np.exp(s)
        good += np.exp(s) * np.array(y)
    return good / total


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    lines = np.array([1, 5, 8, 2, 1])
    x = rng.normal(size=(lines.sum(), 6))
    field = crf_quality.Field(rng.normal(size=6), rng.normal(size=(2, 2)))
    got = np.split(field.good(x, lines), np.cumsum(lines)[:-1])
    for part, own in zip(got, np.split(x, np.cumsum(lines)[:-1]), strict=True):
        assert part == pytest.approx(brute_marginals(field, own))


def test_gradient_climbs_and_neighbours_count():
    rng = np.random.default_rng(5)
    lines = np.full(60, 6)
    label = np.repeat([0.0, 1.0], 30)
    x = rng.normal(size=(360, 3)) + np.repeat(label, 6)[:, None] * [1.5, 0, 0]
    field = crf_quality.fit(x, lines, label)
    mean = field.good(x, lines).reshape(60, 6).mean(1)
    assert ((mean > 0.5) == (label == 1)).mean() >= 0.95
    assert field.steps[1, 1] + field.steps[0, 0] > field.steps[0, 1] + field.steps[1, 0]


def test_line_features_see_lines():
    import pyarrow as pa

    from ringsight.llm.words import raw

    buf, off = raw(pa.array(["a b c\n\n x x x \nTOP $%& top\na b c", None, " \n ", "one"]))
    x, size, lines = crf_quality.line_features(buf, off)
    assert lines.tolist() == [4, 1, 1, 1] and x.shape == (7, crf_quality.N_FEATURES)
    assert size.tolist() == [5, 7, 11, 5, 1, 1, 3]
    assert x[1, 6] == pytest.approx(2 / 3) and x[3, 8] == 1 and x[0, 8] == 0
    assert (x[4, 1:] == 0).all() and x[0, crf_quality._OWN + len(crf_quality._SHARED) + 3] == x[1, 6]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op8_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert len(rows) > 500
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    crc = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in labels.collect()}
    assert all(r["held_out"] == crc[r["doc_id"]] for r in got.select("doc_id", "held_out").collect() if r["doc_id"] in crc)


def test_classifier_on_edge_cases(spark):
    rows = edge_rows()
    df = docs(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(50)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = crf_quality.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    none = crf_quality.classify(df, labels.filter("quality = 5")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert crf_quality.filter_documents(df, labels.filter("quality = 5")).count() == len(rows)
    assert crf_quality.classify(df.filter("doc_id = -1"), labels).count() == 0


# ---------------------------------------------------------------- chats

TURNS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    low = lambda v: (v is not None, v if v is not None else 0)
    by = {}
    for c, t, r, x in set(rows):
        by.setdefault(c, []).append((t, r or "", x or ""))
    full = {c: sorted(set(ts), key=lambda t: (-1 if t[0] is None else t[0], t[0] is not None, t[1])) for c, ts in by.items()}
    plain = {c: [t[1:] for t in ts] for c, ts in full.items()}

    def gone(c):
        return any(len(o) > len(plain[c]) and o[: len(plain[c])] == plain[c] or o == plain[c] and (d is None, low(d)) < (c is None, low(c)) for d, o in plain.items() if d != c)

    out = []
    for c, ts in full.items():
        at = 0
        for n, (t, r, x) in enumerate(ts, 1):
            if gone(c):
                continue
            piece = f"<|{r}|>\n{x}\n<|end|>\n"
            out.append((c, t, r, n, at, piece))
            at += len(piece)
    return out


def test_chats_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        n = rng.randrange(1, 7)
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"m{rng.randrange(2)}é") for t in range(n)]
    rows += [(100, t, "user", f"long {t}") for t in range(900)] + [(101, t, "user", f"long {t}") for t in range(650)]
    rows += [(102, t + 5, "user", f"long {t}") for t in range(900)]
    rows += [(None, 0, "user", "lost"), (None, 1, None, None), (103, None, "user", "first"), (103, 3, "bot", "x")] + [(103, 3, "bot", "x")] * 3
    df = spark.createDataFrame(rows, TURNS).withColumns({"conv": F.lit("x"), "nth": F.lit("y"), "start": F.lit(0)})
    got = [tuple(r) for r in chat_format.render(df).select("conv_id", "turn", "role", "nth", "start", "rendered").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=order) == sorted(brute_chats(rows), key=order)


def test_no_chats(spark):
    assert chat_format.render(spark.createDataFrame([], TURNS)).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_stages_on_given_tables(spark):
    """Every stage on what the one before kept; the whole is what run() returns."""
    sf = "/root/testdata/sf0.01"
    docs_now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs_now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_now, sf)
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs_now.dtypes
        out = simhash_dedup.settle(out)
        sizes.append(out.count())
        before, docs_now = docs_now, out
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    direct = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, direct.select(key).collect())) == sorted(map(tuple, docs_now.select(key).collect()))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in direct.collect()}
    assert set(tokens) == {r["doc_id"] for r in before.collect()}


def test_stages_take_effect(spark):
    rng = random.Random(6)
    good = lambda n: "\n".join(" ".join(words(rng, 12, 5000)) + "." for _ in range(n))
    junk = lambda: "\n".join(" ".join(f"{w}$$$" for w in words(rng, 12, 5000)) for _ in range(8))
    shared = " ".join(words(rng, 60, 5000))
    rows = [(i, good(8)) for i in range(120)] + [(1000 + i, junk()) for i in range(120)]
    rows += [(2000, rows[5][1]), (2001, rows[5][1].replace("w1", "v1", 2)), (2002, good(4) + "\n" + shared), (2003, good(4) + "\n" + shared)]
    df = docs(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i < 2000], "doc_id long, quality int, toxic int")
    kept = crf_quality.filter_documents(df, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i < 1000 or i >= 2000}
    kept = quality_rules.filter_documents(kept)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i < 1000 or i >= 2000}
    kept = simhash_dedup.keep_one(kept)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i < 1000 or i >= 2002}
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_repeats(spark, kept, "").collect()}
    assert shared in texts[2002][0] and shared[20:] not in texts[2003][0] and texts[2003][1] == len(texts[2003][0])
    assert texts[7][0] == rows[7][1]


def test_stages_on_empty_and_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (edge_rows(), [(1, None)]):
        now = docs(spark, rows, extra=True)
        for name, stage in corpus_pipeline.STAGES:
            now = simhash_dedup.settle(stage(spark, now, str(tmp_path)))
        assert "sequence_id" in now.columns
    now = docs(spark, [(1, "x")]).filter("doc_id = 2")
    for _, stage in corpus_pipeline.STAGES:
        now = simhash_dedup.settle(stage(spark, now, str(tmp_path)))
    assert now.count() == 0


