"""Packed counters, metric-tree codes and compression distance against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.llm import filter_audit, toxicity, vector_codes
from ringsight.llm.skew import join_by_size
from ringsight.llm.vocabulary import word_counts, word_pieces
from small import edge_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASH = ["part", "digest", "bits", "code", "n", "good", "toxic", "total", "salt", "first", "alone", "label", "doc", "fits", "word", "score", "key", "rows", "x", "v", "ids", "block"]


def clashing(df):
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


# ---------------------------------------------------------------- op11


def plain_audit(docs, good, toxic):
    """(doc_id, text, source) rows, document by document and order by order."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    facts = []
    for doc_id, text, source in docs:
        t = text or ""
        w = word.findall(t)
        same = [i for i, other, _ in docs if (other or "") == t and i is not None]
        flags = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and doc_id > min(same),
        }
        facts.append((source or "", {k for k, v in flags.items() if v}, doc_id in good, doc_id in toxic))
    out = []
    for part in sorted({f[0] for f in facts}):
        own = [f for f in facts if f[0] == part]
        removed = {}
        for order in filter_audit.ORDERS:
            for _, fails, g, x in own:
                gone = next((k for k, name in enumerate(order, 1) if name in fails), None)
                if gone:
                    removed.setdefault((order, gone), []).append((g, x))
        shapley = {n: sum(len(v) for (o, s), v in removed.items() if o[s - 1] == n) for n in "ABCDE"}
        for order in filter_audit.ORDERS:
            for step, name in enumerate(order, 1):
                here = removed.get((order, step), [])
                kept = len(own) - sum(len(removed.get((order, s), [])) for s in range(1, step + 1))
                failing = sum(name in f[1] for f in own)
                unique = sum(f[1] == {name} for f in own)
                out.append((part, order, step, kept, len(here), failing - len(here), unique, sum(g for g, _ in here), sum(x for _, x in here), shapley[name]))
    return out


def audit_rows():
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in edge_rows()]
    rows += [(100 + i, rows[rng.randrange(len(rows))][1], "a") for i in range(40)]
    rows += [(200 + i, " ".join(rng.choice(["Ab", "c#d", "EFG", "x", f"y{j}"]) for j in range(rng.randrange(90))), "b") for i in range(40)]
    rows += [(300, "same", "b"), (300, "same", "b"), (301, "same", "a"), (300, "same", "a")]
    return rows


def test_audit_equals_documents_one_by_one(spark):
    rows = audit_rows()
    docs = clashing(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(5))
    labels = clashing(spark.createDataFrame([(5, 1, 0), (101, 1, 1), (101, 0, None), (205, 0, 1), (None, 1, 1), (9999, 1, 1), (300, 1, None)], LABELS))
    got = sorted(map(tuple, filter_audit.audit(docs, labels).collect()))
    assert got == sorted(plain_audit(rows, {5, 101, 300}, {101, 205}))


def test_audit_of_an_empty_table(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_fields_never_carry():
    table = filter_audit.counters()
    most = (1 << filter_audit.FIELD) - 1
    lanes = filter_audit.unpack(table[0b1111111] * most)
    assert [lane[0] for lane in lanes] == [most] * 3
    assert all(set(lane[1:]) == {0, most} and sum(lane[1:]) == 120 * most for lane in lanes)
    assert filter_audit.unpack(table[0b0100000] + table[0])[0][0] == 2


def test_sums_do_not_depend_on_how_they_are_split(spark):
    coded = spark.createDataFrame([(f"p{i % 7}", i % 128, 1 + i % 3) for i in range(2000)], "part string, code int, n long")
    a = {r["part"]: bytes(r["total"]) for r in filter_audit.totals(coded.repartition(13), salts=3).collect()}
    b = {r["part"]: bytes(r["total"]) for r in filter_audit.totals(coded.coalesce(1), salts=1).collect()}
    assert a == b and len(a) == 7


def test_words_in_pieces_are_the_words():
    rng = random.Random(1)
    for _ in range(50):
        text = bytes(rng.choice(b"ab \t\n\x0b\x0c\r\x1c\x85\xc3") for _ in range(rng.randrange(200)))
        words = text.split()
        assert [w for p in word_pieces(text, rng.randrange(1, 9)) for w in p] == words
        assert word_counts(text) == (len(words), set(words))


# ---------------------------------------------------------------- op13


def plain_codes(rows, rounds=4, entries=256):
    kept = [(i, lab, [int(np.floor(1024 * float(c))) for c in v]) for i, lab, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept], np.int64)
    spans = vector_codes.cuts(x.shape[1])
    codes, error, numbers = [], np.zeros(len(x), np.int64), []
    for a, b in spans:
        p = x[:, a:b]
        book = p[:entries].copy()

        def near(book, p=p):
            return ((p[:, None, :] - book[None]) ** 2).sum(2)

        for _ in range(rounds):
            own = near(book).argmin(1)
            for e in set(own.tolist()):
                book[e] = np.floor_divide(p[own == e].sum(0), (own == e).sum())
        d = near(book)
        codes.append(d.argmin(1))
        error += d.min(1)
        numbers += book.reshape(-1).tolist()
    by = {}
    for (_, lab, _), e in zip(kept, error.tolist()):
        by[lab] = by.get(lab, 0) + e
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c[k]:02x}" for c in codes), int(error[k]), by[lab], digest) for k, (i, lab, _) in enumerate(kept))


def vectors(rng, n, dim=12, groups=9):
    centres = rng.normal(size=(groups, dim))
    return [(i, i % 5 or None, (centres[rng.integers(groups)] + 0.1 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def codes_of(df, **kw):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compress(df, **kw).collect())


SHAPE = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("n, dim, entries", [(900, 12, 256), (700, 8, 16), (40, 12, 256), (1, 4, 256), (60, 3, 8)])
def test_codes_equal_plain_kmeans(spark, monkeypatch, n, dim, entries):
    rng = np.random.default_rng(n)
    rows = vectors(rng, n, dim)
    rows += [(n + 1, 1, None), (n + 2, 1, []), (n + 3, 1, [float("nan")] + [0.0] * (dim - 1)), (n + 4, 1, [float("inf")] * dim), (n + 5, 1, [None] * dim)]
    if n > 100:
        rows += [(i, 2, rows[3][2]) for i in range(2000, 2300)]  # copies
        rows += [(3000, 1, [0.0] * dim), (0, 4, [0.5] * dim), (0, 4, [0.25] * dim)]
    df = clashing(spark.createDataFrame(rows, SHAPE).repartition(4))
    assert codes_of(df, entries=entries) == plain_codes(rows, entries=entries)


def test_codes_of_rows_without_id_and_of_an_empty_table(spark):
    rows = vectors(np.random.default_rng(5), 50) + [(None, 1, [0.5] * 12), (None, None, [0.5] * 12)]
    assert codes_of(spark.createDataFrame(rows, SHAPE)) == plain_codes(rows)
    assert vector_codes.compress(spark.createDataFrame([], SHAPE)).count() == 0


def test_huge_components_saturate(spark):
    rows = [(i, 1, [3e38 * (-1) ** i, float(i), 0.0, 1e30]) for i in range(300)]
    got = vector_codes.compress(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 300 and all(0 <= r["error"] <= r["label_error"] for r in got)


def test_every_ball_is_what_its_points_are():
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(-500, 500, (700, 5)), axis=0)
    weight = rng.integers(1, 9, len(points))
    tree = vector_codes.grow(points, weight, leaf=6)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and tree.start[0] == 0 and tree.end[0] == len(points)
    for i in range(len(tree.start)):
        own = tree.order[tree.start[i] : tree.end[i]]
        assert (tree.sums[i] == (points[own] * weight[own, None]).sum(0)).all() and tree.count[i] == weight[own].sum()
        assert np.sqrt(((points[own] - tree.sums[i] / tree.count[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
        if tree.left[i] >= 0:
            a, b = tree.left[i], tree.right[i]
            assert (tree.start[i], tree.end[a], tree.end[i]) == (tree.start[a], tree.start[b], tree.end[b])
        else:
            assert len(own) <= 6


def test_balls_are_owned_without_looking_at_points():
    rng = np.random.default_rng(4)
    centres = rng.integers(-9000, 9000, (20, 4))
    points = np.unique(centres[rng.integers(20, size=3000)] + rng.integers(-40, 40, (3000, 4)), axis=0)
    tree = vector_codes.grow(points, np.ones(len(points), np.int64))
    looked = sum(tree.end[at] - tree.start[at] for at, _, members in vector_codes.walk(tree, points, centres) if members is not None)
    assert looked < len(points) / 10
    own, _ = vector_codes._nearest(points, centres)
    assert (vector_codes.assigned(tree, points, centres) == own).all()


def test_distances_are_exact_above_doubles():
    points = np.array([[2**29, 1], [2**29, 3]])
    entries = np.array([[-(2**29), 2], [-(2**29), 4], [-(2**29), 2]])
    own, d = vector_codes._nearest(points, entries)
    assert own.tolist() == [0, 0] and d.tolist() == [2**60 + 1, 2**60 + 1]


def test_join_by_size_keeps_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(5000)], "key string, v int")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = {tuple(r) for r in join_by_size(rows, table, "key", "n").select("key", "v", "s").collect()}
    sums = {r["key"]: r["s"] for r in table.collect()}
    assert got == {(r["key"], r["v"], sums[r["key"]]) for r in rows.collect()} and len(got) == 5000


# ---------------------------------------------------------------- op12


def toxic_corpus(seed=1, n=900):
    rng = random.Random(seed)
    syllables = ["the", "re", "and", "ing", "tion", "ou", "er", "st", "wh", "ly"]
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(n):
        words = [plain() for _ in range(rng.randrange(8, 200))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nincompoop", "scoundrel", "wretch"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxic_documents_are_found_by_compression(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "blockhead wretch", "en", "s", 0), (1, rows[1][1], "en", "s", 0)]
    rows += [(5002, " \n " + rows[1][1] * 4000 + " blockhead the scoundrel", "en", "s", 0), (5003, "x" * 200_000, "en", "s", 0)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    lab = clashing(spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 1), (7000, 1, None)], LABELS))
    got = toxicity.classify(docs, lab).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {i: t for i, _, t in labels}
    tested = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 100 and sum(a == b for a, b in tested) / len(tested) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[5002]["predicted"] == 1 and by[None]["predicted"] == 1 and not by[None]["held_out"]
    assert by[5000]["score"] == by[5001]["score"] < 0.3 and by[5003]["predicted"] == 0


def test_long_labelled_texts_are_learnt_from(spark):
    rows, labels = toxic_corpus(2, 240)
    long = [(i, (t + " ") * 60, *rest) for i, t, *rest in rows]
    got = toxicity.classify(spark.createDataFrame(long, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    tested = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in tested) / len(tested) > 0.9


def test_without_labels_nothing_is_toxic(spark):
    rows, _ = toxic_corpus(3, 20)
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["score"] for r in toxicity.classify(docs, spark.createDataFrame([], LABELS)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), spark.createDataFrame([(1, 1, 1), (3, 1, 0)], LABELS)).count() == 0


def test_skipping_words_changes_no_evidence():
    rng = random.Random(8)
    toxic = [(w, 30) for w in (b"blockhead", b"wretch", b"scoundrel")]
    words = [bytes(rng.choice(b"etaoinshr") for _ in range(rng.randrange(2, 12))) for _ in range(400)]
    pairs = toxicity.train_pairs(toxic, [(w, 5) for w in words])
    whole = toxicity.Measurer(pairs).lengths(set(words) | {w for w, _ in toxic})
    wanted = frozenset(whole[w][0] for w, _ in toxic)
    some = toxicity.Measurer(pairs, wanted).lengths(set(whole))
    assert all(some[w] == (whole[w] if whole[w][0] in wanted else None) for w in whole)
