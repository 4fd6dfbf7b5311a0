import hashlib
import random
import re

import numpy as np
import pytest
from small import docs, edge_rows, words
from xxhash import xxh64_intdigest

from ringsight.llm import components, simhash_dedup, substring_dedup
from ringsight.llm.words import raw, spans

SPACE = re.compile("[^\x20\x09-\x0d]+")


def brute_repeats(rows, window):
    """Every window of every text against the smallest doc_id that has it."""
    cut = [(d, SPACE.findall(t or "")) for d, t in rows]
    least = {}
    for d, ws in cut:
        if d is not None:
            for i in range(len(ws) - window + 1):
                key = tuple(ws[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, ws in cut:
        gone = set()
        for i in range(len(ws) - window + 1):
            if d is not None and least[tuple(ws[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, " ".join(w for i, w in enumerate(ws) if i not in gone), len(ws), len(gone)))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


@pytest.mark.parametrize("window,anchor", [(13, 4), (6, 3)])
def test_repeats_match_brute_force(spark, window, anchor):
    rows = edge_rows()
    got = substring_dedup.remove_repeats(docs(spark, rows, extra=True), window, anchor)
    got = [(r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(rows, window), key=key)


def test_repeats_with_few_words_in_common_anchors(spark):
    """Few different words: the same anchors everywhere, many windows of one anchor, repeats inside a document."""
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(10, 90), 3))) for i in range(300)]
    got = substring_dedup.remove_repeats(docs(spark, rows), 8, 3)
    got = [(r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(rows, 8), key=key)


def marked(df):
    """Every marked window by itself: (doc, version and place)."""
    return {(r["doc"], r["at"] + i) for r in df.collect() for i in range(31) if r["mask"] >> i & 1}


def test_hot_anchors_meet_window_by_window(spark):
    """A run of words in many different contexts, with repeats among them: the same places, however many anchors count as hot."""
    rng = random.Random(11)
    run = "of the and a".split()
    texts = [words(rng, 9, 40) + run + words(rng, 9, 40) for _ in range(400)]
    texts += [words(rng, 3) + t + words(rng, 3) for t in texts[:60]]
    table = docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(run * 9)), (7, None)])
    plain = marked(substring_dedup.repeats(substring_dedup.seeds(table)))
    some = substring_dedup.hot_anchors(table, least=20, counters=4096)
    every = substring_dedup.hot_anchors(table, least=0, counters=10**6)
    assert 0 < len(some) < len(every)
    assert len(plain) >= 60 * 10
    for hot in (some, every):
        found = substring_dedup.seeds(table, hot=hot)
        assert marked(substring_dedup.repeats(found)) == plain
    most = substring_dedup.seeds(table, hot=some).groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert most < 60  # 460 places of the run's anchor before
    assert len(substring_dedup.hot_anchors(table.limit(0), least=0)) == 0


def test_small_partitions_send_their_frequent_anchors_alone(spark):
    """Counters that leave a task are few, however small its share of the table is; the common run is still hot."""
    rng = random.Random(12)
    run = "of the and a".split()
    rows = [(i, " ".join(words(rng, 9, 4000) + run + words(rng, 9, 4000))) for i in range(4000)]
    table = docs(spark, rows).repartition(40)
    counts = substring_dedup.anchor_counts(table, least=8 * substring_dedup.TASKS).filter("anchor is not null")
    assert 0 < counts.count() <= 5 * 40  # about 100 different anchors of 100 texts in each task before
    assert [r["anchor"] % 2**64 for r in counts.groupBy("anchor").sum("n").filter("`sum(n)` > 2000").collect()] != []
    assert len(substring_dedup.hot_anchors(table, least=2000)) >= 1


def test_windows_of_one_anchor_over_many_batches(spark):
    """What a task remembers of an anchor comes from batches of one to a hundred rows alike."""
    rng = random.Random(12)
    table = docs(spark, [(i, " ".join(words(rng, 30, 2))) for i in range(500)])
    found = substring_dedup.seeds(table, 8, 3)
    whole = marked(substring_dedup.repeats(found))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows in (1, 7, 100):
            spark.conf.set(size, rows)
            assert marked(substring_dedup.repeats(found)) == whole
    finally:
        spark.conf.set(size, before)


def test_counters_miss_no_frequent_key():
    rng = np.random.default_rng(5)
    keys, counts, all_keys = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for _ in range(50):
        new = np.concatenate([rng.integers(100, 10**6, 900), np.full(100, 7), rng.integers(0, 5, 60)]).astype(np.uint64)
        all_keys.append(new)
        keys, counts = substring_dedup._summed(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]), 200)
        assert len(keys) <= 200
    total = np.concatenate(all_keys)
    for k in (7, 0, 1, 2, 3, 4):
        true = int((total == k).sum())
        kept = int(counts[keys == k].sum())
        assert true - len(total) // 200 <= kept <= true


def test_texts_that_share_a_doc_id(spark):
    rng = random.Random(4)
    a, b = words(rng, 40), words(rng, 40)
    rows = [(1, " ".join(a)), (2, " ".join(b + a[:20])), (2, " ".join(a[5:30] + b)), (2, " ".join(b + a[:20]))]
    got = substring_dedup.remove_repeats(docs(spark, rows))
    got = [(r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(rows, 13), key=key)


def test_empty_tables(spark):
    empty = docs(spark, [(1, "x")]).filter("doc_id = 2")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.keep_one(empty).count() == 0


def brute_print(text):
    ws = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(nodes, close):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and close(a, b):
                    label[a] = label[b]
                    changed = True
    return label


def test_near_duplicates_match_brute_force(spark):
    rows = [*edge_rows(), (40, "Some TEXT with Ärger"), (41, "some text with Ärger"), (42, "SOME text with ärger")]
    got = simhash_dedup.near_duplicates(docs(spark, rows, extra=True)).collect()
    prints = [(d, brute_print(t)) for d, t in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & (2**64 - 1)) for r in got) == sorted((d is None, d or 0, f) for d, f in prints)
    own = {}
    for d, f in prints:
        if d is not None:
            own.setdefault(d, set()).add(f)
    near = brute_components(sorted(own), lambda a, b: any((x ^ y).bit_count() <= 3 for x in own[a] for y in own[b]))
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(near.items())
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("cell_rows", [5, 2048])
@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_every_plan_finds_all_links(spark, cell_rows, parts):
    """Clusters around centres, chains of single steps, and far values; keys beyond the cell size are split."""
    rng = random.Random(parts)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    step = rng.getrandbits(64)
    for _ in range(20):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(step)
    values = sorted(values)
    sample = np.array(values, np.uint64)
    groups = simhash_dedup.partition_bits(sample, parts)
    assert sorted(b for g in groups for b in g) == list(range(64))
    _, chosen = simhash_dedup.allocate(sample, groups, len(values))
    assert sum(chosen) == 3 - parts + 1
    plan = [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, 0, i) for i, v in enumerate(values)], "fp long, fp2 long, root long")
    edges = simhash_dedup.links(df, plan, cell_rows=cell_rows)
    got = {values[r["node"]]: values[r["component"]] for r in components.components(edges).collect()}
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    classes = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert classes({v: got.get(v, v) for v in values}) == classes(want)


@pytest.mark.parametrize("near", [None, simhash_dedup.COPIES])
def test_keep_one(spark, near):
    rows = edge_rows()
    got = [r["doc_id"] for r in simhash_dedup.keep_one(docs(spark, rows, extra=True), near=near).collect()]
    found = simhash_dedup.near_duplicates(docs(spark, rows), near=near).collect()
    want = {r["component_id"] for r in found if r["doc_id"] is not None}
    named = [d for d in got if d is not None]
    assert sorted(named) == sorted(want) and got.count(None) == 2


def test_wider_search_matches_brute_force(spark):
    """Copies with some words changed: linked by both fingerprints, however the plan splits the bits."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = words(rng, 150, 3000)
        for j in range(4):
            text = list(base)
            for _ in range(2 * j):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((4 * i + j, " ".join(text)))
    near = simhash_dedup.COPIES
    found = simhash_dedup.near_duplicates(docs(spark, rows), near=near).collect()
    prints = {d: simhash_dedup.fingerprint(t.encode(), 3, 5) for d, t in rows}
    apart = lambda a, b, k: (prints[a][k] ^ prints[b][k]).bit_count()
    linked = lambda a, b: apart(a, b, 0) <= 3 or (apart(a, b, 0) <= near.radius and apart(a, b, 1) <= near.confirm)
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(sorted(prints), linked)
    assert all(r["component_id"] // 4 == r["doc_id"] // 4 for r in found)
    assert sum(r["component_id"] == r["doc_id"] for r in found) < 150


def test_doc_ids_tie_their_rows(spark):
    """Rows of one doc_id, also where that id is the smallest of another fingerprint's rows."""
    rng = random.Random(13)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (4, c), (5, " ".join(words(rng, 60)))]
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r["component"] for r in components.components(edges).collect()} == {0}


def test_words_on_bytes_equal_the_pattern():
    import pyarrow as pa

    texts = ["a  b\n", None, "", "é x\x0b y\x1c z", " lead", "trail ", "x" * 200 + " " + "y" * 70]
    buf, off = raw(pa.array(texts))
    start, end, count = spans(buf, off)
    flat = [bytes(buf[a:b]).decode() for a, b in zip(start, end, strict=True)]
    assert flat == [w for t in texts for w in SPACE.findall(t or "")]
    assert count.tolist() == [len(SPACE.findall(t or "")) for t in texts]
    sliced = pa.array(["zz", *texts]).slice(1)
    assert bytes(raw(sliced)[0]) == bytes(buf)


def test_digest_of_kept_words():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
