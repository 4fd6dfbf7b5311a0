"""The near-copy stage against brute-force Jaccard on five-word shingles."""

import random

import pytest
from small import docs, edge_rows, words

import corpus_pipeline
from ringsight.llm import near_copies


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def brute(rows):
    """Smallest doc_id of each component of rows at 0.8 or more."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d == e or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(d), top(e)))
                label[y] = x
    return {d: top(d) for d in label}


def planted(seed):
    """Pairs around 0.8: a replaced block, or edits here and there, of as many words as put the pair just above or below."""
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        base = words(rng, 300, 10**6)
        text = list(base)
        if i % 2:
            n, at = rng.choice([20, 26, 28, 29, 30, 31, 34, 45]), rng.randrange(240)
            text[at : at + n] = words(rng, n, 10**6)
        else:
            for at in rng.sample(range(300), rng.choice([4, 5, 6, 7, 8, 10])):
                text[at] = f"new{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(text))]
    return rows


@pytest.mark.parametrize("cell_shingles", [700, near_copies.CELL_SHINGLES])
def test_components_match_brute_force(spark, cell_shingles):
    rows = [*edge_rows(), *((1000 + d, t) for d, t in planted(5))]
    base = words(random.Random(6), 200, 10**6)  # a group that is split into cells: steps near each other, ends far apart
    rows += [(5000 + i, " ".join([*(f"x{i}y{k}" for k in range(2)), *base[2 * i : 2 * i + 120]])) for i in range(40)]
    want = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs(spark, rows, extra=True), cell_shingles).collect() if r["doc_id"] is not None}
    assert got == want
    pairs = [1000 + 2 * i for i in range(240)]
    assert 60 < sum(want[d] == want[d + 1] for d in pairs) < 180


def test_pipeline_stage_keeps_one_of_each_component(spark):
    rows = [*edge_rows(), *((1000 + d, t) for d, t in planted(8))]
    got = [r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs(spark, rows), "").select("doc_id").collect()]
    assert sorted(d for d in got if d is not None) == sorted(set(brute(rows).values())) and got.count(None) == 2


def test_empty_table(spark):
    assert near_copies.keep_one(docs(spark, [(1, "x")]).filter("doc_id = 2")).count() == 0
