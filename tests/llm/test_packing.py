import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from small import docs, edge_rows
from tokenizers import Tokenizer

from ringsight.llm import packing
from ringsight.llm.words import Lexicon, raw

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, window):
    """Gapless windows, no overlap, nothing over the window."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(window - sum(n for _, n in pieces) for pieces in by.values()) / (window * len(by))


@pytest.mark.parametrize("window,unit", [(4096, 16), (64, 4)])
def test_every_id_lies_in_one_piece(spark, window, unit):
    rows = [*edge_rows(), (50, "It's <|endoftext|> it’s x 12345 é ÉCOLE A don't!!"), (51, "x" * 700)]
    got = packing.pack(docs(spark, rows, extra=True), PATH, window, unit).collect()
    check_layout(got, window)
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), window):
            part = np.array(ids[at : at + window], "<u4")
            want.append((d, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)


def test_given_documents_have_little_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_layout(packing.pack(df, PATH).collect(), 4096) < 0.01


def test_empty_table(spark):
    assert packing.pack(docs(spark, [(1, "x")]).filter("doc_id = 2"), PATH).count() == 0


def test_lexicon_forgets_and_learns_again():
    lexicon = Lexicon(packing._learner(PATH), limit=6)
    tokenizer = Tokenizer.from_file(PATH)
    for texts in (["a b c d", "e f a", "", "d d d"], ["x<|endoftext|>y Z's", "a"], ["b b c", "é"]):
        buf, off = raw(pa.array(texts))
        made = [ids.tolist() for ids in packing.document_ids(buf, off, lexicon)]
        assert made == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert len(lexicon.keys) <= 6


def test_counts_never_ask_for_more_than_there_is():
    rng = np.random.default_rng(5)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 64), 40, replace=False), rng.integers(1, 50, 40), strict=True)}
    ranges, windows = packing.plan_windows(histogram, 64, 4)
    used, places = defaultdict(int), set()
    for length, first, end, base, slots, place in ranges:
        assert end <= histogram[length]
        for i in range(end - first):
            used[base + i // slots] += length
            places.add((base + i // slots, place + i % slots))
    assert len(places) == sum(histogram.values()) and max(used.values()) <= 64 and len(used) == windows


def test_least_squares_is_exact_where_it_can_be():
    combos = packing.combinations(8, 2)
    assert sorted(combos) == [(4, 4), (5, 3), (6, 2), (7, 1), (8,)]
    have = np.zeros(9)
    have[[8, 7, 1, 4]] = [3, 5, 5, 6]
    x = packing.solve_counts(combos, have)
    assert {combos[j]: round(v, 6) for j, v in enumerate(x) if v > 1e-6} == {(8,): 3, (7, 1): 5, (4, 4): 3}
