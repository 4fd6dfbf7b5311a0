import numpy as np
import pyarrow as pa

from ringsight.llm.words import Lexicon, hashes, raw, spans


def cut(texts):
    buf, off = raw(pa.array(texts))
    return buf, *spans(buf, off)[:2]


def test_blocks_in_another_order_are_another_word():
    a, b = "-" * 64, "=" * 64
    words = [a + b + b + a, b + a + a + b, a + b, b + a, "-" * 64, "-" * 65, "-" * 256]
    assert len(set(hashes(*cut([" ".join(words)])).tolist())) == len(words)


def test_hash_does_not_depend_on_the_other_words():
    words = ["a", "bc", "x" * 64, "y" * 65, "z" * 300, "é" * 70]
    alone = [int(hashes(*cut([w]))[0]) for w in words]
    assert hashes(*cut([" ".join(words)])).tolist() == alone


def test_lexicon_keeps_long_words_apart():
    a, b = "-" * 64, "=" * 128
    known = {}

    def learn(new):
        ids = np.array([known.setdefault(w, len(known)) for w in new], np.uint32)
        return ids, np.ones(len(new), np.int32), np.ones(len(new), bool)

    words = [a + b + a, "=" * 64 + "-" * 128 + "=" * 64]
    ids, _, _ = Lexicon(learn).encode(*cut([" ".join(words)]))
    assert [known[w.encode()] for w in words] == ids.tolist()
