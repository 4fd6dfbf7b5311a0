"""SentencePiece models on the tokenizers library: encoding, decoding and a parity check.

The model file is read as a protocol buffer message: pieces with scores and types, the model kind, the normaliser's options. From
them the tokenizers library gets its normaliser (character map, dummy prefix, white space), the metaspace
marker, either a unigram model with the scores or a BPE model whose merges follow from the scores, and byte fallback.

If no piece has the marker behind another character, no piece crosses the start of a word; then texts are cut there, and
each worker remembers the ids of words up to a bound. New words are encoded in multithreaded batches. Parity is
checked where ids are made: whatever the library encodes, the original implementation encodes too, and a row says
whether all its parts agree. Other models, and those with a character map, are encoded and checked text by text.

Null texts count as empty and have no ids. Very long texts are encoded whole. Repeated rows are encoded alike. An empty table gives an empty
result. Columns other than the named ones are not read. Known limit: a unigram model may match the spelling of a byte piece
(such as <0x0A>) in a text, where the original doesn't; the parity flag shows it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.llm.words import Lexicon, chunks, raw, spans

MARK = "▁"
BATCH = 2048
THREADS = "2"  # of an encoding batch
#: Fixed values of the message format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message; nested messages and texts as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            raise ValueError(f"wire type {kind} at byte {at}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    suffix_mark: bool = False

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(data: bytes) -> Model:
    """Read a model file."""
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            own = dict(fields(value))
            model.kind = own.get(3, UNIGRAM)
            model.byte_fallback = bool(own.get(35, 0))
            model.suffix_mark = bool(own.get(24, 0))
        elif number == 3:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix = bool(own.get(3, 1))
            model.squeeze_spaces = bool(own.get(4, 1))
            model.escape_spaces = bool(own.get(5, 1))
    if model.kind not in (UNIGRAM, BPE) or model.suffix_mark or not model.escape_spaces:
        raise ValueError("only unigram and BPE models with a leading marker are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order of its score."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    order = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    made = sorted((p for p in score if len(p) > 1), key=lambda p: (-score[p], order[p]))
    return [(p[:i], p[i:]) for p in made for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


def words_stand_alone(model: Model) -> bool:
    """No piece crosses the start of a word, and normalising leaves every character where it is."""
    return not model.charsmap and not model.squeeze_spaces and model.dummy_prefix and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in model.pieces)


def build(model: Model, prefix: bool = True):
    """The tokenizer; without ``prefix`` for parts of a text that have their marker already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = model.pieces[model.unknown][0]
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        # a control piece is never found in a text: it keeps its id under a name that no text has
        hidden = lambda i, p, kind: f"\U0010ffff{i}\U0010ffff" if kind in (CONTROL, UNUSED) else p
        core = models.Unigram([(hidden(i, p, kind), s) for i, (p, s, kind) in enumerate(model.pieces)], model.unknown, model.byte_fallback)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


class Codec:
    """A model in a worker."""

    def __init__(self, data: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        model = parse(data)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = words_stand_alone(model)
        self.tokenizer = build(model, prefix=not self.by_word)
        self.lexicon = Lexicon(self._learn) if self.by_word else None

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, count, good = [np.zeros(0, np.uint32)], [], []
        for at in range(0, len(parts), BATCH):
            texts = [p.decode("utf-8", "replace") for p in parts[at : at + BATCH]]
            made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            # the original puts the first marker in front by itself
            want = self.original.encode([t[1:] for t in texts], num_threads=1)
            rows = [m.ids for m in made]
            ids.append(np.fromiter((i for row in rows for i in row), np.uint32))
            count += [len(row) for row in rows]
            good += [row == (w if len(t) > 1 else self._bare()) for t, row, w in zip(texts, rows, want, strict=True)]
        return np.concatenate(ids), np.array(count, np.int64), np.array(good, bool)

    def _bare(self) -> list[int]:
        """A marker alone: the original gives no ids for an empty text."""
        return self.original.piece_to_id([MARK])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether the original implementation gives the same."""
        if not self.by_word:
            plain = [t.decode("utf-8", "replace") for t in texts]
            made = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
            for m, want in zip(made, self.original.encode(plain, num_threads=1), strict=True):
                yield np.array(m.ids, np.uint32), m.ids == want
            return
        marked = [b" " + t.replace(_MARK_BYTES, b" ") if t else b"" for t in texts]
        buf = np.frombuffer(b"".join(marked), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in marked], dtype=np.int64)])
        start, end, _ = spans(buf, off, _BLANK)
        # a part reaches from the end of the word before, so it has all markers in front; markers at the end of a text are a part
        owner = np.searchsorted(off, start, side="right") - 1
        begin = off[owner]
        begin[1:] = np.maximum(begin[1:], end[:-1])
        last = np.concatenate([[0], np.maximum.accumulate(end)])[np.searchsorted(start, off[1:])]
        tail = np.maximum(last, off[:-1])
        tail_rows = np.flatnonzero(tail < off[1:])
        begin = np.concatenate([begin, tail[tail_rows]])
        end = np.concatenate([end, off[1:][tail_rows]])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        ids, count, good = self.lexicon.encode(buf, begin, end)
        edge = np.searchsorted(begin, off)
        upto = np.concatenate([[0], np.cumsum(count)])[edge]
        bad = np.concatenate([[0], np.cumsum(~good)])[edge]
        for i in range(len(texts)):
            yield ids[upto[i] : upto[i + 1]], bool(bad[i + 1] == bad[i])


_MARK_BYTES = MARK.encode()
_BLANK = np.zeros(256, bool)
_BLANK[32] = True
_LOADED: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _LOADED:
        with open(path, "rb") as f:  # a library's file, installed on every machine
            _LOADED[path] = Codec(f.read())
    return _LOADED[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids and parity for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            buf, off = raw(batch.column(1))
            for a, b in chunks(off, 1 << 19):
                data = buf[off[a] : off[b]].tobytes()
                edge = (off[a : b + 1] - off[a]).tolist()
                rows = list(codec.encode([data[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]))
                size = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int32), *[r[0] for r in rows]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(size), pa.array(values)), pa.array([r[1] for r in rows], pa.bool_())],
                    names=["key", "ids", "parity"],
                )

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, ids array<int>, parity boolean").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text for every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = [r or [] for r in batch.column(1).slice(a, 256).to_pylist()]
                texts = codec.tokenizer.decode_batch(rows, skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), parity and round_trip (decoding gives the text) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            buf, off = raw(batch.column(1))
            for a, b in chunks(off, 1 << 19):
                data = buf[off[a] : off[b]].tobytes()
                edge = (off[a : b + 1] - off[a]).tolist()
                texts = [data[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
                rows = list(codec.encode(texts))
                back = [
                    text
                    for i in range(0, len(rows), 32)
                    for text in codec.tokenizer.decode_batch([r[0].tolist() for r in rows[i : i + 32]], skip_special_tokens=False)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(r[0]) for r in rows], pa.int64()),
                        pa.array([zlib.crc32(r[0].astype("<u4").tobytes()) for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.bool_()),
                        pa.array([t.encode() == o for t, o in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    names=["key", "n_tokens", "ids_crc32", "parity", "round_trip"],
                )

    schema = "key long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
