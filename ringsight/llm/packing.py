"""Packing of tokenised documents into fixed windows by non-negative least squares over the length histogram.

A document longer than the window is cut into full windows, which need no packing, and a rest. The rests are
packed whole. Their lengths form a histogram of at most ``window`` bins, whatever the corpus size, so planning is
bounded work on the driver while documents stay where they are:

1. lengths are rounded up to units; every combination of at most ``depth`` unit lengths that fills the window
   exactly is a column, and its repeat count is solved by non-negative least squares against the histogram;
2. counts are rounded down, so no combination asks for more documents than there are;
3. the documents left over are packed greedily, longest first into the fullest window with room, again on the
   histogram of their exact lengths.

The outcome is a list of (length, first ordinal, last ordinal) -> window slots. Each document learns its ordinal
among the documents of its length from counts per (length, shard), and looks its slot up. A length that a third of
all documents share is spread over the shards.

Null texts are empty documents, of one token (the end mark). Repeated rows are packed as often as they occur. An
empty table gives an empty result. Documents without an id are packed like any other. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringsight.llm.stages import settle
from ringsight.llm.words import Lexicon, chunks, raw, spans

WINDOW = 4096
UNIT = 16
DEPTH = 3
SHARD_ROWS = 50_000
MIN_SHARDS, MAX_SHARDS = 64, 65_536
END_ID = 2

PIECES = "doc_id long, part int, start long, length long, ids_crc32 long, doc_tokens long"


# ---------------------------------------------------------------- tokens


_SEPARATOR = "<|endoftext|>"
_JOINED = 256


def _learner(path: str):
    """Ids of white-space separated words. The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order. Words are encoded many at a time, with a special token between."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would hold memory of their own
    tokenizer = Tokenizer.from_file(path)
    mark = tokenizer.token_to_id(_SEPARATOR)

    def learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        alone = {i for i, t in enumerate(texts) if _SEPARATOR in t} if mark is not None else set(range(len(texts)))
        plain = [t for i, t in enumerate(texts) if i not in alone]
        made: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for at in range(0, len(plain), _JOINED * 64):
            groups = [plain[i : i + _JOINED] for i in range(at, min(at + _JOINED * 64, len(plain)), _JOINED)]
            for group, encoding in zip(
                groups, tokenizer.encode_batch_fast([_SEPARATOR.join(g) for g in groups], add_special_tokens=False), strict=True
            ):
                ids = np.array(encoding.ids, np.uint32)
                borders = np.flatnonzero(ids == mark)
                edge = np.concatenate([[-1], borders, [len(ids)]])
                if len(edge) != len(group) + 1:
                    raise ValueError("the special token does not separate words")
                made.append(np.delete(ids, borders))
                counts.append(np.diff(edge) - 1)
        ids = np.concatenate([np.zeros(0, np.uint32), *made])
        count = np.concatenate([np.zeros(0, np.int64), *counts])
        if alone:
            parts, own = np.split(ids, np.cumsum(count)[:-1]) if len(count) else [], iter(range(len(count)))
            rows = [
                np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in alone else parts[next(own)]
                for i, t in enumerate(texts)
            ]
            ids, count = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return ids, count, np.ones(len(words), bool)

    return learn


_LOADED: dict[str, Lexicon] = {}


def _lexicon(path: str) -> Lexicon:
    if path not in _LOADED:
        _LOADED[path] = Lexicon(_learner(path))
    return _LOADED[path]


def document_ids(buf: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> Iterator[np.ndarray]:
    """Token ids of each text, with the end mark."""
    start, end, words = spans(buf, off)
    ids, count, _ = lexicon.encode(buf, start, end)
    upto = np.concatenate([[0], np.cumsum(count)])
    bound = upto[np.concatenate([[0], np.cumsum(words)])]
    mark = np.array([END_ID], np.uint32)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        yield np.concatenate([ids[a:b], mark])


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per full window of a document and one for its rest, with the checksum of the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw(batch.column(1))
            keys = batch.column(0)
            for first, last in chunks(off, 1 << 20):
                rows: list[tuple[int, int, int, int, int, int]] = []
                part_off = off[first : last + 1] - off[first]
                for i, ids in enumerate(document_ids(buf[off[first] : off[last]], part_off, _lexicon(path))):
                    n = len(ids)
                    for part, start in enumerate(range(0, n, window)):
                        piece = ids[start : start + window].astype("<u4")
                        rows.append((first + i, part, start, len(piece), zlib.crc32(piece.tobytes()), n))
                cols = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *[pa.array(c) for c in cols[2:]]],
                    names=["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- plan on the histogram


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``depth`` lengths, longest first."""
    found: list[tuple[int, ...]] = []

    def extend(done: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(done)
        elif len(done) < depth:
            top = min(left, done[-1] if done else units)
            for u in range(top, 0, -1):
                if u * (depth - len(done)) < left:
                    break
                extend((*done, u), left - u)

    extend((), units)
    return found


def solve_counts(combos: list[tuple[int, ...]], have: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative least squares by active sets: min ||W (A x - have)||, x >= 0.

    A has one column per combination (how often it uses each unit length). Long lengths weigh more, since they
    can't be placed later. The matrix is only ever touched by its few non-zeros; the dense systems have at most one
    column per unit length.
    """
    units = len(have) - 1
    weight = np.sqrt(np.arange(units + 1) / units) * (have > 0)
    use = np.zeros((len(combos), max(map(len, combos))), np.int64)
    for j, c in enumerate(combos):
        use[j, : len(c)] = c
    possible = np.array([all(have[u] for u in c) for c in combos])
    x = np.zeros(len(combos))
    active: list[int] = []
    target = weight * have

    def columns(js: list[int]) -> np.ndarray:
        a = np.zeros((units + 1, len(js)))
        for k, j in enumerate(js):
            np.add.at(a[:, k], list(combos[j]), 1)
        return a * weight[:, None]

    residual = target.copy()
    tolerance = 1e-9 * max(1.0, float(target.sum()))
    for _ in range(rounds):
        pull = (weight * residual)[use].sum(1)  # unit 0 pads shallow combinations and has weight 0
        pull[~possible] = -np.inf
        pull[active] = -np.inf
        best = int(np.argmax(pull))
        if not pull[best] > tolerance:
            break
        active.append(best)
        while True:
            a = columns(active)
            z = np.linalg.lstsq(a, target, rcond=None)[0]
            if z.min() > 0:
                x[active] = z
                break
            old = x[active]
            falling = z <= 0
            gap = np.maximum(old[falling] - z[falling], 1e-300)
            step = float(np.min(old[falling] / gap))
            new = old + step * (z - old)
            new[falling & (new <= 1e-12)] = 0
            if not (new == 0).any():
                new[np.argmin(np.where(falling, new, np.inf))] = 0
            x[active] = new
            active = [j for j, v in zip(active, new, strict=True) if v > 0]
            if not active:
                break
        a = columns(active)
        residual = target - a @ x[active] if active else target.copy()
    return x


def greedy(lengths: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest window with room, counts at a time: (lengths of one window, repeats)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            fit = [g for g in room if g >= length]
            if not fit:
                per = min(window // length, left)
                whole, rest = divmod(left, per)
                for size, times in ((per, whole), (rest, 1)):
                    if size and times:
                        room.setdefault(window - size * length, []).append(((length,) * size, times))
                left = 0
                continue
            gap = min(fit)
            combo, times = room[gap].pop()
            if not room[gap]:
                del room[gap]
            per = min(gap // length, max(1, left // times))
            took = min(times, left // per)
            if took < times:
                room.setdefault(gap, []).append((combo, times - took))
            room.setdefault(gap - per * length, []).append(((*combo, *((length,) * per)), took))
            left -= took * per
    return [entry for entries in room.values() for entry in entries]


def plan_windows(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH):
    """Slots for every document length: rows (length, first ordinal, end ordinal, window base, slots per window, place).

    Ordinals count the documents of one length from 0. Document ``first + i`` of a row goes to window
    ``base + i // slots``, at place ``place + i % slots`` there.
    """
    units = window // unit
    bins: dict[int, list[int]] = {}
    for length in sorted(histogram, reverse=True):
        bins.setdefault(-(-length // unit), []).append(length)
    have = np.zeros(units + 1)
    for u, ls in bins.items():
        have[u] = sum(histogram[n] for n in ls)
    ranges: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    base = 0

    def fill(length: int, count: int, first_window: int, slots: int, place: int) -> None:
        ranges.append((length, taken[length], taken[length] + count, first_window, slots, place))
        taken[length] += count

    if histogram:
        combos = combinations(units, depth)
        counts = np.floor(solve_counts(combos, have) + 1e-9).astype(np.int64)
        left = have.astype(np.int64)
        order = [j for j in np.argsort(-counts, kind="stable") if counts[j] > 0]
        for j in order:
            need: dict[int, int] = {}
            for u in combos[j]:
                need[u] = need.get(u, 0) + 1
            times = int(min([counts[j], *(left[u] // k for u, k in need.items())]))
            if times <= 0:
                continue
            place = 0
            for u, k in need.items():
                left[u] -= k * times
                done = 0
                while done < k * times:
                    length = next(n for n in bins[u] if taken[n] < histogram[n])
                    # whole windows of this length, or the head or tail of one that changes length inside
                    inside = done % k
                    got = min(histogram[length] - taken[length], k * times - done)
                    if inside:
                        got = min(got, k - inside)
                        fill(length, got, base + done // k, k, place + inside)
                    elif got >= k:
                        got -= got % k
                        fill(length, got, base + done // k, k, place)
                    else:
                        fill(length, got, base + done // k, k, place)
                    done += got
                place += k
            base += times
        rest = {n: histogram[n] - taken[n] for n in histogram if histogram[n] > taken[n]}
        for combo, times in greedy(rest, window):
            place = 0
            need = {}
            for n in combo:
                need[n] = need.get(n, 0) + 1
            for n, k in need.items():
                fill(n, k * times, base, k, place)
                place += k
            base += times
    return ranges, base


# ---------------------------------------------------------------- documents to slots


def pack(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    written = settle(token_pieces(docs, path, window))
    shards = min(max(written.count() // SHARD_ROWS, MIN_SHARDS), MAX_SHARDS)
    pieces = written.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    per_shard = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(window, 0)
    ranges, windows = plan_windows(histogram, window, unit, depth)
    if full:
        ranges.append((window, 0, full, windows, 1, 0))

    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_shard.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = (
        pieces.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(bases, ["length", "shard"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("_nth")).alias("ordinal"))
    )
    table = np.array(sorted(ranges), np.int64).reshape(-1, 6)
    span = int(max([1, *table[:, 2]])) + 1  # one key orders (length, ordinal)
    assert (window + 1) * span < 2**63
    keys = table[:, 0] * span + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            ordinal = batch.column(5).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * span + ordinal, side="right") - 1]
            nth = ordinal - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"],
            )

    placed = numbered.mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    )
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
