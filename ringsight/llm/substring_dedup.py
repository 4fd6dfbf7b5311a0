"""Exact removal of repeated passages: seeds from winnowed anchors, extension to every window around them.

A window is ``WINDOW`` consecutive words. Among the ANCHOR-word runs inside a window the one with the smallest hash
is its anchor (the leftmost of equals), so equal windows have equal anchors at equal places, and about one word in
five starts an anchor. An anchor travels once, with the digests of the windows that hang on it: those windows are
its extension to both sides as far as it stays their anchor, and the neighbouring anchors carry on from there, so a
maximal repeat is covered by the anchors inside it. Where anchors meet, a window whose digest was seen in a smaller
doc_id is a repeat. All windows of a maximal repeat are then joined in the document, which leaves exactly the words
of repeats that are at least WINDOW long.

Anchors of a group arrive by ascending doc_id and pass through in a stream: what a task remembers are the distinct
windows of the current anchor, not its occurrences, and no pairs are built. Copies of a passage inside one Arrow
chunk are settled before the shuffle. Window digests have 48 bits beside the 64 of their anchor, both must agree.

An anchor that is frequent in the whole table (``hot_anchors``, mergeable counters over all documents) is no place to
meet: each of its windows travels alone, under a key made of anchor and window, so that its different windows are
dealt over all tasks. Which anchors are taken for hot changes where windows meet, never what is found.

Null texts and texts of fewer than WINDOW words lose nothing. Rows without doc_id neither lose words nor make
others lose any. Rows that share a doc_id never count as smaller than each other; each loses what smaller ids
repeat. Equal windows inside one document stay. ``remove_repeats`` adds columns and replaces those of their names; ``without_repeats`` changes
text alone and passes every other column, whatever its name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.llm.columns import free_name
from ringsight.llm.stages import settle
from ringsight.llm.words import U64, chunks, hashes, mix, raw, rolled, spans

WINDOW = 13
ANCHOR = 4
DIGEST = 6

_SEEDS = "anchor long, doc long, at long, n int, digests binary"
_MARKS = "doc long, at long, mask int"
_COUNTS = "anchor long, n long"
HOT_SEEDS = 32_768  # an anchor may have so many places anyway
COUNTERS = 65_536  # of one task; an anchor with over four in COUNTERS of all places is always found, and at most half as many are
TASKS = 2_048  # so many tasks together may keep to themselves as many places as an anchor may have anyway
_VERSION = 40  # bits of a place below the version of the text


def _version(buf: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, h: np.ndarray) -> np.ndarray:
    """16 bits that tell apart texts which share a doc_id."""
    if not len(h):
        return np.zeros(len(count), np.int64)
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(h * (np.arange(len(h), dtype=U64) * U64(2) + U64(1)), dtype=U64)])
    at = np.concatenate([[0], np.cumsum(count)])
    # place inside the text, not inside the chunk: subtract the chunk offset from every factor
    plain = np.concatenate([np.zeros(1, U64), np.cumsum(h, dtype=U64)])
    value = (upto[at[1:]] - upto[at[:-1]]) - (plain[at[1:]] - plain[at[:-1]]) * (at[:-1].astype(U64) * U64(2))
    return (mix(value) >> U64(48)).astype(np.int64) & 0x7FFF


def _minimum_places(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every run of ``width`` values."""
    n = len(g) - width + 1
    low, at = g[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, width):
        other = g[i : i + n]
        less = other < low
        low[less] = other[less]
        at[less] = i
    return at + np.arange(n)


def _anchored(h: np.ndarray, count: np.ndarray, known: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...] | None:
    """Starts of all windows, their texts, the key of each window's anchor, and where in this list an anchor begins."""
    if len(h) < window:
        return None
    text = np.repeat(np.arange(len(count)), count)
    whole = np.flatnonzero((text[: len(h) - window + 1] == text[window - 1 :]) & known[text[: len(h) - window + 1]])
    if not len(whole):
        return None
    g = rolled(h, anchor)
    place = _minimum_places(g, window - anchor + 1)[whole]
    return whole, text[whole], g[place], np.concatenate([[True], place[1:] != place[:-1]])


def _seeds(
    ids: np.ndarray, known: np.ndarray, buf: np.ndarray, off: np.ndarray, window: int, anchor: int, hot: np.ndarray
) -> pa.RecordBatch | None:
    start, end, count = spans(buf, off)
    h = hashes(buf, start, end)
    found = _anchored(h, count, known, window, anchor)
    if found is None:
        return None
    whole, text, run, begins = found
    alone = np.isin(run, hot)
    head = np.flatnonzero(begins | alone)
    n = np.diff(np.append(head, len(whole)))
    first, owner = whole[head], text[head]
    first_word = np.cumsum(count) - count
    doc = ids[owner]
    at = (_version(buf, start, end, count, h)[owner] << _VERSION) | (first - first_word[owner])
    w = rolled(h, window)
    key = np.where(alone[head], mix(run[head] ^ mix(w[first])), run[head])
    # the first and the last window hold all words that the windows of an anchor touch
    content = mix(mix(w[first] ^ key) + w[first + n - 1] * U64(3) + n.astype(U64))
    order = np.lexsort((doc, content))
    same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
    group = np.cumsum(~same) - 1
    least = doc[order][np.flatnonzero(~same)][group]
    settled = np.zeros(len(head), bool)
    settled[order] = doc[order] > least
    digests = np.ascontiguousarray(w[whole].view(np.uint8).reshape(-1, 8)[:, :DIGEST])
    keep = np.repeat(~settled, n)
    sent = np.where(settled, 0, n)
    spread = mix(key + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    offsets = np.concatenate([[0], np.cumsum(sent * DIGEST)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(digests[keep].tobytes())])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(settled, spread, key).view(np.int64)),
            pa.array(doc),
            pa.array(at),
            pa.array(n.astype(np.int32)),
            binary,
        ],
        names=["anchor", "doc", "at", "n", "digests"],
    )


def _summed(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` counters; what the largest one left out counts is taken from all of them."""
    keys, back = np.unique(keys, return_inverse=True)
    counts = np.bincount(back, counts).astype(np.int64)
    if len(keys) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def hot_anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, least: int = HOT_SEEDS, counters: int = COUNTERS) -> np.ndarray:
    """Keys of the anchors that have more than ``least`` places and a large share of all of them, at most half as many as ``counters``.

    Each task counts all its anchors in bounded memory. Its counters are too low by one in ``counters`` of its places at most, and those
    below that share stay with it, so sums are too low by two in ``counters`` at most. In small partitions that share is less than one
    place; there counters of up to one in ``TASKS`` of ``least`` stay too, so that tasks send their frequent anchors, not all of them.
    """
    counted = settle(anchor_counts(docs, window, anchor, least, counters).groupBy("anchor").agg(F.sum("n").alias("n")))
    places = counted.filter("anchor is null").first()
    limit = max(least, 2 * (places["n"] if places else 0) // counters)
    hot = counted.filter(F.col("anchor").isNotNull() & (F.col("n") > limit)).select("anchor").toArrow().column(0)
    return np.sort(hot.to_numpy().astype(np.int64)).view(U64)


def anchor_counts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, least: int = HOT_SEEDS, counters: int = COUNTERS) -> DataFrame:
    """Places of the frequent anchors of each task, and of all its anchors (null)."""

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            buf, off = raw(batch.column(1))
            for a, b in chunks(off):
                part = buf[off[a] : off[b]]
                start, end, count = spans(part, off[a : b + 1] - off[a])
                found = _anchored(hashes(part, start, end), count, known[a:b], window, anchor)
                if found is not None:
                    new = found[2][found[3]]
                    total += len(new)
                    keys, counts = _summed(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]), counters)
        sent = (counts * counters > total) & (counts > least // TASKS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *keys[sent].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[sent].tolist()], pa.int64())],
            names=["anchor", "n"],
        )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count_up, _COUNTS)


def seeds(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: np.ndarray | None = None) -> DataFrame:
    """Anchors of all documents with the digests of their windows. Without digests: all its windows are repeats already."""
    hot = np.zeros(0, U64) if hot is None else hot

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            buf, off = raw(batch.column(1))
            for a, b in chunks(off):
                made = _seeds(ids[a:b], known[a:b], buf[off[a] : off[b]], off[a : b + 1] - off[a], window, anchor, hot)
                if made is not None:
                    yield made

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, _SEEDS)


def _pushed(runs: list[tuple[np.ndarray, np.ndarray]], windows: np.ndarray, docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs with one more; runs that are not longer than it are merged, so each window is merged a logarithmic number of times."""
    runs = list(runs)
    while runs and len(runs[-1][0]) <= 2 * len(windows):
        more, theirs = runs.pop()
        windows, docs = np.concatenate([windows, more]), np.concatenate([docs, theirs])
        order = np.lexsort((docs, windows))
        first = np.concatenate([[True], windows[order][1:] != windows[order][:-1]])
        windows, docs = windows[order][first], docs[order][first]
    return [*runs, (windows, docs)]


def repeats(found: DataFrame) -> DataFrame:
    """Places whose windows occur in a smaller doc_id: (doc, at, mask), bit i of mask for the window at ``at + i``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []  # sorted windows of the current anchor and the smallest doc of each, in runs of falling size
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            column = batch.column(4)
            edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            size = np.diff(edge) // DIGEST
            done = size == 0
            outs = [(doc[done], at[done], (1 << n[done].astype(np.int64)) - 1)]
            open_rows = np.flatnonzero(~done)
            if len(open_rows):
                k = key[open_rows]
                fresh = np.concatenate([[True], k[1:] != k[:-1]])
                group = np.cumsum(fresh) - 1
                many = np.bincount(group)[group] > 1
                last = group == group[-1]
                carried = (group == 0) & (k[0] == held_key if held_key is not None else False)
                rows = np.flatnonzero(many | last | carried)
                take = open_rows[rows]
                count = size[take]
                total = int(count.sum())
                before = np.cumsum(count) - count
                row_of = np.repeat(np.arange(len(take)), count)
                pos = (np.arange(total) - np.repeat(before, count)) * DIGEST + np.repeat(edge[take], count)
                data = np.frombuffer(column.buffers()[2], np.uint8)
                wide = np.zeros((total, 8), np.uint8)
                for i in range(DIGEST):
                    wide[:, i] = data[pos + i]
                digest = wide.view(U64).reshape(-1)
                g, d = group[rows][row_of], doc[take][row_of]
                order = np.lexsort((d, digest, g))
                head = np.concatenate([[True], (digest[order][1:] != digest[order][:-1]) | (g[order][1:] != g[order][:-1])])
                least = np.empty(total, np.int64)
                least[order] = d[order][np.flatnonzero(head)][np.cumsum(head) - 1]
                if carried.any():
                    mine = np.flatnonzero(g == 0)
                    for windows, docs in held:
                        where = np.minimum(np.searchsorted(windows, digest[mine]), len(windows) - 1)
                        same = windows[where] == digest[mine]
                        least[mine[same]] = np.minimum(least[mine[same]], docs[where[same]])
                again = d > least
                mask = np.add.reduceat(again.astype(np.int64) << (np.arange(total) - np.repeat(before, count)), before)
                hit = mask > 0
                outs.append((doc[take][hit], at[take][hit], mask[hit]))
                end = order[head & (g[order] == group[-1])]
                held = _pushed(held if held_key == int(k[-1]) else [], digest[end], least[end])
                held_key = int(k[-1])
            cols = [np.concatenate(c) for c in zip(*outs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32))], names=["doc", "at", "mask"]
            )

    return found.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(judge, _MARKS)


ADDED = ("kept_text", "n_words", "n_removed")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with ``kept_text`` (kept words joined by a space), ``n_words`` and ``n_removed``."""
    return _cut_out(docs, window, anchor, ADDED, False)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with their kept words, joined by a space, as text; a text that loses nothing stays as it is. ``n_chars`` follows the text."""
    added = [free_name(docs, n) for n in ADDED]
    found = _cut_out(docs, window, anchor, added, True)
    lost = F.col(added[2]) > 0
    changed = {"text": F.col(added[0]), "n_chars": F.when(lost, F.length(added[0])).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(changed[c] if c in changed else F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _cut_out(docs: DataFrame, window: int, anchor: int, added: Sequence[str], whole: bool) -> DataFrame:
    """The documents without text, with the ``added`` columns. ``whole``: a text without a repeat is given as it is, null too."""
    import zstandard

    if not 1 <= anchor < window or window - anchor + 1 > 31:
        raise ValueError("an anchor is shorter than the window, by 30 words at most")
    packed_as, marked_as, named_as = (free_name(docs, n) for n in ("_packed", "_marks", "_doc"))
    marks = (
        repeats(seeds(docs, window, anchor, hot_anchors(docs, window, anchor)))
        .groupBy("doc")
        .agg(F.collect_list(F.struct("at", "mask")).alias(marked_as))
        .withColumnRenamed("doc", named_as)
    )
    passed = [c for c in docs.columns if c != "text" and c not in added]
    kept = [F.col(f"`{c}`") for c in passed]
    rest = docs.select(*kept).schema

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            made = pa.array([None if t is None else tool.compress(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], packed_as])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = batch.column(batch.num_columns - 2)
            marked = batch.column(batch.num_columns - 1).to_pylist()
            texts, words_n, removed_n = [], [], []
            for cell, own in zip(packed.to_pylist(), marked, strict=True):
                words = [] if cell is None else tool.decompress(cell).split()
                gone = _removed(words, own, window) if own else None
                if gone is not None and gone.any():
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                if whole and len(kept) == len(words):
                    texts.append(None if cell is None else tool.decompress(cell))
                else:
                    texts.append(b" ".join(kept))
                words_n.append(len(words))
                removed_n.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-2],
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(words_n, pa.int64()),
                    pa.array(removed_n, pa.int64()),
                ],
                names=[*batch.schema.names[:-2], *added],
            )

    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    inner = StructType([*rest.fields, StructField(packed_as, BinaryType())])
    outer = StructType([*rest.fields, *[StructField(n, t) for n, t in zip(added, (StringType(), LongType(), LongType()), strict=True)]])
    packed = docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(squeeze, inner)
    joined = packed.join(marks, packed["doc_id"].cast("long") == marks[named_as], "left").select(*kept, packed_as, marked_as)
    return joined.mapInArrow(cut, outer)


def _removed(words: list[bytes], marks: list[dict], window: int) -> np.ndarray:
    """Words under a repeated window; marks of another text with this doc_id have another version."""
    joined = b" ".join(words)
    buf = np.frombuffer(joined, np.uint8)
    off = np.array([0, len(buf)])
    start, end, count = spans(buf, off)
    own = int(_version(buf, start, end, count, hashes(buf, start, end))[0])
    change = np.zeros(len(words) + 1, np.int64)
    for m in marks:
        if m["at"] >> _VERSION != own:
            continue
        first, mask = m["at"] & ((1 << _VERSION) - 1), m["mask"]
        i = 0
        while mask >> i:
            if mask >> i & 1:
                change[first + i] += 1
                change[first + i + window] -= 1
            i += 1
    return np.cumsum(change[:-1]) > 0
