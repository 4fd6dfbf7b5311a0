"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; a forward-backward pass gives
each line's probability of being good, and the mean weighted by line length is the document's score. A line's features are
shares of byte classes and of words that repeat their forerunner, so they hold for any language; labels, language,
source and id are never among them.

The field is fitted on a bounded sample of labelled documents (``TRAIN_DOCS`` of each label, those with the smallest hash of
their id among rows outside the held-out quarter, of any length) by gradient ascent on the conditional likelihood, where
all lines of a document carry its label. Features are taken from whole texts where these lie; a document of more than ``TRAIN_RUNS`` runs of
``RUN_LINES`` lines is learnt from that many runs spread evenly over all of it, so what the driver holds is bounded by the rows. Scoring reads whole texts, line counts and lengths are unbounded: prefix products of the 2 x 2
step matrices give all forward and backward messages in a logarithmic number of array operations.

Null and empty texts are one empty line and get a score as well. Rows without doc_id are not held out and are never
trained on. Repeated rows score alike. Without labels of both kinds every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ringsight.llm.columns import free_name
from ringsight.llm.words import chunks, hashes, raw, spans

TRAIN_DOCS = 1500
TRAIN_RUNS, RUN_LINES = 8, 64
ROUNDS = 250
THRESHOLD = 0.7

_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def _class_table() -> np.ndarray:
    """Byte -> one of: 0 other, 1 small letter or part of a longer character, 2 capital, 3 digit, 4 symbol, 5 loud mark, 6 stop, 7 space."""
    t = np.zeros(256, np.uint8)
    for members, kind in ((range(97, 123), 1), (range(128, 256), 1), (range(65, 91), 2), (range(48, 58), 3), (b"#*$%&|<>{}[]=^~_@\\", 4), (b"!?", 5), (b".,;:", 6), (b" \t\n\x0b\x0c\r", 7)):
        t[list(members)] = kind
    return t


_CLASS = _class_table()
_OWN = 14
_SHARED = (1, 2, 3, 6, 7, 8)  # features that a line also takes from its neighbours
N_FEATURES = _OWN + 2 * len(_SHARED)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length, and the number of lines of every text (at least one)."""
    start, end, _ = spans(buf, off, _LINE_END)
    text = np.searchsorted(off, start, side="right") - 1
    w0, w1, _ = spans(buf, off)
    first, last = np.searchsorted(w0, start), np.searchsorted(w0, end)
    has = last > first  # lines with a word
    start, end, text, first, last = start[has], end[has], text[has], first[has], last[has]
    x = np.zeros((len(start), _OWN))
    size = (end - start).astype(float)
    if len(start):
        kind = _CLASS[buf]

        def per_line(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return (total[end] - total[start]).astype(float)

        counts = [per_line(kind == k) for k in range(8)]
        letters = np.maximum(counts[1] + counts[2], 1)
        solid = np.maximum(size - counts[7], 1)
        h = hashes(buf, w0, w1)
        again = np.zeros(len(h), bool)
        near = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        near[2:] = h[2:] == h[:-2]
        capital = kind[w0] == 2
        lone = (w1 - w0 == 1) & (kind[w0] == 4)
        tail = kind[w1 - 1]

        def per_words(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return (total[last] - total[first]) / np.maximum(last - first, 1)

        words = (last - first).astype(float)
        line_hash = hashes(buf, start, end)
        order = np.lexsort((np.arange(len(start)), line_hash, text))
        same = np.zeros(len(start))
        same[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (text[order][1:] == text[order][:-1])
        x = np.stack(
            [
                np.ones(len(start)),
                counts[4] / solid,
                counts[5] / solid,
                counts[2] / letters,
                counts[3] / solid,
                counts[0] / solid,
                per_words(again),
                per_words(lone),
                same,
                per_words(near),
                per_words(capital),
                per_words((tail == 4) | (tail == 5)),
                np.minimum(solid / np.maximum(words, 1) / 10, 3),
                np.log1p(words) / 5,
            ],
            axis=1,
        )
    lines = np.bincount(text, minlength=len(off) - 1)
    lacking = np.flatnonzero(lines == 0)
    if len(lacking):  # one empty line each
        blank = np.zeros((len(lacking), _OWN))
        blank[:, 0] = 1
        text = np.concatenate([text, lacking])
        order = np.argsort(text, kind="stable")
        x, size, text = np.concatenate([x, blank])[order], np.concatenate([size, np.ones(len(lacking))])[order], text[order]
        lines = np.maximum(lines, 1)
    own = x[:, list(_SHARED)]
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(text) > 1:
        joined = (text[1:] == text[:-1])[:, None]
        before[1:] = own[:-1] * joined
        after[:-1] = own[1:] * joined
    return np.concatenate([x, before, after], axis=1), size, lines


def _chain(steps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Products of log matrices from each chain's start to each place, by doubling."""
    out, step, longest = steps.copy(), 1, int(place.max(initial=0))
    while step <= longest:
        at = np.flatnonzero(place >= step)
        a, b = out[at - step], out[at]
        out[at] = np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])
        step *= 2
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the good label, and the 2 x 2 scores of neighbouring labels (0 bad, 1 good)."""

    weights: np.ndarray
    steps: np.ndarray

    def messages(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node scores, forward and backward messages, and the log partition of every line's chain."""
        n = len(x)
        node = np.stack([np.zeros(n), x @ self.weights], axis=1)
        place = np.arange(n) - np.repeat(np.cumsum(lines) - lines, lines)
        from_end = np.repeat(lines, lines) - 1 - place
        matrix = self.steps[None] + node[:, None, :]
        opening = np.where((place == 0)[:, None, None], np.broadcast_to(node[:, None, :], matrix.shape), matrix)
        forward = _chain(opening, place)[:, 0, :]
        swapped = np.swapaxes(matrix, 1, 2)[::-1]
        back = np.swapaxes(_chain(swapped, from_end[::-1])[::-1], 1, 2)  # product from each line to the chain's end
        backward = np.zeros((n, 2))
        inner = np.flatnonzero(from_end > 0)
        backward[inner] = np.logaddexp(back[inner + 1, :, 0], back[inner + 1, :, 1])
        total = np.logaddexp(forward[:, 0] + backward[:, 0], forward[:, 1] + backward[:, 1])
        return node, forward, backward, total

    def good(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        _, forward, backward, total = self.messages(x, lines)
        return np.exp(np.minimum(forward[:, 1] + backward[:, 1] - total, 0))


def fit(x: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, penalty: float = 1e-3) -> Field:
    """Maximum conditional likelihood with a small penalty, both labels weighing the same. label: one of each text."""
    y = np.repeat(label, lines)
    share = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    weight = np.repeat(share / lines, lines)
    inner = np.flatnonzero(np.arange(len(x)) - np.repeat(np.cumsum(lines) - lines, lines) > 0)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        field = Field(theta[:-4], theta[-4:].reshape(2, 2))
        node, forward, backward, total = field.messages(x, lines)
        p = np.exp(forward[:, 1] + backward[:, 1] - total)
        grad = np.zeros_like(theta)
        grad[:-4] = (weight * (y - p)) @ x
        if len(inner):
            pair = forward[inner - 1][:, :, None] + field.steps[None] + (node + backward)[inner][:, None, :] - total[inner][:, None, None]
            seen = np.zeros((len(inner), 2, 2))
            seen[np.arange(len(inner)), y[inner - 1].astype(int), y[inner].astype(int)] = 1
            grad[-4:] = np.einsum("n,nij->ij", weight[inner], seen - np.exp(pair)).reshape(-1)
        grad -= penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS) -> Field | None:
    """The field, or None where a label is missing."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("quality").cast("int").alias("_label"))
    usable = usable.filter(F.col("_doc").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_doc"))).distinct()
    picked = [usable.filter(F.col("_label") == k).orderBy(F.xxhash64("_doc"), "_doc").limit(per_label) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * per_label rows
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    joined = own.join(sample, F.col("_id") == F.col("_doc"))
    made = joined.select("_doc", "_label", "_text").mapInArrow(_lessons, "doc long, label int, x array<double>")
    rows = made.orderBy("doc", F.xxhash64("x"), "x").limit(2 * per_label).toArrow()
    if rows.num_rows == 0:
        return None
    label = rows.column("label").to_numpy().astype(float)
    if label.min() == label.max():
        return None
    lists = rows.column("x").combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    return fit(x, lists.value_lengths().to_numpy() // N_FEATURES, label)


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the lines of each text, or of runs of lines spread over a longer one."""
    for batch in batches:
        buf, off = raw(batch.column(2))
        for i in range(batch.num_rows):
            x, _, _ = line_features(buf[off[i] : off[i + 1]], off[i : i + 2] - off[i])
            if len(x) > TRAIN_RUNS * RUN_LINES:
                starts = np.linspace(0, len(x) - RUN_LINES, TRAIN_RUNS).astype(int)
                x = x[(starts[:, None] + np.arange(RUN_LINES)).reshape(-1)]
            row = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([x.reshape(-1)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(row, names=["doc", "label", "x"])


def _scores(column: pa.Array, field: Field | None) -> np.ndarray:
    buf, off = raw(column)
    out = np.full(len(off) - 1, 0.5)
    if field is None:
        return out
    for a, b in chunks(off):
        x, size, lines = line_features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        good = field.good(x, lines)
        head = np.cumsum(lines) - lines
        out[a:b] = np.add.reduceat(size * good, head) / np.add.reduceat(size, head)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, field: Field | None, name: str = "score", keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The documents with their score; ``keep`` chooses rows by score."""
    passed = [c for c in docs.columns if c != name]  # the score replaces a column of its name
    at = passed.index("text")
    own = docs.select(*[F.col(f"`{c}`") for c in passed])
    schema = StructType([*own.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _scores(batch.column(at), field)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, name])
            yield out.filter(pa.array(keep(made))) if keep else out

    return own.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, for every row."""
    field = train(docs, labels)
    made = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), field)
    return made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good; all of them where no field could be trained."""
    field = train(docs, labels)
    if field is None:
        return docs
    name = free_name(docs, "_score")
    return score(docs, field, name, lambda s: s >= THRESHOLD).drop(name)
