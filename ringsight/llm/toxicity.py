"""Toxicity by compression distance: which of two zstandard dictionaries makes a window of the text shorter.

A window is one word of the text, written three times with spaces, since zstandard hardly codes fewer bytes. One dictionary of a pair is
trained on windows that mark toxic documents, the other on windows of ordinary ones; the two compressed lengths of a window, added over
``DICTIONARIES`` pairs, are all that is known of it. Lengths are calibrated: from documents that trained no dictionary comes the log odds
of holding a window with these lengths, and the two most toxic windows of a text make its score by a logistic curve. A text is read whole.

The fit uses a bounded sample of labelled documents (``TRAIN_DOCS`` of each label, those with the smallest hash of their id among rows outside
the held-out quarter, any length), two thirds for the dictionaries, one for the calibration; texts that are the same count once in each.
A word marks toxic documents if the share of them that holds it lies ``SURE`` standard errors above that of ordinary ones, and is at least
``SHARE``; the ordinary side takes the ``ORDINARY_WORDS`` most frequent others. The driver holds these words, the dictionaries (2 kB at most) and the table
of lengths, never a text. Labels, language, source and doc_id are no input of a score.

Null and empty texts have no window, so they get the score of a text without any toxic one. Rows without doc_id are not held out and never
trained on. Repeated rows score alike. Words longer than 64 kB are compressed whole; lengths above ``LONGEST`` count as that. Without labels
of both kinds, or without any word that marks toxic documents, every score is 0. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.llm.stages import settle_compact
from ringsight.llm.vocabulary import word_counts
from ringsight.llm.words import raw, texts_of

TRAIN_DOCS = 3000
SHARE, SUPPORT, SURE = 0.02, 3, 8
ORDINARY_WORDS = 30_000
ORDINARY_SAMPLES = 400_000
#: (bytes, segment length, part length) of each pair
DICTIONARIES = ((2048, 32, 8), (2048, 24, 6), (1024, 16, 6))
LEVEL = 19
LEAST_ODDS = 1.5  # log odds below this are no evidence
LONGEST = 400
MEMORY = 600_000  # words whose lengths a worker remembers
THRESHOLD = 0.3

Lengths = tuple[int, int]  # with the toxic dictionaries, and how much longer with the ordinary ones


def window(word: bytes) -> bytes:
    return b" " + word + b" " + word + b" " + word


def _trained(samples: list[bytes], size: int, segment: int, part: int) -> tuple[bytes, int]:
    """A dictionary and its kind; too few samples for the trainer are a dictionary as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=part, level=LEVEL).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:
        plain = b"".join(dict.fromkeys(reversed(samples)))[:size]
        return plain.ljust(8, b" "), zstandard.DICT_TYPE_RAWCONTENT


@dataclass(frozen=True)
class Pairs:
    """(toxic, ordinary) dictionaries, as bytes that travel to the workers."""

    made: tuple[tuple[tuple[bytes, int], tuple[bytes, int]], ...]

    def tools(self) -> list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]:
        return [tuple(_compressor(*d) for d in pair) for pair in self.made]


def _compressor(data: bytes, kind: int) -> zstandard.ZstdCompressor:
    shared = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(data), **shared)
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


class Measurer:
    """Lengths of words, remembered by a worker.

    ``wanted`` are the lengths with the toxic dictionaries that count at all. Since lengths only add up, a word above the longest of
    them is left (None) before the other dictionaries see it, and so is one whose length is not among them.
    """

    def __init__(self, pairs: Pairs, wanted: frozenset[int] | None = None):
        self.pairs, self.wanted = pairs, wanted
        self.tools = pairs.tools()
        self.known: dict[bytes, Lengths | None] = {}

    def lengths(self, words: set[bytes]) -> dict[bytes, Lengths | None]:
        """A mapping that holds at least these words."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > MEMORY:
                self.known = {}
                new = list(words)
            self.known.update(dict.fromkeys(new))
            most = max(self.wanted, default=0) if self.wanted is not None else None
            left, toxic = new, np.zeros(len(new), np.int64)
            for tool, _ in self.tools:
                toxic = toxic + self._sizes(tool, left)
                if most is not None and most < LONGEST:
                    keep = toxic <= most
                    left, toxic = [w for w, k in zip(left, keep.tolist(), strict=True) if k], toxic[keep]
            toxic = np.minimum(toxic, LONGEST)
            if self.wanted is not None:
                keep = np.isin(toxic, list(self.wanted))
                left, toxic = [w for w, k in zip(left, keep.tolist(), strict=True) if k], toxic[keep]
            ordinary = sum((self._sizes(tool, left) for _, tool in self.tools), np.zeros(len(left), np.int64))
            gap = np.minimum(ordinary, LONGEST) - toxic
            self.known.update(zip(left, zip(toxic.tolist(), gap.tolist(), strict=True), strict=True))
        return self.known

    @staticmethod
    def _sizes(tool: zstandard.ZstdCompressor, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        out = tool.multi_compress_to_buffer([window(w) for w in words], threads=1)
        return np.fromiter((len(out[i]) for i in range(len(words))), np.int64, len(words))


@dataclass(frozen=True)
class Judge:
    """The fitted classifier: dictionaries, log odds of lengths, and the curve over the two highest of a text."""

    pairs: Pairs
    odds: dict[Lengths, float]
    slope: float
    offset: float

    def measurer(self) -> Measurer:
        return Measurer(self.pairs, frozenset(length for length, _ in self.odds))

    def evidence(self, text: bytes, measurer: Measurer) -> float:
        words = word_counts(text)[1]
        known = measurer.lengths(words)
        odds = self.odds
        return sum(sorted(odds.get(known[w], 0.0) for w in words)[-2:])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -60, 60)))


def curve(evidence: np.ndarray, label: np.ndarray, share: float, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps; ``share`` is how many labels are 1 before the sample evened them."""
    weight = np.where(label == 1, share / max((label == 1).sum(), 1), (1 - share) / max((label == 0).sum(), 1))
    x = np.stack([evidence, np.ones(len(evidence))], 1)
    theta = np.array([0.0, math.log(share / (1 - share))])
    keep = np.array([penalty, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        grad = x.T @ (weight * (label - p)) - keep * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        theta = theta + step / max(1.0, float(np.abs(step).max()) / 2)
    return max(float(theta[0]), 0.0), float(theta[1])


# ---------------------------------------------------------------- on the tables


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, float]:
    """(label, whether it fits dictionaries, text) of the sample, and the share of toxic ones among all usable labels."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("label"))
    usable = usable.filter(F.col("doc").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc"))).distinct()
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    picked = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc"), "doc").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * per_label rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fits = F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(3)) > 0
    joined = own.join(chosen, "doc").select("label", fits.alias("fits"), "text").dropDuplicates(["label", "text"])
    return settle_compact(joined), share


def _marking_words(sample: DataFrame) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
    """Words that mark toxic documents and the most frequent others, with their numbers of documents."""
    own = sample.filter("fits")
    size = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, ordinary = size.get(1, 0), size.get(0, 0)
    if not toxic or not ordinary:
        return [], []

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts_of(*raw(batch.column(1))), strict=True):
                seen = list(word_counts(text)[1])
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(seen), pa.int32()), pa.array(seen, pa.binary())], names=["label", "word"])

    found = own.select("label", "text").mapInArrow(words, "label int, word binary")
    counted = found.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(f"a + b >= {SUPPORT}")
    both = (F.col("a") + F.col("b")) / (toxic + ordinary)
    error = F.sqrt(both * (1 - both) * (1 / toxic + 1 / ordinary))
    marks = (F.col("a") >= max(SUPPORT, SHARE * toxic)) & (F.col("a") / toxic - F.col("b") / ordinary >= SURE * error)
    counted = counted.withColumn("marks", marks)
    # A sampled text of n distinct words adds n / (SHARE * toxic) marking words at most.
    first = counted.filter("marks").orderBy("word").collect()
    other = counted.filter(f"not marks and b >= {SUPPORT}").orderBy(F.desc("b"), "word").limit(ORDINARY_WORDS).collect()
    return [(bytes(r["word"]), r["a"]) for r in first], [(bytes(r["word"]), r["b"]) for r in other]


def train_pairs(toxic: list[tuple[bytes, int]], ordinary: list[tuple[bytes, int]]) -> Pairs:
    """One toxic and one ordinary dictionary for each entry of ``DICTIONARIES``."""

    def repeated(words: list[tuple[bytes, int]]) -> list[bytes]:
        out = [window(w) for w, n in words for _ in range(n)]
        random.Random(0).shuffle(out)  # the trainer takes one segment from each stretch of samples in turn
        return out[:ORDINARY_SAMPLES]

    a, b = repeated(toxic), repeated(ordinary)
    return Pairs(tuple((_trained(a, *shape), _trained(b, *shape)) for shape in DICTIONARIES))


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS) -> Judge | None:
    """The fitted classifier, or None where there is nothing to learn from."""
    sample, share = _sample(docs, labels, per_label)
    toxic, ordinary = _marking_words(sample)
    if not toxic or not ordinary:
        return None
    pairs = train_pairs(toxic, ordinary)
    rest = sample.filter("not fits").select("label", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer(pairs)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts_of(*raw(batch.column(1))), strict=True):
                words = word_counts(text)[1]
                known = measurer.lengths(words)
                cells = sorted({known[w] for w in words})
                cols = [pa.array([label] * len(cells), pa.int32()), pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["label", "length", "gap"])

    size = {r["label"]: r["n"] for r in rest.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return None
    cells = rest.mapInArrow(measured, "label int, length int, gap int").groupBy("length", "gap")
    rows = cells.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).collect()  # at most LONGEST * 2 LONGEST lengths
    every = {(r["length"], r["gap"]): math.log((r["a"] + 0.5) / (n1 + 1) / ((r["b"] + 1) / (n0 + 2))) for r in rows if r["a"] >= max(SUPPORT, n1 / 100)}
    odds = {lengths: v for lengths, v in every.items() if v >= LEAST_ODDS}
    judge = Judge(pairs, odds, 1.0, 0.0)
    seen = rest.mapInArrow(_evidence(judge), "label int, evidence double").collect()  # at most 2 * per_label rows
    slope, offset = curve(np.array([r["evidence"] for r in seen]), np.array([float(r["label"]) for r in seen]), share)
    return Judge(pairs, odds, slope, offset)


def _evidence(judge: Judge):
    """Batches (any column, text) to (that column, evidence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = judge.measurer()
        for batch in batches:
            made = [judge.evidence(t, measurer) for t in texts_of(*raw(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=[batch.schema.names[0], "evidence"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, for every row."""
    judge = train(docs, labels)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _evidence(judge)(batches) if judge else batches:
            made = judge.score(batch.column(1).to_numpy()) if judge else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "score"])

    made = own.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
