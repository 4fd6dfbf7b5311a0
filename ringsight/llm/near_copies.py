"""Near copies by the exact Jaccard similarity of five-word shingles: two texts link at ``LEAST`` (0.8) or more.

Candidates come from the SimHash search, which also links ``COPIES``, and from ``BANDS`` independent fingerprints, each the hash of ``ROWS``
MinHash values of the shingle set. A pair with similarity s shares one of these with a chance of 1 - (1 - s^ROWS)^BANDS: 0.9994 at 0.8,
0.99998 at 0.85. Candidates only say where to look: inside each connected group of them every pair that is not linked yet by way of others
is compared by its whole shingle sets, and what is below the limit never links.

Equal shingle sets collapse to one node before. The bands and two fingerprints are all that is written for every text; shingle sets are made anew for the
texts in candidate groups. A group with more than ``CELL_SHINGLES`` shingles is split into chunks, and every pair of chunks
is a cell of its own. A cell gives a forest of what is linked there, not the links.

Words are lowered in ASCII and parted by ASCII white space; a text with fewer than five words is one shingle. Null and empty texts have
no shingle and are copies of each other. Rows without doc_id link nothing and stay. Rows that share a doc_id belong to each of their
components, which so become one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.llm.components import components
from ringsight.llm.simhash_dedup import COPIES, SHINGLE, first_of_components, searched, shingle_hashes, simhash
from ringsight.llm.stages import settle
from ringsight.llm.words import U64, mix, raw, texts_of

WORDS = 5
LEAST = (4, 5)  # 0.8 as a fraction, so that the comparison is exact
BANDS, ROWS = 40, 8
CELL_SHINGLES = 1 << 20

_SLOPE = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SHIFT = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def bands(shingles: np.ndarray) -> np.ndarray:
    """The band fingerprints of a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, U64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        for k in range(0, BANDS * ROWS, 8):  # blocks that stay in the processor's cache
            made = part * _SLOPE[k : k + 8, None] + _SHIFT[k : k + 8, None]
            np.minimum(least[k : k + 8], made.min(1), out=least[k : k + 8])
    key = np.zeros(BANDS, U64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * U64(0xD1342543DE82EF95) + row)
    return key.view(np.int64)


def _mark(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, fp2, mark, size, bands): both fingerprints, and digest, size and bands of the shingle set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw(batch.column(1))
            made = np.zeros((len(off) - 1, 2), U64)
            marks, sizes, keys = [], [], []
            for i, text in enumerate(texts_of(buf, off)):
                short, long = shingle_hashes(text, SHINGLE, WORDS)
                made[i] = simhash(short), simhash(long)
                unique = np.unique(long)
                marks.append(_mark(unique))
                sizes.append(len(unique))
                keys.append(bands(unique))
            both = np.ascontiguousarray(made.T).view(np.int64)
            cols = [batch.column(0), pa.array(both[0]), pa.array(both[1]), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "fp2", "mark", "size", "bands"])

    return _texts(docs).mapInArrow(each, "doc_id long, fp long, fp2 long, mark binary, size long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between roots that connect all candidates. ``nodes``: mark, root, fp, fp2, bands."""
    distinct = settle(nodes.groupBy("fp", "fp2").agg(F.min("root").alias("root")))
    same_print = nodes.select("fp", "fp2", F.col("root").alias("u")).join(distinct, ["fp", "fp2"]).select("u", F.col("root").alias("v")).filter("u <> v")
    keys = nodes.select("root", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("root").alias("v"), F.max("root").alias("_last")).filter("v < _last").drop("_last")
    same_band = keys.join(shared, ["band", "key"]).select(F.col("root").alias("u"), "v").filter("u <> v").distinct()
    return searched(distinct, near=COPIES).unionAll(same_print).unionAll(same_band)


def linked(root: np.ndarray, chunk: np.ndarray, split: bool, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the texts of one cell whose shingle sets are similar enough; in a split cell only pairs of two chunks are compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(n), size)[np.argsort(ids, kind="stable")]
    first = np.cumsum(count) - count
    off = np.append(0, np.cumsum(size))
    label = np.arange(n)
    u, v = [], []
    for i in range(n - 1):
        open_ = label != label[i]
        open_[: i + 1] = False
        if split:
            open_ &= chunk != chunk[i]
        if not open_.any():
            continue
        own = ids[off[i] : off[i + 1]]
        own = own[count[own] > 1]
        many = count[own]
        at = np.arange(int(many.sum())) + np.repeat(first[own] - (np.cumsum(many) - many), many)
        both = np.bincount(holder[at], minlength=n)
        for j in np.flatnonzero(open_ & (both * LEAST[1] >= (size + size[i] - both) * LEAST[0])):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                u.append(root[i])
                v.append(root[j])
    return np.array(u, np.int64), np.array(v, np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (component, cell)."""
    now, root, chunk, sets, split = None, [], [], [], False

    def judge() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            u, v = linked(np.array(root, np.int64), np.array(chunk), split, sets)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for k, row in enumerate(zip(*cols, strict=True)):
            if row[:2] != now:
                yield from judge()
                now, root, chunk, sets, split = row[:2], [], [], [], row[3]
            root.append(row[4])
            chunk.append(row[2])
            sets.append(np.frombuffer(batch.column(5)[k].as_buffer(), "<u8").copy())
    yield from judge()


def verified(docs: DataFrame, nodes: DataFrame, edges: DataFrame, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Edges (u, v) that connect what is similar enough inside the groups that the candidate edges connect."""
    found = settle(nodes.select("root", "mark", "size").join(components(edges).withColumnRenamed("node", "root"), "root"))
    weight = found.groupBy("component").agg(F.ceil(F.sum("size") / F.lit(cell_shingles)).cast("int").alias("pieces"))
    placed = found.join(weight, "component").withColumn("pieces", F.greatest("pieces", F.lit(1)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw(batch.column(1))
            made = [np.unique(shingle_hashes(text, WORDS)[0]) for text in texts_of(buf, off)]
            right = pa.array([_mark(s) == m for s, m in zip(made, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            packed = pa.array([s.astype("<u8").tobytes() for s in made], pa.binary())
            cols = [batch.column(0), batch.column(3), batch.column(4), packed]
            yield pa.RecordBatch.from_arrays(cols, names=["root", "component", "pieces", "shingles"]).filter(right)

    texts = _texts(docs).withColumnRenamed("doc_id", "root").join(placed, "root").select("root", "text", "mark", "component", "pieces")
    made = texts.mapInArrow(sets, "root long, component long, pieces int, shingles binary")
    chunked = made.withColumn("chunk", F.pmod(F.xxhash64("root"), F.col("pieces")).cast("int"))
    cells = (
        chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("cell", F.least("chunk", "other") * F.col("pieces").cast("long") + F.greatest("chunk", "other"))
        .withColumn("split", F.col("chunk") != F.col("other"))
    )
    return (
        cells.select("component", "cell", "chunk", "split", "root", "shingles")
        .repartition("component", "cell")
        .sortWithinPartitions("component", "cell")
        .mapInArrow(_verify, "u long, v long")
    )


def near_copies(docs: DataFrame, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """(doc_id, component_id) for every row; component_id is null without doc_id."""
    made = settle(prints(docs))
    owned = made.filter("doc_id is not null")
    least = F.min(F.struct("doc_id", "fp", "fp2", "size", "bands")).alias("_n")
    nodes = settle(owned.groupBy("mark").agg(least).select("mark", F.col("_n.doc_id").alias("root"), "_n.fp", "_n.fp2", "_n.size", "_n.bands"))
    edges = verified(docs, nodes, candidates(nodes), cell_shingles)
    # A doc_id ties the shingle sets of its rows together.
    by_row = owned.select("doc_id", "mark").join(nodes.select("mark", "root"), "mark")
    shared = owned.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    tied = by_row.filter("doc_id <> root").join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
    found = components(edges.unionAll(tied)).select(F.col("node").alias("root"), "component")
    labelled = nodes.select("mark", "root").join(found, "root", "left").select("mark", F.coalesce("component", "root").alias("component_id"))
    return made.select("doc_id", "mark").join(labelled, "mark", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays, once. Rows without doc_id stay."""
    return first_of_components(docs, near_copies(docs))
