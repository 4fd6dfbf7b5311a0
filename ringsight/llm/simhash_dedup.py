"""Near duplicates by SimHash and a generalised pigeonhole search in Hamming space.

Fingerprints of 64 bits link at ``RADIUS`` differing bits or fewer. The bits are split into partitions and each
partition p gets a threshold t_p >= -1 with sum(t_p) = RADIUS - partitions + 1: two fingerprints within RADIUS are then
within t_p on some partition, whatever the thresholds (-1 leaves a partition out). Correlated bits share a partition,
so that their skew costs one partition only. A dynamic program spends the thresholds where a bounded sample of
fingerprints promises the fewest probes and candidates; any outcome is exact, the sample moves cost alone.

Only distinct fingerprints are searched, copies collapse before. Each is stored once per partition used, and probes the
keys within the threshold. Keys that hold more than ``CELL_ROWS`` fingerprints are split into chunks, and every pair of
chunks is a cell of its own, so no task holds a hot key. All candidates in a cell are verified; what leaves the cell is
a forest that connects what is linked there, not the links, so output is linear in the fingerprints.

A wider search (``near``) also links fingerprints that differ in more bits, if a second fingerprint over longer
shingles is close as well. Bits alone neither find all copies nor only copies: ``near_copies`` takes these links as candidates and
decides by the shingles themselves.

Null and empty texts have fingerprint zero and link like any other. Rows without doc_id get a fingerprint and no
component, and link nothing. Rows that share a doc_id belong to each of their components, which so become one. Columns
other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.llm.columns import free_name
from ringsight.llm.components import components
from ringsight.llm.stages import settle
from ringsight.llm.words import U64, raw, texts_of

RADIUS = 3
BITS = 64
SEED = 42
SHINGLE = 3
CELL_ROWS = 2048
SAMPLE_ROWS = 4096
PROBE_COST, PAIR_COST = 40.0, 1.0


@dataclass(frozen=True)
class Near:
    """A wider link: at most ``radius`` bits on the first fingerprint and ``confirm`` on one over ``shingle`` words."""

    radius: int = 9
    shingle: int = 5
    confirm: int = 14


COPIES = Near()


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, *shingles: int) -> list[np.ndarray]:
    """Hashes of all shingles of one text for each shingle length, in order; a text with fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return [np.zeros(0, U64)] * len(shingles)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    made = []
    for shingle in shingles:
        n = max(len(words) - shingle + 1, 1)
        last = end[shingle - 1 :] if len(words) >= shingle else end[-1:]
        hashed = np.empty(n, U64)
        for at in range(0, n, 32768):
            hashed[at : at + 32768] = [xxh64_intdigest(flat[a:b], SEED) for a, b in zip(start[at : min(at + 32768, n)].tolist(), last[at : at + 32768].tolist(), strict=True)]
        made.append(hashed)
    return made


def simhash(hashed: np.ndarray) -> int:
    """SimHash of shingle hashes, each counted as often as it occurs; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 32768):
        part = hashed[at : at + 32768].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, *shingles: int) -> list[int]:
    """SimHash of one text for each shingle length; shingles count as often as they occur."""
    return [simhash(hashed) for hashed in shingle_hashes(text, *shingles)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, second: int | None = None) -> DataFrame:
    """(doc_id, fp, fp2): fingerprints as signed longs; fp2 is zero without a second shingle length."""
    lengths = (shingle,) if second is None else (shingle, second)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw(batch.column(1))
            made = np.zeros((len(off) - 1, 2), U64)
            for i, text in enumerate(texts_of(buf, off)):
                made[i, : len(lengths)] = fingerprint(text, *lengths)
            prints = np.ascontiguousarray(made.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[0]), pa.array(prints[1])], names=["doc_id", "fp", "fp2"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(each, "doc_id long, fp long, fp2 long")


# ---------------------------------------------------------------- partitions and thresholds


def partition_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, correlated bits together."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0))
    with np.errstate(invalid="ignore", divide="ignore"):
        tie = np.abs(centred.T @ centred / np.outer(scale, scale))
    tie = np.nan_to_num(tie)
    left = list(range(BITS))
    groups = []
    for p in range(parts):
        size = len(left) // (parts - p)
        group = [max(left, key=lambda b: tie[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: tie[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, groups: list[list[int]], rows: int, radius: int = RADIUS) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost, by dynamic programming over partitions and the sum spent so far."""
    take = sample[: min(len(sample), 2048)]
    pairs = max(len(take) * (len(take) - 1) / 2, 1)
    goal = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        mask = U64(sum(1 << b for b in group))
        near = np.zeros(len(group) + 1)
        for i in range(len(take) - 1):
            near += np.bincount(np.bitwise_count((take[i + 1 :] ^ take[i]) & mask), minlength=len(group) + 1)[: len(group) + 1]
        cost = [0.0]
        probes, even = 0, 0.0
        for t in range(radius + 1):
            n = comb(len(group), t)
            probes += n
            even += n / 2.0 ** len(group)
            share = max(near[: t + 1].sum() / pairs, even)
            cost.append(rows * probes * PROBE_COST + rows * rows / 2 * share * PAIR_COST)
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (sofar, chosen) in best.items():
            for t in range(-1, radius + 1):
                new = (sofar + cost[t + 1], [*chosen, t])
                if spent + t not in grown or new[0] < grown[spent + t][0]:
                    grown[spent + t] = new
        best = grown
    return best[goal]


def search_plan(sample: np.ndarray, rows: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, threshold) of every partition used."""
    if len(sample) < 2:
        even = np.array_split(np.arange(BITS), radius + 1)
        return [(sum(1 << int(b) for b in group), 0) for group in even]
    plans = []
    for parts in range(2, radius + 3):
        groups = partition_bits(sample, parts)
        cost, chosen = allocate(sample, groups, rows, radius)
        plans.append((cost, parts, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans)[2]


# ---------------------------------------------------------------- probe and verify


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(plan: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(partition, mask, flip, role): role 0 stores the key, role 1 asks for the key with some bits flipped."""
    rows = []
    for p, (mask, threshold) in enumerate(plan):
        bits = [b for b in range(BITS) if mask >> b & 1]
        for t in range(threshold + 1):
            rows += [(p, _signed(mask), _signed(sum(1 << b for b in flip)), int(t > 0)) for flip in combinations(bits, t)]
    return rows


def _verify_cells(radius: int, near: Near | None):
    """Links inside cells. Rows come sorted by (part, key, cell, role); the last cell waits for the next batch."""

    def close(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(a ^ b)
        linked = apart <= radius
        if near:
            linked |= (apart <= near.radius) & (np.bitwise_count(a2 ^ b2) <= near.confirm)
        return linked

    def links(cols: list[np.ndarray], head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stored fingerprints, which lead their cell, against all rows after them."""
        _, _, _, chunk, split, role, fp, fp2, root = cols
        fp, fp2 = fp.view(U64), fp2.view(U64)
        size = np.diff(np.append(head, len(fp)))
        end = np.repeat(head + size, size)
        a, b = [], []
        at = np.flatnonzero(role == 0)
        step = 1
        at = at[at + step < end[at]]
        while len(at):
            other = at + step
            linked = close(fp[at], fp[other], fp2[at], fp2[other])
            linked &= ((split[at] == 0) | (chunk[at] != chunk[other])) & (root[at] != root[other])
            a.append(at[linked])
            b.append(other[linked])
            step += 1
            at = at[at + step < end[at]]
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One edge from every linked node to the smallest of those it is connected with here."""
        nodes, index = np.unique(np.concatenate([root[a], root[b]]), return_inverse=True)
        i, j = index[: len(a)], index[len(a) :]
        label = np.arange(len(nodes))
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
        moved = label != np.arange(len(nodes))
        return nodes[moved], nodes[label[moved]]

    def judge(cols: list[np.ndarray]) -> pa.RecordBatch:
        part, key, cell = cols[:3]
        fresh = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        head = np.concatenate([[0], np.flatnonzero(fresh) + 1])
        a, b = links(cols, head)
        u, v = forest(cols[8], a, b) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield judge([c[:cut] for c in cols])
        if held is not None:
            yield judge(held)

    return run


def links(nodes: DataFrame, plan: list[tuple[int, int]], radius: int = RADIUS, near: Near | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (u, v) between roots that connect all nodes that link. ``nodes``: fp, fp2 and root, each (fp, fp2) once.

    The plan must cover the wider radius where there is one.
    """
    probes = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("part", "mask", "flip", "role"), strict=True)]) for row in _probes(plan)]))
    rows = nodes.select("fp", "fp2", "root", probes.alias("p")).select(
        F.col("p.part").alias("part"),
        F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"),
        F.col("p.role").alias("role"),
        "fp",
        "fp2",
        "root",
    )
    hot = rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    pieces = F.ceil(F.col("n") / F.lit(cell_rows)).cast("int")
    joined = rows.join(hot, ["part", "key"], "left").withColumn("pieces", F.coalesce(pieces, F.lit(1)))
    chunked = joined.withColumn("chunk", F.pmod(F.xxhash64("root"), F.col("pieces")).cast("int"))
    cells = (
        chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("cell", F.least("chunk", "other") * F.col("pieces") + F.greatest("chunk", "other"))
        .withColumn("split", (F.col("chunk") != F.col("other")).cast("int"))
    )
    # Off the diagonal, rows of one chunk already met each other in its own cell.
    return (
        cells.select("part", "key", F.col("cell").cast("long").alias("cell"), "chunk", "split", "role", "fp", "fp2", "root")
        .repartition("part", "key", "cell")
        .sortWithinPartitions("part", "key", "cell", "role")
        .mapInArrow(_verify_cells(radius, near), "u long, v long")
    )


def searched(nodes: DataFrame, radius: int = RADIUS, near: Near | None = None) -> DataFrame:
    """``links`` of written nodes by a plan fitted on a bounded sample of them."""
    rows = nodes.count()
    every = max(rows // SAMPLE_ROWS, 1)
    picked = nodes.filter(F.pmod(F.xxhash64("fp", "fp2"), F.lit(every)) == 0).orderBy(F.xxhash64("fp", "fp2"))
    sample = np.array([r["fp"] for r in picked.select("fp").limit(SAMPLE_ROWS).collect()], np.int64).view(U64)
    return links(nodes, search_plan(sample, rows, near.radius if near else radius), radius, near)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, near: Near | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = settle(fingerprints(docs, shingle, near.shingle if near else None))
    owned = prints.filter("doc_id is not null")
    nodes = settle(owned.groupBy("fp", "fp2").agg(F.min("doc_id").alias("root")))
    edges = searched(nodes, radius, near)
    # A doc_id ties the fingerprints of its rows together, and fingerprints whose roots are one id.
    by_row = owned.join(nodes, ["fp", "fp2"]).select("doc_id", "root").filter("doc_id <> root")
    shared = by_row.groupBy("doc_id").agg(F.min("root").alias("u"), F.max("root").alias("v")).filter("u <> v").select("doc_id")
    tied = by_row.join(shared, "doc_id").select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
    rooted = by_row.join(nodes.select(F.col("root").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
    found = components(edges.unionAll(tied).unionAll(rooted))
    labelled = nodes.join(found, nodes["root"] == found["node"], "left").select("fp", "fp2", F.coalesce("component", "root").alias("component_id"))
    return prints.join(labelled, ["fp", "fp2"], "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def hex_print(fp: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, near: Near | None = COPIES) -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays, once. Rows without doc_id stay."""
    return first_of_components(docs, near_duplicates(docs, radius, shingle, near))


def first_of_components(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, and the rows without doc_id."""
    kept, nth = free_name(docs, "_kept"), free_name(docs, "_nth")
    firsts = found.filter("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.filter("doc_id is not null")
    staying = named.join(firsts, named["doc_id"].cast("long") == firsts[kept], "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    once = staying.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)
    return once.unionByName(docs.filter("doc_id is null"))
