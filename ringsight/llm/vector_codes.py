"""Vector compression by product codes whose codebooks come from exact k-means over metric trees.

Components become whole numbers, ``floor(1024 x)``, and every vector is cut into four consecutive parts. Rows are dealt into blocks, and each
block holds one metric tree per part position over its distinct parts, built once by the anchors hierarchy, from the middle out: about
the square root of the points become anchors, each new one at the point that lies farthest from its own anchor and taking over the
points nearer to it (a list sorted by distance tells where to stop looking); the anchors are then merged pairwise, smallest common
ball first, up to a root, and treated the same way inside, down to leaves. A ball caches the sum and the count of its points.

A round walks every tree from its root with the list of entries that may be nearest. An entry e goes from the list of a ball (centre c,
radius r) when another entry f is nearer to all its points, |c-e|^2 - |c-f|^2 > 2 r |e-f|, and children inherit what is left. When one entry
is left the ball is wholly its own and gives its cached sum and count without a look at its points; at a leaf the points decide among the
remaining entries, in whole numbers, ties to the lower index. So a round is exact k-means. What leaves a task is one sum and one count for
each entry, at most 1,024 rows; the codebooks (256 entries for each part) are the only thing that the driver holds.

Bounding uses floating point with room for its rounding; distances that decide are exact: below 2^53 as doubles, else as 64-bit
integers. Components beyond +-sqrt(2^60 / length) (134 million for 64) saturate there, so that no distance leaves a long; sums over rows that leave one saturate too.

Rows whose vector is null, empty, or holds a null or non-finite component are dropped, as are vectors of another length than most (of two
lengths equally frequent the shorter stays). Lengths that four does not divide give the first parts one component more. Zero vectors, copies
and rows that share a vec_id take part like any other; rows without vec_id are coded and count in the sums, and come last when the first
entries are chosen. With fewer than 256 rows the codebooks are shorter. Columns other than vec_id, embedding and label are not read; without
a label column all labels are null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.llm.skew import join_by_size
from ringsight.llm.stages import settle

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096
LEAF = 24
_EXACT = float(1 << 53)
_LONG = 2**63 - 1


# ---------------------------------------------------------------- metric trees


@dataclass(frozen=True)
class Tree:
    """Balls in arrays, children after their parent. Points of ball i are ``order[start[i] : end[i]]``; left is -1 at a leaf."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray
    count: np.ndarray
    radius: np.ndarray


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Point numbers owned by each anchor; at most ``wanted`` anchors, fewer where all points of every anchor are one."""
    d = _far(points, points[0])
    order = np.argsort(-d, kind="stable")
    pivots, owned, far = [points[0]], [order], [d[order]]
    while len(owned) < wanted:
        widest = max(range(len(owned)), key=lambda i: far[i][0])
        if far[widest][0] == 0:
            break
        pivot = points[owned[widest][0]]
        taken, reach = [], []
        for i in range(len(owned)):
            apart = math.sqrt(((pivot - pivots[i]) ** 2).sum())
            # Points within half the way to the new anchor stay where they are; lists go from far to near.
            upto = int(np.searchsorted(-far[i], -apart / 2 * (1 - 1e-12), side="right"))
            if not upto:
                continue
            new = _far(points[owned[i][:upto]], pivot)
            moves = new < far[i][:upto]
            if moves.any():
                taken.append(owned[i][:upto][moves])
                reach.append(new[moves])
                stay = np.concatenate([~moves, np.ones(len(far[i]) - upto, bool)])
                owned[i], far[i] = owned[i][stay], far[i][stay]
        own, reach_all = np.concatenate(taken), np.concatenate(reach)
        by = np.argsort(-reach_all, kind="stable")
        pivots.append(pivot)
        owned.append(own[by])
        far.append(reach_all[by])
    return owned


def _merged(sums: np.ndarray, count: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to merge, smallest common ball first; the n-th merge makes node ``len(count) + n``."""
    k = len(count)
    s, n, r = (np.concatenate([a, np.zeros((k - 1, *a.shape[1:]))]) for a in (sums, count, radius))
    size = np.full((2 * k - 1, 2 * k - 1), np.inf)

    def bounds(i: int, others: np.ndarray) -> np.ndarray:
        apart = _far(s[others] / n[others, None], s[i] / n[i])
        return np.maximum((apart + r[i] + r[others]) / 2, np.maximum(r[i], r[others]))

    for i in range(k):
        others = np.arange(i + 1, k)
        if len(others):
            size[i, others] = bounds(i, others)
    alive = np.arange(2 * k - 1) < k
    pairs = []
    for made in range(k, 2 * k - 1):
        a, b = divmod(int(size.argmin()), 2 * k - 1)
        pairs.append((a, b))
        s[made], n[made], r[made] = s[a] + s[b], n[a] + n[b], size[a, b]
        alive[[a, b]] = False
        size[[a, b]], size[:, [a, b]] = np.inf, np.inf
        others = np.flatnonzero(alive)
        alive[made] = True
        size[others, made] = bounds(made, others)
    return pairs


def grow(points: np.ndarray, weight: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over distinct points, each standing for ``weight`` rows."""
    exact = points.astype(np.int64)
    plain = points.astype(np.float64)
    nodes: list[list] = []  # point numbers of a leaf or None, left, right

    def build(own: np.ndarray) -> int:
        if len(own) > leaf:
            groups = [own[g] for g in anchors(plain[own], max(2, math.isqrt(len(own))))]
            if len(groups) > 1:
                made = [build(g) for g in groups]
                sums = np.stack([plain[g].sum(0) for g in groups])
                count = np.array([float(len(g)) for g in groups])
                radius = np.array([_far(plain[g], s / n).max() for g, s, n in zip(groups, sums, count, strict=True)])
                for a, b in _merged(sums, count, radius):
                    nodes.append([None, made[a], made[b]])
                    made.append(len(nodes) - 1)
                return made[-1]
        nodes.append([own, -1, -1])
        return len(nodes) - 1

    build(np.arange(len(points)))
    # Lay the nodes out from the root, so that every ball is a range of the order.
    order, rows, stack, place = [], [], [(len(nodes) - 1, -1, 0)], 0
    while stack:
        at, parent, side = stack.pop()
        own, a, b = nodes[at]
        rows.append([place, place, -1, -1])
        if parent >= 0:
            rows[parent][2 + side] = len(rows) - 1
        if own is None:
            stack += [(b, len(rows) - 1, 1), (a, len(rows) - 1, 0)]
        else:
            order.append(own)
            place += len(own)
            rows[-1][1] = place
    start, end, left, right = np.array(rows, np.int64).T.copy()
    for i in range(len(rows) - 1, -1, -1):
        if left[i] >= 0:
            end[i] = end[right[i]]
    order = np.concatenate(order)
    upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(exact[order] * weight[order, None], axis=0)])
    weights = np.concatenate([[0], np.cumsum(weight[order])])
    sums, count = upto[end] - upto[start], weights[end] - weights[start]
    centre = sums / count[:, None]
    radius = np.array([_far(plain[order[a:b]], c).max() for a, b, c in zip(start.tolist(), end.tolist(), centre, strict=True)])
    return Tree(order, start, end, left, right, sums, count, radius)


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest nearest entry of each point and the exact squared distance."""
    most = max(float(np.abs(points).max(initial=0)), float(np.abs(entries).max(initial=0)))
    if points.shape[1] * (2 * most) ** 2 < _EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        d = (e**2).sum(1) - 2.0 * (p @ e.T)
        own = d.argmin(1)
        return own, (d[np.arange(len(p)), own] + (p**2).sum(1)).astype(np.int64)
    own, best = np.zeros(len(points), np.int64), np.full(len(points), _LONG)
    for j, e in enumerate(entries.astype(np.int64)):
        d = ((points.astype(np.int64) - e) ** 2).sum(1)
        less = d < best
        own[less], best[less] = j, d[less]
    return own, best


def walk(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray | int, np.ndarray | None]]:
    """(ball, entry, None) for balls that one entry owns, (leaf, entries of its points, their order) elsewhere."""
    e = entries.astype(np.float64)
    stack = [(0, np.arange(len(e)))]
    while stack:
        at, left = stack.pop()
        centre, radius = tree.sums[at] / tree.count[at], float(tree.radius[at])
        square = ((e[left] - centre) ** 2).sum(1)
        best = int(square.argmin())
        apart = np.sqrt(((e[left] - e[left[best]]) ** 2).sum(1))
        room = 1e-9 * (square + square[best] + 2 * radius * apart + float((centre**2).sum())) + 1e-9
        left = left[square - square[best] <= 2 * radius * apart + room]
        if len(left) == 1:
            yield at, int(left[0]), None
        elif tree.left[at] < 0:
            members = tree.order[tree.start[at] : tree.end[at]]
            own, _ = _nearest(points[members], entries[left])
            yield at, left[own], members
        else:
            stack += [(int(tree.right[at]), left), (int(tree.left[at]), left)]


def entry_sums(tree: Tree, points: np.ndarray, weight: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the rows that are nearest to each entry."""
    sums, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    for at, own, members in walk(tree, points, entries):
        if members is None:
            sums[own] += tree.sums[at]
            count[own] += tree.count[at]
        else:
            np.add.at(sums, own, points[members].astype(np.int64) * weight[members, None])
            np.add.at(count, own, weight[members])
    return sums, count


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point."""
    out = np.zeros(len(points), np.int64)
    for at, own, members in walk(tree, points, entries):
        out[tree.order[tree.start[at] : tree.end[at]] if members is None else members] = own
    return out


# ---------------------------------------------------------------- on the tables


def whole_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, x) with whole components, and the length of the vectors."""
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("string") if "label" in df.columns else F.lit(None).cast("string")
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v")).filter("size(v) > 0")
    clean = own.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    top = clean.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    length = top["n"] if top else 0
    most = math.isqrt((1 << 60) // max(length, 1))
    whole = F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x * SCALE))))).cast("int"))
    return clean.filter(F.size("v") == length).select("vec_id", "label", whole.alias("x")), length


def cuts(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    edges = np.cumsum([0] + [len(a) for a in np.array_split(np.arange(length), parts)]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _freeze(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _thaw(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as stored:
        return {k: stored[k] for k in stored.files}


def _parts(block: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Tree]]:
    """(distinct points, rows of each, point of each row, tree) for every part of a block."""
    for k in range(PARTS):
        tree = Tree(*[block[f"{k}.{name}"] for name in Tree.__dataclass_fields__])
        yield block[f"{k}.points"], block[f"{k}.weight"], block[f"{k}.row"], tree


def plant(vectors: DataFrame, length: int) -> DataFrame:
    """(ids, labels, block): rows in blocks with the trees of their parts."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * length)))
    spans = cuts(length)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            column = table.column("x").combine_chunks()
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int32).reshape(-1, length)
            arrays = {}
            for k, (a, b) in enumerate(spans):
                points, row, weight = np.unique(x[:, a:b], axis=0, return_inverse=True, return_counts=True)
                if a == b:  # fewer components than parts: all parts are alike
                    points, row, weight = np.zeros((1, 0), np.int32), np.zeros(len(x), np.int64), np.array([len(x)])
                tree = grow(points, weight)
                arrays |= {f"{k}.points": points, f"{k}.weight": weight, f"{k}.row": row.reshape(-1)}
                arrays |= {f"{k}.{name}": getattr(tree, name) for name in Tree.__dataclass_fields__}
            lists = [pa.array([table.column(n).to_pylist()], pa.list_(t)) for n, t in (("vec_id", pa.int64()), ("label", pa.string()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([_freeze(**arrays)], pa.binary())], names=["ids", "labels", "block"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, min(rows - n, batch.num_rows - at))
                at, n = at + piece.num_rows, n + piece.num_rows
                held.append(piece)
                if n == rows:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield made(pa.Table.from_batches(held))

    return vectors.select("vec_id", "label", "x").mapInArrow(blocks, "ids array<long>, labels array<string>, block binary")


def first_codebooks(vectors: DataFrame, length: int, entries: int = ENTRIES) -> list[np.ndarray]:
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()  # at most ``entries`` rows
    x = np.array([r["x"] for r in rows], np.int64).reshape(-1, length)
    return [x[:, a:b] for a, b in cuts(length)]


def improved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of what is nearest to it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for batch in batches:
            for data in batch.column(0):
                for (s, n), book, (points, weight, _, tree) in zip(total, books, _parts(_thaw(data.as_py())), strict=True):
                    more, rows = entry_sums(tree, points, weight, book)
                    s += more
                    n += rows
        for part, (s, n) in enumerate(total):
            used = np.flatnonzero(n)
            cols = [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "s"])

    width = max(b.shape[1] for b in books)
    made = blocks.select("block").mapInArrow(sums, "part int, entry int, n long, s array<long>")
    added = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i)).cast("decimal(20,0)")) for i in range(width)]).alias("s"))
    out = [b.copy() for b in books]
    for r in added.collect():  # one row for each entry
        book = out[r["part"]]
        book[r["entry"]] = [int(v) // r["n"] for v in r["s"][: book.shape[1]]]
    return out


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(*batch.columns, strict=True):
                code, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for k, (book, (points, _, row, tree)) in enumerate(zip(books, _parts(_thaw(data.as_py())), strict=True)):
                    own = assigned(tree, points, book)
                    apart = ((points.astype(np.int64) - book[own]) ** 2).sum(1)
                    code[:, k], error = own[row], error + apart[row]
                text = code.tobytes().hex()
                spelt = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                cols = [ids.values, labels.values, pa.array(spelt, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "block").mapInArrow(codes, "vec_id long, label string, code string, error long")


def compress(df: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every vector."""
    vectors, length = whole_vectors(df)
    if not length:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks = settle(plant(vectors, length))
    books = first_codebooks(vectors, length, entries)
    for _ in range(rounds):
        books = improved(blocks, books)
    coded = settle(_coded(blocks, books).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("key").agg(F.count("*").alias("rows"), total.alias("label_error"))
    joined = join_by_size(coded, by_label, "key", "rows")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def oracle(table: str = "embeddings", rounds: int = ROUNDS, entries: int = ENTRIES) -> str:
    """The rows of ``compress`` in DuckDB for unique ids and vectors of one length that four divides: every part against every entry."""
    near = lambda book: f"""SELECT vec_id, k, x, i, d FROM (SELECT p.vec_id, p.k, p.x, e.i,
    list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(p.x, e.x)])::BIGINT d FROM p JOIN {book} e USING (k)) QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY d, i) = 1"""  # noqa: E731
    text = f"""
WITH w AS (SELECT vec_id, label, [floor(1024 * c::DOUBLE)::BIGINT for c in embedding] x FROM {table}
  WHERE len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0),
p AS MATERIALIZED (SELECT vec_id, k::INT k, x[k * len(x) // {PARTS} + 1 : (k + 1) * len(x) // {PARTS}] x FROM w, range({PARTS}) r(k)),
b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 i, x FROM p QUALIFY i < {entries})"""
    for r in range(rounds):
        text += f""",
n{r} AS MATERIALIZED ({near(f"b{r}")}),
m{r} AS (SELECT k, i, list(v ORDER BY pos) x FROM (SELECT k, i, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) v
  FROM (SELECT k, i, unnest(x) v, generate_subscripts(x, 1) pos FROM n{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.k, b.i, coalesce(m.x, b.x) x FROM b{r} b LEFT JOIN m{r} m USING (k, i))"""
    return text + f""",
f AS MATERIALIZED ({near(f"b{rounds}")}),
c AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY k) code, sum(d)::BIGINT error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY k, i, pos)) codebooks_sha256 FROM (SELECT k, i, unnest(x) v, generate_subscripts(x, 1) pos FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN w USING (vec_id), h
"""
