"""How filters interact: what each of five removes in every order, by packed counters.

Which filters a document fails is a mask of five bits, and the mask decides all that happens to it: in each of the 120 orders, which
of the five steps removes it. So every mask stands for one big integer, whose 601 fields are a one for the document itself and a
one for each (order, step) that removes it. Documents labelled good or toxic carry the same fields again in a second and a third
lane. Adding the integers of a part adds all its counters at once. A field has ``FIELD`` bits and no field counts more than the
documents of its part, so below 2^64 documents nothing carries into the next field.

The rest follows from the sums: what a step keeps is the total less what the order removed so far; a filter's own failures are what it
removes in first place, so redundant ones are those less what it removes here; what it removes in last place fails nothing else.

Masks come from one pass over the texts. The fifth filter asks whether a smaller doc_id has the same text: rows travel as 16-byte digests,
rows with equal text, part and labels add up before they move, and the smallest id of each digest decides. Sums are made in each task,
then over salted groups of one part, then over the part, always as a stream of integers of the same size.

Null texts are empty; they count as texts without words, and the second of them repeats the first. A null source is the part ''. Rows
without doc_id repeat nothing, are repeated by nothing and have no labels. Rows that share a doc_id are not smaller than each other, and
each of them counts. A document is good (toxic) if any label row of its id says so. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringsight.llm.stages import settle
from ringsight.llm.vocabulary import word_counts
from ringsight.llm.words import raw, texts_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
FIELD = 64
LANE = 1 + len(STEPS)  # fields of one lane: the document, then its steps
LANES = 3  # all, good, toxic
BYTES = LANES * LANE * FIELD // 8
SALTS = 64
HELD_PARTS = 256  # running sums that a task keeps at once

_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))
_SYMBOL = re.compile(rb"[#$%&*|]")


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D."""
    n, distinct = word_counts(text)
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (n < 50) | (100 * len(distinct) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | bool(_SYMBOL.search(text)) << 3


def removing_step(mask: int, order: str) -> int | None:
    """The step, from 1, that removes a document with these failures."""
    for step, name in enumerate(order, 1):
        if mask >> FILTERS.index(name) & 1:
            return step
    return None


def packed(mask: int) -> int:
    """The fields of one document: itself, and each (order, step) that removes it."""
    out = 1
    for i, (order, step) in enumerate(STEPS):
        if removing_step(mask, order) == step:
            out |= 1 << FIELD * (1 + i)
    return out


def counters() -> list[int]:
    """The integer of every (mask, good, toxic), at ``mask | good << 5 | toxic << 6``."""
    lane = FIELD * LANE
    plain = [packed(mask) for mask in range(32)]
    return [p | (p << lane) * good | (p << 2 * lane) * toxic for toxic in (0, 1) for good in (0, 1) for p in plain]


def unpack(total: int) -> list[list[int]]:
    """Three lanes of fields."""
    data = total.to_bytes(BYTES, "little")
    width = FIELD // 8
    fields = [int.from_bytes(data[i : i + width], "little") for i in range(0, BYTES, width)]
    return [fields[k * LANE : (k + 1) * LANE] for k in range(LANES)]


# ---------------------------------------------------------------- on the tables


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, code, n): documents of each part by mask and labels, as ``counters`` numbers them; not merged over texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = raw(batch.column(2))
            digests, bits = [], []
            for text in texts_of(buf, off):
                digests.append(blake2b(text, digest_size=16).digest())
                bits.append(text_failures(text))
            cols = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "digest", "bits"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    facts = settle(own.mapInArrow(each, "doc_id long, part string, digest binary, bits int"))
    says = lambda c: F.max(F.coalesce((F.col(c).cast("int") == 1).cast("int"), F.lit(0)))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    flags = F.coalesce("good", F.lit(0)) * 32 + F.coalesce("toxic", F.lit(0)) * 64
    named = facts.filter("doc_id is not null").join(marked, "doc_id", "left").withColumn("code", F.col("bits") + flags)
    # One row for each id and text keeps the layout of the join; then equal texts add up before they move.
    rows = named.groupBy("doc_id", "digest", "part", "code").agg(F.count("*").alias("n"))
    cells = rows.groupBy("digest", "part", "code").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    alone = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0))
    split = cells.withColumn("alone", alone).select("part", F.inline(F.array(
        F.struct(F.col("code"), F.col("alone").alias("n")),
        F.struct((F.col("code") + 16).alias("code"), (F.col("n") - F.col("alone")).alias("n")),
    )))
    nameless = facts.filter("doc_id is null").groupBy("part", F.col("bits").alias("code")).agg(F.count("*").alias("n"))
    return split.filter("n > 0").unionByName(nameless)


def _summing(value, held_parts: int = HELD_PARTS):
    """Rows of parts in, (part, integer) out; ``value`` turns a batch into pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            made = [v.to_bytes(BYTES, "little") for v in held.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(made, pa.binary())], names=["part", "total"])
            held.clear()
            return out

        for batch in batches:
            for part, integer in value(batch):
                if part not in held and len(held) >= held_parts:
                    yield emit()
                held[part] = held.get(part, 0) + integer
        yield emit()

    return run


def totals(coded: DataFrame, salts: int = SALTS) -> DataFrame:
    """(part, total): the sum of the integers of each part's documents."""
    table = counters()

    def documents(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        seen: dict[tuple[str, int], int] = {}
        for key, n in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
            seen[key] = seen.get(key, 0) + n
        for (part, code), n in seen.items():
            yield part, table[code] * n

    def sums(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        for part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield part, int.from_bytes(total, "little")

    shape = "part string, total binary"
    first = coded.select("part", "code", "n").mapInArrow(_summing(documents), shape)
    salted = first.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition("part", "salt").sortWithinPartitions("part")
    second = salted.select("part", "total").mapInArrow(_summing(sums), shape)
    return second.repartition("part").sortWithinPartitions("part").mapInArrow(_summing(sums, 1), shape)


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def rows_of(part: str, total: int) -> list[tuple]:
    """The 600 rows of one part."""
    (n, *removed), (_, *good), (_, *toxic) = unpack(total)
    at = {key: i for i, key in enumerate(STEPS)}
    rest = {name: FILTERS.replace(name, "") for name in FILTERS}
    fails = {name: removed[at[name + others, 1]] for name, others in rest.items()}
    unique = {name: removed[at[others + name, len(FILTERS)]] for name, others in rest.items()}
    shapley = {name: sum(removed[i] for (order, step), i in at.items() if order[step - 1] == name) for name in FILTERS}
    out = []
    for order in ORDERS:
        kept = n
        for step, name in enumerate(order, 1):
            i = at[order, step]
            kept -= removed[i]
            out.append((part, order, step, kept, removed[i], fails[name] - removed[i], unique[name], good[i], toxic[i], shapley[name]))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RESULT.split(", ")]
        for batch in batches:
            for part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = list(zip(*rows_of(part, int.from_bytes(total, "little")), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return totals(masks(docs, labels)).mapInArrow(spell, _RESULT)


def oracle(documents: str = "documents", labels: str = "labels") -> str:
    """The rows of ``audit`` in DuckDB: every document against every step, counted by mask."""
    fail = {
        "A": "len(w) < 50",
        "B": "100 * len(list_distinct(w)) < 65 * len(w)",
        "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)",
        "D": "regexp_matches(t, '[#$%&*|]')",
        "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)",
    }
    bits = " + ".join(f"({sql})::INT * {1 << i}" for i, sql in enumerate(fail.values()))
    bit = lambda pos: f"(m >> (instr('{FILTERS}', substr(o, {pos}, 1)) - 1) & 1)"
    first = "CASE " + " ".join(f"WHEN {bit(p)} = 1 THEN {p}" for p in range(1, 6)) + " END"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM {documents}),
l AS (SELECT doc_id, max((quality = 1)::INT) good, max((toxic = 1)::INT) toxic FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT doc_id, part, {bits} m FROM d),
c AS (SELECT part, m, count(*) n, count(*) FILTER (WHERE good = 1) g, count(*) FILTER (WHERE toxic = 1) x FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(o) AS (SELECT '' UNION ALL SELECT o || b FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(b) WHERE instr(o, b) = 0),
s AS (SELECT part, o, step, substr(o, step::INT, 1) name, n, g, x, {first} gone, m >> (instr('{FILTERS}', substr(o, step::INT, 1)) - 1) & 1 fails, bit_count(m) many
  FROM c, o, range(1, 6) r(step) WHERE length(o) = 5),
a AS (SELECT part, o, step, name, coalesce(sum(n) FILTER (WHERE gone IS NULL OR gone > step), 0) kept, coalesce(sum(n) FILTER (WHERE gone = step), 0) removed,
    coalesce(sum(n) FILTER (WHERE fails = 1 AND gone < step), 0) redundant, coalesce(sum(n) FILTER (WHERE fails = 1 AND many = 1), 0) uniq,
    coalesce(sum(g) FILTER (WHERE gone = step), 0) good, coalesce(sum(x) FILTER (WHERE gone = step), 0) tox
  FROM s GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, uniq::BIGINT AS unique_fails,
  good::BIGINT AS good_lost, tox::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM a
"""
