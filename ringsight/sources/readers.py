"""Sources: frame files, concatenated image streams, slot tables, calibration bundles, settings, snapshots."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.functions.numeric import measured
from ringsight.operators.sequencing import ELEMENT_PERIOD
from ringsight.operators.wheels import SETTINGS_GAP, SETTINGS_SPACING
from ringsight.session import settle

FRAME_SCHEMA = "frame_id string, camera_id string, image_data binary, captured_at timestamp, sequence_no bigint"
IMAGE_START, IMAGE_END = b"\xff\xd8", b"\xff\xd9"  # fixed values
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
IMAGE_SCHEMA = "path string, offset bigint, image binary, truncated boolean, range_no bigint, in_range bigint"
RANGE_BYTES = 64 << 20  # one range of a stream file
READ_BYTES = 1 << 20  # read at once
BATCH_BYTES = 16 << 20  # images that leave a task together
ROW_BYTES = 200  # of a row beside its image, while it is held
SLOT_TEXT = ["kind", "status"]
SLOT_NUMBERS = [
    "dx", "dy", "peak", "lit_L", "lit_R", "top_L", "bot_L", "bright_L", "straight_L", "slope_L", "top_R", "bot_R",
    "bright_R", "straight_R", "slope_R", "face_resid",
]
SLOT_SCHEMA = "slot int, frame int, kind string, status string, short_L boolean, short_R boolean, " + ", ".join(
    f"{c} double" for c in SLOT_NUMBERS
)
SLOPE_LOW, SLOPE_HIGH = 0.05, 0.20  # fixed values: plausible slope of a template line


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frames as parquet, at rest or as a stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(FRAME_SCHEMA).parquet(path)


def _split(content: bytes):
    at = 0
    while True:
        start = content.find(IMAGE_START, at)
        if start < 0:
            return
        end = content.find(IMAGE_END, start + 2)
        if end < 0:
            yield start, content[start:], True
            return
        yield start, content[start : end + 2], False
        at = end + 2


def split_images(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Images of concatenated streams: bytes between images are skipped, an open tail is marked truncated.

    A task holds one batch of streams as Arrow gives it, one stream of it as bytes, and ``BATCH_BYTES`` of images.
    """
    kind = df.schema[path].dataType.simpleString()
    return df.select(path, content).mapInArrow(_split_batches, f"path {kind}, image_no bigint, offset bigint, image binary, truncated boolean")


def _split_batches(batches):
    """Images of batches of (path, content), in batches of ``BATCH_BYTES`` or one image more."""
    names = ["path", "image_no", "offset", "image", "truncated"]

    def made(held, kind):
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    for batch in batches:
        kind, held, weight = batch.column(0).type, [], 0
        for name, data in zip(batch.column(0), batch.column(1)):
            for i, (at, image, cut) in enumerate(_split(data.as_py())):
                held.append((name.as_py(), i, at, image, cut))
                weight += len(image) + ROW_BYTES
                if weight > BATCH_BYTES:
                    yield made(held, kind)
                    held, weight = [], 0
        if held:
            yield made(held, kind)


def read_image_streams(spark: SparkSession, path: str, stream: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Images of the concatenated streams below ``path``: path, offset, image, truncated, range_no and in_range.

    Files are read in ranges of ``range_bytes``, dealt over tasks, and give the rows of ``split_images``. An end marker puts every
    reader in the same state, so a range owns what follows the end markers that begin in it (the first one the head of the
    file too) and reads on over its border to the next end marker. As a stream, new files are found by Spark's file source.
    Only one image at a time is held whole.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").schema(FILE_SCHEMA).load(path).select("path", "length")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / range_bytes)))
    ranges = files.filter("length > 0").select("path", "length", parts.alias("range_no"))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "range_no")

    def run(batches):
        for batch in batches:
            for name, size, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _opened(name) as file:
                    held, weight = [], 0
                    found = images_between(file, part * range_bytes, min((part + 1) * range_bytes, size))
                    for i, (at, image, cut) in enumerate(found):
                        held.append((name, at, image, cut, part, i))
                        weight += len(image)
                        if weight > BATCH_BYTES:
                            yield _image_batch(held)
                            held, weight = [], 0
                    yield _image_batch(held)

    return dealt.mapInArrow(run, IMAGE_SCHEMA)


def images_between(file, first: int, end: int, block: int = READ_BYTES):
    """(offset, image, truncated) of the images that belong to the bytes [first, end) of a seekable file."""
    file.seek(first)
    held, base = bytearray(), first  # bytes of the file from base on
    at, start, known = first, None, first == 0
    while True:
        data = file.read(block)
        held += data
        while True:
            close = held.find(IMAGE_END, at - base)
            if start is None and known:
                begin = held.find(IMAGE_START, at - base)
                if begin >= 0 and (close < 0 or begin < close):
                    start = base + begin
                    at = start + 2
                    continue
            if close < 0:
                break
            if start is not None:
                yield start, bytes(held[start - base : close + 2]), False
            if base + close >= end:
                return
            at, start, known = base + close + 2, None, True
        if not data:
            if start is not None:
                yield start, bytes(held[start - base :]), True
            return
        # a marker may lie across the blocks, so the last byte is looked at again
        at = max(at, base + len(held) - 1)
        if start is None and not known and at >= end:
            return
        keep = (at if start is None else start) - base
        del held[:keep]
        base += keep


def _opened(path: str):
    if re.match("file:/|/", path):
        return open(re.sub("^file:/+", "/", path), "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _image_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    types = (pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["path", "offset", "image", "truncated", "range_no", "in_range"]
    )


def numbered_images(images: DataFrame) -> DataFrame:
    """Images with their number in the file (image_no) and over all files in path order (sequence_no), both from 0.

    Only one row a range is ordered. No image at all is an error.
    """
    ranges = settle(images.groupBy("path", "range_no").agg(F.count("*").alias("_n")))
    files = settle(ranges.groupBy("path").agg(F.sum("_n").alias("_total")))
    if files.isEmpty():
        raise ValueError("no image in any file")
    in_file = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    over_all = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    of_file = files.select("path", F.coalesce(F.sum("_total").over(over_all), F.lit(0)).alias("_files"))
    of_range = ranges.select("path", "range_no", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_ranges"))
    number = F.col("_ranges") + F.col("in_range")
    out = images.join(of_range.join(of_file, "path"), ["path", "range_no"])
    return out.select("path", number.alias("image_no"), (F.col("_files") + number).alias("sequence_no"), "offset", "image", "truncated")


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """Slot table from CSV, NaN as NULL, with a synthetic time per slot."""
    return typed_slots(spark.read.schema(SLOT_SCHEMA).option("header", True).option("nanValue", "nan").csv(path))


def typed_slots(df: DataFrame) -> DataFrame:
    numbers = {c: measured(F.col(c)) for c in SLOT_NUMBERS if c in df.columns}
    return df.withColumns({**numbers, "t_wall": F.col("slot") * F.lit(ELEMENT_PERIOD)})


def bundle_problems(rules: Column) -> Column:
    """What is wrong with a calibration struct: format, shape against pitch, line slopes."""
    from ringsight.functions.numeric import violations

    slope = lambda s: F.abs(rules[f"slope_{s}"]).between(SLOPE_LOW, SLOPE_HIGH)
    return violations(
        (rules["format"] == rules["expected_format"], "format"),
        (F.abs(rules["loop_cols"] / rules["elements"] - rules["pitch"]) < 0.5, "pitch"),
        (slope("left"), "slope_left"),
        (slope("right"), "slope_right"),
    )


def read_calibration(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Calibration rules; one small file, read as one document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Every listed file against its digest. ``manifest``: value = "<sha256>  <name>"; ``files``: name, content."""
    parts = F.split("value", "  ", 2)
    listed = manifest.select(parts[1].alias("name"), F.lower(parts[0]).alias("want"))
    found = files.select("name", F.sha2("content", 256).alias("got"))
    out = listed.join(found, "name", "full_outer")
    status = (
        F.when(F.col("want").isNull(), "unlisted").when(F.col("got").isNull(), "missing")
        .when(F.col("want") == F.col("got"), "ok").otherwise("changed")
    )
    return out.select("name", status.alias("status"))


def version_text(digest: Column, build: Column, thresholds: Column) -> Column:
    return F.concat_ws("+", F.substring(digest, 1, 8), build, thresholds)


SETTINGS_SCHEMA = "wheel_max_gap_godets int, wheel_min_spacing_godets int"


def parse_settings(text: Column) -> Column:
    """Settings struct; anything invalid gives the whole default."""
    s = F.from_json(text, SETTINGS_SCHEMA)
    gap, spacing = s["wheel_max_gap_godets"], s["wheel_min_spacing_godets"]
    valid = F.coalesce(gap.between(2, 20) & spacing.between(1, 6) & (spacing <= gap), F.lit(False))
    return F.struct(
        F.when(valid, gap).otherwise(SETTINGS_GAP).alias("gap"), F.when(valid, spacing).otherwise(SETTINGS_SPACING).alias("spacing")
    )


def restore_latest(snapshots: DataFrame, keys: list[str], order: str, version: str) -> DataFrame:
    """Latest snapshot per key if it was written by the running version; other keys start empty."""
    rest = [c for c in snapshots.columns if c not in keys]
    last = snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")
    return last.filter(F.col("version") == version)
