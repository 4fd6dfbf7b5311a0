"""Ranges of concatenated image streams against the split of the whole file."""

import io
import random

import pytest
from pyspark.sql import functions as F

from ringsight.sources import readers

START, END = readers.IMAGE_START, readers.IMAGE_END


def noisy(rng, n):
    """Markers in any order, halves of markers, bytes between and inside images, an open tail now and then."""
    parts = [START, END, b"\xff", b"\xd8", b"\xd9", b"ab", b"", START + b"thumb" + START, b"x" * 17]
    return b"".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("block", [1, 2, 3, 16, 1000])
def test_ranges_give_the_images_of_the_whole(block):
    rng = random.Random(block)
    for _ in range(60):
        data = noisy(rng, rng.randrange(0, 60))
        width = rng.randrange(1, 90)
        want = list(readers._split(data))
        got = []
        for first in range(0, len(data), width):
            got += readers.images_between(io.BytesIO(data), first, min(first + width, len(data)), block)
        assert got == want


def write(folder, contents):
    for i, data in enumerate(contents):
        (folder / f"cam{i}.mjpeg").write_bytes(data)


def whole(contents):
    """(file, image_no, sequence_no, offset, image, truncated)"""
    rows, total = [], 0
    for i, data in enumerate(contents):
        for k, (at, image, cut) in enumerate(readers._split(data)):
            rows.append((f"cam{i}.mjpeg", k, total, at, image, cut))
            total += 1
    return rows


def plain(df):
    name = F.element_at(F.split("path", "/"), -1)
    return sorted(tuple(r) for r in df.select(name, "image_no", "sequence_no", "offset", "image", "truncated").collect())


def test_read_and_number(spark, tmp_path):
    rng = random.Random(1)
    contents = [noisy(rng, 400), b"", b"no image here", START + b"open to the end", noisy(rng, 3000)]
    write(tmp_path, contents)
    for width in (50, 999, readers.RANGE_BYTES):
        images = readers.read_image_streams(spark, str(tmp_path), range_bytes=width)
        assert plain(readers.numbered_images(images)) == sorted(whole(contents))


def test_one_large_file_is_many_tasks(spark, tmp_path):
    image = START + bytes(200_000) + END
    write(tmp_path, [image * 300])
    images = readers.read_image_streams(spark, str(tmp_path), range_bytes=1 << 20)
    tasks = images.select(F.spark_partition_id().alias("task"), F.length("image").alias("size"), "offset")
    row = tasks.agg(F.countDistinct("task"), F.count("*"), F.countDistinct("offset"), F.min("size"), F.max("size")).first()
    assert row[0] > 1 and tuple(row[1:]) == (300, 300, len(image), len(image))


def test_no_image_is_an_error(spark, tmp_path):
    write(tmp_path, [b"nothing", b""])
    with pytest.raises(ValueError):
        readers.numbered_images(readers.read_image_streams(spark, str(tmp_path)))


def test_new_files_as_a_stream(spark, tmp_path):
    rng = random.Random(2)
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    contents = [noisy(rng, 200), noisy(rng, 300)]

    def drain():
        images = readers.read_image_streams(spark, str(source), stream=True, range_bytes=100)
        q = images.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
        q.awaitTermination()

    write(source, contents[:1])
    drain()
    write(source, contents)  # the first file again, unchanged: seen already by its name
    drain()
    assert plain(readers.numbered_images(spark.read.parquet(str(out)))) == sorted(whole(contents))
