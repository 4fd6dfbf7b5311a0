"""The stages of the pipeline: names that clash, two runs in one session, long labelled texts."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ringsight.llm import crf_quality, near_copies, quality_rules, substring_dedup
from small import DOCS, edge_rows, words

SF = "/root/testdata/sf0.001"
LLM = Path(crf_quality.__file__).parent


def internal_names() -> list[str]:
    """Every name with an underscore in front, and every column that the modules of the stages mention, as far as an extra column can have it."""
    text = "".join((LLM / f"{m}.py").read_text() for m in ("crf_quality", "quality_rules", "near_copies", "simhash_dedup", "substring_dedup", "components"))
    own = {n.split()[0] for n in DOCS.split(", ")}
    return sorted({n.lower() for n in re.findall(r'"(_?[a-z][a-z0-9_]*)"', text)} - own)


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "s0", None if t is None else len(t)) for i, t in edge_rows()]
    rng = random.Random(2)
    rows += [(100 + i, "\n".join(" ".join(words(rng, 12)) + "." for _ in range(8)), "en", "s0", 700) for i in range(60)]
    rows += [(200, rows[-1][1], "en", "s0", 700), (201, rows[-2][1] + " more", None, None, 705)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in internal_names()])


STAGES = {
    "rules": quality_rules.filter_documents,
    "copies": near_copies.keep_one,
    "repeats": substring_dedup.without_repeats,
    "classifier": lambda d: crf_quality.filter_documents(
        d, d.sparkSession.createDataFrame([(i, int(i >= 100)) for i in [*range(40), *range(100, 160)]], "doc_id long, quality int")
    ),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_pass_columns_of_any_name(spark, clashing, name):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda r: (r["doc_id"] is None, r["doc_id"], str(r["text"]), r["n_chars"] or 0)
    want = sorted((tuple(r) for r in STAGES[name](plain).collect()), key=str)
    out = STAGES[name](clashing)
    assert out.columns == clashing.columns and out.schema["n_chars"].dataType == clashing.schema["n_chars"].dataType
    rows = out.collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == want and len(want) > 20
    for r in sorted(rows, key=key):
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for n in internal_names())


def test_two_runs_are_read_in_any_order(spark):
    first, second = (corpus_pipeline.run(spark, SF) for _ in range(2))
    b = sorted(map(tuple, second.collect()))
    assert sorted(map(tuple, first.collect())) == b and sorted(map(tuple, first.collect())) == b


def test_stages_of_two_runs_may_alternate(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")] * 2
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = [stage(spark, d, SF) for d in docs]
    a, b = (sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in reversed(docs))
    assert a == b and len(a) > 20


def test_long_labelled_texts_are_learnt_from(spark):
    rng = random.Random(1)
    good = lambda: "\n".join(" ".join(words(rng, 10)) + "." for _ in range(700))
    bad = lambda: "\n".join("### $$$ !!! " * 4 for _ in range(700))
    rows = [(i, good() if i % 2 else bad(), "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    assert docs.agg(F.min(F.length("text"))).first()[0] > 20_000
    kept = crf_quality.filter_documents(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(1, 40, 2))


def test_a_long_text_is_learnt_from_evenly(spark):
    rows = [(0, 1, "\n".join(f"line {i}" for i in range(5000))), (1, 0, None), (2, 0, "a\nb")]
    df = spark.createDataFrame(rows, "doc long, label int, text string").coalesce(1)
    made = {r["doc"]: len(r["x"]) // crf_quality.N_FEATURES for r in df.mapInArrow(crf_quality._lessons, "doc long, label int, x array<double>").collect()}
    assert made == {0: crf_quality.TRAIN_RUNS * crf_quality.RUN_LINES, 1: 1, 2: 2}
