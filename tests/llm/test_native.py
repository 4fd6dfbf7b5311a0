"""Quality rules, URL filter and license scan against SQL or plain Python."""

import re

import duckdb
import pytest
from check import compare, connect
from small import docs, edge_rows

import __spark_entry__ as entry
from ringsight.llm import license_scan, quality_rules, url_filter
from ringsight.llm.queries import ORACLE_SQL, URL_RULES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    ok, note, _ = compare(spark, connect(path), name, entry.queries()[name], entry.oracle_sql()[name], path)
    assert ok, note


def duck(df, name, sql):
    con = duckdb.connect()
    con.register(name, df.toArrow())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return [dict(zip(columns, row, strict=True)) for row in cur.fetchall()]


def same(spark_rows, sql_rows, columns):
    plain = lambda r: tuple((r[c] is None, str(r[c])) for c in columns)
    assert sorted(map(plain, spark_rows)) == sorted(map(plain, sql_rows))


QUALITY_ROWS = [
    *edge_rows(),
    (60, "a b c a b c a b c " * 20),
    (61, "\n".join(["same line here", " same line here", "same line here", "", "  ", "same line here"] * 20)),
    (62, "*** ### $$$ %%% &&& " * 30, None, "s"),
    (63, "one | two | three <b> " * 30, "en", None),
    (64, "x\x0by\x0cz\r\n\tq " * 40),
]


def test_quality_rules_on_edge_cases(spark):
    df = docs(spark, QUALITY_ROWS, extra=True)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality_rules.assess(df)
    assert got.columns == columns
    same(got.collect(), duck(docs(spark, QUALITY_ROWS), "documents", quality_rules.oracle()), columns)


def test_quality_thresholds_follow_their_group(spark):
    """A source that always writes with symbols keeps them; the same text in a plain source goes."""
    plain, marked = "word of plain text goes on here " * 10, "word * of & plain * text & goes " * 10
    rows = [(i, plain + str(i), "en", "plain") for i in range(250)] + [(1000 + i, marked + str(i), "en", "marked") for i in range(250)]
    rows += [(5000, "# $ % & " * 5 + plain, "en", "plain"), (5001, "* " * 300 + plain, "en", "plain")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.assess(docs(spark, [(i, t.replace("goes", f"goes{i}"), a, b) for i, t, a, b in rows])).collect()}
    base = {r["doc_id"] for r in quality_rules.assess(docs(spark, rows)).filter("base_failed").collect()}
    assert len(base) > 400  # the repeated phrases
    rich = lambda i, lead: " ".join(f"{lead}w{(i * 131 + j * 17) % 9973}" for j in range(120))
    rows = [(i, rich(i, ""), "en", "plain") for i in range(250)] + [(1000 + i, rich(i, "*"), "en", "marked") for i in range(250)]
    rows += [(5000, rich(7, "*"), "en", "plain"), (5001, rich(8, "*"), "en", "rare"), (5002, rich(9, ""), None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.assess(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(250)) and all(got[1000 + i] for i in range(250))
    assert not got[5000] and got[5002]
    assert kept  # computed without failure


def test_sketch_merges(spark):
    """Fences of parts added up are those of the whole, and buckets keep a value to one part in 32."""
    from pyspark.sql import functions as F

    values = spark.range(0, 5000).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] < r["b"] + max(r["b"] // 32, 1) + 1 for r in values)
    df = docs(spark, QUALITY_ROWS)
    whole = quality_rules.sketch(quality_rules.measure(df))
    halves = quality_rules.sketch(quality_rules.measure(df.filter("doc_id % 2 = 0"))).unionAll(
        quality_rules.sketch(quality_rules.measure(df.filter("doc_id % 2 = 1")))
    )
    named = whole.filter("lang is not null or source is not null")
    assert named.count() > 0
    a = {r["ratio"]: r.asDict() for r in quality_rules.fences(quality_rules.sketch(quality_rules.measure(df.filter("doc_id is not null"))).withColumn("k", F.lit(1)), ["k", "ratio"][:1]).select("k", "size", F.lit("x").alias("ratio"), "symbols_most").collect()}
    b = {r["ratio"]: r.asDict() for r in quality_rules.fences(halves.withColumn("k", F.lit(1)), ["k"]).select("k", "size", F.lit("x").alias("ratio"), "symbols_most").collect()}
    assert a == b


def test_quality_filter_keeps_columns(spark):
    df = docs(spark, QUALITY_ROWS, extra=True)
    kept = quality_rules.filter_documents(df)
    assert kept.columns == df.columns
    want = [r["doc_id"] for r in quality_rules.assess(df).filter("kept").collect()]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in kept.collect())


URLS = [
    "http://a.example.com/en/x?q#f", "HTTPS://WWW.Example.COM/en/", "http://example.com", "http://example.com?/en/", "ftp://b.net/es/1", "x.net/es/", None, "",
    "http://net/es/", "http://notnet/es/", "http://a.b.c.net/fr/#x", "http://example.com/EN/", "http://example.com/en", "http://example.net./es/", "://com/",
    "http://user@example.com:80/en/", "http://é.com/en/\nfoo", "http://www.example.com/en/a://b.net/es/", "http://ÉXAMPLE.COM/", "http:///en/", "http://com/x",
]


@pytest.mark.parametrize("rules", [URL_RULES, [("block", "net"), ("allow", "net/e"), ("block", "example.com/en/x"), ("allow", "b.c.net/fr"), ("block", "c.net/fr/#"), ("allow", "c.net/f")], []])
def test_urls_on_edge_cases(spark, rules):
    rows = [(i if i % 7 else None, u, "x", "y") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    want = []
    for page_id, url, *_ in rows:
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(r), len(r.partition("/")[0]), a, r) for a, r in rules for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        best = max(fit, default=None)
        want.append({"page_id": page_id, "host": host, "path": path, "rule": best and best[3], "verdict": best[2] if best else "allow"})
    same(got, want, ["page_id", "host", "path", "rule", "verdict"])


def test_urls_of_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).count() == 0


LICENSES = [
    "Released under the MIT License.", "mit, license mit LICENSE mit-license", "commit license", "This work is licensed under the GNU General Public License, version 3 or any later version.",
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: MIT\n" * 30, "All rights reserved. All Rights Reserved",
    "Licensed under CC BY-NC 4.0", "BSD 3-Clause license, MIT license, GPL v3 license", "permission is hereby granted, free of charge, to any person obtaining a copy of the MIT license",
    "Mozilla Public License 2.0 or Apache license", "mit lizenz", "general public license general public license", "license", "apache   \n license é apache", "apache éé license",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License",
]


def brute_scan(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    flat = "".join(f" {w}" for w in ws) + " "
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for order, keyword, expression, label, tier, confidence in license_scan.rules():
        if f" {keyword} " in flat and any(s in (text or "").lower() for s in license_scan.STEMS):
            for m in re.finditer(expression, flat):
                start = flat[: m.start()].count(" ")
                found.append((start, start + m[0].count(" "), tier, -order, label, confidence))

    def covered(d):
        return any(e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[0], e[1]) != d[:2] or e[2:4] > d[2:4]) for e in found)

    kept = [d for d in found if not covered(d)]
    base = {label for _, label in places}
    score = max([d[5] for d in kept] + ([license_scan.BASE_SCORE] if base else [0.0]))
    starts = [i for i, _ in places]
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), score


def test_licenses_match_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(LICENSES)] + [(100, " ".join(LICENSES)), (101, " ".join(LICENSES) * 3), (102, None), (103, ""), (0, LICENSES[3]), (None, LICENSES[0]), (1, LICENSES[1])]
    got = license_scan.scan(docs(spark, rows, extra=True))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert got.columns == columns
    same(got.collect(), [dict(zip(columns, (d, *brute_scan(t)), strict=True)) for d, t in rows], columns)


def test_last_license_after_line_separators(spark):
    """U+0085, U+2028 and U+2029 are letters of words here; a dot does not match them in Java."""
    marks = ["\u0085", "\u2028", "\u2029"]
    rows = [(i, f"lead{m} MIT License and more{m} words, MIT License again {m} end") for i, m in enumerate(marks)] + [(3, f"{''.join(marks)} license mit")]
    got = license_scan.scan(docs(spark, rows)).select("doc_id", "n_base", "first_word", "last_word").collect()
    want = [brute_scan(t)[1:4] for _, t in rows]
    assert want[:3] == [(2, 1, 6)] * 3
    assert {r[0]: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_license_rules_are_many_and_ordered(spark):
    assert len(license_scan.rules()) >= 300
    assert [r[0] for r in license_scan.rules()] == list(range(len(license_scan.rules())))
    assert license_scan.scan(docs(spark, [(1, "x")]).filter("doc_id = 2")).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_url_filter", "op6_license_scan"])
def test_native_operators_run_no_python(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("MapInArrow|Python|Pandas|CartesianProduct", plan)
