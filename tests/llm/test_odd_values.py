"""Licence scans and token counts of odd tables, by value."""

import pytest

from gatewatch.llm import licenses, tokencount
from gatewatch.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, license string, template string, own string, n_words long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", -1) for r in rows], SCHEMA).repartition(2)


def test_licenses_of_odd_tables(spark):
    """Repeated and null ids that match, a notice deep in a long text, one as a whole text, one short of its share."""
    mit, gpl = licenses.NOTICES["MIT"], licenses.NOTICES["GPL-3.0"]
    filler = "some words that say nothing of licences at all " * 20_000
    rows = [(1, f"Code. {mit}"), (1, f"Code. {mit}"), (1, f"{gpl} {mit}"), (None, f"a {mit} b"), (None, None), (None, f"{gpl}"), (2, filler + mit + " " + filler), (3, mit.upper()), (4, "Released under the"), (5, ""), (6, "This work is licensed under nothing")]
    got = sorted(((r.doc_id, r.license, round(r.containment, 3)) for r in licenses.scan(table(spark, rows), licenses.notices(spark)).collect()), key=str)
    assert got == sorted([(1, "MIT", 1.0), (1, "GPL-3.0", 1.0), (None, "MIT", 1.0), (None, "GPL-3.0", 1.0), (2, "MIT", 1.0), (3, "MIT", 1.0)], key=str)
    assert licenses.scan(table(spark, rows).limit(0), licenses.notices(spark)).count() == 0


def test_templates_of_any_size(spark):
    """Long templates beside short ones, one of them twice, without a hint to send them to all tasks."""
    long = " ".join(f"clause{i} of term{i * 7 % 1009}" for i in range(4000))
    words = long.split()
    templates = spark.createDataFrame([("Long", long), ("Long", "another text of the same licence here"), ("Short", "five words make one shingle"), ("None", "too short"), ("Null", None)], "license string, text string")
    rows = [(1, long), (2, "x " + " ".join(words[:11_000])), (3, " ".join(words[:6000])), (4, "yes five words make one shingle here"), (5, "another text of the same licence here")]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(table(spark, rows), templates).collect()}
    assert set(got) == {(1, "Long"), (2, "Long"), (4, "Short"), (5, "Long")} and got[1, "Long"] == got[5, "Long"] == 1.0
    assert got[2, "Long"] == pytest.approx(10_996 / 11_996, abs=1e-9)


def test_token_counts_of_odd_tables(spark):
    from tokenizers import Tokenizer

    rows = [(1, "The cat"), (1, "The cat"), (None, "the"), (2, None), (3, " \t\n"), (4, "word " * 30_000)]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_tokens) for r in tokencount.count(table(spark, rows), vocabulary()).collect()))
    known = lambda t: len(Tokenizer.from_file(vocabulary()).encode(t, add_special_tokens=False).ids)
    assert got == sorted([(1, 2, known("the cat")), (1, 2, known("the cat")), (0, 1, known("the")), (2, 0, 0), (3, 0, 0), (4, 30_000, 30_000 * known("word"))])
