"""Licence texts and notices of many families, found by bands and told apart."""

import random
import re

import pytest

from gatewatch.llm import licenses
from gatewatch.llm.notices import _BSD_BEGIN, _BSD_END, _BSD_NAMES, TEXTS


def shingles(text):
    w = [x for x in (re.sub(r"[.,;:!?\"'()]+$", "", x) for x in re.findall(r"[^\x20\x09-\x0D]+", text.lower())) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(rows):
    """By comparing every text with every template."""
    best = {}
    for i, text in rows:
        for name, known in licenses.TEMPLATES:
            share = len(shingles(text or "") & shingles(known)) / len(shingles(known))
            if 100 * share >= licenses.CONTAINED:
                best[i, name] = max(share, best.get((i, name), 0.0))
    return best


def scanned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.license): r.containment for r in licenses.scan(docs, licenses.notices(spark)).collect()}


def test_every_family_is_found_and_told_apart(spark):
    """A text of each: its own licence whole and no other; a whole text of BSD-3-Clause counts as both."""
    filler = "a file of some code that does nothing much "
    rows = [(i, f"{filler * 9}\n{text}\n{filler * 9}") for i, (_, text) in enumerate(TEXTS)]
    rows.append((len(TEXTS), _BSD_BEGIN + _BSD_NAMES + _BSD_END))
    got = scanned(spark, rows)
    want = {(i, name) for i, (name, _) in enumerate(TEXTS)} | {(len(TEXTS), "BSD-2-Clause"), (len(TEXTS), "BSD-3-Clause")}
    assert set(got) == want and all(got[i, name] == 1.0 for i, (name, _) in enumerate(TEXTS))
    assert got == pytest.approx(plain(rows))


def test_edited_texts(spark):
    """Words changed, lines wrapped anew, two licences in one text, half a licence: as by comparing all, 99 % or more of it."""
    rng, rows = random.Random(5), []
    for i in range(150):
        words = " ".join(text for _, text in rng.sample(TEXTS, rng.randint(1, 2))).split()
        for _ in range(rng.randint(0, len(words) // 25)):
            words[rng.randrange(len(words))] = "changed"
        if i % 10 == 0:
            words = words[: len(words) // 2]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words)))
    got, want = scanned(spark, [*rows, (998, None), (999, "")]), plain(rows)
    assert len(want) > 100 and set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(got[x] == pytest.approx(want[x]) for x in got)
