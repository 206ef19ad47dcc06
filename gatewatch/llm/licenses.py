"""Licence scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

Texts and templates are shingles of five lower-cased words.  A template's
windows start at each of its shingles, a text's overlap by half; windows have
four shingles, or two or one for templates too short for more, so that a text
window lies inside any copy of a template.  A band is one MinHash value of a
window: equal windows collide in all bands, windows of Jaccard similarity j
with probability 1 - (1 - j) ** bands, 0.94 at one half for four bands.  All of
it is built-in functions; the bands meet in a join on their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm.notices import TEXTS
from gatewatch.llm.tables import free, sized, stash
from gatewatch.llm.text import let, whole, words
from gatewatch.llm.winnowing import _tail, gram_hashes

#: Shingles of a window; bands of it, step of a text's windows, shingles that a template needs for it.
WINDOWS = {4: (4, 2, 5), 2: (2, 1, 2), 1: (1, 1, 1)}
CONTAINED = 80

# Notices of one line.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


#: All that a scan looks for by default: notices of one line, and whole texts and longer notices.
TEMPLATES = (*sorted(NOTICES.items()), *TEXTS)


def notices(spark: SparkSession) -> DataFrame:
    """TEMPLATES as a table.  A text of BSD-3-Clause holds all of BSD-2-Clause, and counts as both."""
    return spark.createDataFrame([*TEMPLATES], "license string, text string")


def _shingles(text: Column) -> Column:
    """Hashes of the five-word shingles; punctuation at the end of a word does not count."""
    bare = F.regexp_replace(F.lower(text), r"[.,;:!?\"'()]+(?=[\x20\x09-\x0D]|$)", "")
    return let(words(bare), lambda w: F.when(F.size(w) >= 5, gram_hashes(w)).otherwise(F.array().cast("array<bigint>")))


def _order(band: int) -> int:
    """What a band's hashes are XORed with, so that each band orders them anew."""
    return ((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) - (1 << 63)


def _turned(shingle: Column, band: int) -> Column:
    return shingle.bitwiseXOR(F.lit(_order(band)))


def _pairs(hashes: Column, band: int) -> Column:
    """The band's values of the windows of two shingles."""
    return let(_tail(hashes, 1), lambda t: F.zip_with(F.slice(hashes, F.lit(1), F.size(t)), t, lambda x, y: F.least(_turned(x, band), _turned(y, band))))


def _fours(pairs: Column, last: Column, step: int) -> Column:
    """The values of windows of four, from those of two: starts at 0, step, ... and last, none if that is negative."""
    steps = F.sequence(F.lit(0), last, F.lit(step))
    starts = F.when(last < 0, F.array().cast("array<int>")).when(last % step == 0, steps).otherwise(F.concat(steps, F.array(last)))
    return F.transform(starts, lambda i: F.least(F.get(pairs, i), F.get(pairs, i + 2)))


def _bands(hashes: Column, steps: dict[int, int]) -> Column:
    """Band values of the windows of the widths in ``steps``, at every so many shingles; widths share a pair's values."""
    last = F.size(hashes) - 4
    two = lambda m, band: [m] if 2 in steps and band < WINDOWS[2][0] else []
    four = lambda m: [_fours(m, last, steps[4])] if 4 in steps else []
    of = lambda band: let(_pairs(hashes, band), lambda m: F.concat(*two(m, band), *four(m)))
    found = [F.transform(hashes, lambda h: _turned(h, 0))] if 1 in steps else []
    return F.concat(*found, *[of(band) for band in range(max((WINDOWS[w][0] for w in steps if w > 1), default=0))])


def scan(docs: DataFrame, templates: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """doc_id, license, containment: templates of which ``contained`` percent of the shingles stand in a text.

    docs: doc_id, text; templates: license, text, any number of rows; other
    columns are not looked at.  Null texts and templates of fewer than five
    words match nothing; a license with several templates counts by its best.
    Rows that share a doc_id, null or not, give one result for each license,
    the best of them.  Texts of any length are hashed whole; ties do not arise.
    An empty table gives no rows.
    """
    width = F.coalesce(*[F.when(F.size("own") >= least, F.lit(w)) for w, (_, _, least) in sorted(WINDOWS.items(), reverse=True)])
    known = templates.select("license", _shingles(whole("text")).alias("own")).where(F.size("own") > 0)
    known = stash(known.withColumns({"width": width, "template": F.monotonically_increasing_id()}), "templates")
    widths = [r.width for r in known.select("width").distinct().collect()]  # three at most
    keys = F.coalesce(*[F.when(F.col("width") == w, _bands(F.col("own"), {w: 1})) for w in WINDOWS])
    by_key = stash(known.select("template", F.explode(keys).alias("key")).distinct(), "template-keys")

    docs = docs.select("doc_id", "text")
    hashed = docs.select("doc_id", _shingles(whole("text")).alias("hashes"))
    probes = _bands(F.col("hashes"), {w: WINDOWS[w][1] for w in widths}) if widths else F.array().cast("array<bigint>")
    met = stash(hashed.select("doc_id", F.explode(probes).alias("key")).join(sized(by_key), "key").select("doc_id", "template").distinct(), "met")
    free(by_key)
    # only texts that met a template are hashed again
    ids = stash(met.select(F.col("doc_id").alias("id")).distinct(), "ids")
    found = docs.join(sized(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("doc_id", _shingles(whole("text")).alias("hashes"))
    pairs = found.alias("d").join(met.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))).select("d.doc_id", "hashes", "template").join(known, "template")  # by size in bytes, as Spark sees fit: a template can be long
    share = F.size(F.array_intersect("hashes", "own")) / F.size(F.array_distinct("own"))
    return pairs.select("doc_id", "license", share.alias("share")).where(F.col("share") * 100 >= contained).groupBy("doc_id", "license").agg(F.max("share").alias("containment"))
