"""Host-level quality rules: document rules, host failure rates under an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import sized, stash
from gatewatch.llm.text import GAP, fresh, let, whole, words

MIN_WORDS = 50
#: Shares in percent beyond which a rule fails: repeated words, symbols and repeated lines by words and lines.
REPEATED, SYMBOLS, DUP_LINES = 50, 10, 30
#: Mean word lengths outside these fail.
SHORT_WORD, LONG_WORD = 2, 15
#: A host is rejected beyond this shrunk failure rate.
HOST_RATE = 0.5
#: The prior counts as so many documents at most.
STRENGTH = 1000.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("fails_short", "fails_repeat", "fails_symbols", "fails_dup_lines", "fails_word_length")


def _repeat_words(found: Column) -> Column:
    """Words in 3-word windows that come twice or more; windows are compared by a 64-bit hash within their text."""

    def marked(pairs: Column) -> Column:
        # neighbours in hash order that are equal
        other = lambda j: F.get(pairs, j)["h"]
        starts = F.filter(F.transform(pairs, lambda x, j: F.when((x["h"] == other(j - 1)) | (x["h"] == other(j + 1)), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), 0).otherwise(let(pairs, marked))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(found) < 4, 0).otherwise(let(windows(found), counted))


def measured(docs: DataFrame) -> DataFrame:
    """The columns of docs, then COUNTS (long) and RULES (boolean)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*COUNTS, *RULES)]
    text = whole("text")
    own, line = fresh(docs, "words", "lines")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = docs.select(*keep, words(text).alias(own), lines.alias(line))
    counts = {
        "n_words": F.size(own),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
        "n_lines": F.size(line),
        "n_dup_lines": F.size(line) - F.size(F.array_distinct(line)),
        "n_repeat_words": _repeat_words(F.col(own)),
    }
    at = at.select(*keep, *[v.cast("long").alias(k) for k, v in counts.items()])
    n = F.col("n_words")
    rules = {
        "fails_short": n < MIN_WORDS,
        "fails_repeat": 100 * F.col("n_repeat_words") > REPEATED * n,
        "fails_symbols": 100 * F.col("n_symbols") > SYMBOLS * n,
        "fails_dup_lines": 100 * F.col("n_dup_lines") > DUP_LINES * F.col("n_lines"),
        "fails_word_length": (F.col("word_chars") < SHORT_WORD * n) | (F.col("word_chars") > LONG_WORD * n),
    }
    return at.withColumns(rules)


def hosts(judged: DataFrame) -> DataFrame:
    """host, host_docs, host_fails, host_rate: failures by host, shrunk by a beta prior fitted to all hosts by moments."""
    failed = F.greatest(*[F.col(r).cast("int") for r in RULES])
    by = stash(judged.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("host_docs"), F.sum(failed).alias("host_fails")), "hosts")
    rate = F.col("host_fails") / F.col("host_docs")
    m = by.agg((F.sum("host_fails") / F.sum("host_docs")).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean = m.mean or 0.0
    strength = min(STRENGTH, max(1.0, mean * (1 - mean) / m.var - 1)) if m.var else STRENGTH
    return sized(by).withColumn("host_rate", (F.col("host_fails") + F.lit(strength * mean)) / (F.col("host_docs") + F.lit(strength)))


def _evidence() -> Column:
    """How much likelier a document's own failures are in junk: squared excess over each failed limit, 1 for none.

    Bars that stand alone are cells of a table and no symbols here.
    """
    n, lines = F.col("n_words"), F.col("n_lines")
    symbols = 100 * (F.col("n_symbols") - F.col("n_bars")) / (SYMBOLS * n)
    # odds, as a share ends at 1; the first copy of a line keeps it below
    dup = F.col("n_dup_lines") * (100 - DUP_LINES) / (DUP_LINES * (lines - F.col("n_dup_lines")))
    long, short = F.col("word_chars") / (LONG_WORD * n), SHORT_WORD * n / F.col("word_chars")
    excess = lambda x: F.greatest(F.lit(1.0), F.coalesce(x, F.lit(1.0)))
    return F.pow(excess(symbols) * excess(dup) * excess(long) * excess(short), 2)


def posterior(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """The columns of judge(), then n_bars, p_junk and wanted.

    p_junk: the host's shrunk failure rate (tables not counted as failures) as
    prior odds, times the evidence of the document's own failures; 1 where the
    base rules fail.  wanted: p_junk is HOST_RATE at most.  A document that
    fails nothing goes only with its host, one that fails much goes anywhere.
    """
    docs = docs.drop("n_bars", "p_junk", "wanted")
    bars = F.length(F.regexp_replace(whole("text"), r"(?<![#*$%&|<>])\|(?![#*$%&|<>])", ""))
    judged = judge(docs.withColumn("n_bars", (F.length(whole("text")) - bars).cast("long")), keep_text=keep_text)
    symbols = 100 * (F.col("n_symbols") - F.col("n_bars")) > SYMBOLS * F.col("n_words")
    by = hosts(judged.drop("fails_symbols").withColumn("fails_symbols", symbols))
    prior = F.col("h.host_rate")
    odds = prior / (1 - prior) * _evidence()
    p = F.when(F.col("base_failed") | (prior >= 1), 1.0).otherwise(odds / (1 + odds))
    out = judged.alias("d").join(by.alias("h"), F.col("d.source").eqNullSafe(F.col("h.host"))).select("d.*", p.alias("p_junk"))
    return out.withColumn("wanted", F.col("p_junk") <= HOST_RATE)


def judge(docs: DataFrame, host_rate: float = HOST_RATE, keep_text: bool = True) -> DataFrame:
    """The columns of docs, COUNTS, RULES, host_rate, base_failed, kept.

    docs: text, source and any others.  A null text has no words and fails, a
    null source is a host of its own, repeated rows count as often as they
    come, columns of the input named as the added ones are replaced and all
    others kept, an empty table gives no rows.  A text of any length is counted
    whole, its words in one array; nothing depends on the order of rows.  A
    document that passes the base rules goes only with a rejected host.
    """
    judged = measured(docs)
    judged = stash(judged if keep_text else judged.drop("text"), "measured")
    by, out = hosts(judged), judged.drop("host_rate", "base_failed", "kept")
    out = out.alias("d").join(by.alias("h"), F.col("d.source").eqNullSafe(F.col("h.host"))).select("d.*", "h.host_rate")
    base = F.col("fails_short") | F.col("fails_repeat")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("host_rate") <= host_rate))


#: The same in SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) > 2),
p AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
n AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM p, (VALUES (0), (1), (2)) AS k(j) GROUP BY r),
c AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM c),
h AS (SELECT source, count(*) AS docs, sum(failed::INT) AS fails FROM f GROUP BY source),
m AS (SELECT sum(fails) / sum(docs) AS mean, var_pop(fails / docs) AS var FROM h),
s AS (SELECT mean, CASE WHEN var > 0 THEN least(1000, greatest(1, mean * (1 - mean) / var - 1)) ELSE 1000 END AS strength FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (fails + strength * mean) / (docs + strength) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN s
"""
