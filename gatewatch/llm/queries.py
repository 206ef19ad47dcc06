"""Queries of the training-data operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm import bytepairs, classifier, filters, jaccard, licenses, mixing, packing, periodic, pii, quality, substrings, tokencount, winnowing
from gatewatch.llm.text import batches, raw


def _read(spark: SparkSession, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_quality_rules(spark, sf_dir):
    docs = _read(spark, sf_dir, "doc_id", "text", "source")
    # only the counts are needed further on: the text is not written
    judged = quality.judge(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "doc_id", "text"), vocabulary())


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard.classes(_read(spark, sf_dir, "doc_id", "text"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark, sf_dir):
    docs = _read(spark, sf_dir, "doc_id", "text", "source")
    return mixing.mix(docs, carry=False).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark, sf_dir):
    return pii.counted(pii.find(_read(spark, sf_dir, "doc_id", "text"), keep_text=False))


def op6_winnowing(spark, sf_dir):
    return winnowing.compared(_read(spark, sf_dir, "doc_id", "text"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.repeated(_read(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_quality_classifier(spark, sf_dir):
    labels = _read(spark, sf_dir, "doc_id", "quality", table="labels")
    return classifier.classify(_read(spark, sf_dir, "doc_id", "text", "source", "lang"), labels)


def op9_token_counts(spark, sf_dir):
    return tokencount.count(_read(spark, sf_dir, "doc_id", "text"), vocabulary())


def op10_license_scan(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "doc_id", "text"), licenses.notices(spark))


def _spun(it):
    """Of a tenth of the ids, chosen by checksum, the text from some word on repeats its next words to the end."""
    for b in batches(it):
        texts = raw(b, "text")
        for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
            h = zlib.crc32(str(doc_id).encode())
            if doc_id is None or h % 10 or not (words := (texts[i] or b"").split()):
                continue
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            texts[i] = b" ".join([*words[:a], *(words[a + k % p] for k in range(n - a))])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def periodic_digests(found: DataFrame) -> DataFrame:
    """Rows of periodic.detect() as counts, the run of greatest exponent and checksums."""
    exponent = lambda r: r["length"] / r["period"]
    best = F.array_max(F.transform("runs", lambda r: F.struct(exponent(r).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # whole numbers only: 1000 * length / period rounded down
    milli = F.expr("1000 * b.n DIV -b.p")
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.n").alias("length"), (-F.col("b.p")).alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op11_periodic_runs(spark, sf_dir):
    docs = _read(spark, sf_dir, "doc_id", "text")
    return periodic_digests(periodic.detect(docs.mapInArrow(_spun, "doc_id long, text string")))


def ranks() -> tuple[str, str]:
    """Path and pattern of a rank file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def byte_pair_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    both = bytepairs.decode(bytepairs.encode(docs, path, pattern), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_byte_bpe(spark, sf_dir):
    return byte_pair_digests(_read(spark, sf_dir, "doc_id", "text"), *ranks())


def op13_filter_audit(spark, sf_dir):
    labels = _read(spark, sf_dir, "doc_id", "quality", "toxic", table="labels")
    return filters.audit(filters.marked(_read(spark, sf_dir, "doc_id", "text", "lang"), labels))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_ngram_jaccard, op4_mixing, op5_pii, op6_winnowing, op7_substring_dedup, op8_quality_classifier, op9_token_counts, op10_license_scan, op11_periodic_runs, op12_byte_bpe, op13_filter_audit)}
_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

NGRAM_SQL = f"""
WITH RECURSIVE {_WORDS},
l AS (SELECT doc_id, list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM l),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.node = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

SUBSTRING_SQL = f"""
WITH {_WORDS},
g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: array_to_string(ws[i:i + 49], ' '))) AS g FROM w WHERE len(ws) >= 50),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM g JOIN f USING (g), range(50) AS k(j) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_quoted = lambda text: "'" + text.replace("'", "''") + "'"

LICENSE_SQL = f"""
WITH known AS (SELECT 'template ' || row_number() OVER () AS id, license, t FROM (VALUES {", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.TEMPLATES)}) AS v(license, t)),
texts AS (SELECT doc_id::VARCHAR AS id, doc_id, NULL AS license, coalesce(text, '') AS t FROM documents UNION ALL SELECT id, NULL, license, t FROM known),
b AS (SELECT id, doc_id, license, list_filter(list_transform(regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+'), lambda x: regexp_replace(x, '[.,;:!?"''()]+$', '')), lambda x: x <> '') AS ws FROM texts),
s AS (SELECT DISTINCT id, doc_id, license, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM b WHERE len(ws) >= 5),
n AS (SELECT id, count(*) AS n FROM s WHERE doc_id IS NULL GROUP BY 1),
m AS (SELECT a.doc_id, o.license, n.id, count(*) / any_value(n.n) AS containment FROM s a JOIN s o ON a.g = o.g AND a.doc_id IS NOT NULL AND o.doc_id IS NULL JOIN n ON n.id = o.id GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment FROM m WHERE containment * 100 >= 80 GROUP BY 1, 2
"""

ORACLES = {"op1_quality_rules": quality.SQL, "op3_ngram_jaccard": NGRAM_SQL, "op7_substring_dedup": SUBSTRING_SQL, "op10_license_scan": LICENSE_SQL, "op13_filter_audit": filters.SQL}
