"""Document fingerprints by winnowing.

Word k-gram hashes are rolled up from word hashes; of each window of WINDOW
grams the least is chosen, the rightmost of equal ones, and kept with its
place.  Any WINDOW + K - 1 words that two texts share leave a common choice.
Everything is built-in functions on arrays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.llm.tables import sized, stash
from gatewatch.llm.text import let, whole, words

K = 5
WINDOW = 8
#: Low bits of a key that hold a gram's place, counted from the end so that the rightmost of equal hashes is least.
PLACE = 31


def _pairs(a: Column, b: Column) -> Column:
    """Hash of a[i] and b[i] as far as both go; b is a's tail."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, lambda x, y: F.xxhash64(x, y))


def _tail(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def gram_hashes(found: Column) -> Column:
    """Hashes of the runs of K = 5 words: 2 and 2 and 1.  Fewer words: the whole sequence as one; none: empty."""
    one = lambda h: let(_pairs(h, _tail(h, 1)), lambda two: let(_pairs(two, _tail(two, 2)), lambda four: _pairs(four, _tail(h, 4))))
    short = F.transform(F.array(found), lambda w: F.xxhash64(F.array_join(w, " ")))
    return F.when(F.size(found) == 0, F.array().cast("array<bigint>")).when(F.size(found) < K, short).otherwise(let(F.transform(found, lambda w: F.xxhash64(w)), one))


def _least(a: Column, by: int) -> Column:
    """Least of a[i] and a[i + by]; what has no partner goes."""
    return let(_tail(a, by), lambda t: F.zip_with(F.slice(a, F.lit(1), F.size(t)), t, lambda x, y: F.least(x, y)))


def choices(hashes: Column) -> Column:
    """The chosen keys in order of place: 32 bits of the hash, then the place from the end."""
    last = F.lit((1 << PLACE) - 1)
    keys = F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << 32) - 1)), PLACE) + (last - i))
    window = lambda k: let(_least(k, 1), lambda two: let(_least(two, 2), lambda four: _least(four, 4)))
    return let(keys, lambda k: F.array_distinct(F.when(F.size(k) > WINDOW, window(k)).when(F.size(k) > 0, F.array(F.array_min(k))).otherwise(k)))


def fingerprint(text: Column) -> Column:
    """Chosen keys of a text without nulls."""
    return let(words(text), lambda w: choices(gram_hashes(w)))


def spelled(keys: Column) -> Column:
    """hash:place of each choice, comma-joined; place is the gram's first word, from 0."""
    last = F.lit((1 << PLACE) - 1)
    return F.array_join(F.transform(keys, lambda k: F.concat_ws(":", F.hex(F.shiftright(k, PLACE)), last - k.bitwiseAND(last))), ",")


def _hashes(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda k: F.shiftright(k, PLACE)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the chosen hashes; two empty fingerprints are alike."""
    of = lambda x, y: let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / (F.size(x) + F.size(y) - n)))
    return let(_hashes(a), lambda x: let(_hashes(b), lambda y: of(x, y)))


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are no less than the value, by halving; bucket 0 has the largest values, nulls go to the last."""
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")  # one constant, however many

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(bounds, middle) < value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(middle).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.lit(len(cuts)) - F.when(value.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, half, lambda s: s["lo"]))


def with_next(docs: DataFrame, per_bucket: int = 4000) -> DataFrame:
    """docs: doc_id, text, keys.  Adds next_text and next_keys: those of the next row by descending doc_id, after the last the first.

    Rows are bucketed by ranges of doc_id; the first row of a bucket is also
    sent to the bucket before it, so no bucket sees another's rows.  Ties of
    doc_id go by text.  A null doc_id comes last.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    if not n:
        return docs.withColumns({"next_text": F.col("text"), "next_keys": F.col("keys")})
    parts = -(-n // per_bucket)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    placed = docs.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(cuts))))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    # a row per bucket: its first id and the bucket before it, which for the first one is the last
    heads, by = placed.groupBy("bucket").agg(F.max("doc_id").alias("top")), Window.orderBy("bucket")
    prior = F.coalesce(F.lag("bucket").over(by), F.max("bucket").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tagged = placed.join(sized(stash(heads.withColumn("prior", prior), "heads")), "bucket")
    here, ahead = (F.struct(to.alias("to"), F.lit(guest).alias("guest")) for to, guest in ((F.col("bucket"), 0), (F.col("prior"), 1)))
    go = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(here, ahead)).otherwise(F.array(here))
    sent = tagged.withColumn("go", F.explode(go)).select(*docs.columns, "go.to", "go.guest")
    by = Window.partitionBy("to").orderBy("guest", *order)
    found = sent.withColumns({"next_text": F.lead("text").over(by), "next_keys": F.lead("keys").over(by)})
    return found.where("guest = 0").drop("to", "guest")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id, text; other columns are not looked at.  A null text is empty,
    one of any length is hashed whole, of equal hashes in a window the
    rightmost is chosen.  A text's last half is
    overwritten by the beginning of the next document's; a single document is
    its own next one.  An empty table gives no rows.
    """
    text = docs.select("doc_id", whole("text").alias("text"))
    text = with_next(text.withColumn("keys", fingerprint(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = text.select("doc_id", n.cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_keys"))
    return out.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("keys")).alias("fingerprint"), spelled(F.col("edited_keys")).alias("edited_fingerprint"), likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"), likeness(F.col("keys"), F.col("next_keys")).alias("near_next"))
