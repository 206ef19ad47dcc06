"""Periodic runs, byte-level BPE and the filter audit against plain versions."""

import hashlib
import random
import unicodedata
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import bytepairs, filters, periodic, queries
from gatewatch.llm.text import word_hashes

ODD = "doc_id long, text string, lang string, source string, n_chars long, runs string, ids string, decoded string, part string, mask string, good string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, a repeated row, an id with two texts, a very long text and word, columns of clashing names."""
    rows = [(1, "tick tock " * 30, "en"), (1, "tick tock " * 30, "en"), (1, "another text", None), (None, None, None), (None, "tick tock " * 30, "de"), (2, "x" * 50_000 + " " + "ab cd ef " * 4000, "en"), (3, "", "en"), (4, " \t\n", "de"), (20, "Ünïcode ١٢ 你好  　 A#", "")]
    return spark.createDataFrame([(*r, "s", 1, "a", "b", "c", "d", "e", "f") for r in rows], ODD).repartition(3).cache()


# --- periodic runs ---------------------------------------------------------


def plain_runs(words, least=24, times=3):
    """Every period, word by word."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, z - a, q) for (a, z), q in out.items())


def made_words(rng):
    words = [rng.choice("abcdef"[: rng.choice([1, 2, 3, 6])]) for _ in range(rng.choice([0, 1, 23, 24, 25, 40, 90, 200]))]
    for _ in range(rng.randrange(3) if words else 0):
        a, p = rng.randrange(len(words)), rng.randrange(1, 12)
        for i in range(a + p, min(len(words), a + rng.randrange(80))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (7, 4)])
def test_runs(least, times, monkeypatch):
    rng = random.Random(least)
    monkeypatch.setattr(periodic, "PAIRS", 64)
    for _ in range(400):
        words = made_words(rng)
        own = " ".join(words).encode().split()
        h, _ = word_hashes(pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], ["text"]), "text")
        want = plain_runs(words, least, times)
        assert periodic.runs(own, h, least, times) == want
        assert periodic.runs(own, h & np.uint64(1), least, times) == want  # most words share a hash


def plain_digest(words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def test_op11_query(spark):
    """Over a whole table: all that the query gives, against a plain version."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    ran = 0
    for i, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if n > 3000:
            continue  # by the square of the words
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert got[i] == plain_digest(words)
        ran += got[i][0] > 0
    assert ran > 5


def test_runs_of_odd_tables(odd):
    got = periodic.detect(odd).collect()
    by = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed if len(r.collapsed) < 100 else len(r.collapsed)) for r in got)
    ticks = [(0, 60, 2)]
    assert by == [(0, [], ""), (0, ticks, "tick tock"), (1, [], "another text"), (1, ticks, "tick tock"), (1, ticks, "tick tock"), (2, [(1, 12000, 3)], 50_009), (3, [], ""), (4, [], ""), (20, [], "Ünïcode ١٢ 你好 　 A#")]
    assert periodic.detect(odd.limit(0)).count() == 0
    none = queries.periodic_digests(periodic.detect(odd.where("doc_id = 3"))).first()
    assert tuple(none) == (3, 0, None, None, None, None, sha(b""), sha(b""))


def test_ties_between_runs(spark):
    """Equal exponents: the smaller start; a run inside another's rest, and two that share words."""
    text = " ".join(["a b"] * 12 + ["x"] + ["c d"] * 12)
    r = queries.periodic_digests(periodic.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 0, 24, 2, 12000)
    nested = (["a"] * 24 + ["b"]) * 3
    assert tuple(queries.periodic_digests(periodic.detect(spark.createDataFrame([(1, " ".join(nested))], "doc_id long, text string"))).first())[1:] == plain_digest(nested)


# --- byte-level BPE -----------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    path, pattern = queries.ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytepairs.merges_of(path).ranks, special_tokens={}).encode_ordinary


def ids_of(texts):
    import regex

    path, pattern = queries.ranks()
    ids, ends = bytepairs.encoded(pa.array(texts, pa.string()), bytepairs.merges_of(path), regex.compile(pattern).findall)
    return [ids[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)]


def test_every_character(tiktoken_ids):
    texts = [f"a{c} {c}1 {c}" for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Co", "Cn")]
    assert ids_of(texts) == [tiktoken_ids(t) for t in texts]


def test_random_texts(tiktoken_ids):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t'sdA1é日本語 ..!?aaaaa　\xa0\x1c\x85") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 3000, "".join(rng.choice("ab") for _ in range(5000)), "", " ", "你" * 2000]
    assert ids_of(texts) == [tiktoken_ids(t) for t in texts]


def test_merges_of_odd_vocabularies():
    """Random ranks, where a merge often makes a pair of an earlier rank, and tokens that no merge reaches."""
    rng = random.Random(8)
    late = 0
    for _ in range(60):
        tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(30)} | {b"cccccccc"}, key=lambda _: rng.random())
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        merges = bytepairs.Merges(ranks)
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(14))).encode() for _ in range(80)] + [b"cccccccc"]
        ids, ends = merges.replay(pieces)
        for i, p in enumerate(pieces):
            want = [ranks[p]] if p in ranks else merges.one(p)
            assert ids[ends[i] : ends[i + 1]].tolist() == want
            # would the order of ranks alone do?
            steps = merged_ranks(p, ranks)
            late += steps != sorted(steps)
    assert late > 10
    assert bytepairs.Merges(ranks).replay([])[0].tolist() == []


def merged_ranks(piece, ranks):
    """The rank of each merge of a piece, in order."""
    parts, out = [piece[i : i + 1] for i in range(len(piece))], []
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        rank, i = min(found)
        out.append(rank)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return out


def test_op12_query(spark, tiktoken_ids):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        ids = tiktoken_ids(text or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))


def test_bpe_of_odd_tables(odd, tiktoken_ids, monkeypatch):
    rows = odd.select("doc_id", "text").collect()
    for block in (bytepairs.BLOCK, 700):
        monkeypatch.setattr(bytepairs, "BLOCK", block)
        got = bytepairs.decode(bytepairs.encode(odd, *queries.ranks()), queries.ranks()[0]).collect()
        key = lambda r: (r[0] or 0, r[1])
        assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded).decode()) for r in got), key=key) == sorted(((r.doc_id, tiktoken_ids(r.text or ""), r.text or "") for r in rows), key=key)
    assert bytepairs.decode(bytepairs.encode(odd.limit(0), *queries.ranks()), queries.ranks()[0]).count() == 0


def test_blocks(monkeypatch):
    monkeypatch.setattr(bytepairs, "BLOCK", 100)
    texts = ["a" * n for n in (10, 60, 50, 500, 1, 2, 99, 101)] + [None, ""] + ["b" * 30] * 10
    parts = [b.column("text").to_pylist() for b in bytepairs._blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 200 for p in parts)


# --- filter audit ---------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order, document by document."""
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = [x.decode() for x in t.encode().split()]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v[:6], total[v[6]])
    return out


def as_table(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_every_order(spark):
    rng = random.Random(11)
    docs = []
    for i in range(300):
        n = rng.choice([0, 5, 199, 200, 230])
        words = [f"w{rng.randrange(rng.choice([90, 4000]))}" for _ in range(n)]
        if rng.random() < 0.3:
            words += ["A" * 60]
        if rng.random() < 0.2:
            words += [rng.choice("#$%&*|")]
        text = rng.choice(docs)[1] if docs and rng.random() < 0.3 else " ".join(words)
        docs.append((rng.choice([i, i, rng.randrange(300), None]), rng.choice([text, text, text, None]), rng.choice(["en", "en", "de", None, ""])))
    labels = [(rng.choice([rng.randrange(300), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)]
    got = filters.audit(filters.marked(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = plain_audit(docs, [r for r in labels if r[0] is not None])
    assert as_table(got) == want and len(want) == 3 * 600


def test_audit_of_odd_tables(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "y"), (2, None, 1, "z")], "doc_id long, quality int, toxic int, text string")
    got = filters.audit(filters.marked(odd, labels))
    assert as_table(got) == plain_audit(rows, [(1, 1, 0), (1, 0, 1), (2, None, 1)])
    assert filters.audit(filters.marked(odd.limit(0), labels)).count() == 0
    assert as_table(filters.audit(filters.marked(odd, labels.limit(0)))) == plain_audit(rows, [])


def test_zeta_and_other_filters(spark):
    counts = np.random.default_rng(2).integers(0, 50, (3, 8))
    alive = filters.zeta(counts, 3)
    for s in range(8):
        assert alive[:, s].tolist() == counts[:, [m for m in range(8) if not m & s]].sum(1).tolist()
    one = filters.audit(spark.createDataFrame([(None, 1, True, None), (None, 0, None, True)], "part string, mask int, good boolean, toxic boolean"), "X").collect()
    assert [tuple(r) for r in one] == [(None, "X", 1, 1, 1, 0, 1, 1, 0, 1)]
    with pytest.raises(ValueError, match="filters"):
        filters.audit(spark.range(1), "ABCDEFGHI")


def test_large_group_of_copies(spark):
    """A third of all rows is one text: all but the least id are copies."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("key"), F.lit(2).alias("mask"))
    out = filters.copies(df.withColumn("key", F.sha2("key", 256).cast("binary")))
    assert out.where("mask = 18").count() == 999 and out.where("mask = 2").count() == 2001
