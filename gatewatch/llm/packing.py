"""Best-fit packing by hierarchical residual packing.

Every input partition packs its own pieces best-fit, longest first, and closes
bins that are nearly full.  Its underfull bins then travel up a tree as items:
groups of partitions merge them best-fit again until one group is left.  A node
has at most one bin that is half empty or more, so what travels is bounded by
``CARRY`` bins per node; further underfull bins (all over half full, which no
other such bin can join) are closed where they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import stash
from gatewatch.llm.text import Cached, batches, raw

CAPACITY = 4096
END_ID = 1
#: A bin with less room than 1/64 of its capacity counts as full.
FULL = 64
#: Underfull bins that a node hands to the next level at most.
CARRY = 512
FAN = 8
#: Entries of a task's two word caches.
WORDS = 900_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, load long, open boolean"
_NODE = 1 << 32  # a bin's number is its node times this, plus its place there


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[bytes], bytes]:
    """Text -> little-endian ids of ``word_bpe``-style tokenizers, kept per word.

    White space never reaches such a tokenizer's model, so the ids of a text
    are those of its words in a row.  Words of plain Latin letters (composed
    ones, as normal form C leaves them) are split into model words here; all others go through the whole tokenizer.
    A Python worker keeps its encoder from task to task.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    model = tokenizer.model
    plain = re.compile("[!-~¡-įı-ɏ]+").fullmatch
    # The tokenizer's own pre-token pattern and its byte alphabet.
    cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    alphabet = {b: chr(256 + i) for i, b in enumerate(others)}

    def model_word(word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(alphabet)
        return b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(spelled))

    known = Cached(model_word, WORDS)

    def chunk(word: bytes) -> bytes:
        text = word.decode(errors="replace")
        if plain(text) and "<|" not in text:
            return b"".join(map(known.__getitem__, cut(text.lower())))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    get = Cached(chunk, WORDS).__getitem__
    # case is lost anyway, but for special tokens, which are looked for first
    return lambda text: b"".join(map(get, (text if b"<|" in text else text.lower()).split()))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and each bin's load; longest first, the tightest bin that has room."""
    where, at, loads = [0] * len(lengths), [0] * len(lengths), []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        if fits := rooms >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        where[i], at[i] = b, loads[b]
        loads[b] += need
        if left := room - need:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return where, at, loads


def travelling(loads: list[int], capacity: int) -> set[int]:
    """The bins that go up a level: underfull ones, the emptiest first, CARRY at most."""
    under = [b for b, load in enumerate(loads) if capacity - load > capacity // FULL]
    return set(sorted(under, key=lambda b: (loads[b], b))[:CARRY])


def _pack(vocabulary: str, capacity: int, end_id: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node = encoder(vocabulary), TaskContext.get().partitionId()
        ids, piece, start, length, crc = [], [], [], [], []
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches(it):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw(b, "text"), strict=True):
                all_ids = encode(text or b"") + end
                for k, i in enumerate(range(0, len(all_ids), width)):
                    own = all_ids[i : i + width]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(i // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
        where, at, loads = best_fit(length, capacity)
        up = travelling(loads, capacity)
        columns = [ids, piece, start, length, crc, [node * _NODE + x for x in where], at, [loads[x] for x in where], [x in up for x in where]]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        for i in range(0, len(ids), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000], t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _merge(capacity: int) -> Callable:
    def run(key, pdf):
        pdf = pdf.sort_values("bin")
        where, at, loads = best_fit(pdf["load"].tolist(), capacity)
        up = travelling(loads, capacity)
        return pdf.assign(new=[int(key[0]) * _NODE + w for w in where], at=at, load=[loads[w] for w in where], open=[w in up for w in where])[["bin", "new", "at", "load", "open"]]

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document and their place in sequences of at most ``capacity`` tokens.

    docs: doc_id, text; other columns are not looked at.  A null or empty text
    is the end id alone; a document beyond the capacity, however long, is cut,
    its last piece being the short one.  Pieces of one length go by their place
    in the input.  Repeated rows are packed as often as they come.  An empty
    table gives no rows.
    """
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_pack(vocabulary, capacity, end_id), PIECES), "pieces")
    moved = None  # bin -> where it lies by now
    level = pieces.where("open").groupBy("bin").agg(F.first("load").alias("load"))
    top = pieces.agg(F.max("bin")).first()[0] or 0
    nodes, depth = top // _NODE + 1, 0
    while nodes > 1:
        depth += 1
        # numbers of a merge do not meet those of any lower level
        base = (1 << 30) // (1 << depth)
        group = F.floor(F.pmod(F.floor(F.col("bin") / _NODE), F.lit(base * 2)) / FAN) + F.lit(base)
        step = stash(level.withColumn("node", group.cast("long")).groupBy("node").applyInPandas(_merge(capacity), "bin long, new long, at long, load long, open boolean"), "merged")
        if moved is None:
            moved = step.select("bin", F.col("new").alias("sequence_id"), F.col("at").alias("shift"))
        else:
            now = step.select(F.col("bin").alias("sequence_id"), "new", "at")
            moved = stash(moved.join(now, "sequence_id", "left").select("bin", F.coalesce("new", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("at", F.lit(0))).alias("shift")), "moved")
        level = step.where("open").groupBy(F.col("new").alias("bin")).agg(F.first("load").alias("load"))
        nodes = -(-nodes // FAN)
    out = pieces
    if moved is not None:
        out = pieces.join(moved, "bin", "left")
    else:
        out = pieces.withColumns({"sequence_id": F.col("bin"), "shift": F.lit(0).cast("long")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))
