"""Byte-level BPE by merge replay over a corpus, and decoding.

A block of documents is one corpus: its different pieces stand in a row of
linked tokens, and an inverted index leads from each token pair, by the rank of
its merge, to the places where it stands.  Every merge is applied in rank
order to all its places at once; only the touched neighbours get new pairs, and
with them new entries.  A document's ids are those of its pieces in a row.

One replay over the different pieces of all documents would have to bring every
piece's ids back to every occurrence, a shuffle of all words; a block needs none.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gatewatch.llm.text import batches

#: Bytes of text in a block, and rows; a longer text is a block of its own.
BLOCK, ROWS = 16 << 20, 16_384
_NONE = -1
#: Between two characters that are no white space a single space begins a new piece.
_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which some space has no such neighbours.
_RAGGED = r"^ | $| [\x{9}-\x{D}\x{1C}-\x{20}\x{85}\pZ]|[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\pZ] "


class Merges:
    """The merges of a vocabulary of byte strings with their ranks, which are their ids as well."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = 1 + max(ranks.values())
        self.spelled: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.spelled[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        parts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(parts, np.int64).reshape(-1, 3).T
        #: All pairs by left token, and by right token: where each token's begin, the other token, the rank.
        self.by = []
        for own, other in ((left, right), (right, left)):
            order = np.lexsort((other, own))
            begins = np.searchsorted(own[order], np.arange(self.size + 1))
            self.by.append((begins, other[order].astype(np.int32), rank[order].astype(np.int32)))
        bytes_of = self.of_byte.astype(np.int64)
        table = np.full((256, 256), _NONE, np.int32)
        for b, token in enumerate(bytes_of.tolist()):
            table[b] = self.ranked(0, token, bytes_of.astype(np.int32))
        self.of_bytes = table.ravel()

    def ranked(self, side: int, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of one token, on the left (side 0) or right (1), with others; _NONE where they do not merge."""
        begins, other, rank = self.by[side]
        x, y = begins[token], begins[token + 1]
        if x == y:
            return np.full(len(others), _NONE, np.int32)
        at = np.minimum(np.searchsorted(other[x:y], others), y - x - 1) + x
        return np.where(other[at] == others, rank[at], _NONE)

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece, merge by merge: always the leftmost pair of least rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, self.size) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == self.size:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's begin (one more than pieces)."""
        lengths = np.array([*map(len, pieces)], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if not n:
            return np.empty(0, np.int32), begins
        token = self.of_byte[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[begins[1:][lengths > 0] - 1] = _NONE
        before[begins[:-1][lengths > 0]] = _NONE
        # the rank of the pair that begins at each place
        pair = np.full(n, _NONE, np.int32)
        pair[:-1] = self.of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]]
        pair[after == _NONE] = _NONE
        places = np.flatnonzero(pair != _NONE)
        places = places[np.argsort(pair[places], kind="stable")].astype(np.int32)
        index: list[list[np.ndarray]] = [[] for _ in range(self.size)]
        self._enter(index, pair[places], places)
        late: list[np.ndarray] = []  # places of pairs that rank before the merge that made them
        for rank in range(self.size):
            if not index[rank]:
                continue
            at = np.concatenate(index[rank]) if len(index[rank]) > 1 else index[rank][0]
            index[rank] = []
            at = at[pair[at] == rank]
            if not len(at):
                continue
            at = self._leftmost(at, after)
            gone = after[at]
            then = after[gone]
            more = then != _NONE
            beside, follows = at[more], then[more]
            old = token[follows]
            token[at], token[gone], pair[gone], after[at] = rank, _NONE, _NONE, then
            before[follows] = beside
            fresh = np.full(len(at), _NONE, np.int32)
            fresh[more] = self.ranked(0, rank, token[follows])
            pair[at] = fresh
            if (both := old != token[follows]).any():
                # from left to right a place meets the next one before that is merged too
                met = self.ranked(0, rank, old[both])
                late.append(beside[both][(met != _NONE) & (met < rank)])
            ahead = before[at]
            ahead = ahead[ahead != _NONE]
            made = self.ranked(1, rank, token[ahead])
            pair[ahead] = made
            places, ranks = np.concatenate([at, ahead]), np.concatenate([fresh, made])
            some = ranks != _NONE
            places, ranks = places[some], ranks[some]
            if not len(places):
                continue
            early = ranks < rank
            if early.any():
                late.append(places[early])
                places, ranks = places[~early], ranks[~early]
            order = np.argsort(ranks, kind="stable")
            self._enter(index, ranks[order], places[order])
        stays = token != _NONE
        ends = np.concatenate([[0], np.cumsum(stays)])[begins]
        ids = token[stays]
        # a piece that is a token as it stands is that token; those that met a late pair are done one by one
        own = {i: [rank] for i, p in enumerate(pieces) if (rank := self.ranks.get(p)) is not None and ends[i + 1] - ends[i] > 1}
        for i in set((np.searchsorted(begins, np.concatenate(late), side="right") - 1).tolist()) if late else ():
            own.setdefault(i, self.one(pieces[i]))
        return _replaced(ids, ends, own) if own else (ids, ends)

    @staticmethod
    def _enter(index: list[list[np.ndarray]], ranks: np.ndarray, places: np.ndarray) -> None:
        """Add places to the index; ranks are in order."""
        if not len(ranks):
            return
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cut.tolist(), len(ranks)]
        for rank, x, y in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            index[rank].append(places[x:y])

    @staticmethod
    def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The different places; of those that follow each other, as in a a a, every second one, from the left."""
        at = np.sort(at)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        tied = after[at[:-1]] == at[1:]
        if not tied.any():
            return at
        first = np.flatnonzero(np.concatenate([[True], ~tied]))
        place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        return at[place % 2 == 0]


def _replaced(ids: np.ndarray, ends: np.ndarray, own: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(ends)
    changed = np.array(sorted(own))
    parts, done = [], 0
    for i in changed.tolist():
        parts += [ids[done : ends[i]], np.array(own[i], np.int32)]
        done = ends[i + 1]
    counts[changed] = [len(own[i]) for i in changed.tolist()]
    return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(counts)])


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of values that which names, in a row, and where each begins."""
    counts = np.diff(ends)[which]
    to = np.concatenate([[0], np.cumsum(counts)])
    return values[np.arange(to[-1]) + np.repeat(ends[which] - to[:-1], counts)], to


class Codes(dict):
    """Key -> its number in order of first appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encoded(texts: pa.Array, merges: Merges, pieces_of: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin; texts has no nulls.

    A text is cut at single spaces between other characters first, so that the
    pattern meets each different stretch once a block.
    """
    stretches, pieces = Codes(), Codes()
    rows, sizes = [], []
    for text, ragged in zip(map(str, texts), pc.match_substring_regex(texts, _RAGGED).to_pylist(), strict=True):
        cut = _SPACE.split(text) if ragged else text.split(" ")
        # all but the first begin with their space
        cut[0] = (cut[0],)
        rows.append(np.fromiter(map(stretches.__getitem__, cut), np.int32, len(cut)))
        sizes.append(len(cut))
    flat, counts = array("i"), array("i", [0])
    for s in stretches:
        flat.extend(map(pieces.__getitem__, pieces_of(s[0] if type(s) is tuple else " " + s)))
        counts.append(len(flat))
    stretches.clear()
    spelled = [p.encode() for p in pieces]
    pieces.clear()
    ids, ends = merges.replay(spelled)
    ids, to = gathered(ids, ends, np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
    ids, ends = gathered(ids, to[np.array(counts)], np.concatenate(rows) if rows else np.empty(0, np.int64))
    return ids, ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    """A rank file: a line per token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK bytes of text."""
    held, size = [], 0
    for b in batches(it):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        if held and (size + sizes[-1] > BLOCK or sum(x.num_rows for x in held) > ROWS):
            yield from _whole(held)
            held, size = [], 0
        if sizes[-1] <= BLOCK:
            held.append(b)
            size += int(sizes[-1])
            continue
        cut = np.searchsorted(sizes, np.arange(BLOCK, sizes[-1] + BLOCK, BLOCK), side="right")
        edges = np.unique(np.concatenate([[0], np.minimum(cut + 1, b.num_rows)])).tolist()
        for x, y in zip(edges, edges[1:], strict=False):
            yield b.slice(x, y - x)
    if held:
        yield from _whole(held)


def _whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text, each match of pattern encoded by itself, without special tokens.

    docs: doc_id, text; other columns are not looked at.  A null or empty text
    has no ids.  Equal ranks do not exist; of pairs with one rank the leftmost
    goes first, and a match that is a token as a whole is that token.  Texts and
    matches of any length are encoded whole; a task holds a block of BLOCK
    bytes, or one longer text.  Repeated rows each give a row, an empty table
    none.  ranks: path of a rank file that every executor has; it knows all
    bytes.  pattern: one that begins a new match at a single space between two
    characters that are none, as the usual patterns of such files do.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        merges, pieces_of = merges_of(ranks), regex.compile(pattern).findall
        for b in _blocks(it):
            ids, ends = encoded(pc.fill_null(b.column("text"), ""), merges, pieces_of)
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                own = ends[i : i + part.num_rows + 1]
                values = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(ids[own[0] : own[-1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, ranks: str) -> DataFrame:
    """rows and decoded: the bytes of its ids.  rows: ids (array<int>) and any others but decoded; null ids are none."""
    kept = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = merges_of(ranks).spelled
        for b in batches(it, 256):
            texts = [b"".join(map(spelled.__getitem__, ids or ())) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{schema}, decoded binary")
