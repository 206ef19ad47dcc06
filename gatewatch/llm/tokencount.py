"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  A node's failure link leads to what is
left of its string once the greedy longest pieces at its front are taken off,
and the number of those pieces is kept with the node, so a word is read once,
byte by byte, and its pieces are counted without being built.  A word ends with
a mark of its own, so pieces that only end words match nowhere else.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gatewatch.llm.text import Cached, batches, raw


#: The mark at a word's end: beyond any byte.
END = 256


class LongestMatch:
    """Greedy longest-match-first piece counts; -1 for words that no sequence of greedy pieces covers.

    Pieces and words are sequences of bytes, perhaps with END at their end; END
    alone, where a word's last piece has no form of its own for ends, counts nothing.
    """

    def __init__(self, pieces: Iterable[Sequence[int]]) -> None:
        self.to: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.to.append({})
                    ends.append(False)
                at = self.to[at][c]
            ends[at] |= at > 0
        self.fail: list[int] = [-1] * len(self.to)
        self.popped: list[int] = [0] * len(self.to)
        bare = self.to[0].get(END)
        line = deque([0])
        while line:
            u = line.popleft()
            for c, v in self.to[u].items():
                line.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, int(v != bare)
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.to[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.to[z][c], n

    def count(self, word: Sequence[int]) -> int:
        to, fail, popped, at, n = self.to, self.fail, self.popped, 0, 0
        for c in word:
            while c not in to[at]:
                if fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = to[at][c]
        while at:
            if fail[at] < 0:
                return -1
            n += popped[at]
            at = fail[at]
        return n


def pieces(vocabulary: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-alphabet vocabulary file, those that end words with END, and END alone."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(vocabulary, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    bare = [(name.removesuffix("</w>"), name.endswith("</w>")) for name in sorted(names)]
    return [*((*(back[c] for c in name), *[END] * last) for name, last in bare if name and all(c in back for c in name)), (END,)]


@lru_cache(maxsize=2)
def automaton(vocabulary: str) -> LongestMatch:
    return LongestMatch(pieces(vocabulary))


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown.

    docs: doc_id, text; other columns are not looked at.  Words are lower-cased
    as the tokenizer does it; one that the vocabulary cannot spell is a single
    unknown token.  A null or empty text has none.  Texts and words of any
    length are read whole, in time linear in them; nothing depends on the order
    of rows.  Repeated rows are counted each; an empty table gives no rows.
    The file is a fixed vocabulary that every executor has at this path.
    """

    def run(it):
        known = automaton(vocabulary)
        of = Cached(lambda word: known.count((*word, END))).__getitem__
        for b in batches(it):
            rows = []
            for text in raw(b, "text"):
                text = text or b""
                lower = text.lower() if text.isascii() else text.decode(errors="replace").lower().encode()
                counts = [*map(of, lower.split())]
                unknown = counts.count(-1)
                rows.append((len(counts), sum(counts) + 2 * unknown, unknown))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
