"""Personal data: fixed shapes first, then contextual patterns bootstrapped from them.

The base finds emails, addresses, cards and phone numbers by shape.  Their
occurrences seed a graph of lexical patterns (the words around) and instances
(identifier-like tokens and runs of tokens).  Spark scores both sides in turn:
a pattern by the share that is believed to be of the kind among its instances
that anything is known of, an instance by its best pattern.  Seeds are believed;
instances that a check of their kind contradicts are not; of plausible ones
nothing is known until a pattern vouches for them, so they hold no pattern back.
Patterns of high score and enough different seeds then mark what the shapes miss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import SENT, stash
from gatewatch.llm.text import batches, fresh, raw

#: Kinds in their order within spans.
KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs, and the scores from which patterns and instances count.
SUPPORT, SURE, ROUNDS = 8, 0.8, 3

_LOCAL = "".join(map(chr, range(48, 58))) + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NAME_AT_HOST = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*[A-Za-z][A-Za-z0-9.-]*")
_SPELT_AT = re.compile(rb"[\[(]at[\])]", re.I)
#: Identifiers of several tokens: groups of digits, and addresses with the at sign spelt out.
_RUN = re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9][0-9()./-]*+(?: [(]?[0-9][0-9()./-]*+)++")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?i:at)[\])] ?[A-Za-z0-9.-]++(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]++)*+")
_GROUPED = re.compile(r"\+?[(]?[0-9]+(?:[ ()./-]+[0-9]+)+[)]?")
_DATE = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9]).*")
_DIGITS = str.maketrans("0123456789", "0000000000")
#: Characters of context that are looked at on either side.
AROUND = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, from each @ outwards: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def shape(token: str) -> int | None:
    """The kind that a token could be an odd spelling of: enough digits, or an at sign between letters."""
    digits = len(_DIGIT.findall(token))
    if "@" in token.strip("@"):
        return 0
    if 4 <= digits <= 12 and token.count(".") == 3:
        return 1
    if digits >= 14 and digits >= 0.7 * len(token):
        return 2
    return 3 if 7 <= digits <= 15 and digits >= 0.6 * len(token) else None


def plausible(word: str, kind: int) -> bool:
    """Whether a check of the kind leaves it open that the word is one; false contradicts it."""
    if kind == 0:
        return bool(_SPELT.fullmatch(word) or _NAME_AT_HOST.fullmatch(word))
    numbers = re.findall("[0-9]+", word)
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and not re.search("[A-Za-z]", word)
    if kind == 2:
        return 14 <= len(digits := "".join(numbers)) <= 19 and luhn(digits) and not re.search("[A-Za-z]", word)
    return bool(_GROUPED.fullmatch(word)) and not _DATE.fullmatch(word)


def runs(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and kind of candidates of several tokens."""
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            word = m[0].rstrip("(./-")
            word = word[:-1] if word.count(")") > word.count("(") else word
            after = text[m.end() : m.end() + 1]
            digits = len(_DIGIT.findall(word))
            if " " in word and digits <= 19 and not (after.isalnum() or after == "@") and (kind := shape(word if digits >= 14 else re.sub("[ ()]", "", word))) is not None:
                yield m.start(), m.start() + len(word), kind
    if _SPELT_AT.search(text.encode(errors="replace")):
        yield from ((m.start(), m.start() + len(m[0].rstrip(".-")), 0) for m in _SPELT.finditer(text))


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str], bool, bool]]:
    """Identifier-like tokens and runs of tokens: start, end, kind, value, patterns around, is a seed, is plausible."""
    out = []

    def add(a: int, b: int, kind: int, seed: bool) -> None:
        left = _TOKEN.findall(text[max(0, a - AROUND) : a].lower().translate(_DIGITS))[-2:]
        right = _TOKEN.findall(text[b : b + AROUND].lower().translate(_DIGITS))[:1]
        patterns = [" ".join([*left[-1:], "_"]), " ".join([*left, "_"]), " ".join([*left[-1:], "_", *right])]
        value = hashlib.blake2b(text[a:b].encode(errors="replace"), digest_size=12).hexdigest()
        out.append((a, b, kind, value, sorted({p for p in patterns if p != "_"}), seed, seed or plausible(text[a:b], kind)))

    def free(found: Iterator[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Those of found, in order of start, that overlap nothing taken."""
        kept, i, reach, taken = [], 0, -1, sorted(taken)
        for a, b, kind in found:
            while i < len(taken) and taken[i][0] < b:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a:
                kept.append((a, b, kind))
        return kept

    def tokens() -> Iterator[tuple[int, int, int]]:
        for m in _TOKEN.finditer(text):
            if _DIGIT.search(m[0]) or "@" in m[0]:
                word = m[0].strip("\"'.,;:!?()[]{}<>")
                a = m.start() + m[0].find(word) if word else m.start()
                if word and (kind := shape(word)) is not None:
                    yield a, a + len(word), kind

    for a, kind, b in spans:
        add(a, b, kind, True)
    taken = [(a, b) for a, _, b in spans]
    long = free(sorted(runs(text)), taken)
    for a, b, kind in [*long, *free(tokens(), [*taken, *((a, b) for a, b, _ in long)])]:
        add(a, b, kind, False)
    return out


SPAN = "struct<start:int,kind:int,stop:int>"
MENTIONS = "array<struct<start:int,stop:int,kind:int,value:string,patterns:array<string>,seed:boolean,plausible:boolean>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
_MENTIONS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()), ("plausible", pa.bool_())]))


def _scan(name: str) -> Callable:
    """Adds base and, by this name, the mentions."""

    def run(it):
        for b in batches(it):
            base, seen = [], []
            for text in raw(b, "text"):
                if not text or not (b"@" in text or re.search(rb"[0-9]", text) or _SPELT_AT.search(text)):
                    base.append([])
                    seen.append([])
                    continue
                text = text.decode(errors="replace")
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "stop": e} for s, k, e in spans])
                seen.append([dict(zip(("start", "stop", "kind", "value", "patterns", "seed", "plausible"), m, strict=True)) for m in mentions(text, spans)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, _SPANS), pa.array(seen, _MENTIONS)], [*b.schema.names, "base", name])

    return run


def patterns(graph: DataFrame, support: int = SUPPORT, sure: float = SURE, rounds: int = ROUNDS) -> DataFrame:
    """graph: kind, value, pattern, seed, plausible.  The patterns of high score after ``rounds``: kind, pattern, score.

    A pattern's score is the mean belief in those of its different instances
    that have one, pulled to none by two unbelieved ones.  An instance's belief
    is 1 for seeds, else the score of its best pattern with enough seeds; without
    one it is 0 where its kind's check contradicts it and absent where not.
    """
    flag = lambda c: F.max(F.col(c).cast("int")).alias(c)
    edges = stash(graph.groupBy("kind", "pattern", "value").agg(flag("seed"), flag("plausible")), "graph")
    known = F.when(F.col("seed") == 1, 1.0).when(F.col("plausible") == 0, 0.0)
    belief = edges.groupBy("kind", "value").agg(F.max(known).alias("belief"))
    for i in range(rounds):
        scored = edges.join(belief, ["kind", "value"]).groupBy("kind", "pattern").agg((F.sum("belief") / (F.count("belief") + 2)).alias("score"), F.sum("seed").alias("seeds"))
        scored = stash(scored.where((F.col("seeds") >= support) & (F.col("score") >= sure)), f"patterns{i}")
        if i + 1 < rounds:
            # greatest() skips nulls
            belief = edges.join(scored, ["kind", "pattern"], "left").groupBy("kind", "value").agg(F.max(F.greatest(known, "score")).alias("belief"))
    return scored.select("kind", "pattern", "score")


def find(docs: DataFrame, support: int = SUPPORT, sure: float = SURE, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """The columns of docs (the text only with keep_text), then base and added: arrays of (start, kind, stop) in code points.

    docs: text and any others.  A null or empty text has no spans.  Repeated
    rows all get their spans.  Texts are read whole, whatever their length;
    contexts are the words within AROUND characters.  Spans that begin together
    go by kind.  Columns named base or added in the input are replaced, all
    others are kept.  An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("base", "added")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    row, mentioned = fresh(docs, "row", "mentions")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    seen = docs.mapInArrow(_scan(mentioned), f"{schema}, base array<{SPAN}>, `{mentioned}` {MENTIONS}")
    if not keep_text:
        keep.remove("text")
        seen = seen.drop("text")
    # written, so the numbers of rows stay
    seen = stash(seen.withColumn(row, F.monotonically_increasing_id()), "mentions")
    each = seen.where(F.size(mentioned) > 0).select(F.col(row).alias("at"), F.explode(mentioned).alias("m")).select("at", "m.*")
    linked = each.select("at", "start", "stop", "kind", "value", "seed", "plausible", F.explode("patterns").alias("pattern"))
    good = patterns(linked.select("kind", "value", "pattern", "seed", "plausible"), support, sure, rounds)
    new = linked.where("not seed").join(good, ["kind", "pattern"], "left_semi").groupBy("at").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("new"))
    new = stash(new, "added")
    spans = new.agg(F.sum(F.size("new"))).first()[0] or 0
    new = F.broadcast(new) if spans <= SENT else new
    out = seen.alias("t").join(new.alias("n"), F.col(f"t.{row}") == F.col("n.at"), "left")
    return out.select(*[F.col(f"t.`{c}`") for c in keep], "t.base", F.coalesce(F.array_sort("n.new"), F.array().cast(f"array<{SPAN}>")).alias("added"))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def counted(found: DataFrame) -> DataFrame:
    """One row per row of find(): doc_id, n_<kind> of the base, base_sha256, spans."""
    of = lambda kind: lambda s: s["kind"] == kind  # noqa: E731  a second parameter would be the element's place
    n = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def _mask(it):
    """The text with each run of overlapping spans replaced by its first kind in brackets; base and added go."""
    for b in batches(it):
        names = [c for c in b.schema.names if c not in ("base", "added")]
        texts = b.column("text").to_pylist()
        for i, (base, added) in enumerate(zip(b.column("base").to_pylist(), b.column("added").to_pylist(), strict=True)):
            if base or added:
                text, done, out = texts[i], 0, []
                for s in sorted([*base, *added], key=lambda s: (s["start"], s["kind"], s["stop"])):
                    if s["start"] >= done:
                        out += [text[done : s["start"]], "[", KINDS[s["kind"]].upper(), "]"]
                    done = max(done, s["stop"])
                texts[i] = "".join([*out, text[done:]])
        yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in names], names)


def masked(found: DataFrame) -> DataFrame:
    """Rows of find() with the text masked, without base and added."""
    kept = [f for f in found.schema if f.name not in ("base", "added")]
    return found.mapInArrow(_mask, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))
