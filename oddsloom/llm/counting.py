"""Token counts by finite-state transduction, with chunk state maps composed by joins.

The pieces of a vocabulary compile into a deterministic transducer (:mod:`.automaton`) whose
transitions carry the number of tokens they emit.  It returns to its start wherever a run of blanks
begins, since no piece holds a blank after another character.

Texts of more than ``CHUNK`` bytes are cut into chunks, which are spread over tasks.  A chunk's map says
into which state, and with how many tokens emitted, it takes the state that it is entered with.  That
state is told from the ``CONTEXT`` bytes before the chunk: from the last run of blanks among them, or, if
they hold none, from their beginning, after which the states of different beginnings fall together.
Maps compose where a chunk leaves in a state that the next one was entered with; a join of each chunk with
the next one shows whether it does.  Chunks are mapped from further states until whatever leaves one
chunk enters the next: with most texts none is needed, and with periodic ones no more than their
period.  Then the number of a text is the sum over its chunks, if each was entered with one state only;
otherwise the maps are composed in pairs, each round halving their number (:func:`_scanned`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import TokenAutomaton, distinct_spans
from .common import body, slices, stored, tidied, utf8

#: Bytes of a chunk, bytes before it from which its state is told, and bytes that a task works on at once.
CHUNK, CONTEXT, SLICE = 1 << 16, 1 << 10, 1 << 20
BLANK = 0x20
#: The mark that stands for a blank in the vocabulary, and that counts as one in a text.
MARK = "▁"
CUT = "uid long, doc_id long, chunk int, last boolean, n_bytes long, n long, context binary, data binary"
MAPPED = "uid long, doc_id long, chunk int, n_bytes long, entry binary, exit binary, n long"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes):
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = (4, at) if key & 7 == 5 else (8, at) if key & 7 == 1 else _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a ``.model`` file with their scores, in order; control and byte pieces are left out."""
    with open(path, "rb") as file:
        raw = file.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                out.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0])))
    return out


def _derive(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last merge that makes ``piece`` in a text of its own, or None if it never arises."""
    parts, last = list(piece), None
    while len(parts) > 1:
        best = min(((rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == len(rank):
            return None
        i = best[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return last


class PieceCounter:
    """The transducer of a ``.model`` file: pieces merge by score, whatever pair makes them; characters without a piece count a token a byte."""

    def __init__(self, path: str):
        scored = [(p.replace(MARK, " "), s) for p, s in read_pieces(path)]
        if any(" " in p.lstrip(" ") for p, _ in scored):
            raise ValueError("a piece holds a blank after another character; texts cannot be cut at blanks")
        names = [p for p, _ in scored if len(p) == 1] + [p for p, _ in sorted((x for x in scored if len(x[0]) > 1), key=lambda x: -x[1])]
        n_base = sum(len(p) == 1 for p in names)
        index = {p: i for i, p in enumerate(names)}
        rank = {p: i for i, p in enumerate(names) if i >= n_base}
        merges, made = [], [None] * n_base
        for p in names[n_base:]:
            merges += [(index[p[:i]], index[p[i:]], index[p]) for i in range(1, len(p)) if p[:i] in index and p[i:] in index]
            last = _derive(p, rank) if all(c in index for c in p) else None
            made.append(last and (index[last[0]], index[last[1]]))
        self.automaton = TokenAutomaton([p.encode() for p in names], n_base, merges, made, unknown=True)

    def count(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each span; equal spans are read once."""
        pick, same = distinct_spans(raw, start, end)
        return self.automaton.count(raw, start[pick], (end - start)[pick])[same]


@lru_cache(2)
def load(path: str) -> PieceCounter:
    """The compiled vocabulary; each Python worker compiles it once."""
    return PieceCounter(path)


def text_counts(counter: PieceCounter, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens of whole texts, given as bytes and offsets; words begin where a text or a run of blanks does."""
    n = len(at) - 1
    if not len(raw):
        return np.zeros(n, np.int64)
    place = raw == BLANK
    place[1:] &= ~(raw[:-1] == BLANK)
    place[at[:-1][at[:-1] < len(raw)]] = True
    places = np.flatnonzero(place)
    owner = np.searchsorted(at, places, "right") - 1
    return np.bincount(owner, counter.count(raw, places, np.append(places[1:], len(raw))), n).astype(np.int64)


def _places(data: bytes, after_blank: bool) -> np.ndarray:
    """Where runs of blanks begin; ``after_blank``: no run begins with the first byte."""
    blank = np.frombuffer(data, np.uint8) == BLANK
    place = blank.copy()
    place[1:] &= ~blank[:-1]
    if after_blank and len(place):
        place[0] = False
    return np.flatnonzero(place)


def _written(state: tuple) -> bytes:
    node, last, count = state
    return np.array([node, *last, *count], np.int32).tobytes()


def _state(raw: bytes) -> tuple:
    values = np.frombuffer(raw, np.int32).tolist()
    half = (len(values) - 1) // 2
    return values[0], values[1 : 1 + half], values[1 + half :]


def chunk_map(counter: PieceCounter, context: bytes, data: bytes, first: bool, last: bool, entry: bytes | None = None) -> tuple[bytes, bytes, int]:
    """The state a chunk is entered with, the state it leaves in, and the tokens between.

    ``entry``: the state, if it is known; else it is told from ``context``.  The last chunk of a text
    ends its last word and leaves in no state.
    """
    automaton = counter.automaton
    mark = MARK.encode()
    before, data = context.replace(mark, b" "), data.replace(mark, b" ")
    if first:  # the library puts a blank before every text that is not empty
        before, data = b"", b" " + data
    if entry is None:
        places = _places(before, True)
        entry = _written(automaton.settled(automaton.advance(automaton.start(), before[places[-1] if len(places) else 0 :]))[0])
    places = _places(data, first or before.endswith(b" "))
    if not len(places):
        state, n = automaton.advance(_state(entry), data), 0
    else:
        n = automaton.advance(_state(entry), data[: places[0]])[2][-1]
        raw = np.frombuffer(data, np.uint8)
        n += int(counter.count(raw, places[:-1], places[1:]).sum()) if len(places) > 1 else 0
        state = automaton.advance(automaton.start(), data[places[-1] :])
    if last:
        return entry, b"", n + state[2][-1]
    state, more = automaton.settled(state)
    return entry, _written(state), n + more


def _cuts(text: bytes, size: int) -> list[int]:
    """Ends of chunks of at least ``size`` bytes, which end with a character."""
    out, at = [], 0
    while at < len(text):
        at = min(at + size, len(text))
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        out.append(at)
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, chunk: int = CHUNK, context: int | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of ``docs`` (doc_id, text).

    Counts are those of the sentencepiece library without begin or end marks.  Null and empty texts
    have no bytes and no tokens.  Rows are counted one by one, so repeated rows, null or repeated
    doc_ids and columns besides doc_id and text make no difference.  A text of any length is counted
    whole, with blanks or without; its chunks are spread over tasks.  An empty table gives an empty result.
    ``context``: bytes before a chunk from which its state is told, four chunks or ``CONTEXT`` at most.
    """
    context = min(CONTEXT, 4 * chunk) if context is None else context

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count short texts, cut long ones."""
        counter = load(vocabulary)
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("context", pa.binary()), ("data", pa.binary())])
        for batch in tidied(batches):
            size = pc.binary_length(pc.cast(batch.column("text"), pa.large_binary()))
            short = batch.filter(pc.less_equal(size, chunk))
            for part, n_bytes, raw, at in _slices(short):
                n = text_counts(counter, *_spaced(raw, at, np.diff(at) > 0))
                none = pa.nulls(len(part), pa.binary())
                yield pa.record_batch([part.column("uid"), part.column("doc_id"), pa.array(np.zeros(len(part), np.int32)), pa.array(np.ones(len(part), bool)), pa.array(n_bytes), pa.array(n), none, none], schema=schema)
            long = batch.filter(pc.greater(size, chunk))
            for i in range(len(long)):
                uid, doc_id, text = (long.column(c)[i].as_py() for c in ("uid", "doc_id", "text"))
                text = text.encode()
                a = 0
                for k, b in enumerate(_cuts(text, chunk)):
                    c = max(0, a - context)
                    while text[c] & 0xC0 == 0x80:
                        c -= 1
                    yield pa.record_batch([[uid], [doc_id], [k], [b == len(text)], [b - a], [None], [text[c:a]], [text[a:b]]], schema=schema)
                    a = b

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in tidied(batches):
            known = batch.column("entry").to_pylist() if "entry" in batch.schema.names else [None] * len(batch)
            maps = [chunk_map(counter, before, data, k == 0, last, entry) for before, data, k, last, entry in zip(*(batch.column(c).to_pylist() for c in ("context", "data", "chunk", "last")), known, strict=True)]
            entry, exit_, n = zip(*maps, strict=True) if maps else ((), (), ())
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "chunk", "n_bytes")), pa.array(entry, pa.binary()), pa.array(exit_, pa.binary()), pa.array(n, pa.int64())], ["uid", "doc_id", "chunk", "n_bytes", "entry", "exit", "n"])

    numbered = docs.select("doc_id", body().alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = stored(numbered.mapInArrow(cut, CUT), "token-chunks")
    counted = rows.where("n is not null").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    chunks = rows.where("n is null").drop("n")
    maps = stored(chunks.repartition("uid", "chunk").mapInArrow(to_maps, MAPPED), "token-maps")
    several = None
    while True:
        out = maps.select("uid", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry")).where("length(entry) > 0").distinct()
        more = stored(out.join(maps.select("uid", "chunk", "entry"), ["uid", "chunk", "entry"], "left_anti"), "token-states")
        if more.isEmpty():
            break
        maps = stored(maps.unionByName(chunks.join(more, ["uid", "chunk"]).mapInArrow(to_maps, MAPPED)), "token-maps")
        several = maps.groupBy("uid", "chunk").count().where("count > 1").select("uid").distinct()
    alone = maps if several is None else maps.join(several, "uid", "left_anti")
    whole = alone.groupBy("uid", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("uid")
    if several is not None:
        whole = whole.unionByName(_scanned(maps.join(several, "uid", "left_semi")))
    return counted.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)


def _scanned(maps: DataFrame) -> DataFrame:
    """doc_id, n_bytes and n_tokens of texts from the maps of their chunks, composed pairwise in rounds."""
    maps = stored(maps.select("uid", "doc_id", "chunk", "n_bytes", "entry", "exit", "n"), "token-scan")
    while not maps.where("chunk > 0").isEmpty():
        half = F.shiftright("chunk", 1).alias("half")
        right = maps.where("chunk % 2 = 1").select("uid", half, F.col("entry").alias("exit"), F.col("exit").alias("out"), F.col("n").alias("more"), F.col("n_bytes").alias("more_bytes"))
        left = maps.where("chunk % 2 = 0").select("uid", "doc_id", half, "n_bytes", "entry", "exit", "n")
        both = left.join(right, ["uid", "half", "exit"], "left")
        n, n_bytes = (F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("n", "more"), ("n_bytes", "more_bytes")))
        maps = stored(both.select("uid", "doc_id", F.col("half").alias("chunk"), n_bytes.alias("n_bytes"), "entry", F.coalesce("out", "exit").alias("exit"), n.alias("n")), "token-scan")
    return maps.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))


def _slices(batch: pa.RecordBatch):
    """Slices of a batch of texts, with their sizes, and their bytes in which every mark for a blank is a blank."""
    raw, at = utf8(batch.column("text"))
    for a, b in slices(at, SLICE):
        part = batch.slice(a, b - a)
        data, places = raw[at[a] : at[b]], at[a : b + 1] - at[a]
        n_bytes = np.diff(places)
        if MARK.encode() in data.tobytes():
            data, places = utf8(pc.replace_substring(part.column("text"), MARK, " "))
        yield part, n_bytes, data, places


def _spaced(raw: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put a blank before the chosen texts."""
    shift = np.concatenate([[0], np.cumsum(which)])
    out = np.full(len(raw) + shift[-1], BLANK, np.uint8)
    out[np.arange(len(raw)) + np.repeat(shift[1:], np.diff(at))] = raw
    return out, at + shift
