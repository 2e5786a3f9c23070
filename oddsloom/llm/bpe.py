"""Encoding and decoding with a byte-level BPE vocabulary through a tokenization automaton.

A text is split into words by the vocabulary's rule; equal words of a batch are encoded once, by the
transitions of a :class:`~.automaton.TokenAutomaton`.  Decoding concatenates the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .automaton import TokenAutomaton, distinct_spans, ragged
from .common import slices, tidied, utf8

#: Bytes of text that are worked on at once; a longer text is a batch of its own.
SLICE = 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(rule, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind  # a run may span the surrogates, which no text holds
    return kinds


def split_words(raw: np.ndarray, at: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split texts (bytes and offsets) into words: start and end of each, and the text it belongs to.

    The rule: an apostrophe with s, t, re, ve, m, ll or d; runs of letters, of numbers or of other
    marks, each with one blank before it; and white space, whose last character is left to what
    follows.  ``special`` is a word wherever it occurs.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    text = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(text)
    cls = char_classes()[text]
    cut = np.zeros(n + 1, bool)  # where a text or a special word begins or ends
    cut[np.searchsorted(place, at)] = True
    inside = None
    if special and (found := [m.start() for m in re.finditer(re.escape(special), raw.tobytes())]):
        first = np.searchsorted(place, found)
        within = first + len(special) <= np.searchsorted(place, at)[np.searchsorted(at, found, "right")]
        first = first[within]
        cut[first] = cut[first + len(special)] = True
        inside = (first[:, None] + np.arange(1, len(special))).reshape(-1)
        cut[inside] = False
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new |= cut[:n]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (text[:-1] == 32) & ~cut[1:n]
    blank = cls == SPACE
    start = new & (blank | ~after_blank)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~cut[1:n]
    mark = np.flatnonzero((text == 39) & new & ~after_blank)
    mark = mark[(mark + 1 < n)]
    mark = mark[~cut[mark + 1]]
    one = text[mark + 1]
    two = np.where((mark + 2 < n) & ~cut[np.minimum(mark + 2, n)], text[np.minimum(mark + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[mark[short | long] + 1] = False
    rest = np.concatenate([mark[short] + 2, mark[long] + 3])
    start[rest[rest < n]] = True
    if inside is not None:
        start[inside] = False
    begin = place[start]
    end = np.append(begin[1:], len(raw))
    return begin, end, np.searchsorted(at, begin, "right") - 1


def _check(spec: dict) -> None:
    """Refuse a vocabulary file that asks for more than what is done here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    usual = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = spec.get("added_tokens") or []
    odd = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
    if not plain or not usual or spec.get("normalizer") or len(added) > 1 or odd:
        raise ValueError("a byte-level BPE without normalizer, prefix space and with at most one added token is needed")


class ByteBPE:
    """A vocabulary file of the tokenizers library, compiled."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _check(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        as_bytes = lambda piece: bytes(letters[c] for c in piece)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])] + [a + b for a, b in pairs]
        index = {name: i for i, name in enumerate(names)}
        merges = [(index[a], index[b], index[a + b]) for a, b in pairs]
        made: list[tuple[int, int] | None] = [None] * 256 + [(u, v) for u, v, _ in merges]
        pieces = [as_bytes(name) for name in names]
        self.automaton = TokenAutomaton(pieces, 256, merges, made)
        self.id_of = np.array([vocab[name] for name in names], np.int64)
        added = spec.get("added_tokens") or []
        self.special = added[0]["content"].encode() if added else b""
        labels = {int(i): p for i, p in zip(self.id_of, pieces, strict=True)} | {t["id"]: t["content"].encode() for t in added}
        self.special_id = added[0]["id"] if added else -1
        labels = [labels.get(i, b"") for i in range(max(labels) + 1)]
        self.labels, self.label_at = np.frombuffer(b"".join(labels), np.uint8), np.cumsum([0, *map(len, labels)])
        decimals = [f"{i},".encode() for i in range(len(labels))]
        self.decimals, self.decimal_at = np.frombuffer(b"".join(decimals), np.uint8), np.cumsum([0, *map(len, decimals)])

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts (bytes and offsets), concatenated, and the offsets of each text's."""
        start, end, text = split_words(raw, at, self.special)
        pick, same = distinct_spans(raw, start, end)
        tokens, ends = self.automaton.encode(raw, start[pick], (end - start)[pick])
        ids = self.id_of[tokens]
        if self.special and len(pick):
            # A word can only be as the special one if it is the special one.
            whole = np.flatnonzero((end - start)[pick] == len(self.special))
            for j in whole:
                if raw[start[pick[j]] : end[pick[j]]].tobytes() == self.special:
                    ids = np.concatenate([ids[: ends[j]], [self.special_id], ids[ends[j + 1] :]])
                    ends = np.concatenate([ends[: j + 1], ends[j + 1 :] - (ends[j + 1] - ends[j] - 1)])
        ids, word_ends = ragged(ids, ends, same)
        first = np.searchsorted(text, np.arange(len(at)), "left")
        return ids, word_ends[first]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc labels of each text's tokens, concatenated, and the offsets of each text's bytes."""
        raw, places = ragged(self.labels, self.label_at, ids)
        return raw, places[ends]

    def written(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in decimal, each followed by a comma."""
        raw, places = ragged(self.decimals, self.decimal_at, ids)
        return raw, places[ends]


@lru_cache(2)
def load(path: str) -> ByteBPE:
    """The compiled vocabulary; each Python worker compiles it once."""
    return ByteBPE(path)


def _batches(batches: Iterator[pa.RecordBatch], path: str):
    """(batch, first row, end row, ids, ends) for slices of the last column of each batch."""
    coder = load(path)
    for batch in tidied(batches):
        raw, at = utf8(batch.column(batch.num_columns - 1))
        for a, b in slices(at, SLICE):
            yield coder, batch, a, b, *coder.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a])


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row of ``docs`` (doc_id, text); null counts as empty."""

    def run(batches):
        for _, batch, a, b, ids, ends in _batches(batches, vocabulary):
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids give an empty text."""

    def run(batches):
        coder = load(vocabulary)
        for batch in tidied(batches):
            rows = [x or [] for x in batch.column(1).to_pylist()]
            ids = np.array([i for x in rows for i in x], np.int64)
            raw, ends = coder.decode(ids, np.cumsum([0, *map(len, rows)]))
            whole = raw.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256, exact (text restored).

    Null texts count as empty: no tokens, and digests of the empty text.  Rows are independent, so
    repeated rows, null or repeated doc_ids and columns besides doc_id and text make no difference.
    """

    def run(batches):
        for coder, batch, a, b, ids, ends in _batches(batches, vocabulary):
            raw, at = coder.written(ids, ends)
            back, back_at = coder.decode(ids, ends)
            raw, back = raw.tobytes(), back.tobytes()
            source, source_at = utf8(batch.column(1).slice(a, b - a))
            source = source.tobytes()
            out = []
            for i in range(b - a):
                text = back[back_at[i] : back_at[i + 1]]
                exact = text == source[source_at[i] : source_at[i + 1]]
                if not exact:  # not a whole text in UTF-8: what cannot be read is replaced
                    text = text.decode("utf-8", "replace").encode()
                out.append((hashlib.sha256(raw[at[i] : max(at[i], at[i + 1] - 1)]).hexdigest(), hashlib.sha256(text).hexdigest(), exact))
            shas, texts, exact = zip(*out, strict=True)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(ends), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
