"""Jaccard join of documents by PartEnum signatures of their shingles.

Sizes of sets are cut into bands [l, r] with r = l / threshold, so that similar sets lie in one band or
in adjoining ones.  A band j has a scheme for the pairs whose larger set is in it: such sets differ in at most
k = (1 - t) / (1 + t) * 2r elements.  The scheme cuts the domain of elements into n1 partitions by hash, and each
of them into n2 parts.  By counting, some partitions differ in at most k2 elements, so some n2 - k2 of
their parts agree; the hashes of all such subsets of parts are the signatures, and similar sets share one.
Small sets enumerate subsets; large ones have k2 = 0, as there the number of signatures decides.

Signatures of fewer than ``LEAST`` elements are shared by sets that have nothing else in common.  n1 is
therefore larger by a slack e than counting asks for: then e + 1 partitions agree, and a set with at most e
partitions that have such weak signatures leaves them out.  If either of two similar sets does so, one of the
partitions that agree is strong in both; if neither does, their weak signatures meet.  No pair is lost.

Signatures go to slots, packed; a task first ties equal signatures of its own together, and sends on one set
for each, so a signature that a third of all rows share reaches its slot once for a task.  What shares a
signature is held against the set among them that meets most others; where that leaves them in several components,
against one more that the first is not tied to.  Sets that are in different components after that are compared with each
other, each pair once however many signatures it shares; those of large signatures in blocks (:func:`_in_blocks`).

Most pairs that share a signature are not similar.  Sets go to a comparison only if sizes and sketches of the pair allow
it to be: these bound from below in how many elements two sets differ, so no pair is lost (:func:`_sketch`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import body, mixed, slices, stored, tidied, utf8, word_hashes
from .components import components

WORDS, PERCENT = 4, 85
#: Elements that a strong signature has at least, and signatures that a small set may have.
LEAST, SMALL_BUDGET = 2, 48
#: Signatures that a task ties together at once, and those of a slot on average.
HELD, SLOT = 1 << 20, 1 << 20
#: Sets, and shingles of these together, of a block that sets with one home are cut into.
BLOCK, BLOCK_ITEMS = 1024, 1 << 20
#: Turns in which the sets of a signature are held against one of them.
TURNS = 2
#: Sets of a signature that are paired one by one, at most; those of a larger one are compared in blocks.
PAIRED = 64
#: Bits of a sketch.
SKETCH = 1024
#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE = 1 << 20
_SEED = np.uint64(0xA0761D6478BD642F)


class Scheme:
    """How the sets of a pair whose larger one is in band ``band`` get their signatures; k is None if they must be equal."""

    def __init__(self, band: int, least: int, greatest: int, percent: int):
        self.band = band
        #: 100 * both >= percent * union and sizes of a + b = 2r at most leave so many elements apart.
        self.k = 2 * greatest * (100 - percent) // (100 + percent)
        best = None
        for k2 in range(min(self.k, 4) + 1):
            for n2 in range(k2 + 1, 13 if k2 else 2):
                n1, slack, sound = self._partitions(least, k2, n2)
                n, each = n1 * comb(n2, k2), least / n1 * (n2 - k2) / n2
                if k2 == 0:
                    budget = max(SMALL_BUDGET, n)
                if best is None or sound and n <= budget and (not best[0] or each > best[1] * 1.05):
                    best = sound, each, n1, n2, k2, slack
        _, _, self.n1, self.n2, self.k2, self.slack = best
        self.subsets = np.array([[i in x for i in range(self.n2)] for x in combinations(range(self.n2), self.n2 - self.k2)], np.uint64)

    def _partitions(self, least: int, k2: int, n2: int) -> tuple[int, int, bool]:
        """Partitions, those of them that may be left out (about as many as are weak in the smallest sets), and whether few are weak."""
        base = self.k // (k2 + 1) + 1
        slack, weak = 0, 0.0
        for _ in range(6):
            mean = least / (base + slack) * (n2 - k2) / n2
            weak = exp(-mean) * (1 + mean) * comb(n2, k2)
            if weak > 0.25:
                return base, 0, False
            slack = int((base + slack) * weak + 2 * sqrt((base + slack) * weak)) if base > 3 else 0
        return base + slack, slack, True

    def signatures(self, items: np.ndarray) -> np.ndarray:
        """The signatures of a set of distinct 64-bit hashes."""
        seed = np.uint64((self.band + 1) * int(_SEED) % (1 << 64))
        h = mixed(items ^ seed)
        cell = ((h >> np.uint64(34)) % np.uint64(self.n1) * np.uint64(self.n2) + (h & np.uint64((1 << 30) - 1)) % np.uint64(self.n2)).astype(np.int64)
        cells = self.n1 * self.n2
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, mixed(h + _SEED))
        count = np.bincount(cell, minlength=cells).reshape(self.n1, self.n2)
        total = total.reshape(self.n1, self.n2)
        has = count @ self.subsets.T.astype(np.int64)
        name = (np.arange(self.n1, dtype=np.uint64)[:, None] << np.uint64(16)) + np.arange(len(self.subsets), dtype=np.uint64)[None]
        out = mixed((total[:, None, :] * self.subsets[None]).sum(2, dtype=np.uint64) ^ mixed(name + seed))
        weak = has < LEAST
        if weak.any(1).sum() <= self.slack:
            return out[~weak]
        return out.reshape(-1)


class Bands:
    """The bands of sizes at a threshold in percent; made as far as sizes reach."""

    def __init__(self, percent: int):
        self.percent, self.ends, self.schemes = percent, [100 // percent], {}

    def _widen(self) -> None:
        self.ends.append((self.ends[-1] + 1) * 100 // self.percent)

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            self._widen()
        return int(np.searchsorted(self.ends, size))

    def scheme(self, band: int) -> Scheme:
        if band not in self.schemes:
            while len(self.ends) <= band:
                self._widen()
            least = self.ends[band - 2] + 1 if band > 1 else 1
            self.schemes[band] = Scheme(band, least, self.ends[band], self.percent)
        return self.schemes[band]

    def signatures(self, items: np.ndarray) -> np.ndarray:
        """All signatures of a set: for pairs in which it is the larger, and for those with a set of the next band.

        Where no element may differ there are none, as equal sets are one node already.
        """
        band = self.of(len(items))
        return np.concatenate([s.signatures(items) for s in (self.scheme(band), self.scheme(band + 1)) if s.k] or [np.zeros(0, np.uint64)])


@lru_cache(8)
def bands(percent: int) -> Bands:
    return Bands(percent)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of texts (bytes and offsets), as 64-bit hashes; none for a text without words."""
    n = len(at) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * n
    raw = _LOWER[raw]
    solid = ~neardup._SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | border[1 : len(raw)]
    end[:-1] &= ~solid[1:] | border[1 : len(raw)]
    first = np.flatnonzero(start)
    word = word_hashes(raw[solid], np.flatnonzero(end) + 1 - first)
    cut = np.searchsorted(first, at)
    whole = np.zeros(max(len(word) - words + 1, 0), np.uint64)
    for j in range(words):
        whole += word[j : len(word) - words + 1 + j] * _ODD[j]
    whole = mixed(whole + np.uint64(words))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= words:
            items = np.sort(whole[a : b - words + 1])
            out.append(items[np.append(True, items[1:] != items[:-1])])
        elif b > a:
            out.append(mixed((word[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sliced(texts: pa.Array, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges [a, b) of texts, with the sets of their rows."""
    raw, at = utf8(texts)
    for a, b in slices(at, SLICE):
        yield a, b, shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], words)


def _name(items: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([mixed(items ^ _ODD[40]).sum(dtype=np.uint64), mixed(items + _ODD[41]).sum(dtype=np.uint64)]).tobytes()


def _key(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _sketch(items: np.ndarray) -> np.ndarray:
    """Whether the number of elements in each of ``SKETCH`` cells is odd, as longs.

    An element that only one of two sets has changes one bit, so sets differ in as many elements as bits, or more.
    """
    n = np.bincount((mixed(items ^ _ODD[42]) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Whether sets of so many elements can be similar: the larger one holds all that both can share."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _sketches_allow(percent: int) -> Column:
    """Whether the sets a and b (held, sketch) can be similar: 100 * both >= percent * union bounds the elements that they differ in."""
    bits = F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda so_far, x: so_far + x)
    return (100 + percent) * apart <= (100 - percent) * (F.col("a_held") + F.col("b_held"))


def _tied(signature: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs sorted by signature and key, each once; and for each the least key of its signature."""
    order = np.lexsort((key, signature))
    signature, key = signature[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (key[1:] != key[:-1])
    signature, key = signature[new], key[new]
    head = key[np.searchsorted(signature, signature, "left")]
    return signature, key, head


_PACKED = "slot int, kind int, a binary, b binary, c binary, d binary"
#: What a packed row holds: signatures and keys; signatures, heads and keys that are tied; rows of documents.
OPEN, TIED, ROWS = range(3)
_MET = "edge boolean, signature long, a long, b long, doc_id long, ref long, name binary, key long, n_shingles long"
_ROW = np.dtype([("has_id", "?"), ("doc_id", "<i8"), ("ref", "<i8"), ("name", "V16"), ("key", "<i8"), ("n", "<i8")])


def _packed(texts: DataFrame, words: int, percent: int, slots: int) -> DataFrame:
    """What the rows of texts (doc_id, ref, text) and their signatures come to, packed by slot.

    Equal signatures of a task are tied to a head; one pair of each signature goes on to the slot where it is at home.
    """

    def parts(slot: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(slot, kind="stable")
        cut = np.flatnonzero(np.append(True, slot[order][1:] != slot[order][:-1])) if len(order) else np.zeros(0, np.int64)
        ends = np.append(cut, len(order))
        packed = [pa.array([x[order[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in columns]
        packed += [pa.nulls(len(cut), pa.binary())] * (4 - len(packed))
        return pa.record_batch([pa.array(slot[order][cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32)), *packed], ["slot", "kind", "a", "b", "c", "d"])

    def flush(signatures: list, keys: list) -> Iterator[pa.RecordBatch]:
        signature, key, head = _tied(np.concatenate(signatures), np.repeat(np.array(keys, np.int64), [len(x) for x in signatures]))
        tied = key != head
        n = np.uint64(slots)
        yield parts(signature[~tied] % n, OPEN, signature[~tied], key[~tied])
        # What is tied is done, and goes anywhere.
        yield parts(mixed(signature[tied] ^ key[tied].view(np.uint64)) % n, TIED, signature[tied], head[tied], key[tied])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bands(percent)
        signatures, keys, n = [], [], 0
        for batch in tidied(batches):
            ids, refs = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b, sets in _sliced(batch.column(2), words):
                names = [_name(x) for x in sets]
                rows = np.array([(i is not None, i or 0, r, m, _key(m), len(x)) for i, r, m, x in zip(ids[a:b], refs[a:b], names, sets, strict=True)], _ROW)
                yield parts(mixed(refs[a:b].astype(np.int64).view(np.uint64)) % np.uint64(slots), ROWS, rows)
                for items, name in zip(sets, names, strict=True):
                    if len(items):
                        signatures.append(known.signatures(items))
                        keys.append(_key(name))
                        n += len(signatures[-1])
                        if n > HELD:
                            yield from flush(signatures, keys)
                            signatures, keys, n = [], [], 0
        if n:
            yield from flush(signatures, keys)

    return texts.select("doc_id", "ref", "text").mapInArrow(run, _PACKED)


def _meet(rows: pa.Table) -> pa.Table:
    """The signatures of a slot that several sets have, as stars (signature, head, another set); and its rows of documents."""

    def joined(kind: int, column: str, of) -> np.ndarray:
        part = rows.filter(pc.equal(rows.column("kind"), kind))
        return np.frombuffer(b"".join(part.column(column).to_pylist()), of)

    signature, key, head = _tied(joined(OPEN, "a", np.uint64), joined(OPEN, "b", np.int64))
    more = key != head
    edges = [np.concatenate([x, y]) for x, y in ((joined(TIED, "a", np.int64), signature[more].view(np.int64)), (joined(TIED, "b", np.int64), head[more]), (joined(TIED, "c", np.int64), key[more]))]
    docs = joined(ROWS, "a", _ROW)
    m, n = len(edges[0]), len(docs)
    none = pa.nulls(n, pa.int64())
    of_edges = [pa.array(np.ones(m, bool)), *map(pa.array, edges), *[pa.nulls(m, pa.int64())] * 2, pa.nulls(m, pa.binary()), *[pa.nulls(m, pa.int64())] * 2]
    names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(docs["name"]))]).cast(pa.binary())
    ids = pa.array(np.ascontiguousarray(docs["doc_id"]), mask=~docs["has_id"])
    of_docs = [pa.array(np.zeros(n, bool)), none, none, none, ids, pa.array(np.ascontiguousarray(docs["ref"])), names, *(pa.array(np.ascontiguousarray(docs[c])) for c in ("key", "n"))]
    columns = ["edge", "signature", "a", "b", "doc_id", "ref", "name", "key", "n_shingles"]
    return pa.concat_tables([pa.table(of_edges, columns), pa.table(of_docs, columns)])


def _items(texts: DataFrame, words: int) -> DataFrame:
    """key, name, the sorted shingles and the sketch of each set, from (key, text); a text that is not its key's is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            given = batch.column(0).to_pylist()
            for a, b, sets in _sliced(batch.column(1), words):
                names = [_name(x) for x in sets]
                fits = [i for i, x in enumerate(names) if _key(x) == given[a + i]]
                yield pa.record_batch([pa.array([given[a + i] for i in fits], pa.int64()), pa.array([names[i] for i in fits], pa.binary()), pa.array([sets[i].view(np.int64) for i in fits], pa.list_(pa.int64())), pa.array([_sketch(sets[i]) for i in fits], pa.list_(pa.int64()))], ["key", "name", "items", "sketch"])

    return texts.select("key", "text").mapInArrow(run, "key long, name binary, items array<long>, sketch array<long>").dropDuplicates(["name"])


def _stars(candidates: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each signature's hub and its other sets, and hubs (signature, hub): of ``candidates``, that which meets most."""
    hubs = stored(candidates.groupBy("signature").agg(F.max(F.struct("meets", "key")).alias("h")).select("signature", F.col("h.key").alias("hub")), "partenum-hubs")
    pairs = members.join(hubs, "signature").where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    return stored(pairs, "partenum-pairs"), hubs


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The pairs (a, b), in order, without those that were compared in an earlier turn."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "partenum-untried")


def _in_blocks(left: DataFrame, placed: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """a, b, similarity: links of different components between the sets of signatures (signature, key, label).

    Sets are put into blocks by the largest signature that they have, so that those that share much stand together, and
    two blocks are compared if some signature has sets in both.
    """
    sizes = left.groupBy("signature").agg(F.count("*").alias("n"))
    homes = left.join(sizes, "signature").groupBy("key").agg(F.max(F.struct("n", "signature")).alias("h")).select("key", F.col("h.signature").alias("home"))
    homes = stored(homes.join(placed.select("key", "name", "held"), "key"), "partenum-homes")
    blocks = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_ITEMS)).alias("n"))
    at = homes.join(blocks, "home").select("key", "name", F.concat_ws("-", "home", F.pmod(F.xxhash64("key"), F.col("n"))).alias("block"))
    at = stored(at, "partenum-at")
    there = stored(left.join(at.select("key", "block"), "key").select("signature", "block").distinct(), "partenum-there")
    both = there.withColumnRenamed("block", "i").join(there.withColumnRenamed("block", "j"), "signature").where("i <= j").select("i", "j").distinct()
    both = stored(both, "partenum-both")
    labels = left.select("key", "label").distinct()
    sets = at.join(labels, "key").select("block", F.col("name").alias("node"), "label").distinct().join(items.select(F.col("name").alias("node"), "items"), "node")
    packed = stored(sets.select("block", "node", "label", "items").groupBy("block").applyInArrow(_pack, "side string, payload binary"), "partenum-packed")
    # A block goes once, packed, to each pair that it is in.
    sides = both.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    compare = neardup._block_links(percent / 100)

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for side, payload in zip(rows.column("side").to_pylist(), rows.column("payload").to_pylist(), strict=True):
            part = pa.ipc.open_stream(payload).read_all()
            parts.append(part.append_column("side", pa.array([side] * part.num_rows, pa.string())))
        whole = pa.concat_tables(parts)
        for name in ("i", "j"):
            whole = whole.append_column(name, pa.array([rows.column(name)[0].as_py()] * whole.num_rows, pa.string()))
        return compare(whole)

    return sides.join(packed, "side").select("i", "j", "side", "payload").groupBy("i", "j").applyInArrow(run, "a binary, b binary, similarity double")


def _pack(rows: pa.Table) -> pa.Table:
    """The sets of a block as one row."""
    sink = pa.BufferOutputStream()
    sets = rows.select(["node", "label", "items"])
    with pa.ipc.new_stream(sink, sets.schema) as out:
        out.write_table(sets)
    return pa.table([pa.array([rows.column("block")[0].as_py()], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["side", "payload"])


def _similar(pairs: DataFrame, placed: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """a and b (names of sets) for the pairs of keys that are similar by exact comparison.

    ``placed`` has key, block, held and sketch.  Pairs of two blocks are one piece of work, to which each of their sets goes
    once.  Pairs that cannot be similar by their sizes and sketches are not dealt.
    """
    of = lambda x: placed.select(F.col("key").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("block", "held", "sketch")))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").where(_sizes_allow("a_held", "b_held", percent) & _sketches_allow(percent))
    # Both sides of the comparison read it.
    dealt = stored(dealt.select(F.least("a_block", "b_block").alias("i"), F.greatest("a_block", "b_block").alias("j"), "a", "b").distinct(), "partenum-dealt")
    asked = dealt.select(F.col("i").alias("left"), F.col("j").alias("right"), F.explode(F.array("a", "b")).alias("key")).distinct().join(items.select("key", "name", "items"), "key")

    def run(some: pa.Table, sets: pa.Table) -> pa.Table:
        of: dict[int, list] = {}
        for key, name, values in zip(sets.column("key").to_pylist(), sets.column("name").to_pylist(), _lists(sets.column("items")), strict=True):
            of.setdefault(key, []).append((name, values))
        found = []
        for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True):
            for x, xs in of.get(a, ()):
                for y, ys in of.get(b, ()):
                    n = len(xs) + len(ys)
                    # The larger set holds all that both can share.
                    if 100 * min(len(xs), len(ys)) >= percent * max(len(xs), len(ys)):
                        both = len(np.intersect1d(xs, ys, assume_unique=True))
                        if 100 * both >= percent * (n - both):
                            found.append((x, y))
        return pa.table([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    return dealt.groupBy("i", "j").cogroup(asked.groupBy("left", "right")).applyInArrow(run, "a binary, b binary")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of a column of lists of longs, without a Python object for each."""
    out = []
    for chunk in column.chunks:
        at, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """What the rows of ``docs`` (doc_id long, text string) are linked with: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z in lower case.  A row's set has its distinct shingles of
    ``words`` words, or all words as one where it has fewer.  Two rows link when 100 * both >= percent * union;
    component_id is the least doc_id that links reach from a row, its own included.

    Null, empty and blank texts have no shingles, link with nothing and are components of their own.  Texts
    of any length are read whole.  Repeated rows link with each other.  A null doc_id is the greatest; a
    component of null ids has a null component_id.  An empty table gives an empty result.  Columns besides doc_id and
    text are ignored.
    """
    # ref leads back to a text; it stands in for the doc_ids that are null.
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("ref"), body().alias("text"))
    # As a rule a text has one signature for ten bytes; slots set how work is spread, nothing else.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (10 * SLOT) + 1)
    met = stored(_packed(docs, words, percent, slots).groupBy("slot").applyInArrow(_meet, _MET), "partenum-met", wide=True)
    edges = met.where("edge").select("signature", "a", "b")
    rows = met.where("not edge").select("doc_id", "ref", "name", "key", "n_shingles")
    # Each signature that several sets have, with those sets; a set that meets many others is near to many.
    members = stored(edges.select("signature", F.explode(F.array("a", "b")).alias("key")).distinct(), "partenum-members")
    # Similar sets share many signatures; of those that the same sets have, one stands for all.
    held_by = members.groupBy("signature").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    sizes = stored(held_by.groupBy("n", "x", "y").agg(F.min("signature").alias("signature")).select("signature", "n"), "partenum-signatures")
    members = stored(members.join(sizes, "signature"), "partenum-classes")
    meets = stored(members.groupBy("key").agg(F.sum("n").alias("meets")), "partenum-meets")
    members = stored(members.join(meets, "key"), "partenum-ranked")
    pairs, hubs = _stars(members, members)

    # Sets that meet others, by the least hub that they meet: their home.
    homes = pairs.select(F.col("b").alias("key"), F.col("a").alias("home")).unionByName(pairs.select(F.col("a").alias("key"), F.col("a").alias("home"))).groupBy("key").agg(F.min("home").alias("home"))
    named = stored(rows.join(homes, "key").groupBy("key", "name", "home").agg(F.min("ref").alias("ref"), F.max("n_shingles").alias("held")), "partenum-asked")
    # Documents that meet others grow with the table, so they are never broadcast.
    texts = docs.select("ref", "text").join(named.select("ref", "key").distinct().hint("merge"), "ref")
    items = stored(_items(texts, words), "partenum-items", wide=True)
    blocks = named.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_ITEMS)).alias("n"))
    placed = named.join(blocks, "home").select("key", "name", "held", F.concat_ws("-", "home", F.pmod(F.xxhash64("key"), F.col("n"))).alias("block"))
    placed = placed.join(items.select("name", "sketch"), "name")
    placed = stored(placed, "partenum-blocks")

    links, tried, left = None, None, members
    for turn in range(TURNS):
        pairs = _untried(pairs, tried)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_similar(pairs, placed, items, percent), "partenum-links", wide=True)
        links = found if links is None else links.unionByName(found)
        classes = components(links)
        # What is left: signatures whose sets are not all tied by links yet.
        labels = named.select("key", F.col("name").alias("node")).join(classes, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
        left = left.drop("label").join(stored(labels, "partenum-labels"), "key")
        apart = left.groupBy("signature").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("signature")
        left = stored(left.join(apart, "signature"), "partenum-left")
        if turn < TURNS - 1:
            # The set that meets most, among those that no hub is tied to, is held against all others, unless all will be paired.
            many = left.where(F.col("n") > PAIRED)
            tied = hubs.withColumnRenamed("hub", "key").join(many.select("signature", "key", "label"), ["signature", "key"]).select("signature", "label")
            pairs, more = _stars(many.join(tied.distinct(), ["signature", "label"], "left_anti"), many)
            hubs = hubs.unionByName(more)
    few = left.where(F.col("n") <= PAIRED).join(placed.select("key", "held", "sketch"), "key")
    of = lambda x: few.select("signature", *(F.col(c).alias(f"{x}_{c}") for c in ("key", "label", "held", "sketch")))
    met_in = of("a").join(of("b"), "signature").where("a_key < b_key AND a_label <> b_label")
    near = met_in.where(_sizes_allow("a_held", "b_held", percent) & _sketches_allow(percent))
    pairs = _untried(near.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")), tried)
    more = stored(_similar(pairs, placed, items, percent), "partenum-links", wide=True)
    more = more.unionByName(stored(_in_blocks(left.where(F.col("n") > PAIRED).drop("n"), placed, items, percent), "partenum-more", wide=True).select("a", "b"))
    if not more.isEmpty():
        classes = components(links.unionByName(more))

    parts = rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"))
    parts = stored(parts.join(classes.withColumnRenamed("node", "name"), "name", "left").select("name", "least", "n_shingles", F.coalesce("label", "name").alias("label")), "partenum-parts")
    least = parts.groupBy("label").agg(F.min("least").alias("component_id"))
    reached = parts.where("n_shingles > 0").join(least, "label").select("name", "component_id")
    return rows.join(reached, "name", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
