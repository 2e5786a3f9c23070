"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its shingles of five words.  DartMinHash throws darts into the
plane of weight and rank over every element: a Poisson process in rank, hashed from the element alone,
whose darts have a coordinate and a height.  A document sees the darts that are below the weights
of its elements, and for each coordinate keeps the one of least rank.  Two documents keep the same
dart with a probability that is their weighted Jaccard similarity.  Only about k ln k darts are thrown
for a document, whatever its length, by stopping at a rank that falls with its total weight.

Documents with the same set of shingles are one node.  Nodes that agree on a band of coordinates meet
in a bucket:

* in each bucket all nodes are held against its hub, the node that meets most others, and links are
  those with an exact similarity over the threshold;
* buckets of three nodes or more whose nodes are not all in one component after that are compared
  exactly, in blocks of nodes.  Only pairs of different components count, so no link that could
  change a class is lost, and of these only what spans the components is written.

Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, mixed, slices, stored, tidied, utf8, word_hashes
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 6 coordinates: a pair of similarity 0.8 meets with a probability of 0.9993.
BANDS, ROWS = 24, 6
#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE = 512 << 10
#: Nodes, and shingles of these together, of a block in the exact comparison of a bucket.
BLOCK, BLOCK_ITEMS = 256, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _turn(i: int) -> np.uint64:
    """The i-th multiple of a step, modulo 2**64."""
    return np.uint64(i * int(_STEP) % (1 << 64))


_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts (bytes and offsets): text, hash and multiplicity of each, by text and hash.

    Words are runs of anything but ASCII white space.  A text of fewer words than a shingle has one
    shingle with all of them; a text without words has none.
    """
    n = len(at) - 1
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none.astype(np.uint64), none
    solid = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | border[1 : len(raw)]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | border[1 : len(raw)]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    word = word_hashes(raw[solid], last - first)
    owner = np.searchsorted(at, first, "right") - 1
    size = np.bincount(owner, minlength=n)
    begins = np.concatenate([[0], np.cumsum(size)])[:-1]
    many = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    doc = np.repeat(np.arange(n), many)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + begins[doc]
    left = np.minimum(size, words)[doc]
    hashed = np.zeros(len(doc), np.uint64)
    for j in range(words):
        within = j < left
        hashed[within] += word[place[within] + j] * _ODD[j]
    hashed = mixed(hashed + left.astype(np.uint64))
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    where = np.flatnonzero(new)
    return doc[where], hashed[where], np.diff(np.append(where, len(doc)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """k coordinates for each of n documents, given as rows (doc, element, weight over 0) sorted by doc.

    The heights are cut into bands [0, 1), [1, 2), [2, 4), ...; each is a process of its own, so that
    an element's darts are the same whatever its weight.  A document that is left without a dart for
    some coordinate goes on to twice the rank.  Documents without elements keep zeros.
    """
    signature = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weight, n)
    reach = np.where(total > 0, (k * np.log(k) + 4 * k) / np.maximum(total, 1e-300), 0)
    layers = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), layers)
    layer = np.arange(len(row)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    wide = np.where(layer == 0, 1.0, low)
    seed = mixed(element[row] + layer.astype(np.uint64) * _STEP)
    owner, top = doc[row], weight[row]
    todo = np.flatnonzero(total > 0)
    while len(todo):
        asked = np.zeros(n, bool)
        asked[todo] = True
        live = np.flatnonzero(asked[owner])
        best = np.full(n * k, np.inf)
        rank, step = np.zeros(len(live)), 0
        thrown = []
        while len(live):
            step += 2
            rank = rank - np.log(_unit(mixed(seed[live] + _turn(step - 1)))) / wide[live]
            on = rank <= reach[owner[live]]
            live, rank = live[on], rank[on]
            dart = mixed(seed[live] + _turn(step))
            under = low[live] + _unit(mixed(dart)) * wide[live] < top[live]
            cell = owner[live][under] * k + (dart[under] % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank[under])
            thrown.append((cell, rank[under], dart[under]))
        for cell, at, dart in thrown:
            kept = at == best[cell]
            signature.reshape(-1)[cell[kept]] = dart[kept]
        open_ = np.isinf(best.reshape(n, k)).any(1)
        todo = todo[open_[todo]]
        reach[todo] *= 2
    return signature


def _node(doc: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """A 128-bit name of each document's set of shingles."""
    name = np.zeros((n, 2), np.uint64)
    np.add.at(name[:, 0], doc, mixed(hashed ^ _ODD[40]))
    np.add.at(name[:, 1], doc, mixed(hashed + _ODD[41]))
    return name


def _binary(name: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(name)], pa.binary())


def sketches(docs: DataFrame, weights: str = "set", words: int = WORDS) -> DataFrame:
    """doc_id, ref, digest, node, bands (array<long>) of each row of ``docs`` (doc_id, ref, digest, text).

    ``weights``: "set" gives each shingle the weight 1, so that similarity is Jaccard's of sets;
    "count" weighs shingles by their multiplicity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            raw, at = utf8(batch.column(3))
            for a, b in slices(at, SLICE):
                n = b - a
                doc, hashed, times = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a], words)
                weight = times.astype(np.float64) if weights == "count" else np.ones(len(doc))
                signature = dart_minhash(doc, hashed, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
                band = mixed((signature * _ODD[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)
                # Texts without words meet nobody; their node alone makes them alike.
                size = np.where(np.bincount(doc, minlength=n)[:n] > 0, BANDS, 0)
                flat = band[size > 0].reshape(-1)
                name = _node(doc, hashed if weights == "set" else mixed(hashed + times.astype(np.uint64)), n)
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(flat))
                yield pa.record_batch([*(batch.column(c).slice(a, n) for c in range(3)), _binary(name), bands], ["doc_id", "ref", "digest", "node", "bands"])

    return docs.select("doc_id", "ref", "digest", "text").mapInArrow(run, "doc_id long, ref long, digest binary, node binary, bands array<long>")


def _elements(texts: DataFrame, weights: str, words: int) -> DataFrame:
    """node and its sorted shingles, from (node, text); a text that is not its node's is left out.

    With counts as weights, the i-th occurrence of a shingle is an element of its own, which makes
    weighted similarity that of sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            raw, at = utf8(batch.column(1))
            for a, b in slices(at, SLICE):
                n = b - a
                doc, hashed, times = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a], words)
                name = _node(doc, hashed if weights == "set" else mixed(hashed + times.astype(np.uint64)), n)
                if weights == "count":
                    doc, each = np.repeat(doc, times), np.repeat(hashed, times)
                    hashed = mixed(each + (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64) * _STEP)
                ends = np.searchsorted(doc, np.arange(n + 1))
                sets = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(hashed.view(np.int64)))
                given = batch.column(0).slice(a, n)
                same = pa.array([x.tobytes() == y for x, y in zip(name, given.to_pylist(), strict=True)], pa.bool_())
                yield pa.record_batch([given, sets], ["node", "items"]).filter(same)

    return texts.select("node", "text").mapInArrow(run, "node binary, items array<long>").dropDuplicates(["node"])


def _block_links(similarity: float):
    """Links of different components between the nodes of one block, or of two."""

    def run(rows: pa.Table) -> pa.Table:
        two = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        nodes, part, side = rows.column("node").to_pylist(), rows.column("label").to_pylist(), rows.column("side").to_pylist()
        items = [np.array(x, np.int64) for x in rows.column("items").to_pylist()]
        size = np.array([len(x) for x in items])
        index = {x: i for i, x in enumerate(dict.fromkeys(part))}
        part = np.array([index[x] for x in part])
        left = np.flatnonzero(np.array(side) == rows.column("i")[0].as_py()) if two else np.arange(len(nodes))
        right = np.flatnonzero(np.array(side) == rows.column("j")[0].as_py()) if two else np.arange(len(nodes))
        # Shared items: only those that occur in two nodes matter.
        flat, owner = np.concatenate(items) if len(items) else np.zeros(0, np.int64), np.repeat(np.arange(len(items)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        again = np.zeros(len(flat), bool)
        again[1:] = flat[1:] == flat[:-1]
        again[:-1] |= again[1:]
        flat, owner = flat[again], owner[again]
        place = np.cumsum(np.append(True, flat[1:] != flat[:-1])[: len(flat)]) - 1
        shared = np.zeros((len(left), len(right)), np.float32)
        row_of, col_of = np.full(len(nodes), -1), np.full(len(nodes), -1)
        row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
        total = int(place[-1]) + 1 if len(place) else 0
        for a in range(0, total, 4096):
            inner = slice(*np.searchsorted(place, [a, min(a + 4096, total)]))
            p, o = place[inner] - a, owner[inner]
            x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            x[row_of[o[row_of[o] >= 0]], p[row_of[o] >= 0]] = 1
            y[col_of[o[col_of[o] >= 0]], p[col_of[o] >= 0]] = 1
            shared += x @ y.T
        union = size[left][:, None] + size[right][None] - shared
        # As a ratio of integers, so that a similarity of exactly the threshold counts.
        near = (shared >= similarity * union - 1e-6) & (part[left][:, None] != part[right][None])
        if not two:
            near &= np.arange(len(left))[:, None] < np.arange(len(right))[None]
        r, c = np.nonzero(near)
        value = shared[r, c] / union[r, c]
        # A link for each pair of components that is new, the nearest first: they span the block's components.
        root = list(range(len(index)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        kept = []
        for k in np.argsort(-value, kind="stable"):
            x, y = find(part[left[r[k]]]), find(part[right[c[k]]])
            if x != y:
                root[x] = y
                kept.append(k)
        return pa.table([pa.array([nodes[left[r[k]]] for k in kept], pa.binary()), pa.array([nodes[right[c[k]]] for k in kept], pa.binary()), pa.array(value[kept].astype(np.float64))], names=["a", "b", "similarity"])

    return run


def links_within(members: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """a, b, similarity: links between nodes of one bucket and of different components, by exact comparison.

    ``members`` has bucket, node, held (the size of its set) and label (its component); ``items`` has node and
    items.  A bucket is cut into blocks by the number of its nodes and by what they hold.
    """
    blocks = members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    last = F.col("blocks") - 1
    dealt = members.join(blocks, "bucket").withColumn("side", F.pmod(F.xxhash64("node"), last + 1).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    dealt = dealt.join(items, "node").select("bucket", "i", "j", "side", "node", "label", "items")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(_block_links(similarity), "a binary, b binary, similarity double")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "set", words: int = WORDS) -> DataFrame:
    """Classes of near-duplicate rows of ``docs`` (doc_id long, text string).

    Returns a row per row of ``docs``: doc_id, class_id (the least doc_id of its class), class_size
    (rows), kept (doc_id = class_id), near_id and near_similarity (the nearest other text that it was
    found to be linked with, by its least doc_id; null for texts that are alone).  Two rows are linked if
    the weighted Jaccard similarity of their shingles is at least ``similarity``; classes are what links
    connect.  ``weights``: "set" weighs every shingle 1, "count" by how often a text has it.

    Null texts count as empty.  Texts without words are alike, and like nothing else.  Texts of fewer
    than ``words`` words are one shingle, so only the same words in the same order are near.  Repeated
    rows are in one class, and all rows that bear the class's least doc_id are kept.  A null doc_id is
    the greatest; a class of null ids has a null class_id and keeps its rows.  An empty table gives an
    empty result; columns besides doc_id and text are ignored.
    """
    return _classed(docs, similarity, weights, words).drop("digest")


def _digest() -> Column:
    """16 bytes that tell the texts of rows with one doc_id apart; null counts as empty."""
    return F.unhex(F.md5(body().cast("binary")))


def _classed(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "set", words: int = WORDS) -> DataFrame:
    """The rows of :func:`near_groups` with the digest of their text."""
    # ref leads back to a text; it stands in for the doc_ids that are null.
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("ref"), _digest().alias("digest"), "text")
    rows = stored(sketches(docs, weights, words), "sketches", wide=True)
    nodes = stored(rows.groupBy("node", "bands").agg(F.min("doc_id").alias("rep"), F.min("ref").alias("ref"), F.count("*").alias("n_rows")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    counts = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(members.join(counts, "bucket"), "members")
    meets = stored(members.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    ranked = members.join(meets, "node")
    hubs = stored(ranked.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub")), "hubs")
    pairs = members.join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(pairs, "pairs")

    asked = stored(meets.select("node").join(nodes.select("node", "ref"), "node"), "asked")
    # The same plan at every size: the documents that are asked for grow with the table, so they are never broadcast.
    texts = docs.select("ref", "text").join(asked.hint("merge"), "ref")
    items = stored(_elements(texts, weights, words), "items", wide=True)
    of = lambda name: items.select(F.col("node").alias(name), F.col("items").alias(f"{name}_items"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - F.col("shared")
    links = both.withColumn("shared", shared).where(F.col("shared") >= similarity * union - 1e-6)
    links = stored(links.select("a", "b", (F.col("shared") / union).alias("similarity")), "near-links")

    classes = components(links.select("a", "b"))
    labelled = stored(members.where("n > 2").join(classes, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label")), "labelled")
    mixed_up = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    mixed_up = stored(mixed_up, "mixed")
    sized = labelled.join(mixed_up, "bucket").join(items.select("node", F.size("items").alias("held")), "node")
    more = stored(links_within(stored(sized.select("bucket", "node", "held", "label"), "mixed-nodes"), items, similarity), "more-links", wide=True)
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links.select("a", "b"))

    classed = nodes.join(classes, "node", "left").select("node", "rep", "n_rows", F.coalesce("label", "node").alias("label"))
    classed = stored(classed, "classed")
    sizes = stored(classed.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n_rows").alias("class_size")), "class-sizes")
    # The best link of each node, ties to the least document.
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    ends = ends.join(classed.select(F.col("node").alias("b"), F.coalesce("rep", F.lit((1 << 63) - 1)).alias("rep")), "b")
    near = ends.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("similarity", (-F.col("rep")).alias("neg"))).alias("best"))
    near = near.select("node", F.when(F.col("best.neg") > -((1 << 63) - 1), -F.col("best.neg")).alias("near_id"), F.col("best.similarity").alias("near_similarity"))
    named = classed.select("node", "label").join(sizes, "label").join(near, "node", "left")
    named = stored(named.select("node", "class_id", "class_size", "near_id", "near_similarity"), "named")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    return rows.select("doc_id", "digest", "node").join(named, "node").select("doc_id", "digest", "class_id", "class_size", kept, "near_id", "near_similarity")


def drop_near(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class; rows that repeat the doc_id which stays, stay too."""
    gone = _classed(docs.select("doc_id", "text"), **how).where("not kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__gone")).distinct()
    text = docs.withColumn("__digest", _digest())
    return text.join(gone, text.doc_id.eqNullSafe(gone["__id"]) & (text["__digest"] == gone["__gone"]), "left_anti").drop("__digest")
