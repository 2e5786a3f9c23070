"""A quality classifier: a convolutional network on bytes, in numpy.

Bytes are embedded; learned filters slide over the whole document.  The document is covered by
chunks that overlap by half; in each, every filter keeps its largest response, and hidden units
combine those.  Every hidden unit keeps its largest value over all chunks, and a logistic unit turns
these into one probability.  So a document is judged by its most telling chunks, wherever they are.

The network is trained on the driver from a bounded sample of labelled rows; it has a few thousand
weights, which go to the tasks with the function that scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, slices, tidied, utf8

#: Labelled rows that training uses at most.
SAMPLE = 2400
#: Bytes of their texts, at most.
SAMPLE_BYTES = 32 << 20
#: Bytes of a sampled row that one training step may hold at most in a batch; longer rows train alone.
SLICE = 512 << 10
BLOCK, STRIDE, WIDTH = 64, 2, 6
#: Bytes of a longer text that are read at once.
PIECE = 1 << 20
PAD = 256
PASS_SCORE = 0.7


class ByteConvNet:
    """Weights: emb (257, e), filt (WIDTH * e, f), fb (f), hid (f, h), hb (h), out (h), ob ()."""

    def __init__(self, e: int = 4, f: int = 24, h: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.w = {"emb": draw(257, e, s=0.5), "filt": draw(WIDTH * e, f, s=0.4), "fb": np.zeros(f, np.float32), "hid": draw(f, h, s=0.3), "hb": np.full(h, 0.1, np.float32), "out": draw(h, s=0.3), "ob": np.zeros(1, np.float32)}
        self.w["emb"][PAD] = 0

    def _forward(self, raw: np.ndarray, at: np.ndarray) -> dict:
        w = self.w
        size = np.diff(at)
        blocks = (size + WIDTH + 2 + BLOCK - 1) // BLOCK
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.full(first[-1] * BLOCK + WIDTH, PAD, np.int16)
        padded[np.arange(len(raw)) + np.repeat(first[:-1] * BLOCK - at[:-1], size)] = raw
        emb = w["emb"][padded]
        e = emb.shape[1]
        n = first[-1] * BLOCK // STRIDE
        windows = np.lib.stride_tricks.as_strided(emb, (n, WIDTH * e), (STRIDE * e * 4, 4))
        resp = (np.ascontiguousarray(windows) @ w["filt"]).reshape(first[-1], BLOCK // STRIDE, -1)
        # The last windows of a document reach into the next one; they count as padding, as all before them of its last eight bytes is.
        resp[first[1:] - 1, -((WIDTH - 1) // STRIDE) :] = 0
        best = resp.argmax(1) if self.training else None
        top = resp.max(1)
        last = np.zeros(len(top), bool)
        last[first[1:] - 1] = True
        nxt = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
        nxt[last] = np.flatnonzero(last)  # the last block of a document pairs with itself
        chunk = np.maximum(top, top[nxt])
        act = np.maximum(chunk + w["fb"], 0)
        hidden = np.maximum(act @ w["hid"] + w["hb"], 0)
        pooled = np.maximum.reduceat(hidden, first[:-1]) if len(size) else np.zeros((0, hidden.shape[1]), np.float32)
        z = pooled @ w["out"] + w["ob"][0]
        return locals()

    training = False

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A probability for each text (bytes and offsets)."""
        if len(at) < 2:
            return np.zeros(0)
        if len(at) == 2 and at[1] > PIECE:
            z = self._pooled_by_piece(raw) @ self.w["out"] + self.w["ob"][0]
            return 1 / (1 + np.exp(-np.array([z], np.float64)))
        return 1 / (1 + np.exp(-self._forward(raw, at)["z"].astype(np.float64)))

    def _pooled_by_piece(self, raw: np.ndarray) -> np.ndarray:
        """The pooled units of one long text, read piece by piece so that memory does not grow with it.

        A piece is read with the block after it and what that one's windows reach into, and only its own
        blocks count.
        """
        pooled, step = np.zeros(len(self.w["hb"]), np.float32), PIECE // BLOCK * BLOCK
        for a in range(0, len(raw), step):
            end = a + step
            last = end + BLOCK + WIDTH >= len(raw)
            part = raw[a:] if last else raw[a : end + BLOCK + WIDTH]
            hidden = self._forward(part, np.array([0, len(part)]))["hidden"]
            pooled = np.maximum(pooled, (hidden if last else hidden[: step // BLOCK]).max(0))
            if last:
                break
        return pooled

    def gradients(self, raw: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean log loss; only the places that the maxima come from pass any on."""
        self.training = True
        v = self._forward(raw, at)
        self.training = False
        w, m, first = self.w, len(label), v["first"]
        p = 1 / (1 + np.exp(-v["z"]))
        loss = -np.mean(np.log(np.clip(np.where(label == 1, p, 1 - p), 1e-7, 1)))
        dz = ((p - label) / m).astype(np.float32)
        g = {"out": v["pooled"].T @ dz, "ob": np.array([dz.sum()])}
        dpool = dz[:, None] * w["out"] * (v["pooled"] > 0)
        doc, unit = np.nonzero(dpool)
        where = np.concatenate([first[d] + v["hidden"][first[d] : first[d + 1]].argmax(0)[None] for d in range(m)])[doc, unit]
        dh = dpool[doc, unit]
        act = v["act"][where]
        g["hb"] = np.bincount(unit, dh, len(w["hb"]))
        g["hid"] = np.zeros_like(w["hid"])
        np.add.at(g["hid"].T, unit, act * dh[:, None])
        dact = w["hid"].T[unit] * dh[:, None] * (act > 0)
        g["fb"] = dact.sum(0)
        row, filt = np.nonzero(dact)
        d = dact[row, filt]
        blk, other = where[row], v["nxt"][where[row]]
        blk = np.where(v["top"][blk, filt] >= v["top"][other, filt], blk, other)
        pos = blk * BLOCK + v["best"][blk, filt] * STRIDE
        e = w["emb"].shape[1]
        tokens = v["padded"][pos[:, None] + np.arange(WIDTH)]
        seen = w["emb"][tokens].reshape(len(pos), -1)
        g["filt"] = np.zeros_like(w["filt"])
        np.add.at(g["filt"].T, filt, seen * d[:, None])
        demb = (w["filt"].T[filt] * d[:, None]).reshape(-1, e)
        flat = tokens.reshape(-1)
        g["emb"] = np.stack([np.bincount(flat, demb[:, j], 257) for j in range(e)], 1)
        g["emb"][PAD] = 0
        return g, float(loss)

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 1000, batch: int = 32, rate: float = 0.01, seed: int = 2) -> ByteConvNet:
        """Adam on shuffled batches, with a falling rate; always the same for the same rows in the same order."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(x, np.float64) for k, x in self.w.items()}
        square = {k: np.zeros_like(x, np.float64) for k, x in self.w.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(texts))
            for a in range(0, min(len(order), (steps - step) * batch), batch):
                picks = order[a : a + batch]
                at = np.cumsum([0, *(len(texts[i]) for i in picks)])
                raw = np.frombuffer(b"".join(texts[i] for i in picks), np.uint8)
                g, _ = self.gradients(raw, at, labels[picks])
                step += 1
                now = rate * (1 - (step - 1) / steps)
                for k, x in self.w.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                    square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                    x -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out():
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteConvNet:
    """A network trained on at most ``sample`` labelled rows of ``docs`` that are not held out.

    The sample has the rows with the smallest hashes of doc_id, so it does not depend on order.  It is chosen on
    numbers alone: rows are taken in that order as long as their whole texts fit into ``SAMPLE_BYTES``, and one that does
    not fit is passed over, so neither the driver nor a task holds more.  Rows with a null label take no part; of labels
    for one doc_id, one is used.  Where no row is left, the network is untrained.
    """
    picked = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    picked = picked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = docs.select("doc_id", body().alias("text")).withColumn("name", F.xxhash64("text"))
    sizes = named.join(F.broadcast(picked), "doc_id").select("doc_id", "name", "quality", F.octet_length("text").cast("long").alias("n"))  # of at most ``sample`` rows
    chosen, left = [], SAMPLE_BYTES
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "name").limit(sample).collect():
        if row.n <= left:
            chosen.append(row)
            left -= row.n
    net = ByteConvNet()
    if not chosen:
        return net
    keys = docs.sparkSession.createDataFrame(sorted({(r.doc_id, r.name) for r in chosen}), "doc_id long, name long")
    texts = {(r.doc_id, r.name): r.text for r in named.join(F.broadcast(keys), ["doc_id", "name"]).dropDuplicates(["doc_id", "name"]).collect()}
    return net.fit([texts[r.doc_id, r.name].encode() for r in chosen], np.array([r.quality for r in chosen]))


def scored(docs: DataFrame, net: ByteConvNet, name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1, higher: better) of its whole texts; null texts count as empty."""
    schema = docs.select(*docs.columns).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            raw, at = utf8(batch.column(batch.schema.get_field_index("text")))
            parts = [net.score(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(at, SLICE)]
            out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= PASS_SCORE) of each row of ``docs`` (doc_id, text).

    Empty texts get the score of a document without bytes, and null ones too; texts of any length are read
    whole, piece by piece, and an empty table gives an empty result.  Rows are scored one by one; repeated rows
    get equal scores.  A null doc_id is not held out.  Labels are only used in :func:`train`.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, sample))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return scored(docs, train(docs, labels, sample), "__score").where(F.col("__score") >= PASS_SCORE).drop("__score")
