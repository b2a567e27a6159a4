"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from its byte-class and
class-bigram frequencies and its word repetition; gated attention weighs the encoded
passages, and the weighted representation gives the score. Encoder, attention and output are
learned together from document labels alone.

Texts of any length are read in parts of ``PART`` bytes at most, each with what its last word and last pair of bytes
need of the next one, and the attention's sums run over all parts of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, blocks, crc_mod, narrow
from .words import BLANK, Words

PASSAGE = 512
#: Bytes that are encoded at a time; a multiple of PASSAGE.
PART = 1 << 18
_SINGLE = b" \n.,;:!?&$*%#|-_/\\<>()[]{}'\"@=+~^`"
CLASSES = 6 + len(_SINGLE)
EXTRA = 4
FEATURES = CLASSES + CLASSES * CLASSES + EXTRA


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.int64)  # other control bytes
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[0x80:0xC0] = 3
    table[0xC0:] = 4
    for i, b in enumerate(_SINGLE):
        table[b] = 6 + i
    return table


_TABLE = _class_table()


class Part(NamedTuple):
    """``size`` bytes of a text from a passage's beginning on, and ``data``: these and the rest of the last word."""

    text: int
    data: bytes
    size: int
    within: bool  # whether it begins within a word


def parts(texts: list[bytes], part: int | None = None) -> Iterator[list[Part]]:
    """The texts in parts of PART bytes at most, about as many bytes at a time. An empty text is one empty part."""
    most = part or PART
    group, n = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw)), most):
            end = min(at + most, len(raw))
            found = BLANK.search(raw, end)
            stop = max(found.start() if found else len(raw), min(end + 1, len(raw)))
            group.append(Part(i, raw[at:stop], end - at, at > 0 and not BLANK.match(raw, at - 1)))
            n += end - at
            if n >= most:
                yield group
                group, n = [], 0
    if group:
        yield group


def encoded(group: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) of parts of texts and the text of each passage. An empty part is one passage
    of zeros. A pair of bytes belongs to the passage of its first byte, a word to that of its beginning."""
    words = Words([g.data for g in group], places=True)
    data = np.frombuffer(words.data, np.uint8)
    given = np.fromiter((len(g.data) for g in group), np.int64, len(group))
    sizes = np.fromiter((g.size for g in group), np.int64, len(group))
    per = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.fromiter((g.text for g in group), np.int64, len(group)), per)
    base = np.cumsum(per) - per
    offset = np.cumsum(given + 1) - given - 1
    doc = np.repeat(np.arange(len(group)), given + 1)
    place = np.arange(len(data)) - offset[doc]
    own = place < sizes[doc]
    passage = base[doc] + np.minimum(place, np.maximum(sizes[doc] - 1, 0)) // PASSAGE
    kind = _TABLE[data]
    n = len(owner)
    one = np.bincount(passage[own] * CLASSES + kind[own], minlength=n * CLASSES).reshape(n, CLASSES)
    pair = own[:-1] & (place[:-1] + 1 < given[doc[:-1]])
    two = np.bincount(
        passage[:-1][pair] * (CLASSES * CLASSES) + kind[:-1][pair] * CLASSES + kind[1:][pair], minlength=n * CLASSES * CLASSES
    ).reshape(n, CLASSES * CLASSES)
    extra = np.zeros((n, EXTRA), np.float32)
    cut = np.fromiter((g.within for g in group), bool, len(group))
    begun = own[words.starts] & ~((place[words.starts] == 0) & cut[doc[words.starts]])
    if begun.any():
        starts, hashes = words.starts[begun], words.hashes[begun]
        at = passage[starts]
        count = np.maximum(np.bincount(at, minlength=n), 1)
        order = np.lexsort((hashes, at))
        h, p = hashes[order], at[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        extra[:, 0] = np.bincount(p, again, n) / count
        next_ = np.zeros(len(at), bool)
        next_[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
        extra[:, 1] = np.bincount(at, next_, n) / count
        extra[:, 2] = np.minimum(np.bincount(at, words.ends[begun] - starts, n) / count / 16, 4)
    extra[:, 3] = np.minimum(np.bincount(passage[own], minlength=n) / PASSAGE, 1)
    total = np.maximum(one.sum(axis=1, keepdims=True), 1).astype(np.float32)
    shares = (np.sqrt(x.astype(np.float32) / total) for x in (one, two))
    return np.concatenate([*shares, extra], axis=1), owner


def passages(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts and the text of each passage."""
    done = [encoded(g) for g in parts([t if isinstance(t, bytes) else t.encode() for t in texts])]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


class Mil:
    """Encoder tanh(XE+e), gate tanh(HV)*sigmoid(HU), attention softmax within the bag, linear output."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": draw(FEATURES, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        """Of the passages ``x`` of the bags 0, 1, ... in ``owner``, which is sorted."""
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = np.clip((v * u) @ p["w"], -30, 30)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        e = np.exp(s)
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "u": u, "e": e, "a": a, "z": z, "starts": starts, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One score for each text. Only the attention's sums are held for a text, not its passages."""
        top, total = np.zeros((len(texts), len(self.p["c"]))), np.zeros(len(texts))
        for group in parts(texts):
            x, owner = encoded(group)
            # In 64 bits, so that equal passages have equal values wherever they stand in a matrix.
            f = self.forward(x.astype(np.float64), owner - owner[0])
            which, weight = owner[f["starts"]], np.add.reduceat(f["e"].astype(np.float64), f["starts"])
            total[which] += weight
            top[which] += weight[:, None] * f["z"]
        return np.round(1 / (1 + np.exp(-np.clip((top / total[:, None]) @ self.p["c"] + self.p["d"], -30, 30))), 9)

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags' labels ``y`` by each parameter."""
        p, f = self.p, self.forward(x, owner)
        h, v, u, a = f["h"], f["v"], f["u"], f["a"]
        err = ((f["score"] - y) / len(y)).astype(x.dtype)
        dz = err[:, None] * p["c"]
        into = np.einsum("ij,ij->i", dz[owner], h)
        ds = a * (into - np.add.reduceat(a * into, f["starts"])[owner])
        dg = ds[:, None] * p["w"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        dh = (a[:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": f["z"].T @ err, "d": err.sum(keepdims=True)}

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, columns: np.ndarray | None = None, steps: int = 250, rate: float = 0.01, decay: float = 1e-3) -> Mil:
        """Learn from passages ``x`` of the bags in ``owner``. With ``columns``, ``x`` has only these
        features; the others are zero in every passage, so their weights just decay."""
        p, encoder = self.p, self.p["E"]
        if columns is not None:
            p["E"] = encoder[columns]
        m = {k: [np.zeros_like(w), np.zeros_like(w)] for k, w in p.items()}
        for step in range(1, steps + 1):
            for k, g in self.gradients(x, owner, y).items():
                m[k][0] = 0.9 * m[k][0] + 0.1 * g
                m[k][1] = 0.999 * m[k][1] + 0.001 * g * g
                p[k] -= (rate * (m[k][0] / (1 - 0.9**step) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8) + decay * p[k])).astype(np.float32)
        if columns is not None:
            learned, p["E"] = p["E"], encoder * np.float32((1 - rate * decay) ** steps)
            p["E"][columns] = learned
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, bag: int = 32, id_col: str = "doc_id", text_col: str = "text") -> Mil:
    """A model from at most ``sample`` labelled documents, those with the least hash of the id among
    rows whose crc32(id as text) mod 5 is not 0. An id labelled twice counts once, by its lower label. Of a text of more
    than ``bag`` passages the sample has as many, evenly spaced, so the driver gets ``sample`` x ``bag`` passages at most."""
    rows = labels.where(F.col("quality").isNotNull() & ~crc_mod("doc_id", 5).isin(0, -1))
    rows = rows.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("y"))
    rows = rows.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(sample)
    picked = narrow(docs, id_col, text_col).join(F.broadcast(rows), F.col("doc_id") == F.col("id")).select("id", "y", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            made: tuple[list, ...] = ([], [], [], [])
            for text in block.column("text").to_pylist():
                size = max(1, -(-len(raw := text.encode()) // PASSAGE))
                spaced = np.unique(np.arange(bag) * size // bag) if size > bag else np.arange(size)
                x, before = [], 0
                for group in parts([raw]):
                    some = encoded(group)[0]
                    x.append(some[spaced[(spaced >= before) & (spaced < before + len(some))] - before])
                    before += len(some)
                x = np.concatenate(x)
                passage, column = np.nonzero(x)
                for to, v in zip(made, (len(x), passage.astype(np.uint32).tobytes(), column.astype(np.uint16).tobytes(), x[passage, column].astype(np.float16).tobytes()), strict=True):
                    to.append(v)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("y"), *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=["id", "y", "n", "nth", "column", "value"])

    found = picked.mapInArrow(encode, "id long, y int, n int, nth binary, column binary, value binary")
    got = sorted(found.collect(), key=lambda r: (r["id"], r["column"], r["value"]))
    model = Mil()
    if not got:
        return model
    sizes = np.array([r["n"] for r in got])
    first = np.cumsum(sizes) - sizes
    passage = np.concatenate([np.frombuffer(r["nth"], np.uint32) + at for r, at in zip(got, first, strict=True)])
    columns, place = np.unique(np.concatenate([np.frombuffer(r["column"], np.uint16) for r in got]), return_inverse=True)
    x = np.zeros((sizes.sum(), len(columns)), np.float32)
    x[passage, place] = np.concatenate([np.frombuffer(r["value"], np.float16) for r in got])
    return model.fit(x, np.repeat(np.arange(len(got)), sizes), np.array([r["y"] for r in got], np.float32), columns.astype(np.int64))


def score(docs: DataFrame, model: Mil, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where label 1 is likelier. Null and empty texts are
    scored as a bag of one empty passage. Attention sums run over all passages of a text of any length."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.scores([t.encode() for t in texts.to_pylist()]))]

    return append(docs, {name: pa.float64()}, compute, text_col)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Only texts enter a score; a
    null id is not held out and never learned from; repeated rows stay; an empty table gives an empty result, and
    without any label the scores are those of an unlearned model."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return score(narrow(docs, id_col, text_col), model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
