"""Language identification with a linear-chain conditional random field over words.

Each word gets a label score from hashed affixes and character n-grams (n-grams that reach the
word's edge are affixes) and from the word itself (lexicon); labels of neighbouring words are tied by
learned transitions. Forward-backward gives each word's label probabilities, so code-switched
texts are labelled word by word; a text's language is the label with the largest
expected number of words.

A text is one chain, however long. It is worked on in pieces of ``CHAIN`` words, many pieces side by side: each
piece is reduced to one matrix, these carry the forward and backward messages from piece to piece, and then
every piece is settled with the messages at its two ends. The result is that of one pass over the whole chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, crc_mod, narrow
from .words import U, mix, pieces

CHAIN = 64
#: Pieces that are settled at a time, and bytes of a text that are cut into words at a time.
SLICE, CUT = 1024, 1 << 20
#: Bytes of words whose features are made at a time.
FEATURED = 1 << 19
TABLE = 1 << 17
UNDETERMINED = "und"
_NOT_LETTERS = "[^\\pL\\pM]+"


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (TABLE, labels)
    transitions: np.ndarray  # (labels, labels), from row to column


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of letters, lower-cased) of the texts, and how many each text has."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), _NOT_LETTERS)
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    parent = pc.list_parent_indices(parts).filter(some)
    return flat.filter(some), np.bincount(parent.to_numpy(), minlength=len(texts))


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words: (indices, the word of each)."""
    data = np.frombuffer(("".join(f"\x02{w}\x03\x00\x00" for w in words.to_pylist())).encode() + b"\x00", np.uint8)
    starts = np.flatnonzero(data == 2)
    owner = np.cumsum(data == 2) - 1
    x = data.astype(U)
    at, who = [], []
    code = x[:-1] * U(256) + x[1:]
    for n in (2, 3, 4):
        if n > 2:
            code = code[:-1] * U(256) + x[n - 1 :]
        inside = np.flatnonzero((data[n - 1 :] != 0) & (data[: len(data) - n + 1] != 0) & (owner[n - 1 :] == owner[: len(data) - n + 1]))
        at.append(mix(code[inside] * U(8) + U(n)))
        who.append(owner[inside])
    powers = np.cumprod(np.full(max(1, int(np.diff(np.append(starts, len(data))).max(initial=1))), 0x9E3779B97F4A7C15 | 1, U))
    if len(starts):
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        at.append(mix(np.add.reduceat(mix(x + U(1)) * (data > 3) * powers[place], starts) * U(8) + U(1)))
        who.append(np.arange(len(starts)))
    return (np.concatenate(at) % U(TABLE)).astype(np.int64), np.concatenate(who)


def _scores(index: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(owner, weights[index, k], n) for k in range(weights.shape[1])], axis=1)


def _long_word(word: bytes, weights: np.ndarray) -> np.ndarray:
    """Label scores of one word of any length, a span at a time."""
    seen, total = np.zeros(TABLE, np.int64), U(0)
    data = np.frombuffer(b"\x02" + word + b"\x03", np.uint8)
    base = 0x9E3779B97F4A7C15 | 1
    powers = np.cumprod(np.full(FEATURED, base, U))
    for i in range(0, len(data), FEATURED):
        x = data[i : i + FEATURED + 3].astype(U)
        code = x
        for n in (2, 3, 4):
            code = code[: len(x) - n + 1] * U(256) + x[n - 1 :]
            seen += np.bincount((mix(code[:FEATURED] * U(8) + U(n)) % U(TABLE)).astype(np.int64), minlength=TABLE)
        x = x[:FEATURED]
        total += (mix(x + U(1)) * (x > 3) * powers[: len(x)]).sum(dtype=U) * U(pow(base, i, 1 << 64))
    seen[int(mix(np.array([total]) * U(8) + U(1))[0] % U(TABLE))] += 1
    return seen @ weights.astype(np.float64)


def word_scores(words: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Label scores of distinct words. Features are made for FEATURED bytes of words at a time, and longer words are
    read in spans, so that no table grows with a text."""
    out = np.zeros((len(words), weights.shape[1]))
    total = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64))
    at = 0
    while at < len(words):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + FEATURED, side="right")))
        if total[end - 1] - before > FEATURED:
            out[at] = _long_word(words[at].as_py().encode(), weights)
        else:
            index, owner = features(words.slice(at, end - at))
            out[at:end] = _scores(index, owner, end - at, weights)
        at = end
    return out


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, size and text of the pieces of CHAIN words that the texts are cut into."""
    per = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(counts) - counts)[text] + nth * CHAIN, np.minimum(CHAIN, counts[text] - nth * CHAIN), text


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Index of the word at each (place, piece), -1 beyond a piece's end."""
    place = np.arange(CHAIN)[:, None]
    return np.where(place < size, start + place, -1)


def _scaled(x: np.ndarray, axis) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def forward_backward(emit: np.ndarray, valid: np.ndarray, transitions: np.ndarray, entry: np.ndarray | None = None, leave: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities (place, chain, label) and, with ``count``, the expected transition counts. Where chains are pieces of longer
    ones, ``entry`` is the forward message that comes to their first words, ``leave`` the backward message at their last."""
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = _scaled(e[0] if entry is None else e[0] * entry, 1)
    for t in range(1, len(e)):
        alpha[t] = _scaled((alpha[t - 1] @ a) * e[t], 1)
    end = np.ones_like(e[0]) if leave is None else leave
    beta[-1] = end
    for t in range(len(e) - 2, -1, -1):
        beta[t] = np.where(valid[t + 1][:, None], _scaled((e[t + 1] * beta[t + 1]) @ a.T, 1), end)
    p = _scaled(alpha * beta, 2)
    if not count:
        return p, None
    right = e[1:] * beta[1:]
    z = np.einsum("tsi,ij,tsj->ts", alpha[:-1], a, right)
    pairs = np.einsum("tsi,tsj->ij", alpha[:-1] * (valid[1:] / z)[..., None], right) * a
    return p, pairs


def _reduced(emit: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """(piece, label, label): weight of all paths from each first word's label to each last word's, up to a factor."""
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(transitions)
    out = e[0][:, :, None] * np.eye(len(a))
    for t in range(1, len(e)):
        out = np.where(valid[t][:, None, None], _scaled((out @ a) * e[t][:, None, :], (1, 2)), out)
    return out


def _messages(reduced: np.ndarray, text: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward message into, and backward message at the end of, each piece of each text."""
    a = np.exp(transitions)
    entry, leave = np.ones((len(text), len(a))), np.ones((len(text), len(a)))
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.diff(np.append(begin, len(text)))
    most = int(size.max(initial=0))
    for k in range(1, most):
        at = begin[size > k] + k
        entry[at] = _scaled(np.einsum("si,sij->sj", entry[at - 1], reduced[at - 1]) @ a, 1)
    for k in range(most - 2, -1, -1):
        at = begin[size > k + 1] + k
        leave[at] = _scaled(np.einsum("sij,sj->si", reduced[at + 1], leave[at + 1]) @ a.T, 1)
    return entry, leave


def _coded(model: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of every word, label scores by code, each text's number of words. A lone long text is cut
    into words CUT bytes at a time."""
    if len(texts) == 1:
        raw = texts[0].as_py().encode()
        groups = [pa.array([raw[i:j].decode()]) for i, j in pieces(raw, CUT)]
    else:
        groups = [texts]
    codes, tables, counts, n = [np.zeros(0, np.int32)], [np.zeros((0, len(model.labels)))], np.zeros(len(texts), np.int64), 0
    for group in groups:
        words, sizes = split_words(group)
        coded = words.dictionary_encode()
        codes.append(coded.indices.to_numpy() + np.int32(n))
        tables.append(word_scores(coded.dictionary, model.weights))
        counts += sizes
        n += len(coded.dictionary)
    return np.concatenate(codes), np.concatenate(tables), counts


def _settled(model: Crf, texts: pa.Array) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Each text's number of words; and (words, texts, label probabilities) of all words, slice by slice."""
    code, scores, counts = _coded(model, texts)
    start, size, text = _chains(counts)

    def emitted(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = _places(start[some], size[some])
        valid = at >= 0
        return at, valid, scores[code[np.where(valid, at, 0)]] * valid[..., None]

    def slices(which: np.ndarray) -> Iterator[np.ndarray]:
        return (which[i : i + SLICE] for i in range(0, len(which), SLICE))

    def run() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        reduced = np.ones((len(text), len(model.labels), len(model.labels)))
        for some in slices(np.flatnonzero(counts[text] > CHAIN)):
            _, valid, emit = emitted(some)
            reduced[some] = _reduced(emit, valid, model.transitions)
        entry, leave = _messages(reduced, text, model.transitions)
        for some in slices(np.arange(len(text))):
            at, valid, emit = emitted(some)
            p, _ = forward_backward(emit, valid, model.transitions, entry[some], leave[some], count=False)
            yield at[valid], np.broadcast_to(text[some], valid.shape)[valid], p[valid]

    return counts, run()


def label_words(model: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word of the texts, and each text's number of words."""
    counts, settled = _settled(model, texts)
    out = np.zeros((int(counts.sum()), len(model.labels)))
    for at, _, p in settled:
        out[at] = p
    return out, counts


def label_shares(model: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's expected share of words of each label, and its number of words."""
    counts, settled = _settled(model, texts)
    out = np.zeros((len(texts), len(model.labels)))
    for _, text, p in settled:
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(text, p[:, j], len(texts))
    return out / np.maximum(counts, 1)[:, None], counts


def fit(texts: list[str], langs: list[str], epochs: int = 3, rate: float = 0.3, seed: int = 5) -> Crf:
    """A model from labelled texts, by adaptive gradient steps on the chains' log-likelihood.

    Half of the chains are a text's own words; half are joined from runs of 16 words
    of different texts, so that transitions between languages are learned too.
    """
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    k = max(1, len(labels))
    weights, transitions = np.zeros((TABLE, k)), np.zeros((k, k))
    words, counts = split_words(pa.array(texts, pa.string()))
    if not len(words):
        return Crf(labels, weights.astype(np.float32), transitions)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    gold = np.repeat(np.array([labels.index(x) for x in langs]), counts)
    index, owner = features(coded.dictionary)
    bounds = np.searchsorted(np.sort(owner), np.arange(len(coded.dictionary) + 1))
    index = index[np.argsort(owner, kind="stable")]
    own = _places(*_chains(counts)[:2])
    runs = own.reshape(CHAIN // 16, 16, -1).transpose(0, 2, 1).reshape(-1, 16)
    runs = runs[(runs >= 0).all(axis=1)]
    mixed = rng.permutation(runs)[: len(runs) // (CHAIN // 16) * (CHAIN // 16)].reshape(-1, CHAIN).T
    chains = np.concatenate([own, mixed], axis=1)
    seen_w, seen_t = np.full((TABLE, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(chains.shape[1])
        for b in range(0, len(order), 256):
            at = chains[:, order[b : b + 256]]
            valid = at >= 0
            at0 = np.where(valid, at, 0)
            used, code = np.unique(codes[at0], return_inverse=True)
            code = code.reshape(at0.shape)
            size = bounds[used + 1] - bounds[used]
            flat = np.repeat(bounds[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            idx, own_ = index[flat], np.repeat(np.arange(len(used)), size)
            emit = _scores(idx, own_, len(used), weights)[code] * valid[..., None]
            p, pairs = forward_backward(emit, valid, transitions)
            y = gold[at0]
            grad = -p
            np.put_along_axis(grad, y[..., None], np.take_along_axis(grad, y[..., None], 2) + 1, 2)
            grad *= valid[..., None]
            both = valid[1:]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][both], y[1:][both]), 1)
            n = valid.sum()
            for j in range(k):
                by_word = np.bincount(code.ravel(), grad[..., j].ravel(), len(used))
                g = np.bincount(idx, by_word[own_], TABLE) / n - 1e-7 * weights[:, j]
                seen_w[:, j] += g * g
                weights[:, j] += rate * g / np.sqrt(seen_w[:, j])
            g = (seen - pairs) / n
            seen_t += g * g
            transitions += rate * g / np.sqrt(seen_t)
    return Crf(labels, weights.astype(np.float32), transitions)


def train(docs: DataFrame, per_label: int = 400, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """A model from a sample of about ``per_label`` labelled documents of each language, drawn by a
    hash of the id among those whose crc32(id as text) mod 3 is not 1. Of a text of over ``longest`` characters the
    sample has as many from a place drawn likewise, so the driver gets ``per_label`` x ``longest`` of each language at most."""
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & ~crc_mod(id_col, 3).isin(1, -1))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(f"`{lang_col}`").alias("lang")).count().collect()}
    if not sizes:
        return Crf([], np.zeros((TABLE, 1), np.float32), np.zeros((1, 1)))
    part = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_label / n) * 1e6))))
    draw = lambda what, n: F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(what)), n)
    drawn = draw("language", F.lit(1_000_000)) < part[F.col(f"`{lang_col}`")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spare = F.length(text) - longest
    text = F.when(spare > 0, F.substring(text, (draw("place", F.greatest(spare, F.lit(1))) + 1).cast("int"), F.lit(longest))).otherwise(text)
    sample = known.where(drawn).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = sorted(sample.collect(), key=lambda r: (r["id"], r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Crf, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share of the text's words, 0 to 1.

    A text without letters (null and empty ones too) is ``und`` with score 0, and so is every text
    if the model knows no language. Ties go to the alphabetically first language. Texts of any length are handled
    alike; repeated rows and null ids stay as they are; an empty table gives an empty result.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        if not model.labels:
            return [pa.array([UNDETERMINED] * len(texts)), pa.array(np.zeros(len(texts)))]
        share, counts = label_shares(model, texts)
        best = share.argmax(axis=1)
        names = [model.labels[b] if c else UNDETERMINED for b, c in zip(best, counts, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.clip(share.max(axis=1), 0.0, 1.0))]

    return append(docs, {lang: pa.string(), score: pa.float64()}, compute, text_col)


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Ids and languages never enter a
    prediction; a null id is not held out and never learned from."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return identify(narrow(docs, id_col, text_col), model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )
