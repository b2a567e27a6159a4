"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words (a lone word by itself), weighted by how often they occur. For
each of ``SAMPLES`` samples every term draws r and c from Gamma(2, 1) and b from [0, 1), by its
hash alone; the term with the least ln c - r (t - b) - r, where t = floor(ln(weight) / r + b), is
sampled together with t. Two texts draw the same (term, t) with the probability of their
generalised Jaccard similarity, sum of the lesser weights over sum of the greater.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, share
from .substring import NO_ID
from .words import U, Words, mix

SAMPLES = 64
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 1 << 63, SAMPLES, dtype=U) * U(2) + U(1)
_FLIP = _RNG.integers(0, 1 << 63, SAMPLES, dtype=U)


def _gamma_table() -> np.ndarray:
    """65536 quantiles of Gamma(2, 1), by bisection of its distribution function 1 - (1 + x) e^-x."""
    q = (np.arange(65536) + 0.5) / 65536
    lo, hi = np.zeros(65536), np.full(65536, 64.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return lo


_R = _gamma_table().astype(np.float32)
_LN_C = np.log(_gamma_table()).astype(np.float32)
_B = (np.arange(65536, dtype=np.float32) + np.float32(0.5)) / np.float32(65536)


#: Terms of a block that are sampled at a time: more are dealt by their hash into as many shares as needed.
TERMS = 1 << 19


def weighted_terms(words: Words, share_: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, weight) of every distinct term of every text, in order of text; of one share of the terms."""
    alone = np.flatnonzero(words.counts == 1)
    terms, owners = [words.hashes[words.first[alone]]], [alone]
    for term, at in words.chunks(2):
        owners.append(np.searchsorted(words.first, at, side="right") - 1)
        terms.append(term)
        if shares > 1:
            own = (term >> U(40)) % U(shares) == share_
            terms[-1], owners[-1] = term[own], owners[-1][own]
    if shares > 1:
        own = (terms[0] >> U(40)) % U(shares) == share_
        terms[0], owners[0] = terms[0][own], owners[0][own]
    term, owner = np.concatenate(terms), np.concatenate(owners)
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    return owner[begin], term[begin], np.diff(np.append(begin, len(term)))


def fingerprints(texts: list[bytes], terms: int = TERMS) -> np.ndarray:
    """(texts, SAMPLES) 16-bit samples; all zero for a text without words."""
    words = Words(texts)
    least = np.full((len(texts), SAMPLES), U(0xFFFFFFFFFFFFFFFF))
    shares = max(1, -(-len(words.hashes) // terms))
    for share_ in range(shares):
        owner, term, weight = weighted_terms(words, share_, shares)
        if len(owner):
            _sample(owner, term, weight, least)
    samples = mix((least & _LOW) + np.arange(SAMPLES, dtype=U) * U(0xD6E8FEB86659FD93)).astype(np.uint16)
    samples[words.counts == 0] = 0
    return samples


_LOW = U(0xFFFFFFFF)


def _sample(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, least: np.ndarray) -> None:
    """Lower the least key of each text and sample by these terms. A key has the value to be least in its upper half, raised
    above zero so that it orders like an integer, and below what is sampled: term and t."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    rows = owner[starts]
    many = np.flatnonzero(weight > 1)
    ln_w, sampled = np.log(weight[many]).astype(np.float32), term >> U(32)
    for k in range(SAMPLES):
        x = (term ^ _FLIP[k]) * _MULTIPLY[k]
        x ^= x >> U(29)
        drawn = x.view(np.uint16).reshape(-1, 4)
        r, b, ln_c = _R[drawn[:, 0]], _B[drawn[:, 1]], _LN_C[drawn[:, 3]]
        a = ln_c - r * (1 - b)  # t is 0 where the weight is 1
        low = sampled
        if len(many):
            t = np.floor(ln_w / r[many] + b[many])
            a[many] = ln_c[many] - r[many] * (t - b[many]) - r[many]
            low = sampled.copy()
            low[many] = (sampled[many] + t.astype(U) * U(0x9E3779B1)) & _LOW
        key = ((a + np.float32(64)).view(np.uint32).astype(U) << U(32)) | low
        least[rows, k] = np.minimum(least[rows, k], np.minimum.reduceat(key, starts))


def in_groups(texts: list[str], limit: int = 1 << 20) -> np.ndarray:
    """Fingerprints of texts, about ``limit`` bytes of them at a time."""
    done, group, size = [np.zeros((0, SAMPLES), np.uint16)], [], 0
    for text in texts:
        raw = text.encode()
        if group and size + len(raw) > limit:
            done.append(fingerprints(group))
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        done.append(fingerprints(group))
    return np.concatenate(done)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def edit(text: str, following: str) -> str:
    """The last half (rounded down) of a text's code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, id, text) in order: each row that is not ahead is paired with the next row of
    its part; one with ahead null, which come first, with itself. Only one row is held over from block to block."""
    held = None
    for block in blocks(batches):
        seq, now, then, ids = [], [], [], []
        if held is not None:
            seq.append(held[2])
        for part, ahead, id_, text in zip(*(block.column(c).to_pylist() for c in ("part", "ahead", "id", "text")), strict=True):
            if held is None and ahead:
                continue
            seq.append(text)
            if ahead is None:
                now.append(len(seq) - 1)
                then.append(len(seq) - 1)
                ids.append(id_)
                continue
            if held is not None:
                if held[0] != part:
                    raise ValueError("a part ends without the document after it")
                now.append(len(seq) - 2)
                then.append(len(seq) - 1)
                ids.append(held[1])
            held = None if ahead else (part, id_, text)
        if not now:
            continue
        edited = [edit(seq[i], seq[j]) for i, j in zip(now, then, strict=True)]
        prints = in_groups([*seq, *edited])
        own, next_, other = prints[now], prints[then], prints[len(seq) :]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(seq[i]) for i in now], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array([p.tobytes() for p in own.astype(">u2")], pa.binary()),
                pa.array([p.tobytes() for p in other.astype(">u2")], pa.binary()),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, next_)),
            ],
            names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
    if held is not None:
        raise ValueError("a part ends without the document after it")


def _mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tie, text) with ``again``: an equal row came before within the block."""
    for block in blocks(batches):
        seen, again = set(), []
        for row in zip(block.column("id").to_pylist(), block.column("text").to_pylist(), strict=True):
            again.append(row in seen)
            seen.add(row)
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(again, pa.bool_())], names=[*block.schema.names, "again"])


def _bounds(texts: DataFrame, parts: int) -> tuple[list[tuple[int, int | None]], bool]:
    """First (id, tie) of each range, in order, and whether an id has several ranges. The tie is null where a range begins
    with all rows of its id. An id that fills several ranges has as many equal shares of the ties, each beginning at a tie that
    occurs. There are as many bounds as ranges at most, and nothing else reaches the driver."""
    asked = [i / parts for i in range(parts)]
    found = texts.agg(F.min("id"), F.percentile_approx("id", asked, max(10_000, 10 * parts))).first()
    if found[0] is None:
        return [(0, None)], False
    times = Counter(found[1])
    hot = {i: n for i, n in times.items() if n > 1}
    bounds = [(i, None) for i in {found[0], *times} - set(hot)]
    if hot:
        few = texts.sparkSession.createDataFrame(list(hot.items()), "id long, n long")
        some = texts.join(F.broadcast(few), "id")
        # The upper half of the ties' bits, as a number from 0 on, falls into n equal shares.
        slot = F.shiftright(F.col("n") * (F.shiftright("tie", 32) + (1 << 31)), 32)
        bounds += [(r["id"], r["tie"]) for r in some.groupBy("id", slot.alias("slot")).agg(F.min("tie").alias("tie")).collect()]
    return sorted(bounds, key=lambda b: (b[0], b[1] or 0)), bool(hot)


def ordered_parts(texts: DataFrame, rows_each: int = 4000) -> DataFrame:
    """(part, ahead, id, text): rows dealt by ranges of (id, a hash of the text), each range followed by the first rows
    of the next one (the last by the first of all), marked ``ahead``. Ranges begin at values that occur, so a
    row at a beginning is known by its values alone. Where an id fills several ranges, rows equal to an earlier one of
    their block have ahead null: each is followed by itself, so they may lie in any part."""
    texts = texts.select("id", F.xxhash64("text").alias("tie"), "text")
    bounds, hot = _bounds(texts, min(share(texts.count(), rows_each), 10_000))
    ids, at = np.unique(np.array([b[0] for b in bounds], np.int64), return_index=True)
    ends = np.append(at[1:], len(bounds))
    first_tie = {int(i): np.array([b[1] for b in bounds[a:e]], np.int64) for i, a, e in zip(ids, at, ends, strict=True) if bounds[a][1] is not None}

    @F.pandas_udf("long")
    def place(id_: pd.Series, tie: pd.Series) -> pd.Series:
        values, ties = id_.to_numpy(), tie.to_numpy()
        k = np.searchsorted(ids, values, side="right") - 1
        begins, part = ids[k] == values, ends[k] - 1
        for i in np.unique(values[begins]):
            if int(i) in first_tie:
                own, shares = values == i, first_tie[int(i)]
                among = np.searchsorted(shares, ties[own], side="right") - 1
                part[own] = at[k[own]] + among
                begins[own] = shares[among] == ties[own]
        return pd.Series(2 * part + begins)

    if hot:
        texts = texts.mapInArrow(_mark_repeats, "id long, tie long, text string, again boolean")
    else:
        texts = texts.withColumn("again", F.lit(False))
    part = F.expr("at div 2")
    here = F.struct(part.alias("part"), F.when(~F.col("again"), F.lit(False)).alias("ahead"))
    before = F.struct(F.pmod(part - 1, F.lit(len(bounds))).cast("long").alias("part"), F.lit(True).alias("ahead"))
    apart = F.struct(F.pmod(F.monotonically_increasing_id(), F.lit(len(bounds))).cast("long").alias("part"), F.lit(None).cast("boolean").alias("ahead"))
    dealt = texts.withColumns({"at": place("id", "tie"), "apart": apart})
    copies = F.when(F.col("again"), F.array("apart")).when(F.col("at") % 2 == 1, F.array(here, before)).otherwise(F.array(here))
    dealt = dealt.withColumn("p", F.explode(copies)).select("p.part", "p.ahead", "id", "tie", "text")
    return dealt.repartition(len(bounds), "part").sortWithinPartitions("part", "ahead", "id", "tie", "text").drop("tie")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited (the edited text), fingerprint and
    edited_fingerprint (128 bytes each), near_edited, near_next.

    The next document is the one of next greater doc_id, equal ids in order of a hash of the text, rows that repeat both
    one after another; the first follows the last, so a lone document follows itself. Null ids come before all others and
    stay null. An id that very many rows have, or null, is spread over as many ranges as it fills. Rows that repeat within a
    block are spread by their place in ``docs``, which should thus be read from files. A null text is empty; a text without words has the fingerprint of zeros; texts of any length are handled
    alike. Extra columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    out = ordered_parts(texts).mapInArrow(
        _pairs,
        "id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double",
    )
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *out.columns[1:])
