"""Training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import json
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, chat, fingerprint, html, langid, media, neardup, packing, quality, substring
from waymark.llm.components import components
from waymark.llm.dom import parse

tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
RNG = random.Random(3)
WORDS = ["the", "Of", "and", "ridge", "été", "straße", "niño", "x", "river", "42", "日本", "<|endoftext|>", "it's", "&amp;"]


def words(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "a", "b", "c"]) for _ in range(n))


BASE = words(120)
TEXTS = [
    None, "", "   ", "one", "one two three four", words(60), BASE, BASE, BASE.upper(), BASE + " more", "  " + BASE.replace(" ", "\n", 3),
    words(30) + " " + " ".join(BASE.split()[10:70]) + " " + words(20), "again " * 90, words(3000), "a  b \n c\n\n d <|endoftext|> e", "z" * 5000, words(40) + " " + words(40),
]


def frame(spark, texts=TEXTS, clash=True):
    """Rows with null and repeated ids, and columns whose names operators use themselves."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three four five six"), (5, texts[5] if len(texts) > 5 else "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("?"), "key": F.lit(1), "n": F.lit(2), "start": F.lit(0), "part": F.lit(1)}) if clash else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# Packing


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers.path(name))


def test_packing_whole(spark):
    t = library("byte_bpe_50k.json")
    pieces = packing.token_pieces(frame(spark), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, window=64)
    packed = packing.pack(pieces, 20, window=64, group_rows=10).toPandas()
    for i, text in enumerate(TEXTS):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = packed[packed.doc_id == i].drop_duplicates(["start"]).sort_values("start")
        got = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert got == want and (own.doc_tokens == len(want)).all() and (own.length == own.ids.map(len) // 4).all()
    for _, seq in packed.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.values == np.concatenate([[0], np.cumsum(seq.length)[:-1]])).all() and seq.length.sum() <= 64


def test_best_fit_takes_tightest(spark):
    lengths = np.array([60, 50, 30, 14, 10, 4, 20, 64])
    sequence, offset = packing.best_fit_decreasing(lengths, 64)
    free, used = {0: 0}, 1  # sequence 0 is the full piece
    for i in [i for i in np.argsort(-lengths, kind="stable").tolist() if lengths[i] < 64]:
        fits = [c for c in free.values() if c >= lengths[i]]
        if fits:
            assert free[int(sequence[i])] == min(fits) and offset[i] == 64 - min(fits)
        else:
            assert sequence[i] == used and offset[i] == 0
            free[used], used = 64, used + 1
        free[int(sequence[i])] -= int(lengths[i])
    tree = packing.OpenWindows(64)
    for c in (5, 9, 9, 40):
        tree.put(c, 100 + c)
    assert [tree.take(n) for n in (6, 6, 6, 6, 1)] == [(9, 109), (9, 109), (40, 140), None, (5, 105)]


def test_group_count_follows_pieces_of_long_texts(spark):
    from waymark.llm import queries

    docs = spark.createDataFrame([(1, "9 a" * 30_000), (2, None), (3, "")], "doc_id long, text string")
    pieces = packing.token_pieces(docs, queries._vocabulary("byte_bpe_50k.tiktoken"), queries._pattern()).count()
    assert 2 * docs.count() < pieces <= queries.most_pieces(docs)
    assert queries.most_pieces(docs.limit(0)) == 0


def test_groups_are_dealt_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """Many groups, null ids among them, in few tasks: each group is packed as if it were alone, and null ids spread over groups."""
    monkeypatch.setattr(packing, "TASKS", 3)
    rows = [(None if i % 3 == 0 else i, 0, 1 + i * 7 % 60, i) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, 2000, window=64, group_rows=50)
    assert packed.rdd.getNumPartitions() <= 3
    out = packed.toPandas()
    assert len(out) == 2000 and sorted(out.ids_crc32) == list(range(2000))
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.values == np.concatenate([[0], np.cumsum(seq.length)[:-1]])).all() and seq.length.sum() <= 64
    groups = out.sequence_id.values >> 32
    assert len(set(groups)) == 40 and len(set(groups[out.doc_id.isna()])) == 40
    for g in set(groups):
        own = out[groups == g].length.values
        assert len(set(out.sequence_id[groups == g])) == packing.best_fit_decreasing(own, 64)[0].max() + 1


def test_packing_empty(spark):
    pieces = packing.token_pieces(empty(spark), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    assert packing.pack(pieces, 0).count() == 0


# Near copies


def brute_components(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def variants(n, edits, rng):
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    rng = random.Random(1)
    texts = [*TEXTS, *variants(60, 14, rng), *variants(20, 4, rng)]
    want, sizes = brute_components(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def boilerplate(n, rng, own=60, common=60):
    shared = " ".join(f"c{rng.randrange(10**6)}" for _ in range(common))
    return [shared + " " + " ".join(f"o{rng.randrange(10**7)}" for _ in range(own)) for _ in range(n)]


@pytest.mark.parametrize("wide, few", [(256, 64), (2, 10**6), (2, 0)])
def test_near_duplicates_among_boilerplate(spark, monkeypatch, wide, few):
    """Boilerplate and chains of near copies: buckets that hold several components, by pairs or by prefixes."""
    monkeypatch.setattr(neardup, "WIDE", wide)
    monkeypatch.setattr(neardup, "FEW", few)
    rng = random.Random(21)
    texts = [*boilerplate(60, rng), *variants(40, 14, rng), *boilerplate(30, rng, own=20, common=100)]
    texts += [t.replace("o", "O", 3) + " tail" for t in texts[:15]]
    want, _ = brute_components(texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_hot_band_gives_linear_pairs(spark):
    """5,000 texts that share half of their words, in one bucket, each a component of its own."""
    n = 5000
    texts = spark.createDataFrame(list(enumerate(boilerplate(n, random.Random(22), own=30, common=30))), "doc_id long, text string")
    wide = texts.select(F.lit(1).cast("long").alias("band"), "doc_id", F.col("doc_id").alias("part"))
    bands, pairs = neardup.prefix_pairs(wide, texts)
    assert bands.count() == 1 and pairs.count() <= n


def test_prefixes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 10**6)
    rng = random.Random(23)
    texts = [*variants(50, 16, rng), *boilerplate(20, rng, own=8, common=60), "", "a b", "a b", *variants(9, 30, rng)]
    sets = neardup.shingle_sets([t.encode() for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = docs.select(F.lit(1).cast("long").alias("band"), "doc_id", F.col("doc_id").alias("part"))
    got = {tuple(r) for r in neardup.prefix_pairs(wide, docs)[1].collect()}
    links = 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                links += 1
                assert (i, j) in got
    assert links > 200


def test_recall_just_over_the_similarity(spark):
    """300 pairs of similarity 0.75 to 0.80, each linked with nothing else."""
    rng = random.Random(24)
    texts, want = [], []
    while len(want) < 300:
        one = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 300))]
        other = list(one)
        while True:
            other[rng.randrange(len(other))] = f"y{rng.randrange(10**6)}"
            pair = [" ".join(one), " ".join(other)]
            a, b = neardup.shingle_sets([t.encode() for t in pair])
            like = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            if like < 0.80:
                break
        if like >= 0.75:
            want.append(len(texts))
            texts += pair
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == got[i + 1] == i for i in want)


def test_near_duplicates_edges(spark):
    out = neardup.near_duplicates(frame(spark)).collect()
    assert len(out) == len(TEXTS) + 2 and sum(r.doc_id == 5 for r in out) == 2
    (null,) = [r for r in out if r.doc_id is None]
    assert null.component_id is None and null.kept
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_parity_bound_and_sketch():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([a[: 200 - k], rng.integers(0, 1 << 62, k).astype(np.uint64)])) for k in (0, 10, 20, 60)]
    bits = neardup.parity_bitmaps(sets)
    sketch = neardup.odd_sketches(neardup.min_hashes(sets))
    for j in range(1, 4):
        apart = len(np.setxor1d(sets[0], sets[j]))
        assert sum(int(x).bit_count() for x in (bits[0] ^ bits[j]).view(np.uint64)) <= apart
    near = [sum(int(x).bit_count() for x in (sketch[0] ^ sketch[j]).view(np.uint64)) for j in (1, 2, 3)]
    assert near[0] < near[2] and near[1] <= neardup.MOST_BITS


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}


# Repeated passages


def brute_kept(texts):
    all_words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in all_words for i in range(len(w) - 34))
    out = []
    for w in all_words:
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        out.append(b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode())
    return out


@pytest.mark.parametrize("hot_rows", [1, 4096])
def test_substring(spark, hot_rows):
    shared = words(60)
    texts = [*TEXTS, *(words(n) + " " + shared + " " + words(n + 3) for n in range(1, 9)), " ".join(["p q r"] * 30)]
    got = {r.doc_id: r for r in substring.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot_rows=hot_rows).collect()}
    want = brute_kept(texts)
    for i, t in enumerate(texts):
        n = len((t or "").encode().split())
        assert got[i].kept_text == want[i] and got[i].n_words == n and got[i].n_removed == n - len(want[i].split(" ") if want[i] else [])


def test_substring_edges(spark):
    out = substring.substring_dedup(frame(spark), carry=("score",)).collect()
    assert len(out) == len(TEXTS) + 2 and {r.score for r in out} == {"?"}
    assert [r.kept_text for r in out if r.doc_id is None] == ["one two three four five six"]
    assert all(r.n_removed == 60 for r in out if r.doc_id == 5)  # the row occurs twice
    assert substring.substring_dedup(empty(spark)).count() == 0


# Tokens


def test_bpe_equals_library(spark):
    t = library("word_bpe_49k.json")
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzétheinΣςİß’'0123½²  \n\t 　\x1c\x85.,!?-<|>日本한😀́̈"
    fuzz = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    fuzz += ["<|endoftext|>a<|startoftext|> B<|endoftext|>", "the" * 400, "it's we'LL I'd 'S", *(x or "" for x in TEXTS)]
    rows = bpe.encode_decode(spark.createDataFrame(list(enumerate(fuzz)), "doc_id long, text string"), tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == len(fuzz)
    for r in rows:
        want = t.encode(fuzz[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark):
    out = bpe.encode_decode(frame(spark), tokenizers.path("word_bpe_49k.json")).collect()
    assert len(out) == len(TEXTS) + 2 and {(r.n_tokens, r.decoded) for r in out if r.doc_id in (0, 1, 2)} == {(0, "")}
    assert bpe.encode_decode(empty(spark), tokenizers.path("word_bpe_49k.json")).count() == 0


def coded(coder, texts):
    """Per text: ids and decoded text, checked against the number of tokens."""
    count, ids, said = coder.block(pa.array(texts, pa.string()))
    out = [(np.frombuffer(i, "<u4").tolist(), s) for i, s in zip(ids.to_pylist(), said.to_pylist())]
    assert count.to_pylist() == [len(i) for i, _ in out]
    return out


def by_library(texts):
    t = library("word_bpe_49k.json")
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    return [(w, t.decode(w, skip_special_tokens=False)) for w in want]


def test_bpe_encodes_different_words_together(monkeypatch):
    """A block of words that are all different takes few passes over single words; their ids are the library's."""
    rng, single = random.Random(8), []
    coder = bpe.WordBpe(tokenizers.path("word_bpe_49k.json"))
    alone = bpe.PrefixEncoder.encode
    monkeypatch.setattr(bpe.PrefixEncoder, "encode", lambda self, word: single.append(word) or alone(self, word))
    different = ["".join(rng.choice(["the", "ion", "er", "ñ", "x", "水", "eau", "s"]) for _ in range(rng.randrange(1, 12))) for _ in range(8000)]
    texts = [" ".join(different[i : i + 100]) for i in range(0, 8000, 100)] + ["q" * 700, "the" * 900]
    coder.block(pa.array(texts))
    assert len(single) < 50
    assert coded(coder, texts) == by_library(texts)
    for most in (1, 10**9):
        monkeypatch.setattr(bpe, "MANY", most)
        assert coded(coder, texts) == by_library(texts)


def test_bpe_cuts_words_as_library():
    rng = random.Random(9)
    texts = ["", "'", "''s", "'s's't", "l'll'll", "x'reve", "'ve'", "1's2", "it's<|endoftext|>'s", "e<|endoftext|>\u0301", "<|startoftext|><|endoftext|>", "\u0301", " "]
    texts += ["".join(rng.choice("'srevlmdt 1,éS") for _ in range(rng.randrange(30))) for _ in range(3000)]
    coder = bpe.load(tokenizers.path("word_bpe_49k.json"))
    assert coded(coder, texts) == by_library(texts)
    assert [coded(coder, [t])[0] for t in texts[:200]] == by_library(texts[:200])


def test_bpe_of_every_character_as_library(spark):
    """Letters, digits, lower case and order of marks are of the library's versions of Unicode, which are not Python's."""
    every = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)]]
    texts = [" ".join(f"a{c}b 1{c}{c}\u0334\u0301{c}" for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    texts += ["\U00011935\U00011930 \U00011938\u0301", "<|endoftext|>\u1df6\u0334\U00016ea0<|endoftext|>\u0301ΑΣ", "é\u07fde\u0301"]
    rows = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizers.path("word_bpe_49k.json")).collect()
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows}
    wrong = [i for i, want in enumerate(by_library(texts)) if got[i] != want]
    assert not wrong, f"{len(wrong)} texts"


def test_bpe_of_long_text_by_spans(monkeypatch):
    texts = [words(300), "\n\n" + words(40) + "  \t", "z" * 90 + " <|endoftext|>\n", "水の 山\u3000" * 30, "水の、山.Σa,,b\u0301.\u0301c;'s!'s" * 40]
    coder = bpe.load(tokenizers.path("word_bpe_49k.json"))
    for span in (1, 7, 100):
        monkeypatch.setattr(bpe, "SPAN", span)
        assert [coded(coder, [t])[0] for t in texts] == by_library(texts)


# Media


def test_media_round_trip(spark):
    out = media.store_texts(frame(spark)).collect()
    assert len(out) == len(TEXTS) + 2
    by_text = {}
    for r in out:
        if r.doc_id is None:
            continue
        raw = (TEXTS[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.payload).rstrip(b" ") == raw.rstrip(b" ") and len(r.payload) % 192 == 0 and len(r.payload) >= 192
        by_text.setdefault(raw, set()).add((bytes(r.media), bytes(r.feature)))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.store_texts(empty(spark)).count() == 0


def test_png_checks_and_filters():
    payload = bytes(RNG.randrange(256) for _ in range(192 * 9))
    image = media.write_png(payload)
    assert media.read_png(image).tobytes() == payload
    for at in (20, len(image) // 2, len(image) - 14):
        broken = bytearray(image)
        broken[at] ^= 1
        with pytest.raises(media.CorruptMedia):
            media.read_png(bytes(broken))
    with pytest.raises(media.CorruptMedia):
        media.read_png(image[:40])
    # every filter, written by the format's rule, is undone
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 192).astype(int)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1], np.uint8)
    made = np.zeros_like(rows)
    for y in range(9):
        for x in range(192):
            a = rows[y, x - 3] if x >= 3 else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            made[y, x] = (rows[y, x] - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    assert (media.unfilter(kinds, made.astype(np.uint8), 3) == rows).all()


def test_png_is_read_elsewhere():
    image = media.write_png(b"a" * 384)
    head = image[16:29]
    assert head[:8] == (64).to_bytes(4, "big") + (2).to_bytes(4, "big") and zlib.crc32(b"IHDR" + head).to_bytes(4, "big") == image[29:33]


# Fingerprints


def jaccard(a, b):
    a, b = ([t.encode().split() for t in (x,)][0] for x in (a, b))
    a, b = (Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter(w) for w in (a, b))
    most = sum(max(a[k], b[k]) for k in a | b)
    return sum(min(a[k], b[k]) for k in a & b) / most if most else 1.0


def test_fingerprints_estimate(spark):
    rng = random.Random(5)
    texts = [words(rng.randrange(20, 200), rng) for _ in range(150)]
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wrong = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = fingerprint.edit(t, after)
        assert got[i].edited == edited == t[: len(t) - len(t) // 2] + after[: len(t) // 2] and got[i].n_chars == len(t)
        wrong += [got[i].near_edited - jaccard(t, edited), got[i].near_next - jaccard(t, after)]
    assert abs(np.mean(wrong)) < 0.02 and np.std(wrong) < 0.08


@pytest.mark.parametrize("rows_each", [3, 4000])
def test_fingerprint_order_and_edges(spark, monkeypatch, rows_each):
    monkeypatch.setattr(fingerprint.ordered_parts, "__defaults__", (rows_each,))
    out = fingerprint.document_fingerprints(frame(spark)).collect()
    assert len(out) == len(TEXTS) + 2
    order = sorted([(-1, "one two three four five six"), *((i, t or "") for i, t in enumerate(TEXTS)), (5, TEXTS[5])])
    after = {(-1 if i == -1 else i): order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}
    for r in out:
        i = -1 if r.doc_id is None else r.doc_id
        text = dict(order)[i]
        if i != 5:
            assert r.edited == fingerprint.edit(text, after[i])
    same = {bytes(r.fingerprint) for r in out if r.doc_id in (6, 7)}
    assert len(same) == 1
    lone = fingerprint.document_fingerprints(spark.createDataFrame([(7, "a b c")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert fingerprint.document_fingerprints(empty(spark)).count() == 0


def test_fingerprints_of_hot_ids(spark):
    """A third of the rows under one id, a third without id, most of these equal: the pairs are those of one sorted pass, and
    no part holds much more than its share."""
    rng = random.Random(9)
    rows = [(i, words(6, rng)) for i in range(400)] + [(77, words(6, rng)) for _ in range(400)]
    rows += [(None, "the same words again")] * 380 + [(None, words(6, rng)) for _ in range(20)] + [(500, "the last one")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.coalesce("doc_id", F.lit(fingerprint.NO_ID)).alias("id"), "text")
    order = [(r.id, r.text) for r in texts.withColumn("tie", F.xxhash64("text")).orderBy("id", "tie", "text").collect()]
    wanted = Counter((i, fingerprint.edit(t, order[(n + 1) % len(order)][1])) for n, (i, t) in enumerate(order))
    plan = fingerprint.ordered_parts(texts, 40)
    largest = max(r["count"] for r in plan.where("ahead is null or not ahead").groupBy("part").count().collect())
    assert largest < 130
    schema = "id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    got = plan.mapInArrow(fingerprint._pairs, schema).collect()
    assert Counter((r.id, r.edited) for r in got) == wanted
    assert all(r.near_next == 1.0 for r in got if r.edited == "the same words again" and r.id == fingerprint.NO_ID)


# Language and quality


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_language_edges(spark):
    docs = frame(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    out = {r.doc_id: r for r in langid.language_ids(docs).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2)) and out[6].lang_pred == out[7].lang_pred
    unknown = langid.language_ids(frame(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    assert langid.language_ids(empty(spark)).count() == 0


def test_crf_labels_code_switched_words():
    en, fr = ["the river and ridge of stone"] * 40, ["le fleuve et la crête du rocher"] * 40
    model = langid.fit(en + fr, ["en"] * 40 + ["fr"] * 40)
    import pyarrow as pa

    p, counts = langid.label_words(model, pa.array(["the river and ridge le fleuve et la crête"]))
    assert counts.tolist() == [9] and [model.labels[i] for i in p.argmax(axis=1)] == ["en"] * 4 + ["fr"] * 5


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    p, pairs = langid.forward_backward(emit, np.ones((4, 1), bool), trans)
    total, single, double = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(emit[t, 0, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, s in enumerate(path):
            single[t, s] += w
        for a, b in zip(path, path[1:], strict=False):
            double[a, b] += w
    assert np.allclose(p[:, 0], single / total) and np.allclose(pairs, double / total)


@needs_data
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95 and out.score.between(0, 1).all()


def test_quality_gradient_and_edges(spark):
    x, owner = quality.passages(["ab cd " * 200, "", "x" * 1500])
    assert owner.tolist() == [0, 0, 0, 1, 2, 2, 2] and not x[3].any()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality_scores(frame(spark), labels).collect()}
    assert out[6].score == out[7].score and all(0 <= r.score <= 1 for r in out.values())
    assert quality.quality_scores(empty(spark), labels.limit(0)).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="site-banner cookie">Accept</div>
<div id="wrap"><article><h1>Head &amp; more</h1><p>One <b>two</b>
 three<br>four<p>Five&nbsp;six<ul><li>a<li>b</ul><aside>no</aside></article>
<section class="comments"><p>nice</p></section></div><!-- <p>no</p> --><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://a.example/y", ""), (4, "http://b.example/", "<p>plain <i>text</i></p> tail"), (4, "http://b.example/", "<p>plain <i>text</i></p> tail"), (None, "x", "<div>a<div>b</div>c</div>")]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    got = [(r.page_id, r.text) for r in out]
    assert sorted(got, key=repr) == sorted([(1, "Head & more One two three four Five six a b"), (2, ""), (3, ""), (4, "plain text tail"), (4, "plain text tail"), (None, "a b c")], key=repr)
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_asides_by_name(spark):
    page = '<div class="main-menu"><p>menu</p></div><div id="content"><div class="ad-box">ad</div><p>story</p><form><p>mail</p></form><div id="reader-comments">nice</div><article class="related-story">other</article><p>end</p></div><div class="sidebar">side</div>'
    (r,) = html.extract_main_text(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")).collect()
    assert r.text == "story end"


def test_template_text_goes(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><div><span>Our site, since 1990</span></div><div><p>story {i} {words(5)}</p></div></div>") for i in range(30)]
    copies = [(100 + i, "http://c.example/", "<div><p>the same story</p></div>") for i in range(30)]
    out = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    assert all(out[i].startswith(f"story {i} ") and "1990" not in out[i] for i in range(30))
    assert all(out[100 + i] == "the same story" for i in range(30))


def test_copies_with_their_own_surroundings_keep_their_text(spark):
    made = lambda i, head, story: f"<script>track({i})</script><nav>menu {i}</nav><article><h1>{head}</h1><!-- ad {i} --><div class='ad'>buy {i}</div><p>{story}</p></article>"
    rows = [(i, f"http://c.example/{i}", made(i, "one head", "one story") if i < 40 else made(i, f"head {i}", f"story {i}")) for i in range(50)]
    out = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == ("one head one story" if i < 40 else f"head {i} story {i}") for i in range(50))


def test_tree_matching():
    a, b = (html.skeleton(parse(s)) for s in ("<ul><li>1<li>2</ul><p>x</p><b>y</b>", "<ul><li>1</ul><i>q</i><b>y</b>"))
    assert html.matching(a, b)[0] == 4 and html.matching(a, a)[0] == 5
    assert [k[0] for k in html.merge(a, b)[2]] in (["ul", "p", "i", "b"], ["ul", "i", "p", "b"])


# Conversations


def test_roles_are_recovered(spark):
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{words(rng.randrange(1, 30), rng)}\n{words(5, rng)}") for c in range(40) for t in range(rng.randrange(1, 9))]
    table = spark.createDataFrame([*rows, (None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    lines = chat.transcript_lines(table)
    out = {(r.conv_id, r.start >> 20): r for r in chat.parse_transcripts(lines.select("conv", "pos", "line"), chat.train(lines), span=8 << 20).collect()}
    right = sum((c, t) in out and out[c, t].role == r and out[c, t].text == x.strip() for c, t, r, x in rows)
    assert right > 0.95 * len(rows) and out[rows[0][0], 0].rendered.startswith("<|user|>\n")
    none = lines.limit(0)
    assert chat.parse_transcripts(none.select("conv", "pos", "line"), chat.train(none)).count() == 0


def test_blockwise_viterbi_equals_plain(spark):
    rng = np.random.default_rng(2)
    model = chat.Hmm(rng.normal(size=(chat.N_STATES, chat.N_STATES)), rng.normal(size=(chat.N_STATES, chat.N_OBSERVED)))
    seen = rng.integers(0, chat.N_OBSERVED, 300).tolist()
    want = chat.settle([model.step(o) for o in seen], chat.BEFORE, -1)
    lines = spark.createDataFrame([(1, i, o) for i, o in enumerate(seen)], "conv long, pos long, o int")
    got = [r.state for r in chat.viterbi(lines, model, span=4).orderBy("pos").collect()]
    assert got == want


def test_rows_of_one_turn_are_all_kept(spark, tmp_path):
    from waymark.llm.queries import op7_chat

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"plain {c} {t} {words(6)}") for c in range(20) for t in range(6)]
    odd = [(None, None, "user", "zulu nobody\nzulu2"), (None, None, "user", "alfa nobody\nalfa2\nalfa3"), (None, 0, "assistant", "mike nobody"), (3, 1, "assistant", "another answer\nwith a line"), (3, 1, "user", "another question")]
    spark.createDataFrame([*rows, *odd, *odd[:2]], "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    out = op7_chat(spark, str(tmp_path)).select("conv_id", "turn", "text").collect()
    said = {c: [line for r in sorted(out, key=lambda r: r.turn) if r.conv_id == c for line in r.text.split("\n") if line.strip()] for c in (None, 3)}
    for c, lines in said.items():
        # A marker that the model takes for text stays before its line.
        want = sorted(line for x in {*rows, *odd} if x[0] == c for line in x[3].split("\n") if line)
        assert len(lines) == len(want) and all(any(got.endswith(w) for got in lines) for w in want)


def test_long_turns_and_clashing_columns(spark, tmp_path):
    from waymark.llm.queries import op7_chat

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"plain {c} {t} {words(6)}") for c in range(20) for t in range(6)]
    rows += [(7, 6, "user", "\n".join(f"line {i}" for i in range(3000))), (7, 7, "assistant", "done")]
    df = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"conv": F.lit("?"), "pos": F.lit("x"), "line": F.lit(1), "at": F.lit(2), "state": F.lit("y"), "start": F.lit(0)})
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    out = op7_chat(spark, str(tmp_path)).where("conv_id = 7").collect()
    said = [line for r in sorted(out, key=lambda r: r.turn) for line in r.text.split("\n")]
    assert sum(r.n_lines for r in out) in range(3007, 3020) and [x for x in said if x.startswith("line ")][-2999:] == [f"line {i}" for i in range(1, 3000)]


def test_lines_are_numbered_across_ranges(spark):
    rng = random.Random(8)
    places = [(c, rng.randrange(40), str(i)) for c, n in ((7, 3000), (1, 5), (9, 700), (-4, 1)) for i in range(n)]
    lines = spark.createDataFrame(places, "conv long, pos long, line string").repartition(6)
    got = {}
    for r in chat.numbered(lines, ("pos",)).collect():
        got.setdefault(r.conv, []).append((r.at, r.pos, r.line))
    assert sum(map(len, got.values())) == len(places)
    for c, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found))) and [x[1] for x in found] == sorted(p for k, p, _ in places if k == c)


# Registration


@needs_data
def test_registered_digests(spark):
    import __spark_entry__ as entry

    made = entry.queries()
    assert {n.split("_")[0] for n in made if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in made
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in made["op2_media"](spark, DATA).collect():
        raw = docs[r.doc_id].encode()
        raw += b" " * (-len(raw) % 192 if raw else 192)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))


@needs_data
def test_pipeline_small(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = docs
    for name, stage in cp.STAGES:
        before = out.count()
        out = stage(spark, out, DATA)
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= before
        out = spark.createDataFrame(out.collect(), out.schema)
    json.dumps([r.asDict() for r in out.limit(1).collect()])
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


SPEECH = {
    "en": "the river and ridge of stone with water over this hill where they went".split(),
    "de": "der fluss und das gebirge aus stein mit wasser über diesem hügel wohin sie gingen".split(),
    "fr": "le fleuve et la crête du rocher avec eau sur cette colline où ils allaient".split(),
    "es": "el río y la cresta del peñasco con agua sobre esta colina donde ellos iban".split(),
}


def corpus(rng):
    """(doc_id, text, lang, source, n_chars) and quality labels: good and bad texts of four languages, near and exact copies, a shared
    passage, a text of all languages alike, one without letters, null texts and ids."""
    said = lambda k, n: " ".join(rng.choice(SPEECH[k]) + str(rng.randrange(100)) for _ in range(n))
    langs = list(SPEECH)
    texts = [(said(langs[i % 4], 60), langs[i % 4], 1) for i in range(80)]
    texts += [("$$ 99 ## !! " * 12 + said(langs[i % 4], 8), langs[i % 4], 0) for i in range(40)]
    passage = said("en", 50)
    texts += [(said("en", 20) + " " + passage + " " + said("en", 20), "en", 1) for _ in range(3)]
    texts += [(texts[i][0] + " more", texts[i][1], 1) for i in range(6)] + [texts[3], texts[3]]
    texts += [(" ".join(w for four in zip(*(rng.sample(SPEECH[k], 10) for k in langs), strict=True) for w in four), None, 1), ("12 34 56 !!", None, 0), (None, "en", 1)]
    rows = [(i, t, lang, "web", len(t or "")) for i, (t, lang, _) in enumerate(texts)] + [(None, said("de", 50), "de", None, None)]
    return rows, [(i, q, 0) for i, (_, _, q) in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out of it, as run() writes it."""
    import corpus_pipeline as cp

    base = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus(random.Random(31))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("score", F.lit(1)).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    frames = [spark.createDataFrame(rows, schema)]
    for _, stage in cp.STAGES:
        out = stage(spark, frames[-1], base)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    return base, frames


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pipeline_languages_by_brute_force(spark, stages):
    import corpus_pipeline as cp
    import pyarrow as pa

    model = langid.train(stages[1][0])
    want = []
    for r in stages[1][0].collect():
        code, scores, (n,) = langid._coded(model, pa.array([r.text or ""]))
        if n:
            p, _ = langid.forward_backward(scores[code][:, None, :], np.ones((n, 1), bool), model.transitions)
            if p[:, 0].mean(axis=0).max() >= cp.LEAST_LANGUAGE:
                want.append(tuple(r))
    assert as_rows(stages[1][1]) == sorted(want, key=repr)
    gone = {r.doc_id for r in stages[1][0].collect()} - {r.doc_id for r in stages[1][1].collect()}
    mixed, none, null = (r.doc_id for r in stages[1][0].collect() if r.lang is None or r.text is None)
    assert {none, null} <= gone and mixed in gone and len(gone) == 3


def test_pipeline_quality_by_brute_force(spark, stages):
    import corpus_pipeline as cp

    model = quality.train(stages[1][1], spark.read.parquet(f"{stages[0]}/labels.parquet"))
    want = []
    for r in stages[1][1].collect():
        x, _ = quality.passages([r.text])
        h = np.tanh(x @ model.p["E"] + model.p["e"])
        a = np.exp((np.tanh(h @ model.p["V"]) / (1 + np.exp(-(h @ model.p["U"])))) @ model.p["w"])
        if 1 / (1 + np.exp(-((a / a.sum()) @ h @ model.p["c"] + model.p["d"][0]))) >= cp.LEAST_QUALITY:
            want.append(tuple(r))
    assert as_rows(stages[1][2]) == sorted(want, key=repr)
    kept = {r.doc_id for r in stages[1][2].collect()}
    assert not kept & set(range(80, 120)) and set(range(80)) <= kept


def test_pipeline_copies_and_passages_by_brute_force(spark, stages):
    rows = stages[1][2].collect()
    named = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
    root, _ = brute_components([r.text for r in named])
    want = [tuple(r) for i, r in enumerate(named) if root[i] == i] + [tuple(r) for r in rows if r.doc_id is None]
    assert as_rows(stages[1][3]) == sorted(want, key=repr) and len(want) == len(rows) - 8

    rows = stages[1][3].collect()
    want = []
    for r, kept in zip(rows, brute_kept([r.text for r in rows]), strict=True):
        if len(kept.split()) == len(r.text.split()):
            want.append(tuple(r))
        elif kept:
            want.append((r.doc_id, kept, r.lang, r.source, len(kept)))
    assert as_rows(stages[1][4]) == sorted(want, key=repr) and any(tuple(r) not in want for r in rows)


def test_pipeline_packing_and_run(spark, stages):
    import corpus_pipeline as cp

    t = library("byte_bpe_50k.json")
    rows, packed = stages[1][4].collect(), stages[1][5].toPandas()
    want = sorted(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    whole = packed.assign(key=packed.doc_id.fillna(-1)).groupby("key")
    assert sorted(whole.length.sum()) == want and (packed.groupby("sequence_id").length.sum() <= 1024).all()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert as_rows(cp.run(spark, stages[0]).select(columns)) == as_rows(stages[1][5].select(columns))


def test_pipeline_stages_on_empty_tables(spark, stages):
    import corpus_pipeline as cp

    for _, stage in cp.STAGES:
        assert stage(spark, stages[1][0].limit(0), stages[0]).count() == 0


def test_quality_is_the_same_however_texts_are_cut(monkeypatch):
    text = ("Plain words, 12 numbers; <b>marks</b> and $$$ again again " * 300).encode() + "é ünd ".encode() * 500 + b"x" * 3000
    (group,) = quality.parts([text, b"", b"ab"], part=1 << 30)
    x, owner = quality.encoded(group)
    model = quality.Mil()
    want = model.forward(x, owner)["score"]
    for size in (512, 2048, 1 << 15):
        monkeypatch.setattr(quality, "PART", size)
        y, of = quality.passages([text, b"", b"ab"])
        assert (y == x).all() and (of == owner).all()
        assert np.allclose(model.scores([text, b"", b"ab"]), want, atol=1e-6)


def test_quality_forward_and_gradient_by_brute_force():
    rng = np.random.default_rng(0)
    model = quality.Mil(hidden=5, gate=3)
    p = model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, owner, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    for bag, got in enumerate(model.forward(x, owner)["score"]):
        h = [np.tanh(row @ p["E"] + p["e"]) for row in x[owner == bag]]
        s = [np.exp((np.tanh(k @ p["V"]) / (1 + np.exp(-(k @ p["U"])))) @ p["w"]) for k in h]
        z = sum(a / sum(s) * k for a, k in zip(s, h, strict=True))
        assert abs(got - 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))) < 1e-12

    def loss():
        q = model.forward(x, owner)["score"]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for k, g in model.gradients(x, owner, y).items():
        for _ in range(5):
            i = tuple(int(rng.integers(n)) for n in p[k].shape)
            p[k][i] += 1e-5
            up = loss()
            p[k][i] -= 2e-5
            down = loss()
            p[k][i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-7


def test_training_bags_are_bounded(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "12 $$ 9 ") * (4000 if i < 4 else 40)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, bag=4)
    scored = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((scored[i] > 0.5) == (i % 2 == 1) for i in range(40))


def test_language_of_long_chains_is_exact():
    import pyarrow as pa

    en, fr = ["the river and ridge of stone"] * 40, ["le fleuve et la crête du rocher"] * 40
    model = langid.fit(en + fr, ["en"] * 40 + ["fr"] * 40)
    rng = random.Random(3)
    texts = [" ".join(rng.choice([*en[0].split(), *fr[0].split(), "x", "zz"]) for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 1000)]
    p, counts = langid.label_words(model, pa.array(texts))
    code, scores, _ = langid._coded(model, pa.array(texts))
    at = 0
    for n in counts.tolist():
        if n:
            whole, _ = langid.forward_backward(scores[code[at : at + n]][:, None, :], np.ones((n, 1), bool), model.transitions)
            assert np.allclose(whole[:, 0], p[at : at + n], atol=1e-12)
        at += n
    alone = langid.label_shares(model, pa.array(texts[-1:]))[0]
    assert np.allclose(alone, langid.label_shares(model, pa.array(texts))[0][-1:])


def test_words_do_not_depend_on_spans(monkeypatch):
    from waymark.llm import words as w

    texts = [b"", words(300).encode(), b"x" * 500 + b" y", b"  ", b"a b\nc", words(40).encode(), b""]
    want = w.Words(texts, places=True)
    flat = [x for t in texts for x in t.split()]
    assert [want.data[i:j] for i, j in zip(want.starts, want.ends, strict=True)] == flat and want.counts.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(w, "SPAN", 37)
    monkeypatch.setattr(w, "CHUNK", 16)
    got = w.Words(texts, places=True)
    assert (got.hashes == want.hashes).all() and (got.starts == want.starts).all() and (got.ends == want.ends).all()
    runs, cuts = got.runs(5)
    windows = [tuple(t.split()[i : i + 5]) for t in texts for i in range(len(t.split()) - 4)]
    assert cuts[-1] == len(runs) == len(windows) and len({*zip(runs.tolist(), windows, strict=True)}) == len(set(windows)) == len(set(runs.tolist()))


def test_samples_of_long_texts_in_shares(monkeypatch):
    texts = [words(n).encode() for n in (200, 0, 1, 900)]
    assert (fingerprint.fingerprints(texts, terms=50) == fingerprint.fingerprints(texts)).all()
    sets = neardup.shingle_sets([words(n).encode() for n in (300, 50, 900, 2)])
    hashes, bits = neardup.min_hashes(sets), neardup.parity_bitmaps(sets)
    monkeypatch.setattr(neardup, "PART", 64)
    assert (neardup.min_hashes(sets) == hashes).all() and (neardup.parity_bitmaps(sets) == bits).all()


MEMORY = """
import resource, sys
import pyarrow as pa
sys.path.insert(0, {root!r})
from waymark.llm import fingerprint, langid, media, neardup, quality, substring
text = " ".join(f"w{{i * 7919 % 1000003}}" for i in range(100_000)) + " "
text *= (32 << 20) // len(text)
def batch(**columns):
    return iter([pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))])
ids, texts = ([1], pa.int64()), ([text], pa.string())
{body}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize(
    "body",
    [
        "for _ in substring._minimisers(batch(key=([b'k'], pa.binary()), id=ids, text=texts)): pass",
        "for _ in neardup._signatures(batch(doc_id=ids, text=texts)): pass",
        "for _ in fingerprint._pairs(batch(part=([0, 0], pa.int64()), ahead=([False, True], pa.bool_()), id=([1, 2], pa.int64()), text=([text, 'a b'], pa.string()))): pass",
        "quality.Mil().scores([text.encode()])",
        "media.read_png(media.write_png(media.pad(text.encode())))",
        "langid.label_shares(langid.fit(['a b c', 'd e f'], ['x', 'y']), pa.array([text]))",
        "del text, texts; langid.label_shares(langid.fit(['a b c', 'd e f'], ['x', 'y']), pa.array(['abcdefg' * (32 << 20 >> 3)]))",
        "del text, texts; langid.label_shares(langid.fit(['a b c', 'd e f'], ['x', 'y']), pa.array(['\\u6c34\\u306e\\u3001\\u5c71' * (32 << 20 >> 4)]))",
    ],
)
def test_memory_for_one_long_text(body):
    """A text of 32 MB takes each kernel under 800 MB, with 200 MB for the process itself."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", MEMORY.format(root=root, body=body)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-800:]
    assert int(done.stdout.split()[-1]) < 800


@pytest.mark.parametrize("text", ["text", "'1 ' * (16 << 20)", "'\\u6c34\\u306e\\u3001\\u5c71' * (32 << 20 >> 4)"])
def test_memory_of_bpe_for_one_long_text(text):
    body = f"from waymark.llm import bpe; text = {text}; del texts; bpe.load({tokenizers.path('word_bpe_49k.json')!r}).block(pa.array([text]))"
    test_memory_for_one_long_text(body)


def test_word_scores_do_not_depend_on_spans(monkeypatch):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(langid.TABLE, 3)).astype(np.float32)
    words_ = pa.array(["a", "straße", "x" * 300, "日本語" * 40, "", "river", "abc" * 33])
    want = langid.word_scores(words_, weights)
    for span in (7, 16, 100):
        monkeypatch.setattr(langid, "FEATURED", span)
        assert np.allclose(langid.word_scores(words_, weights), want)


def test_monotonous_long_texts(spark):
    rng = random.Random(9)
    texts = ["again " * 70_000, " ".join(str(rng.randrange(10**6)) for _ in range(70_000)), "x " * 34, "p q r " * 40_000, words(36, rng)]
    texts.append(" ".join(texts[1].split()[32_700:32_900]) + " tail")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(texts)
    for hot_rows in (100, 10**9):
        got = {r.doc_id: r.kept_text for r in substring.substring_dedup(docs, hot_rows=hot_rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_packing_of_long_documents_holds_no_group(spark):
    lengths = [(i, s, 64 if s < 64 * 50 else 1 + (i * 37) % 63) for i in range(40) for s in range(0, 64 * 51, 64)]
    out = packing.pack(spark.createDataFrame(lengths, "doc_id long, start long, length long"), len(lengths), window=64, group_rows=500).toPandas()
    assert len(out) == len(lengths)
    size = out.groupby("sequence_id").length.sum()
    assert (size <= 64).all() and (size[out[out.length == 64].sequence_id] == 64).all()
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.values == np.concatenate([[0], np.cumsum(seq.length)[:-1]])).all()


def test_deeply_nested_page():
    source = "<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p>"
    root = parse(source)
    form, found = html.read_page(source)
    assert [b.text for b in found] == ["x", "y"]
    assert len(list(html.align(root, html.skeleton(root)))) == 5002 and html.read_form(form).size == 5002


def extracted(spark, pages):
    rows = [(i, url, source) for i, (url, source) in enumerate(pages)]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(out, key=lambda r: r.page_id)]


def test_names_do_not_hide_articles(spark):
    pages = [
        '<body class="home no-sidebar"><article><p>story</p></article></body>',
        '<main class="content has-sidebar"><p>story</p></main>',
        '<article class="post comment-open"><p>story</p></article>',
        '<article><p>story</p><section id="related-work"><p>more</p></section></article>',
        "<div>" * 300 + '<div class="ad"><p>advert</p></div><p>story</p>' + "</div>" * 300,
    ]
    assert extracted(spark, [(f"http://h{i}.example/", p) for i, p in enumerate(pages)]) == ["story"] * 3 + ["story more", "story"]


def test_wrapper_without_any_names(spark):
    rng = random.Random(12)
    page = lambda i: (
        f"<div class='k1'><a href='/'>{words(2, rng)}</a><a href='/b'>{words(2, rng)}</a></div><div class='k2'>buy {words(3, rng)}</div>"
        f"<div class='k3'><h2>head {i}</h2><div><p>story {i} {words(40, rng)}</p><p>{words(30, rng)}</p></div><div class='k5'><p>Written for Our Site since 1990, all about it</p></div></div>"
        f"<div class='k4'>rights {i}</div>"
    )
    sources = [page(i) for i in range(12)]
    for i, text in enumerate(extracted(spark, [("http://n.example/", s) for s in sources])):
        assert text.startswith(f"head {i} story {i} ") and not any(w in text for w in ("rights", "buy", "Our Site"))


def test_layouts_are_all_in_the_template(spark):
    rng = random.Random(13)
    pages = [f"<div><div><p>head {words(2, rng)}</p></div><div><p>story {i} {words(50, rng)}</p></div></div>" for i in range(40)]
    pages += [f"<table><tr><td>side {i}</td><td class='t'><p>other {i} {words(50, rng)}</p><p>All rights are reserved here</p></td></tr></table>" for i in range(20)]
    out = extracted(spark, [("http://l.example/", p) for p in pages])
    assert all(t.startswith(f"story {i} ") or f"story {i} " in t for i, t in enumerate(out[:40]))
    assert all(f"other {i} " in t for i, t in enumerate(out[40:]))


def test_pages_without_an_article_stay_empty(spark):
    rng = random.Random(17)
    page = lambda i, story: f"<div class='k1'>buy {i}</div><div class='k2'><h1></h1><p>{story}</p></div><div class='k3'>rights {i}</div>"
    pages = [page(i, f"story {i} {words(40, rng)}") for i in range(8)] + [page(8, "")]
    out = extracted(spark, [("http://e.example/", p) for p in pages])
    assert all(t.startswith(f"story {i} ") for i, t in enumerate(out[:8])) and out[8] == ""


def test_repeated_paragraphs_lose_constant_ends(spark):
    rng = random.Random(14)
    pages = [f"<article><h1>head</h1><p>our daily slogan</p><p>story {i} {words(30, rng)}</p><p>more {words(9, rng)}</p><p>all rights reserved</p></article>" for i in range(10)]
    out = extracted(spark, [("http://p.example/", p) for p in pages])
    assert all(t.startswith(f"head story {i} ") and "reserved" not in t for i, t in enumerate(out))


def many_words(n, rng):
    return " ".join(f"{rng.choice(WORDS[:5])}{rng.randrange(999)}" for _ in range(n))


@pytest.mark.parametrize(("pages", "times"), [(5, 1), (10, 1), (30, 1), (30, 4), (100, 2)])
def test_comments_never_stand_for_the_article(spark, pages, times):
    """Eight comments a page, each ``times`` as long as a paragraph or a little longer, on hosts of any size."""
    rng = random.Random(pages + times)
    sources, want = [], []
    for i in range(pages):
        text = [f"head {many_words(3, rng)}", *(many_words(30, rng) for _ in range(3))]
        comments = "".join(f"<div class='c'><p>{many_words(35 * times, rng)}</p></div>" for _ in range(8))
        body = f"<h1>{text[0]}</h1>" + "".join(f"<p>{p}</p>" for p in text[1:])
        sources.append(f"<nav><a href='/'>home {i}</a></nav><article>{body}</article><section class='comments'>{comments}</section><footer>rights {i}</footer>")
        want.append(" ".join(text))
    assert extracted(spark, [("http://c.example/", s) for s in sources]) == want


def test_parts_of_the_article_stay(spark):
    """Links between paragraphs, a first paragraph that nine of ten pages share, a heading in the article's own header."""
    rng = random.Random(23)
    links, shared, headed, want = [], [], [], [[], [], []]
    for i in range(10):
        a, b, head, names = many_words(30, rng), many_words(30, rng), many_words(3, rng), [many_words(4, rng) for _ in range(4)]
        menu = "<nav><a href='/'>x</a></nav>"
        links.append(f"{menu}<article><h1>{head}</h1><p>{a}</p><ul>{''.join(f'<li><a href=/{k}>{x}</a></li>' for k, x in enumerate(names))}</ul><p>{b}</p></article>")
        want[0].append(" ".join([head, a, *names, b]))
        first = "This column appears weekly." if i else many_words(6, rng)
        shared.append(f"{menu}<article><h1>{head}</h1><p>{first}</p><p>{a}</p><p>{b}</p></article>")
        want[1].append(" ".join([head, first, a, b]))
        headed.append(f"<header>site</header><article><header><h1>{head}</h1></header><p>{a}</p><p>{b}</p></article>")
        want[2].append(" ".join([head, a, b]))
    for pages, texts in zip((links, shared, headed), want, strict=True):
        assert extracted(spark, [("http://a.example/", s) for s in pages]) == texts


def test_choice_of_the_part_by_brute_force():
    """On small templates the choice is an unmarked part whenever one has a twentieth of the text."""
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randrange(2, 6)
        kids = tuple(html.shape(f"div.k{k}", False, (html.shape("p", True, ()),)) for k in range(n))
        template = html.shape("body", False, kids)
        stats = []
        for k in range(n):
            mass = float(rng.choice([0, 100, 1000, 5000, 20000]))
            marked = rng.random() < 0.5
            stats.append({"slot": 2 + 2 * k, "mass": mass, "links": 0.0, "aside": mass if marked else 0.0, "pages": 500, "uses": 500, "texts": 500})
        own = html.Wrapper(template, stats, 500)
        total = sum(s["mass"] for s in stats)
        plain = sum(s["mass"] for s in stats if not s["aside"])
        if plain and plain >= total / 20:
            kept = own.kept()
            best = max((s for s in stats if not s["aside"]), key=lambda s: s["mass"])
            assert best["slot"] in kept
            heavy = [s for s in stats if s["aside"] and s["mass"]]
            assert not any(s["slot"] in kept for s in heavy)


def test_near_copies_keep_their_head(spark):
    rng = random.Random(15)
    base = words(60, rng).split()
    pages = []
    for i in range(30):
        w = list(base)
        w[i] = f"changed{i}"
        pages.append(f"<nav><a href='/'>{words(2, rng)}</a></nav><article><h1>one head</h1><p>{' '.join(w)}</p></article><footer>{words(4, rng)}</footer>")
    assert all(t.startswith("one head ") and f"changed{i}" in t for i, t in enumerate(extracted(spark, [("http://c.example/", p) for p in pages])))


def brute_matching(a, b):
    """Most nodes of two forms in an order-preserving pairing of like nodes, by trying all pairings."""
    if a.kind != b.kind:
        return 0

    def best(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        paired = brute_matching(a.kids[i], b.kids[j])
        return max(best(i + 1, j), best(i, j + 1), paired + best(i + 1, j + 1) if paired else 0)

    return 1 + best(0, 0)


def test_alignment_by_brute_force():
    rng = random.Random(16)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return html.shape(rng.choice(["div.a", "div.b", "p"]), False, tuple(kids))

    for _ in range(200):
        a, b = (html.shape("body", False, tree(3).kids) for _ in range(2))
        assert html.matching(a, b)[0] == brute_matching(a, b)
        both = html.merge(a, b)
        assert html.read_form(html.written_form(both)) is both
        for one in (a, b):
            at = html.slots_of(one, both)
            assert sorted(at) == at and len(set(at)) == one.size and at[0] == 0  # every node has a slot of its own, in order
