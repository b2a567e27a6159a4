"""Token counts, conversation repair and periodic runs against the library and brute force."""

import hashlib
import random
import subprocess
import sys
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from waymark.llm import periodic, queries, repair, tokencount

tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = tokenizers.path("byte_bpe_50k.json")


def documents(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_tokens": F.lit("?"), "runs": F.lit(1), "start": F.lit(0), "n_bytes": F.lit(2)}) if clash else df


# Token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def fuzz(n, rng):
    bits = ["the", "ing", "é", "ß", "日本", "  ", " ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|endof", "42", "x" * 70, "\x1c", "\x85", "　", "\x01", "!!!", "…", "🙂", "a" * 100, "\r\n", "²", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(n)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 128), rng.randrange(0x20, 0x3000)])) for _ in range(rng.randrange(200))) for _ in range(n // 6)]


def test_counts_equal_library(spark, library):
    texts = [None, "", "   ", *fuzz(3000, random.Random(5)), "again " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (3, texts[3])]
    got = tokencount.count_tokens(documents(spark, rows), VOCABULARY).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for (i, t), ids in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        want[i].append((len((t or "").encode()), len(ids.ids)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_bytes, r.n_tokens))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert tokencount.count_tokens(documents(spark, []), VOCABULARY).collect() == []


@pytest.mark.parametrize("word", ["z" * 30_000, "ab" * 20_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(50_000)), "日" * 9_000, "=-" * 9_000])
def test_long_words(library, word):
    own = tokencount.counter(VOCABULARY)
    assert own.text(word) == len(library.encode(word, add_special_tokens=False).ids)


def test_both_heaps_agree():
    own, rng = tokencount.counter(VOCABULARY).merger, random.Random(7)
    for _ in range(3000):
        word = "".join(rng.choice("aeinst hé") for _ in range(rng.randrange(1, 60))).encode()[:64]
        assert own._short(word) == own._merged(word)


def test_vocabularies_out_of_order_are_refused():
    from waymark.llm.bpe import byte_symbols

    vocab = {s: i for i, s in enumerate([*byte_symbols(), "abc", "ab"])}
    with pytest.raises(ValueError):
        tokencount.Merger(vocab, [("ab", "c"), ("a", "b")])


# Conversation repair


def in_order(rows):
    filled = [(t, " " if role is None else role, " " if text is None else text) for t, role, text in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


MOVE = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def choices(row, fault, state):
    """(cost, edit, state after, what is written) of every edit of a row."""
    _, role, text = row
    yield 3, "D", state, ""
    if fault not in ("blank", "duplicate"):
        for edit, initial, cost, name in (("K", role[:1], 0, role), ("R", "u", 2, "user"), ("R", "a", 2, "assistant")):
            if (state, initial) in MOVE:
                yield cost + (fault == "truncated"), edit, MOVE[state, initial], f"\n{name}:{text}"


def inserts(state):
    for initial, name in (("u", "user"), ("a", "assistant")):
        if (state, initial) in MOVE:
            yield 2, "I", MOVE[state, initial], f"\n{name}:"


def brute(rows):
    rows = in_order(rows)
    faults = faults_of(rows)

    @cache
    def best(i, state, run):
        ends = [(0, "", "")] if i == len(rows) and state in ("", "a") else []
        ways = list(inserts(state)) if run < 3 else []
        for cost, edit, to, out in ways:
            rest = best(i, to, run + 1)
            ends += [(cost + rest[0], edit + rest[1], out + rest[2])] if rest else []
        for cost, edit, to, out in choices(rows[i], faults[i], state) if i < len(rows) else ():
            rest = best(i + 1, to, 0)
            ends += [(cost + rest[0], edit + rest[1], out + rest[2])] if rest else []
        return min(ends, default=None)

    cost, audit, text = best(0, "", 0)
    return measured(rows, faults) | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text[1:].encode()).hexdigest()}


def measured(rows, faults):
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
    }


def long_brute(rows):
    """The same for many rows: costs to go from the end, then the least letter at each place."""
    rows = in_order(rows)
    faults = faults_of(rows)
    far = 1 << 40

    def closed(costs):
        for _ in range(3):
            for q in costs:
                for cost, _, to, _ in inserts(q):
                    costs[q] = min(costs[q], cost + costs[to])
        return costs

    todo = [closed({"": 0, "a": 0, "s": far, "u": far})]
    for row, fault in zip(reversed(rows), reversed(faults), strict=True):
        todo.append(closed({q: min(cost + todo[-1][to] for cost, _, to, _ in choices(row, fault, q)) for q in ("", "s", "u", "a")}))
    todo.reverse()
    state, i, audit, text = "", 0, [], []
    while True:
        if i == len(rows) and state in ("", "a"):
            break
        ways = [(edit, to, out, i) for cost, edit, to, out in inserts(state) if cost + todo[i][to] == todo[i][state]]
        if i < len(rows):
            ways += [(edit, to, out, i + 1) for cost, edit, to, out in choices(rows[i], faults[i], state) if cost + todo[i + 1][to] == todo[i][state]]
        edit, state, out, i = min(ways)
        audit.append(edit)
        text.append(out)
    return measured(rows, faults) | {"cost": todo[0][""], "audit": "".join(audit), "repaired_sha256": hashlib.sha256("".join(text)[1:].encode()).hexdigest()}


TEXTS = ["Hi.", "Hi.", "what", "a!  ", "  ", "", None, "ok\n", "é.", "no?"]


def conversations(n, rng, most=12):
    out = []
    for c in range(n):
        for j in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            out.append((c or None, rng.choice([None, j, j, j, j // 2]), role, rng.choice([*TEXTS, "x" * j + "?"])))
    return out


def test_repair_by_brute_force(spark):
    data = conversations(700, random.Random(8))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"present": F.lit("?"), "kind": F.lit(1), "block": F.lit(2)})
    by = defaultdict(list)
    for c, *row in data:
        by[c].append(tuple(row))
    out = repair.repair_conversations(df)
    got = {r.conv_id: r.asDict() for r in out.collect()}
    assert len(got) == len(by) == out.count()
    for c, rows in by.items():
        want = brute(rows)
        assert {k: got[c][k] for k in want} == want, rows
    turns = defaultdict(list)
    for r in repair.repaired_turns(df, out).orderBy("place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for c in by:
        assert hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() == got[c]["repaired_sha256"]


def test_repair_of_giant_conversations(spark):
    """Blocks of backpointers are written and followed; conversations of very long texts too."""
    rng = random.Random(9)
    data = [("big", i // 2 if i % 5 else None, rng.choice(["user", "assistant", "assistant", "system"]), f"{i}." if i % 3 else rng.choice(["", "cut", "Hi."])) for i in range(100_000)]
    data += [(None, i, rng.choice(["user", "assistant"]), f"{i} " + "long text " * 30_000 + ".") for i in range(12)]
    data += [("small", 1, "user", "Hi.")]
    df = spark.createDataFrame(data, "conv_id string, turn long, role string, text string")
    out = repair.repair_conversations(df)
    got = {r.conv_id: r.asDict() for r in out.collect()}
    for c in ("big", None, "small"):
        want = long_brute([row[1:] for row in data if row[0] == c])
        assert {k: got[c][k] for k in want} == want
    assert got["small"] == got["small"] | brute([(1, "user", "Hi.")])
    turns = repair.repaired_turns(df, out).where("conv_id = 'big' or conv_id is null").orderBy("place").collect()
    for c in ("big", None):
        own = "\n".join(f"{r.role}:{r.text}" for r in turns if r.conv_id == c)
        assert hashlib.sha256(own.encode()).hexdigest() == got[c]["repaired_sha256"]


def test_damage_and_conversations_that_lose_all_rows(spark):
    import zlib

    data = [(c, t, r, f"a{c} b. {t}?") for c in range(120) for t, r in ((0, "user"), (1, "assistant"))[: 1 + c % 2]] + [(None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    hurt = defaultdict(list)
    for c, t, role, text in data:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if way == 4 else role, "" if way == 1 else text.replace(".", "").replace("?", "") if way == 2 else text)
        hurt[c] += [] if way == 0 else [row] * (2 if way == 3 else 1)
    got = {r.conv_id: r.asDict() for r in repair.repair_conversations(repair.damage(df), F.col("present")).collect()}
    assert len(got) == 121 and any(not rows for rows in hurt.values())
    for c in got:
        want = brute(hurt[c])
        assert {k: got[c][k] for k in want} == want
    assert repair.repair_conversations(df.limit(0)).collect() == []


def test_dropped_states_change_nothing():
    """Scripts without the rule that drops states."""
    rng = random.Random(4)
    for _ in range(300):
        kinds = [rng.choice([*range(9), 2, 4]) for _ in range(rng.randrange(1, 40))]
        ends = []
        for rule in (repair.AROUND, {}):
            repair.step.cache_clear()
            config, total, pointers, keep = repair.START, 0, [], repair.AROUND
            repair.AROUND = rule
            for kind in kinds:
                config, cost, p = repair.step(config, kind)
                total += cost
                pointers.append(p)
            repair.AROUND = keep
            state, extra, more = repair.finish(config)
            ends.append((total + more, repair.script(repair.back(pointers, state)[1]) + "I" * extra))
        repair.step.cache_clear()
        assert ends[0] == ends[1]


# Periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def periodic_texts(n, rng):
    out = [[], ["x"] * 1000, [str(i % 100) for i in range(1234)], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4]
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(1, 9))]
            w += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
        out.append(w)
    return out


def test_runs_by_brute_force(spark):
    texts = periodic_texts(1500, random.Random(2))
    rows = [(i, "\t".join(w) + " ") for i, w in enumerate(texts)] + [(None, None), (1, "a " * 9), (1, "")]
    got = periodic.periodic_runs(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = texts[r.doc_id] if r.doc_id not in (None, 1) else ["a"] * r.n_words if r.n_words < 10 else texts[1]
        want = brute_runs(w)
        assert [(x.start, x.period, x.length) for x in r.runs] == want and r.n_words == len(w)
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.periodic_runs(documents(spark, [])).collect() == []


def test_registered_runs(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(120)))) for i in range(200)] + [(None, "a " * 30), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    planted = 0
    for r in got:
        (text,) = [t for i, t in rows if i == r.doc_id] if r.doc_id != 7 else [dict(rows[:200])[7]] if r.collapsed_sha256 != hashlib.sha256(b"").hexdigest() else [None]
        w = (text or "").split()
        asked = queries.planted_period(r.doc_id, len(w))
        if asked:
            a, p = asked
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        want = brute_runs(w)
        best = max(want, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=None)
        assert r.n_runs == len(want)
        assert (r.start, r.period, r.length, r.exponent_milli) == ((*best, 1000 * best[2] // best[1]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in want).encode()).hexdigest()
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 8


MEMORY = """
import resource, sys
{body}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize(
    ("body", "most"),
    [
        ("import public_tokenizers as P, pyarrow as pa\nfrom waymark.llm.tokencount import counter\nassert counter(P.path('byte_bpe_50k.json')).block(pa.array(['some text or other ' * 1_700_000]))[0] > 1e6", 800),
        ("import public_tokenizers as P\nfrom waymark.llm.tokencount import counter\nassert counter(P.path('byte_bpe_50k.json')).text('ab' * 2_000_000) > 1e5", 400),
        ("from waymark.llm.periodic import runs_of\nassert len(next(runs_of([1], [b'some text or other ' * 1_700_000]))[1]) == 1", 1100),
    ],
)
def test_memory_for_one_long_text(body, most):
    done = subprocess.run([sys.executable, "-c", MEMORY.format(body=body)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < most
