"""Every registered query against its SQL on the smallest tables, and edge cases through Spark."""

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from waymark import queries as q
from waymark.functions import columns as col
from waymark.functions import tokens as tk
from waymark.operators import assist, extract, pagetext, ranks, readings, rows
from waymark.sources import corpus, csv, folder, project, shared
from waymark.streaming.scan import scan_stream, stream_tables

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    want = duck.execute(q.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert ours == theirs


@needs_data
def test_flagship_has_coordinates_across_breaks(spark, duck):
    import __spark_entry__ as entry

    want = duck.execute(f"{q.P} SELECT p.file_id, p.page_num FROM planted p JOIN pfiles f USING (file_id) WHERE NOT f.hidden AND n_pages = 2").fetchall()
    got = {(r.file_id, r.page_num) for r in entry.entry(spark).collect()}
    assert want and got.issuperset(want)


def test_csv_bytes(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, False)], "file_id string, file_seq long, hidden boolean")
    data = [("r1", "a", ["x,1", 'q"\n'], 41.5, None, None, "bad, one")]
    df = spark.createDataFrame(data, "row_id string, file_id string, cells array<string>, lat double, lon double, lat_raw string, lon_raw string")
    df = df.withColumn("row_seq", rows.row_seq(0, 1)).withColumn("notes", F.lit(""))
    csv.export_csv(df, files, ["A", "B"], str(tmp_path / "out"), single_file=True)
    (part,) = glob.glob(str(tmp_path / "out" / "part-*"))
    with open(part, "rb") as f:
        assert f.read() == '﻿A,B,Latitude (DD),Longitude (DD)\r\n"x,1","q""\n",41.5,"bad, one"\r\n'.encode()


def test_format_edges(spark):
    data = [(0.0,), (-0.0,), (41.0,), (12.9999999,), (59.9999999,), (0.1234565,), (None,)]
    df = spark.createDataFrame(data, "x double")
    got = [tuple(r) for r in df.select(col.format_dd(F.col("x")), col.format_dms(F.col("x"), "lon")).collect()]
    assert got[0] == ("0.0", "0°00'00\"E") and got[1][0] == "0.0" and got[2] == ("41.0", "41°00'00\"E")
    assert got[3][1] == "13°00'00\"E" and got[5][0] == "0.123456" and got[6] == ("", "")


def test_cross_page_chain_and_partitions(spark):
    pages = [("f", 1, "found at 41°24'12\"N,"), ("f", 2, "2°10'26\"E as seen"), ("f", 3, "none"), ("g", 1, "found at 41°"), ("g", 2, "24'12\"N, 2°10'26\"E as seen")]
    df = spark.createDataFrame(pages, "file_id string, page_num int, text string")
    files = spark.createDataFrame([("f", None), ("g", None)], "file_id string, intensity int")
    none = spark.createDataFrame([], "file_id string, page_num int, half string, start int")
    seen = set()
    for n in (1, 5):
        found, dets = extract.scan_corpus(df.repartition(n), files, none)
        seen.add(tuple(sorted((r.file_id, r.page_num, r.is_cross, round(r.lat, 4), round(r.lon, 4)) for r in found.collect())))
        assert dets.where("file_id = 'g' and half = 'lat'").count() == 2
    assert seen == {(("f", 1, 1, 41.4033, 2.1739), ("g", 1, 1, 41.4033, 2.1739))}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "file_id string, page_num int, text string")
    files = spark.createDataFrame([], "file_id string, intensity int")
    none = spark.createDataFrame([], "file_id string, page_num int, half string, start int")
    found, dets = extract.scan_corpus(pages, files, none)
    assert found.count() == 0 and dets.count() == 0


def test_duplicates_are_stable(spark):
    data = [(f"r{i}", i, 1.5 if i % 2 else None, None, None, None) for i in range(20)]
    df = spark.createDataFrame(data, "row_id string, i int, lat double, lon double, lat_raw string, lon_raw string")
    df = df.withColumn("row_seq", rows.row_seq(0, 0, 0, 0, F.col("i"))).withColumn("cells", F.array(F.lit("a"))).withColumn("file_id", F.lit("f"))
    gone = rows.find_duplicates(df)
    assert {r.row_id for r in gone.collect()} == {f"r{i}" for i in range(3, 20, 2)}
    assert rows.find_duplicates(df.join(gone, "row_id", "left_anti")).count() == 0


def test_folder_listing(spark, tmp_path):
    for name in ("b/doc10.pdf", "b/doc9.PDF", "a.pdf", ".hidden/x.pdf", "b/.x.pdf", "c/d/e/f/deep.pdf", "c/d/e/f/g/deeper.pdf", "notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%PDF")
    got = [(r.file_seq, r.name) for r in corpus.list_corpus(spark, str(tmp_path)).orderBy("file_seq").collect()]
    assert got == [(1, "a.pdf"), (2, "doc9.PDF"), (3, "doc10.pdf"), (4, "deep.pdf")]
    assert [r.name for r in corpus.list_corpus(spark, str(tmp_path), max_depth=None, max_files=2).orderBy("file_seq").collect()] == ["a.pdf", "doc9.PDF"]
    many = spark.range(700).selectExpr("concat('n', id, '.pdf') as path")
    assert corpus.files_of(many, "").agg(F.count("*"), F.max("file_seq"), F.max_by("name", "file_seq")).first() == (500, 500, "n499.pdf")


def test_places_over_ranges(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 as k", "id").repartition(7)
    assert shared.numbered(df, "k", "id").where("num <> k + 1").count() == 0
    assert shared.numbered(df.limit(0), "k").count() == 0


def test_columns_are_renamed():
    assert rows.rename_column(["A", "B", "C"], 1, "New") == ["A", "New", "C"] and rows.rename_column(["A"], 4, "x") == ["A"]


@pytest.mark.parametrize("refusal", [401, 403])
def test_refused_run_stops(spark, tmp_path, refusal):
    log = tmp_path / "asked"
    log.mkdir()

    def transport(body):
        (log / body).touch()
        return (200, "{}") if int(body) <= 20 else (refusal, "no")

    requests = spark.range(1, 101).selectExpr("id as request_seq", "cast(id as string) as body")
    got = {r.request_seq: r.status for r in assist.call_in_slices(requests, transport, parallel=2, slice_size=10).collect()}
    assert all(got[i] == 200 for i in range(1, 21)) and all(got[i] in (0, refusal) for i in range(21, 31)) and all(got[i] == 0 for i in range(31, 101))
    assert {int(p.name) for p in log.iterdir()}.issubset(range(1, 31))


@pytest.mark.parametrize(
    ("text", "n"),
    [('```json\n[{"a": 1}]\n```', 1), ('see [{"a": "x]y"}, 2] and [3]', 1), ("none", 0), ("[{", 0), (None, 0), ('[{"a": 1}', 0), ('[bad] [{"a": 1}]', 0), ('[[{"a": 1}], {"b": "\\"]"}]', 1)],
)
def test_first_array_of_a_reply(spark, text, n):
    items = F.try_variant_get(F.try_parse_json(assist.first_array(F.col("text"))), "$", "array<variant>")
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    assert spark.createDataFrame([(text,)], "text string").select(F.coalesce(F.size(objects), F.lit(0))).first()[0] in (n, -1 if n == 0 else n)


def test_results_of_any_reply(spark):
    """Replies that a model may give, the hostile ones included; all of them within the JVM."""
    replies = {
        "deep": "[" * 200_000,
        "closed": "[" * 100_000 + "]" * 100_000,
        "half": '[{"row": "a", "note": "x\\ud83d y", "delete": true}]',
        "open string": '[{"row": "a", "note": "never ends]',
        "escapes": 'so: [{"row": "b", "note": "he said \\"[]\\" \\\\", "need_prev": true}] and [1]',
        "kinds": '```json\n[{"row": 5, "lat": "4", "lon": 180.5, "delete": "true", "col1": 7, "col2": " c ", "verdict": 3}, {"row": 5.0, "lat": -90, "lon": 1.5e1}, {"row": true}, {"row": ""}, {"row": null}, [1], 3, "x", null, {"row": 1.5, "verdict": "ok", "notes_col": "\\t n "}]```',
        "strings": '[{"row": "' + "q" * 50_000 + '", "note": "' + "n" * 500 + '\\n' * 20_000 + '"}]',
        "none": None, "empty": "", "not json": "[{row: 1}]", "nan": '[{"row": "z", "lat": NaN}]', "fence": '```JSON [{"row":"f"}] ```',
    }
    out = assist.parse_results(spark.createDataFrame(list(replies.items()), "name string, text string"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("name", "result_seq").collect():
        got.setdefault(r.name, []).append(r)
    assert set(got) == {"half", "escapes", "kinds", "strings", "fence"}
    (half,), (escapes,), (strings,) = got["half"], got["escapes"], got["strings"]
    assert half.row == "a" and half["del"] and half.note.startswith("x") and half.note.endswith(" y")
    assert escapes.note == 'he said "[]" \\' and escapes.need_prev and not escapes.need_next
    assert len(strings.row) == 50_000 and strings.note == "n" * 400
    one, two, three = got["kinds"]
    assert (one.row, one.lat, one.lon, one["del"], one.cols, one.verdict) == ("5", None, None, False, ["", "c"], None)
    assert (two.row, two.lat, two.lon) == ("5", -90.0, 15.0) and (three.row, three.verdict, three.notes_col, three.result_seq) == ("1.5", "ok", "n", 2)


def test_formats_stay_small(spark):
    """Nested formats share their parts, so that generated code stays within Java's bounds."""
    plan = spark.range(3).select(col.format_dms(F.col("id").cast("double") / 7, "lat"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_no_python_over_the_rows(spark):
    data = [(f"r{i}", i, 1.5, None, None, None) for i in range(20)]
    df = spark.createDataFrame(data, "row_id string, i int, lat double, lon double, lat_raw string, lon_raw string")
    df = df.withColumn("row_seq", rows.row_seq(0, 0, 0, 0, F.col("i"))).withColumns({"cells": F.array(F.lit("a"), F.lit("b")), "notes": F.lit(""), "file_id": F.lit("f")})
    filled = rows.fill_rows(df, df.select("row_id"), "lat", "2°W")
    assert "Python" not in filled._jdf.queryExecution().executedPlan().toString()
    assert {r.lat for r in filled.collect()} == {-2.0}
    edits = spark.createDataFrame([("r1", "lat", "12°30'N"), ("r1", "0", "x"), ("r2", "lat", " "), ("r3", "lat", "what"), ("r4", "lon", "91"), ("r5", "notes", None)], "row_id string, column string, value string")
    got = {r.row_id: r for r in rows.apply_edits(df, edits).collect()}
    assert (got["r1"].lat, got["r1"].cells) == (12.5, ["x", "b"]) and got["r2"].lat is None and (got["r3"].lat, got["r3"].lat_raw) == (None, "what")
    assert got["r4"].lon == 91 and got["r5"].notes == "" and got["r6"].lat == 1.5


def test_cross_pairs_that_share_a_half(spark):
    """A page with a lone latitude between two longitudes belongs to the earlier break."""
    pages = [("f", p, t) for p, t in enumerate(['x 2°10\'26"E,', '41°24\'12"N,', '3°10\'26"E x', "none", 'x 41°24\'12"N,', '2°10\'26"E x'], 1)]
    df = spark.createDataFrame(pages * 1, "file_id string, page_num int, text string")
    files = spark.createDataFrame([("f", None)], "file_id string, intensity int")
    none = spark.createDataFrame([], "file_id string, page_num int, half string, start int")
    found, _ = extract.scan_corpus(df, files, none)
    got = sorted((r.page_num, r.is_cross, r.lat and round(r.lat, 2), r.lon and round(r.lon, 2)) for r in found.collect())
    assert got == [(2, 1, 41.4, 2.17), (3, 0, None, 3.17), (5, 1, 41.4, 2.17)]


def test_breaks_that_are_not_read_have_no_pair(spark):
    """Random texts cut at any place: the filter of breaks loses no pair."""
    rng = random.Random(41)
    bits = ["12", "41.5", "104", "7,25", "59", "°", "o", "O", "'", '"', " ", " ", "\n", "N", "S", "e", "w", "north", "Oeste", "lat", "Lat.", "Longitude", "xLat", "toN", "-", "−", ",", ", ", ";", "and", " by ", "to", "x", "(", ".", ":", "a ", "the "]
    pages = [(f"f{i}", p, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))) for i in range(6000) for p in (1, 2)]
    df = spark.createDataFrame(pages, "file_id string, page_num int, text string")
    got = {r.file_id for r in extract.extract_cross_page(df, level=7).collect()}
    texts = {(f, p): t for f, p, t in pages}
    want = set()
    for i in range(6000):
        tail, head = texts[f"f{i}", 1], texts[f"f{i}", 2]
        for lat, lon in tk.extract(tail + "\n" + head, 7):
            if lat and lon and min(lat.start, lon.start) < len(tail) and max(lat.end, lon.end) > len(tail) + 1:
                want.add(f"f{i}")
    assert got == want and len(want) > 150


def test_boxes_of_a_huge_page(spark):
    """Boxes by bins are those of comparing every item with every range; a range meets few of the page's items."""
    rng = random.Random(4)
    spans, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 1, 1, 2])
        n = rng.choice([1, 3, 7, 20, 700 if i % 500 == 0 else 5])
        spans.append(("f", i % 2, i, at, at + n, float(at), 7.0, 10.0 * n, 9.0))
        at += n
    ranges = [(f"d{i}", "f", i % 2, s, s + rng.choice([0, 1, 5, 60, 300])) for i in range(400) for s in [rng.randrange(at + 50)]]
    ranges += [("all", "f", 0, 0, at + 100), ("long", "f", 1, 500, 2_000_000_000), ("none", "g", 0, 0, 10)]
    items = spark.createDataFrame(spans, "file_id string, page_num int, item_seq int, start int, end int, x double, y double, width double, height double")
    wanted = spark.createDataFrame(ranges, "det_id string, file_id string, page_num int, start int, end int")
    got = {r.det_id: len(r.rects) for r in pagetext.rects_for_range(items, wanted).collect()}
    expected = {d: sum(f == g and p == q and e > s and b < t for g, q, _, b, e, *_ in spans) for d, f, p, s, t in ranges}
    assert got == {d: n for d, n in expected.items() if n}


def test_scans_by_store(spark, tmp_path):
    """Scans by a store equal plain ones; only what is new, changed or at another level is read, equal texts once."""
    both = 'at 41°24\'12"N, 2°10\'26"E'
    pages = [("f", 1, 'found at 41°24\'12"N,'), ("f", 2, '2°10\'26"E as seen'), ("f", 3, None), ("f", 4, "none"), ("g", 1, both), ("g", 2, both), ("h", 1, both + " and more"), ("h", 2, "in 1987")]
    none = spark.createDataFrame([], "file_id string, page_num int, half string, start int")
    base = str(tmp_path / "store")

    def scan(rows_, levels):
        df = spark.createDataFrame(rows_, "file_id string, page_num int, text string")
        files = spark.createDataFrame(list(levels.items()), "file_id string, intensity int")
        before = readings.stored_keys(spark, base).count()
        show = lambda c: sorted((r.row_id, r.page_num, r.lat, r.lon, r.lat_segs, r.lon_segs) for r in c.collect())
        by_store, plain_ = show(readings.scan_by_store(df, files, none, base)), show(extract.scan_coordinates(df, files, none))
        assert by_store == plain_
        return len(by_store), readings.stored_keys(spark, base).count() - before

    first = {"f": None, "g": None, "h": None}
    n, read = scan(pages, first)
    assert n == 4 and read >= 5  # five different texts with digits, and the break of f
    assert scan(pages, first) == (4, 0)
    assert scan(pages, {**first, "h": 7})[1] == 2
    changed = [("h", 2, both + " anew") if p[:2] == ("h", 2) else p for p in pages]
    assert scan(changed, first) == (5, 1)
    # A store whose readings were written twice gives the same.
    twice = spark.read.parquet(base + "/readings")
    twice.write.mode("append").parquet(base + "/readings")
    assert scan(changed, first) == (5, 0)
    assert scan([], first) == (0, 0)


def test_huge_files_are_folded_by_many_tasks(spark):
    """Chunks of files of many pages, gaps in their numbers, pages without rows and over-long ones included."""
    rng = random.Random(12)
    data, want = [], {}
    for f, n in (("a", 3000), ("b", 5), ("c", 700), ("d", 1), ("e", 257)):
        page, chunk, chars, count, first = -3, 0, 0, 0, True
        for _ in range(n):
            page += rng.choice([1, 1, 1, 2, 400])
            size, rows_ = rng.choice([0, 10, 300, 900, 5000]), rng.choice([0, 0, 1, 3, 20, 60])
            if not first and (chars + size + 50 > 1500 or count + rows_ > 40):
                chunk, chars, count = chunk + 1, 0, 0
            first, chars, count = False, chars + size + 50, count + rows_
            data.append((f, page, size, rows_))
            want[f, page] = chunk
    rng.shuffle(data)
    df = spark.createDataFrame(data, "file_id string, page_num int, size int, n_rows long")
    for pages in (64, 10_000):
        out = assist.assign_chunks(df, budget=1500, fold_pages=pages).collect()
        assert len(out) == len(want) and {(r.file_id, r.page_num): r.chunk_id for r in out} == want


def test_preview_takes_the_first_file_in_order(spark):
    pages = spark.createDataFrame([("f10", 1, "ten"), ("f2", 1, "two"), ("f1", 1, "one")], "file_id string, page_num int, text string")
    work = spark.createDataFrame([("f10", 10, "r1", 1, "doc10.pdf", 1, ["", ""], 1.0, 2.0, 1), ("f2", 2, "r2", 2, "doc2.pdf", 1, ["", ""], 1.0, 2.0, 2)], "file_id string, file_seq long, id string, num long, file string, page int, cells array<string>, lat double, lon double, row_seq int")
    (r,) = assist.preview_prompt(pages, work, assist.Tasks()).collect()
    assert r.file_id == "f2" and "two" in r.user


def test_chains_by_pointer_doubling(spark):
    """Random graphs of earlier neighbours, long chains among them, against taking the nodes in order."""
    rng = random.Random(3)
    edges = {(f"a{i:05d}", f"a{i - 1:05d}") for i in range(1, 300)}
    edges |= {(f"b{i:05d}", f"b{rng.randrange(i):05d}") for i in range(1, 200) for _ in range(rng.choice([1, 1, 1, 2, 3]))}
    edges |= {(f"c{i:05d}", f"c{i - 1:05d}") for i in range(1, 400) if rng.random() < 0.8}
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    kept = set()
    for x in nodes:
        if not any((x, y) in edges for y in kept):
            kept.add(x)
    links = spark.createDataFrame(sorted(edges), "node string, earlier string")
    got = extract.settle_shared(links, spark.createDataFrame([(x,) for x in nodes], "node string"))
    assert sorted(r.node for r in got.collect()) == sorted(kept)


@pytest.mark.parametrize("block_pages", [1, 3, 1000])
def test_breaks_across_blocks(spark, block_pages):
    """One file of many pages gives the same breaks as a window over it, gaps in the numbers included."""
    rng = random.Random(block_pages)
    texts, page = [], 0
    for _ in range(200):
        page += rng.choice([1, 1, 1, 2, 7])
        texts.append(("f", page, rng.choice(["found at 41°24'12\"N,", "2°10'26\"E as seen", "", "words alone", "at 41°", "24'12\"N, 2°10'26\"E"])))
    want = set()
    for (_, a, tail), (_, b, head) in zip(texts, texts[1:], strict=False):
        for lat, lon in tk.extract(tail + "\n" + head, 5):
            if lat and lon and min(lat.start, lon.start) < len(tail) and max(lat.end, lon.end) > len(tail) + 1:
                want.add((b, a))
    df = spark.createDataFrame(texts, "file_id string, page_num int, text string")
    found = extract.pairs_over_breaks(extract.page_ends(df), block_pages=block_pages)
    got = {(r.page_num, min(x.page_num for x in r.lat_segs + r.lon_segs)) for r in found.collect()}
    assert got == want and len(want) > 10


def test_files_over_several_batches(spark, tmp_path):
    """A stream that cuts files anywhere gives the rows and detections of one scan, chains over the cuts and repeated batches included."""
    rng = random.Random(21)
    bits = ['x 2°10\'26"E,', '41°24\'12"N,', '3°10\'26"E x', "none", 'x 41°24\'12"N,', '2°10\'26"E x', "found at 41°", "24'12\"N, 2°10'26\"E as seen", 'both 41°24\'12"N, 2°10\'26"E,', '41°24\'12"N, 2°10\'26"E']
    pages = [(f"f{i}", p, rng.choice(bits)) for i in range(60) for p in range(1, 8)]
    files = spark.createDataFrame([(f"f{i}", None) for i in range(60)], "file_id string, intensity int")
    gone = spark.createDataFrame([("f1", 2, "lat", 0), ("f2", 3, "lat", 2)], "file_id string, page_num int, half string, start int")
    df = spark.createDataFrame(pages, "file_id string, page_num int, text string")
    want_rows, want_dets = extract.scan_corpus(df, files, gone)
    for last in (2, 3, 4, 7):
        df.where((F.col("page_num") <= last) & (F.col("page_num") > {2: 0, 3: 2, 4: 3, 7: 4}[last])).write.mode("append").parquet(str(tmp_path / "in"))
        scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), gone).awaitTermination()
    rows_, dets = stream_tables(spark, str(tmp_path / "out"))
    plain_rows = lambda t: sorted(((r.row_id, r.page_num, r.lat, r.lon) for r in t.collect()), key=repr)
    assert plain_rows(rows_) == plain_rows(want_rows)
    plain_dets = lambda t: sorted((r.det_id, r.row_id, r.start, r.end) for r in t.collect())
    assert plain_dets(dets) == plain_dets(want_dets)
    assert any(":1:" in r.row_id for r in rows_.collect())


def test_names_with_underscores_and_depth(spark, tmp_path):
    for name in ("_a.pdf", "_b/c.pdf", "d/_e.PDF", "d/e/f/g/h.pdf", "d/e/f/g/h/i.pdf", ".git/j.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%PDF")
    (tmp_path / "d/e/f/g/h").chmod(0)  # below the depth: would fail, were it opened by another user than root
    got = {r.path.removeprefix(f"{tmp_path}/") for r in corpus.list_corpus(spark, str(tmp_path)).collect()}
    assert got == {"_a.pdf", "_b/c.pdf", "d/_e.PDF", "d/e/f/g/h.pdf"}
    (tmp_path / "d/e/f/g/h").chmod(0o755)
    assert corpus.list_corpus(spark, f"file://{tmp_path}", max_depth=None, max_files=None).count() == 5
    opened = []
    reader = folder.FolderReader(str(tmp_path), 4)
    entries, folder._entries = folder._entries, lambda f: (opened.append(f), entries(f))[1]
    try:
        found = [p for part in reader.partitions() for (p,) in reader.read(part)]
    finally:
        folder._entries = entries
    assert len(found) == 4 and not any(f.endswith("g/h") or ".git" in f for f in opened)


def test_failed_save_leaves_the_project(spark, tmp_path):
    base = str(tmp_path / "projects")
    files = spark.createDataFrame([("f1", 1, False)], "file_id string, file_seq long, hidden boolean")
    rows_ = spark.createDataFrame([("r1", ["a"], None)], "row_id string, cells array<string>, notes string")
    tables = {"files": files, "rows": rows_, "dets": rows_.select("row_id"), "suppressed": rows_.select("row_id")}
    project.save_project(tables, base, "p", "First", ["A", "B"], level=3)
    broken = tables | {"dets": rows_.select(F.raise_error(F.lit("no")).alias("row_id"))}
    with pytest.raises(Exception, match="no"):
        project.save_project(broken | {"rows": rows_.withColumn("row_id", F.lit("r2"))}, base, "p", "Second", ["A"])
    loaded, settings = project.load_project(spark, base, "p")
    assert settings == {"name": "First", "cols": ["A", "B"], "fmt": "dd", "level": 3}
    assert [(r.row_id, r.cells, r.notes) for r in loaded["rows"].collect()] == [("r1", ["a", ""], "")]
    # A project may be saved over itself, and old versions be emptied.
    project.save_project(loaded | {"rows": loaded["rows"].withColumn("notes", F.lit("seen"))}, base, "p", "Third", ["A", "B"])
    project.drop_old_versions(spark, base, "p")
    loaded, settings = project.load_project(spark, base, "p")
    assert settings["name"] == "Third" and [r.notes for r in loaded["rows"].collect()] == ["seen"]
    assert [r.name for r in project.list_projects(spark, base).collect()] == ["Third"]
    project.delete_project(spark, base, "p")
    assert project.list_projects(spark, base).count() == 0 and loaded["rows"].sparkSession.read.parquet(f"{base}/versions/*/rows").count() == 0
    with pytest.raises(KeyError):
        project.load_project(spark, base, "p")


def test_fill_by_ranks_equals_fill_by_numbers(spark, tmp_path):
    """Random tables with hidden files, rows added by hand, repeated places, additions and removals, in ranges of ten rows."""
    rng = random.Random(8)
    schema = "row_id string, file_id string, cells array<string>, notes string, s int, f long, p int, c int, i long"

    def some(n, tag):
        return [(f"{tag}{k}", (f := rng.choice(["a", "b", "c", None])), ["x", "y"], "", 0 if f else 2, "abc".find(f or "a") + 1, rng.randrange(4), 0, rng.randrange(9)) for k in range(n)]

    def table(data):
        return spark.createDataFrame(data, schema).select("row_id", rows.row_seq(*(F.col(c) for c in "sfpci")).alias("row_seq"), "file_id", "cells", "notes")

    files = spark.createDataFrame([("a", 1, False), ("b", 2, True), ("c", 3, False)], "file_id string, file_seq long, hidden boolean")
    old, more = some(120, "r"), some(30, "n")
    base = str(tmp_path / "ranks")
    ranks.build_ranks(table(old), base, 10)
    ranks.note_changes(table(more), base, 1)
    ranks.note_changes(table(old[::4]), base, -1)
    now = table([r for k, r in enumerate(old) if k % 4] + more)
    n = rows.visible_rows(now, files).count()
    for first, last in [(1, 1), (30, 7), (-3, 5), (n - 2, n + 50), (n + 1, n + 9), (0, 0), (1, n)]:
        want = {r.row_id: r.cells for r in rows.fill_range(now, files, first, last, "1", "v").collect()}
        got = ranks.fill_range_by_ranks(now, files, base, first, last, "1", "v")
        assert {r.row_id: r.cells for r in got.collect()} == want, (first, last)
        assert got.columns == now.columns
    plan = ranks.fill_range_by_ranks(now, files, base, 3, 9, "1", "v")._jdf.queryExecution().toString()
    assert "Sort [" not in plan and "SortMergeJoin" not in plan


def test_ranks_of_an_empty_table(spark, tmp_path):
    files = spark.createDataFrame([], "file_id string, file_seq long, hidden boolean")
    none = spark.createDataFrame([], "row_id string, file_id string, cells array<string>, notes string").withColumn("row_seq", rows.row_seq())
    base = str(tmp_path / "ranks")
    ranks.build_ranks(none, base)
    assert ranks.places_of(none, files, base, [1]) == [None]
    assert ranks.fill_range_by_ranks(none, files, base, 1, 5, "notes", "v").count() == 0


def test_equal_texts_are_read_once():
    """Of equal values in a batch one is read, and every row gets all that is found in its own."""
    texts = ["at 41.5N, 2.5E and 3.5S, 4.5W", "none", "in 12.25", "at 41.5N, 2.5E and 3.5S, 4.5W", None, "in 12.25"] * 50
    batch = extract.pa.RecordBatch.from_arrays([extract.pa.array(texts), extract.pa.array([5] * 299 + [6], extract.pa.int32())], names=["text", "level"])
    read = []
    row, index, (lat, lon) = extract.read_once(batch, ("text", "level"), 2, lambda text, n: (read.append((text, n)), tk.extract(text or "", n))[1])
    assert len(read) == len(set(read)) == 5
    want = [(r, i, *pair) for r, t in enumerate(texts) for i, pair in enumerate(tk.extract(t or "", batch.column("level")[r].as_py()))]
    got = zip(row.tolist(), index.to_pylist(), lat.to_pylist(), lon.to_pylist(), strict=True)
    assert [(r, i, a and tuple(a.values()), b and tuple(b.values())) for r, i, a, b in got] == [(r, i, a and tuple(a), b and tuple(b)) for r, i, a, b in want]


def test_levels_share_a_reading(monkeypatch):
    """Pairs at all levels equal those of each by itself; a text of tokens that all levels take is read once."""
    rng = random.Random(5)
    bits = ["12", "41.5", "104", "7,25", "59", "3.1234", "1987", "°", "'", '"', " ", " ", "\n", "N", "S", "e", "w", "lat", "Lat.", "Longitude", "-", ",", ", ", ";", "and", "by", "(", ".", "a "]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 20)))
        assert tk.extract_at_levels(text, [*range(1, 8), 0, 9]) == [tk.extract(text, n) for n in [*range(1, 8), 0, 9]], text
    read, own = [], tk.find_tokens
    monkeypatch.setattr(tk, "find_tokens", lambda text, n=5: (read.append(n), own(text, n))[1])
    assert len(tk.extract_at_levels('at 41°24\'12"N, 2°10\'26"E', range(1, 8))) == 7 and len(read) == 1


def test_bits_of_ends(spark):
    """What a page's ends are told by in Python equals what Spark's expressions tell."""
    rng = random.Random(6)
    bits = ["12", "41.5", "°", "o", "O", "'", '"', " ", "\n", "\u2009", "N", "S", "e", "north", "Oeste", "lat", "Lat.", "xLat", "toN", "-", "−", ",", "and", "AND", "x", "(", "a ", "the ", "ſ", "\u212a"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for i in range(5000)]
    df = spark.createDataFrame(texts, "i int, head string").withColumn("tail", F.col("head"))
    got = {r.i: (r.h, r.t) for r in df.select("i", extract._bits("head").alias("h"), extract._bits("tail").alias("t")).collect()}
    assert got == {i: (extract.bits_of("head", t), extract.bits_of("tail", t)) for i, t in texts}


@pytest.mark.parametrize("n", [99_999])
def test_few_slices_of_many_requests(spark, n):
    """The number of slices grows as the logarithm of that of requests; every request is answered once."""
    began = []
    write, call = assist.call_model, lambda some, *a: (began.append(1), write(some, *a))[1]
    assist.call_model = call
    try:
        out = assist.call_in_slices(spark.range(1, n + 1).selectExpr("id as request_seq", "cast(id as string) as body"), lambda body: (200, body), slice_size=1_000)
    finally:
        assist.call_model = write
    assert len(began) < 20
    assert out.where("status = 200 and response = cast(request_seq as string)").select("request_seq").distinct().count() == out.count() == n


def _reads(df) -> set[str]:
    """The tables that a result's plan reads: folders of written ones without their numbers."""
    return {os.path.basename(os.path.dirname(f))[:-33] if "/part-" in f else os.path.basename(f) for f in df.inputFiles()}


@needs_data
def test_a_rescan_merges_once(spark):
    """Claims are found once, and duplicates are looked for in the merged table as written, not in the merge made anew."""
    assert "claims" in _reads(q.QUERIES["r5_rescan_merge"](spark, DATA))
    assert _reads(q.QUERIES["r5_rescan_dedup"](spark, DATA)) == {"rows", "orders.parquet"}


@needs_data
def test_items_are_placed_once(spark):
    """Texts and boxes of a scan come from one pass over its items, which the boxes read as written."""
    assert _reads(q.QUERIES["w2_scan_job"](spark, DATA)) == {"pieces", "coordinates"}
