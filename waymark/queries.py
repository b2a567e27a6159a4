"""One registered query per operator over tables derived from the given ones, with its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import columns as col
from .operators import assist, extract, pagetext, ranks, readings, rows, summary
from .plans import jobs
from .sources import corpus, csv, project, shared
from .streaming.scan import scan_stream, stream_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COLS = ["Type", "Detail"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _values(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"lat_micro": fx.micro(F.col("lat.dd")), "lon_micro": fx.micro(F.col("lon.dd"))})


P = f"WITH {fx.PLANTED_SQL} "
E_ = f"WITH {fx.EVENTS_SQL} "
I_ = f"WITH {fx.ITEMS_SQL} "

# Extraction


@query("e1_intensity_rules", "SELECT l AS level, CASE WHEN l>=6 THEN 1 ELSE 2 END AS weak_decimals, l=7 AS allow_bare, [22,26,30,36,44,64,84][l] AS max_gap, count(*) AS n FROM (SELECT CASE WHEN o_custkey%9=0 THEN 5 WHEN o_custkey%9=8 THEN 7 ELSE CAST(o_custkey%9 AS INTEGER) END AS l FROM orders) GROUP BY 1,2,3,4")
def e1(spark, d):
    from .functions.tokens import intensity_rules

    rules = spark.createDataFrame([(a, r.level, r.weak_decimals, r.allow_bare, r.max_gap) for a in range(9) for r in [intensity_rules(a)]], "asked long, level int, weak_decimals int, allow_bare boolean, max_gap int")
    asked = fx.table(spark, d, "orders").select((F.col("o_custkey") % 9).alias("asked"))
    return asked.join(F.broadcast(rules), "asked").groupBy("level", "weak_decimals", "allow_bare", "max_gap").agg(F.count("*").alias("n"))


@query("e2_find_tokens", P + "SELECT file_id, CAST(page_num + i AS INTEGER) AS page_num, CAST(CASE WHEN n_pages=1 THEN 2 ELSE 1 END AS BIGINT) AS n_tokens FROM planted, range(0, 2) t(i) WHERE i < n_pages")
def e2(spark, d):
    return extract.find_tokens(fx.planted_pages(spark, d)).groupBy("file_id", "page_num").agg(F.count("*").alias("n_tokens"))


@query("e3_judge_tokens", P + "SELECT file_id, page_num, u AS micro, axis, strength, style<4 AS is_dms FROM (SELECT *, lat_micro u, 'lat' axis, CASE WHEN style=5 THEN 'medium' ELSE 'strong' END strength FROM planted UNION ALL SELECT *, lon_micro u, 'lon' axis, CASE WHEN style=5 THEN 'medium' ELSE 'strong' END strength FROM planted) WHERE n_pages=1")
def e3(spark, d):
    single = fx._planted(spark, d).where("n_pages = 1").select("file_id", "page_num")
    t = extract.find_tokens(fx.planted_pages(spark, d)).join(single, ["file_id", "page_num"], "left_semi")
    return t.select("file_id", "page_num", fx.micro(F.col("token.dd")).alias("micro"), "token.axis", "token.strength", "token.is_dms")


@query("e5_extract_coordinates", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted WHERE n_pages=1")
def e5(spark, d):
    pairs = extract.extract_coordinates(fx.planted_pages(spark, d)).where("lat is not null and lon is not null")
    return _values(pairs).select("file_id", "page_num", "lat_micro", "lon_micro")


@query("e4_pair_tokens_by_level", P + "SELECT l AS level, CAST(count(*) FILTER (n_pages=1 AND (l>=5 OR style<>5)) AS BIGINT) AS n_pairs FROM planted, range(1,8) t(l) GROUP BY l")
def e4(spark, d):
    pairs = extract.extract_at_levels(fx.planted_pages(spark, d)).where("lat is not null and lon is not null")
    return pairs.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n_pairs"))


@query("e4_pair_tokens", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted WHERE n_pages=1")
def e4_pairs(spark, d):
    pages = fx.planted_pages(spark, d)
    pairs = extract.pair_tokens(extract.find_tokens(pages), pages).where("lat is not null and lon is not null")
    return _values(pairs).select("file_id", "page_num", "lat_micro", "lon_micro")


@query("e6_effective_intensity", P + "SELECT file_id, CAST(CASE WHEN o_custkey%3=0 THEN 7 ELSE 5 END AS INTEGER) AS level FROM (SELECT DISTINCT file_id, o_custkey FROM planted)")
def e6(spark, d):
    files = fx.planted_files(spark, d).withColumn("intensity", F.when(F.col("file_seq") % 3 == 0, 7))
    return files.select("file_id", extract.effective_intensity(5).alias("level"))


@query("e7_extract_cross_page", P + "SELECT file_id, CAST(page_num+1 AS INTEGER) AS page_num, lat_micro, lon_micro, page_num AS lat_page, lat_start FROM planted WHERE n_pages=2")
def e7(spark, d):
    first = F.get("lat_segs", F.lit(0))
    return _values(extract.extract_cross_page(fx.planted_pages(spark, d))).select("file_id", "page_num", "lat_micro", "lon_micro", first["page_num"].alias("lat_page"), first["start"].alias("lat_start"))


@query("e8_merge_cross_page", P + "SELECT file_id, CASE WHEN n_pages=2 THEN 1 ELSE 0 END AS is_cross, lat_micro, lon_micro FROM planted WHERE n_pages=1 OR k%7<>0 UNION ALL SELECT file_id, 0, CASE WHEN i=0 THEN lat_micro END, CASE WHEN i=1 THEN lon_micro END FROM planted, range(0,2) t(i) WHERE n_pages=2 AND k%7=0 AND style<>5")
def e8(spark, d):
    pages = fx.planted_pages(spark, d)
    own, cross = (shared.written(x, "found") for x in (extract.extract_coordinates(pages), extract.extract_cross_page(pages)))
    own, cross = extract.merge_cross_page(own, cross, fx.planted_suppressed(spark, d))
    return _values(extract.located(own, cross)).select("file_id", "is_cross", "lat_micro", "lon_micro")


@query("e10_build_detections", P + "SELECT file_id, page_num, 'lat' AS half, lat_start AS start, lat_end AS \"end\", lat_text AS raw FROM ranges WHERE n_pages=1 UNION ALL SELECT file_id, page_num, 'lon', lon_start, lon_end, lon_text FROM ranges WHERE n_pages=1")
def e10(spark, d):
    pairs = extract.extract_coordinates(fx.planted_pages(spark, d)).where("lat is not null and lon is not null")
    empty = extract.extract_cross_page(fx.planted_pages(spark, d)).limit(0)
    return extract.build_detections(extract.located(pairs, empty)).select("file_id", "page_num", "half", "start", "end", "raw")


@query("e11_scan_corpus", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted")
def e11(spark, d):
    found, _ = extract.scan_corpus(fx.planted_pages(spark, d), fx.planted_files(spark, d), fx.no_places(spark))
    return found.select("file_id", "page_num", fx.micro(F.col("lat")).alias("lat_micro"), fx.micro(F.col("lon")).alias("lon_micro"))


@query("e5_noise_documents")
def e5_noise(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.lit(1).alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))
    return extract.extract_coordinates(docs, level=7).select("file_id", "pair_idx", F.col("lat.dd").alias("lat"), F.col("lon.dd").alias("lon"))


@query("r3_location_keys", P + "SELECT file_id, page_num, 'lat' AS half, lat_start AS start FROM ranges WHERE n_pages=1 UNION ALL SELECT file_id, page_num, 'lon', lon_start FROM ranges WHERE n_pages=1")
def r3(spark, d):
    return rows.location_keys(extract.extract_coordinates(fx.planted_pages(spark, d)).where("lat is not null and lon is not null"))


@query("r4_drop_suppressed", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted WHERE n_pages=1 AND k%7<>0")
def r4(spark, d):
    pairs = extract.extract_coordinates(fx.planted_pages(spark, d)).where("lat is not null and lon is not null")
    return _values(extract.drop_suppressed(pairs, fx.planted_suppressed(spark, d))).select("file_id", "page_num", "lat_micro", "lon_micro")


@query("w1_entry_table", P + "SELECT p.file_id, p.page_num, p.lat_micro, p.lon_micro FROM planted p JOIN pfiles f USING (file_id) WHERE NOT f.hidden AND n_pages=1")
def w1(spark, d):
    files = fx.planted_files(spark, d)
    pairs = extract.extract_coordinates(fx.planted_pages(spark, d), files).where("lat is not null and lon is not null")
    return _values(rows.visible_rows(pairs, files)).select("file_id", "page_num", "lat_micro", "lon_micro")


# The same over all planted pages, pairs across page breaks and lone halves included


def _scanned(spark, d, suppressed=None):
    return extract.scan_coordinates(fx.planted_pages(spark, d), fx.planted_files(spark, d), fx.no_places(spark) if suppressed is None else suppressed)


#: Ranges of both halves; the second page of a broken coordinate begins with its longitude.
HALVES = "halves AS (SELECT *, 'lat' AS half, page_num AS pg, lat_start AS s, lat_end AS e, lat_text AS raw FROM ranges UNION ALL SELECT *, 'lon', CAST(page_num + n_pages - 1 AS INTEGER), CASE WHEN n_pages=2 THEN 0 ELSE lon_start END, CASE WHEN n_pages=2 THEN length(lon_text) + CASE WHEN style=5 THEN 1 ELSE 0 END ELSE lon_end END, lon_text FROM ranges)"
H_ = f"WITH {fx.PLANTED_SQL}, {HALVES} "


@query("e3_judge_tokens_all_pages", H_ + "SELECT file_id, pg AS page_num, CASE WHEN half='lat' THEN lat_micro ELSE lon_micro END AS micro, half AS axis, CASE WHEN style=5 THEN 'medium' ELSE 'strong' END AS strength, style<4 AS is_dms FROM halves")
def e3_all(spark, d):
    t = extract.find_tokens(fx.planted_pages(spark, d))
    return t.select("file_id", "page_num", fx.micro(F.col("token.dd")).alias("micro"), "token.axis", "token.strength", "token.is_dms")


@query("e10_build_detections_all_pages", H_ + "SELECT file_id, pg AS page_num, half, s AS start, e AS \"end\", raw FROM halves")
def e10_all(spark, d):
    return extract.build_detections(_scanned(spark, d)).select("file_id", "page_num", "half", "start", "end", "raw")


@query("r3_location_keys_all_pages", H_ + "SELECT file_id, pg AS page_num, half, s AS start FROM halves")
def r3_all(spark, d):
    return rows.location_keys(_scanned(spark, d))


@query("r4_drop_suppressed_all_pages", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted WHERE k%7<>0 UNION ALL SELECT file_id, CAST(page_num + 1 AS INTEGER), NULL, lon_micro FROM planted WHERE k%7=0 AND n_pages=2 AND style<>5")
def r4_all(spark, d):
    return _values(_scanned(spark, d, fx.planted_suppressed(spark, d))).select("file_id", "page_num", "lat_micro", "lon_micro")


@query("w1_entry_table_all_pages", P + "SELECT p.file_id, p.page_num, p.lat_micro, p.lon_micro FROM planted p JOIN pfiles f USING (file_id) WHERE NOT f.hidden")
def w1_all(spark, d):
    return _values(rows.visible_rows(_scanned(spark, d), fx.planted_files(spark, d))).select("file_id", "page_num", "lat_micro", "lon_micro")


@query("e10_split_tokens", "WITH o AS (SELECT *, CAST(o_orderkey*37%90 AS VARCHAR) d, (o_orderkey*11%60) || chr(39) || (o_orderkey*7%60) || '\"N' AS rest, (o_orderkey*53%180) || '°' || (o_orderkey*13%60) || chr(39) || (o_orderkey*17%60) || '\"E' AS lon FROM orders) "
    f"SELECT 's' || o_orderkey AS file_id, 1 AS page_num, 'lat' AS half, 0 AS seg, {len(fx.LEAD) - 1} AS start, CAST({len(fx.LEAD)} + length(d) + 1 AS INTEGER) AS \"end\" FROM o "
    "UNION ALL SELECT 's' || o_orderkey, 2, 'lat', 1, 0, CAST(length(rest) AS INTEGER) FROM o UNION ALL SELECT 's' || o_orderkey, 2, 'lon', 0, CAST(length(rest) + 1 AS INTEGER), CAST(length(rest) + 2 + length(lon) AS INTEGER) FROM o")  # fmt: skip
def e10_split(spark, d):
    pages = fx.split_pages(spark, d)
    files = pages.select("file_id").distinct().withColumn("intensity", F.lit(None).cast("int"))
    coords = extract.scan_coordinates(pages, files, fx.no_places(spark))
    return extract.build_detections(coords).select("file_id", "page_num", "half", "seg", "start", "end")


@query("w2_scan_job", f"WITH {fx.PLANTED_SQL}, {HALVES}, texts AS (SELECT file_id, page_num AS pg, CASE WHEN n_pages=1 THEN '{fx.LEAD}' || lat_text || ', ' || lon_text || '{fx.REAR}' ELSE '{fx.LEAD}' || lat_text || ',' END AS t FROM planted UNION ALL SELECT file_id, CAST(page_num+1 AS INTEGER), lon_text || '{fx.REAR}' FROM planted WHERE n_pages=2), "
    "split AS (SELECT file_id, pg, string_split(t, ' ') w FROM texts), words AS (SELECT file_id, pg, length(w[i]) n, coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x)+1)), 0) pos FROM split, unnest(range(1, len(w)+1)) u(i)) "
    "SELECT file_id, pg AS page_num, half, raw, count(*) AS n_boxes, CAST(sum(10*greatest(s, pos)) AS BIGINT) AS left_sum, CAST(sum(10*least(e, pos+n)) AS BIGINT) AS right_sum, 697.2::DOUBLE AS bottom FROM halves JOIN words USING (file_id, pg) WHERE pos+n > s AND pos < e GROUP BY 1, 2, 3, 4")  # fmt: skip
def w2(spark, d):
    dets = jobs.scan_job(fx.planted_items(spark, d), fx.planted_files(spark, d), fx.no_places(spark))["dets"]
    box = dets.select("file_id", "page_num", "half", "raw", F.explode("rects").alias("b"))
    total = lambda i: F.sum(F.round(F.col("b")[i])).cast("long")
    return box.groupBy("file_id", "page_num", "half", "raw").agg(F.count("*").alias("n_boxes"), total(0).alias("left_sum"), total(2).alias("right_sum"), F.round(F.max(F.col("b")[1]), 6).alias("bottom"))


# Page text


@query("s2_build_page_text", I_ + "SELECT file_id, page_num, string_agg(piece, '' ORDER BY item_seq) AS text FROM pieces GROUP BY 1, 2")
def s2(spark, d):
    return pagetext.build_page_text(fx.word_items(spark, d))


@query("s3_page_spans", I_ + "SELECT file_id, page_num, item_seq, CAST(b + length(d) AS BIGINT) AS start, CAST(b + length(d) + length(str) AS BIGINT) AS \"end\" FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY file_id, page_num ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM pieces) WHERE filled")
def s3(spark, d):
    return pagetext.page_spans(fx.word_items(spark, d)).select("file_id", "page_num", "item_seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("e9_rects_for_range", I_ + "SELECT file_id, page_num, count(*) AS n_boxes, CAST(sum(round(1000*(x + 16.0*(greatest(10, s)-s)/length(str)))) AS BIGINT) AS left_sum, CAST(sum(round(1000*(y + h*1.02))) AS BIGINT) AS top_sum FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY file_id, page_num ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(d) s FROM pieces) WHERE filled AND s + length(str) > 10 AND s < 60 GROUP BY 1, 2")
def e9(spark, d):
    spans = pagetext.page_spans(fx.word_items(spark, d))
    pages = spans.select("file_id", "page_num").distinct()
    ranges = pages.select(F.concat_ws(":", "file_id", "page_num").alias("det_id"), "file_id", "page_num", F.lit(10).alias("start"), F.lit(60).alias("end"))
    boxes = pagetext.rects_for_range(spans, ranges).join(ranges, "det_id").select("file_id", "page_num", F.explode("rects").alias("b"))
    thousandth = lambda i: F.sum(F.round(F.col("b")[i] * 1000)).cast("long")
    return boxes.groupBy("file_id", "page_num").agg(F.count("*").alias("n_boxes"), thousandth(0).alias("left_sum"), thousandth(3).alias("top_sum"))


# Formatting


def _numbers(spark, d):
    x = (F.col("event_id") * 7919 % 18000000 - 9000000).cast("double") / 100000
    return fx.table(spark, d, "events").select("event_id", x.alias("x"))


X = "(SELECT event_id, ((event_id*7919)%18000000 - 9000000)::DOUBLE/100000 x FROM events)"
DD = lambda x: f"CASE WHEN {x} IS NULL THEN '' ELSE regexp_replace(regexp_replace(printf('%.6f', {x}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '.0') END"


@query("c2_format_dd", f"SELECT event_id, {DD('x')} AS dd FROM {X}")
def c2(spark, d):
    return _numbers(spark, d).select("event_id", col.format_dd(F.col("x")).alias("dd"))


@query("c3_format_dms", f"""WITH a AS (SELECT event_id, x, floor(abs(x)) g, (abs(x)-floor(abs(x)))*60 mf FROM {X}), b AS (SELECT *, floor(mf) m, (mf-floor(mf))*60 s FROM a),
 c AS (SELECT *, printf('%.2f', s)::DOUBLE >= 60 o FROM b), e AS (SELECT *, CASE WHEN o THEN 0.0 ELSE s END s2, m + CASE WHEN o THEN 1 ELSE 0 END m2 FROM c),
 f AS (SELECT *, g + CASE WHEN m2>=60 THEN 1 ELSE 0 END g3, CASE WHEN m2>=60 THEN 0 ELSE m2 END m3, regexp_replace(regexp_replace(printf('%.2f', s2), '\\.00$', ''), '(\\.[0-9])0$', '\\1') st FROM e)
 SELECT event_id, CAST(g3 AS BIGINT) || '°' || lpad(CAST(m3 AS BIGINT)::VARCHAR, 2, '0') || '''' || CASE WHEN length(st)<2 THEN '0' || st ELSE st END || '"' || CASE WHEN x<0 THEN 'S' ELSE 'N' END AS dms FROM f""")
def c3(spark, d):
    return _numbers(spark, d).select("event_id", col.format_dms(F.col("x"), "lat").alias("dms"))


@query("c4_to_fixed", f"SELECT event_id, printf('%.6f', x) AS six, printf('%.2f', (event_id%999)/8.0::DOUBLE + 0.0001) AS two FROM {X}")
def c4(spark, d):
    return _numbers(spark, d).select("event_id", col.to_fixed(F.col("x"), 6).alias("six"), col.to_fixed(F.col("event_id") % 999 / 8.0 + 0.0001, 2).alias("two"))


@query("c1_parse_single", P + "SELECT k, CASE WHEN k%3=0 THEN NULL ELSE CASE WHEN k%3=1 THEN lat_micro ELSE 1000000*(k%200-100) END END * CASE WHEN k%3=2 AND abs(k%200-100)>90 THEN NULL ELSE 1 END AS micro FROM planted")
def c1(spark, d):
    p = fx._planted(spark, d)
    typed = F.when(F.col("k") % 3 == 0, "none here").when(F.col("k") % 3 == 1, F.concat(F.lit("  "), "lat_text", F.lit(" "))).otherwise((F.col("k") % 200 - 100).cast("string"))
    return rows.parse_single(p.select("k", typed.alias("typed")), "typed", "lat", "dd").select("k", fx.micro(F.col("dd")).alias("micro"))


CELL = lambda v, raw: f"CASE WHEN {raw} IS NOT NULL THEN {raw} ELSE {DD(v)} END"
ESC = lambda s: f"""CASE WHEN regexp_matches({s}, '[",\\n\\r]') THEN '"' || replace({s}, '"', '""') || '"' ELSE {s} END"""


@query("c5_cell_text", E_ + f"SELECT row_id, {CELL('lat', 'lat_raw')} AS lat_text, {CELL('lon', 'lon_raw')} AS lon_text FROM erows")
def c5(spark, d):
    return fx.event_rows(spark, d).select("row_id", *(col.cell_text(h, "dd", "dd").alias(f"{h}_text") for h in ("lat", "lon")))


@query("c6_apply_edits", E_ + "SELECT row_id, c0, CASE WHEN e%6=1 THEN 'edited' ELSE c1 END AS c1, CASE WHEN e%6=2 THEN NULL WHEN e%6=3 THEN 12.5 WHEN e%6=4 THEN NULL ELSE lat END AS lat, CASE WHEN e%6 IN (2,3) THEN NULL WHEN e%6=4 THEN 'what' ELSE lat_raw END AS lat_raw FROM erows")
def c6(spark, d):
    base = fx.event_rows(spark, d)
    e = F.expr("cast(substring(row_id, 2) as long)") % 6
    edits = base.where(e.between(1, 4)).select("row_id", F.when(e == 1, "1").otherwise("lat").alias("column"), F.when(e == 1, "edited").when(e == 2, " ").when(e == 3, "12°30'N").otherwise("what").alias("value"))
    return rows.apply_edits(base, edits).select("row_id", col.cell(0).alias("c0"), col.cell(1).alias("c1"), "lat", "lat_raw")


@query("c7_one_word", "SELECT conv_id, turn, coalesce(regexp_extract(text, '[^ \\n\\t]+'), '') AS word FROM conversations")
def c7(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", col.one_word(F.concat(F.lit("  "), "text")).alias("word"))


@query("s5_csv_escape", E_ + f"SELECT row_id, {ESC('c1')} AS field FROM erows")
def s5(spark, d):
    return fx.event_rows(spark, d).select("row_id", col.csv_escape(col.cell(1)).alias("field"))


@query("s4_export_csv", E_ + f"SELECT {ESC('c0')} || ',' || {ESC('c1')} || ',' || {ESC('(' + CELL('lat', 'lat_raw') + ')')} || ',' || {ESC('(' + CELL('lon', 'lon_raw') + ')')} || ',' || {ESC('notes')} AS value FROM visible UNION ALL SELECT 'Type,Detail,Latitude (DD),Longitude (DD),Notes'")
def s4(spark, d):
    path = f"{shared.shared_folder(spark)}/csv-{shared.unique()}"
    csv.export_csv(fx.event_rows(spark, d), fx.event_files(spark, d), COLS, path, notes_on=True)
    return spark.read.option("lineSep", "\r\n").text(path)


# The table of rows


@query("r1_visible_rows", E_ + "SELECT row_id FROM visible")
def r1(spark, d):
    return rows.visible_rows(fx.event_rows(spark, d), fx.event_files(spark, d)).select("row_id")


def _event_dets(spark, d):
    r = fx.event_rows(spark, d).where("file_id is not null and lat is not null")
    return r.select(F.concat(F.lit("d"), "row_id").alias("det_id"), "file_id", "page_num", F.lit("lat").alias("half"), F.lit(0).alias("seg"), F.col("row_seq.pair_idx").cast("int").alias("start"), "row_id")


EDETS = "edets AS (SELECT row_id, file_id, page_num, 'lat' half, CAST(e AS INTEGER) AS start FROM erows WHERE file_id IS NOT NULL AND lat IS NOT NULL)"


@query("r2_remove_rows", E_ + f", {EDETS} SELECT 'row' AS kind, row_id AS what, 0 AS start FROM erows WHERE e%31<>0 UNION ALL SELECT 'det', row_id, start FROM edets WHERE start%31<>0 UNION ALL SELECT 'place', file_id, start FROM edets WHERE start%31=0")
def r2(spark, d):
    base, dets = fx.event_rows(spark, d), _event_dets(spark, d)
    ids = base.where(F.col("row_seq.pair_idx") % 31 == 0).select("row_id")
    left, left_dets, places = rows.remove_rows(base, dets, fx.no_places(spark), ids)
    out = left.select(F.lit("row").alias("kind"), F.col("row_id").alias("what"), F.lit(0).alias("start"))
    return out.union(left_dets.select(F.lit("det"), "row_id", "start")).union(places.select(F.lit("place"), "file_id", "start"))


@query("r5_rescan_merge", P + "SELECT file_id, page_num, lat_micro, lon_micro, CASE WHEN k%7<>0 THEN CASE WHEN k%4=1 THEN 'edited' ELSE '' END ELSE '' END AS c0 FROM planted WHERE o_custkey%13<>0 AND k%7<>0 UNION ALL SELECT file_id, CAST(page_num+1 AS INTEGER), lat_micro, lon_micro, CASE WHEN k%4=1 THEN 'edited' ELSE '' END FROM planted WHERE o_custkey%13<>0 AND k%7=0 AND n_pages=2 AND style<>5 UNION ALL SELECT file_id, page_num, lat_micro, lon_micro, CASE WHEN k%4=1 THEN 'edited' ELSE '' END FROM planted WHERE o_custkey%13=0")
def r5(spark, d):
    pages, files = fx.planted_pages(spark, d), fx.planted_files(spark, d)
    coords = extract.scan_coordinates(pages, files, fx.no_places(spark))
    table = rows.as_table_rows(extract.fresh_rows(coords), files)
    planted = fx._planted(spark, d).where("k % 4 = 1").select("file_id", "page_num", F.lit(True).alias("hit"))
    table = table.join(planted, ["file_id", "page_num"], "left").withColumn("cells", F.when(F.col("hit"), F.array(F.lit("edited"), F.lit(""))).otherwise(F.col("cells"))).drop("hit")
    dets = extract.build_detections(coords).drop("rects")
    # A second scan with the latitudes of every seventh order suppressed: where the break had split the two
    # halves, a strong longitude stays alone and takes over the old row, which keeps its values.
    gone = fx.planted_suppressed(spark, d)
    out = jobs.rescan_job(pages, files, table, dets, gone, level=5)
    lone = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return out["rows"].where(lone).select("file_id", "page_num", fx.micro(F.col("lat")).alias("lat_micro"), fx.micro(F.col("lon")).alias("lon_micro"), F.col("cells")[0].alias("c0"))


@query("r5_rescan_dedup", P + """SELECT file_id, page_num, lat_micro, lon_micro FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey%10=0, lat_micro, lon_micro ORDER BY o_custkey%13=0, o_custkey, page_num) AS i
FROM planted) WHERE i=1 OR o_custkey%10=0""")
def r5_dedup(spark, d):
    """A re-scan that removes the rows whose coordinate an earlier visible row has; hidden files keep theirs, and rows of unread files come last."""
    pages, files = fx.planted_pages(spark, d), fx.planted_files(spark, d)
    coords = extract.scan_coordinates(pages, files, fx.no_places(spark))
    table = rows.as_table_rows(extract.fresh_rows(coords), files)
    out = jobs.rescan_job(pages, files, table, extract.build_detections(coords).drop("rects"), fx.no_places(spark), dedup=True)
    return out["rows"].select("file_id", "page_num", fx.micro(F.col("lat")).alias("lat_micro"), fx.micro(F.col("lon")).alias("lon_micro"))


@query("r17_rescan_by_store", P + "SELECT file_id, count(*) AS n_rows, CAST(sum(lat_micro) AS BIGINT) AS lat_sum, CAST(sum(lon_micro) AS BIGINT) AS lon_sum, CAST(CASE WHEN o_custkey%10=3 THEN sum(n_pages) ELSE 0 END AS BIGINT) AS n_read FROM planted GROUP BY file_id, o_custkey")
def r17_store(spark, d):
    """Every tenth file gets a level of its own after a scan; the second scan reads the pages of these files (n_read) and no others."""
    pages, files, base = fx.planted_pages(spark, d), fx.planted_files(spark, d), f"{shared.shared_folder(spark)}/store-{shared.unique()}"
    readings.scan_by_store(pages, files, fx.no_places(spark), base)
    before = shared.written(readings.stored_keys(spark, base), "before")
    files = files.withColumn("intensity", F.when(F.col("file_seq") % 10 == 3, 6).otherwise(F.col("intensity")))
    found = extract.fresh_rows(readings.scan_by_store(pages, files, fx.no_places(spark), base))
    new = readings.stored_keys(spark, base).join(before, readings.KEY, "left_anti")
    at = extract.leveled(pages, files, 5).select("file_id", "level", readings.digest().alias("digest"))
    read = at.join(new, readings.KEY).groupBy("file_id").agg(F.count("*").alias("n_read"))
    sums = found.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.sum(fx.micro(F.col("lat"))).alias("lat_sum"), F.sum(fx.micro(F.col("lon"))).alias("lon_sum"))
    return sums.join(read, "file_id", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)).cast("long"))


def _duplicates(name: str, same_cols: bool, same_pdf: bool, extra: str) -> None:
    sql = E_ + f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY ka, ko{extra} ORDER BY num) i FROM keyed WHERE ka<>'' OR ko<>'') WHERE i > 1"

    @query(name, sql)
    def run(spark, d):
        return rows.find_duplicates(rows.visible_rows(fx.event_rows(spark, d), fx.event_files(spark, d)), same_cols, same_pdf)


_duplicates("r6_find_duplicates", False, False, "")
_duplicates("r6_find_duplicates_same_cols", True, False, ", lower(trim(c0)), lower(trim(c1))")
_duplicates("r6_find_duplicates_same_pdf", False, True, ", coalesce(file_id, '')")


@query("r7_has_coordinate", E_ + "SELECT row_id, (lat IS NOT NULL OR lon IS NOT NULL OR trim(coalesce(lat_raw,''))<>'' OR trim(coalesce(lon_raw,''))<>'') AS has FROM erows")
def r7(spark, d):
    return fx.event_rows(spark, d).select("row_id", col.has_coordinate().alias("has"))


DUP = "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY ka, ko ORDER BY num) i FROM keyed WHERE ka<>'' OR ko<>'') WHERE i > 1"


@query("r8_dedup_preview", E_ + f"SELECT (SELECT count(*) FROM ({DUP})) AS n_duplicates, count(*) AS n_rows FROM visible")
def r8(spark, d):
    return rows.dedup_preview(fx.event_rows(spark, d), fx.event_files(spark, d))


@query("r9_remove_duplicates", E_ + f"SELECT row_id FROM erows WHERE row_id NOT IN ({DUP})")
def r9(spark, d):
    return rows.remove_duplicates(fx.event_rows(spark, d), _event_dets(spark, d), fx.no_places(spark), fx.event_files(spark, d))[0].select("row_id")


@query("r10_number_rows", E_ + "SELECT row_id, num FROM visible")
def r10(spark, d):
    return rows.number_rows(rows.visible_rows(fx.event_rows(spark, d), fx.event_files(spark, d))).select("row_id", F.col("num").cast("long").alias("num"))


@query("r11_fill_range", E_ + "SELECT r.row_id, r.c0, CASE WHEN v.num BETWEEN 20 AND 900 THEN 'filled' ELSE r.c1 END AS c1 FROM erows r LEFT JOIN visible v USING (row_id)")
def r11(spark, d):
    out = rows.fill_range(fx.event_rows(spark, d), fx.event_files(spark, d), 900, 20, "1", "filled")
    return out.select("row_id", col.cell(0).alias("c0"), col.cell(1).alias("c1"))


@query("r11_fill_range_by_ranks", E_ + "SELECT r.row_id, r.c0, CASE WHEN v.num BETWEEN 20 AND 900 THEN 'filled' ELSE r.c1 END AS c1 FROM erows r LEFT JOIN (SELECT row_id, row_number() OVER (ORDER BY num) AS num FROM visible WHERE row_id IN (SELECT row_id FROM erows WHERE e%7<>0)) v USING (row_id) WHERE r.e%7<>0")
def r11_ranks(spark, d):
    """A stored index of all rows, from which every seventh row is removed before the fill."""
    base, files, path = fx.event_rows(spark, d), fx.event_files(spark, d), f"{shared.shared_folder(spark)}/ranks-{shared.unique()}"
    ranks.build_ranks(base, path, 4096)
    gone = F.col("row_seq.pair_idx") % 7 == 0
    ranks.note_changes(base.where(gone), path, -1)
    out = ranks.fill_range_by_ranks(base.where(~gone), files, path, 900, 20, "1", "filled")
    return out.select("row_id", col.cell(0).alias("c0"), col.cell(1).alias("c1"))


@query("r12_fill_rows", E_ + "SELECT row_id, CASE WHEN e%9=0 THEN -33.5 ELSE lat END AS lat, CASE WHEN e%9=0 THEN NULL ELSE lat_raw END AS lat_raw FROM erows")
def r12(spark, d):
    base = fx.event_rows(spark, d)
    out = rows.fill_rows(base, base.where(F.col("row_seq.pair_idx") % 9 == 0).select("row_id"), "lat", "33°30'S")
    return out.select("row_id", "lat", "lat_raw")


@query("r13_fill_from_above", E_ + "SELECT r.row_id, CASE WHEN r.e%5=0 AND v.above IS NOT NULL THEN v.above ELSE r.c1 END AS c1 FROM erows r LEFT JOIN (SELECT row_id, lag(c1) OVER (ORDER BY num) above FROM visible) v USING (row_id)")
def r13(spark, d):
    base = fx.event_rows(spark, d)
    ids = base.where(F.col("row_seq.pair_idx") % 5 == 0).select("row_id")
    return rows.fill_from_above(base, fx.event_files(spark, d), ids, "1").select("row_id", col.cell(1).alias("c1"))


@query("r14_table_shape", E_ + "SELECT row_id, 3 AS wide, 2 AS narrow, '' AS c2 FROM erows UNION ALL SELECT 'new', 3, 2, ''")
def r14(spark, d):
    more = rows.add_row(fx.event_rows(spark, d), "new")
    wide, cols = rows.add_column(more, COLS)
    narrow, _ = rows.drop_column(wide, cols)
    sizes = narrow.select("row_id", F.size("cells").alias("narrow"))
    return wide.select("row_id", F.size("cells").alias("wide"), col.cell(2).alias("c2")).join(sizes, "row_id")


@query("r15_delete_flagged", E_ + "SELECT row_id FROM erows WHERE NOT (del AND row_id IN (SELECT row_id FROM visible))")
def r15(spark, d):
    return rows.delete_flagged(fx.event_rows(spark, d), _event_dets(spark, d), fx.no_places(spark), fx.event_files(spark, d))[0].select("row_id")


@query("r16_apply_suggestions", E_ + "SELECT row_id, CASE WHEN h AND llm_lat IS NOT NULL THEN llm_lat ELSE lat END AS lat, CASE WHEN h AND llm_lon IS NOT NULL THEN llm_lon ELSE lon END AS lon, CASE WHEN h AND llm_lat IS NOT NULL THEN NULL ELSE lat_raw END AS lat_raw, CASE WHEN h THEN 'ok' ELSE verdict END AS verdict FROM (SELECT *, coalesce(e%2=1 AND verdict='mismatch' AND (llm_lat IS NOT NULL OR llm_lon IS NOT NULL), false) h FROM erows)")
def r16(spark, d):
    base = fx.event_rows(spark, d)
    return rows.apply_suggestions(base, base.where(F.col("row_seq.pair_idx") % 2 == 1).select("row_id")).select("row_id", "lat", "lon", "lat_raw", "llm.verdict")


@query("r17_hide_files", E_ + "SELECT file_id, hidden OR file_id IN ('f1','f2') AS hidden, CASE WHEN file_id='f3' THEN 7 END AS intensity FROM efiles")
def r17(spark, d):
    return rows.set_file_net(rows.hide_files(fx.event_files(spark, d), ["f1", "f2"]), ["f3"], 7).select("file_id", "hidden", "intensity")


# Summaries


@query("a1_file_summary", E_ + f", {EDETS} SELECT f.file_id, f.name, 9 AS num_pages, CASE WHEN failed THEN 'unreadable' END AS error, count(d.row_id) AS n_dets FROM efiles f LEFT JOIN edets d USING (file_id) GROUP BY 1,2,3,4")
def a1(spark, d):
    return summary.file_summary(fx.event_files(spark, d), _event_dets(spark, d))


@query("a2_corpus_summary", E_ + f", {EDETS} SELECT (SELECT count(*) FROM efiles) AS n_files, (SELECT count(*) FROM efiles WHERE hidden) AS n_hidden, (SELECT count(*) FROM (SELECT DISTINCT file_id, page_num FROM edets WHERE file_id IN (SELECT file_id FROM efiles WHERE NOT hidden))) AS n_pages, (SELECT count(*) FROM visible) AS n_rows")
def a2(spark, d):
    return summary.corpus_summary(fx.event_files(spark, d), _event_dets(spark, d), fx.event_rows(spark, d))


@query("a3_pages_with_hits", P + "SELECT file_id, CAST(page_num + i AS INTEGER) AS page_num, CAST(CASE WHEN n_pages=1 THEN 2 ELSE 1 END AS BIGINT) AS n_dets FROM planted, range(0, 2) t(i) WHERE i < n_pages")
def a3(spark, d):
    pages = fx.planted_pages(spark, d)
    _, dets = extract.scan_corpus(pages, fx.planted_files(spark, d), fx.no_places(spark))
    return summary.pages_with_hits(pages, dets, show_all=True)


@query("a4_sent_summary", E_ + "SELECT f.file_id, count(r.row_id) AS n_rows, count(r.row_id) FILTER (r.sent) AS n_sent FROM efiles f LEFT JOIN erows r USING (file_id) WHERE NOT f.hidden AND NOT f.failed GROUP BY 1")
def a4(spark, d):
    return summary.sent_summary(fx.event_files(spark, d), fx.event_rows(spark, d))


_KINDS = ("ok", "mismatch", "not_found", "filled", "noted", "flagged", "deleted", "confirm_kept", "retried", "retry_fixed", "unbadged", "skipped")


@query("a5_run_summary", "SELECT " + ", ".join(f"count(*) FILTER (event_id%13={i}) AS n_{k}" for i, k in enumerate(_KINDS)) + " FROM events")
def a5(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (*_KINDS, "other"))), (F.col("event_id") % 13 + 1).cast("int"))
    return summary.run_summary(fx.table(spark, d, "events").select(kind.alias("kind")))


@query("a6_deletion_report", E_ + "SELECT num AS place, '#' || num || ' — ' || coalesce(CAST(lat AS VARCHAR), '(no lat)') || ', ' || coalesce(CAST(lon AS VARCHAR), '(no lon)') || ' (doc p.' || page_num || '): ' || CASE WHEN e%2=0 THEN 'why' ELSE 'no reason given' END AS line FROM (SELECT * FROM visible WHERE del ORDER BY num LIMIT 15) UNION ALL SELECT NULL, '… and ' || (count(*)-15) || ' more' FROM visible WHERE del HAVING count(*) > 15")
def a6(spark, d):
    shown = rows.number_rows(rows.visible_rows(fx.event_rows(spark, d), fx.event_files(spark, d))).where("llm.del")
    return summary.deletion_report(shown.select("num", "lat", "lon", F.lit("doc").alias("file"), F.col("page_num").alias("page"), F.when(F.col("row_seq.pair_idx") % 2 == 0, "why").otherwise("").alias("note")))


# Reviews


@query("l1_select_llm_work", E_ + "SELECT v.row_id AS id, v.num, f.name AS file, v.page_num AS page, v.lat, v.lon FROM visible v JOIN efiles f USING (file_id) WHERE NOT f.failed AND NOT f.hidden AND NOT v.sent")
def l1(spark, d):
    work, _ = assist.select_llm_work(fx.event_rows(spark, d), fx.event_files(spark, d), unsent_only=True)
    return work.select("id", "num", "file", "page", "lat", "lon")


def _doc_pages(spark, d):
    docs = fx.table(spark, d, "documents").select(F.concat(F.lit("f"), "doc_id").alias("file_id"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / 1500))
    cut = docs.select("file_id", "doc_id", "t", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("page_num"))
    return cut.select("file_id", "doc_id", "page_num", F.expr("substring(t, (page_num - 1) * 1500 + 1, 1500)").alias("text"))


def _doc_work(spark, d):
    """Page p of document n has (n + p) % 5 * 7 rows."""
    many = _doc_pages(spark, d).select("file_id", "doc_id", "page_num", F.expr("(doc_id + page_num) % 5 * 7").cast("int").alias("n")).where("n > 0")
    r = many.select("file_id", "doc_id", F.col("page_num").alias("page"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    num = F.col("page") * 1000 + F.col("i")
    return r.select(
        "file_id", F.lit(0).alias("file_seq"), rows.row_seq(0, F.col("doc_id"), F.col("page"), 0, F.col("i")).alias("row_seq"), F.concat_ws("-", "file_id", "page", "i").alias("id"), num.cast("long").alias("num"),
        F.array(F.lit("a"), F.lit("")).alias("cells"), F.lit(1.5).alias("lat"), F.lit(None).cast("double").alias("lon"), F.concat("file_id", F.lit(".pdf")).alias("file"), "page",
    )


DOCS_SQL = """docs AS (SELECT 'f' || doc_id file_id, doc_id, coalesce(text, '') t FROM documents),
dpages AS (SELECT file_id, doc_id, CAST(p AS INTEGER) page_num, substring(t, CAST((p-1)*1500+1 AS BIGINT), 1500) AS text, (doc_id+p)%5*7 n FROM docs, unnest(range(1, CAST(greatest(1, ceil(length(t)/1500.0)) AS BIGINT)+1)) u(p))"""


@query("l3_chunk_work", f"""WITH RECURSIVE {DOCS_SQL}, c AS (SELECT file_id, page_num, 0 AS chunk_id, CAST(length(text)+50 AS BIGINT) chars, CAST(n AS BIGINT) cnt FROM dpages WHERE page_num=1
 UNION ALL SELECT p.file_id, p.page_num, CASE WHEN c.chars + length(p.text)+50 > 6000 OR c.cnt + p.n > 40 THEN c.chunk_id+1 ELSE c.chunk_id END, CASE WHEN c.chars + length(p.text)+50 > 6000 OR c.cnt + p.n > 40 THEN length(p.text)+50 ELSE c.chars + length(p.text)+50 END,
 CASE WHEN c.chars + length(p.text)+50 > 6000 OR c.cnt + p.n > 40 THEN p.n ELSE c.cnt + p.n END FROM c JOIN dpages p ON p.file_id=c.file_id AND p.page_num=c.page_num+1)
 SELECT c.file_id, c.chunk_id, count(*) AS n_pages, CAST(sum(p.n) AS BIGINT) AS n_rows, CAST(sum(length(p.text)) AS BIGINT) AS n_chars FROM c JOIN dpages p USING (file_id, page_num) GROUP BY 1, 2 HAVING sum(p.n) > 0""")
def l3(spark, d):
    chunks = assist.chunk_work(_doc_pages(spark, d).select("file_id", "page_num", "text"), _doc_work(spark, d), budget=6000)
    chars = F.aggregate("pages", F.lit(0), lambda a, p: a + F.length(p["text"])).cast("long")
    return chunks.select("file_id", "chunk_id", F.size("pages").cast("long").alias("n_pages"), F.size("rows").cast("long").alias("n_rows"), chars.alias("n_chars"))


@query("l4_chunk_per_page", f"WITH {DOCS_SQL} SELECT file_id, page_num, CAST(i AS INTEGER) AS part, CAST(least(10, n - i*10) AS BIGINT) AS n_rows, length(text) AS n_chars FROM dpages, range(0, 4) t(i) WHERE i*10 < n")
def l4(spark, d):
    chunks = assist.chunk_per_page(_doc_pages(spark, d).select("file_id", "page_num", "text"), _doc_work(spark, d), max_rows=10)
    return chunks.select("file_id", "page_num", "part", F.size("rows").cast("long").alias("n_rows"), F.length(F.col("pages")[0]["text"]).cast("long").alias("n_chars"))


@query("l2_pages_to_send", P + "SELECT file_id, CAST(page_num + i AS INTEGER) AS page_num FROM planted, range(0, 2) t(i) WHERE i < n_pages AND k%7<>0 AND n_pages=1")
def l2(spark, d):
    pages = fx.planted_pages(spark, d)
    pairs = extract.drop_suppressed(extract.extract_coordinates(pages), fx.planted_suppressed(spark, d)).where("lat is not null and lon is not null")
    return assist.pages_to_send(pages, rows.location_keys(pairs)).select("file_id", "page_num")


@query("l2_pages_to_send_all_pages", P + "SELECT file_id, CAST(page_num + i AS INTEGER) AS page_num FROM planted, range(0, 2) t(i) WHERE i < n_pages AND (k%7<>0 OR i=1 AND style<>5)")
def l2_all(spark, d):
    found = rows.location_keys(_scanned(spark, d, fx.planted_suppressed(spark, d)))
    return assist.pages_to_send(fx.planted_pages(spark, d), found).select("file_id", "page_num")


_TASKS = assist.Tasks(cols=["Type", "Detail"])
_HEAD = "CSV rows (id | row # | Type | Detail | latitude | longitude | source):"


@query("l5_build_prompt", f"WITH {DOCS_SQL} SELECT file_id, page_num, '{_HEAD}' || chr(10) || (SELECT string_agg(file_id || '-' || page_num || '-' || i || ' | ' || (page_num*1000+i) || ' | a |  | 1.5 |  | ' || file_id || '.pdf p.' || page_num, chr(10) ORDER BY i) FROM range(1, n+1) t(i)) || chr(10) || chr(10) || 'DOCUMENT TEXT:' || chr(10) || '--- ' || file_id || '.pdf — page ' || page_num || ' ---' || chr(10) || text AS \"user\" FROM dpages WHERE n > 0")
def l5(spark, d):
    chunks = assist.chunk_per_page(_doc_pages(spark, d).select("file_id", "page_num", "text"), _doc_work(spark, d))
    return assist.build_prompt(chunks, _TASKS).select("file_id", "page_num", "user")


def _as_requests(spark, d):
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", F.lit("be exact").alias("system"), F.col("text").alias("user"))
    return assist.build_requests(c, "openai", "m1", temperature=0.5)


@query("l6_build_requests", "SELECT conv_id, turn, 'm1' AS model, text AS user_text, 'be exact' AS system_text, '0.5' AS temperature FROM conversations")
def l6(spark, d):
    get = lambda p: F.get_json_object("body", p)
    return _as_requests(spark, d).select("conv_id", "turn", get("$.model").alias("model"), get("$.messages[1].content").alias("user_text"), get("$.messages[0].content").alias("system_text"), get("$.temperature").alias("temperature"))


def echo(body: str) -> tuple[int, str]:
    """A stand-in for a service: replies with the user's text."""
    said = json.loads(body)["messages"][-1]["content"]
    return 200, json.dumps({"choices": [{"message": {"content": said}}]})


@query("l7_call_model", "SELECT conv_id, turn, 200 AS status, text, CAST(NULL AS VARCHAR) AS error FROM conversations")
def l7(spark, d):
    return assist.extract_text(assist.call_model(_as_requests(spark, d), echo), "openai").select("conv_id", "turn", "status", "text", "error")


@query("l7_refused_run", "SELECT CAST(status AS INTEGER) AS status, CAST(n AS BIGINT) AS n FROM (SELECT 200 AS status, least(100, count(*)) AS n FROM conversations UNION ALL SELECT 401, least(1, count(*)-100) FROM conversations UNION ALL SELECT 0, count(*)-101 FROM conversations) WHERE n > 0")
def l7_refused(spark, d):
    """The key is refused after a hundred requests: one answer says so, and nothing more is sent."""
    rows_ = shared.numbered(fx.table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", name="request_seq")
    replies = assist.call_in_slices(rows_.withColumn("body", F.col("request_seq").cast("string")), lambda body: (200 if int(body) <= 100 else 401, body), parallel=1, slice_size=100)
    return replies.groupBy("status").agg(F.count("*").alias("n"))


def _replies(spark, d):
    e = F.col("event_id")
    obj = F.concat(F.lit('{"row": "r'), e, F.lit('", "verdict": "'), F.when(e % 2 == 0, "ok").otherwise("bogus"), F.lit('", "lat": '), (e % 120).cast("string"), F.lit(', "lon": '), (e % 170).cast("string"), F.lit(', "col1": " Aa bb ", "col2": "x]y", "delete": '), F.when(e % 7 == 0, "true").otherwise('"true"'), F.lit(', "note": "n'), e, F.lit('"}'))
    text = F.when(e % 5 == 0, F.concat(F.lit("```json\n["), obj, F.lit("]\n```"))).when(e % 5 == 1, F.concat(F.lit("Here: ["), obj, F.lit("] done ]"))).when(e % 5 == 2, F.concat(F.lit("["), obj)).when(e % 5 == 3, F.concat(F.lit("["), obj, F.lit(', {"verdict": "ok"}, 5]'))).otherwise("nothing")
    return fx.table(spark, d, "events").select("event_id", text.alias("text"))


@query("l9_l10_parse_results", "SELECT event_id, 'r' || event_id AS row, CASE WHEN event_id%2=0 THEN 'ok' END AS verdict, CASE WHEN event_id%120<=90 THEN (event_id%120)::DOUBLE END AS lat, (event_id%170)::DOUBLE AS lon, 'Aa bb' AS c0, 'x]y' AS c1, event_id%7=0 AS del, 'n' || event_id AS note FROM events WHERE event_id%5 IN (0,1,3)")
def l9(spark, d):
    return assist.parse_results(_replies(spark, d)).select("event_id", "row", "verdict", "lat", "lon", F.col("cols")[0].alias("c0"), F.col("cols")[1].alias("c1"), "del", "note")


@query("l8_extract_text", "SELECT event_id, CASE event_id%4 WHEN 0 THEN 'a' || chr(10) || 'b' END AS text, CASE event_id%4 WHEN 1 THEN 'bad key' WHEN 2 THEN 'The model declined this request (refusal).' WHEN 3 THEN 'Provider returned non-JSON response: <html>' END AS error FROM events")
def l8(spark, d):
    e = F.col("event_id") % 4
    body = F.when(e == 0, '{"type":"message","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}').when(e == 1, '{"type":"error","error":{"message":"bad key"}}').when(e == 2, '{"type":"message","stop_reason":"refusal","content":[]}').otherwise("<html>")
    return assist.extract_text(fx.table(spark, d, "events").select("event_id", body.alias("response")), "anthropic").select("event_id", "text", "error")


def _results(spark, d):
    """Two answers per row, of passes 1 and 2."""
    parsed = assist.parse_results(_replies(spark, d))
    one = parsed.select(F.lit(1).alias("pass"), F.col("event_id").alias("request_seq"), "result_seq", "row", "verdict", "lat", "lon", "cols", "notes_col", "note", "del", "need_prev", "need_next")
    later = one.withColumns({"pass": F.lit(2), "verdict": F.when(F.col("request_seq") % 3 == 0, "mismatch"), "cols": F.array(F.lit("Later"), F.lit("later")), "notes_col": F.lit("seen"), "del": F.lit(False)})
    return one.unionByName(later)


@query("l11_apply_results", E_ + "SELECT row_id, c0, CASE WHEN e%5 IN (0,1,3) AND c1='' THEN 'x]y' ELSE c1 END AS c1, CASE WHEN e%5 IN (0,1,3) AND notes='' THEN 'seen' ELSE notes END AS notes, CASE WHEN e%5 NOT IN (0,1,3) THEN verdict WHEN e%3=0 THEN 'mismatch' WHEN e%2=0 THEN 'ok' ELSE verdict END AS verdict, CASE WHEN e%5 IN (0,1,3) AND e%7=0 THEN true WHEN del THEN true END AS del FROM erows")
def l11(spark, d):
    tasks = assist.Tasks(verify=True, fill=True, notes=True, flag=True, cols=["Type", "Detail"])
    out, _ = assist.apply_results(fx.event_rows(spark, d), _results(spark, d), tasks)
    return out.select("row_id", col.cell(0).alias("c0"), col.cell(1).alias("c1"), "notes", "llm.verdict", "llm.del")


def _event_work(spark, d):
    return assist.select_llm_work(fx.event_rows(spark, d), fx.event_files(spark, d))[0]


@query("l12_needs_page", E_ + "SELECT file_id, page_num AS page, CAST(page_num-1 AS INTEGER) AS bound, count(*) AS n_rows FROM visible JOIN efiles USING (file_id) WHERE NOT failed AND NOT efiles.hidden AND e%4=1 AND page_num>1 GROUP BY 1,2,3")
def l12(spark, d):
    asked = fx.event_rows(spark, d).select(F.col("row_id").alias("row"), (F.col("row_seq.pair_idx") % 4 == 1).alias("need_prev"))
    out = assist.needs_page(asked, _event_work(spark, d), fx.event_files(spark, d), "prev")
    return out.select("file_id", "page", "bound", F.size("ids").cast("long").alias("n_rows"))


@query("l12_window_chunks", f"""WITH {DOCS_SQL}, a AS (SELECT *, max(page_num) OVER (PARTITION BY file_id) np FROM dpages),
 asked AS (SELECT 'prev' AS way, file_id, page_num AS page, page_num-s AS bound, (n+3)//4 AS k FROM a, range(1,3) t(s) WHERE n > 0 AND page_num-s >= 1 UNION ALL SELECT 'next', file_id, page_num, page_num+s, (n+2)//4 FROM a, range(1,3) t(s) WHERE n > 1 AND page_num+s <= np)
 SELECT way, asked.file_id, page, CAST(bound AS INTEGER) AS bound, CAST(k AS BIGINT) AS n_rows, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM asked JOIN a ON a.file_id=asked.file_id AND a.page_num BETWEEN least(page, bound) AND greatest(page, bound) GROUP BY 1,2,3,4,5""")
def l12_windows(spark, d):
    pages, work = _doc_pages(spark, d).select("file_id", "page_num", "text"), _doc_work(spark, d)
    files = pages.groupBy("file_id").agg(F.max("page_num").alias("num_pages"))
    i = F.col("num") % 1000
    asked = work.select(F.col("id").alias("row"), (i % 4 == 1).alias("need_prev"), (i % 4 == 2).alias("need_next"))
    out = []
    for way in ("prev", "next"):
        first = assist.needs_page(asked, work, files, way)
        second = assist.needs_page(asked, work, files, way, first.select(F.explode("ids").alias("id"), "bound"))
        # The second pass asks for those only whose first window is there.
        again = second.where(F.abs(F.col("bound") - F.col("page")) == 2)
        chunks = assist.window_chunks(first.union(again), pages, work)
        chars = F.aggregate("pages", F.lit(0), lambda a, p: a + F.length(p["text"])).cast("long")
        out.append(chunks.select(F.lit(way).alias("way"), "file_id", "page", "bound", F.size("rows").cast("long").alias("n_rows"), F.size("pages").cast("long").alias("n_pages"), chars.alias("n_chars")))
    return out[0].union(out[1])


@query("l13_unbadged", E_ + "SELECT file_id, page_num, count(*) AS n_rows FROM erows WHERE sent AND verdict IS NULL AND NOT coalesce(del, false) GROUP BY 1,2")
def l13(spark, d):
    base = fx.event_rows(spark, d)
    return assist.unbadged(base, base.where("llm_sent is not null")).select("file_id", "page_num", F.size("ids").cast("long").alias("n_rows"))


@query("l14_unfinished", E_ + "SELECT row_id FROM erows WHERE (verdict IS NULL AND NOT coalesce(del, false)) OR trim(c1)=''")
def l14(spark, d):
    return assist.unfinished(fx.event_rows(spark, d), assist.Tasks(verify=True, species=True))


@query("l15_second_model_retry", E_ + "SELECT row_id AS id FROM visible JOIN efiles USING (file_id) WHERE NOT failed AND NOT efiles.hidden AND verdict IS NULL AND NOT coalesce(del, false)")
def l15(spark, d):
    rest = assist.unfinished(fx.event_rows(spark, d), assist.Tasks()).withColumnRenamed("row_id", "id")
    return _event_work(spark, d).join(rest, "id", "left_semi").select("id")


@query("l16_confirm_deletes", E_ + "SELECT row_id, CASE WHEN del AND e%5 IN (0,1,3) THEN 'n' || e ELSE CASE WHEN has_llm THEN 'note ' || e END END AS note FROM erows WHERE NOT (del AND e%5 IN (0,1,3) AND e%7=0)")
def l16(spark, d):
    second = _results(spark, d).where("pass = 1")
    return assist.confirm_deletes(fx.event_rows(spark, d), _event_dets(spark, d), fx.no_places(spark), second)[0].select("row_id", "llm.note")


@query("l17_mark_sent", E_ + "SELECT row_id, (sent OR (e%2=0 AND (verdict IS NOT NULL OR coalesce(del, false)))) AS sent FROM erows")
def l17(spark, d):
    base = fx.event_rows(spark, d)
    out = assist.mark_sent(base, base.where(F.col("row_seq.pair_idx") % 2 == 0).select("row_id"), F.lit("2024-01-01").cast("timestamp"))
    return out.select("row_id", F.col("llm_sent").isNotNull().alias("sent"))


_SYSTEM = assist.system_prompt(_TASKS).replace("'", "''")


@query("l18_preview_prompt", f"""WITH RECURSIVE {DOCS_SQL}, own AS (SELECT * FROM dpages WHERE file_id = (SELECT min(file_id) FROM dpages WHERE n > 0)),
 c AS (SELECT file_id, page_num, 0 AS chunk_id, CAST(length(text)+50 AS BIGINT) chars, CAST(n AS BIGINT) cnt FROM own WHERE page_num=1
 UNION ALL SELECT p.file_id, p.page_num, CASE WHEN c.chars + length(p.text)+50 > 24000 OR c.cnt + p.n > 40 THEN c.chunk_id+1 ELSE c.chunk_id END, CASE WHEN c.chars + length(p.text)+50 > 24000 OR c.cnt + p.n > 40 THEN length(p.text)+50 ELSE c.chars + length(p.text)+50 END,
 CASE WHEN c.chars + length(p.text)+50 > 24000 OR c.cnt + p.n > 40 THEN p.n ELSE c.cnt + p.n END FROM c JOIN own p ON p.page_num=c.page_num+1),
 first AS (SELECT o.*, chunk_id FROM c JOIN own o USING (file_id, page_num) WHERE chunk_id = (SELECT min(chunk_id) FROM c JOIN own USING (page_num) WHERE n > 0)),
 lines AS (SELECT page_num, i, file_id || '-' || page_num || '-' || i || ' | ' || (page_num*1000+i) || ' | a |  | 1.5 |  | ' || file_id || '.pdf p.' || page_num AS line FROM first, unnest(range(1, n+1)) t(i))
 SELECT (SELECT any_value(file_id) FROM first) AS file_id, (SELECT any_value(chunk_id) FROM first) AS chunk_id, '{_SYSTEM}' AS system,
 substring('{_HEAD}' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY page_num, i) FROM lines) || chr(10) || chr(10) || 'DOCUMENT TEXT:' || chr(10) || (SELECT string_agg('--- ' || file_id || '.pdf — page ' || page_num || ' ---' || chr(10) || text, chr(10) ORDER BY page_num) FROM first), 1, 8000) AS "user\"""")
def l18(spark, d):
    return assist.preview_prompt(_doc_pages(spark, d).select("file_id", "page_num", "text"), _doc_work(spark, d), _TASKS)


# Sources, projects, stream


@query("s1_list_corpus", "SELECT 'd' || (o_custkey%7) || '/doc' || o_orderkey || '.PDF' AS path, CAST(row_number() OVER (ORDER BY o_custkey%7, o_orderkey) AS BIGINT) AS file_seq FROM orders WHERE o_orderkey%4 NOT IN (1, 2)")
def s1(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("d"), F.col("o_custkey") % 7, F.lit("/"), F.when(k % 4 == 1, ".").otherwise(""), F.lit("doc"), k, F.when(k % 4 == 2, ".txt").otherwise(".PDF"))
    return corpus.files_of(fx.table(spark, d, "orders").select(name.alias("path")), "", max_files=None).select("path", "file_seq")


@query("s6_s7_projects", E_ + "SELECT 'p1' AS project, row_id, c0, '' AS c2 FROM erows")
def s6(spark, d):
    base = f"{shared.shared_folder(spark)}/projects-{shared.unique()}"
    tables = {"files": fx.event_files(spark, d), "rows": fx.event_rows(spark, d), "dets": _event_dets(spark, d), "suppressed": fx.planted_suppressed(spark, d)}
    for p in ("p1", "p2"):
        project.save_project(tables, base, p, f"Project {p}", ["Type", "Detail", "More"])
    project.delete_project(spark, base, "p2")
    out = None
    for p in (r["project_id"] for r in project.list_projects(spark, base).collect()):
        loaded, _ = project.load_project(spark, base, p)
        own = loaded["rows"].select(F.lit(p).alias("project"), "row_id", col.cell(0).alias("c0"), col.cell(2).alias("c2"))
        out = own if out is None else out.union(own)
    return out


@query("x1_scan_stream", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted")
def x1(spark, d):
    base = f"{shared.shared_folder(spark)}/stream-{shared.unique()}"
    fx.planted_pages(spark, d).repartition(4, "file_id").write.parquet(f"{base}/in")
    scan_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state", fx.no_places(spark)).awaitTermination()
    got, _ = stream_tables(spark, f"{base}/out")
    return got.select("file_id", "page_num", fx.micro(F.col("lat")).alias("lat_micro"), fx.micro(F.col("lon")).alias("lon_micro"))


@query("x1_scan_stream_batches", P + "SELECT file_id, page_num, lat_micro, lon_micro FROM planted")
def x1_batches(spark, d):
    """The same pages in three batches that cut through the files, the later ones after a restart."""
    base = f"{shared.shared_folder(spark)}/stream-{shared.unique()}"
    pages = shared.written(fx.planted_pages(spark, d), "pages")
    for part in ("page_num <= 5", "page_num between 6 and 12", "page_num > 12"):
        pages.where(part).write.mode("append").parquet(f"{base}/in")
        scan_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state", fx.no_places(spark)).awaitTermination()
    got, _ = stream_tables(spark, f"{base}/out")
    return got.select("file_id", "page_num", fx.micro(F.col("lat")).alias("lat_micro"), fx.micro(F.col("lon")).alias("lon_micro"))


def reviewer(body: str) -> tuple[int, str]:
    """A stand-in for a service: confirms every row that it is shown."""
    said = json.loads(body)["messages"][-1]["content"].split("\n\nDOCUMENT TEXT:")[0]
    ids = [line.split(" | ")[0] for line in said.split("\n") if line.startswith("f") and " | " in line]
    content = json.dumps([{"row": i, "verdict": "ok", "col1": "Genus name", "note": "seen"} for i in ids])
    return 200, json.dumps({"choices": [{"message": {"content": content}}]})


@query("w3_assist_job", P + "SELECT file_id, page_num, CASE WHEN o_custkey%10=0 OR o_custkey%13=0 THEN NULL ELSE 'ok' END AS verdict, CASE WHEN o_custkey%10=0 OR o_custkey%13=0 THEN '' ELSE 'Genus' END AS c0, NOT (o_custkey%10=0 OR o_custkey%13=0) AS sent FROM planted WHERE n_pages=1")
def w3(spark, d):
    pages, files = fx.planted_pages(spark, d), fx.planted_files(spark, d)
    single = fx._planted(spark, d).where("n_pages = 1").select("file_id", "page_num")
    coords = extract.located(extract.extract_coordinates(pages), extract.extract_cross_page(pages).limit(0)).join(single, ["file_id", "page_num"], "left_semi")
    coords = shared.written(coords, "coordinates")  # rows and detections are both made of them
    tables = {"pages": pages, "files": files, "rows": rows.as_table_rows(extract.fresh_rows(coords), files), "dets": extract.build_detections(coords), "suppressed": fx.no_places(spark)}
    out = jobs.assist_job(tables, assist.Tasks(verify=True, genus=True), reviewer)["rows"]
    return out.select("file_id", "page_num", "llm.verdict", col.cell(0).alias("c0"), F.col("llm_sent").isNotNull().alias("sent"))


@query("w3_assist_job_all_pages", SQL["w3_assist_job"].removesuffix(" WHERE n_pages=1"))
def w3_all(spark, d):
    pages, files = fx.planted_pages(spark, d), fx.planted_files(spark, d)
    coords = _scanned(spark, d)
    tables = {"pages": pages, "files": files, "rows": rows.as_table_rows(extract.fresh_rows(coords), files), "dets": extract.build_detections(coords), "suppressed": fx.no_places(spark)}
    out = jobs.assist_job(tables, assist.Tasks(verify=True, genus=True), reviewer)["rows"]
    return out.select("file_id", "page_num", "llm.verdict", col.cell(0).alias("c0"), F.col("llm_sent").isNotNull().alias("sent"))


def two_reviewers(body: str) -> tuple[int, str]:
    """A stand-in for two services: m1 knows only rows of even pages, m2 finds none of what it is asked."""
    asked = json.loads(body)
    said = asked["messages"][-1]["content"].split("\n\nDOCUMENT TEXT:")[0]
    ids = [line.split(" | ")[0] for line in said.split("\n") if line.startswith("f") and " | " in line]
    first = asked["model"] == "m1"
    results = [{"row": i, "verdict": "ok" if first else "not_found"} for i in ids if not first or int(i.split(":")[1]) % 2 == 0]
    return 200, json.dumps({"choices": [{"message": {"content": json.dumps(results)}}]})


_ODD = "(page_num + n_pages - 1) % 2 = 1"


@query("w4_second_model", P + f"SELECT file_id, page_num, CASE WHEN o_custkey%10=0 OR o_custkey%13=0 THEN NULL WHEN {_ODD} THEN 'not_found' ELSE 'ok' END AS verdict, (SELECT count(*) FROM planted WHERE {_ODD} AND NOT (o_custkey%10=0 OR o_custkey%13=0)) AS n_fixed FROM planted")
def w4(spark, d):
    pages, files = fx.planted_pages(spark, d), fx.planted_files(spark, d)
    coords = _scanned(spark, d)
    tables = {"pages": pages, "files": files, "rows": rows.as_table_rows(extract.fresh_rows(coords), files), "dets": extract.build_detections(coords), "suppressed": fx.no_places(spark)}
    out = jobs.assist_job(tables, assist.Tasks(verify=True), two_reviewers, model="m1", second=("openai", "m2"))
    n_fixed = out["second"].first()["n_fixed"]
    return out["rows"].select("file_id", "page_num", "llm.verdict", F.lit(n_fixed).cast("long").alias("n_fixed"))
