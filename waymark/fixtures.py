"""Test tables made from the given ones by arithmetic that SQL can repeat: planted pages with known
coordinates, table rows, files, text items, model replies. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.rows import LLM, row_seq

LEAD, REAR = "The party made a record at ", " by the ridge."
N_FILES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coordinate per order: its notation (0-5), texts of both halves, and its pages."""
    k = F.col("o_orderkey")
    # Pages are numbered before anything else is made, so that only keys are shuffled.
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 5 == 0, 2).otherwise(1).alias("n_pages"))
    numbered = keys.withColumn("page_num", (F.coalesce(F.sum("n_pages").over(before), F.lit(0)) + 1).cast("int"))
    o = numbered.select(
        k.alias("k"), F.concat(F.lit("f"), F.col("o_custkey")).alias("file_id"), "o_custkey",
        (k * 37 % 90).alias("a_d"), (k * 11 % 60).alias("a_m"), (k * 7 % 60).alias("a_s"), (k % 2).alias("a_neg"),
        (k * 53 % 180).alias("o_d"), (k * 13 % 60).alias("o_m"), (k * 17 % 60).alias("o_s"), F.expr("o_orderkey div 2 % 2").alias("o_neg"),
        F.expr("o_orderkey div 4 % 6").alias("style"), "n_pages", "page_num",
    )

    def half(p: str, letters: str, label: str) -> Column:
        d, m, s = (F.col(f"{p}_{x}").cast("string") for x in "dms")
        letter = F.when(F.col(f"{p}_neg") == 1, letters[1]).otherwise(letters[0])
        micro = F.col(f"{p}_d") * 1_000_000 + F.floor((F.col(f"{p}_m") * 60 + F.col(f"{p}_s")) * 1_000_000 / 3600)
        number = F.concat(F.floor(micro / 1_000_000).cast("string"), F.lit("."), F.lpad((micro % 1_000_000).cast("string"), 6, "0"))
        minus = F.when(F.col(f"{p}_neg") == 1, "-").otherwise("")
        return (
            F.when(F.col("style") == 0, F.concat(d, F.lit("°"), m, F.lit("'"), s, F.lit('"'), letter))
            .when(F.col("style") == 1, F.concat(d, F.lit("o"), m, F.lit("'"), s, F.lit('"'), letter))
            .when(F.col("style") == 2, F.concat_ws(" ", d, m, s, letter))
            .when(F.col("style") == 3, F.concat(letter, F.lit(" "), d, F.lit("°"), m, F.lit("'"), s, F.lit('"')))
            .when(F.col("style") == 4, F.concat(number, F.lit(" "), letter))
            .otherwise(F.concat(F.lit(label + " "), minus, number))
        )

    return o.select("*", half("a", "NS", "Lat.").alias("lat_text"), half("o", "EW", "Long.").alias("lon_text"))


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, page_num, text); orders with k % 5 = 0 take two pages with the break between the halves."""
    p = _planted(spark, sf_dir)
    whole = F.array(F.struct(F.col("page_num"), F.concat(F.lit(LEAD), "lat_text", F.lit(", "), "lon_text", F.lit(REAR)).alias("text")))
    split = F.array(
        F.struct(F.col("page_num"), F.concat(F.lit(LEAD), "lat_text", F.lit(",")).alias("text")),
        F.struct((F.col("page_num") + 1).alias("page_num"), F.concat("lon_text", F.lit(REAR)).alias("text")),
    )
    return p.select("file_id", F.inline(F.when(F.col("n_pages") == 1, whole).otherwise(split)))


def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, page_num, text): one file of two pages per order, with the break within the latitude, after its degrees."""
    k = F.col("o_orderkey")
    d = lambda c: c.cast("string")
    lat = F.concat(d(k * 11 % 60), F.lit("'"), d(k * 7 % 60), F.lit('"'), F.when(k % 2 == 1, "S").otherwise("N"))
    lon = F.concat(d(k * 53 % 180), F.lit("°"), d(k * 13 % 60), F.lit("'"), d(k * 17 % 60), F.lit('"'), F.when(F.expr("o_orderkey div 2 % 2") == 1, "W").otherwise("E"))
    one = F.struct(F.lit(1).alias("page_num"), F.concat(F.lit(LEAD), d(k * 37 % 90), F.lit("°")).alias("text"))
    two = F.struct(F.lit(2).alias("page_num"), F.concat(lat, F.lit(", "), lon, F.lit(REAR)).alias("text"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k).alias("file_id"), F.inline(F.array(one, two)))


def planted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items of the planted pages: one per word, ten units for each character, on one line."""
    words = planted_pages(spark, sf_dir).select("file_id", "page_num", F.split("text", " ").alias("w"))
    start = F.length(F.array_join(F.slice("w", F.lit(1), F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)
    at = words.select("file_id", "page_num", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")).withColumn("at", start)
    word = F.element_at("w", F.col("i") + 1)
    return at.select(
        "file_id", "page_num", F.col("i").alias("item_seq"), word.alias("str"), F.lit(False).alias("has_eol"), (F.col("at") * 10).cast("double").alias("x"), F.lit(700.0).alias("y"),
        (F.length(word) * 10).cast("double").alias("width"), F.lit(10.0).alias("height"),
    )


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per customer with orders; every tenth is hidden, every 13th failed to be read."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)).cast("int").alias("num_pages"))
    return c.select(
        F.concat(F.lit("f"), "o_custkey").alias("file_id"), F.col("o_custkey").cast("long").alias("file_seq"), F.concat(F.lit("doc"), "o_custkey", F.lit(".pdf")).alias("name"),
        F.when(F.col("o_custkey") % 13 == 0, "unreadable").alias("error"), "num_pages", F.lit(None).cast("int").alias("intensity"), (F.col("o_custkey") % 10 == 0).alias("hidden"),
    )


def planted_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the latitudes of orders with k % 7 = 0."""
    start = F.lit(len(LEAD)) - F.when(F.col("style").isin(3, 5), 0).otherwise(1)
    return _planted(spark, sf_dir).where("k % 7 = 0").select("file_id", "page_num", F.lit("lat").alias("half"), start.cast("int").alias("start"))


def no_places(spark: SparkSession) -> DataFrame:
    """None, which the optimizer can see."""
    return spark.range(0).selectExpr("'' as file_id", "0 as page_num", "'' as half", "0 as start")


#: The same planted coordinates in SQL: expected values in micro-degrees, and the text's parts.
PLANTED_SQL = f"""
base AS (SELECT o_orderkey k, 'f' || o_custkey file_id, o_custkey,
  o_orderkey*37%90 a_d, o_orderkey*11%60 a_m, o_orderkey*7%60 a_s, o_orderkey%2 a_neg,
  o_orderkey*53%180 o_d, o_orderkey*13%60 o_m, o_orderkey*17%60 o_s, (o_orderkey//2)%2 o_neg,
  (o_orderkey//4)%6 style, CASE WHEN o_orderkey%5=0 THEN 2 ELSE 1 END n_pages FROM orders),
micro AS (SELECT *, a_d*1000000 + ((a_m*60+a_s)*1000000)//3600 a_u, o_d*1000000 + ((o_m*60+o_s)*1000000)//3600 o_u,
  CASE WHEN a_neg=1 THEN 'S' ELSE 'N' END a_l, CASE WHEN o_neg=1 THEN 'W' ELSE 'E' END o_l,
  CAST(coalesce(sum(n_pages) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INTEGER) page_num FROM base),
planted AS (SELECT *,
  CASE WHEN style<4 THEN CAST(floor((a_d + a_m/60.0::DOUBLE + a_s/3600.0::DOUBLE)*1e6+0.5) AS BIGINT) ELSE a_u END * (1-2*a_neg) lat_micro,
  CASE WHEN style<4 THEN CAST(floor((o_d + o_m/60.0::DOUBLE + o_s/3600.0::DOUBLE)*1e6+0.5) AS BIGINT) ELSE o_u END * (1-2*o_neg) lon_micro,
  CASE style WHEN 0 THEN a_d || '°' || a_m || '''' || a_s || '"' || a_l WHEN 1 THEN a_d || 'o' || a_m || '''' || a_s || '"' || a_l
    WHEN 2 THEN a_d || ' ' || a_m || ' ' || a_s || ' ' || a_l WHEN 3 THEN a_l || ' ' || a_d || '°' || a_m || '''' || a_s || '"'
    WHEN 4 THEN (a_u//1000000) || '.' || lpad((a_u%1000000)::VARCHAR, 6, '0') || ' ' || a_l
    ELSE 'Lat. ' || CASE WHEN a_neg=1 THEN '-' ELSE '' END || (a_u//1000000) || '.' || lpad((a_u%1000000)::VARCHAR, 6, '0') END lat_text,
  CASE style WHEN 0 THEN o_d || '°' || o_m || '''' || o_s || '"' || o_l WHEN 1 THEN o_d || 'o' || o_m || '''' || o_s || '"' || o_l
    WHEN 2 THEN o_d || ' ' || o_m || ' ' || o_s || ' ' || o_l WHEN 3 THEN o_l || ' ' || o_d || '°' || o_m || '''' || o_s || '"'
    WHEN 4 THEN (o_u//1000000) || '.' || lpad((o_u%1000000)::VARCHAR, 6, '0') || ' ' || o_l
    ELSE 'Long. ' || CASE WHEN o_neg=1 THEN '-' ELSE '' END || (o_u//1000000) || '.' || lpad((o_u%1000000)::VARCHAR, 6, '0') END lon_text,
  {len(LEAD)} - CASE WHEN style IN (3,5) THEN 0 ELSE 1 END lat_start FROM micro),
ranges AS (SELECT *, {len(LEAD)} + length(lat_text) lat_end, {len(LEAD)} + length(lat_text) + CASE WHEN style IN (3,5) THEN 2 ELSE 1 END lon_start,
  {len(LEAD)} + length(lat_text) + 2 + length(lon_text) + CASE WHEN style=5 THEN 1 ELSE 0 END lon_end FROM planted),
pfiles AS (SELECT 'f' || o_custkey file_id, o_custkey file_seq, 'doc' || o_custkey || '.pdf' AS name, CASE WHEN o_custkey%13=0 THEN 'unreadable' END AS error,
  CAST(sum(CASE WHEN o_orderkey%5=0 THEN 2 ELSE 1 END) AS INTEGER) num_pages, o_custkey%10=0 hidden FROM orders GROUP BY o_custkey)
"""


def micro(c: Column) -> Column:
    """Integer micro-degrees, rounded half away from zero."""
    return (F.floor(F.abs(c) * 1e6 + 0.5) * F.when(c < 0, -1).otherwise(1)).cast("long")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of events: values that repeat, halves and texts that are missing or not understood."""
    e = F.col("event_id")
    lat = F.when(e % 11 == 0, None).when(e % 13 == 0, None).otherwise((e % 97 - 48).cast("double") + 0.25)
    lon = F.when(e % 11 == 0, None).when(e % 17 == 0, None).otherwise((e % 89 - 44).cast("double") * 2 + 0.125)
    llm = F.struct(
        F.when(e % 3 == 0, "ok").when(e % 3 == 1, "mismatch").alias("verdict"), F.concat(F.lit("note "), e).alias("note"),
        F.when(e % 6 == 1, e % 50 + 0.5).alias("lat"), F.when(e % 12 == 1, e % 70 + 0.5).alias("lon"), F.when(e % 19 == 0, True).alias("del"),
    ).cast(LLM)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), e).alias("row_id"), row_seq(0, F.col("user_id") % N_FILES, 0, 0, e).alias("row_seq"),
        F.when(e % 23 != 0, F.concat(F.lit("f"), F.col("user_id") % N_FILES)).alias("file_id"), (e % 9 + 1).cast("int").alias("page_num"),
        F.array(F.col("event_type"), F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("s, \""), e % 5))).alias("cells"), F.when(e % 10 == 0, "old").otherwise("").alias("notes"),
        lat.alias("lat"), lon.alias("lon"), F.when(e % 13 == 0, F.concat(F.lit(" bad "), e % 3)).alias("lat_raw"), F.when((e % 17 == 0) & (e % 11 != 0), "x").alias("lon_raw"),
        F.when(e % 5 != 0, llm).alias("llm"), F.when(e % 8 == 0, F.col("ts").cast("timestamp")).alias("llm_sent"),
    )


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % N_FILES
    f = table(spark, sf_dir, "events").select(u.alias("u")).distinct()
    return f.select(
        F.concat(F.lit("f"), "u").alias("file_id"), F.col("u").cast("long").alias("file_seq"), F.concat(F.lit("doc"), "u", F.lit(".pdf")).alias("name"),
        F.when(F.col("u") % 9 == 0, "unreadable").alias("error"), F.lit(9).alias("num_pages"), F.lit(None).cast("int").alias("intensity"), (F.col("u") % 7 == 0).alias("hidden"),
    )


EVENTS_SQL = f"""
erows AS (SELECT event_id e, 'r' || event_id row_id, user_id % {N_FILES} fseq, CASE WHEN event_id%23<>0 THEN 'f' || (user_id % {N_FILES}) END file_id, CAST(event_id%9+1 AS INTEGER) page_num,
  event_type c0, CASE WHEN event_id%4=0 THEN '' ELSE 's, "' || (event_id%5) END c1, CASE WHEN event_id%10=0 THEN 'old' ELSE '' END notes,
  CASE WHEN event_id%11=0 OR event_id%13=0 THEN NULL ELSE (event_id%97-48)::DOUBLE + 0.25 END lat,
  CASE WHEN event_id%11=0 OR event_id%17=0 THEN NULL ELSE (event_id%89-44)::DOUBLE*2 + 0.125 END lon,
  CASE WHEN event_id%13=0 THEN ' bad ' || (event_id%3) END lat_raw, CASE WHEN event_id%17=0 AND event_id%11<>0 THEN 'x' END lon_raw,
  event_id%5<>0 has_llm, CASE WHEN event_id%5<>0 THEN CASE WHEN event_id%3=0 THEN 'ok' WHEN event_id%3=1 THEN 'mismatch' END END verdict,
  CASE WHEN event_id%5<>0 AND event_id%6=1 THEN (event_id%50+0.5)::DOUBLE END llm_lat, CASE WHEN event_id%5<>0 AND event_id%12=1 THEN (event_id%70+0.5)::DOUBLE END llm_lon,
  event_id%5<>0 AND event_id%19=0 del, event_id%8=0 sent FROM events),
efiles AS (SELECT DISTINCT 'f' || (user_id % {N_FILES}) file_id, user_id % {N_FILES} fseq, 'doc' || (user_id % {N_FILES}) || '.pdf' AS name, (user_id % {N_FILES})%9=0 failed, (user_id % {N_FILES})%7=0 hidden FROM events),
visible AS (SELECT r.*, row_number() OVER (ORDER BY fseq, e) num FROM erows r WHERE r.file_id IS NULL OR r.file_id NOT IN (SELECT file_id FROM efiles WHERE hidden)),
keyed AS (SELECT *, CASE WHEN lat IS NOT NULL THEN 'n:' || printf('%.6f', lat) WHEN trim(coalesce(lat_raw,''))<>'' THEN 'r:' || trim(lat_raw) ELSE '' END ka,
  CASE WHEN lon IS NOT NULL THEN 'n:' || printf('%.6f', lon) WHEN trim(coalesce(lon_raw,''))<>'' THEN 'r:' || trim(lon_raw) ELSE '' END ko FROM visible)
"""


def word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items: the words of conversations, laid out in lines by arithmetic; every seventh is empty."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[ \\n]+")).alias("i", "word"))
    i = F.col("i")
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("file_id"), F.col("turn").cast("int").alias("page_num"), i.alias("item_seq"), F.when(i % 7 == 6, "").otherwise(F.col("word")).alias("str"),
        (i % 11 == 10).alias("has_eol"), ((i % 5) * 20 + (i % 3)).cast("double").alias("x"), (F.lit(1000) - F.floor(i / 5) * 12).cast("double").alias("y"),
        F.lit(16.0).alias("width"), F.when(i % 4 == 0, 0.0).otherwise(10.0).alias("height"),
    )


ITEMS_SQL = """
words AS (SELECT conv_id, turn, string_split_regex(text, '[ \\n]+') ws FROM conversations),
items AS (SELECT 'c' || conv_id file_id, CAST(turn AS INTEGER) page_num, CAST(i AS INTEGER) item_seq, CASE WHEN i%7=6 THEN '' ELSE ws[i+1] END str, i%11=10 eol,
  CAST((i%5)*20 + (i%3) AS DOUBLE) x, CAST(1000 - (i//5)*12 AS DOUBLE) y, CASE WHEN i%4=0 THEN 8.0 ELSE 10.0 END h FROM words, unnest(range(0, len(ws))) t(i)),
marked AS (SELECT *, length(str)>0 filled FROM items),
prevs AS (SELECT *, last_value(CASE WHEN filled THEN x END IGNORE NULLS) OVER w px, last_value(CASE WHEN filled THEN y END IGNORE NULLS) OVER w py, last_value(CASE WHEN filled THEN h END IGNORE NULLS) OVER w ph,
  last_value(CASE WHEN filled THEN eol WHEN eol THEN true END IGNORE NULLS) OVER w closed FROM marked WINDOW w AS (PARTITION BY file_id, page_num ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
divided AS (SELECT *, CASE WHEN NOT filled THEN '' WHEN px IS NULL OR coalesce(closed,false) THEN '' WHEN abs(y-py) > ph*0.75 THEN chr(10) WHEN x-(px+16.0) > ph*0.12 THEN ' ' ELSE '' END d FROM prevs),
pieces AS (SELECT *, CASE WHEN filled THEN d || str || CASE WHEN eol THEN chr(10) ELSE '' END WHEN eol AND px IS NOT NULL AND NOT coalesce(closed,false) THEN chr(10) ELSE '' END piece FROM divided)
"""
