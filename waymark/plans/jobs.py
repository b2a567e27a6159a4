"""Composed jobs: scan a corpus, scan it again, have its rows reviewed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import DEFAULT_LEVEL
from ..operators import assist
from ..operators.extract import build_detections, fresh_rows, scan_coordinates
from ..operators.pagetext import placed_pieces, spans_of_pieces, text_of_pieces
from ..operators.readings import scan_by_store
from ..operators.rows import as_table_rows, remove_duplicates, remove_rows, rescan_merge
from ..sources.shared import numbered, written


def _scan(pages: DataFrame, files: DataFrame, suppressed: DataFrame, level: int, store: str | None) -> DataFrame:
    return scan_by_store(pages, files, suppressed, store, level) if store else scan_coordinates(pages, files, suppressed, level)


def scan_job(items: DataFrame, files: DataFrame, suppressed: DataFrame, n_cols: int = 2, level: int = DEFAULT_LEVEL, store: str | None = None) -> dict[str, DataFrame]:
    """Pages, rows and detections of a corpus of text items. What is read goes into the folder ``store``, if one is given."""
    placed = written(placed_pieces(items), "pieces")
    pages, spans = written(text_of_pieces(placed), "pages"), spans_of_pieces(placed)
    coords = _scan(pages, files, suppressed, level, store)
    rows = as_table_rows(fresh_rows(coords, n_cols), files)
    return {"pages": pages, "files": files, "rows": rows, "dets": build_detections(coords, spans), "suppressed": suppressed}


def rescan_job(pages: DataFrame, files: DataFrame, rows: DataFrame, dets: DataFrame, suppressed: DataFrame, n_cols: int = 2, level: int = DEFAULT_LEVEL, dedup: bool = False, store: str | None = None) -> dict[str, DataFrame]:
    """The table after detection at another level: edits stay, deleted places stay deleted. With a ``store`` of an
    earlier scan only new and changed texts, and those at another level, are read."""
    scannable = pages.join(files.where("error is null").select("file_id"), "file_id", "left_semi")
    coords = _scan(scannable, files, suppressed, level, store)
    fresh = as_table_rows(fresh_rows(coords, n_cols), files)
    new_rows, new_dets = rescan_merge(rows, dets, coords, build_detections(coords).drop("rects"), fresh, files)
    if dedup:
        new_rows = written(new_rows, "rows")
        new_rows, new_dets, suppressed = remove_duplicates(new_rows, new_dets, suppressed, files)
    return {"pages": pages, "files": files, "rows": new_rows, "dets": new_dets, "suppressed": suppressed}


def _ask(chunks: DataFrame, tasks: assist.Tasks, kind: str, model: str, transport: Callable, pass_: int, parallel: int) -> DataFrame:
    """Results of all chunks of a pass, asked in the order of their keys. The replies are written, so nothing is asked twice."""
    keys = [c for c in chunks.columns if c not in ("pages", "rows")]
    requests = assist.build_requests(assist.build_prompt(numbered(chunks, *keys, name="request_seq"), tasks), kind, model)
    replies = assist.call_in_slices(requests, transport, parallel)
    text = assist.extract_text(replies, kind).where("error is null").select(F.lit(pass_).alias("pass"), "request_seq", "text")
    return written(assist.parse_results(text, len(tasks.cols)), f"results-{pass_}")


def assist_job(tables: dict[str, DataFrame], tasks: assist.Tasks, transport: Callable, kind: str = "openai", model: str = "model", second: tuple[str, str] | None = None, scope: str = "detected", per_page: bool = False, parallel: int = 4) -> dict[str, DataFrame]:
    """A review run: first pass, page walks back and forth, retries of rows without an answer, a second model for
    unfinished rows and for flags, and the time of the answer. ``second`` in the result counts the rows that the second
    model was asked about and those that it finished (n_retried, n_fixed)."""
    files, pages, suppressed = tables["files"], tables["pages"], tables["suppressed"]
    rows, dets = written(tables["rows"], "rows"), tables["dets"]
    work, _ = assist.select_llm_work(rows, files, unsent_only=True)
    work = written(work, "work")
    sent = work.select(F.col("id").alias("row_id"))
    send = written(assist.pages_to_send(pages, dets, scope), "pages-to-send")
    step = 0

    def merge(results: DataFrame) -> None:
        nonlocal rows, dets, suppressed
        new, gone = assist.apply_results(rows, results, tasks)
        new = written(new, "rows")
        if tasks.auto_delete:
            new, dets, suppressed = remove_rows(new, dets, suppressed, gone)
            new = written(new, "rows")
        rows = new

    def chunked(some: DataFrame) -> DataFrame:
        return assist.chunk_per_page(send, some) if per_page and scope != "all" else assist.chunk_work(send, some)

    def ask(chunks: DataFrame, with_: assist.Tasks, who: tuple[str, str]) -> DataFrame:
        nonlocal step
        step += 1
        return _ask(chunks, with_, *who, transport, step, parallel)

    wants = scope != "all" and (tasks.fill or tasks.genus or tasks.species or bool(tasks.extra.strip()))

    def run(some: DataFrame, who: tuple[str, str]) -> None:
        first = ask(chunked(some), replace(tasks, allow_prev=wants, allow_next=wants), who)
        merge(first)
        for way in ("prev", "next") if wants else ():
            results, bounds = first, None
            for n in range(1, assist.WALK_PASSES + 1):
                windows = written(assist.needs_page(results, some, files, way, bounds), "windows")
                if windows.isEmpty():
                    break
                further = n < assist.WALK_PASSES
                results = ask(assist.window_chunks(windows, pages, some), replace(tasks, allow_prev=further and way == "prev", allow_next=further and way == "next"), who)
                bounds = windows.select(F.explode("ids").alias("id"), "bound")
                merge(results)
        for _ in range(assist.BADGE_RETRIES if tasks.verify else 0):
            missing = written(assist.unbadged(rows, some.select(F.col("id").alias("row_id"))), "unbadged")
            if missing.isEmpty():
                break
            left = some.join(missing.select(F.explode("ids").alias("id")), "id", "left_semi")
            merge(ask(assist.chunk_per_page(pages.select("file_id", F.col("page_num").cast("int"), "text"), left), tasks, who))

    run(work, (kind, model))
    counts = work.limit(0).agg(F.lit(0).cast("long").alias("n_retried"), F.lit(0).cast("long").alias("n_fixed"))
    if second:
        rest = assist.unfinished(rows.join(sent, "row_id", "left_semi"), tasks).withColumnRenamed("row_id", "id")
        again = written(work.join(rest, "id", "left_semi"), "again")
        if not again.isEmpty():
            run(again, second)
            asked = again.select(F.col("id").alias("row_id"))
            left = assist.unfinished(rows.join(asked, "row_id", "left_semi"), tasks).withColumn("left", F.lit(1))
            counts = asked.join(left, "row_id", "left").agg(F.count("*").alias("n_retried"), F.count_if(F.col("left").isNull()).alias("n_fixed"))
        if tasks.flag and not tasks.auto_delete:
            flagged = work.join(rows.where("llm.del").select(F.col("row_id").alias("id")), "id", "left_semi")
            only = replace(tasks, verify=False, genus=False, species=False, fill=False, notes=False, allow_prev=False, allow_next=False)
            rows, dets, suppressed = assist.confirm_deletes(rows, dets, suppressed, ask(chunked(flagged), only, second))
    rows = assist.mark_sent(rows, sent, F.current_timestamp())
    return {**tables, "rows": rows, "dets": dets, "suppressed": suppressed, "second": counts}
