"""Scan sessions, folded from their events in order.

Events have session, seq, action and, where the action has them, mode, enable_ocr, ocr_text (null:
recognition failed), image, corners. Pages form a stack (the last one can be taken back), so a
session's events are folded one by one; sessions spread over tasks, and within a task events pass in
batches while only the sessions' states stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("start_new_scan", "capture", "save_page", "cancel_edit", "export_complete", "back_to_scanner", "back_to_edit")
DEFAULT_MODE = "document_enhanced"
# The line between the pages of a copied text, and the message of a failed recognition.
PAGE_BREAK = "\n\n--- ページ区切り ---\n\n"
OCR_FAILED = "OCR解析に失敗しました。画像の保存は完了していますが、検索可能な文字情報は埋め込まれていません。"
STATE = "step string, pages array<int>, modes array<string>, ocr map<int,string>, export_mode string, current_mode string, has_image boolean, is_warped boolean, ocr_error string"


@dataclass
class Session:
    step: str = "scan"
    pages: list[int] = field(default_factory=list)
    modes: list[str] = field(default_factory=list)
    ocr: dict[int, str] = field(default_factory=dict)
    export_mode: str = "pdf"
    current_mode: str = DEFAULT_MODE
    has_image: bool = False
    is_warped: bool = False
    ocr_error: str | None = None

    def apply(self, seq: int, action: str, mode: str | None, enable_ocr: bool | None, ocr_text: str | None) -> None:
        if action in ("start_new_scan", "export_complete"):
            self.pages, self.modes, self.ocr, self.has_image, self.ocr_error, self.step = [], [], {}, False, None, "scan"
        elif action == "capture":
            self.has_image, self.is_warped, self.current_mode, self.ocr_error, self.step = True, False, DEFAULT_MODE, None, "edit"
        elif action == "save_page":
            self.export_mode, self.current_mode, self.ocr_error = ("pdf" if enable_ocr else "jpeg"), mode, None
            self.modes.append(mode)
            if enable_ocr and ocr_text is not None:
                self.ocr[len(self.pages)] = ocr_text
            elif enable_ocr:
                self.ocr_error = OCR_FAILED
            self.pages.append(seq)
            self.step = "export"
        elif action == "cancel_edit":
            self.has_image, self.step = False, ("export" if self.pages else "scan")
        elif action == "back_to_scanner":
            self.has_image, self.ocr_error, self.step = False, None, "scan"
        elif action == "back_to_edit":
            self.ocr.pop(len(self.pages) - 1, None)
            self.pages = self.pages[:-1]
            self.current_mode = (self.modes[-1] if self.modes else None) or DEFAULT_MODE
            self.modes = self.modes[:-1]
            self.ocr_error, self.is_warped, self.step = None, True, "edit"


def fold_sessions(events: DataFrame) -> DataFrame:
    """session and its state after its last event; pages holds the seq of each page's save. Unknown actions change nothing."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = None, None, []

        def row() -> tuple:
            return (key, state.step, state.pages, state.modes, dict(state.ocr), state.export_mode, state.current_mode, state.has_image, state.is_warped, state.ocr_error)

        columns = ["session", "step", "pages", "modes", "ocr", "export_mode", "current_mode", "has_image", "is_warped", "ocr_error"]
        for pdf in batches:
            for e in pdf.itertuples(index=False):
                if state is None or e.session != key:
                    if state is not None:
                        done.append(row())
                    key, state = e.session, Session()
                plain = lambda v: None if v is None or v is pd.NA or v != v else v
                state.apply(int(e.seq), e.action, plain(e.mode), plain(e.enable_ocr), plain(e.ocr_text))
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if state is not None:
            yield pd.DataFrame([row()], columns=columns)

    slim = events.select(F.col("session").cast("long").alias("session"), F.col("seq").cast("long").alias("seq"), "action", "mode", "enable_ocr", "ocr_text").where("session is not null")
    return slim.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(fold, f"session long, {STATE}")


def page_indexes(saves: DataFrame) -> DataFrame:
    """Adds page, from 0 in the order of seq within a session: for logs that only add pages."""
    return saves.withColumn("page", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1)


def pages_with_text(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Each page with its recognised text, if it has one."""
    return pages.join(ocr, ["session", "page"], "left")


def copied_text(ocr: DataFrame) -> DataFrame:
    """session and the text of all its recognised pages in order, with page breaks; pages without text add none."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text"))))
    return ocr.groupBy("session").agg(F.array_join(F.transform(parts, lambda s: s["text"]), PAGE_BREAK).alias("text"))


def rotation_after(turns: DataFrame) -> DataFrame:
    """Adds rotation: the angle after each turn of 90 (right) or -90 degrees in delta, in order of seq."""
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("rotation", F.pmod(F.sum("delta").over(order), F.lit(360)).cast("int"))


def page_to_save(preview: Column, computed: Column) -> Column:
    """The preview if there is one, else the page computed now; rows where both are null are not saved."""
    return F.coalesce(preview, computed)
