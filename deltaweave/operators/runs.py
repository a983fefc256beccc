"""Text runs from spans and from OCR words."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import inf, nan

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import strip

PAGE = ["pair_id", "side", "sheet"]


def span_runs(spans: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """spans(PAGE, ord, text, x0, y0, x1, y1, origin_x, origin_y, size) with a run number.

    Spans go by baseline (one decimal), then x. A span joins the one before it if
    their baselines differ by at most half its size and the gap between them is
    from none to three sizes; that looks at one neighbour only, so it is a window.
    """
    order = Window.partitionBy(*PAGE).orderBy(F.round("origin_y", 1), "origin_x", "ord")
    before = lambda c: F.lag(c).over(order)
    gap = F.col("x0") - before("x1")
    joins = (F.abs(F.col("origin_y") - before("origin_y")) <= s.run_baseline * before("size")) & (gap >= 0) & (gap <= s.run_gap * before("size"))
    marked = spans.withColumn("gap", gap).withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("place", F.row_number().over(order))
    return marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _joined(wide: Column) -> Column:
    """Texts in order, with a space where ``wide`` says so, white space made single."""
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat(F.when(wide, " ").otherwise(""), F.col("text")).alias("t"))))
    return strip(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["t"]), ""), r"\s+", " "))


def run_text(runs: DataFrame, width: Column, height: Column, s: Settings = DEFAULT) -> DataFrame:
    """One row for each run: text, box as shares of the sheet, and its anchor (the first span's origin)."""
    return runs.groupBy(*PAGE, "run").agg(
        _joined((F.col("new") == 0) & (F.col("gap") > s.space_gap)).alias("text"),
        (F.min("x0") / F.max(width)).alias("x0"),
        (F.min("y0") / F.max(height)).alias("y0"),
        (F.max("x1") / F.max(width)).alias("x1"),
        (F.max("y1") / F.max(height)).alias("y1"),
        (F.min_by("origin_x", "place") / F.max(width)).alias("anchor_x"),
        (F.min_by("origin_y", "place") / F.max(height)).alias("anchor_y"),
        F.count(F.lit(1)).alias("n_spans"),
    )


def clean_words(words: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """OCR words with text and a confidence (any spelling of a number) of at least the least one."""
    conf = F.expr("try_cast(trim(conf) AS DOUBLE)")
    text = F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))  # the characters of \s; there are many words, and a regular expression is slow
    return words.withColumn("text", text).withColumn("conf", conf).where((F.col("text") != "") & (F.col("conf") >= s.ocr_least_conf))


def _in_order(words: DataFrame) -> DataFrame:
    columns = [*PAGE, "top", "left", "ord", "text", "conf", "width", "height"]
    return words.select(*columns).repartition(*PAGE).sortWithinPartitions(*PAGE, "top", "left", "ord", "text", "conf", "width", "height")


def _numbers(column: pa.Array) -> np.ndarray:
    """A column as floats; nulls are NaN."""
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


class _Bands:
    """Bands of words that stream by in order; all that is kept is the page and the band's first word."""

    def __init__(self, s: Settings):
        self.s, self.page, self.seed, self.reach, self.band, self.group = s, None, nan, nan, 0, 0

    def _turns(self, batch: pa.RecordBatch) -> np.ndarray:
        turns = np.zeros(batch.num_rows, bool)
        for c in PAGE:
            codes = pc.dictionary_encode(batch[c], null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            turns[1:] |= codes[1:] != codes[:-1]
        first, last = (tuple(batch[c][i].as_py() for c in PAGE) for i in (0, batch.num_rows - 1))
        turns[0] = first != self.page
        self.page = last
        return turns

    def _reached(self, tops: list[float], begin: int, end: int) -> int:
        """Where the first word stands, from begin on, that the band's first word does not reach."""
        if self.seed != self.seed or self.reach != self.reach:
            return begin
        return bisect_right(tops, self.reach, begin, end, key=lambda top: top - self.seed if top == top else inf)

    def add(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the band, and a number of it that no other page's band has."""
        tops, heights, turns = _numbers(batch["top"]).tolist(), _numbers(batch["height"]).tolist(), self._turns(batch)
        begins = np.union1d([0], np.flatnonzero(turns)).tolist()
        at, bands, groups = [], [], []
        for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            i = begin
            if turns[begin]:
                self.band, self.seed = 0, nan
            elif (more := self._reached(tops, begin, end)) > begin:
                at, bands, groups, i = [begin], [self.band], [self.group], more
            while i < end:
                self.seed, self.reach, self.band, self.group = tops[i], self.s.run_baseline * heights[i], self.band + 1, self.group + 1
                at.append(i)
                bands.append(self.band)
                groups.append(self.group)
                i = self._reached(tops, i + 1, end)
        sizes = np.diff([*at, batch.num_rows])
        return np.repeat(np.array(bands, np.int32), sizes), np.repeat(np.array(groups, np.int64), sizes)


def word_bands(words: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Words with a band number.

    A word opens a band unless it lies within half the height of the band's first
    word, so each depends on a seed further back: a fold over a page's words in
    the order of (top, left, ord). Rows stream through it sorted by page; all that is
    kept is the seed, so a page may have any number of words.
    """
    sorted_ = _in_order(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _Bands(s)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands.add(batch)[0])], [*batch.schema.names, "band"])

    found = sorted_.mapInArrow(run, ", ".join([*[f"{c} {kind}" for c, kind in sorted_.dtypes], "band int"]))
    return found.select(*PAGE, "band", *sorted_.columns[len(PAGE) :])


def _runs_of(batch: pa.RecordBatch, band: np.ndarray, group: np.ndarray, s: Settings) -> pa.RecordBatch:
    """One row for each run of whole bands."""
    left, width, top, height, conf = (_numbers(batch[c]) for c in ("left", "width", "top", "height", "conf"))
    ord_ = batch["ord"].to_numpy(zero_copy_only=False)
    if batch["ord"].null_count:
        ord_ = np.nan_to_num(ord_.astype(float), nan=-inf)
    order = np.lexsort((ord_, np.where(np.isnan(left), -inf, left), group))
    left, width, top, height, conf, group = (x[order] for x in (left, width, top, height, conf, group))
    right = left + width
    gap = left[1:] - right[:-1]
    joins = (group[1:] == group[:-1]) & (gap >= 0) & (gap <= s.run_gap * height[:-1])
    starts = np.flatnonzero(np.append(True, ~joins))
    opens = np.append(True, np.diff(group[starts]) != 0)
    place = np.arange(len(starts))
    run = place - np.maximum.accumulate(np.where(opens, place, 0)) + 1
    texts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), batch["text"].take(pa.array(order)))
    known = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
    pages = pa.array(order[starts])
    return pa.RecordBatch.from_arrays(
        [
            *(batch[c].take(pages) for c in PAGE), pa.array(band[order[starts]]), pa.array(run, pa.int64()), pc.binary_join(texts, " "),
            *(known(f.reduceat(x, starts)) for f, x in ((np.fmin, left), (np.fmin, top), (np.fmax, right), (np.fmax, top + height))),
            pa.array(np.add.reduceat(np.nan_to_num(conf), starts)), pa.array(np.add.reduceat((~np.isnan(conf)).astype(np.int64), starts)),
        ],
        [*PAGE, "band", "run", "text", "left", "top", "right", "bottom", "_conf", "_n"],
    )


def band_runs(words: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each run of a band: words whose gap to the one before is from none to three of its heights.

    Bands follow each other in the order of word_bands, so they are cut into runs in the
    same stream, without a second shuffle and sort of all words; what is kept is the band
    that is not over yet, one line of a page.
    """
    sorted_ = _in_order(words)
    kinds = dict(sorted_.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held = _Bands(s), []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks().to_batches()[0]
            return _runs_of(whole, np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held]), s)

        for batch in batches:
            if not batch.num_rows:
                continue
            band, group = bands.add(batch)
            last = int(np.searchsorted(group, group[-1]))
            if last or (held and held[-1][2][-1] != group[0]):
                held.append((batch.slice(0, last), band[:last], group[:last]))
                yield out()
                held = []
            held.append((batch.slice(last), band[last:], group[last:]))
        if held:
            yield out()

    found = sorted_.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in PAGE], "band int, run bigint, text string, left double, top double, right double, bottom double, _conf double, _n bigint"]))
    odd = F.col("text").rlike(r"^\s|\s$|\s\s|[\t\n\x0b\f\r]")
    text = F.when(odd, strip(F.regexp_replace("text", r"\s+", " "))).otherwise(F.col("text"))
    return found.select(*PAGE, "band", "run", text.alias("text"), "left", "top", "right", "bottom", F.round(F.try_divide("_conf", "_n") / 100, 4).alias("confidence"))


def native_detect(words_on_first_page: Column, extension: Column, s: Settings = DEFAULT) -> Column:
    """Which adapter claims a file: native and scanned differ by the words on the first page."""
    return (
        F.when(extension == "dwg", "dwg").when((extension == "pdf") & (words_on_first_page >= s.least_words), "pdf_native").when(extension == "pdf", "pdf_scanned")
    )


def revision_label(titles: DataFrame) -> DataFrame:
    """pair_id, side, label: the first revision letter on sheet 1; titles has field, value, ord."""
    return titles.where("sheet = 1 AND field = 'rev'").groupBy("pair_id", "side").agg(F.min_by("value", "ord").alias("label"))
