"""Layout of pages from the places of their words: rows and cells, tables, reading order, and the text that follows.

A page is a group of bounded size (what fits on one sheet), so folds whose state depends on the order run by page; everything
that looks only at the neighbour before is a window. Pages are dealt by document and number, and a page's result depends on
nothing else, so it is the same at any parallelism.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# How far words of one row may differ in height, the share of a character's width below which pieces are one
# word, the gap between cells, how near a cell lies to its column, and the least table; the overlap that makes a line, and
# the share of a page's text that a new one must keep.
ROW_SLACK, PIECE_SHARE, CELL_GAP, COLUMN_SLACK, LEAST_COLUMNS, LEAST_ROWS = 3.0, 0.20, 12.0, 12.0, 3, 3
LINE_OVERLAP, KEPT_SHARE = 0.45, 0.8
NUMBER = r"^[\d\s.,%-]+$"

PAGE = ["doc_id", "side"]


def cells(words: DataFrame) -> DataFrame:
    """``doc_id, side, y, x, tekst, biter`` of each cell of ``words`` (``doc_id, side, nr, x0, y0, x1, tekst``), ``nr`` being their order.

    A word belongs to the first row, in the order in which rows were begun, whose first word lies within 3 points of it. In a
    row, pieces nearer than a fifth of its median character width are one word, and words up to 12 points apart one cell.
    ``biter`` is how many pieces of the cell were put together without a blank. Blank words and null places count for nothing.
    """
    return _page_rows(words).select(*PAGE, "r.y", F.explode(F.arrays_zip("r.celler", "r.biter")).alias("c")).select(*PAGE, "y", "c.celler.x", "c.celler.tekst", "c.biter")


def word_lines(words: DataFrame) -> DataFrame:
    """``lines(cells(words))`` by one reading of each page, no rows for words or cells between."""
    return _page_rows(words).select(*PAGE, "linje", "r.celler", F.col("r.sum").alias("biter"))


_ROWS = "array<struct<y:double,celler:array<struct<x:double,tekst:string>>,biter:array<int>,sum:int>>"


def _page_rows(words: DataFrame) -> DataFrame:
    """``doc_id, side, linje, r``: the rows of each page from the top, with their cells from the left."""
    w = _placed_words(words)
    word = F.struct("nr", "x0", "y0", "x1", "tekst")
    pages = w.groupBy(*PAGE).agg(F.collect_list(word).alias("page"))
    return pages.select(*PAGE, F.posexplode(F.arrow_udf(_rows_of_pages, DataType.fromDDL(_ROWS))("page")).alias("linje", "r"))


def _placed_words(words: DataFrame) -> DataFrame:
    w = words.where(F.trim(F.coalesce("tekst", F.lit(""))) != "").where("x0 is not null and x1 is not null and y0 is not null")
    return w.select(*PAGE, "nr", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1")), "tekst")


def _row_heights(page: np.ndarray, nr: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The height of each word's row: in each round the first word left of every page begins a row and takes all within reach.

    What is no finite height lies in no row (NaN).
    """
    order = np.lexsort((y, nr, page))
    out, left = np.full(len(y), np.nan), order[np.isfinite(y[order])]
    while left.size:
        first = np.diff(page[left], prepend=-1) != 0
        begun = y[left][first][np.cumsum(first) - 1]
        near = np.abs(y[left] - begun) <= ROW_SLACK
        out[left[near]] = begun[near]
        left = left[~near]
    return out


def _rows_of_pages(pages: pa.Array) -> pa.Array:
    """Rows and cells of many pages at a time, over flat arrays of all their words."""
    nr, x0, y0, x1, text = pages.flatten().flatten()
    page = np.repeat(np.arange(len(pages)), pages.value_lengths().to_numpy(zero_copy_only=False))
    rank = lambda a: pc.rank(a, null_placement="at_start", tiebreaker="dense").to_numpy()
    nr, x0, x1 = rank(nr), x0.to_numpy(), x1.to_numpy()
    y = _row_heights(page, nr, y0.to_numpy())
    found = ~np.isnan(y)
    height = np.where(found, y, 0.0)
    o = np.lexsort((nr, rank(text), x1, x0, height, found, page))
    page, x0, x1, found, height, text = page[o], x0[o], x1[o], found[o], height[o], text.take(pa.array(o))

    new_row = (np.diff(page, prepend=-1) != 0) | (np.diff(found, prepend=False) != 0) | (np.diff(height, prepend=0.0) != 0)
    new_row[:1] = True
    row, starts = np.cumsum(new_row) - 1, np.flatnonzero(new_row)
    width, counts = (x1 - x0) / pc.utf8_length(text).to_numpy(), np.diff(np.append(starts, len(x0)))
    width = width[np.lexsort((width, row))]
    low, high = width[starts + (counts - 1) // 2], width[starts + counts // 2]
    limit = PIECE_SHARE * np.where(low == high, low, 0.5 * low + 0.5 * high)[row]
    gap = x0 - np.concatenate((x1[:1], x1[:-1]))
    # As in SQL, NaN is above all numbers.
    joined = ~new_row & ((limit > 0) | np.isnan(limit)) & ((gap < limit) | (np.isnan(limit) & ~np.isnan(gap)))
    new = new_row | (~joined & ((gap > CELL_GAP) | np.isnan(gap)))

    cell = np.flatnonzero(new)
    put = pc.binary_join_element_wise(pc.if_else(pa.array(joined | new), "", " ").cast(text.type), text, pa.scalar("", text.type))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cell, len(x0)), pa.int32()), put), pa.scalar("", text.type))
    pieces, x, of_row = np.add.reduceat(joined.astype(np.int32), cell) if len(cell) else np.zeros(0, np.int32), x0[cell], row[cell]
    o = np.lexsort((rank(texts), x, of_row))
    x, texts, pieces = x[o], texts.take(pa.array(o)), pieces[o]

    ends = np.searchsorted(of_row, np.arange(len(starts) + 1)).astype(np.int32)
    cells_ = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x), texts], ["x", "tekst"]))
    total = np.diff(np.concatenate(([0], np.cumsum(pieces, dtype=np.int64)))[ends]).astype(np.int32)
    rows = [pa.array(height[starts], mask=~found[starts]), cells_, pa.ListArray.from_arrays(ends, pa.array(pieces)), pa.array(total)]
    by_page = np.searchsorted(page[starts], np.arange(len(pages) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(by_page, pa.StructArray.from_arrays(rows, ["y", "celler", "biter", "sum"]))


def lines(cell_rows: DataFrame) -> DataFrame:
    """``doc_id, side, linje, celler, biter``: cells from left to right of each row, rows from the top, numbered from 0."""
    one = cell_rows.groupBy(*PAGE, "y").agg(F.array_sort(F.collect_list(F.struct("x", "tekst"))).alias("celler"), F.sum("biter").cast("int").alias("biter"))
    return one.withColumn("linje", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y")) - 1).select(*PAGE, "linje", "celler", "biter")


class Columns:
    """Starts of a table's columns, which grow with each row that fits them."""

    def __init__(self, starts: list[float]):
        self.starts = list(starts)

    def take(self, starts: list[float]) -> bool:
        """Whether every start lies near a column that is known already; only such rows belong to the table."""
        return all(any(abs(s - x) <= COLUMN_SLACK for s in self.starts) for x in starts)

    def place(self, x: float) -> int:
        """The nearest column, of two equally near ones the left; the columns are sorted."""
        k = bisect.bisect_left(self.starts, x)
        if k and (k == len(self.starts) or x - self.starts[k - 1] <= self.starts[k] - x):
            return bisect.bisect_left(self.starts, self.starts[k - 1])
        return k


def _tables_of_page(page: list[tuple]) -> list[tuple]:
    """Rows of the page's tables: table, row, line, column, text, and whether the row names the columns."""
    return _found_tables([(n, [(float(c["x"]), c["tekst"]) for c in cells_]) for n, cells_ in page])


def _found_tables(rows: list[tuple]) -> list[tuple]:
    """``_tables_of_page`` of lines whose cells are tuples."""
    out, at, table = [], 0, 0
    while at < len(rows):
        columns = Columns([x for x, _ in rows[at][1]])
        end = at + 1
        while end < len(rows) and columns.take([x for x, _ in rows[end][1]]):
            end += 1
        if end - at < LEAST_ROWS:
            at += 1
            continue
        columns.starts.sort()
        for number, (line, row) in enumerate(rows[at:end]):
            held = [""] * len(columns.starts)
            for x, text in row:
                k = columns.place(x)
                held[k] = f"{held[k]} {text}".strip()
            named = number == 0 and not any(re.match(NUMBER, t.strip()) and re.search(r"\d", t) for t in held if t)
            out += [(table, number, line, k, text, named) for k, text in enumerate(held)]
        table, at = table + 1, end
    return out


def tables(line_rows: DataFrame) -> DataFrame:
    """``doc_id, side, tabell, rad, linje, kolonne, tekst, overskrift`` of every cell, empty ones too, of the tables among ``lines``.

    A table is three or more lines of three or more cells in a row (lines of fewer cells between them do not count), whose cells
    begin where the first line's columns do. ``overskrift`` marks the cells of a first row without a number. Lines that belong
    to no table give no rows.
    """
    wide = line_rows.where(F.size("celler") >= LEAST_COLUMNS)
    return _by_page(wide, ["linje", "celler"], "tabell:int,rad:int,linje:int,kolonne:int,tekst:string,overskrift:boolean", _tables_of_page)


def _page_starts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where the pages of sorted words begin."""
    codes = [pc.dictionary_encode(table.column(c), null_encoding="encode") for c in PAGE]
    codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy() for c in codes]
    return np.flatnonzero(np.logical_or.reduce([np.diff(c, prepend=-1) != 0 for c in codes]))


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted words cut where a page begins, so that none lies in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_page_starts(batch)[-1])
        goes_on = held and len(_page_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks())) == 1
        if last or (held and not goes_on):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _built_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's text as built from its words, and whether it has words in pieces and tables with named columns."""
    for words in _whole_pages(batches):
        starts = _page_starts(words)
        fields = ["nr", "x0", "y0", "x1", "tekst"]
        flat = pa.StructArray.from_arrays([words.column(c).combine_chunks() for c in fields], fields)
        made = _rows_of_pages(pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), flat))
        _, cells_, _, pieces = made.flatten().flatten()
        x, text = cells_.flatten().flatten()
        cell = zip(x.to_pylist(), text.to_pylist(), strict=True)
        rows = iter([(list(itertools.islice(cell, n)), p) for n, p in zip(cells_.value_lengths().to_pylist(), pieces.to_pylist(), strict=True)])
        texts = [_text_of_page(list(itertools.islice(rows, n))) for n in made.value_lengths().to_pylist()]
        new, parts, tables_ = zip(*texts, strict=True)
        keys = words.select(PAGE).take(pa.array(starts)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() for c in PAGE), pa.array(new, pa.string()), pa.array(parts, pa.bool_()), pa.array(tables_, pa.bool_())], [*PAGE, "ny", "biter", "tabell"])


def _text_of_page(rows: list[tuple]) -> tuple[str, bool, bool]:
    """The text of a page's rows (cells, pieces), whether it has words in pieces, and whether it has a table with named columns."""
    said: dict[int, list[str]] = {}
    heads: dict[int, list[str]] = {}
    for table, _, line, column, text, named in _found_tables([(n, c) for n, (c, _) in enumerate(rows) if len(c) >= LEAST_COLUMNS]):
        value = text.strip(" ")
        if named:
            heads.setdefault(table, []).append(value)
        if table in heads:
            name = "" if named else heads[table][column]
            parts = said.setdefault(line, ["[TABELL: "] if named else [""])
            if value and (named or name):
                parts.append(value if named else f"{name}: {value}")
    lines_ = []
    for n, (cells_, _) in enumerate(rows):
        if n not in said:
            lines_.append(" ".join(t for _, t in cells_))
        else:
            kind, *parts = said[n]
            lines_.append(f"{kind}{', '.join(parts)}]" if kind else " | ".join(parts))
    return "\n".join(lines_), any(p > 0 for _, p in rows), bool(said)


def page_texts(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, side, tekst, byttet`` of ``pages`` (``doc_id, side, tekst``): the text built from the places of ``words`` where that gains.

    A page's text is exchanged only if it has a table with named columns or words in pieces, and only for one that keeps 80 %
    of its length. Lines of a named table say the column before each cell; empty cells are left out. A null text is empty.
    """
    # The window brings a page's words together, in order, without building an array of them; the sort is the window's own. Its number
    # goes along, or Spark would leave the window out.
    w = _placed_words(words).withColumn("plass", F.row_number().over(Window.partitionBy(*PAGE).orderBy("nr"))).sortWithinPartitions(*PAGE, "nr")
    kinds = ", ".join(f"{c} {w.schema[c].dataType.simpleString()}" for c in PAGE)
    built = w.mapInArrow(_built_texts, f"{kinds}, ny string, biter boolean, tabell boolean")
    bare = lambda c: F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    p = pages.select(*PAGE, F.coalesce("tekst", F.lit("")).alias("gammel")).join(built, PAGE, "left")
    better = F.coalesce((F.col("biter") | F.col("tabell")) & (bare("ny") >= KEPT_SHARE * bare("gammel")), F.lit(False))
    return p.select(*PAGE, F.when(better, F.col("ny")).otherwise(F.col("gammel")).alias("tekst"), better.alias("byttet"))


def _order_of_page(regions: list[tuple]) -> list[tuple]:
    """Lines by overlap with a running median band, from the top; regions (``nr, x0, y0, y1, tekst``) of a line from the left, with their
    places in the text."""
    middle = [(r[2] + r[3]) / 2 for r in regions]
    first, last, tops, bottoms, members = [], [], [], [], []  # each line's band, its edges and its regions
    for i in sorted(range(len(regions)), key=lambda i: (middle[i], regions[i][1], regions[i][0])):
        _, _, top, bottom, _ = regions[i]
        k, most = -1, -math.inf
        for j in range(len(members)):
            share = (min(bottom, last[j]) - max(top, first[j])) / max(min(bottom - top, last[j] - first[j]), 1.0)
            if share > most:
                k, most = j, share
        if most < LINE_OVERLAP:
            k = len(members)
            for of_lines, new in ((first, 0.0), (last, 0.0), (tops, []), (bottoms, []), (members, [])):
                of_lines.append(new)
        bisect.insort(tops[k], top)
        bisect.insort(bottoms[k], bottom)
        members[k].append(i)
        first[k], last[k] = tops[k][len(tops[k]) // 2], bottoms[k][len(bottoms[k]) // 2]
    out, at = [], 0
    means = [sum(middle[i] for i in m) / len(m) if len(m) < 8 else np.mean([middle[i] for i in m]) for m in members]
    for number, k in enumerate(sorted(range(len(members)), key=means.__getitem__)):
        for place, i in enumerate(sorted(members[k], key=lambda i: regions[i][1])):
            nr, _, _, _, text = regions[i]
            at += 1 if number or place else 0
            out.append((nr, number, place, at, at + len(text), text))
            at += len(text)
    return out


def _by_page(rows: DataFrame, columns: list[str], made: str, work: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``work`` on the rows of each page, sorted by ``columns``: pages come to it many at a time, as arrays, and go back as rows of ``made``."""
    kind = DataType.fromDDL(f"array<struct<{made}>>")
    arrow = to_arrow_type(kind)

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([work([tuple(r.values()) for r in page]) for page in pages.to_pylist()], type=arrow)

    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("page"))
    return pages.select(*PAGE, F.explode(F.arrow_udf(run, kind)("page")).alias("r")).select(*PAGE, "r.*")


def reading_order(regions: DataFrame) -> DataFrame:
    """``doc_id, side, nr, linje, plass, start, slutt, tekst`` of ``regions`` (``doc_id, side, nr, x0, y0, x1, y1, tekst``).

    A region joins the line whose band it overlaps most, if by 45 % of the lower of the two; a band is the median of its
    members' edges, so that a tall one cannot draw in the next line. ``start`` and ``slutt`` are the region's place in the
    page's text, regions of a line a blank apart and lines a line break. Blank texts and null places count for nothing.
    """
    r = regions.withColumn("tekst", F.regexp_replace(F.coalesce("tekst", F.lit("")), r"(?U)^\s+|\s+$", "")).where("tekst <> '' and x0 is not null and y0 is not null and y1 is not null")
    columns, number = ["nr", "x0", "y0", "y1", "tekst"], r.schema["nr"].dataType.simpleString()
    r = r.select(*PAGE, "nr", *(F.col(c).cast("double").alias(c) for c in columns[1:4]), "tekst")
    return _by_page(r, columns, f"nr:{number},linje:int,plass:int,start:int,slutt:int,tekst:string", _order_of_page)


def ordered_text(placed: DataFrame) -> DataFrame:
    """``doc_id, side, tekst``: each page's regions in reading order."""
    line = placed.groupBy(*PAGE, "linje").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plass", "tekst"))), lambda s: s["tekst"]), " ").alias("tekst"))
    return line.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linje", "tekst"))), lambda s: s["tekst"]), "\n").alias("tekst"))
