"""Searches whose matches run over line ends.

A pattern is matched on the whole text, with ``.`` for line ends as well; where a match begins and ends is
found in the text's line starts by binary search. A text is read once, whatever the number of its matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.search import HEAD_LIMIT, MOST_COLUMNS, MOST_LIMIT

FLAGS = re.DOTALL | re.MULTILINE


def matched_lines(text: str, pattern: re.Pattern, around: int) -> tuple[int, list[tuple[int, bool]], list[int]]:
    """Matches of a text; (line from 0, whether a match touches it) with ``around`` lines before and after,
    each once; and where lines start. An empty match touches the line it is in; a match that ends in a
    line end doesn't touch the line after."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    last = len(starts) - 1 - (len(text) > 0 and text.endswith("\n"))
    count, touched = 0, -1
    spans: list[tuple[int, int]] = []
    for m in pattern.finditer(text):
        count += 1
        first = min(bisect_right(starts, m.start()) - 1, max(last, 0))
        end = max(first, min(bisect_right(starts, max(m.end() - 1, m.start())) - 1, max(last, 0)))
        if spans and first <= touched + 1:
            spans[-1] = (spans[-1][0], max(end, touched))
        else:
            spans.append((first, end))
        touched = spans[-1][1]
    out: list[tuple[int, bool]] = []
    shown = -1
    for i, (a, b) in enumerate(spans):
        stop = min(max(last, 0), b + around)
        if i + 1 < len(spans):
            stop = min(stop, spans[i + 1][0] - 1)
        out += [(n, a <= n <= b) for n in range(max(shown + 1, a - around, 0), stop + 1)]
        shown = stop
    return count, out, starts


def _run(docs: DataFrame, pattern: str, ignore_case: bool, around: int, lines: bool) -> DataFrame:
    flags = FLAGS | (re.IGNORECASE if ignore_case else 0)
    re.compile(pattern, flags)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern, flags)
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                count, found, starts = matched_lines(text, compiled, around) if text is not None else (0, [], [])
                if not count:
                    continue
                if not lines:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), pa.array([count], pa.int64())], ["id", "n"])
                    continue
                cut = [text[starts[i] : starts[i + 1] - 1 if i + 1 < len(starts) else len(text)][:MOST_COLUMNS] for i, _ in found]
                cols = [pa.array([name.as_py()] * len(found), name.type), pa.array([i + 1 for i, _ in found], pa.int32()), pa.array(cut, pa.string()), pa.array([h for _, h in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "number", "line", "hit"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(search, f"id {kind}, number int, line string, hit boolean" if lines else f"id {kind}, n long")


def span_lines(docs: DataFrame, pattern: str, ignore_case: bool = False, around: int = 0) -> DataFrame:
    """(id, number, line, hit): the lines (from 1, cut to MOST_COLUMNS signs) that matches touch, and
    ``around`` lines before and after, each once. Null texts have none."""
    return _run(docs, pattern, ignore_case, around, True)


def span_counts(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(id, n): how many matches each text with one has."""
    return _run(docs, pattern, ignore_case, 0, False)


def span_files(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """The ids of texts with a match."""
    return span_counts(docs, pattern, ignore_case).select("id")


def page(rows: DataFrame, order: list[str], limit: int = HEAD_LIMIT, offset: int = 0) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them (MOST_LIMIT at most). An offset of as many rows as there
    are, or more, is ignored. The limit is the feature: no more than offset and limit rows are numbered."""
    most = min(limit or HEAD_LIMIT, MOST_LIMIT)
    if offset <= 0:
        return rows.orderBy(*order).limit(most)
    skip = offset if rows.limit(offset + 1).count() > offset else 0
    return rows.orderBy(*order).offset(skip).limit(most)
