"""Periodic runs of words: sparse diagonals of word matches, followed online from word to word."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

#: A word, and its form in Spark's functions.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(words: Sequence[str], least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run: a stretch of smallest period q, of max(least, repeats * q) words or
    more, that no neighbouring word extends. `repeats` is 2 or more.

    A diagonal is a lag d with the first word of the stretch over which words d apart agree. Each word
    extends the diagonals it agrees with; those it ends are runs, if long enough, at once. It also opens
    diagonals to its earlier occurrences, but at word i only for lags below twice the largest power of
    two that divides i: a run of lag d agrees over at least d words, so one of them is a multiple of the
    power of two below d, and the words before it are counted back. A lag that is a multiple of an open
    one whose stretch holds the earlier occurrence ends with it, and is not opened. A text thus costs
    about words times the logarithm of words, however often it repeats itself.

    Of equal stretches the smallest lag is the period; the others are multiples of it.
    """
    n = len(words)
    farthest = n // repeats
    found: dict[tuple[int, int], int] = {}
    diagonals: dict[int, int] = {}
    latest: dict[str, int] = {}
    before = [-1] * n                                 # the occurrence before each word's own

    def close(lag: int, stop: int) -> None:
        start = diagonals.pop(lag)
        if stop - start >= max(least, repeats * lag):
            found[start, stop] = min(lag, found.get((start, stop), lag))

    for i, word in enumerate(words):
        if diagonals:
            for lag in [d for d in diagonals if words[i - d] != word]:
                close(lag, i)
        j = before[i] = latest.get(word, -1)
        latest[word] = i
        if j < 0:
            continue
        reach = i - min(2 * (i & -i) - 1, farthest)
        if j < reach:
            continue
        # Only a stretch of twice its lag can hold a multiple of it; few lags have such stretches at the same word.
        repeating = [(d, s) for d, s in diagonals.items() if i - s >= 2 * d]
        while j >= reach and j >= 0:
            lag = i - j
            if lag not in diagonals and not any(lag % d == 0 and j >= s for d, s in repeating):
                start = j
                while start and words[start - 1] == words[start - 1 + lag]:
                    start -= 1
                diagonals[lag] = start
                if i - start >= 2 * lag:
                    repeating.append((lag, start))
            j = before[j]
    for lag in list(diagonals):
        close(lag, n)
    return sorted((start, stop - start, lag) for (start, stop), lag in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats most often (greatest length / period); ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: Sequence[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return list(words)
    kept, at = [], 0
    for start, stop in sorted((start + period, start + length) for start, length, period in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, stop)
    return kept + list(words[at:])


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, repeats: int = 4) -> DataFrame:
    """One row per input row: key, n_words, runs (by start, then period), strongest (null if none), collapsed (text).

    `collapsed` has the kept words joined by one space. Whole texts are searched, each in its task. A null
    or empty text has no words, no runs and an empty `collapsed`; null keys and repeated rows are kept as
    they are; an empty table gives an empty one; other columns are not read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def as_rows(runs):
            return [dict(zip(("start", "length", "period"), run)) for run in runs]

        for batch in sliced(batches):
            counts, runs, best, texts = [], [], [], []
            for value in batch.column(1):
                words = WORD.findall(value.as_py())
                of_text = periodic_runs(words, least, repeats)
                top = strongest(of_text)
                counts.append(len(words))
                runs.append(as_rows(of_text))
                best.append(as_rows([top])[0] if top else None)
                texts.append(" ".join(collapsed(words, of_text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(best, kind),
                 pa.array(texts, pa.string())], ["key", "n_words", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(
        search, f"key {dict(rows.dtypes)['key']}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def listed(runs: Column) -> Column:
    """Every run as `start,length,period` and a line feed, in one text."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n"))), "")
