"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from its own features and those of the lines around it;
transition scores tie neighbouring labels. Forward-backward gives the probability that a line is good,
and a document's quality is the mean over its lines weighted by their length, mapped to a probability
by a logistic curve. The field and the curve are trained here, on labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

#: Labelled documents that the field is trained on at most, those of the smallest hash; and lines in one of them at most.
TRAINING_DOCUMENTS = 6000
#: Lines in the whole sample: some 1.2 KB each while training.
TRAINING_ROWS = 400_000
TRAINING_LINES = 300
BINS = 8

FEATURES = ("chars", "words", "word_length", "upper", "digits", "symbols", "bars", "stops", "distinct", "repeats",
            "ends", "again")

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:?'\"()-+@/_="
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _STOPS)


def line_features(text: str) -> np.ndarray:
    """One row of FEATURES per line of the whole text; an empty text is one empty line."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    for i, line in enumerate(lines):
        n = len(line)
        if not n:
            continue
        words = line.split()
        count = max(1, len(words))
        letters = n - len(line.translate(None, _LETTERS))
        out[i] = (
            n, count, n / count, (n - len(line.translate(None, _UPPER))) / max(1, letters),
            (n - len(line.translate(None, _DIGITS))) / n, (n - len(line.translate(None, _SYMBOLS))) / n,
            line.count(b"|") / count, (n - len(line.translate(None, _STOPS))) / count,
            len(set(words)) / count, sum(map(bytes.__eq__, words, words[1:])) / count,
            line[-1] in b".!?", seen[line] > 1)
    out[:, :2] = np.log1p(out[:, :2])
    return out


@dataclass
class Field:
    """Bin limits of the features, line weights (label good against bad), transition scores and the curve's parameters."""

    limits: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray

    def line_scores(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return design(raw, first, last, self.limits) @ self.weights.astype(np.float32)

    def document_scores(self, raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores in (0, 1) of documents whose lines follow each other in `raw`."""
        chains = Chains(counts)
        good = chains.marginals(self.line_scores(raw, chains.first, chains.last), self.moves)[0]
        return self.calibrated(weighted_means(good, raw, chains))

    def calibrated(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * spread(means))))


def spread(means: np.ndarray) -> np.ndarray:
    """Log-odds of a mean marginal, kept finite."""
    kept = np.clip(means, 1e-9, 1 - 1e-9)
    return np.log(kept / (1 - kept))


def weighted_means(good: np.ndarray, raw: np.ndarray, chains: Chains) -> np.ndarray:
    weight = np.expm1(raw[:, 0].astype(np.float64)) + 1
    return np.add.reduceat(good * weight, chains.starts) / np.add.reduceat(weight, chains.starts)


def design(raw: np.ndarray, first: np.ndarray, last: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """0/1 matrix: the bins of a line's own features, of the line before and of the line after, its place, and a constant."""
    n, kinds = raw.shape
    bins = np.stack([np.searchsorted(limits[k], raw[:, k], side="right") for k in range(kinds)], axis=1)
    width = kinds * BINS
    columns = bins + np.arange(kinds) * BINS
    rows = np.arange(n)[:, None]
    out = np.zeros((n, 3 * width + 3), np.float32)
    out[rows, columns] = 1
    inner = np.flatnonzero(~first)
    out[inner[:, None], width + columns[inner - 1]] = 1
    inner = np.flatnonzero(~last)
    out[inner[:, None], 2 * width + columns[inner + 1]] = 1
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1
    return out


class Chains:
    """Lines of many documents, one after the other; every pass works on all documents at once, line by line."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.starts = np.cumsum(counts) - counts
        self.first = np.zeros(int(counts.sum()), bool)
        self.first[self.starts] = True
        self.last = np.zeros(len(self.first), bool)
        self.last[self.starts + counts - 1] = True
        self.order = np.argsort(-counts, kind="stable")
        self.active = np.searchsorted(-counts[self.order], -np.arange(int(counts.max())), side="left")

    def marginals(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(line is good), and P(labels of a line and the next) as (lines, 2, 2), zero at last lines.

        `scores` is the log-odds of good; label 1 is good. Messages are scaled to sum one at each line.
        """
        scores = scores.astype(np.float64)
        emit = np.exp(np.stack([-scores / 2, scores / 2], axis=1).clip(-30, 30))
        factor = np.exp(moves)
        ahead, scale = np.empty_like(emit), np.empty(len(emit))
        starts = self.starts[self.order]
        for step, active in enumerate(self.active):
            at = starts[:active] + step
            value = emit[at] * (ahead[at - 1] @ factor if step else 1.0)
            total = value.sum(axis=1)
            ahead[at], scale[at] = value / total[:, None], total
        behind = np.ones_like(emit)
        for step in range(len(self.active) - 2, -1, -1):
            at = starts[:self.active[step + 1]] + step
            behind[at] = ((emit[at + 1] * behind[at + 1]) @ factor.T) / scale[at + 1][:, None]
        good = (ahead[:, 1] * behind[:, 1]) / (ahead * behind).sum(axis=1)
        pairs = np.zeros((len(emit), 2, 2))
        inner = np.flatnonzero(~self.last)
        joint = ahead[inner][:, :, None] * factor * (emit[inner + 1] * behind[inner + 1])[:, None, :]
        pairs[inner] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return good, pairs


def quantile_limits(raw: np.ndarray) -> np.ndarray:
    return np.stack([np.quantile(raw[:, k], np.arange(1, BINS) / BINS) for k in range(raw.shape[1])])


def fitted(raw: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 150, shrink: float = 1e-3) -> Field:
    """Trains by gradient ascent (Adam) on the mean log-likelihood of the lines' labels, each line taking its document's.

    Lines weigh the same within a document and documents weigh the same, so that long ones do not rule.
    """
    limits = quantile_limits(raw)
    chains = Chains(counts)
    x = design(raw, chains.first, chains.last, limits)
    truth = np.repeat(labels, counts).astype(np.float64)
    share = np.repeat(1 / counts / len(counts), counts)
    inner = (~chains.last).astype(np.float64) * share
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    known = np.zeros((len(truth), 2, 2))
    known[np.arange(len(truth)), truth.astype(int), truth.astype(int)] = 1
    state = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for step in range(1, steps + 1):
        good, pairs = chains.marginals(x @ weights.astype(np.float32), moves)
        slope = np.concatenate((x.T @ ((truth - good) * share).astype(np.float32) - shrink * weights,
                                (((known - pairs) * inner[:, None, None]).sum(axis=0) - 20 * shrink * moves).ravel()))
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope ** 2
        move = 0.1 * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-8)
        weights, moves = weights + move[:-4], moves + move[-4:].reshape(2, 2)
    field = Field(limits, weights, moves, np.array([0.0, 1.0]))
    good = chains.marginals(field.line_scores(raw, chains.first, chains.last), moves)[0]
    field.curve = logistic(spread(weighted_means(good, raw, chains)), labels)
    return field


def logistic(x: np.ndarray, labels: np.ndarray, steps: int = 30) -> np.ndarray:
    """Intercept and slope of the curve, by Newton's method with a little shrinkage towards slope one."""
    curve, prior = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    design_of = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design_of @ curve, -30, 30)))
        slope = design_of.T @ (labels - p) - 0.1 * (curve - prior)
        bend = (design_of * (p * (1 - p))[:, None]).T @ design_of + 0.1 * np.eye(2)
        curve = curve + np.linalg.solve(bend, slope)
    return curve


def held_out(key: str) -> Column:
    """Documents that no label is learned from: CRC-32 of the key as text, mod 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            label: str = "quality") -> Field | None:
    """The field learned from a bounded sample of the labelled documents that are not held out.

    The sample holds TRAINING_DOCUMENTS labels, those of the smallest hash of their key, without the
    documents of more than TRAINING_LINES lines, and ends where its lines reach TRAINING_ROWS; it is all that
    the driver gets. Labels other than 0 and 1, and of null keys, are left out; a document that comes twice
    counts twice. None if one of the two labels is missing, as it is where a table is empty.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("draw"))
    chosen = usable.orderBy("draw", "key", "label").limit(TRAINING_DOCUMENTS)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).join(F.broadcast(chosen), "key")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("draw"), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([f.tobytes() for f in found], pa.binary())], ["label", "draw", "n", "raw"])

    short = F.length(text_of("text")) - F.length(F.replace(text_of("text"), F.lit("\n"), F.lit(""))) < TRAINING_LINES
    sample = rows.where(short).mapInArrow(features, "label int, draw long, n long, raw binary").toPandas()
    if sample["label"].nunique() < 2:
        return None
    # By hash until the lines are enough: what the driver trains on is bounded in lines, not in documents alone.
    sample = sample.sort_values(["draw", "label", "raw"])
    sample = sample[sample["n"].cumsum() <= TRAINING_ROWS].sort_values(["label", "raw"]).reset_index(drop=True)
    if sample["label"].nunique() < 2:
        return None
    raw = np.frombuffer(b"".join(sample["raw"]), np.float32).reshape(-1, len(FEATURES))
    return fitted(raw, sample["n"].to_numpy(), sample["label"].to_numpy())


def scored(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1, higher: likelier good) of each row's whole text; one row per input row.

    Null texts are empty, and an empty text is scored like any other, as one empty line. Without a
    field every score is 0.5. Rows with a null key and repeated rows are kept; no rows give no rows.
    """
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            found = [line_features(t.as_py()) for t in batch.column(1)]
            values = np.full(len(found), 0.5)
            if field is not None and found:
                values = field.document_scores(np.concatenate(found), np.array([len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(scores, f"key {dict(rows.dtypes)['key']}, score double")


def accepted(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text",
             least: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score is at least `least`, with all their columns, whatever their names.

    A null text is scored as an empty one and stays null; null keys and repeated rows are kept or left like any
    other; without a field all rows stay, and no rows give no rows.
    """
    schema = docs.schema
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            found = [line_features(t.as_py() or "") for t in batch.column(place)]
            if field is None or not found:
                yield batch
                continue
            values = field.document_scores(np.concatenate(found), np.array([len(f) for f in found]))
            yield batch.filter(pa.array(values >= least))

    return docs.mapInArrow(kept, schema)
