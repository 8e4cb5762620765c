"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(score - threshold_k), with one weight vector over hashed words shared by all grades
and ascending thresholds. The model is fitted on the driver from a bounded sample of labelled rows (SAMPLE,
lowest hashes of doc_id); every document is scored from its whole text. Weights are whole numbers in units of
2**-20, so a score does not depend on the order of its terms.

A document's features are its distinct lower-case words without outer punctuation, their first four and five
letters, the distinct shapes of its words, and bucketed shares of shapes and of distinct words. Only buckets whose
documents' mean grade is SIGNIFICANT standard errors from the sample's take part. Defined cases: null text is
empty; very long texts are read whole; extra columns are ignored; an empty table gives an empty result; a text without words is rejected with grade 0; rows that repeat are scored alike; labels without text or
grade are ignored; with labels of fewer than two grades every text with words is kept.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_memo, give_back, slices

SAMPLE = 8_000
BUCKETS = 1 << 18
GRADES = 3
UNIT = 1 << 20
MIN_DOCS = 6
SIGNIFICANT = 4.0
SCHEMA = "doc_id long, expected_grade double, tail_probability double, keep boolean, score double"
_MARKS = "!?.,;:#$%&*|=+-_~^<>/\\\"'()[]{}@`"


def graded(quality: Column, toxic: Column) -> Column:
    """0: poor text; 1: good text that is toxic; 2: good and not toxic."""
    return F.when(quality.isNull(), None).when(quality < 1, 0).when(toxic >= 1, 1).otherwise(2)


def shape(word: str, core: str) -> str:
    """Coarse form of a word: letters' case, digits and the marks that it ends on."""
    kind = "n" if not core else "d" if core.isdigit() else "U" if len(core) > 1 and core.isupper() else "T" if core[:1].isupper() else "l" if core.isalpha() else "m"
    return kind + word[len(word.rstrip(_MARKS)) :][-3:]


def _bucket(kind: int, s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"), kind) % BUCKETS


class Features(dict):
    """word -> (shape, its buckets), remembered up to a bound; equal values are one object. With `only`, other buckets are left out."""

    def __init__(self, only: frozenset[int] | None = None, bound: int = 300_000):
        super().__init__()
        self.only, self.bound = only, bound
        self.values: dict[tuple, tuple] = {}

    def keep(self, buckets: Iterable[int]) -> tuple[int, ...]:
        return tuple(b for b in buckets if self.only is None or b in self.only)

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        if len(self) > self.bound:
            self.clear()
            self.values.clear()
        core = word.strip(_MARKS)
        form, bare = shape(word, core), core.lower()
        value = (form, self.keep((_bucket(1, bare), _bucket(2, bare[:5]), _bucket(3, bare[:4]), _bucket(4, form))))
        out = self[word] = self.values.setdefault(value, value)
        return out


def buckets_of(text: str, memo: Features) -> list[int]:
    """Distinct buckets of a text."""
    words = text.split()
    counts = Counter(words)
    out: set[int] = set()
    shapes: dict[str, int] = {}
    for w, n in counts.items():
        form, found = memo[w]
        shapes[form] = shapes.get(form, 0) + n
        if found:
            out.update(found)
    total = len(words)
    for s, n in shapes.items():
        out.update(memo.keep(_bucket(5 + k, s) for k in range(min(9, 10 * n // total))))
    variety = min(9, 10 * len(counts) // total) if total else 0
    out.update(memo.keep(_bucket(20 + k, str(min(3, total // 64))) for k in range(variety, 10)))
    return sorted(out)


def _cells(rows: list[tuple[list[int], int]], step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows and their buckets, few rows at a time: most buckets take no part, and the driver has little room."""
    for at in range(0, len(rows), step):
        some = [np.asarray(b, np.int64) for b, _ in rows[at : at + step]]
        yield np.repeat(np.arange(at, at + len(some)), [len(b) for b in some]), np.concatenate(some)


def fit(rows: list[tuple[list[int], int]], epochs: int = 160, rate: float = 0.06, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights in whole units and GRADES - 1 ascending thresholds, by full-batch Adam."""
    grades = np.array([g for _, g in rows])
    if len(set(grades.tolist())) < 2:
        return np.zeros(BUCKETS, np.int64), np.full(GRADES - 1, -4.0)
    df, total = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for d, c in _cells(rows):
        df += np.bincount(c, minlength=BUCKETS)
        total += np.bincount(c, grades[d], BUCKETS)
    mean = total / np.maximum(df, 1)
    z = np.abs(mean - grades.mean()) * np.sqrt(df) / max(grades.std(), 1e-9)
    use = np.nonzero((df >= MIN_DOCS) & (df < len(rows)) & (z >= SIGNIFICANT))[0]
    slot = np.full(BUCKETS, -1)
    slot[use] = np.arange(len(use))
    doc, col, n = np.empty(df[use].sum(), np.int64), np.empty(df[use].sum(), np.int64), 0
    for d, c in _cells(rows):
        at = np.nonzero(slot[c] >= 0)[0]
        doc[n : n + len(at)], col[n : n + len(at)] = d[at], slot[c[at]]
        n += len(at)
    w = np.zeros(len(use))
    cut = np.array([-1.0, 0.0])
    counts = np.bincount(grades, minlength=GRADES)
    weight = (len(rows) / (GRADES * np.maximum(counts, 1)))[grades] ** 0.5
    m, v = np.zeros(len(use) + GRADES - 1), np.zeros(len(use) + GRADES - 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, epochs + 1):
        s = np.bincount(doc, w[col], len(rows))
        upper = np.column_stack([np.ones(len(rows)), *(sig(s - c) for c in cut), np.zeros(len(rows))])
        at = np.arange(len(rows))
        hi, lo = upper[at, grades], upper[at, grades + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = -weight * (dhi - dlo) / p
        gc = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            gc[k] = np.sum(weight * (dhi / p * (grades == k + 1) - dlo / p * (grades == k)))
        g = np.concatenate([np.bincount(col, gs[doc], len(use)) / len(rows) + l2 * w, gc / len(rows)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-2]
        cut = np.sort(cut - step[-2:])
    out = np.zeros(BUCKETS, np.int64)
    out[use] = np.rint(w * UNIT)
    return out, cut


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most `sample` labelled documents."""
    grade = labels.select(F.col("doc_id").alias("_id"), graded(F.col("quality"), F.col("toxic")).alias("_g")).where("_g is not null and _id is not null")
    grade = grade.distinct().orderBy(F.xxhash64("_id"), "_id", "_g").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(grade), F.col("doc_id") == F.col("_id")).where("text is not null")
    # rows that repeat an id count once, so that no more than `sample` rows are collected
    rows = rows.groupBy("doc_id", "_g").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memo()
        memo = Features()
        for b in slices(batches):
            found = [buckets_of(t, memo) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32())), b.column("_g").cast(pa.int32())], names=["doc_id", "buckets", "grade"])

    got = rows.select("doc_id", "text", "_g").mapInArrow(run, "doc_id long, buckets array<int>, grade int").toArrow()
    order = np.lexsort((got["grade"].to_numpy(), got["doc_id"].to_numpy()))
    lists, grades = got["buckets"].combine_chunks(), got["grade"].to_pylist()
    model = fit([(lists[int(i)].values.to_numpy(), grades[int(i)]) for i in order])
    del got, lists, grades, order
    give_back()  # the driver lives on too
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """Expected grade, P(top grade) and the decision for every document."""
    packed, cut = model[0].tobytes(), model[1].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memo()
        weights = np.frombuffer(packed, np.int64)
        memo = Features(frozenset(np.nonzero(weights)[0].tolist()))
        for b in slices(batches):
            sums, some = [], []
            for t in b.column("text").to_pylist():
                found = buckets_of(t or "", memo)
                sums.append(int(weights[found].sum()))
                some.append(bool(t and not t.isspace()))
            s, some = np.array(sums, float) / UNIT, np.array(some, bool)
            tails = [np.where(some, 1 / (1 + np.exp(-np.clip(s - c, -35, 35))), 0.0) for c in cut]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sum(tails), pa.float64()), pa.array(tails[-1], pa.float64()), pa.array((tails[-1] >= least) & some, pa.bool_()), pa.array(s, pa.float64())], names=["doc_id", "expected_grade", "tail_probability", "keep", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns: the decision is made where the row is."""
    packed, cut = model[0].tobytes(), float(model[1][-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memo()
        weights = np.frombuffer(packed, np.int64)
        memo = Features(frozenset(np.nonzero(weights)[0].tolist()))
        for b in slices(batches):
            keep = []
            for t in b.column("text").to_pylist():
                score_ = int(weights[buckets_of(t or "", memo)].sum()) / UNIT
                keep.append(bool(t and not t.isspace()) and 1 / (1 + np.exp(-np.clip(score_ - cut, -35, 35))) >= least)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
