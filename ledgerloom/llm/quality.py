"""Quality rules judged by an isolation forest.

One pass over the texts counts the statistics of the rules (words, symbols, repeated lines,
repeated word windows, ...). An isolation forest is grown on a bounded sample of the
statistics: random splits on random statistics; documents that few splits set apart are
anomalous. The score 2**(-path/expected path) is compared with a threshold that is
calibrated on all labelled rows, through a histogram of scores by label.

The forest is fitted on about ``FIT_ROWS`` rows (documented bound): labelled rows
where there are labels, else any rows. Counts, scores and the threshold cover all rows.

Defined results: a null or empty text has zero counts and fails the base rules; rows are
judged one by one, so repeated rows get the same verdict; without labelled rows of both
kinds the threshold is ``DEFAULT_THRESHOLD``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drawn

FIT_ROWS = 8192
TREES = 100
SAMPLE = 256
BINS = 2000
DEFAULT_THRESHOLD = 0.62
#: Wrongly dropping a good document costs as much as keeping so many bad ones.
FALSE_ALARM_COST = 3.0
MIN_WORDS = 50
_SEED = 7

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: f_repeat is the share of words in repeated windows or in repeated lines, whichever is larger
STATISTICS = ["f_word", "f_symbols", "f_repeat", "f_upper"]

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))


def text_counts(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the statistics of one whole text."""
    if not isinstance(text, str) or not text:
        return (0,) * 5, (0.0,) * len(STATISTICS)
    raw = text.encode()
    size = len(raw)
    words = raw.split()  # bytes.split() parts at x20 and x09 to x0D only
    n = len(words)
    word_chars = len(text) - (size - len(raw.translate(None, _SPACE)))
    symbols = size - len(raw.translate(None, _SYMBOLS))
    upper = size - len(raw.translate(None, _UPPER))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    repeat = 0
    if n >= 3:
        base = len(number) + 1
        if base < 2_000_000:
            key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:  # the product would not fit
            pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
            key = pair[:-1] * base + ids[2:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = np.empty(n - 1, bool)
        same[0] = same[-1] = False
        same[1:-1] = ordered[1:] == ordered[:-1]
        again = np.zeros(n, bool)
        found = order[same[1:] | same[:-1]]
        for k in range(3):
            again[found + k] = True
        repeat = int(again.sum())
    w = max(n, 1)
    # words of repeated lines, first ones included: lines of one or two words needn't make a repeated window
    in_lines = 0
    if dup:
        times = Counter(lines)
        in_lines = sum(k * len(x.split()) for x, k in times.items() if k > 1)
    stats = (word_chars / w, symbols / w, max(repeat, in_lines) / w, upper / w)
    return (n, word_chars, symbols, dup, repeat), stats


def _counted(docs: DataFrame, keep: list[str], mark: str = "") -> DataFrame:
    """The columns ``keep`` with the five counts and the statistics of each row's text; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            found = [text_counts(x) for x in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            columns += [pa.array([s[k] for _, s in found], pa.float64()) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(mark + c for c in (*COUNTS, *STATISTICS))])

    kinds = [f"`{c}` {t}" for c, t in docs.select(keep).dtypes] + [f"{mark}{c} long" for c in COUNTS] + [f"{mark}{c} double" for c in STATISTICS]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(kinds))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and the statistics of each row."""
    return _counted(docs, ["doc_id"])


def expected_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    out = 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random trees in flat arrays: feature (-1: leaf), split, first child, path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(self.sample, 2))))
        self.trees = [self._grown(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)]

    def _grown(self, rows, rng):
        feature, split, child, path = [], [], [], []
        todo = [(rows, 0, 0)]
        feature.append(-1), split.append(0.0), child.append(0), path.append(0.0)
        while todo:
            x, depth, at = todo.pop()
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(x) <= 1 or not len(wide):
                path[at] = depth + float(expected_path(len(x)))
                continue
            f = int(rng.choice(wide))
            s = float(rng.uniform(low[f], high[f]))
            left = x[:, f] < s
            feature[at], split[at], child[at] = f, s, len(feature)
            for part in (x[left], x[~left]):
                todo.append((part, depth + 1, len(feature)))
                feature.append(-1), split.append(0.0), child.append(0), path.append(0.0)
        return np.array(feature, np.int32), np.array(split), np.array(child, np.int32), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2**(-mean path / expected path): near 1 for rows that are set apart at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, child, path in self.trees:
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, child[at] + (x[rows, np.maximum(f, 0)] >= split[at]))
            total += path[at]
        return np.exp2(-total / len(self.trees) / max(float(expected_path(self.sample)), 1e-9))


def best_threshold(histogram: dict[tuple[int, int], int], false_alarm_cost: float = FALSE_ALARM_COST) -> float:
    """The threshold with the least cost on labelled rows: {(bin, quality): rows}.

    Both kinds weigh alike in sum, so the share of bad labels doesn't move it.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for (b, q), n in histogram.items():
        (good if q else bad)[b] += n
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    # cut above bin b: bad rows up to b are missed, good rows above it are lost
    missed = np.cumsum(bad) / bad.sum()
    lost = 1 - np.cumsum(good) / good.sum()
    cost = missed + false_alarm_cost * lost
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((best[len(best) // 2] + 1) / BINS)


class Judge:
    """A fitted forest with its threshold; ``scores`` and ``keeps`` work on arrays of rows."""

    def __init__(self, forest: IsolationForest | None, threshold: float, min_words: int):
        self.forest, self.threshold, self.min_words = forest, threshold, min_words

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        return self.forest.score(statistics) if self.forest and len(statistics) else np.full(len(statistics), 0.5)

    def base_failed(self, n_words, n_repeat_words):
        return (n_words < self.min_words) | (100 * n_repeat_words > 50 * n_words)


def calibrated(stats: DataFrame, labels: DataFrame | None, fit_rows: int = FIT_ROWS, min_words: int = MIN_WORDS) -> Judge:
    """Grow the forest on a bounded sample of ``stats`` and set the threshold on all labelled rows.

    ``labels`` has doc_id and quality (1 good, 0 bad); a null quality is no label.
    """
    known = None
    if labels is not None:
        known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        known = checkpointed(stats.select("doc_id", *STATISTICS, "n_words").join(known, "doc_id"))
    # a bounded sample, the same at every run: the rows with the smallest hashes
    pools = [known.where(f"n_words >= {min_words}")] if known is not None else []
    forest = None
    for pool in [*pools, stats.where("n_words > 0")]:
        rows = drawn(pool.select("doc_id", *STATISTICS), pool.count(), fit_rows, "doc_id", *STATISTICS, seed=_SEED).select(*STATISTICS).collect()
        if len(rows) >= 32:
            forest = IsolationForest(np.array(sorted(rows), dtype=float))
            break
    judge = Judge(forest, DEFAULT_THRESHOLD, min_words)
    if known is None or not forest:
        return judge

    def bins(batches):
        for pdf in batches:
            at = np.minimum((judge.scores(pdf[STATISTICS].to_numpy(float)) * BINS).astype("int64"), BINS)
            yield pd.DataFrame({"bin": at, "quality": (pdf["quality"] != 0).astype("int64")})

    labelled = known.where(f"n_words >= {min_words}").select("quality", *STATISTICS)
    found = labelled.mapInPandas(bins, "bin long, quality long").groupBy("bin", "quality").count().collect()
    judge.threshold = best_threshold({(r["bin"], r["quality"]): r["count"] for r in found})
    return judge


def judged(docs: DataFrame, labels: DataFrame | None, fit_rows: int = FIT_ROWS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the counts, base_failed, kept, score and threshold of every row of ``docs``."""
    stats = checkpointed(rule_statistics(docs))
    judge = calibrated(stats, labels, fit_rows, min_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def verdict(batches):
        for pdf in batches:
            out = pdf[["doc_id", *COUNTS]].copy()
            out["base_failed"] = judge.base_failed(pdf["n_words"], pdf["n_repeat_words"])
            out["score"] = judge.scores(pdf[STATISTICS].to_numpy(float))
            out["kept"] = ~out["base_failed"] & (out["score"] < judge.threshold)
            out["threshold"] = judge.threshold
            yield out

    columns = ", ".join(f"{c} long" for c in COUNTS)
    return stats.mapInPandas(verdict, f"doc_id {kind}, {columns}, base_failed boolean, score double, kept boolean, threshold double")


#: before the names of the columns that keep_good adds for a while
_MARK = "_rule_"


def keep_good(docs: DataFrame, labels: DataFrame | None, fit_rows: int = FIT_ROWS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with all their columns; no shuffle of the texts.

    Each text is counted once: the rows with their statistics are written to the shared folder.
    """
    rows = checkpointed(_counted(docs, docs.columns, _MARK))
    stats = rows.select("doc_id", *(F.col(_MARK + c).alias(c) for c in (*COUNTS, *STATISTICS)))
    judge, columns = calibrated(stats, labels, fit_rows, min_words), docs.columns

    def run(batches):
        for batch in batches:
            of = lambda c: batch.column(_MARK + c).to_numpy(zero_copy_only=False)
            failed = judge.base_failed(of("n_words"), of("n_repeat_words"))
            scores = judge.scores(np.stack([of(c) for c in STATISTICS], axis=1))
            yield batch.select(columns).filter(pa.array(~failed & (scores < judge.threshold)))

    return rows.mapInArrow(run, docs.schema)
