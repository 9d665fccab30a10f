"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions, labels every byte with
probabilities of the languages, and a document's probabilities are the means over all its
bytes. It is trained in numpy by backpropagation through time on a bounded, documented
sample: per language about ``DOCS_PER_LANGUAGE`` documents, ``WINDOWS_PER_DOC`` windows of
each. Prediction is one pass over the rows that covers every byte of every text.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every
text if there is nothing to learn from. Rows are judged one by one. Ties between languages
go to the first in alphabetic order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UND = "und"
HIDDEN = 8
WINDOW = 64
DOCS_PER_LANGUAGE = 500
WINDOWS_PER_DOC = 3
STEPS = 220
BATCH = 192
MIN_SCORE = 0.5
_SEED = 11
_CHUNK = 1024


class BiGRU:
    """Weights of both directions, the softmax over languages, and the passes through time.

    Arrays hold a feature per row and a window per column, so that gates are whole rows.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype("f4")  # what a byte adds to the gates
            self.w[f"u{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype("f4")
            self.w[f"c{d}"] = rng.normal(0, hidden**-0.5, (len(languages), hidden)).astype("f4")
        self.w["bias"] = np.zeros((len(languages), 1), "f4")

    def _read(self, rows: np.ndarray, d: str, trace: list | None = None):
        """States (time, hidden, window) of one direction; ``trace`` gets what the way back needs."""
        steps, n, h = rows.shape[0], rows.shape[1], self.h
        x, u = self.w[f"x{d}"], self.w[f"u{d}"]
        states = np.empty((steps, h, n), x.dtype)
        state = np.zeros((h, n), x.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x.take(rows[t], axis=1)
            g = u @ state
            gates, m, inner = a[: 2 * h], a[2 * h :], g[2 * h :]
            gates += g[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5  # sigmoid
            z, r = gates[:h], gates[h:]
            if trace is not None:
                m += r * inner
            else:
                inner *= r
                m += inner
            np.tanh(m, out=m)
            if trace is not None:
                trace.append((t, state, z, r, inner, m))
            new = np.subtract(state, m, out=states[t])
            new *= z
            new += m
            state = new
        return states

    def _labels(self, forward: np.ndarray, backward: np.ndarray, t: int) -> np.ndarray:
        """Probabilities (language, window) of the bytes at one time."""
        p = self.w["cf"] @ forward[t]
        p += self.w["cb"] @ backward[t]
        p += self.w["bias"]
        np.exp(p, out=p)  # states are below 1, so the sums are small
        p /= p.sum(0)
        return p

    def gradients(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Loss and gradients: every byte of a window has the window's label; weights (time, window)."""
        h, n = self.h, rows.shape[1]
        traces: dict[str, list] = {"f": [], "b": []}
        states = {d: self._read(rows, d, traces[d]) for d in "fb"}
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss, errors = 0.0, []
        for t in range(rows.shape[0]):
            p = self._labels(states["f"], states["b"], t)
            loss -= (np.log(p[labels, np.arange(n)] + 1e-9) * weights[t]).sum()
            p[labels, np.arange(n)] -= 1
            p *= weights[t]
            errors.append(p)
            grads["bias"] += p.sum(1, keepdims=True)
        for d in "fb":
            u, c = self.w[f"u{d}"], self.w[f"c{d}"]
            back = np.zeros((h, n), u.dtype)
            changes, read = [], []
            for t, state, z, r, inner, m in reversed(traces[d]):
                grads[f"c{d}"] += errors[t] @ states[d][t].T
                dh = c.T @ errors[t] + back
                da = np.empty((3 * h, n), u.dtype)
                da[2 * h :] = dh * (1 - z) * (1 - m * m)
                da[:h] = dh * (state - m) * z * (1 - z)
                da[h : 2 * h] = da[2 * h :] * inner * r * (1 - r)
                dg = da.copy()
                dg[2 * h :] *= r
                grads[f"u{d}"] += dg @ state.T
                back = dh * z + u.T @ dg
                changes.append(da)
                read.append(rows[t])
            byte = np.concatenate(read)
            order = np.argsort(byte, kind="stable")
            ordered = byte[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            grads[f"x{d}"][:, ordered[starts]] = np.add.reduceat(np.concatenate(changes, axis=1)[:, order], starts, axis=1)
        return loss, grads

    def fit(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = _SEED):
        """Adam over batches that hold every language alike."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, batch // len(by))) for x in by if len(x)])
            rows = np.ascontiguousarray(windows[pick].T)
            weights = (np.arange(rows.shape[0])[:, None] < lengths[pick]).astype("f4")
            weights /= weights.sum()
            _, grads = self.gradients(rows, labels[pick], weights)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def pooled(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean probabilities over all bytes of each text (rows of zeros for empty ones)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = -(-sizes // window)
        out = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), counts)
        total = int(counts.sum())
        if not total:
            return out
        flat = np.zeros(total * window, np.uint8)
        starts = np.r_[0, np.cumsum(counts)[:-1]] * window
        for t, s in zip(texts, starts, strict=True):
            flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
        rows = flat.reshape(total, window)
        place = np.arange(total) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
        lengths = np.minimum(np.repeat(sizes, counts) - place * window, window)
        sums = np.empty((total, len(self.languages)))
        for i in range(0, total, _CHUNK):
            block = rows[i : i + _CHUNK].T.astype(np.intp)
            n = lengths[i : i + _CHUNK]
            forward, backward = self._read(block, "f"), self._read(block, "b")
            total_p = np.zeros((len(self.languages), len(n)))
            for t in range(window):
                total_p += np.where(t < n, self._labels(forward, backward, t), 0)
            sums[i : i + _CHUNK] = total_p.T
        np.add.at(out, owner, sums)
        return out / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows: int = WINDOWS_PER_DOC) -> list:
    """(lang, window text) of a bounded sample of labelled rows, the same at each run."""
    labelled = docs.where("lang is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return []
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, docs_per_language / n) * (1 << 40)))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(_SEED)), F.lit(1 << 40))
    chosen = labelled.where(draw < F.element_at(shares, F.col("lang"))).where(F.col("text").rlike(r"\p{L}"))
    # equal rows fall in or out together, so what is drawn is limited too
    chosen = chosen.limit(4 * docs_per_language * len(counts))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = F.array(*[F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows)])
    rows = chosen.select("lang", F.explode(cuts).alias("cut")).collect()
    return sorted((r["lang"], r["cut"]) for r in rows)


def train(docs: DataFrame, **sizes) -> BiGRU | None:
    """Learn from the columns text and lang of the labelled rows of ``docs``; None if there are none."""
    rows = training_windows(docs, **sizes)
    if not rows:
        return None
    languages = sorted({k for k, _ in rows})
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    lengths = np.zeros(len(rows), np.int64)
    for i, (_, cut) in enumerate(rows):
        raw = cut.encode()[:WINDOW]
        windows[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        lengths[i] = len(raw)
    number = {k: i for i, k in enumerate(languages)}
    return BiGRU(languages).fit(windows, lengths, np.array([number[k] for k, _ in rows]))


def predict(docs: DataFrame, model: BiGRU | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the columns ``lang_pred`` and ``score`` to the rows; one pass, no shuffle."""
    docs = docs.drop(lang_pred, score)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches):
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf[text]]
            lettered = np.array([any(map(str.isalpha, x)) for x in texts], dtype=bool)
            known = lettered if model else np.zeros(len(texts), bool)
            pred, best = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
            at = np.flatnonzero(known)
            i = 0
            while i < len(at):  # some MB of text at a time
                j, size, raw = i, 0, []
                while j < len(at) and size < 2 << 20:
                    raw.append(texts[at[j]].encode())
                    size += len(raw[-1])
                    j += 1
                p = model.pooled(raw)
                pred[at[i:j]] = np.array(model.languages, dtype=object)[p.argmax(1)]
                best[at[i:j]] = np.clip(p.max(1), 0.0, 1.0)
                i = j
            pdf[lang_pred], pdf[score] = pred, best
            yield pdf

    return docs.mapInPandas(run, f"{kinds}, `{lang_pred}` string, `{score}` double")


def held_out():
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def languages_of(docs: DataFrame, lang_pred: str = "lang_pred", score: str = "score", held: str = "held_out") -> DataFrame:
    """All columns of ``docs`` with held_out, lang_pred and score; learns from rows that aren't held out.

    Columns of ``docs`` with the names of the three are replaced.
    """
    out = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~out).select("doc_id", "text", "lang"))
    return predict(docs.drop(held).withColumn(held, out), model, lang_pred=lang_pred, score=score)
