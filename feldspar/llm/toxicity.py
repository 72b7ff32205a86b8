"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's vector is an embedding, the attention-pooled states of a network over its characters, and the log odds that
it and its character n-grams have between the windows of the classes (counted for each half of the sample on the
other half, so that no word explains its own text).  A second
network reads the words of a window, its states are pooled by attention, and a logistic unit scores the
window.  All overlapping windows of WINDOW words, STEP apart, are scored; the mean and the largest of their log odds and the share above 0 give
the document's score by a small logistic fit.  Everything is numpy, training included; a word's part is computed
once for each distinct word that a worker meets and kept for a while.

Fitting takes a bounded sample, PER_CLASS labelled texts of each class, whole: all their windows count for the log odds, train the
networks (the windows of a text weigh as much as those of any other) and give the document's fit.

Rules: words are runs of letters, digits and underscores, lower-cased; runs over LONGEST characters go on as
further words, so that no character is left out.  Null texts and those without words are one empty window.  Without labels of
both classes the score is the share of label 1.  Matrices have the same shapes whatever is scored together, and shut steps change
nothing at all, so on machines of one kind equal texts get equal scores.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kind, pick, sample_of_labels, ship, spread

WINDOW, STEP, LONGEST = 64, 32, 32
PER_CLASS = 500
#: Words and windows that are computed together; fewer are filled up.
TOGETHER = 512
HIDDEN, CHAR_SLOTS, CHAR_DIM, WORD_SLOTS, WORD_DIM = 8, 256, 8, 4096, 6
#: Sizes of the character n-grams; windows that a gram needs to count; inputs that grams give.
GRAMS, OFTEN, ODDS = (4, 5, 6, 7), 5, 3
KNOWN = 120_000
_WORD = re.compile(rf"\w{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _sigmoid(x):
    """(exactly 0 below -89, where the exponential overflows)"""
    with np.errstate(over="ignore"):
        return np.float32(1) / (np.float32(1) + np.exp(-x))


#: Input of an update gate that shuts it.
SHUT = np.float32(-1e4)


def gru(x: np.ndarray, u: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """States of a gated recurrent unit over x (steps, rows, 3 * hidden: inputs of update, reset and new), which
    has the input's share already; u: (hidden, 3 * hidden)."""
    steps, rows, _ = x.shape
    k = u.shape[0]
    h = np.zeros((rows, k), np.float32)
    out = np.empty((steps, rows, k), np.float32)
    kept = []
    for t in reversed(range(steps)) if back else range(steps):
        a = h @ u
        g = _sigmoid(x[t, :, : 2 * k] + a[:, : 2 * k])
        z, r = g[:, :k], g[:, k:]
        n = np.tanh(x[t, :, 2 * k :] + r * a[:, 2 * k :])
        kept.append((t, h, z, r, n, a))
        h = h + z * (n - h)
        out[t] = h
    return out, kept


def gru_back(d: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the gradient by the states: those by x and by u."""
    k = u.shape[0]
    dx, du = np.empty((d.shape[0], d.shape[1], 3 * k), np.float32), np.zeros_like(u)
    dh = np.zeros((d.shape[1], k), np.float32)
    for t, h, z, r, n, a in reversed(kept):
        dh = dh + d[t]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h) * z * (1 - z)
        dr = dn * a[:, 2 * k :] * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        da = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ da
        dh = dh * (1 - z) + da @ u.T
    return dx, du


def pool(h: np.ndarray, v: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention over the steps: weights by softmax of tanh(h) @ v, and the weighted states."""
    s = np.where(real, np.tanh(h) @ v, np.float32(-1e9))
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    return (w[:, :, None] * h).sum(0), w


def pool_back(d: np.ndarray, h: np.ndarray, v: np.ndarray, w: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ds = w * ((h - out) * d).sum(2)
    t = np.tanh(h)
    return w[:, :, None] * d + ds[:, :, None] * v * (1 - t * t), (ds[:, :, None] * t).sum((0, 1))


def grams(word: str) -> set[str]:
    """The word with its ends marked, and its n-grams."""
    s = f"^{word}$"
    return {s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1)} | {s}


def gram_counts(halves: list[list[tuple[set[str], int]]]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Of windows (distinct words, label) in several parts: the grams; for each part how many windows of each label have each gram, and
    how many windows of each label there are."""
    number: dict[str, int] = {}
    words: dict[str, np.ndarray] = {}
    for windows in halves:
        for w in set().union(*(ws for ws, _ in windows)) - words.keys():
            words[w] = np.array([number.setdefault(g, len(number)) for g in grams(w)], np.int64)
    counts, totals = [], []
    for windows in halves:
        count = np.zeros((2, len(number)), np.int64)
        for y in (0, 1):
            mine = [ws for ws, v in windows if v == y and ws]
            for at in range(0, len(mine), 512):
                part = mine[at : at + 512]
                flat = np.concatenate([words[w] for ws in part for w in ws])
                window = np.repeat(np.arange(len(part)), [sum(len(words[w]) for w in ws) for ws in part])
                both = np.sort(window * len(number) + flat)
                count[y] += np.bincount(both[np.diff(both, prepend=-1) > 0] % len(number), minlength=len(number))
        counts.append(count)
        totals.append(np.bincount([v for _, v in windows], minlength=2))
    return list(number), counts, totals


def log_odds(names: list[str], count: np.ndarray, total: np.ndarray) -> dict[str, float]:
    """The smoothed log odds of the grams that are frequent and telling."""
    v = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    return {names[i]: float(v[i]) for i in np.flatnonzero((count.sum(0) >= OFTEN) & (np.abs(v) >= 0.7))}


class Odds:
    """Log odds of grams, looked up for many words in one pass over their text."""

    def __init__(self, table: dict[str, float]):
        self.table, self._finder = table, None

    def __getstate__(self):
        return self.table

    def __setstate__(self, table):
        self.__init__(table)

    def of(self, words: list[str]) -> np.ndarray:
        """For each word: its own log odds, the largest and the smallest of its grams, scaled."""
        out = np.zeros((len(words), ODDS), np.float32)
        if not self.table or not words:
            return out
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for k, g in enumerate(self.table):
                self._finder.add_word(g, k)
            self._finder.make_automaton()
            self._values = np.array(list(self.table.values()), np.float32)
            self._whole = np.array([g[0] == "^" and g[-1] == "$" for g in self.table])
        found = np.array([x for at in self._finder.iter("".join([f"^{w}$" for w in words])) for x in at], np.int64).reshape(-1, 2)
        word = np.searchsorted(np.cumsum([len(w) + 2 for w in words]), found[:, 0], "right")
        value = self._values[found[:, 1]]
        whole = self._whole[found[:, 1]]
        out[word[whole], 0] = value[whole]
        np.maximum.at(out[:, 1], word, value)
        np.minimum.at(out[:, 2], word, value)
        return out * np.float32(0.5)


class Network:
    def __init__(self, seed: int = 3):
        r, k = np.random.default_rng(seed), HIDDEN
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "chars": f(CHAR_SLOTS, CHAR_DIM, scale=0.5), "words": f(WORD_SLOTS, WORD_DIM, scale=0.1),
            "cw": f(CHAR_DIM, 6 * k, scale=0.35), "cb": np.zeros(6 * k, np.float32), "cu": f(2, k, 3 * k, scale=0.35), "cv": f(2 * k, scale=0.3),
            "ww": f(WORD_DIM + 2 * k + ODDS, 6 * k, scale=0.3), "wb": np.zeros(6 * k, np.float32), "wu": f(2, k, 3 * k, scale=0.35), "wv": f(2 * k, scale=0.3),
            "o": f(2 * k, scale=0.3), "ob": np.zeros(1, np.float32),
        }
        self.share, self.scale = 0.5, None
        self.vocabulary: dict[str, int] = {}
        self.odds = Odds({})
        self._rows: dict[str, int] = {}
        self._inputs = None

    def __getstate__(self):
        return self.p, self.share, self.scale, self.vocabulary, self.odds

    def __setstate__(self, state):
        self.p, self.share, self.scale, self.vocabulary, self.odds = state
        self._rows, self._inputs = {}, None

    # -- words

    @staticmethod
    def _characters(words: list[str]) -> np.ndarray:
        """(steps, words) slots of the characters, 0 after a word's end."""
        n = max(map(len, words))
        c = np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        return np.where(c == 0, 0, 1 + (c * np.uint32(40503) >> np.uint32(3)) % (CHAR_SLOTS - 1)).T.astype(np.int64)

    def _word_forward(self, words: list[str], odds: Odds):
        """Inputs of the window network for each word, and what the way back needs."""
        p, k = self.p, HIDDEN
        c = self._characters(words)
        real = c > 0
        x = p["chars"][c] @ p["cw"] + p["cb"]
        x[~real, :k] = SHUT  # past the end
        x[~real, 3 * k : 4 * k] = SHUT
        parts = [gru(x[:, :, 3 * k * b : 3 * k * (b + 1)], p["cu"][b], bool(b)) for b in (0, 1)]
        h = np.concatenate([parts[0][0], parts[1][0]], 2)
        vector, w = pool(h, p["cv"], real)
        slot = np.array([self.vocabulary.get(t, 0) for t in words])
        e = np.concatenate([p["words"][slot], vector, odds.of(words)], 1)
        return e @ p["ww"] + p["wb"], (c, real, parts, h, vector, w, slot, e)

    def _word_back(self, d, saved, g):
        p, k = self.p, HIDDEN
        c, real, parts, h, vector, w, slot, e = saved
        g["ww"] += e.T @ d
        g["wb"] += d.sum(0)
        de = d @ p["ww"].T
        np.add.at(g["words"], slot, de[:, :WORD_DIM])
        dh, dv = pool_back(de[:, WORD_DIM : WORD_DIM + 2 * k], h, p["cv"], w, vector)
        g["cv"] += dv
        dx = np.zeros((*c.shape, 6 * k), np.float32)
        for b in (0, 1):
            dx[:, :, 3 * k * b : 3 * k * (b + 1)], du = gru_back(dh[:, :, k * b : k * (b + 1)], parts[b][1], p["cu"][b])
            g["cu"][b] += du
        dx[~real] = 0
        flat, at = dx.reshape(-1, 6 * k), c.ravel()
        ec = p["chars"][at]
        g["cw"] += ec.T @ flat
        g["cb"] += flat.sum(0)
        np.add.at(g["chars"], at, flat @ p["cw"].T)

    # -- windows

    def _window_forward(self, x: np.ndarray, real: np.ndarray):
        p, k = self.p, HIDDEN
        parts = [gru(x[:, :, 3 * k * b : 3 * k * (b + 1)], p["wu"][b], bool(b)) for b in (0, 1)]
        h = np.concatenate([parts[0][0], parts[1][0]], 2)
        vector, w = pool(h, p["wv"], real)
        return vector @ p["o"] + p["ob"][0], (parts, h, vector, w)

    def _shut(self) -> np.ndarray:
        row = np.zeros(6 * HIDDEN, np.float32)
        row[:HIDDEN] = row[3 * HIDDEN : 4 * HIDDEN] = SHUT
        return row

    def gradient(self, windows: list[list[str]], y: np.ndarray, odds: Odds, weight: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean logistic loss of the windows, weighted, and its gradient."""
        weight = np.ones(len(y), np.float32) if weight is None else weight
        p, k = self.p, HIDDEN
        number: dict[str, int] = {}
        index = np.zeros((WINDOW, len(windows)), np.int64)
        for j, ws in enumerate(windows):
            index[: len(ws), j] = [number.setdefault(w, len(number) + 1) for w in ws]
        new = sorted(number, key=len) or [""]
        parts_ = [new[a : a + 2 * TOGETHER] for a in range(0, len(new), 2 * TOGETHER)]  # of like lengths
        forward = [self._word_forward(part, odds) for part in parts_]
        table = np.concatenate([self._shut()[None], *[x for x, _ in forward]])
        table[[number.get(w, 1) for w in new]] = table[1:].copy()
        real = index > 0
        logit, (parts, h, vector, w) = self._window_forward(table[index], real)
        q = _sigmoid(logit)
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
        g = {n: np.zeros_like(v) for n, v in p.items()}
        d = (weight * (q - y) / len(y)).astype(np.float32)
        g["o"], g["ob"][0] = vector.T @ d, d.sum()
        dh, g["wv"] = pool_back(d[:, None] * p["o"], h, p["wv"], w, vector)
        dx = np.empty((*index.shape, 6 * k), np.float32)
        for b in (0, 1):
            dx[:, :, 3 * k * b : 3 * k * (b + 1)], g["wu"][b] = gru_back(dh[:, :, k * b : k * (b + 1)], parts[b][1], p["wu"][b])
        order = np.argsort(index.ravel(), kind="stable")
        at = index.ravel()[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = np.add.reduceat(dx.reshape(-1, 6 * k)[order], starts)
        dt = np.zeros_like(table)
        dt[at[starts]] = sums
        for part, (_, saved) in zip(parts_, forward):
            if number:
                self._word_back(dt[[number[w] for w in part]], saved, g)
        return loss, g

    def fit(self, rows: list[tuple[str, int]], share: float, epochs: int = 1, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
        """rows: (text, label); share: of label 1 among all labelled rows."""
        self.share = share
        r = np.random.default_rng(seed)
        rows = [rows[i] for i in r.permutation(len(rows))]
        docs = [(windows_of(words_of(t)), y) for t, y in rows]
        halves = [[(set(w), y) for ws, y in docs[b::2] for w in ws] for b in (0, 1)]
        if len({y for ws, y in docs if ws[0]}) < 2:
            return self
        count: dict[str, int] = {}
        for words, _ in halves[0] + halves[1]:
            for w in words:
                count[w] = count.get(w, 0) + 1
        often = sorted((w for w in count if count[w] >= OFTEN), key=lambda w: (-count[w], w))[: WORD_SLOTS - 1]
        self.vocabulary = {w: i + 1 for i, w in enumerate(often)}
        names, counts, totals = gram_counts(halves)
        tables = [Odds(log_odds(names, counts[1 - b], totals[1 - b])) for b in (0, 1)]
        # all windows, those of one text with the weight of one text; between them the weights are 1 in the mean
        share_ = len(docs) / sum(len(ws) for ws, _ in docs)
        flat = [[(w, y, 1 / len(ws) / share_) for ws, y in docs[b::2] for w in ws if w] for b in (0, 1)]
        m = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in self.p.items()}
        t, total = 0, epochs * sum(-(-len(f) // batch) for f in flat)
        for _ in range(epochs):
            orders = [r.permutation(len(f)) for f in flat]
            parts = [(b, orders[b][at : at + batch]) for b in (0, 1) for at in range(0, len(flat[b]), batch)]
            for k in r.permutation(len(parts)):
                b, part = parts[k]
                chosen = [flat[b][i] for i in part]
                _, g = self.gradient([c[0] for c in chosen], np.array([c[1] for c in chosen], np.float32), tables[b], np.array([c[2] for c in chosen], np.float32))
                t += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step = rate * min(1.0, 2 * (1 - t / (total + 1)))
                for n, v in g.items():
                    v = v * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                    a, b2 = m[n]
                    a += 0.1 * (v - a)
                    b2 += 0.01 * (v * v - b2)
                    self.p[n] -= (step * (a / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-7) + step * 0.01 * self.p[n]).astype(np.float32)
        # the last fit sees each text as if it were unknown: with the other half's log odds
        logits: list = [None] * len(rows)
        for b in (0, 1):
            self.odds, self._rows, self._inputs = tables[b], {}, None
            logits[b::2] = self._logits([t for t, _ in rows[b::2]])
        self.odds, self._rows, self._inputs = Odds(log_odds(names, counts[0] + counts[1], totals[0] + totals[1])), {}, None
        x = np.array([_summary(v) for v in logits])
        mean, deviation = x.mean(0), x.std(0) + 1e-6
        a = np.concatenate([(x - mean) / deviation, np.ones((len(x), 1))], 1)
        z, beta = np.array([v for _, v in rows], float), np.zeros(a.shape[1])
        pull = np.diag([0.5, 0.5, 0.5, 1e-6])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            beta -= np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + pull, a.T @ (q - z) + pull @ beta)
        had = float(np.clip(z.mean(), 1e-3, 1 - 1e-3))
        real = float(np.clip(share, 1e-3, 1 - 1e-3))
        beta[-1] += np.log(real / (1 - real)) - np.log(had / (1 - had))
        self.scale = (mean, deviation, beta)
        return self

    # -- scores

    def _numbers(self, words: list[str]) -> list[int]:
        """Rows of the words in the table of known inputs; unknown ones are computed first."""
        known = self._rows
        new = sorted({w for w in words if w not in known}, key=lambda w: (len(w), w))
        if new:
            if self._inputs is None or len(known) + len(new) > KNOWN:
                known.clear()
                self._inputs, self._used = np.zeros((KNOWN + 1, 6 * HIDDEN), np.float32), 1
                self._inputs[0] = self._shut()
                new = sorted(set(words), key=lambda w: (len(w), w))
                if len(new) > KNOWN:
                    self._inputs = np.concatenate([self._inputs[:1], np.zeros((len(new), 6 * HIDDEN), np.float32)])
            for at in range(0, len(new), TOGETHER):
                part = new[at : at + TOGETHER]
                inputs, _ = self._word_forward(part + [""] * (TOGETHER - len(part)), self.odds)
                self._inputs[self._used : self._used + len(part)] = inputs[: len(part)]
                known.update(zip(part, range(self._used, self._used + len(part))))
                self._used += len(part)
        return [known[w] for w in words]

    def _logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Log odds of every window of every text."""
        counts, index = [], []
        lists = [words_of(t) for t in texts]
        numbers = np.array(self._numbers([w for ws in lists for w in ws]), np.int64)
        at = 0
        for ws in lists:
            n = len(ws)
            starts = _starts(n)
            own = np.zeros(starts[-1] + WINDOW, np.int64)
            own[:n] = numbers[at : at + n]
            at += n
            index.append(own[np.array(starts)[:, None] + np.arange(WINDOW)])
            counts.append(len(starts))
        every = np.concatenate(index)
        out = []
        if self._inputs is None:
            self._inputs, self._used = self._shut()[None].repeat(KNOWN + 1, 0), 1
        for a in range(0, len(every), TOGETHER):
            i = every[a : a + TOGETHER].T
            filled = np.pad(i, ((0, 0), (0, TOGETHER - i.shape[1])))
            # rounded, so that machines of another kind are unlikely to differ
            out.append(np.round(self._window_forward(self._inputs[filled], filled > 0)[0][: i.shape[1]].astype(np.float64), 3))
        return np.split(np.concatenate(out), np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        if self.scale is None:
            return [float(self.share)] * len(texts)
        mean, deviation, beta = self.scale
        x = (np.array([_summary(v) for v in self._logits(texts)]) - mean) / deviation
        odds = x[:, 0] * beta[0] + x[:, 1] * beta[1] + x[:, 2] * beta[2] + beta[3]  # not a product of matrices: by row alone
        return (1 / (1 + np.exp(-np.clip(odds, -40, 40)))).tolist()


def _starts(n: int) -> list[int]:
    return list(range(0, max(1, n - STEP), STEP))


def windows_of(words: list[str]) -> list[list[str]]:
    return [words[s : s + WINDOW] for s in _starts(len(words))]


def _summary(logits: np.ndarray) -> tuple[float, float, float]:
    """Mean and largest log odds of the windows, and the share of those above 0."""
    return float(logits.mean()), float(logits.max()), float((logits > 0).mean())


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = PER_CLASS, label: str = "toxic") -> Network:
    train = F.lit(True) if train is None else train
    counts = dict(pick(labels, "doc_id", label).where(train & F.col(label).isin(0, 1)).groupBy(label).count().collect())
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return Network().fit(sample_of_labels(docs, labels, label, train, per_class), share)


def score_toxicity(df: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row; texts are taken together up to some 200,000 characters."""
    import pyarrow as pa

    ship(df.sparkSession)
    df = pick(df, doc_id, text)

    def run(batches):
        for batch in batches:
            ids, texts, size, begun = batch.column(0), [], 0, 0
            for i, t in enumerate(batch.column(1)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > 200_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(begun, len(texts)), pa.array(network.scores(texts), pa.float64())], [doc_id, "score"])
                    texts, size, begun = [], 0, i + 1

    return df.mapInArrow(run, f"`{doc_id}` {kind(df, doc_id)}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(spread(docs), fit_toxicity(docs, labels, fold("doc_id", 5) != 0))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
