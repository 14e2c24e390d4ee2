"""Quality scores by a sparse ensemble of rules.

Boosted shallow trees are grown on statistics of labelled texts; each path from a root is a conjunction of thresholds. Lasso logistic
weights over these rules leave few of them, and those are compiled into one Spark column over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, byte_table, chunks, grams, mix, text_bytes, with_fields, words_of

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "bangs", "bars", "stops", "lines", "high", "distinct_words", "distinct_triples", "top_word"]
#: Byte classes, counted a byte of text (upper: a letter).
CLASSES = {"digits": b"0123456789", "marks": b"#$%&*@^~<>{}[]\\=+_", "bangs": b"!?", "bars": b"|", "stops": b".,;:", "lines": b"\n", "high": bytes(range(128, 256))}


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over bounds[i]:bounds[i + 1]."""
    s = np.zeros(len(values) + 1)
    np.cumsum(values, out=s[1:])
    return s[bounds[1:]] - s[bounds[:-1]]


def variety(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of values, of distinct values, and how often the most frequent stands."""
    of, at, times = np.unique(hashes + mix(doc.astype(np.uint64)), return_index=True, return_counts=True)
    owner = doc[at]
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    return np.bincount(doc, minlength=n), np.bincount(owner, minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """STATISTICS of each text of a string column without nulls, by rows. An empty text has zeros."""
    data, offsets = text_bytes(column)
    n = len(column)
    words = words_of(column, byte_table("space", False))
    size, n_words = np.diff(offsets).astype(float), np.diff(words.first).astype(float)
    some, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(n_words), "word_bytes": per_text((words.end - words.start).astype(float), words.first) / some_words}
    count = lambda members: per_text(np.isin(np.arange(256), list(members))[data], offsets)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    out["upper"] = upper / np.maximum(upper + lower, 1)
    out |= {name: count(members) / some for name, members in CLASSES.items()}
    total, kinds, top = variety(words.hash, words.doc, n)
    out["distinct_words"], out["top_word"] = kinds / some_words, top / some_words
    triples = grams(words.hash, 3)
    whole = words.doc[: len(triples)] == words.doc[2:] if len(triples) else np.zeros(0, bool)
    total, kinds, _ = variety(triples[whole], words.doc[: len(triples)][whole], n)
    out["distinct_triples"] = kinds / np.maximum(total, 1)
    return np.stack([out[s] for s in STATISTICS], axis=1)


def add_statistics(df: DataFrame, text: str) -> DataFrame:
    """df (of plain column names) with a column stat_<name> for each of STATISTICS; one pass over the texts, no shuffle."""
    added = [f"stat_{s}" for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text):
                got = statistics(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[:, i]) for i in range(len(added)))], names=[*part.schema.names, *added])

    return df.mapInArrow(run, with_fields(df, ", ".join(f"{a} double" for a in added)))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether above, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, t in self.terms:
            out &= (x[:, i] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for i, above, t in self.terms:
            c = F.col(f"stat_{STATISTICS[i]}")
            out &= c > t if above else c <= t
        return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float, least: int) -> list[Rule]:
    """The paths of boosted trees: each tree is fitted to the gradient of the logistic loss, with Newton steps at its leaves."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    cell = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[np.ndarray, tuple]] = [(np.arange(len(y)), ())]
        while nodes:
            rows, terms = nodes.pop()
            best = (1e-9, -1, -1)
            if len(terms) < depth and len(rows) >= 2 * least:
                gs, hs = g[rows].sum(), h[rows].sum()
                for i, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = cell[rows, i]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                        best = (gain[k], i, k)
            if best[1] < 0:
                raw[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                continue
            _, i, k = best
            left = cell[rows, i] <= k
            for part, above in ((rows[left], False), (rows[~left], True)):
                term = (*terms, (i, above, float(cuts[i][k])))
                rules[Rule(tuple(sorted(term)))] = None
                nodes.append((part, term))
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept isn't penalised."""
    n, m = z.shape
    a = np.hstack([np.ones((n, 1), np.float32), z.astype(np.float32)])
    v = np.ones(m + 1, np.float32)
    for _ in range(15):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / float(np.linalg.norm(a.T @ (a @ v)))
    w, u, t = np.zeros(m + 1, np.float32), np.zeros(m + 1, np.float32), 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ u))) - y).astype(np.float32) / n
        new = u - size * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    return float(w[0]), w[1:].astype(float)


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.intercept)
        for r, w in self.rules:
            raw += w * r.holds(x)
        return 1 / (1 + np.exp(-raw))

    def column(self) -> Column:
        """The score over the stat_ columns."""
        raw = F.lit(self.intercept)
        for r, w in self.rules:
            raw += F.when(r.column(), w).otherwise(0.0)
        return 1 / (1 + F.exp(-raw))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalties: tuple[float, ...] = (0.01, 0.004, 0.0015, 0.0006)) -> RuleEnsemble:
    """The penalty is the one with the least loss on every fifth row, of which neither the rules nor the weights tried have seen any;
    rules and weights are then learnt from all rows. Without examples every score is 1, so that nothing is rejected for want of
    labels; with one class only, scores are that class's smoothed share."""
    if not len(y):
        return RuleEnsemble(40.0, [])
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), [])

    def grown(rows: np.ndarray) -> tuple[list[Rule], np.ndarray]:
        rules = tree_rules(x[rows], y[rows], trees, depth, 32, 0.2, max(3, len(rows) // 500))
        return rules, np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0))

    penalty = penalties[0]
    test = np.arange(len(y)) % 5 == 4
    if len(y) > 50 and 0 < y[~test].mean() < 1:
        _, z = grown(np.flatnonzero(~test))

        def loss(penalty: float) -> float:
            b, w = lasso(z[~test], y[~test], penalty)
            raw = b + z[test] @ w
            return float(np.logaddexp(0, np.where(y[test] > 0, -raw, raw)).mean())

        penalty = min(penalties, key=loss)
    rules, z = grown(np.arange(len(y)))
    b, w = lasso(z, y, penalty)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, text: str = "text", key: str = "doc_id", label: str = "quality") -> RuleEnsemble:
    """Fits on at most `max_labelled` labelled rows that aren't held out, those with the least hash of the key (ties by key and label);
    that bound is what the driver gets. Rows without key or label, and labels without a document, don't count; other columns of
    either table are ignored. Repeated rows count as often as they stand."""
    given, rows = Rows(labels), Rows(docs)
    known = given.df.select(F.col(given.column(key)).alias("key"), F.col(given.column(label)).cast("int").alias("y")).where(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key")))
    known = known.orderBy(F.xxhash64("key"), "key", "y").limit(max_labelled)
    mine = rows.df.select(F.col(rows.column(key)).alias("key"), F.coalesce(rows.column(text), F.lit("")).alias("text")).join(F.broadcast(known), "key")
    found = add_statistics(mine, "text").drop("text").orderBy(F.xxhash64("key"), "key", "y", "stat_log_bytes").limit(max_labelled).toPandas()
    return fit_rules(found[[f"stat_{s}" for s in STATISTICS]].to_numpy(), found["y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score is at least threshold).

    Only the whole text counts, however long; a null or empty one has statistics of 0 and gets the score of those. Equal texts have
    equal scores. Repeated rows are repeated, an empty table gives no rows. All columns of docs stay, whatever their names, but for
    those named like an added one (in any case), which the result's replace.
    """
    rows = Rows(docs)
    out = add_statistics(rows.df, rows.column(text)).withColumn("score", model.column())
    return rows.back(out, {"score": "score", "predicted": (F.col("score") >= threshold).cast("int")})
