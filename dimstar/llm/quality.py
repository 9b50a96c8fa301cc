"""Quality classifier: a generalised additive model with pairwise interactions (GA2M) over text statistics.

Cyclic boosting visits one feature after the other, fits a shallow tree to that feature's gradients and adds it to the feature's
lookup table; pairs with the largest gain on what is left get two-dimensional tables the same way. A score is the logistic of a
sum of table entries, looked up for whole batches by bin numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import ship_code
from dimstar.llm.skew import small_batches

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeated_neighbours", "distinct_lines", "words_per_line",
    "upper", "digit", "symbol", "beyond_ascii", "plain_words", "compressed",
)

_SYMBOLS = np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,"])
_ENDS = frozenset("*$%#&!|")


def text_features(text: str | None) -> tuple[float, ...]:
    """The FEATURES of a whole text; null counts as empty, whose features are all 0."""
    if not text:
        return (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, chars = max(len(words), 1), len(text)
    counts = Counter(words)
    return (
        np.log1p(chars),
        np.log1p(len(words)),
        (chars - int(seen[9:14].sum()) - int(seen[32])) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        int(seen[65:91].sum()) / chars,
        int(seen[48:58].sum()) / chars,
        int(seen[_SYMBOLS].sum()) / chars,
        int(seen[192:].sum()) / chars,
        sum(c for w, c in counts.items() if w[-1] not in _ENDS) / n,
        len(zlib.compress(raw, 1)) / len(raw),
    )


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smallest: float) -> np.ndarray:
    """Newton values per bin of a tree over ordered bins, grown by the best split until it has `leaves` leaves."""
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    spans = [(0, len(grad))]
    while len(spans) < leaves:
        best = (1e-9, None)
        for a, b in spans:
            cuts = np.arange(a + 1, b)
            cuts = cuts[(h[cuts] - h[a] >= smallest) & (h[b] - h[cuts] >= smallest)]
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, int(cuts[k]), b))
        if best[1] is None:
            break
        a, cut, b = best[1]
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, smallest: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-dimensional table into four parts, one split on each axis."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    parts = []
    for s in (g, h):
        a, right, below, whole = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        parts.append(np.stack([a, right - a, below - a, whole - right - below + a]))
    gain = (parts[0] ** 2 / (parts[1] + 1.0)).sum(0)
    gain[(parts[1] < smallest).any(0)] = -1
    r, c = np.unravel_index(gain.argmax(), gain.shape)
    values = np.zeros_like(grad)
    if gain[r, c] <= 0:
        return 0.0, values
    v = -parts[0][:, r, c] / (parts[1][:, r, c] + 1.0)
    values[: r + 1, : c + 1], values[: r + 1, c + 1 :], values[r + 1 :, : c + 1], values[r + 1 :, c + 1 :] = v
    return float(gain[r, c]), values


class AdditiveModel:
    """Tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 48, coarse: int = 12):
        self.bins, self.coarse = bins, coarse
        self.base = 0.0
        self.pairs: list[tuple[int, int]] = []

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, *, rounds: int = 60, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, leaves: int = 4, smallest: float = 2.0) -> AdditiveModel:
        n, f = x.shape
        cut = lambda j, k: np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if n else np.zeros(0)
        self.edges, self.coarse_edges = [cut(j, self.bins) for j in range(f)], [cut(j, self.coarse) for j in range(f)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables: list[np.ndarray] = []
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        fine, rough = self._binned(x, self.edges), self._binned(x, self.coarse_edges)
        score = np.full(n, self.base)

        def slopes():
            p = 1 / (1 + np.exp(-score))
            return p - y, np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for j in range(f):
                g, h = slopes()
                k = len(self.tables[j])
                step = rate * _shallow_tree(np.bincount(fine[:, j], g, k), np.bincount(fine[:, j], h, k), leaves, smallest)
                self.tables[j] += step
                score += step[fine[:, j]]
        shape = lambda i, j: (len(self.coarse_edges[i]) + 1, len(self.coarse_edges[j]) + 1)

        def pair_step(i, j):
            g, h = slopes()
            s = shape(i, j)
            cell = rough[:, i] * s[1] + rough[:, j]
            return cell, _quadrants(np.bincount(cell, g, s[0] * s[1]).reshape(s), np.bincount(cell, h, s[0] * s[1]).reshape(s), smallest)

        possible = [p for p in combinations(range(f), 2) if min(shape(*p)) > 1]
        self.pairs = sorted(possible, key=lambda p: -pair_step(*p)[1][0])[:n_pairs]
        self.pair_tables = [np.zeros(shape(*p)) for p in self.pairs]
        for _ in range(pair_rounds):
            for k, p in enumerate(self.pairs):
                cell, (_, values) = pair_step(*p)
                self.pair_tables[k] += rate * values
                score += rate * values.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: bin numbers of the whole batch, then sums of table entries."""
        fine, rough = self._binned(x, self.edges), self._binned(x, self.coarse_edges)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[fine[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-total))


def held_out(id_col: str = "doc_id"):
    """Rows that training may not see: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(True))


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most `max_rows` labelled rows that aren't held out (those with the smallest id hashes), on the driver.

    Labels other than 0 and 1, and rows without an id, are left out; of repeated labels of an id the largest counts, of repeated texts
    the least. Without labelled rows every text scores one half.
    """
    ship_code(docs.sparkSession)
    fit = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(~held_out("id") & F.col("y").isin(0, 1))
    chosen = fit.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [list(text_features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    # max_rows rows of an id and a label: the bound of this broadcast; of several texts of an id the least counts
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")
    found = rows.mapInArrow(measure, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    y = np.array([r["y"] for r in found], float)
    order = np.lexsort((*x.T, y))
    return AdditiveModel().fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text enters the score. Null and empty texts get the score of an empty text. Repeated rows are scored alike.
    """
    score = quality_score(docs, model, text_col)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text"):
    """The score of each row of `docs` as a column expression."""
    ship_code(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = np.array([text_features(t) for t in texts.to_pylist()], float).reshape(len(texts), len(FEATURES))
        return pa.array(model.score(rows), pa.float64())

    return score(F.col(text_col))


def keep_good(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of `docs` whose text scores at least `least`; columns as they were.

    Null and empty texts have the score of an empty text, repeated rows go or stay together, ids aren't read; an empty table gives no
    rows.
    """
    return docs.filter(quality_score(docs, model, text_col) >= least)
