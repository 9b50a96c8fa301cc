"""The classifier of windows: a 1-D convolutional network in numpy, with its training."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

KERNELS = (9, 7, 5)
FILTERS = (32, 64, 128)
DENSE = (128, 64)
BLOCK_DROPOUT = (0.15, 0.20, 0.0)
DENSE_DROPOUT = (0.35, 0.25)
_EPS = 1e-3  # of the batch normalisation
_KEEP = 0.9  # share of the running means and variances that a step keeps
_ROWS = 256  # windows scored at a time: the unfolded input of a block has at most 256 * length * 320 numbers


def rank_auc(score: np.ndarray, y: np.ndarray) -> float:
    """The area under the ROC curve, ties counted half; NaN if a class is missing."""
    low, high = np.sort(score[y == 0]), score[y == 1]
    if not len(low) or not len(high):
        return float("nan")
    return float((np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")).mean() / (2 * len(low)))


def split_rows(y: np.ndarray, rng: np.random.Generator, share: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Places of (the rest, `share` of each class), drawn."""
    taken = np.zeros(len(y), bool)
    for label in np.unique(y):
        places = rng.permutation(np.flatnonzero(y == label))
        taken[places[: round(share * len(places))]] = True
    return np.flatnonzero(~taken), np.flatnonzero(taken)


def _unfold(x: np.ndarray, k: int) -> np.ndarray:
    padded = np.pad(x, ((0, 0), (k // 2, k // 2), (0, 0)))
    return np.concatenate([padded[:, i : i + x.shape[1]] for i in range(k)], 2)


class WindowNet:
    """Three blocks of convolution, ReLU and batch normalisation, the first two halved by maxima; then the mean over the window, two
    dense layers and a logistic output.

    `weights` maps names to arrays, running means and variances included. `report` has what `trained` measured.
    """

    def __init__(self, filters: tuple[int, ...] = FILTERS, dense: tuple[int, ...] = DENSE, seed: int = 7, weights: dict[str, np.ndarray] | None = None):
        self.report: dict[str, float] = {}
        if weights is not None:
            self.weights = {k: np.asarray(w, np.float32) for k, w in weights.items()}
            return
        rng = np.random.default_rng(seed)
        made: dict[str, np.ndarray] = {}
        for i, (k, a, b) in enumerate(zip(KERNELS, (1, *filters), filters)):
            made[f"conv{i}.w"] = rng.uniform(-1, 1, (k * a, b)) * np.sqrt(6 / (k * (a + b)))
            made |= {f"conv{i}.b": np.zeros(b), f"conv{i}.scale": np.ones(b), f"conv{i}.shift": np.zeros(b), f"conv{i}.mean": np.zeros(b), f"conv{i}.var": np.ones(b)}
        for i, (a, b) in enumerate(zip((filters[-1], *dense), (*dense, 1))):
            made |= {f"dense{i}.w": rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), f"dense{i}.b": np.zeros(b)}
        self.weights = {k: w.astype(np.float32) for k, w in made.items()}

    def _run(self, x: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, list]:
        """The output before the logistic function, and, when training (`rng` given), the steps back through the layers."""
        w, back = self.weights, []
        a = x.astype(np.float32)[:, :, None]
        for i, k in enumerate(KERNELS):
            a = self._convolved(a, i, k, back, rng is not None)
            if i < len(KERNELS) - 1:
                a = self._halved(a, back, rng is not None)
            a = self._dropped(a, BLOCK_DROPOUT[i], rng, back)
        steps, shape = a.shape[1], a.shape
        back.append(lambda g, _: np.broadcast_to(g[:, None] / steps, shape))
        a = a.mean(1)
        last = sum(name.startswith("dense") for name in w) // 2 - 1
        for i in range(last + 1):
            a = self._dense(a, i, i < last, back)
            if i < last:
                a = self._dropped(a, DENSE_DROPOUT[i], rng, back)
        return a[:, 0], back

    def _convolved(self, a, i, k, back, training):
        w, name = self.weights, f"conv{i}"
        columns = _unfold(a, k)
        z = np.maximum(columns @ w[f"{name}.w"] + w[f"{name}.b"], 0)
        if not training:
            return (z - w[f"{name}.mean"]) / np.sqrt(w[f"{name}.var"] + _EPS) * w[f"{name}.scale"] + w[f"{name}.shift"]
        mean, var = z.mean((0, 1)), z.var((0, 1))
        for key, now in (("mean", mean), ("var", var)):
            w[f"{name}.{key}"] = _KEEP * w[f"{name}.{key}"] + (1 - _KEEP) * now
        sd = np.sqrt(var + _EPS)
        flat = (z - mean) / sd

        def step(g, grads):
            grads[f"{name}.scale"], grads[f"{name}.shift"] = (g * flat).sum((0, 1)), g.sum((0, 1))
            g = g * w[f"{name}.scale"]
            g = (g - g.mean((0, 1)) - flat * (g * flat).mean((0, 1))) / sd * (z > 0)
            rows = g.reshape(-1, g.shape[2])
            grads[f"{name}.w"], grads[f"{name}.b"] = columns.reshape(-1, columns.shape[2]).T @ rows, rows.sum(0)
            if i == 0:
                return None
            spread, n, c = g @ w[f"{name}.w"].T, a.shape[1], a.shape[2]
            out = np.zeros((len(a), n + 2 * (k // 2), c), np.float32)
            for j in range(k):
                out[:, j : j + n] += spread[:, :, j * c : (j + 1) * c]
            return out[:, k // 2 : k // 2 + n]

        back.append(step)
        return flat * w[f"{name}.scale"] + w[f"{name}.shift"]

    @staticmethod
    def _halved(a, back, training):
        if a.shape[1] < 2:
            return a
        even = a.shape[1] // 2 * 2
        left, right = a[:, 0:even:2], a[:, 1:even:2]
        if training:

            def step(g, _):
                out = np.zeros_like(a)
                out[:, 0:even:2], out[:, 1:even:2] = g * (left >= right), g * (left < right)
                return out

            back.append(step)
        return np.maximum(left, right)

    @staticmethod
    def _dropped(a, share, rng, back):
        if rng is None or not share:
            return a
        mask = ((rng.random(a.shape) >= share) / (1 - share)).astype(np.float32)
        back.append(lambda g, _: g * mask)
        return a * mask

    def _dense(self, a, i, hidden, back):
        w, name = self.weights, f"dense{i}"
        z = a @ w[f"{name}.w"] + w[f"{name}.b"]

        def step(g, grads):
            g = g * (z > 0) if hidden else g
            grads[f"{name}.w"], grads[f"{name}.b"] = a.T @ g, g.sum(0)
            return g @ w[f"{name}.w"].T

        back.append(step)
        return np.maximum(z, 0) if hidden else z

    def score(self, x: np.ndarray) -> np.ndarray:
        """The scores (0 to 1) of windows (n, length)."""
        out = [self._run(x[i : i + _ROWS], None)[0] for i in range(0, len(x), _ROWS)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out).astype(float), -30, 30))) if out else np.zeros(0)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy of a batch, by name of the weights."""
        z, back = self._run(x, rng)
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)[:, None]
        grads: dict[str, np.ndarray] = {}
        for step in reversed(back):
            g = step(g, grads)
        return grads

    def trained(
        self, x: np.ndarray, y: np.ndarray, *, epochs: int = 100, batch: int = 128, rate: float = 1e-3, patience: int = 12, halve: int = 6, least_rate: float = 1e-6, seed: int = 42,
        on_best: Callable[[WindowNet], None] | None = None,
    ) -> WindowNet:
        """Fitted by Adam with balanced classes; a fifth of each class is kept for `report`, a fifth of the rest for stopping.

        After `halve` epochs without a better validation AUC the rate is halved, after `patience` training stops; the best epoch's
        weights stay. `on_best` is called with the network after each better one, to store it while training goes on. Of equal AUCs, usual with few rows, the one with the smaller cross-entropy is better. Where a class is too rare to be split, all rows stand in for the missing part. Without rows nothing is fitted.
        """
        if not len(y):
            return self
        rng = np.random.default_rng(seed)
        both = lambda rows: len(np.unique(y[rows])) == 2
        rest, test = split_rows(y, rng)
        inner, held = split_rows(y[rest], rng)
        train, valid = rest[inner], rest[held]
        everything = np.arange(len(y))
        train, valid, test = (part if both(part) else everything for part in (train, valid, test))
        shares = {label: max(float((y[train] == label).mean()), 1e-9) for label in (0, 1)}
        weight = np.where(y == 1, 0.5 / shares[1], 0.5 / shares[0])
        first, second = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        best, kept, since, n = (-np.inf, -np.inf), dict(self.weights), 0, 0
        for epoch in range(1, epochs + 1):
            order = rng.permutation(train)
            for start in range(0, len(order), batch):
                rows, n = order[start : start + batch], n + 1
                for k, g in self.gradients(x[rows], y[rows], weight[rows], rng).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = first[k] / (1 - 0.9**n) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-7)
                    self.weights[k] = (self.weights[k] - rate * step).astype(np.float32)
            score = self.score(x[valid])
            right = np.log(np.clip(np.where(y[valid] == 1, score, 1 - score), 1e-7, 1))
            reached = (float(np.nan_to_num(rank_auc(score, y[valid]))), float(np.average(right, weights=weight[valid])))
            if reached > best:
                best, kept, since = reached, dict(self.weights), 0
                if on_best:
                    on_best(self)
                continue
            since += 1
            if since % halve == 0:
                rate = max(rate / 2, least_rate)
            if since >= patience:
                break
        self.weights = kept
        self.report = {"epochs": float(epoch), "validation_auc": best[0], "test_auc": rank_auc(self.score(x[test]), y[test])}
        return self
