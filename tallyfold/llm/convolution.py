"""Text convolutions in numpy: several filter widths, maxima over positions, one linear layer.

A filter of width w over symbols with embeddings is a sum of w table rows: the product
of the embedding table and each of the filter's w columns is formed once, so that a
batch is convolved by look-ups and additions.  Training takes Adam steps on cross
entropy; maxima pass their gradient to the position that won.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text that a training task takes at most, besides the bound on its rows.
SAMPLE_BYTES = 64 << 20


def trained(sample: DataFrame, order: list[str], train: Callable[[list[dict]], object], column: str, most: int = SAMPLE_BYTES) -> object:
    """What ``train`` makes of a bounded sample, in one task and in the given order; only the model comes back.

    A row whose value of ``column`` does not fit into what is left of ``most`` bytes is passed
    over, and the next ones are tried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            for i, own in enumerate(sizes):
                if size + own <= most:
                    size += own
                    rows.append({name: batch.column(name)[i].as_py() for name in batch.schema.names})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])


class MaxConvolution:
    """Embeds symbols, convolves, takes maxima over segments and applies a linear layer."""

    def __init__(self, symbols: int, size: int, widths: tuple[int, ...], filters: int, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        n = filters * len(widths)
        self.parts = {
            "embedding": rng.normal(0, 0.3, (symbols, size)),
            "linear": rng.normal(0, n**-0.5, (n, classes)),
            "bias": np.zeros(classes),
        }
        for w in widths:
            self.parts[f"filter{w}"] = rng.normal(0, (w * size) ** -0.5, (w, size, filters))
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}
        self._moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.parts.items()}
        self._step = 0

    def __getstate__(self) -> dict:
        """A stored net can score; the moments of its training stay behind."""
        return {k: v for k, v in vars(self).items() if k not in ("_moments", "_step")}

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, each tap's product with the embedding table."""
        e = self.parts["embedding"]
        return {w: [np.ascontiguousarray(e @ self.parts[f"filter{w}"][k]) for k in range(w)] for w in self.widths}

    # --- training on padded batches of symbol bags: (examples, positions, features) symbols

    def step(self, bags: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float) -> float:
        """One Adam step; bags hold symbol numbers, -1 where there is none."""
        p = self.parts
        there = bags >= 0
        e = (p["embedding"][np.maximum(bags, 0)] * there[..., None]).sum(2)
        n, length, size = e.shape
        pooled, won = [], []
        for w in self.widths:
            f = p[f"filter{w}"]
            r = sum(e[:, k : length - w + 1 + k] @ f[k] for k in range(w))
            at = r.argmax(1)
            won.append(at)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        x = np.concatenate(pooled, 1)
        h = np.maximum(x, 0)
        logits = h @ p["linear"] + p["bias"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        line = np.arange(n)
        loss = float(-(weights * np.log(q[line, labels] + 1e-9)).sum() / weights.sum())
        d = q.copy()
        d[line, labels] -= 1
        d *= (weights / weights.sum())[:, None].astype(np.float32)
        grad = {"linear": h.T @ d, "bias": d.sum(0), "embedding": np.zeros_like(p["embedding"])}
        dx = (d @ p["linear"].T) * (x > 0)
        de = np.zeros_like(e)
        for j, w in enumerate(self.widths):
            f = p[f"filter{w}"]
            dr = dx[:, j * self.filters : (j + 1) * self.filters]
            df = np.zeros_like(f)
            for k in range(w):
                spot = won[j] + k
                df[k] = np.einsum("nfs,nf->sf", e[line[:, None], spot], dr)
                np.add.at(de, (line[:, None], spot), dr[:, :, None] * f[k].T[None])
            grad[f"filter{w}"] = df
        touched = np.flatnonzero(np.abs(de).sum(2).ravel())
        flat = bags.reshape(n * length, -1)[touched]
        moved = de.reshape(n * length, size)[touched]
        for k in range(flat.shape[1]):
            ok = flat[:, k] >= 0
            np.add.at(grad["embedding"], flat[ok, k], moved[ok])
        self._step += 1
        for k, g in grad.items():
            m, v = self._moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p[k] -= rate * (m / (1 - 0.9**self._step)) / (np.sqrt(v / (1 - 0.99**self._step)) + 1e-7)
        return loss

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        """Class probabilities from pooled maxima, one row each."""
        logits = np.maximum(pooled, 0) @ self.parts["linear"] + self.parts["bias"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        return q / q.sum(1, keepdims=True)
