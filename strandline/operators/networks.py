"""Network models of large structures: a sparse Laplacian from the contact join, solved iteratively.

A structure's contacts are a row; no matrix of residues by residues exists.
Fluctuations are the diagonal of the Laplacian's pseudo-inverse: one solve a
residue, in blocks that are dealt over all tasks. Slow modes come from a block
Krylov space of the pseudo-inverse.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.grouped import _spread
from strandline.operators.pairs import contacts

#: Residues of a structure that one task solves for at once.
BLOCK = 64


class Graph:
    """The contacts of one structure, residues numbered from 0: neighbours in rows, one after another."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray):
        a, b = np.concatenate((i, j)).astype(np.int64), np.concatenate((j, i)).astype(np.int64)
        order = np.lexsort((b, a))
        self.n, self.other = n, b[order]
        self.degree = np.bincount(a, minlength=n).astype(float)
        self.begin = np.concatenate(([0], np.cumsum(self.degree[:-1]))).astype(np.int64)
        self.some = np.flatnonzero(self.degree)
        self.part = self._parts()
        self.sizes = np.bincount(self.part).astype(float)

    def _parts(self) -> np.ndarray:
        """Number of the connected part of each residue."""
        label = np.arange(self.n)
        while len(self.some):
            low = label.copy()
            low[self.some] = np.minimum(label[self.some], np.minimum.reduceat(label[self.other], self.begin[self.some]))
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        return np.unique(label, return_inverse=True)[1]

    def times(self, x: np.ndarray) -> np.ndarray:
        """The Laplacian times columns x (n, k)."""
        out = self.degree[:, None] * x
        if len(self.some):
            out[self.some] -= np.add.reduceat(x[self.other], self.begin[self.some], axis=0)
        return out

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Columns without their mean over each connected part, which the Laplacian does not see."""
        total = np.zeros((len(self.sizes), x.shape[1]))
        np.add.at(total, self.part, x)
        return x - (total / self.sizes[:, None])[self.part]

    def solve(self, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
        """The pseudo-inverse times columns b, by conjugate gradients with the degrees as preconditioner."""
        b = self.centred(b)
        x, r = np.zeros_like(b), b.copy()
        scale = 1.0 / np.maximum(self.degree, 1.0)[:, None]
        z = self.centred(scale * r)
        p, rz = z.copy(), (r * z).sum(0)
        limit = tolerance * np.maximum(np.linalg.norm(b, axis=0), 1e-300)
        for _ in range(10 * self.n + 10):
            open_ = np.linalg.norm(r, axis=0) > limit
            if not open_.any():
                break
            q = self.times(p)
            step = np.where(open_, rz / np.where(open_, (p * q).sum(0), 1.0), 0.0)
            x += step * p
            r -= step * q
            z = self.centred(scale * r)
            new = (r * z).sum(0)
            p = z + np.where(open_, new / np.where(rz > 0, rz, 1.0), 0.0) * p
            rz = new
        return self.centred(x)

    def diagonal(self, rows: np.ndarray) -> np.ndarray:
        """Entries of the pseudo-inverse's diagonal."""
        unit = np.zeros((self.n, len(rows)))
        unit[rows, np.arange(len(rows))] = 1.0
        return self.solve(unit)[rows, np.arange(len(rows))]

    def slow_modes(self, modes: int, tolerance: float = 1e-7, seed: int = 0, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors) of the lowest modes above zero: Rayleigh-Ritz in a block Krylov space of the pseudo-inverse, orthogonalised in full."""
        modes = min(modes, self.n - len(self.sizes))
        if modes < 1:
            return np.empty(0), np.empty((self.n, 0))
        basis = np.empty((self.n, 0))
        block = self.centred(np.random.default_rng(seed).normal(size=(self.n, width)))
        while True:
            for _ in range(2):
                block -= basis @ (basis.T @ block)
            q, r = np.linalg.qr(block)
            q = q[:, np.abs(np.diag(r)) > 1e-10 * max(1e-300, np.abs(r).max())]
            full = not q.shape[1] or basis.shape[1] + q.shape[1] > self.n - len(self.sizes)
            if q.shape[1]:
                basis = np.concatenate((basis, self.centred(q)), axis=1)
            small = basis.T @ self.times(basis)
            values, turn = np.linalg.eigh((small + small.T) / 2)
            good = values > 1e-9
            values, turn = values[good][:modes], turn[:, good][:, :modes]
            vectors = basis @ turn
            rest = np.linalg.norm(self.times(vectors) - vectors * values, axis=0)
            if full or len(values) == modes and (rest <= tolerance * max(values[-1], 1e-300)).all():
                return values, vectors
            block = self.solve(q)


def structure_graphs(points: DataFrame, cutoff: float = 7.5) -> DataFrame:
    """(chain, model, seq, i, j): one row a structure, its residues in order and its contacts by their places, from 0.

    A structure's contacts are a few for each residue, and one value by nature.
    """
    residues = points.groupBy("chain", "model").agg(F.sort_array(F.collect_list("seq")).alias("seq"))
    met = contacts(points, ["chain", "model"], cutoff).groupBy("chain", "model").agg(F.collect_list(F.struct("i", "j")).alias("c"))
    return residues.join(met, ["chain", "model"], "left").select("chain", "model", "seq", F.col("c.i").alias("i"), F.col("c.j").alias("j"))


def _graph(seq, i, j) -> Graph:
    none = np.empty(0, np.int64)
    a, b = (none if v is None else np.searchsorted(seq, v) for v in (i, j))
    return Graph(len(seq), a, b)


def large_fluctuations(points: DataFrame, cutoff: float = 7.5, gamma: float = 1.0, kt: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(chain, model, seq, msf, b_factor) as `network_model` gives them with all modes, for structures of any size.

    points (chain, model, seq, x, y, z). A residue without contacts has none of
    its own motion: 0. Work is dealt by structure and block of residues.
    """
    graphs = structure_graphs(points, cutoff)
    blocks = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(seq) - 1) div {block} as int)"))))
    factor = 3.0 * kt / gamma / gamma

    def run(frames):
        for pdf in frames:
            key, graph, out = None, None, []
            for chain, model, seq, i, j, b in pdf.itertuples(index=False):
                if (chain, model) != key:
                    key, graph = (chain, model), _graph(seq, i, j)
                rows = np.arange(b * block, min(len(seq), (b + 1) * block))
                msf = factor * graph.diagonal(rows)
                out.append((chain, model, seq[rows], msf, 8 * np.pi**2 / 3 * msf))
            yield pd.DataFrame(out, columns=["chain", "model", "seq", "msf", "b_factor"])

    kind = points.schema["chain"].dataType.simpleString()
    found = _spread(blocks, "chain", "model", "block").mapInPandas(run, f"chain {kind}, model long, seq array<long>, msf array<double>, b_factor array<double>")
    return found.select("chain", "model", F.inline(F.arrays_zip("seq", "msf", "b_factor")))


def slow_modes(points: DataFrame, modes: int = 10, cutoff: float = 7.5, gamma: float = 1.0) -> DataFrame:
    """(chain, model, mode, eigenvalue, shape): the lowest modes above zero of each structure, from 1; the first residue that moves is on the positive side."""

    def run(frames):
        for pdf in frames:
            out = []
            for chain, model, seq, i, j in pdf.itertuples(index=False):
                values, vectors = _graph(seq, i, j).slow_modes(modes)
                for k, v in enumerate(values):
                    x = vectors[:, k]
                    sign = np.sign(x[np.argmax(np.abs(x) > 1e-6)]) or 1.0
                    out.append((chain, model, k + 1, gamma * v, sign * x))
            yield pd.DataFrame(out, columns=["chain", "model", "mode", "eigenvalue", "shape"])

    kind = points.schema["chain"].dataType.simpleString()
    return _spread(structure_graphs(points, cutoff), "chain", "model").mapInPandas(run, f"chain {kind}, model long, mode int, eigenvalue double, shape array<double>")
