"""How the classifier's constants were chosen: by cross-validation on labelled rows that are not held out.

    python -m pathloom.llm.choose_quality DIR

DIR has the tables documents and labels, small enough for one machine. Rows whose crc32 of the id leaves 1 by 3 have no
part in it, neither their labels nor their texts. Each fold's labelled rows are left out of both sets of the fit.
"""

from __future__ import annotations

import itertools
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq

from . import quality

FOLDS = 4
GRID = (1e-3, 3e-3, 1e-2, 3e-2, 1e-1), (0.02, 0.05), (200, 400)


def validate(x: np.ndarray, labels: dict[int, int], decay: float, rate: float, steps: int) -> tuple[float, float]:
    """Accuracy and area under the curve, as means over the folds. labels: of rows of x, by their number."""
    rows = sorted(labels)
    fold = dict(zip(rows, np.random.default_rng(0).integers(0, FOLDS, len(rows)), strict=True))
    found = []
    for f in range(FOLDS):
        draw, test = np.random.default_rng(f + 1), [i for i in rows if fold[i] == f]
        p = draw.permutation([i for i in rows if labels[i] == 1 and fold[i] != f])[: quality.POSITIVES]
        u = draw.permutation(np.setdiff1d(np.arange(len(x)), test))[: quality.UNLABELLED]
        model = quality.fit(np.vstack([x[p], x[u]]), np.arange(len(p) + len(u)) < len(p), steps, rate, decay)
        s, y = model.score(x[test]), np.array([labels[i] for i in test])
        found.append((np.mean((s >= 0.5) == y), np.mean(s[y == 1][:, None] > s[y == 0])))
    return tuple(np.mean(found, axis=0))


def main(where: str) -> None:
    kept = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    docs = pq.read_table(f"{where}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [r for r in docs if kept(r["doc_id"])]
    number = {r["doc_id"]: k for k, r in enumerate(docs)}
    labels = {number[r["doc_id"]]: r["quality"] for r in pq.read_table(f"{where}/labels.parquet").to_pylist() if r["doc_id"] in number and r["quality"] is not None}
    x = np.array([quality.features((r["text"] or "").encode()) for r in docs], np.float32)
    for decay, rate, steps in itertools.product(*GRID):
        print(decay, rate, steps, *(f"{v:.4f}" for v in validate(x, labels, decay, rate, steps)), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
