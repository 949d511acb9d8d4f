"""Context mixing whose weights and map move while a text is read.

The same predictors, gates and map as in ``context_mixing``; but each piece of a text is predicted by what the pieces before it have taught, and then moves the weights of its
gates against the error and the map's cells towards what came. So order matters, nothing that repeats can be priced once, and a text's cost is its own: ``README.md`` has the figures, which
are why the query learns in two steps instead. It serves texts of a size that one task reads, such as a sample to tune by.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from cellweave.llm.context_mixing import GATES, INPUTS, LEVELS, ORDERS, REACH, Model, Runs, coded, laid_out

#: Runs of a piece, whose bits are predicted together.
PIECE = 64
#: How far a bit's error moves its gate's weights, and a cell of the map.
RATE, MAP_RATE = 0.002, 0.002


class Online:
    """A model that learns from what it prices."""

    def __init__(self, model: Model, piece: int = PIECE, rate: float = RATE, map_rate: float = MAP_RATE):
        self.model, self.piece, self.rate, self.map_rate = model, piece, rate, map_rate

    def text(self, text: str | None, less: bool = False) -> float:
        """Natural logarithm of a text's probability, bit after bit. less: the text is in the counts, and each bit is predicted as if it weren't."""
        flat, own = laid_out([coded(text)])
        runs, total = Runs(flat, own, inverse=True), 0.0
        order = runs.number  # of each byte its run
        for at in range(0, len(order), self.piece):
            for rows, ones, nodes in runs.pieces(order[at : at + self.piece]):
                x, gate = self.model.inputs(runs, rows, ones, nodes, less)
                total += self.learn(x, gate, ones.ravel())
        return total

    def learn(self, x: np.ndarray, gate: np.ndarray, one: np.ndarray) -> float:
        """Price bits together, then move weights and map by their errors."""
        m = self.model
        p, mixed, odds = m.predict(x, gate)
        price = float(np.log(np.where(one, p, 1 - p)).sum())
        error = (one - mixed).astype(np.float32)
        step = np.zeros((INPUTS, GATES), np.float32)
        for k in range(INPUTS):
            step[k] = np.bincount(gate, x[k] * error, minlength=GATES)
        m.weights += self.rate * step.T
        at = np.clip((odds + REACH) * ((LEVELS - 1) / (2 * REACH)), 0, LEVELS - 1.001)
        low = at.astype(np.int64)
        table, part = m.refined.reshape(-1), at - low
        for cell, share in ((gate * LEVELS + low, 1 - part), (gate * LEVELS + low + 1, part)):
            n = np.bincount(cell, share, minlength=len(table))
            table += self.map_rate * (np.bincount(cell, share * one, minlength=len(table)) - n * table)
        return price


def learned(model: Model, texts: Iterable[str | None], **options) -> float:
    """Move a model by training texts, one after the other; their price as they came, in natural logarithms."""
    online = Online(model, **options)
    return sum(online.text(t, less=True) for t in texts)
