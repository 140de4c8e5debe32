"""Recurrences that are affine in their state: what a block of bars makes of the state before it is a matrix and a summand."""

from __future__ import annotations

import numpy as np


class Linear:
    """A kernel (see kernels) whose state after some bars is decay(bars) @ state + what the bars add.

    states: length of the state.  warmup: bars from which on this holds; a block that
    isn't a key's first begins after them.
    """

    states = 1
    warmup = 1

    def enter(self, at: int, state: np.ndarray) -> None:
        """Go on at bar `at` from a state."""
        raise NotImplementedError

    def leave(self) -> np.ndarray:
        raise NotImplementedError

    def step(self) -> np.ndarray:
        """The matrix of one bar, where it is the same for all bars."""
        raise NotImplementedError

    def decay(self, *inputs: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.step(), len(inputs[0]))


def compose(gain: np.ndarray, add: np.ndarray, start: float) -> np.ndarray:
    """y of each bar for y = gain y + add from y = start on.

    The bars' maps are composed over spans of one bar, two, four, ...: no step per bar and
    no division by products that vanish.
    """
    a, b, span = gain.copy(), add.copy(), 1
    while span < len(a):
        b[span:], a[span:] = a[span:] * b[:-span] + b[span:], a[span:] * a[:-span]
        span *= 2
    return a * start + b
