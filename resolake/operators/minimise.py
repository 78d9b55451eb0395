"""A minimiser that asks for values and gradients, so that many can share the passes over a table."""

from __future__ import annotations

import numpy as np


class Minimiser:
    """L-BFGS, orthant-wise where there is an L1 part; asks for the value and gradient of the smooth part at `trial`.

    x: the best point so far, after `steps` steps; slope: the gradient there with the L1 part's.
    """

    def __init__(self, size: int, c1: float, memory: int = 8, tolerance: float = 1e-4):
        self.c1, self.memory, self.tolerance = c1, memory, tolerance
        self.x = self.trial = np.zeros(size)
        self.value, self.done, self.past, self.steps = None, False, [], 0

    def _slope(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The gradient with the L1 part's, of the least size where it has a choice."""
        up, down = g + self.c1, g - self.c1
        return np.where(x > 0, up, np.where(x < 0, down, np.where(up < 0, up, np.where(down > 0, down, 0.0))))

    def _direction(self) -> np.ndarray:
        q, kept = self.slope.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.past, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        d = -q
        if self.c1:
            d[d * self.slope >= 0] = 0
        return d

    def _propose(self) -> None:
        self.trial = self.x + self.step * self.d
        if self.c1:
            side = np.where(self.x != 0, np.sign(self.x), -np.sign(self.slope))
            self.trial[self.trial * side <= 0] = 0

    def trials(self, most: int) -> list[np.ndarray]:
        """`trial`, and up to `most` points in all that it would be followed by if each were refused; told in this order, they give the same path in fewer passes."""
        found, kept = [self.trial], self.trial
        if self.value is not None:
            step = self.step
            while len(found) < most and self.step / 2 >= 1e-12:
                self.step /= 2
                self._propose()
                found.append(self.trial)
            self.step, self.trial = step, kept
        return found

    def tell(self, value: float, gradient: np.ndarray) -> None:
        value += self.c1 * np.abs(self.trial).sum()
        if self.value is not None:
            moved = self.trial - self.x
            if value > self.value + 1e-4 * (self.slope @ moved):
                self.step /= 2
                self.done = self.step < 1e-12
                return self._propose()
            change = gradient - self.gradient
            if moved @ change > 1e-10:
                self.past = [*self.past[-self.memory + 1 :], (moved, change)]
            self.steps += 1
        self.x, self.value, self.gradient = self.trial, value, gradient
        self.slope = self._slope(self.x, gradient)
        self.done = np.linalg.norm(self.slope) <= self.tolerance * max(1.0, np.linalg.norm(self.x))
        self.d = self._direction()
        if self.d @ self.slope >= 0:
            self.past, self.d = [], -self.slope
        self.step = 1.0 if self.past else 1 / max(np.linalg.norm(self.slope), 1.0)
        return self._propose()
