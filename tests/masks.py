"""Drawn masks as rows of text."""

from __future__ import annotations

import math

import numpy as np


def text(mask: np.ndarray) -> list[str]:
    return ["".join("#" if x else "." for x in row) for row in mask]


def disc(radius: int, inner: int = -1) -> np.ndarray:
    n = 2 * radius + 3
    r, c = np.mgrid[:n, :n] - (radius + 1)
    d2 = r * r + c * c
    return (d2 <= radius * radius) & (d2 > inner * inner if inner >= 0 else True)


def ellipse(a: float, b: float, degrees: float, n: int) -> np.ndarray:
    r, c = np.mgrid[:n, :n] - n / 2
    t = math.radians(degrees)
    u, v = c * math.cos(t) - r * math.sin(t), c * math.sin(t) + r * math.cos(t)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


def box(height: int, width: int) -> np.ndarray:
    return np.ones((height, width), bool)


def bent() -> np.ndarray:
    m = np.zeros((30, 30), bool)
    m[5:25, 5:10] = True
    m[20:25, 5:25] = True
    return m


DRAWN = {
    1: ("px1", box(1, 1)), 2: ("sq2", box(2, 2)), 3: ("line1x20", box(1, 20)), 4: ("sq10", box(10, 10)), 5: ("rect10x40", box(10, 40)),
    6: ("disc3", disc(3)), 7: ("disc10", disc(10)), 8: ("disc50", disc(50)), 9: ("ring", disc(20, 10)), 10: ("L", bent()),
    11: ("ell_semi", ellipse(100, 40, 30, 260)), 12: ("ell_full", ellipse(50, 20, 30, 140)), 13: ("ell_120", ellipse(100, 40, 120, 260)), 14: ("empty", np.zeros((5, 5), bool)),
}
