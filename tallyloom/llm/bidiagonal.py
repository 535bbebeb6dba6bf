"""Singular values and right singular vectors of a small square matrix, by the bidiagonal qd route.

Householder reflections take the matrix to upper bidiagonal form, dqds finds the squared singular
values of that form to high relative accuracy, and a twisted factorisation of the tridiagonal
product gives each wanted vector without forming the others.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps

# Squared singular values closer than this share of the larger one get their vectors together.
CLUSTER = 1e-7


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, superdiagonal and the right reflections of `matrix` = U B Vt (square)."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    right = []
    for k in range(n):
        _reflect(a[k:, k:], a[k:, k].copy())
        if k + 2 < n:
            normal = _reflect(a[k:, k + 1 :].T, a[k, k + 1 :].copy())
            right.append((k + 1, normal))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflect(block: np.ndarray, column: np.ndarray) -> np.ndarray | None:
    """Reflects the rows of `block` in place so that `column` ends in its first entry."""
    largest = np.abs(column).max()
    if largest == 0:
        return None
    normal = column / largest
    normal[0] += np.copysign(np.linalg.norm(normal), normal[0])
    normal /= np.linalg.norm(normal)
    block -= 2 * np.outer(normal, normal @ block)
    return normal


def rotate_back(vectors: np.ndarray, right: list) -> np.ndarray:
    """Columns given in the coordinates of the bidiagonal form, in those of the matrix."""
    out = np.array(vectors, dtype=float)
    for start, normal in reversed(right):
        if normal is not None:
            out[start:] -= 2 * np.outer(normal, normal @ out[start:])
    return out


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform; None where the shift lies above the smallest value."""
    d, out_q, out_e = q[0] - shift, [], []
    if d < 0:
        return None
    for k in range(len(e)):
        top = d + e[k]
        ratio = q[k + 1] / top if top > 0 else 0.0
        out_q.append(top)
        out_e.append(e[k] * ratio)
        d = d * ratio - shift if top > 0 else q[k + 1] - shift
        if not d >= 0:
            return None
    out_q.append(d)
    return out_q, out_e


def _pair(a: float, b: float, off: float) -> tuple[float, float]:
    """Both values of a symmetric pair of rows with diagonal a, b and squared off-diagonal."""
    root = float(np.hypot((a - b) / 2, np.sqrt(off)))
    return (a + b) / 2 + root, (a + b) / 2 - root


def _last_shift(q: list[float], e: list[float]) -> float:
    """The smaller value of the last two rows of the product, less what ties them to the rest."""
    a, b, off, tie = q[-2] + e[-2], q[-1] + e[-1], q[-2] * e[-1], q[-3] * e[-2]
    value = _pair(a, b, off)[1]
    share = off / (off + (a - value) ** 2) if off else 0.0
    return max(0.0, value - float(np.sqrt(tie * share)))


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """All squared singular values of an upper bidiagonal matrix, largest first."""
    scale = float(np.max(np.abs(np.concatenate([diagonal, upper, [0.0]]))))
    if scale == 0:
        return np.zeros(len(diagonal))
    # a zero on the diagonal would break the transforms; this changes no value that counts
    q = [max(float(x / scale) ** 2, EPS**4) for x in diagonal]
    e = [float(x / scale) ** 2 for x in upper]
    found, work = [], [(q, e, 0.0)]
    while work:
        q, e, moved = work.pop()
        if len(q) == 1:
            found.append(q[0] + moved)
            continue
        limit = EPS * EPS
        cut = next((k for k in reversed(range(len(e))) if e[k] <= limit * (moved + min(q[k], q[k + 1]))), None)
        if cut is not None:
            work.append((q[: cut + 1], e[:cut], moved))
            work.append((q[cut + 1 :], e[cut + 1 :], moved))
            continue
        if len(q) == 2:
            high = _pair(q[0], q[1] + e[0], q[0] * e[0])[0]
            found += [high + moved, q[0] / high * q[1] + moved]
            continue
        if q[0] < q[-1]:  # small values are found at the end
            q, e = q[::-1], e[::-1]
        guess = _last_shift(q, e)
        for share in (1.0, 0.9, 0.5, 0.0):  # without a shift it always succeeds
            step = _dqds(q, e, share * guess)
            if step:
                work.append((*step, moved + share * guess))
                break
    return np.sort(np.array(found))[::-1] * scale * scale


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of both factorisations of (product - value) and the twist of every row.

    The product of the bidiagonal form with itself has pivots q and multipliers whose square times
    the pivot is e.
    """
    n, least = len(q), value * EPS * EPS
    low = np.sqrt(e / q[:-1])  # multiplier of the product's own factorisation
    forward, backward = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > least else least
        forward[k] = q[k] * low[k] / pivot
        s[k + 1] = forward[k] * low[k] * s[k] - value
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = e[k] + p[k + 1]
        pivot = pivot if abs(pivot) > least else least
        backward[k] = low[k] * q[k] / pivot
        p[k] = p[k + 1] * (q[k] / pivot) - value
    twist = s + p + value
    return forward, backward, twist


def _vector(forward: np.ndarray, backward: np.ndarray, row: int) -> np.ndarray:
    z = np.zeros(len(forward) + 1)
    z[row] = 1.0
    for k in range(row - 1, -1, -1):
        z[k] = -forward[k] * z[k + 1]
    for k in range(row, len(forward)):
        z[k + 1] = -backward[k] * z[k]
    return z


def _refined(q: np.ndarray, e: np.ndarray, value: float, known: list[np.ndarray]) -> np.ndarray:
    """The vector of `value`, at right angles to those that are `known` from the same cluster."""
    best = None
    for _ in range(3):
        forward, backward, twist = _twisted(q, e, value)
        order = np.argsort(np.abs(twist), kind="stable")
        for row in order if known else order[:1]:
            z = _vector(forward, backward, int(row))
            z /= np.linalg.norm(z)
            for _ in range(2):
                for other in known:
                    z = z - other * (other @ z)
            size = np.linalg.norm(z)
            if size > 0.1:
                best = z / size
                break
        if known or best is None:
            break
        row = int(order[0])
        correction = float(twist[row]) * best[row] ** 2  # Rayleigh quotient
        if abs(correction) <= 2 * EPS * value:
            break
        value += correction
    return best


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `wanted` largest squared singular values and their right vectors, as columns.

    Values within rounding of zero are left out, so a matrix of low rank gives fewer.
    """
    n = len(matrix)
    if n == 0 or not np.any(matrix):
        return np.zeros(0), np.zeros((n, 0))
    diagonal, upper, right = bidiagonalise(matrix)
    values = squared_values(diagonal, upper)
    least = values[0] * (n * 8 * EPS) ** 2
    values = values[values > least]
    q = np.maximum(diagonal**2, values[0] * EPS**4)
    e = upper**2
    # low multipliers carry the sign of the form
    signs = np.sign(np.where(diagonal[:-1] * upper == 0, 1.0, diagonal[:-1] * upper))
    flips = np.concatenate([[1.0], np.cumprod(signs)])
    vectors: list[np.ndarray] = []
    cluster = 0
    for k in range(min(wanted, len(values))):
        if k and values[k - 1] - values[k] > CLUSTER * values[k - 1]:
            cluster = k
        vectors.append(_refined(q, e, float(values[k]), vectors[cluster:]))
    columns = np.array(vectors).T * flips[:, None]
    return values[: len(vectors)], rotate_back(columns, right)
