"""Singular values and right singular vectors of a small square matrix: Householder bidiagonal form, dqds, twisted factorisations.

Sizes here are a vector's dimension, so this is the driver's last step over what Spark has reduced; nothing in it depends on rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V with a = U B V^T, by Householder reflections from both sides."""
    a = np.array(a, float)
    d = len(a)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        w = x / size
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d and (w := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of B^T B, falling, from the squares q of B's diagonal and e of its superdiagonal.

    Differential quotient-difference sweeps with shifts: a shift that turns out too large is cut, down to none, which always
    works; what is split off at the end is an eigenvalue less the shifts so far.
    """
    found, stack = [], [(np.array(q, float), np.array(e, float), 0.0)]
    while stack:
        q, e, shifted = stack.pop()
        n = len(q)
        while n:
            # split where the superdiagonal is nothing beside its neighbours
            small = np.nonzero(e[: n - 1] <= EPS**2 * (q[: n - 1] + shifted))[0]
            if len(small):
                at = small[-1] + 1
                if at < n:
                    if at == n - 1:
                        found.append(q[n - 1] + shifted)
                    else:
                        stack.append((q[at:n].copy(), e[at : n - 1].copy(), shifted))
                    n = at
                    continue
            if n == 1:
                found.append(q[0] + shifted)
                break
            if n == 2:
                # the smaller root by its product with the larger one, which has no cancellation
                s = q[0] + q[1] + e[0]
                big = (s + np.sqrt(max(0.0, (q[0] - q[1]) ** 2 + e[0] * (e[0] + 2 * (q[0] + q[1]))))) / 2
                found += [big + shifted, (q[0] * (q[1] / big) if big else 0.0) + shifted]
                break
            shift = _shift(q[:n], e[: n - 1])
            while True:
                swept = _sweep(q[:n], e[: n - 1], shift)
                if swept is not None:
                    break
                shift = shift / 4 if shift > EPS * (q[:n].min() + shifted) else 0.0
            q, e = swept
            shifted += shift
    return np.sort(np.maximum(found, 0.0))[::-1]


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A value under the least eigenvalue that is near it once the last superdiagonal is small (Gerschgorin at the end)."""
    n = len(q)
    guess = q[-1] - np.sqrt(q[-1] * e[-1])
    if n > 2:
        guess = min(guess, q[-2] + e[-1] - np.sqrt(q[-1] * e[-1]) - np.sqrt(q[-2] * e[-2]))
    return max(0.0, guess)


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One step; none if the shift was beyond the least eigenvalue."""
    new_q, new_e, d = np.empty_like(q), np.empty_like(e), q[0] - shift
    if d < 0:
        return None
    for i in range(len(e)):
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            ratio, new_e[i] = 0.0, 0.0
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / new_q[i]
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        if d < 0:
            return None
    new_q[-1] = d
    return new_q, new_e


def twisted(b: np.ndarray, c: np.ndarray, value: float, twist: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A vector z with (B^T B - value) z nearly 0, and |gamma| of every twist; B has diagonal b and superdiagonal c.

    Two factorisations in qd form meet: one from the top (stationary), one from the bottom (progressive); where the pivot gamma left
    in the middle is least, both halves of the vector start. twist chooses another place. Neither forms B^T B, so that the directions
    of small values keep their accuracy.
    """
    n = len(b)
    q, e, cross = b**2, c**2, b[:-1] * c
    tiny = np.finfo(float).tiny / EPS
    safe = lambda x: x if abs(x) > tiny else np.copysign(tiny, x or 1.0)
    s, p, down, up = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0], p[-1] = -value, q[-1] - value
    for i in range(n - 1):
        pivot = safe(s[i] + q[i])
        down[i] = cross[i] / pivot
        s[i + 1] = e[i] * (s[i] / pivot) - value
        j = n - 2 - i
        pivot = safe(e[j] + p[j + 1])
        up[j] = cross[j] / pivot
        p[j] = p[j + 1] * (q[j] / pivot) - value
    gamma = np.abs(s + p + value)
    k = int(np.argmin(gamma)) if twist is None else twist
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z), gamma


#: Eigenvalues nearer than this share of the larger one are a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3


def right_vectors(b: np.ndarray, c: np.ndarray, squares: np.ndarray, first: int) -> np.ndarray:
    """Orthonormal columns: right singular vectors of B for the first squares. B is split where its superdiagonal is nothing.

    A cluster's vectors start at different twists and lose what earlier ones of the cluster have.
    """
    n, out, kept = len(b), [], []
    largest = np.sqrt(squares[0])
    edges = [0, *(i + 1 for i in range(n - 1) if abs(c[i]) <= EPS * largest), n]
    # values of each block for themselves, then merged in falling order
    pairs = [(value, lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) for value in dqds(b[lo:hi] ** 2, c[lo : hi - 1] ** 2)]
    for value, lo, hi in sorted(pairs, key=lambda p: -p[0])[:first]:
        near = [z for z, (other, a, _) in zip(out, kept, strict=True) if a == lo and abs(other - value) <= CLUSTER * other]
        _, gamma = twisted(b[lo:hi], c[lo : hi - 1], value)
        best = None
        for twist in np.argsort(gamma, kind="stable")[: len(near) + 4]:
            z = np.zeros(n)
            z[lo:hi] = twisted(b[lo:hi], c[lo : hi - 1], value, int(twist))[0]
            for _ in range(2):
                for other in near:
                    z -= (other @ z) * other
            size = np.linalg.norm(z)
            if best is None or size > best[0]:
                best = size, z / (size or 1.0)
            if size > 0.1:
                break
        out.append(best[1])
        kept.append((value, lo, hi))
    return np.array(out).T


def right_singular(r: np.ndarray, first: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first squares of singular values of r, falling, and their right singular vectors as columns; those of rank only."""
    if not len(r) or not np.abs(r).max():
        return np.zeros(0), np.zeros((len(r), 0))
    scale = np.abs(r).max()
    b, c, v = bidiagonal(r / scale)
    squares = dqds(b**2, c**2)
    least = (EPS * max(rows, len(r)) ** 0.5 * len(r)) ** 2 * squares[0]
    first = min(first, int((squares > least).sum()))
    return squares[:first] * scale**2, v @ right_vectors(b, c, squares, first)
