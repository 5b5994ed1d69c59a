"""Leading eigenpairs of a symmetric matrix that is only known by its products, by Jacobi-Davidson.

Rayleigh-Ritz on a growing subspace gives the pairs found so far. For each pair that is not settled a correction is sought
orthogonal to all pairs, by a few steps of MINRES on the shifted and projected matrix; corrections of all pairs share each
product. Settled pairs are locked and kept out of the subspace.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Pairs followed beyond the wanted ones, so that neighbours of the last one do not slow it down.
GUARD = 6
#: Vectors of the subspace before it is cut back to the pairs followed, as a multiple of them.
GROWTH = 9
INNER_STEPS = 4
INNER_GAIN = 1e-2
#: A residual this small against the largest value counts as settled once it no longer falls: rounding of the products is reached.
ROUNDING = 1e-11
STALLED = 3
OUTER_STEPS = 500

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Pairs:
    """Values, falling; unit vectors as columns; norms of the residuals; products of the matrix with a block of vectors."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def _new_directions(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what `found` adds to the orthonormal `known`."""
    kept = known
    for column in found.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):  # twice is enough, once more costs nothing
            column = column - kept @ (kept.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-8:
                break
            column = column / left
        else:
            kept = np.column_stack([kept, column])
    return kept[:, known.shape[1]:]


def minres(apply: Callable[[np.ndarray, np.ndarray], np.ndarray], b: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column of `b`; `apply(v, columns)` multiplies for those columns.

    A column is done when its residual fell to `gain` of what it was, or after `steps` products.
    """
    x = np.zeros_like(b)
    first = np.linalg.norm(b, axis=0)
    state = {name: np.zeros(b.shape[1]) for name in ("old_beta", "dbar", "epsilon", "sine")}
    cosine, phibar, beta = -np.ones(b.shape[1]), first.copy(), first.copy()
    r1, r2, y = b.copy(), b.copy(), b.copy()
    w, w2 = np.zeros_like(b), np.zeros_like(b)
    on = np.flatnonzero(first > 0)
    for step in range(steps):
        if not len(on):
            break
        v = y[:, on] / beta[on]
        z = apply(v, on)
        if step:
            z = z - (beta[on] / state["old_beta"][on]) * r1[:, on]
        alpha = (v * z).sum(axis=0)
        z = z - (alpha / beta[on]) * r2[:, on]
        r1[:, on], r2[:, on], y[:, on] = r2[:, on], z, z
        state["old_beta"][on], beta[on] = beta[on], np.linalg.norm(z, axis=0)
        old_epsilon = state["epsilon"][on]
        delta = cosine[on] * state["dbar"][on] + state["sine"][on] * alpha
        gbar = state["sine"][on] * state["dbar"][on] - cosine[on] * alpha
        state["epsilon"][on] = state["sine"][on] * beta[on]
        state["dbar"][on] = -cosine[on] * beta[on]
        gamma = np.maximum(np.hypot(gbar, beta[on]), EPS * first[on] + np.finfo(np.float64).tiny)
        cosine[on], state["sine"][on] = gbar / gamma, beta[on] / gamma
        phi, phibar[on] = cosine[on] * phibar[on], state["sine"][on] * phibar[on]
        w1, w2[:, on] = w2[:, on].copy(), w[:, on]
        w[:, on] = (v - old_epsilon * w1 - delta * w2[:, on]) / gamma
        x[:, on] += phi * w[:, on]
        on = on[(phibar[on] > gain * first[on]) & (beta[on] > EPS * first[on])]
    return x


def leading_pairs(product: Product, dim: int, wanted: int, seed: int = 0) -> Pairs:
    """The `wanted` (at most `dim`) pairs of largest value. Vectors live with the caller: `dim` is a row's width, not a table's length."""
    wanted = min(wanted, dim)
    followed = min(dim, wanted + GUARD)
    most = min(dim, GROWTH * followed)
    calls = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(block)

    rng = np.random.default_rng(seed)
    locked, locked_values = np.empty((dim, 0)), []
    basis = _new_directions(rng.normal(size=(dim, followed)), locked)
    image = times(basis)
    best, waited = np.inf, 0
    for _ in range(OUTER_STEPS):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        residual = ritz_image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        scale = max([abs(t) for t in (*locked_values, theta[0])])
        whole = locked.shape[1] + basis.shape[1] == dim
        waited = 0 if norms[0] < best / 2 else waited + 1
        best = min(best, norms[0])
        settled = 0
        while settled < len(theta) and len(locked_values) + settled < wanted and (
                whole or norms[settled] <= 4 * EPS * np.sqrt(dim) * scale or (settled == 0 and waited >= STALLED and norms[0] <= ROUNDING * scale)):
            settled += 1
        if settled:
            locked = np.column_stack([locked, ritz[:, :settled]])
            locked_values += list(theta[:settled])
            ritz, ritz_image, residual, theta = ritz[:, settled:], ritz_image[:, settled:], residual[:, settled:], theta[settled:]
            best, waited = np.inf, 0
        if len(locked_values) == wanted:
            break
        if ritz.shape[1] + wanted > most and ritz.shape[1] > followed:
            ritz, ritz_image = ritz[:, :followed], ritz_image[:, :followed]
        basis, image = ritz, ritz_image
        active = min(followed, basis.shape[1])  # a product of more vectors costs no more passes
        pairs = np.column_stack([locked, basis[:, :active]])
        shift = theta[:active]

        def projected(v: np.ndarray, columns: np.ndarray) -> np.ndarray:
            z = times(v) - v * shift[columns]
            return z - pairs @ (pairs.T @ z)

        start = residual[:, :active]
        correction = minres(projected, -(start - pairs @ (pairs.T @ start)), INNER_STEPS, INNER_GAIN)
        known = np.column_stack([locked, basis])
        fresh = _new_directions(correction, known)
        if not fresh.shape[1] and known.shape[1] < dim:
            fresh = _new_directions(rng.normal(size=(dim, 2)), known)
        if fresh.shape[1]:
            basis, image = np.column_stack([basis, fresh]), np.column_stack([image, times(fresh)])
    else:
        raise ValueError(f"no {wanted} settled pairs after {OUTER_STEPS} steps")
    vectors, _ = np.linalg.qr(locked)
    image = times(vectors)
    h = vectors.T @ image
    values, y = np.linalg.eigh((h + h.T) / 2)
    values, y = values[::-1], y[:, ::-1]
    vectors = vectors @ y
    return Pairs(values, vectors, np.linalg.norm(image @ y - vectors * values, axis=0), calls)
