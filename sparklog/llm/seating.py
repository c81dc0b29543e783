"""Gibbs seating in the restaurants of a Pitman-Yor hierarchy.

A seating holds for each dish its customers c, its tables t and, where c is over EXACT, the
tables' sizes. A sweep visits every customer. All customers of a dish with EXACT customers at
most leave together and their number of tables is drawn from its exact conditional
distribution (generalised Stirling numbers); the sizes of such a dish's tables matter to
nothing else. Of a dish with more customers a random BATCHES-th leaves at a time and is seated
anew given the others. Half of the dishes go first, then the other half, so that no restaurant
changes all at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shared import memo

EXACT, BATCHES, STRENGTH = 48, 16, 1.0


@dataclass
class Seating:
    c: np.ndarray
    t: np.ndarray
    sizes: np.ndarray  # of the tables of dishes with c > EXACT, dish after dish

    @staticmethod
    def first(c: np.ndarray) -> "Seating":
        """One table for each dish that has customers."""
        return Seating(c, (c > 0).astype(np.int64), c[c > EXACT])


def log_stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers of c customers and t tables, at [c, t]."""
    kept, key = memo("hpyp"), ("stirling", d)
    if key not in kept:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        for c in range(1, EXACT):
            with np.errstate(invalid="ignore"):
                out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - d * t, 1e-300)) + out[c, 1:])
        kept[key] = out
    return kept[key]


def _few(c, others, logp, d, rng) -> np.ndarray:
    """Tables of dishes with 2 to EXACT customers. others: STRENGTH / d + tables of the
    restaurant's other dishes; logp: log of the parent's probability."""
    table, t = log_stirling(d), np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
        if not len(rows):
            continue
        k = int(c[rows[0]])
        step = np.arange(k)
        w = table[k, 1 : k + 1] + (logp[rows, None] + np.log(d)) * (step + 1) + np.cumsum(np.log(others[rows, None] + step), axis=1)
        cdf = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
        t[rows] = 1 + (cdf[:, :-1] < rng.random((len(rows), 1)) * cdf[:, -1:]).sum(1)
    return t


def _deal(guests: np.ndarray, weight: np.ndarray, owner: np.ndarray, rng, leave: bool = False) -> np.ndarray:
    """So many guests of each dish, by table: each takes one in proportion to its weight;
    leave: guests leave tables whose sizes are the weights. Halves of the tables are dealt to
    first, then halves of these: the work is one of tables, not of guests."""
    upto = np.concatenate([[0], np.cumsum(weight)])
    lo, hi = np.searchsorted(owner, np.arange(len(guests)), "left"), np.searchsorted(owner, np.arange(len(guests)), "right")
    out, n = np.zeros(len(weight), np.int64), guests
    while True:
        some = n > 0
        lo, hi, n = lo[some], hi[some], n[some]
        one = hi - lo <= 1
        out[lo[one]] += n[one]
        lo, hi, n = lo[~one], hi[~one], n[~one]
        if not len(n):
            return out
        mid = (lo + hi) // 2
        left, right = upto[mid] - upto[lo], upto[hi] - upto[mid]
        if leave:
            first = rng.hypergeometric(left, right, n)
        else:
            first = rng.binomial(n, np.clip(left / np.maximum(left + right, 1e-300), 0, 1))
        lo, hi, n = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([first, n - first])


def _many(c, sizes, owner, others, logp, d, rng) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, owner) of the tables of dishes with many customers, after all have moved."""
    n = len(c)
    more = c - np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
    if (more < 0).any():  # some customers are gone: random ones
        sizes = sizes - _deal(np.maximum(-more, 0), sizes, owner, rng, leave=True)
    p, moved, still = np.exp(logp), np.zeros(len(sizes), np.int64), sizes.copy()
    for batch in range(BATCHES):
        leave = rng.binomial(still, 1 / (BATCHES - batch))
        still -= leave
        guests = np.bincount(owner, weights=leave, minlength=n).astype(np.int64)
        if not batch:
            guests += np.maximum(more, 0)
        now = still + moved
        weight = np.where(now > 0, now - d, 0.0)
        old = np.bincount(owner, weights=weight, minlength=n)
        fresh = d * (others + np.bincount(owner, weights=now > 0, minlength=n)) * p
        new = rng.binomial(guests, fresh / (fresh + old))
        moved += _deal(guests - new, weight, owner, rng)
        extra = np.repeat(np.arange(n), new)
        owner = np.concatenate([owner, extra])
        still, moved = np.concatenate([still, np.zeros(len(extra), np.int64)]), np.concatenate([moved, np.ones(len(extra), np.int64)])
        keep = np.argsort(owner, kind="stable")
        keep = keep[(still + moved)[keep] > 0]
        owner, still, moved = owner[keep], still[keep], moved[keep]
    return still + moved, owner


def sweep(old: Seating, c: np.ndarray, logp: np.ndarray, group: np.ndarray, d: float, rng, more: np.ndarray) -> Seating:
    """The seating after a Gibbs sweep. c: the dishes' customers now; logp: log of the parent's
    probability of each; group: each dish's restaurant, numbered from 0; more: the tables of
    each restaurant's dishes that are not given here."""
    t = np.where(c > 0, np.clip(old.t, 1, np.maximum(c, 1)), 0)
    was_big, big = old.c > EXACT, c > EXACT
    # Sizes of dishes that have many customers now; of one that had few: all but one table of one.
    sizes = {}
    parts = np.split(old.sizes, np.cumsum(old.t[was_big])[:-1]) if was_big.any() else []
    for i, s in zip(np.flatnonzero(was_big).tolist(), parts):
        sizes[i] = s
    bigs = np.flatnonzero(big)
    for i in bigs.tolist():
        if i not in sizes:
            sizes[i] = np.concatenate([[c[i] - t[i] + 1], np.ones(t[i] - 1, np.int64)]).astype(np.int64)
    for half in (0, 1):
        mine = np.arange(len(c)) % 2 == half
        tables = (more + np.bincount(group, weights=t, minlength=len(more)))[group]
        others = STRENGTH / d + np.maximum(tables - t, 0)
        few = np.flatnonzero(mine & (c > 1) & ~big)
        t[few] = _few(c[few], others[few], logp[few], d, rng)
        many = np.flatnonzero(mine & big)
        if len(many):
            flat = np.concatenate([sizes[i] for i in many.tolist()])
            owner = np.repeat(np.arange(len(many)), [len(sizes[i]) for i in many.tolist()])
            flat, owner = _many(c[many], flat, owner, others[many], logp[many], d, rng)
            t[many] = np.bincount(owner, minlength=len(many))
            for i, s in zip(many.tolist(), np.split(flat, np.cumsum(t[many])[:-1])):
                sizes[i] = s
    return Seating(c, t, np.concatenate([np.zeros(0, np.int64), *[sizes[i] for i in bigs.tolist()]]))


def discount(once: int, twice: int) -> float:
    """From the dishes with one customer and with two."""
    return float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95))
