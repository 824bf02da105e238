"""A grouping genetic algorithm for bin packing, on numpy arrays.

An individual is a packing: ``bin_of`` (the bin of every item) and ``fills``
(the load of every bin).  Items are given in descending order of size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

Packing = tuple[np.ndarray, np.ndarray]


def best_fit(items: Iterable[int], sizes: np.ndarray, bin_of: np.ndarray, fills: list[int], capacity: int) -> None:
    """Put ``items``, in this order, each into the fullest bin that still takes
    it, or into a new one.  Bins are found by their free space: one list of bins
    per space, and a bit mask of the spaces that occur."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, load in enumerate(fills):
        if load < capacity:
            free[capacity - load].append(b)
            mask |= 1 << (capacity - load)
    for i in items:
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
            fills[b] += size
        else:
            b, space = len(fills), capacity
            fills.append(size)
        bin_of[i] = b
        if space > size:
            free[space - size].append(b)
            mask |= 1 << (space - size)


def packed_in_order(order: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
    bin_of, fills = np.empty(len(sizes), np.int32), []
    best_fit(order.tolist(), sizes, bin_of, fills, capacity)
    return bin_of, np.array(fills, np.int64)


def repacked(bin_of: np.ndarray, fills: np.ndarray, gone: np.ndarray, sizes: np.ndarray, capacity: int,
             rng: np.random.Generator | None = None) -> Packing:
    """Remove the bins marked in ``gone``; their items are displaced and put back
    by best fit, largest first or, with ``rng``, in a blurred order."""
    stays = ~gone
    number = np.cumsum(stays, dtype=np.int64) - 1
    kept = stays[bin_of]
    out = np.where(kept, number[bin_of], -1).astype(np.int32)
    loads, displaced = fills[stays].tolist(), np.flatnonzero(~kept)
    if rng is not None:
        displaced = displaced[np.argsort(-sizes[displaced] * rng.uniform(0.5, 1, len(displaced)), kind="stable")]
    best_fit(displaced.tolist(), sizes, out, loads, capacity)
    return out, np.array(loads, np.int64)


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of ``b`` are injected into ``a``.  Bins of ``a``
    that hold an injected item go (no item may be there twice); their other items
    are displaced."""
    fullest = np.argsort(-b[1], kind="stable")[:max(1, len(b[1]) // 2)]
    injected = np.zeros(len(b[1]), bool)
    injected[rng.choice(fullest, int(rng.integers(1, len(fullest) + 1)), replace=False)] = True
    from_b = injected[b[0]]
    gone = np.zeros(len(a[1]) + len(b[1]), bool)
    gone[a[0][from_b]] = True
    gone[len(a[1]):] = ~injected
    both = np.where(from_b, b[0] + len(a[1]), a[0])
    return repacked(both, np.concatenate([a[1], b[1]]), gone, sizes, capacity)


def mutation(a: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest bin and a few others are taken apart."""
    gone = np.zeros(len(a[1]), bool)
    gone[rng.integers(0, len(gone), 1 + len(gone) // 20)] = True
    gone[np.argmin(a[1])] = True
    return repacked(a[0], a[1], gone, sizes, capacity, rng)


def fitness(p: Packing) -> tuple[int, int]:
    """Fewer bins first, then uneven loads: nearly empty bins are soon emptied."""
    return -len(p[1]), int((p[1] * p[1]).sum())


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the tokens need them, and so do the items
    larger than half a bin, of which no two share one."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def evolve(sizes: np.ndarray, capacity: int, seed: list[int], immigrants: list[Packing], population: int,
           generations: int, elites: int) -> list[Packing]:
    """The best ``elites`` packings after ``generations`` children, best first.
    The first population is best fit over the descending sizes, blurred a little
    more for each individual, next to the immigrants.  Ends where a packing has
    the fewest bins possible."""
    rng = np.random.default_rng(seed)
    least = fewest(sizes, capacity)
    people = list(immigrants)
    if not people:
        people.append(packed_in_order(np.arange(len(sizes)), sizes, capacity))
    while len(people) < population and -fitness(people[0])[0] > least:
        blurred = sizes * (1 + 0.05 * len(people) * rng.standard_normal(len(sizes)))
        people.append(packed_in_order(np.argsort(-blurred, kind="stable"), sizes, capacity))
    people.sort(key=fitness, reverse=True)
    for _ in range(generations):
        if len(people[0][1]) == least or len(people) < 2:
            break
        i, j = np.sort(rng.choice(len(people), 2, replace=False))
        child = crossover(people[i], people[j], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutation(child, sizes, capacity, rng)
        if fitness(child) not in map(fitness, people):     # a new one takes the place of the worst, never of the best
            people[max(1, len(people) - 1)] = child
            people.sort(key=fitness, reverse=True)
    return people[:elites]
