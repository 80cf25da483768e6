"""Random walks that split sets of points in two, many moves or many sets at a time.

A walk moves one point after the other. Its laws are those of ``splits.bipartition``; what is
done at once never changes them: ``walk`` guesses which of the next moves are accepted, computes
all of them exactly under that guess, and keeps what precedes the first wrong one;
``walk_together`` makes one move in each of many small sets at a time.
"""

from __future__ import annotations

import math
from array import array

import numpy as np

MOVES = 50  # most moves of a random walk for each point
LEAST = 40  # a walk ends after that many rejections in a row, or one for each point
WINDOW, DRIFT = 2_048, 100
CHUNK = 1 << 16


def least_gains(u: np.ndarray, at_zero: float, magnification: float) -> np.ndarray:
    """What a move has to gain to be accepted, for uniform numbers in [0, 1): u <= 1 / (1 + odds exp(-magnification gain)) solved for the gain."""
    with np.errstate(divide="ignore"):
        if at_zero == 1:
            return np.full(u.shape, -np.inf)
        return (math.log((1 - at_zero) / at_zero) - np.log(1 / u - 1)) / magnification


def _guess(places: list[int], picks: list[int], signs: list[int], linear: list[float], least: list[float], roots: array, size: int, n: int, apart: float) -> list[int]:
    """Places of moves that would be accepted if every point changed the distance of the means by its ``linear`` share."""
    taken, turned, root = [], set(), roots[size]
    for place, pick, sign, share, need in zip(places, picks, signs, linear, least, strict=True):
        if pick in turned:
            sign = -sign
        then, far = size + sign, apart + sign * share
        if apart * root + need <= far * roots[then] and 0 < then < n:
            size, apart, root = then, far, roots[then]
            taken.append(place)
            turned ^= {pick}
    return taken


def walk(points: np.ndarray, rng: np.random.Generator, at_zero: float, magnification: float) -> tuple[np.ndarray, float]:
    """Sides and objective of the best split that a walk of one set meets."""
    n = len(points)
    side = rng.random(n) < 0.5
    if side.all() or not side.any():
        side[rng.integers(n)] ^= True
    total, limit = points.sum(0), max(n, LEAST)
    blocks = [slice(i, i + CHUNK) for i in range(0, n, CHUNK)]  # no second copy of the points
    sums, size = sum(points[b][~side[b]].sum(0) for b in blocks), int(n - side.sum())
    roots = array("d", (1 / np.sqrt(1 + np.abs(2.0 * np.arange(n + 1) - n))).tobytes())  # by the first side's size
    scale = np.frombuffer(roots)
    gap = sums / size - (total - sums) / (n - size)
    best = float(np.abs(gap).sum() * scale[size])
    norm = 2.000001 * max(float(np.abs(points[b]).sum(1).max()) for b in blocks)  # twice the greatest of a point, and of a mean

    def apart(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        others = 1 / (n - sizes)
        gaps = first * (1 / sizes + others)[:, None]
        gaps -= others[:, None] * total
        return np.abs(gaps, out=gaps).sum(1)
    kept, rejected, left, at, window = side.copy(), 0, MOVES * limit, 0, min(WINDOW, limit)
    picks = np.empty(0, np.int64)
    while left and rejected < limit:
        if at + window > len(picks):
            more = max(4 * window, min(CHUNK, left))
            picks = np.concatenate([picks[at:], rng.integers(n, size=more)])
            least = np.concatenate([least[at:] if at else picks[:0].astype(float), least_gains(rng.random(more), at_zero, magnification)])
            at = 0
        width = min(window, left)
        pick = picks[at : at + width]
        x, need = points.take(pick, 0), least[at : at + width]
        signs = np.where(side[pick], 1, -1)
        toward, per, aparts = np.sign(gap), 1 / size + 1 / (n - size), float(np.abs(gap).sum())
        linear = (x @ toward) * per - float(toward @ (sums / size**2 + (total - sums) / (n - size) ** 2))
        near = max(0, abs(2 * size - n) - DRIFT)
        hope = 1.2 * aparts * ((1 + near) ** -0.5 - (3 + near) ** -0.5) + float(np.abs(linear).max()) * (1 + near) ** -0.5
        likely = np.flatnonzero(need <= hope)  # nothing is lost by leaving out a move here: all are looked at below
        guessed = _guess(likely.tolist(), pick[likely].tolist(), signs[likely].tolist(), linear[likely].tolist(), need[likely].tolist(), roots, size, n, aparts)
        taken, chosen = np.array(guessed, np.int64), np.zeros(width, bool)
        chosen[taken] = True
        order = pick.argsort(kind="stable")  # a point's next move starts from where its last one left it
        same, by = pick[order], chosen[order].cumsum() - chosen[order]
        opens = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        turns = by - np.repeat(by[opens], np.diff(np.append(opens, width)))
        signs[order[turns % 2 == 1]] *= -1
        # the states between the moves that are taken to be accepted, from which every move is looked at
        states = np.empty((len(taken) + 1, points.shape[1]))
        states[0] = sums
        np.cumsum(x[taken] * signs[taken, None], 0, out=states[1:])
        states[1:] += sums
        sizes = np.full(len(taken) + 1, size)
        sizes[1:] += signs[taken].cumsum()
        distance = apart(states, sizes)
        objective = distance * scale[sizes]
        state = chosen.cumsum() - chosen
        then = sizes[state] + signs
        valid = (then > 0) & (then < n)
        then[~valid] = 1
        most = (distance[state] + norm * (1 / then + 1 / (n - then))) * scale[then] - objective[state]  # no move gains more
        doubt = np.flatnonzero(valid & ~chosen & (most >= need))
        moved = states[state[doubt]] + x[doubt] * signs[doubt, None]
        reached = apart(moved, then[doubt]) * scale[then[doubt]]
        used, extra = width, None
        if len(missed := np.flatnonzero(objective[1:] - objective[:-1] < need[taken])):
            used = int(taken[missed[0]]) + 1
            taken = taken[: missed[0]]
        if len(missed := np.flatnonzero(reached - objective[state[doubt]] >= need[doubt])) and doubt[missed[0]] < used:
            extra = missed[0]
            used = int(doubt[extra]) + 1
            taken = taken[: state[used - 1]]
        window = min(limit, WINDOW, max(16, used + used // 2)) if used < width else min(limit, WINDOW, 2 * window)
        at, left = at + used, left - used
        ends, gains = taken, objective[1 : len(taken) + 1]
        if extra is not None:
            ends, gains = np.append(ends, used - 1), np.append(gains, reached[extra])
        if not len(ends):
            rejected += used
            continue
        if rejected + ends[0] >= limit:
            break
        rejected = used - 1 - int(ends[-1])
        top = int(gains.argmax())
        if gains[top] > best:
            best = float(gains[top])
            kept[:] = side
            np.logical_xor.at(kept, pick[ends[: top + 1]], True)
        np.logical_xor.at(side, pick[ends], True)
        sums = states[len(taken)].copy() if extra is None else moved[extra].copy()
        size += int(signs[ends].sum())
        gap = sums / size - (total - sums) / (n - size)
    return kept, best


def mixed(z: np.ndarray) -> np.ndarray:
    """Random 64-bit numbers out of different ones (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def walk_together(points: np.ndarray, counts: np.ndarray, keys: np.ndarray, at_zero: float, magnification: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides of all points and objectives of the sets, whose points follow each other; random numbers of a set come from its key only."""
    starts, half, low = counts.cumsum() - counts, np.uint64(32), np.uint64((1 << 32) - 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(points)) - starts[owner]
    step = np.uint64(0x9E3779B97F4A7C15)

    def drawn(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mixed(keys[sets] + at.astype(np.uint64) * step)

    side = np.zeros((len(counts), counts.max()), bool)
    side[owner, inner] = drawn(owner, -1 - inner) >> np.uint64(63)
    size = counts - side.sum(1)
    bare = np.flatnonzero((size == 0) | (size == counts))
    turned = ((drawn(bare, np.zeros(len(bare), int)) >> half) * counts[bare].astype(np.uint64) >> half).astype(int)
    side[bare, turned] ^= True
    size = counts - side.sum(1)
    total = np.add.reduceat(points, starts)
    sums = np.add.reduceat(points * ~side[owner, inner][:, None], starts)

    def objectives(first: np.ndarray, sizes: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
        others = 1 / (n - sizes)
        gaps = first * (1 / sizes + others)[:, None]
        gaps -= others[:, None] * whole
        return np.abs(gaps, out=gaps).sum(1) / np.sqrt(1 + np.abs(2 * sizes - n))

    now = objectives(sums, size, counts, total)
    best, kept, made = now.copy(), side.copy(), 0
    live = np.flatnonzero(counts > 2)  # two points have no move
    limit = np.maximum(counts, LEAST)
    state = [x[live] for x in (counts, starts, total, limit, MOVES * limit, sums, size, now, side, np.zeros(len(counts), int))]
    while len(live):
        n, start, whole, most, end, sums, size, now, side, rejected = state
        ahead = min(64, max(1, CHUNK // len(live)))
        z = mixed(keys[live] + (made + 1 + np.arange(ahead))[:, None].astype(np.uint64) * step)
        picks = ((z >> half) * n.astype(np.uint64) >> half).astype(int)
        least = least_gains(((z & low) + 0.5) / 2.0**32, at_zero, magnification)
        rows, ended = np.arange(len(live)), 0
        for pick, need in zip(picks, least, strict=True):
            made += 1
            sign = np.where(side[rows, pick], 1, -1)
            then = (size + sign).clip(1, n - 1)
            moved = points.take(start + pick, 0)
            moved *= sign[:, None]
            moved += sums
            reached = objectives(moved, then, n, whole)
            rejected += 1
            taken = np.flatnonzero((reached - now >= need) & (then != size))
            if len(taken):
                sums[taken], size[taken], now[taken], rejected[taken] = moved[taken], then[taken], reached[taken], 0
                side[taken, pick[taken]] ^= True
                better = taken[reached[taken] > best[live[taken]]]
                best[live[better]], kept[live[better]] = reached[better], side[better]
            over = (rejected >= most) | (end <= made)
            if (count := np.count_nonzero(over)) > ended:  # those that have ended stay where they are
                ended, least[:, over] = count, np.inf
                if 8 * ended > len(live):
                    break
        if ended:
            live, state = live[~over], [x[~over] for x in state]
    return kept[owner, inner], best
