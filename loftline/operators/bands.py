"""Least squares and annealing of many small pose graphs together, in one task.

Graphs (parts) lie side by side on a grid: places along one axis, parts along the last one, which all arithmetic runs over. Edges lie in
slots: those of a slot link nodes that are equally far apart, so a slot's ends are two slices of the grid and nothing is gathered or scattered.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

#: Nodes of a grid, how far apart linked nodes may stand on it, and how many edges may lie side by side.
GRID, BAND, BESIDE = 32768, 12, 4
#: Steps of a solution, and trials of a step.
ROUNDS, TRIALS = 20, 8


def near(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of n nodes such that linked ones stand near each other: breadth first from a node at the rim, few links first."""
    links: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        links[a].add(b)
        links[b].add(a)
    place, taken = np.full(n, -1), 0

    def walk(first: int) -> list[int]:
        seen, row, queue = {first}, [], deque([first])
        while queue:
            row.append(queue.popleft())
            ahead = sorted(links[row[-1]] - seen, key=lambda x: (len(links[x]), x))
            seen.update(ahead)
            queue.extend(ahead)
        return row

    for first in sorted(range(n), key=lambda x: (len(links[x]), x)):
        if place[first] < 0:
            row = walk(walk(first)[-1])
            place[row] = np.arange(taken, taken + len(row))
            taken += len(row)
    return place


def anneal_parts(
    part: np.ndarray, pose: np.ndarray, start: np.ndarray, anchored: np.ndarray, of: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray,
    weight: np.ndarray, spatial: np.ndarray, bounds: list[float | None], cx: float, sign: float, robust: float | None, alone: Callable, most: int, count: int, anchor_weight: float = 100.0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Poses of all nodes, cost of each part, factor and residual by unit of weight of each edge, and which parts are left, after a solution for each of `bounds`.

    Before a solution spatial edges are weighed by s^2 / (s^2 + r^2), where s is its bound and r the residual by unit of weight at the poses so far; None weighs
    nothing. Each part takes its own steps with its own damping. Nodes come by part; edges (part `of`) have the numbers of their nodes.
    A part that fits no grid is left if it has more than `most` nodes, else `alone` solves it: (poses, START, anchors, numbers of the ends of its edges,
    steps, weights) to its poses and cost.
    """
    size = np.bincount(part, minlength=count)
    first = np.cumsum(size) - size
    place = np.arange(len(part)) - first[part]
    by_part = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=count))
    mine = lambda p: by_part[ends[p - 1] if p else 0 : ends[p]]
    apart = np.zeros(count, int)
    np.maximum.at(apart, of, np.abs(place[i] - place[j]))
    for p in np.flatnonzero(apart > BAND):
        link = mine(p)
        better = near(size[p], i[link] - first[p], j[link] - first[p])
        place[first[p] : first[p] + size[p]] = better
        apart[p] = np.abs(better[i[link] - first[p]] - better[j[link] - first[p]]).max()
    # Edges between the same nodes, the same way, lie in slots of their own.
    low, far, ahead = np.minimum(place[i], place[j]), np.abs(place[i] - place[j]), place[i] < place[j]
    turn = np.lexsort((ahead, far, low, of))
    same = np.zeros(len(of), bool)
    same[1:] = np.all([x[turn][1:] == x[turn][:-1] for x in (of, low, far, ahead)], 0)
    at = np.arange(len(of))
    beside = np.zeros(len(of), int)
    beside[turn] = at - np.maximum.accumulate(np.where(same, 0, at))
    odd = apart > BAND
    odd[of[(far == 0) | (beside >= BESIDE)]] = True
    pose, cost = pose.copy(), np.zeros(count)
    factor, off = np.ones(len(of)), np.full(len(of), np.nan)
    order = np.flatnonzero(~odd & (size > 0))
    order = order[np.argsort(size[order], kind="stable")]
    while len(order):
        # Parts of about one size go together, so that little is padded; the largest come first.
        some, order = (x[::-1] for x in np.split(order[::-1], [max(1, GRID // int(size[order[-1]]))]))
        here = np.full(count, -1)
        here[some] = np.arange(len(some))
        node, link = np.flatnonzero(here[part] >= 0), np.flatnonzero(here[of] >= 0)
        grid = _Grid(int(size[some].max()), len(some), cx, sign, robust, anchor_weight)
        grid.put_nodes(place[node], here[part[node]], pose[node], start[node], anchored[node])
        grid.put_edges(low[link], far[link], ahead[link], beside[link], here[of[link]], step[link], weight[link], spatial[link])
        grid.run(bounds)
        pose[node], cost[some] = grid.pose[:, place[node], here[part[node]]].T, grid.cost
        for which, where, slot in grid.lies:
            factor[link[which]], off[link[which]] = slot.factor[where], np.sqrt(slot.off[where])
    left = odd & (size > most)
    for p in np.flatnonzero(odd & ~left):
        node, link = slice(first[p], first[p] + size[p]), mine(p)
        ends_of = i[link], j[link], step[link]
        for bound in bounds:
            if bound is not None:
                factor[link] = _weighed(bound, spatial[link], weight[link], factor[link], _squares(pose, *ends_of, cx, sign))
            pose[node], cost[p] = alone(pose[node], start[node], anchored[node], i[link] - first[p], j[link] - first[p], step[link], weight[link] * factor[link])
        off[link] = np.sqrt(_squares(pose, *ends_of, cx, sign))
    return pose, cost, factor, off, left


def _weighed(bound: float, spatial: np.ndarray, weight: np.ndarray, factor: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Factors by squared residuals; edges that are not spatial, have no weight left or no residual keep theirs."""
    with np.errstate(all="ignore"):
        new = np.where(off > 0, bound**2 / (bound**2 + off), 1.0)
        return np.where(spatial & (weight * factor > 1e-12) & ~np.isnan(off), new, factor)


def _squares(pose: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray, cx: float, sign: float) -> np.ndarray:
    rows, _ = _rows(pose[i].T, pose[j].T, _turned(pose[i].T, sign), step.T, cx, sign)
    return sum(r * r for r in rows)


def _turned(x: np.ndarray, sign: float) -> tuple[np.ndarray, ...]:
    ux, uy = np.exp(-x[2]), np.exp(-x[3])
    return ux, uy, ux / uy, np.cos(x[4]), sign * np.sin(x[4])


def _rows(a, b, turned, e, cx: float, sign: float) -> tuple[tuple, tuple]:
    """Residuals of steps e from poses a to b by unit of weight, and parts of their slopes."""
    ux, uy, ratio, c, s = turned
    gx, gy = (b[0] - a[0]) * ux, (b[1] - a[1]) * uy
    across, down = s * ratio * e[1], (-sign * s) / ratio * e[0]
    turn = b[4] - a[4] - sign * e[4]
    turn -= 2 * math.pi * np.rint(turn / (2 * math.pi))
    rows = gx - c * e[0] + across, gy + down - sign * c * e[1], (b[2] - a[2] - e[2]) * cx, (b[3] - a[3] - e[3]) * cx, turn * cx
    return rows, (gx, gy, across, down)


class _Slot:
    """Edges between places that are `far` apart: step (5, places, parts), weight, spatial, factor and squared residual (places, parts)."""

    def __init__(self, n: int, parts: int, far: int, ahead: bool):
        self.far, self.ahead = far, ahead
        self.step, self.weight = np.zeros((5, n - far, parts)), np.zeros((n - far, parts))
        self.spatial, self.factor, self.off = np.zeros((n - far, parts), bool), np.ones((n - far, parts)), np.zeros((n - far, parts))

    def ends(self, n: int) -> tuple[slice, slice]:
        low, high = slice(0, n - self.far), slice(self.far, n)
        return (low, high) if self.ahead else (high, low)

    def of(self, parts: np.ndarray) -> _Slot:
        """The edges of some parts; factors and residuals are copies."""
        out = object.__new__(_Slot)
        out.far, out.ahead = self.far, self.ahead
        for name in ("step", "weight", "spatial", "factor", "off"):
            setattr(out, name, np.ascontiguousarray(getattr(self, name)[..., parts]))
        return out


class _Grid:
    def __init__(self, n: int, parts: int, cx: float, sign: float, robust: float | None, anchor_weight: float):
        self.n, self.parts, self.cx, self.sign, self.robust = n, parts, cx, sign, robust
        self.pull = (np.array([1.0, 1.0, cx, cx, cx]) * anchor_weight) ** 2
        self.pose, self.start = np.zeros((5, n, parts)), np.zeros((5, n, parts))
        self.anchored, self.empty = np.zeros((n, parts)), np.ones((n, parts))
        self.cost, self.damp, self.slots, self.lies, self.rooms = np.zeros(parts), np.full(parts, 1e-3), [], [], {}

    def _room(self, name, *shape: int) -> np.ndarray:
        """An array with anything in it; one of a name is used again and again, as fresh memory costs more than what is done in it."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size)
        return self.rooms[name][:size].reshape(shape)

    def put_nodes(self, place, part, pose, start, anchored) -> None:
        self.pose[:, place, part], self.start[:, place, part] = pose.T, start.T
        self.anchored[place, part], self.empty[place, part] = anchored, 0.0

    def put_edges(self, low, far, ahead, beside, part, step, weight, spatial) -> None:
        kind = (far * 2 + ahead) * BESIDE + beside
        for k in np.unique(kind):
            which = np.flatnonzero(kind == k)
            slot, where = _Slot(self.n, self.parts, int(far[which[0]]), bool(ahead[which[0]])), (low[which], part[which])
            slot.step[:, *where], slot.weight[where], slot.spatial[where] = step[which].T, weight[which], spatial[which]
            self.slots.append(slot)
            self.lies.append((which, where, slot))

    def run(self, bounds: list[float | None]) -> None:
        with np.errstate(all="ignore"):
            self._squares(self.pose, self.slots)
            for bound in bounds:
                for s in self.slots if bound is not None else ():
                    s.factor = _weighed(bound, s.spatial, s.weight, s.factor, s.off)
                self._solve()

    def _solve(self) -> None:
        """Damped least squares of all parts. A factorization serves further steps of a part as long as each gains a tenth of the one before at most."""
        on, steps, tries = np.arange(self.parts), np.zeros(self.parts, int), np.zeros(self.parts, int)
        self.damp = np.minimum(self.damp, 1e-3)
        while len(on):
            every = len(on) == self.parts
            some = (lambda v: v) if every else (lambda v: np.ascontiguousarray(v[..., on]))
            x, start, anchored, empty = some(self.pose), some(self.start), some(self.anchored), some(self.empty)
            slots = self.slots if every else [s.of(on) for s in self.slots]
            blocks, links, right, weights, before = self._system(x, start, anchored, slots, empty)
            for k in range(5):
                blocks[:, k, k] += self.damp[on] * (blocks[:, k, k] + 1e-9)
            rows = _factors(blocks, links, self._room)
            live, first, over, gain = np.ones(len(on), bool), True, np.zeros(len(on), bool), None
            while first or live.sum() * 4 > len(on):
                if not first:
                    _, _, right, _, before = self._system(x, start, anchored, slots, None)
                trial = x - _solved(rows, right, max(links, default=0), self._room).transpose(1, 0, 2)
                held = [s.off for s in slots]
                self._squares(trial, slots)
                after = self._cost(trial, start, anchored, slots, weights)
                good = live & (after <= before)
                x = np.where(good, trial, x)
                for s, was in zip(slots, held, strict=True):
                    s.off = np.where(good, s.off, was)
                self.cost[on] = np.where(live, np.where(good, after, before), self.cost[on])
                self.damp[on] = np.where(good, self.damp[on] / 3, self.damp[on])
                last, gain = gain, before - after
                ends = good & (gain < 1e-9 * (1 + before))
                if first:
                    self.damp[on], tries[on], steps[on] = np.where(good, self.damp[on], self.damp[on] * 4), np.where(good, 0, tries[on] + 1), steps[on] + good
                    ends |= np.where(good, steps[on] >= ROUNDS, tries[on] >= TRIALS)
                    live = good & ~ends & (not self.robust)
                else:
                    ends |= live & (np.abs(gain) <= 1e-12 * (1 + before))
                    live = good & ~ends & (gain <= 0.1 * last)
                over, first = over | ends, False
            self.pose[:, :, on] = x
            for whole, s in zip(self.slots, slots, strict=True):
                whole.off[:, on] = s.off
            on = on[~over]

    def _squares(self, x: np.ndarray, slots: list[_Slot]) -> None:
        turned = _turned(x, self.sign)
        for s in slots:
            u, v = s.ends(self.n)
            rows, _ = _rows(x[:, u], x[:, v], [t[u] for t in turned], s.step, self.cx, self.sign)
            s.off = sum(r * r for r in rows)

    def _cost(self, x, start, anchored, slots, weights) -> np.ndarray:
        drawn = sum(p * ((a - b) ** 2 * anchored).sum(0) for p, a, b in zip(self.pull, x, start, strict=True))
        return sum(((s.off * w * w).sum(0) for s, w in zip(slots, weights, strict=True)), drawn)

    def _system(self, x, start, anchored, slots, empty) -> tuple:
        """Blocks (places, 5, 5, parts) on the diagonal, those of linked places by how far these are apart, right sides, weights, cost; no blocks without `empty`."""
        n, parts, cx, sign = self.n, x.shape[2], self.cx, self.sign
        right = self._room("right", n, 5, parts)
        right[:], blocks, links = 0.0, None, {}
        if empty is not None:
            blocks = self._room("blocks", n, 5, 5, parts)
            links = {far: self._room(far, n - far, 5, 5, parts) for far in {s.far for s in slots}}
            for held in (blocks, *links.values()):
                held[:] = 0.0
        turned, weights = _turned(x, sign), []
        for s in slots:
            u, v = s.ends(n)
            ux, uy, ratio, c, t = (h[u] for h in turned)
            (r0, r1, *others), (gx, gy, across, down) = _rows(x[:, u], x[:, v], (ux, uy, ratio, c, t), s.step, cx, sign)
            w = s.weight * s.factor
            if self.robust:
                w = w * (self.robust**2 / (self.robust**2 + s.off))
            weights.append(w)
            w2, e = w * w, s.step
            # Slopes of the first two rows by the scales and the angle of the start.
            a = -gx - across, across, sign * (t * e[0] + c * ratio * e[1])
            b = down, -gy - down, t * e[1] - c / ratio * e[0]
            w0, w1 = w2 * r0, w2 * r1
            for k, drawn in enumerate((w0 * ux, w1 * uy)):
                right[u, k] -= drawn
                right[v, k] += drawn
            for k in range(3):
                drawn = w2 * others[k] * cx
                right[u, k + 2] += w0 * a[k] + w1 * b[k] - drawn
                right[v, k + 2] += drawn
            if empty is None:
                continue
            to, wc = links[s.far], w2 * (cx * cx)
            # The end has the start's blocks of x and y alone; but for the sign, these and the crossed ones are those of the link.
            for k, unit, slopes in ((0, ux, a), (1, uy, b)):
                by = w2 * unit
                own = by * unit
                blocks[u, k, k] += own
                blocks[v, k, k] += own
                to[:, k, k] -= own
                for m in range(3):
                    cross = by * slopes[m]
                    blocks[u, k, m + 2] -= cross
                    if s.ahead:
                        to[:, m + 2, k] += cross
                    else:
                        to[:, k, m + 2] += cross
            for k in range(3):
                wa, wb = w2 * a[k], w2 * b[k]
                for m in range(k, 3):
                    blocks[u, k + 2, m + 2] += wa * a[m] + wb * b[m]
                blocks[u, k + 2, k + 2] += wc
                blocks[v, k + 2, k + 2] += wc
                to[:, k + 2, k + 2] -= wc
        cost = self._cost(x, start, anchored, slots, weights)
        for k in range(5):
            right[:, k] += self.pull[k] * anchored * (x[k] - start[k])
            if empty is not None:
                blocks[:, k, k] += self.pull[k] * anchored + empty  # behind the last node of a shorter part the system is that of nothing
                blocks[:, k + 1 :, k] = blocks[:, k, k + 1 :]
        return blocks, links, right, weights, cost


def _factors(blocks: np.ndarray, links: dict[int, np.ndarray], room: Callable) -> np.ndarray:
    """For each place the inverse of what is left of its block, and that times its row, of symmetric systems: blocks on the diagonal, links[k] of row c and column c + k.

    A place is eliminated at a time. What it leaves for the next `wide` places is held in a ring, in which place c + wide takes the room of place c.
    """
    n, _, _, parts = blocks.shape
    wide = max(links, default=0)
    q = 5 * wide
    rows, rest = room("rows", n, 5, q + 5, parts), room("rest", q, q, parts)
    product, plain = room("product", max(q, 5), q + 5, parts), room("plain", 5, q, parts)
    rest[:] = 0.0
    for c in range(n):
        row, here = rows[c], slice(c % wide * 5, c % wide * 5 + 5) if wide else slice(0, 0)
        row[:, :5] = blocks[c]
        if wide:
            row[:, :5] += rest[here, here]
            row[:, 5:] = rest[here]
            row[:, 5:][:, here] = 0.0
            for k, link in links.items():
                if c < n - k:
                    at = (c + k) % wide * 5 + 5
                    row[:, at : at + 5] += link[c]
            plain[:] = row[:, 5:]
            rest[here], rest[:, here] = 0.0, 0.0
        for k in range(5):
            by = 1.0 / row[k, k]
            row[k] *= by
            row[k, k] = by
            share = row[:, k].copy()
            share[k] = 0.0
            row[:k, k], row[k + 1 :, k] = 0.0, 0.0
            row -= np.multiply(share[:, None], row[k], out=product[:5])
        for k in range(5) if wide else ():
            rest -= np.multiply(plain[k, :, None], row[k, 5:], out=product[:, :q])
    return rows


def _solved(rows: np.ndarray, right: np.ndarray, wide: int, room: Callable) -> np.ndarray:
    """Solutions (places, 5, parts) by _factors."""
    n, _, _, parts = rows.shape
    q = 5 * wide
    out, left, product = room("out", n, 5, parts), np.zeros((q, parts)), room("product", max(q, 5), q + 5, parts)
    for c in range(n):
        out[c] = right[c]
        if wide:
            here = slice(c % wide * 5, c % wide * 5 + 5)
            out[c] += left[here]
            left[here] = 0.0
            left -= np.multiply(rows[c, :, 5:], out[c][:, None], out=product[:5, :q]).sum(0)
    left[:] = 0.0
    for c in range(n - 1, -1, -1):
        x = np.multiply(rows[c, :, :5], out[c], out=product[:5, :5]).sum(1)
        if wide:
            x -= np.multiply(rows[c, :, 5:], left, out=product[:5, :q]).sum(1)
            left[c % wide * 5 : c % wide * 5 + 5] = x
        out[c] = x
    return out
