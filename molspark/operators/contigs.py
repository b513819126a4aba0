"""Shortest contigs of many small de Bruijn graphs at once: unbranched stretches are found in arrays, only branches are walked."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

_WORD = 1 << 62


def _glue(x: np.ndarray, most_x: int, width: int, y: np.ndarray, most_y: int) -> tuple[np.ndarray, int]:
    """Numbers of the stretches of x, ``width`` letters long, each with the stretch of y behind it; below the second result, in order of the texts."""
    if most_x * most_y >= _WORD:  # places among the different numbers, in the same order
        (x, most_x), (y, most_y) = (((u := np.unique(z, return_inverse=True))[1], len(u[0])) for z in (x, y))
    n = min(len(x), len(y) - width)
    return x[:n] * most_y + y[width : width + n], most_x * most_y


def _codes(letters: np.ndarray, most: int, size: int) -> tuple[np.ndarray, int]:
    """A number for each ``size`` letters in a row, equal for equal ones and in their order, and a number above all of them."""
    out, width, done = None, 1, 0
    part = letters, most
    while True:
        if size & 1:
            out = part if out is None else _glue(*out, done, *part)
            done += width
        size >>= 1
        if not size:
            return out
        part = _glue(*part, width, *part)
        width *= 2


def _in_order(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of their keys, which are below ``most``, and the keys in that order."""
    bits = len(key).bit_length()
    if most << bits < 1 << 63:  # numbers alone are sorted faster than places
        both = np.sort((key << bits) | np.arange(len(key)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _holding(text: str, part: str) -> np.ndarray:
    """Whether ``part`` stands in ``text`` from each place on."""
    out = np.full(len(text) + 1, not part)
    i = text.find(part) if part else -1
    while i >= 0:
        out[i] = True
        i = text.find(part, i + 1)
    return out


#: Rounds in which distances of all graphs go one stretch on, what a step counts in letters of coverage, and a distance above all others.
_ROUNDS, _STEP, _FAR = 32, 1 << 40, 1 << 61


def _reached(fro: np.ndarray, to: np.ndarray, weight: np.ndarray, first: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the stretch of the lightest walk from a first node to it (-1: none) and whether there are several; and the nodes whose walks are not settled yet."""
    if not len(to):
        return np.full(nodes, -1), np.zeros(nodes, bool), to
    order = np.argsort(to, kind="stable")
    fro, weight, to = fro[order], weight[order], to[order]
    runs = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = to[runs]
    far = np.full(nodes, _FAR)
    far[first] = 0
    for _ in range(_ROUNDS):
        near = np.minimum.reduceat(far[fro] + weight, runs)
        nearer = near < far[ends]
        if not nearer.any():
            break
        far[ends[nearer]] = near[nearer]
    tight = np.flatnonzero((far[fro] + weight == far[to]) & (far[to] < _FAR))
    by = np.full(nodes, -1)
    by[to[tight]] = order[tight]
    return by, np.bincount(to[tight], minlength=nodes) > 1, ends[nearer]


def _walk(text: str, node: int, last: int, lo: int, hi: int, to: list[int], steps: list[int], cover: list[int], a: list[int], b: list[int], los: list[int], his: list[int], joined: str) -> str:
    """The walk of fewest steps from ``node`` to ``last`` over stretches, those of a node from lo to hi; ties by higher coverage, then by text; empty if none."""
    heap, done = [(0, 0, text, node, lo, hi)], set()
    while heap:
        far, cost, text, node, lo, hi = heappop(heap)
        if node == last:
            return text
        if node in done:
            continue
        done.add(node)
        for s in range(lo, hi):
            if to[s] not in done:
                heappush(heap, (far + steps[s], cost - cover[s], text + joined[a[s] : b[s]], to[s], los[s], his[s]))
    return ""


def shortest_contigs(sets: list[list[tuple[str, int]]], ks: list[int], coverages: list[int], start_anchor: str, end_anchor: str) -> list[list[str]]:
    """For each set of distinct reads and their numbers the contigs of each k (2 or more) and coverage: the walk of fewest k-mers from the smallest node that begins
    with the start anchor to the smallest that ends with the end anchor, ties by higher coverage, then by text.

    All k-mers of all sets are sorted together.  A node is a stop if it has not one way in and one way out, if a k-mer below the coverage or a read's end
    touches it, or if it is an anchor's; from stop to stop all reads that hold the first k-mer are equal, so one of them tells the stretch.
    """
    grid = [(k, c) for k in ks for c in coverages]
    out = [[""] * len(grid) for _ in sets]
    texts = [s for reads in sets for s, _ in reads]
    joined = "".join(texts)
    if not joined:
        return out
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    table = np.zeros(int(raw.max()) + 1, np.int64)
    table[raw] = 1
    most = int(table.sum())
    table = np.cumsum(table) - 1
    letters = np.append(table[raw], -1)
    holds: dict[str, np.ndarray] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    numbers = np.fromiter((n for reads in sets for _, n in reads), np.int64, len(texts))
    owner = np.repeat(np.arange(len(sets)), [len(reads) for reads in sets])
    for x, k in enumerate(ks):
        long = np.flatnonzero(sizes >= k)
        if not len(long):
            continue
        # one place a node of a read; its k-mer is the node and the next letter, 0 at the read's end
        n = sizes[long] - k + 2
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(offsets[long] - (ends - n), n)
        group = np.repeat(owner[long], n)
        ahead = letters[at + k - 1] + 1
        ahead[ends - 1] = 0
        code, span = _codes(letters[:-1], most, k - 1)
        code = code[at]
        if span * (most + 1) * len(sets) >= _WORD:
            different, code = np.unique(code, return_inverse=True)
            span = len(different)
        order, key = _in_order((group * span + code) * (most + 1) + ahead, len(sets) * span * (most + 1))
        new = np.append(True, key[1:] != key[:-1])
        edge = np.empty(len(key), np.int64)
        edge[order] = np.cumsum(new) - 1
        run = np.flatnonzero(new)
        some = order[run]
        true = ahead[some] > 0
        count = np.add.reduceat(np.repeat(numbers[long], n)[order], run)
        key = key[run] // (most + 1)
        new = np.append(True, key[1:] != key[:-1])
        src = np.cumsum(new) - 1
        node = src[edge]
        dst = np.zeros(len(some), np.int64)
        dst[true] = node[some[true] + 1]
        one = some[new]  # a place of each node
        tail = end_anchor[-(k - 1) :]
        for part in (start_anchor[: k - 1], tail):
            if part not in holds:
                holds[part] = _holding(joined, part)
        starts = np.flatnonzero(holds[start_anchor[: k - 1]][at[one]])
        lasts = np.flatnonzero(holds[tail][at[one] + k - 1 - len(tail)])
        covered = np.append(0, np.cumsum(count[edge]))
        for y, c in enumerate(coverages):
            keep = true & (count >= c)
            ways_out, ways_in = (np.bincount(side[keep], minlength=len(one)) for side in (src, dst))
            alive = ways_out + ways_in > 0
            ends_of = []
            for found in (starts, lasts):
                found = found[alive[found]][::-1]
                best = np.full(len(sets), -1)
                best[group[one[found]]] = found  # the smallest is written last
                ends_of.append(best)
            have = np.flatnonzero((ends_of[0] >= 0) & (ends_of[1] >= 0))
            if not len(have):
                continue
            first, last = ends_of[0][have], ends_of[1][have]
            stop = (ways_out != 1) | (ways_in != 1)
            stop[src[~keep]] = True
            stop[dst[true & ~keep]] = True
            stop[first] = stop[last] = True
            stops = np.flatnonzero(stop[node])
            head = np.flatnonzero(keep[edge[stops]])
            told = np.full(len(some), -1)
            told[edge[stops[head]]] = head
            kmers = np.flatnonzero(told >= 0)  # in order of their nodes
            head, tail_at = stops[told[kmers]], stops[told[kmers] + 1]
            fro, to = src[kmers], node[tail_at]
            steps, cover = tail_at - head, covered[tail_at] - covered[head]
            by, several, unsettled = _reached(fro, to, steps * _STEP - cover, first, len(one))
            unsure = np.full(len(sets), covered[-1] >= _STEP or len(edge) >= 1 << 20)  # weights would not fit
            unsure[group[one[unsettled]]] = True
            doubts, begins, firsts = (x.tolist() for x in (unsure[have] | several[last], by[last], at[one[first]]))
            a, b, before, branched = (x.tolist() for x in (at[head] + k - 1, at[tail_at] + k - 1, by[fro], several[fro]))
            more = None
            for g, f, e, doubt, step, place in zip(have.tolist(), first.tolist(), last.tolist(), doubts, begins, firsts, strict=True):
                way, none = [], step < 0 and f != e
                while step >= 0 and not doubt:
                    way.append(step)
                    doubt, step = branched[step], before[step]
                text = joined[place : place + k - 1]
                if doubt:
                    if more is None:
                        more = (to.tolist(), steps.tolist(), cover.tolist(), a, b, *(np.searchsorted(fro, to, side).tolist() for side in ("left", "right")), joined)
                    text = _walk(text, f, e, *(int(np.searchsorted(fro, f, side)) for side in ("left", "right")), *more)
                elif none:
                    text = ""
                else:
                    text = "".join([text, *[joined[a[s] : b[s]] for s in reversed(way)]])
                out[g][x * len(coverages) + y] = text
    return out
