"""Searches in a graph held by one task, over NumPy arrays."""

from __future__ import annotations

import numpy as np

#: Sources that a task extends together, and labels (8 bytes each) it may hold for them.
BLOCK = 512
LABELS = 8_000_000
UNBOUNDED = 2**62


def _repeated(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``start[k] .. start[k] + count[k] - 1`` for every k in turn, and the k of each."""
    which = np.repeat(np.arange(len(start)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


class Graph:
    """Arcs in compressed rows over dense numbers; ``ids`` are sorted, so numbers order like ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, more: np.ndarray | None = None):
        """``more`` holds ids that may have no arcs."""
        self.ids = np.unique(np.concatenate([src, dst] + ([more] if more is not None else [])))
        a, b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((b, a))
        self.head = np.searchsorted(a[order], np.arange(len(self.ids) + 1)).astype(np.int32)
        self.dst = b[order].astype(np.int32)
        self.cost = np.asarray(cost, np.int64)[order]

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """Dense numbers of ids; -1 for unknown ones."""
        if not len(self.ids) or not len(ids):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def expand(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each arc from each of ``node``: position in ``node``, and index of the arc."""
        return _repeated(self.head[node], self.head[node + 1] - self.head[node])

    @property
    def block(self) -> int:
        """Sources to search together, so that a label per source and node fits ``LABELS``."""
        return max(1, min(BLOCK, LABELS // max(len(self.ids), 1)))

    @classmethod
    def of(cls, parts: dict) -> Graph:
        """A graph from the plain arrays that are broadcast."""
        graph = cls.__new__(cls)
        graph.__dict__.update(parts)
        return graph

    def parts(self) -> np.ndarray:
        """A number for each node, the same for nodes that arcs link in whatever direction."""
        src = np.repeat(np.arange(len(self.ids)), np.diff(self.head))
        label = np.arange(len(self.ids))
        while True:
            low = np.minimum(label[src], label[self.dst])
            new = label.copy()
            np.minimum.at(new, label[src], low)
            np.minimum.at(new, label[self.dst], low)
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def within(self, nodes: np.ndarray) -> Graph:
        """The graph among ``nodes``, ascending numbers that no arc leaves; its ``ids`` are these numbers."""
        which, arc = self.expand(nodes)
        return Graph.of({
            "ids": nodes, "head": np.append(0, np.cumsum(self.head[nodes + 1] - self.head[nodes])).astype(np.int32),
            "dst": np.searchsorted(nodes, self.dst[arc]).astype(np.int32), "cost": self.cost[arc],
        })

    def incoming(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs by their end: compressed rows of (start, cost), starts ascending."""
        src = np.repeat(np.arange(len(self.ids)), np.diff(self.head))
        order = np.lexsort((src, self.dst))
        return np.searchsorted(self.dst[order], np.arange(len(self.ids) + 1)), src[order], self.cost[order]

    def _in_breadth(self) -> np.ndarray:
        """Nodes in the order in which a search by hops meets them, one part after the other."""
        seen, order = np.zeros(len(self.ids), bool), []
        for first in range(len(self.ids)):
            if seen[first]:
                continue
            level = np.array([first])
            seen[first] = True
            while len(level):
                order.append(level)
                level = np.unique(self.dst[self.expand(level)[1]])
                level = level[~seen[level]]
                seen[level] = True
        return np.concatenate(order)

    def all_costs(self, starts: np.ndarray) -> np.ndarray:
        """Costs (node, position in starts), unbounded, for graphs of which every start needs most.

        Sweeps over the arcs there and back, each relaxing all starts at once, until none improves.
        """
        cost = np.full((len(self.ids), len(starts)), UNBOUNDED, np.int64)
        cost[starts, np.arange(len(starts))] = 0
        place = np.empty(len(self.ids), np.int64)
        place[self._in_breadth()] = np.arange(len(self.ids))
        src = np.repeat(np.arange(len(self.ids)), np.diff(self.head))
        order = np.lexsort((place[self.dst], place[src]))
        arcs = list(zip(src[order].tolist(), self.dst[order].tolist(), self.cost[order].tolist()))
        rows, longer, added, less = list(cost), np.empty(len(starts), np.int64), np.add, np.minimum
        before = None
        while before is None or (cost != before).any():
            before = cost.copy()
            for a, b, c in arcs:
                added(rows[a], c, out=longer)
                less(rows[b], longer, out=rows[b])
            arcs.reverse()
        return cost

    def search(self, starts: np.ndarray, radius: int, targets: dict[int, np.ndarray] | None = None):
        """Cheapest costs from each start: arrays (position in starts, node, cost), sorted by the first two.

        With ``targets`` (nodes by position) a start is not searched beyond its dearest target.
        """
        return self.spread(np.arange(len(starts)), starts, np.zeros(len(starts), np.int64), len(starts), radius, targets)

    def spread(self, owner: np.ndarray, node: np.ndarray, cost: np.ndarray, owners: int, radius: int, targets: dict[int, np.ndarray] | None = None):
        """As ``search`` for owners that begin at several nodes, each at a cost."""
        n = np.int64(max(len(self.ids), 1))
        if getattr(self, "labels", None) is None or len(self.labels) < owners * n:
            self.labels = np.full(owners * n, UNBOUNDED + 1, np.int64)  # kept; only what is touched is reset
        labels = self.labels
        key = owner.astype(np.int64) * n + node
        np.minimum.at(labels, key, cost)
        key = np.unique(key)
        touched = [key]
        bound = np.full(owners, radius, np.int64)
        if targets:
            wanted = np.concatenate([k * n + t for k, t in targets.items()])
            of_wanted = np.concatenate([np.full(len(t), k) for k, t in targets.items()])
        while len(key):
            which, arc = self.expand(key % n)
            new_cost = labels[key][which] + self.cost[arc]
            owner_of = key[which] // n
            new_key = owner_of * n + self.dst[arc]
            keep = (new_cost <= bound[owner_of]) & (new_cost < labels[new_key])
            new_key = new_key[keep]
            np.minimum.at(labels, new_key, new_cost[keep])
            key = np.unique(new_key)
            touched.append(key)
            if targets:
                bound[:] = 0
                np.maximum.at(bound, of_wanted, np.minimum(labels[wanted], radius))
                key = key[labels[key] <= bound[key // n]]
        reached = np.unique(np.concatenate(touched))
        found = labels[reached]
        labels[reached] = UNBOUNDED + 1
        return reached // n, reached % n, found

    def nearest(self, places: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k of ``places`` from which each node is reached at least cost: arrays (node, place, cost).

        Ties go to the smaller place. A node never passes on more than its k best, which is exact: a place that
        isn't among the k best of a node isn't among those of any node behind it either.
        """
        n = len(self.ids)
        best_cost, best_place = np.full((n, k), UNBOUNDED + 1, np.int64), np.full((n, k), n, np.int64)
        node = place = np.unique(places)
        cost = np.zeros(len(node), np.int64)
        while len(node):
            # of each node's old and new labels: the cheapest per place, of these the k first
            touched = np.unique(node)
            old = np.repeat(touched, k)
            nodes = np.concatenate([old, node])
            all_places, costs = np.concatenate([best_place[touched].ravel(), place]), np.concatenate([best_cost[touched].ravel(), cost])
            fresh = np.arange(len(nodes)) >= len(old)
            order = np.lexsort((fresh, costs, all_places, nodes))
            nodes, all_places, costs, fresh = nodes[order], all_places[order], costs[order], fresh[order]
            first = np.ones(len(nodes), bool)
            first[1:] = (nodes[1:] != nodes[:-1]) | (all_places[1:] != all_places[:-1])
            keep = first & (all_places < n)
            nodes, all_places, costs, fresh = nodes[keep], all_places[keep], costs[keep], fresh[keep]
            order = np.lexsort((all_places, costs, nodes))
            nodes, all_places, costs, fresh = nodes[order], all_places[order], costs[order], fresh[order]
            rank = np.arange(len(nodes)) - np.searchsorted(nodes, nodes)
            keep = rank < k
            nodes, all_places, costs, fresh, rank = nodes[keep], all_places[keep], costs[keep], fresh[keep], rank[keep]
            best_cost[touched], best_place[touched] = UNBOUNDED + 1, n
            best_cost[nodes, rank], best_place[nodes, rank] = costs, all_places
            node, place, cost = nodes[fresh], all_places[fresh], costs[fresh]
            which, arc = self.expand(node)
            node, place, cost = self.dst[arc].astype(np.int64), place[which], cost[which] + self.cost[arc]
            worst = best_cost[node, k - 1]
            keep = (cost <= radius) & ((cost < worst) | ((cost == worst) & (place < best_place[node, k - 1])))
            node, place, cost = node[keep], place[keep], cost[keep]
        node, rank = np.nonzero(best_place < n)
        return node, best_place[node, rank], best_cost[node, rank]
