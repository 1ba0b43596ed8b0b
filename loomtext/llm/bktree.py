"""BK-trees: children keyed by their integer Hamming distance to the parent."""

from __future__ import annotations


class BKTree:
    """A BK-tree over integers under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int):
        """Positions of the members within the radius of ``value``."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            edges = self.children[at]
            if len(edges) > 2 * radius + 1:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
            else:
                todo += [to for k, to in edges.items() if -radius <= k - d <= radius]
