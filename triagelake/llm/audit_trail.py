"""Edit strings of a dynamic program, kept as linked nodes that share their prefixes.

A node is one edit behind a parent.  It knows its depth, a rolling hash of all
edits from the root, and its ancestors 1, 2, 4, ... edits back.  Two strings are
compared at the first place where they differ, found by binary lifting over the
hashes; where hashes are equal for different nodes, the edits themselves are
compared back to where the paths meet, so a collision cannot decide anything.

``flush`` freezes what all live strings share, so the tree holds only as many
edits as the best strings of the program's states still differ in.
"""

from __future__ import annotations

_MODULUS = (1 << 61) - 1
_BASE = 0x1F3D5B79A86C4E21 % _MODULUS


class Audits:
    ROOT = 0

    def __init__(self, modulus: int = _MODULUS):
        self.modulus = modulus
        self.frozen: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.parent, self.edit, self.depth, self.hash = [0], [""], [0], [0]
        self.back: list[list[int]] = [[]]

    def __len__(self) -> int:
        return len(self.parent)

    def append(self, node: int, edit: str) -> int:
        """The string of ``node`` and one more edit."""
        new = len(self.parent)
        back, hop, k = [node], node, 0
        while k < len(self.back[hop]):
            hop = self.back[hop][k]
            back.append(hop)
            k += 1
        self.parent.append(node)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % self.modulus)
        self.back.append(back)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of ``node`` of this length."""
        gap, k = self.depth[node] - depth, 0
        while gap:
            if gap & 1:
                node = self.back[node][k]
            gap >>= 1
            k += 1
        return node

    def same(self, x: int, y: int) -> bool:
        """Are two strings of one length equal?  Equal hashes are verified edit by edit."""
        if self.hash[x] != self.hash[y]:
            return False
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def before(self, x: int, y: int) -> bool:
        """Is the string of ``x`` smaller than that of ``y``?"""
        size = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, size), self.ancestor(y, size)
        if self.same(a, b):
            return self.depth[x] < self.depth[y]
        k = len(self.back[a]) - 1
        while k >= 0:  # the last prefixes that differ
            if k < len(self.back[a]):
                p, q = self.back[a][k], self.back[b][k]
                if not self.same(p, q):
                    a, b = p, q
            k -= 1
        return self.edit[a] < self.edit[b]

    def _path(self, node: int, top: int) -> list[str]:
        out = []
        while node != top:
            out.append(self.edit[node])
            node = self.parent[node]
        return out[::-1]

    def flush(self, live: list[int]) -> list[int]:
        """Freeze the common prefix of the live nodes; their new numbers."""
        low = min(self.depth[x] for x in live)
        heads = {self.ancestor(x, low) for x in live}
        while len(heads) > 1:
            heads = {self.parent[x] for x in heads}
        top = heads.pop()
        paths = [self._path(x, top) for x in live]
        self.frozen.append("".join(self._path(top, self.ROOT)))
        self._clear()
        out, made = [], {}
        for path in paths:
            node = self.ROOT
            for edit in path:
                step = (node, edit)
                if step not in made:
                    made[step] = self.append(node, edit)
                node = made[step]
            out.append(node)
        return out

    def text(self, node: int) -> str:
        return "".join(self.frozen) + "".join(self._path(node, self.ROOT))
