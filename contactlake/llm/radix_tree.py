"""An adaptive radix tree over byte strings, with resizable nodes and path compression.

A node holds the bytes that lead to it from its parent (``path``), so chains are one
node.  Children are found by the first byte of their path, through one of four
layouts that grow with their number: sorted keys for up to 4 and 16 children, a byte
index for up to 48, a direct table for 256.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to ``room`` children, keys in order."""

    __slots__ = ("room", "keys", "kids")

    def __init__(self, room: int, keys: bytearray, kids: list):
        self.room, self.keys, self.kids = room, keys, kids

    def get(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, kid):
        """Set or add a child; returns the layout that holds it."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.keys) == self.room:
            if self.room == 4:
                return Sorted(16, self.keys, self.kids).put(byte, kid)
            index = bytearray(256)
            for i, key in enumerate(self.keys):
                index[key] = i + 1
            return Indexed(index, self.kids).put(byte, kid)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def __iter__(self) -> Iterator:
        return iter(self.kids)


class Indexed:
    """Up to 48 children behind an index of 256 bytes (0: none)."""

    __slots__ = ("index", "kids")

    def __init__(self, index: bytearray, kids: list):
        self.index, self.kids = index, kids

    def get(self, byte: int):
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid):
        if at := self.index[byte]:
            self.kids[at - 1] = kid
            return self
        if len(self.kids) == 48:
            return Direct([self.kids[i - 1] if i else None for i in self.index]).put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def __iter__(self) -> Iterator:
        return (self.kids[i - 1] for i in self.index if i)


class Direct:
    """A child for each byte."""

    __slots__ = ("kids",)

    def __init__(self, kids: list):
        self.kids = kids

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def __iter__(self) -> Iterator:
        return (k for k in self.kids if k is not None)


class Node:
    """``size`` keys pass through or end here, the smallest owner is ``first``, ``ends`` own the key that ends here."""

    __slots__ = ("path", "size", "first", "ends", "kids")

    def __init__(self, path: bytes, size: int, first: int, ends: list[int], kids=None):
        self.path, self.size, self.first, self.ends = path, size, first, ends
        self.kids = kids if kids is not None else Sorted(4, bytearray(), [])


def _shared(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Tree:
    """Keys with their owners; an owner is an integer, a key may have many."""

    def __init__(self):
        self.root = Node(b"", 0, 0, [])

    def insert(self, key: bytes, owner: int, ends: bool) -> None:
        """Add a key; ``ends`` records its owner where the key ends."""
        node, at = self.root, 0
        self._pass(node, owner)
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids = node.kids.put(key[at], Node(key[at:], 1, owner, [owner] if ends else []))
                return
            same = _shared(kid.path, key[at : at + len(kid.path)])
            if same < len(kid.path):
                upper = Node(kid.path[:same], kid.size, kid.first, [])
                kid.path = kid.path[same:]
                upper.kids = upper.kids.put(kid.path[0], kid)
                node.kids = node.kids.put(key[at], upper)
                kid = upper
            self._pass(kid, owner)
            node, at = kid, at + same
        if ends:
            node.ends.append(owner)

    @staticmethod
    def _pass(node: Node, owner: int) -> None:
        node.first = min(node.first, owner) if node.size else owner
        node.size += 1

    def aligned(self, width: int) -> Iterator[tuple[bytes, Node, bool]]:
        """(key so far, node that covers it, whether the node ends there) for all lengths divisible by ``width``, parents first."""
        yield b"", self.root, True
        todo = [(b"", kid) for kid in self.root.kids]
        while todo:
            above, node = todo.pop()
            here = above + node.path
            for at in range(len(above) // width * width + width, len(here) + 1, width):
                yield here[:at], node, at == len(here)
            todo.extend((here, kid) for kid in node.kids)
