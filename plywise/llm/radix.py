"""An adaptive radix tree over byte strings: four node layouts that grow, and compressed paths."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle


class _Sorted:
    """Up to ``most`` children, their bytes in order."""

    __slots__ = ("most", "bytes", "kids")

    def __init__(self, most: int, pairs: list[tuple[int, _Node]]):
        self.most, self.bytes, self.kids = most, bytearray(b for b, _ in pairs), [k for _, k in pairs]

    def get(self, byte: int) -> _Node | None:
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: _Node) -> None:
        at = self.bytes.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)

    def full(self) -> bool:
        return len(self.kids) == self.most

    def grown(self) -> _Sorted | _Indexed:
        return _Sorted(16, list(self)) if self.most == 4 else _Indexed(list(self))

    def __iter__(self) -> Iterator[tuple[int, _Node]]:
        return zip(self.bytes, self.kids)


class _Indexed:
    """Up to 48 children, found by a table of their places."""

    __slots__ = ("places", "kids")

    def __init__(self, pairs: list[tuple[int, _Node]]):
        self.places, self.kids = bytearray(256), []
        for b, k in pairs:
            self.put(b, k)

    def get(self, byte: int) -> _Node | None:
        at = self.places[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid: _Node) -> None:
        if self.places[byte]:
            self.kids[self.places[byte] - 1] = kid
            return
        self.kids.append(kid)
        self.places[byte] = len(self.kids)

    def full(self) -> bool:
        return len(self.kids) == 48

    def grown(self) -> _Direct:
        return _Direct(list(self))

    def __iter__(self) -> Iterator[tuple[int, _Node]]:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.places) if at)


class _Direct:
    """A place for each byte."""

    __slots__ = ("kids",)

    def __init__(self, pairs: list[tuple[int, _Node]]):
        self.kids: list[_Node | None] = [None] * 256
        for b, k in pairs:
            self.kids[b] = k

    def get(self, byte: int) -> _Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: _Node) -> None:
        self.kids[byte] = kid

    def full(self) -> bool:
        return False

    def __iter__(self) -> Iterator[tuple[int, _Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class _Node:
    """The bytes that follow the one that led here, the children behind them, and the values of the key that ends there."""

    __slots__ = ("path", "kids", "values")

    def __init__(self, path: bytes):
        self.path, self.kids, self.values = path, None, []


class Tree:
    """Keys with their values; keys may be prefixes of each other, and each may have several values."""

    def __init__(self):
        self.root = _Node(b"")

    def add(self, key: bytes, value: object) -> None:
        node, at, above, byte = self.root, 0, None, 0
        while True:
            path, n = node.path, len(node.path)
            if key[at : at + n] != path:  # the path parts: a new node holds what is common
                same = next(i for i in range(n) if key[at + i : at + i + 1] != path[i : i + 1])
                top = _Node(path[:same])
                node.path = path[same + 1 :]
                top.kids = _Sorted(4, [(path[same], node)])
                above.kids.put(byte, top)
                node, n = top, same
            at += n
            if at == len(key):
                node.values.append(value)
                return
            kid = node.kids.get(key[at]) if node.kids is not None else None
            if kid is None:
                leaf = _Node(key[at + 1 :])
                leaf.values.append(value)
                if node.kids is None:
                    node.kids = _Sorted(4, [])
                elif node.kids.full():
                    node.kids = node.kids.grown()
                node.kids.put(key[at], leaf)
                return
            above, byte, node, at = node, key[at], kid, at + 1

    def walk(self) -> Iterator[tuple[int, int, bytes, list]]:
        """Of every node, each before its children: place of its parent in this walk (-1: none), bytes from the root to
        its end, the bytes since its parent's end, and its values."""
        stack, seen = [(self.root, -1, 0, b"")], 0
        while stack:
            node, above, depth, lead = stack.pop()
            own = lead + node.path
            depth += len(own)
            yield above, depth, own, node.values
            if node.kids is not None:
                stack.extend((kid, seen, depth, bytes((b,))) for b, kid in node.kids)
            seen += 1


cloudpickle.register_pickle_by_value(sys.modules[__name__])
