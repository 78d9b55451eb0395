"""A radix trie over byte strings that numbers its leaves."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of an edge between two inner nodes; an edge to a lone leaf holds all that is left of its term.
STEP = 4


class RadixTrie:
    """Terms as bytes; a traversal of UTF-8 by byte is one in the order of code points.

    An inner node maps the next STEP bytes to another node, or to (what is left
    of the only term there, its leaf's number). Counters are kept outside, in
    arrays by leaf number.
    """

    def __init__(self):
        self.root: dict = {}
        self.leaves = 0

    def leaf(self, term: bytes) -> int:
        """The number of a term's leaf; new terms get the next one."""
        node, at = self.root, STEP
        while True:
            edge, rest = term[at - STEP : at], term[at:]
            child = node.get(edge)
            if child is None:
                node[edge] = (rest, self.leaves)
                self.leaves += 1
                return self.leaves - 1
            if type(child) is tuple:
                other, number = child
                if other == rest:
                    return number
                child = node[edge] = {other[:STEP]: (other[STEP:], number)}  # two terms now: one edge further down
            node, at = child, at + STEP

    def __iter__(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf number) in byte order."""
        stack: list = [(b"", self.root)]
        while stack:
            term, node = stack.pop()
            if type(node) is int:
                yield term, node
            else:
                for edge in sorted(node, reverse=True):
                    child = node[edge]
                    stack.append((term + edge + child[0], child[1]) if type(child) is tuple else (term + edge, child))
