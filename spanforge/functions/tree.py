"""The pattern tree, for those who analyse or rewrite patterns.

read(pattern) gives an immutable Tree of the dialect's meaning: flags, classes, set operations, quoting and comments are
resolved, so two patterns of one tree match alike. Nodes:

* Chars(ranges): one code point of a set, as sorted ranges of code points; no range never matches.
* Seq(items), Alt(branches): one after another; the first branch that leads to a match.
* Rep(body, least, most, greedy): most is None without a bound.
* Group(body, index), Back(index): a capturing group and a reference to what it took.
* Look(body, ahead, negated), At(place): what stands around; places are start, end, end_line_feed, line_start, line_end, word, not_word.
* Cluster(): an extended grapheme cluster.

printed() writes a tree as a pattern that reads as the same tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .dialect import NEST_LIMIT, SIZE_LIMIT, Alt, At, Back, Chars, Cluster, Group, Look, Rep, Seq, children, parse, walk

__all__ = ["Alt", "At", "Back", "Chars", "Cluster", "Group", "Look", "Rep", "Seq", "Tree", "read"]

Node = Chars | Seq | Alt | Rep | Group | Back | Look | At | Cluster
_PLACES = {"start": r"\A", "end": r"\z", "end_line_feed": r"\Z", "line_start": "(?m:^)", "line_end": "(?m:$)", "word": r"\b", "not_word": r"\B"}
_BOUNDS = {(0, None): "*", (1, None): "+", (0, 1): "?"}


@dataclass(frozen=True)
class Tree:
    root: Node
    groups: int = 0
    names: tuple[tuple[str, int], ...] = ()

    def walk(self) -> Iterator[Node]:
        """All nodes, each before those in it."""
        return walk(self.root)

    def fold(self, visit: Callable[[Node, list], object]) -> object:
        """visit(node, what it gave for the nodes inside), from the leaves up."""
        return _fold(self.root, visit)

    def map(self, change: Callable[[Node], Node]) -> Tree:
        """The tree with every node changed, from the leaves up; groups keep their numbers."""
        return Tree(_plain(_map(self.root, change)), self.groups, self.names)

    def printed(self) -> str:
        """A pattern that reads as this tree."""
        return _print(self.root, dict((i, n) for n, i in self.names))

    def __str__(self) -> str:
        return self.printed()


def read(pattern: str, size_limit: int = SIZE_LIMIT, nest_limit: int = NEST_LIMIT) -> Tree:
    """The tree of a pattern; PatternError if it has none."""
    parsed = parse(pattern, size_limit, nest_limit)
    return Tree(_plain(parsed.node), parsed.groups, tuple(sorted(parsed.names.items(), key=lambda x: x[1])))


def _rebuilt(n: Node, inner: list) -> Node:
    match n:
        case Seq():
            return Seq(tuple(inner))
        case Alt():
            return Alt(tuple(inner))
        case Rep(_, least, most, greedy):
            return Rep(inner[0], least, most, greedy)
        case Group(_, index):
            return Group(inner[0], index)
        case Look(_, ahead, negated):
            return Look(inner[0], ahead, negated)
    return n


def _fold(n: Node, visit: Callable[[Node, list], object]) -> object:
    return visit(n, [_fold(x, visit) for x in children(n)])


def _map(n: Node, change: Callable[[Node], Node]) -> Node:
    return change(_rebuilt(n, [_map(x, change) for x in children(n)]))


def _plain(n: Node) -> Node:
    """Sequences in sequences, and those of one item, are told as what they are; sets as their ranges alone."""

    def told(n: Node) -> Node:
        match n:
            case Chars(ranges, _):
                return Chars(tuple(tuple(r) for r in ranges))
            case Seq(items):
                flat = tuple(y for x in items for y in (x.items if isinstance(x, Seq) else (x,)))
                return flat[0] if len(flat) == 1 else Seq(flat)
            case Alt((only,)):
                return only
        return n

    return _map(n, told)


def _print(n: Node, names: dict[int, str]) -> str:
    inside = lambda x: _print(x, names)
    match n:
        case Chars(()):
            return "[a&&b]"
        case Chars(ranges):
            code = lambda c: chr(c) if chr(c).isascii() and chr(c).isalnum() else f"\\x{{{c:X}}}"
            if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
                return code(ranges[0][0])
            return "[" + "".join(code(a) if a == b else f"{code(a)}-{code(b)}" for a, b in ranges) + "]"
        case Seq(items):
            return "".join(f"(?:{inside(x)})" if isinstance(x, Alt) else inside(x) for x in items)
        case Alt(branches):
            return "|".join(f"(?:{inside(b)})" if isinstance(b, Alt) else inside(b) for b in branches)
        case Rep(body, least, most, greedy):
            bounds = _BOUNDS.get((least, most)) or f"{{{least}{'' if most == least else ',' if most is None else f',{most}'}}}"
            one = inside(body) if isinstance(body, Chars | Group) else f"(?:{inside(body)})"
            return f"{one}{bounds}{'' if greedy else '?'}"
        case Group(body, index):
            return f"({f'?<{names[index]}>' if index in names else ''}{inside(body)})"
        case Look(body, ahead, negated):
            return f"(?{'' if ahead else '<'}{'!' if negated else '='}{inside(body)})"
        case Back(index):
            return f"(?:\\{index})"
        case At(place):
            return _PLACES[place]
        case Cluster():
            return "\\X"
    raise TypeError(n)
