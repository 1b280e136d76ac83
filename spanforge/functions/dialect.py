"""The pattern dialect: read on the driver, resolved to code-point sets and numbered groups, and spelled for the JVM.

Flags, named groups, predefined classes, set operations, quoting and comments are resolved here, so what reaches Spark's
own regular-expression functions means the same whatever the Java version or locale.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from . import charset as cs
from .errors import PatternError

#: Limits of the dialect: repetition bounds, and defaults of expanded elements and nesting.
MOST_REPEATS, SIZE_LIMIT, NEST_LIMIT = 65535, 10_000, 250
#: Patterns may nest as deep as the limit, at a few frames a level.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


@dataclass(frozen=True)
class Chars:
    """One code point of a set; java: how Java spells the set, where that is shorter."""

    ranges: cs.Ranges
    java: str | None = None


@dataclass(frozen=True)
class Seq:
    items: tuple = ()


@dataclass(frozen=True)
class Alt:
    branches: tuple


@dataclass(frozen=True)
class Rep:
    body: object
    least: int
    most: int | None
    greedy: bool = True


@dataclass(frozen=True)
class Group:
    body: object
    index: int


@dataclass(frozen=True)
class Look:
    body: object
    ahead: bool
    negated: bool


@dataclass(frozen=True)
class Back:
    index: int


@dataclass(frozen=True)
class At:
    """start, end, end_line_feed, line_start, line_end, word, not_word"""

    place: str


@dataclass(frozen=True)
class Cluster:
    """An extended grapheme cluster."""


@dataclass
class Parsed:
    node: object
    groups: int
    names: dict[str, int] = field(default_factory=dict)


def chars(ranges: cs.Ranges, java: str | None = None) -> Chars:
    return Chars(ranges, java)


SINGLE = {"a": "\x07", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b", "0": "\0"}
HEX = set("0123456789abcdefABCDEF")


class Reader:
    def __init__(self, pattern: str, nest_limit: int = NEST_LIMIT):
        self.p, self.at, self.nest, self.nest_limit = pattern, 0, 0, nest_limit
        self.flags: set[str] = set()
        self.groups = 0
        self.names: dict[str, int] = {}
        self.backs: list[tuple[int, int]] = []
        self.quoting = False

    def fail(self, kind: str, start: int | None = None, end: int | None = None):
        raise PatternError(kind, self.p, self.at if start is None else start, end)

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self, text: str) -> bool:
        if self.p.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def read(self) -> Parsed:
        node = self.alternation()
        if self.at < len(self.p):
            self.fail("UnmatchedCloseParen")
        for index, where in self.backs:
            if index > self.groups:
                self.fail("BackrefNotFound", where)
        return Parsed(node, self.groups, self.names)

    # ---- structure

    def skip(self) -> None:
        """Comments everywhere; white space and line comments in extended mode; ends of quoting that none began."""
        while not self.quoting:
            if self.take("\\E"):
                continue
            if self.p.startswith("(?#", self.at):
                end = self.p.find(")", self.at)
                if end < 0:
                    self.fail("UnexpectedEof")
                self.at = end + 1
            elif "x" in self.flags and self.peek() and self.peek() in " \t\n\r\f\v":
                self.at += 1
            elif "x" in self.flags and self.peek() == "#":
                end = self.p.find("\n", self.at)
                self.at = len(self.p) if end < 0 else end + 1
            else:
                return

    def alternation(self):
        branches = [self.sequence()]
        while not self.quoting and self.take("|"):
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        if all(isinstance(b, Chars) for b in branches):
            return Chars(cs.union(*(b.ranges for b in branches)))
        return Alt(tuple(branches))

    def sequence(self):
        items: list = []
        while True:
            self.skip()
            if self.at >= len(self.p) or not self.quoting and self.peek() in "|)":
                break
            start = self.at
            node = self.atom()
            if node is not None:
                items.append(self.quantified(node, start))
        return items[0] if len(items) == 1 else Seq(tuple(items))

    def quantified(self, node, start: int):
        self.skip()
        if self.quoting or (bounds := self.bounds()) is None:
            return node
        greedy = not self.take("?")
        if self.peek() == "+":
            self.fail("PossessiveQuantifier")
        if self.peek() and self.peek() in "*?{":
            self.fail("NestedQuantifier")
        return Rep(node, *bounds, greedy)

    def bounds(self) -> tuple[int, int | None] | None:
        for mark, found in (("*", (0, None)), ("+", (1, None)), ("?", (0, 1))):
            if self.take(mark):
                return found
        start = self.at
        if not self.take("{"):
            return None
        end = self.p.find("}", self.at)
        body = self.p[self.at : end] if end >= 0 else "?"
        low, comma, high = body.partition(",")
        if not all(x == "" or x.isascii() and x.isdigit() for x in (low, high)):
            self.fail("InvalidRepetition", start)
        self.at = end + 1
        least = int(low or 0)
        most = (int(high) if high else None) if comma else least
        if max(least, most or 0) > MOST_REPEATS:
            self.fail("RepetitionTooLarge", start, self.at)
        if most is not None and least > most:
            self.fail("InvalidRepetition", start, self.at)
        return least, most

    # ---- atoms

    def literal(self, c: str) -> Chars:
        one = cs.of(c)
        return Chars(cs.folded(one) if "i" in self.flags else one)

    def atom(self):
        c = self.peek()
        if self.quoting:
            if self.take("\\E"):
                self.quoting = False
                return None
            self.at += 1
            return self.literal(c)
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == "\\":
            return self.escape()
        if c in "*+?":
            self.fail("RepetitionOnNothing")
        if c == "{":
            self.fail("InvalidRepetition")
        if c in "}]":
            self.fail("UnexpectedChar")
        self.at += 1
        if c == ".":
            return Chars(cs.ALL if "s" in self.flags else cs.NOT_LINE_FEED)
        if c == "^":
            return At("line_start" if "m" in self.flags else "start")
        if c == "$":
            return At("line_end" if "m" in self.flags else "end_line_feed")
        return self.literal(c)

    def nested(self):
        self.nest += 1
        if self.nest > self.nest_limit:
            self.fail("NestingTooDeep")
        node = self.alternation()
        self.nest -= 1
        return node

    def closed(self, start: int) -> None:
        if not self.take(")"):
            self.fail("UnmatchedOpenParen", start)

    def group(self):
        start = self.at
        self.at += 1
        if not self.take("?"):
            return self.capture(start)
        for mark, ahead, negated in (("=", True, False), ("!", True, True), ("<=", False, False), ("<!", False, True)):
            if self.take(mark):
                body = self.nested()
                self.closed(start)
                return Look(body, ahead, negated)
        if self.take(":"):
            body = self.nested()
            self.closed(start)
            return body if not isinstance(body, Seq) or body.items else Seq()
        if self.peek() == ">":
            self.fail("AtomicGroup", start)
        if self.take("P="):
            return self.named_back(")", start, "InvalidGroup")
        for mark, end in (("P<", ">"), ("<", ">"), ("'", "'")):
            if self.take(mark):
                return self.capture(start, self.group_name(end, start))
        return self.flag_group(start)

    def capture(self, start: int, name: str | None = None):
        self.groups += 1
        index = self.groups
        if name is not None:
            self.names[name] = index
        body = self.nested()
        self.closed(start)
        return Group(body, index)

    def group_name(self, end: str, start: int) -> str:
        stop = self.p.find(end, self.at)
        name = self.p[self.at : stop] if stop >= 0 else ""
        if not name or not all(c.isalnum() or c == "_" for c in name[1:]) or name[0] in "\\.*+?|^$()[]{}":
            self.fail("InvalidGroup", start)
        self.at = stop + 1
        return name

    def flag_group(self, start: int):
        before, on, negate, seen = set(self.flags), set(self.flags), False, False
        while (c := self.peek()) and c not in ":)":
            self.at += 1
            if c == "-" and not negate:
                negate = True
            elif c in "imsxu":
                seen = True
                (on.discard if negate else on.add)(c)
            else:
                self.fail("InvalidGroup", start, self.at)
        if not seen or not c:
            self.fail("InvalidGroup", start, self.at)
        self.at += 1
        self.flags = on
        if c == ")":
            return None
        body = self.nested()
        self.closed(start)
        self.flags = before
        return body

    # ---- escapes

    def escape(self):
        start = self.at
        self.at += 1
        c = self.peek()
        if not c:
            self.fail("UnexpectedEof", start)
        self.at += 1
        if c == "Q":
            self.quoting = True
            return None
        if c in "123456789":
            while self.peek() and self.peek() in "0123456789":
                self.at += 1
            index = int(self.p[start + 1 : self.at])
            self.backs.append((index, start))
            return Back(index)
        if c == "k":
            for opening, closing in (("<", ">"), ("{", "}"), ("'", "'")):
                if self.take(opening):
                    return self.named_back(closing, start, "InvalidNamedBackref")
            self.fail("InvalidNamedBackref", start)
        if c == "X":
            return Cluster()
        if c == "R":
            return Alt((Seq((Chars(cs.of("\r")), Chars(cs.of("\n")))), Chars(cs.LINE_BREAKS)))
        if c in "AzZbB":
            return At({"A": "start", "z": "end", "Z": "end_line_feed", "b": "word", "B": "not_word"}[c])
        if c == "N":
            if self.peek() == "{":
                self.fail("NamedUnicodeCharacterNotSupported", start)
            return Chars(cs.NOT_LINE_FEED)
        found = self.shared_escape(c, start)
        return self.literal(found) if isinstance(found, str) else found

    def named_back(self, end: str, start: int, kind: str):
        stop = self.p.find(end, self.at)
        name = self.p[self.at : stop] if stop >= 0 else ""
        if not name or not all(x.isalnum() or x == "_" for x in name):
            self.fail(kind, start)
        self.at = stop + 1
        if name not in self.names:
            self.fail("UnknownGroupName", start, self.at)
        return Back(self.names[name])

    def shared_escape(self, c: str, start: int) -> str | Chars:
        """Escapes that mean the same inside and outside of brackets: a character or a set."""
        if c in SINGLE:
            return SINGLE[c]
        if c in "dDwWsShH":
            wide = "u" in self.flags
            ranges = {"d": (cs.named("digit") or (cs.DIGIT,))[0] if wide else cs.DIGIT, "w": (cs.named("word") or (cs.WORD,))[0] if wide else cs.WORD, "s": cs.white_space(), "h": cs.HORIZONTAL}[c.lower()]
            return Chars(cs.complement(ranges) if c.isupper() else ranges)
        if c in "pP":
            return self.property(c == "P", start)
        if c == "x":
            return self.code(2, "InvalidHexEscape", start)
        if c == "u":
            return self.code(4, "InvalidUnicodeEscape", start)
        if c == "c":
            letter = self.peek()
            if not (letter.isascii() and letter.isalpha()):
                self.fail("InvalidControlEscape", start)
            self.at += 1
            return chr(ord(letter.upper()) ^ 0x40)
        if c.isascii() and not c.isalnum():
            return c
        self.fail("InvalidEscape", start, self.at)

    def code(self, digits: int, kind: str, start: int) -> str:
        if self.take("{"):
            end = self.p.find("}", self.at)
            found = self.p[self.at : end] if end >= 0 else ""
            self.at = end + 1
            fits = 1 <= len(found) <= 6
        else:
            found = self.peek(digits)
            self.at += digits
            fits = len(found) == digits
        if not fits or not set(found) <= HEX or int(found, 16) > cs.LAST or 0xD800 <= int(found, 16) <= 0xDFFF:
            self.fail(kind, start)
        return chr(int(found, 16))

    def property(self, negated: bool, start: int) -> Chars:
        if self.take("{"):
            end = self.p.find("}", self.at)
            name = self.p[self.at : end] if end >= 0 else ""
            self.at = end + 1 if end >= 0 else len(self.p)
        else:
            name = self.peek()
            self.at += 1
        if not name or not all(x.isascii() and x.isalnum() or x in "_-" for x in name):
            self.fail("InvalidUnicodeProperty", start)
        if (found := cs.named(name)) is None:
            self.fail("UnknownUnicodeProperty", start, self.at)
        ranges, java = found
        if "i" in self.flags:
            ranges, java = cs.folded(ranges), None
        if negated:
            return Chars(cs.complement(ranges), java and java.replace(r"\p", r"\P"))
        return Chars(ranges, java)

    # ---- brackets

    def bracket(self) -> Chars:
        start = self.at
        self.nest += 1
        if self.nest > self.nest_limit:
            self.fail("NestingTooDeep")
        self.at += 1
        negated = self.take("^")
        parts, javas = [], []
        if self.peek() == "]":
            self.at += 1
            parts.append(cs.of("]"))
            javas.append(None)
        elif self.peek() == "-" and self.peek(2) != "--":
            self.at += 1
            parts.append(cs.of("-"))
            javas.append(None)
        self.term(parts, javas, start)
        ranges, plain = cs.union(*parts), True
        while (op := self.peek(2)) in ("&&", "--", "~~"):
            where = self.at
            if not ranges:
                self.fail("InvalidClassSetOp", where, where + 2)
            self.at += 2
            right: list = []
            self.term(right, [], start)
            if not right:
                self.fail("InvalidClassSetOp", where, where + 2)
            ranges = {"&&": cs.intersection, "--": cs.difference, "~~": cs.symmetric_difference}[op](ranges, cs.union(*right))
            plain = False
        if not self.take("]"):
            self.fail("UnmatchedOpenBracket", start)
        if not parts:
            self.fail("EmptyClass", start)
        self.nest -= 1
        if "i" in self.flags:
            ranges, plain = cs.folded(ranges), False
        java = None
        if plain and any(javas):
            java = f"[{'^' * negated}{''.join(j or ranges_in_java(r) for r, j in zip(parts, javas))}]"
        return Chars(cs.complement(ranges) if negated else ranges, java)

    def term(self, parts: list, javas: list, start: int) -> None:
        """Members up to a set operation or the end of the bracket."""
        while True:
            if self.at >= len(self.p):
                self.fail("UnmatchedOpenBracket", start)
            if self.peek() == "]" or self.peek(2) in ("&&", "--", "~~"):
                return
            if self.peek() == "[" and self.peek(2) != "[:":
                inner = self.bracket()
                parts.append(inner.ranges)
                javas.append(inner.java)
                continue
            where = self.at
            one = self.member()
            if one is None:
                continue
            if isinstance(one, Chars):
                parts.append(one.ranges)
                javas.append(one.java)
            elif self.peek() == "-" and self.peek(2) != "--":
                self.at += 1
                if self.peek() == "]":
                    parts.append(cs.of(one + "-"))
                    javas.append(None)
                    continue
                other = self.member()
                if isinstance(other, Chars):
                    parts += [cs.of(one + "-"), other.ranges]
                    javas += [None, other.java]
                elif other is None:
                    self.fail("InvalidClassRange", where)
                else:
                    if one > other:
                        self.fail("InvalidClassRange", where, self.at)
                    parts.append(((ord(one), ord(other)),))
                    javas.append(None)
            else:
                parts.append(cs.of(one))
                javas.append(None)

    def member(self) -> str | Chars | None:
        start = self.at
        if start >= len(self.p):
            self.fail("UnmatchedOpenBracket", start)
        if self.take("[:"):
            return self.posix(start)
        c = self.peek()
        self.at += 1
        if c != "\\":
            return c
        c = self.peek()
        if not c:
            self.fail("UnexpectedEof", start)
        self.at += 1
        if c == "Q":
            end = self.p.find("\\E", self.at)
            body = self.p[self.at : end if end >= 0 else len(self.p)]
            self.at = len(self.p) if end < 0 else end + 2
            return Chars(cs.of(body)) if body else None
        if c == "E":
            return None
        if c == "b":
            return "\b"
        if c == "N" and self.peek() == "{":
            self.fail("NamedUnicodeCharacterNotSupported", start)
        if c in "RXNBAzZk123456789":
            self.fail("EscapeNotAllowedInClass", start, self.at)
        return self.shared_escape(c, start)

    def posix(self, start: int) -> Chars:
        negated = self.take("^")
        end = self.p.find(":]", self.at)
        if end < 0:
            self.fail("InvalidPosixClass", start)
        name = self.p[self.at : end]
        self.at = end + 2
        if name not in cs.POSIX:
            self.fail("UnknownPosixClass", start, self.at)
        ranges = cs.POSIX[name]
        return Chars(cs.complement(ranges) if negated else ranges)


# ---------------------------------------------------------------- facts


def nullable(n) -> bool:
    match n:
        case Seq(items):
            return all(map(nullable, items))
        case Alt(branches):
            return any(map(nullable, branches))
        case Rep(body, least, _, _):
            return least == 0 or nullable(body)
        case Group(body, _):
            return nullable(body)
        case Chars() | Cluster():
            return False
    return True  # places, lookarounds; a back reference may be to an empty group


def first(n) -> cs.Ranges:
    """Code points with which n can begin; all of them where that isn't known."""
    match n:
        case Chars(ranges, _):
            return ranges
        case Seq(items):
            out: cs.Ranges = ()
            for x in items:
                out = cs.union(out, first(x))
                if not nullable(x):
                    return out
            return out
        case Alt(branches):
            return cs.union(*map(first, branches))
        case Rep(body, _, most, _):
            return first(body) if most != 0 else ()
        case Group(body, _):
            return first(body)
        case At("end"):
            return ()
        case At("end_line_feed" | "line_end"):
            return cs.of("\n")
    return cs.ALL


def size(n) -> int:
    """Expanded elements, by which large patterns are refused."""
    match n:
        case Chars(ranges, _):
            return len(chr(ranges[0][0]).encode("utf-8", "surrogatepass")) if len(ranges) == 1 and ranges[0][0] == ranges[0][1] else 1
        case Seq(items):
            return max(1, sum(map(size, items)))
        case Alt(branches):
            return sum(map(size, branches))
        case Rep(body, least, most, _):
            return size(body) * max(least if most is None else most, 1)
        case Group(body, _) | Look(body, _, _):
            return size(body)
        case Back():
            return 2
    return 1


def children(n) -> tuple:
    match n:
        case Seq(items):
            return items
        case Alt(branches):
            return branches
        case Rep(body, _, _, _) | Group(body, _) | Look(body, _, _):
            return (body,)
    return ()


def walk(n):
    yield n
    for x in children(n):
        yield from walk(x)


def one_way(n, after: cs.Ranges) -> bool:
    """No choice within n is ever open: the next code point decides each branch and the end of each loop."""
    match n:
        case Chars():
            return True
        case Seq(items):
            for i, x in enumerate(items):
                rest = Seq(items[i + 1 :])
                if not one_way(x, cs.union(first(rest), after) if nullable(rest) else first(rest)):
                    return False
            return True
        case Alt(branches):
            starts = [first(b) for b in branches]
            apart = all(not cs.intersection(a, b) for i, a in enumerate(starts) for b in starts[:i])
            return apart and not any(map(nullable, branches)) and all(one_way(b, after) for b in branches)
        case Rep(body, least, most, _):
            return not nullable(body) and (least == most or not cs.intersection(first(body), after)) and one_way(body, cs.union(first(body), after))
        case Group(body, _):
            return one_way(body, after)
    return False


def always(n, index: int) -> bool:
    """Group index takes part in every match."""
    match n:
        case Group(body, i):
            return i == index or always(body, index)
        case Seq(items):
            return any(always(x, index) for x in items)
        case Rep(body, least, _, _):
            return least > 0 and always(body, index)
    return False


def literal_of(n) -> str | None:
    """The only text that n matches, if there is one."""
    match n:
        case Chars(ranges, _) if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
            return chr(ranges[0][0])
        case Seq(items):
            parts = [literal_of(x) for x in items]
            return None if None in parts else "".join(parts)
        case Group(body, _):
            return literal_of(body)
    return None


def required_literal(n) -> str:
    """The longest text that every match holds, or has right after it."""
    items, best, run = n.items if isinstance(n, Seq) else (n,), "", ""
    for x in items:
        found = literal_of(x)
        if found is not None:
            run += found
        elif not isinstance(x, At):  # places take no text
            run = ""
            inner = x.body if isinstance(x, Group) or isinstance(x, Rep) and x.least > 0 or isinstance(x, Look) and not x.negated else None
            if inner is not None:
                best = max(best, required_literal(inner), key=len)
        best = max(best, run, key=len)
    return best


def looked(n) -> frozenset[int]:
    """Groups inside lookarounds: what they match doesn't come out."""
    return frozenset(x.index for look in walk(n) if isinstance(look, Look) for x in walk(look.body) if isinstance(x, Group))


def sealed(n, hidden: frozenset[int]):
    """n with references to groups of other lookarounds as what never matches."""
    match n:
        case Back(index) if index in hidden:
            return Chars(())
        case Look(body, ahead, negated):
            own = frozenset(x.index for x in walk(body) if isinstance(x, Group)) - looked(body)
            return Look(sealed(body, hidden - own), ahead, negated)
        case Seq(items):
            return Seq(tuple(sealed(x, hidden) for x in items))
        case Alt(branches):
            return Alt(tuple(sealed(x, hidden) for x in branches))
        case Rep(body, least, most, greedy):
            return Rep(sealed(body, hidden), least, most, greedy)
        case Group(body, index):
            return Group(sealed(body, hidden), index)
    return n


# ---------------------------------------------------------------- spelling


def code_in_java(c: int) -> str:
    return chr(c) if chr(c).isascii() and chr(c).isalnum() else f"\\x{{{c:X}}}"


def code_in_python(c: int) -> str:
    return chr(c) if chr(c).isascii() and chr(c).isalnum() else f"\\U{c:08X}"


def ranges_in_java(ranges: cs.Ranges, code=code_in_java) -> str:
    return "".join(code(a) if a == b else f"{code(a)}-{code(b)}" for a, b in ranges)


_WORD = "[0-9A-Za-z_]"
#: Iterations of a loop over a group that Java's stack bears.
SHALLOW = 250


class Speller:
    """Spells a node for Java (or the regex module, with python); kept: the groups that stay capturing."""

    def __init__(self, parsed: Parsed, kept: set[int], python: bool = False):
        self.python = python
        self.code = code_in_python if python else code_in_java
        backs = {n.index for n in walk(parsed.node) if isinstance(n, Back)}
        self.number = {g: i for i, g in enumerate(sorted(kept | backs), 1)}
        self.deep: list[str] = []  # why Java can't run it
        self.loops = 0
        self.text = self.head(parsed.node)

    def set(self, n: Chars) -> str:
        if n.java and not self.python:
            return n.java
        if not n.ranges:
            return f"(?!){self.set(Chars(cs.ALL))}"
        if len(n.ranges) == 1 and n.ranges[0][0] == n.ranges[0][1]:
            return self.code(n.ranges[0][0])
        outside = cs.complement(n.ranges)
        if outside and len(outside) < len(n.ranges):
            return f"[^{ranges_in_java(outside, self.code)}]"
        return f"[{ranges_in_java(n.ranges, self.code)}]"

    def place(self, place: str) -> str:
        end = "(?![\\U00000000-\\U0010FFFF])" if self.python else "\\z"
        feed = self.code(10)
        boundary = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
        inside = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
        return {"start": "\\A", "end": end, "end_line_feed": f"(?={feed}?{end})", "line_start": f"(?<![^{feed}])", "line_end": f"(?![^{feed}])", "word": boundary, "not_word": inside}[place]

    def side(self, items: tuple, i: int) -> str | None:
        """A word's edge next to an item that is a word character (or none) for sure: one look is enough."""
        before, after = (items[j] if 0 <= j < len(items) else None for j in (i - 1, i + 1))
        for x, word, other in ((after, f"(?<!{_WORD})", f"(?<={_WORD})"), (before, f"(?!{_WORD})", f"(?={_WORD})")):
            ranges = x.ranges if isinstance(x, Chars) else x.body.ranges if isinstance(x, Rep) and x.least > 0 and isinstance(x.body, Chars) else ()
            if ranges:
                if not cs.intersection(ranges, cs.complement(cs.WORD)):
                    return word
                if not cs.intersection(ranges, cs.WORD):
                    return other
        return None

    def head(self, n) -> str:
        """The whole pattern, begun so that few places are tried.

        A literal after a word's edge is tried first, and what stands before it then. A run of one set's characters
        which ends where something else must follow fails from all its places if it fails from its first: the run's
        start, or the end of the match before, if that lies inside the run."""
        items = n.items if isinstance(n, Seq) else ()
        if self.python or len(items) < 2:
            return self.spell(n, ())
        if items[0] == At("word"):
            size = next((i for i, x in enumerate(items[1:]) if literal_of(x) is None or not isinstance(x, Chars)), len(items) - 1)
            text = items[1 : size + 1]
            if text and not any(cs.intersection(x.ranges, cs.complement(cs.WORD)) for x in text):
                spelled = "".join(map(self.set, text))
                # the rest still sees the last of the text before it
                rest = self.spell(Seq(items[size:]), ())[len(self.set(items[size])) :]
                return f"{spelled}(?<!{_WORD}{spelled}){rest}"
        x = items[0]
        if isinstance(x, Group) and not any(isinstance(y, Back) and y.index == x.index for y in walk(n)):
            x = x.body
        run = isinstance(x, Rep) and isinstance(x.body, Chars) and x.body.ranges and x.least > 0 and x.most is None and x.greedy
        if run and (not nullable(Seq(items[1:])) or any(isinstance(y, Look | At) for y in items[1:])):
            return f"(?:(?<!{self.set(x.body)})|\\G){self.spell(n, ())}"
        return self.spell(n, ())

    def spell(self, n, after: cs.Ranges) -> str:
        match n:
            case Chars():
                return self.set(n)
            case Seq(items):
                out = []
                for i, x in enumerate(items):
                    rest = Seq(items[i + 1 :])
                    if x == At("word") and not self.python and (side := self.side(items, i)):
                        out.append(side)
                        continue
                    out.append(self.spell(x, cs.union(first(rest), after) if nullable(rest) else first(rest)))
                    if isinstance(x, Alt):
                        out[-1] = f"(?:{out[-1]})"
                return "".join(out)
            case Alt(branches):
                return "|".join(self.spell(b, after) for b in branches)
            case Group(body, index):
                named = f"?P<g{self.number[index]}>" if self.python and index in self.number else ""
                return f"({named if index in self.number else '?:'}{self.spell(body, after)})"
            case Look(body, ahead, negated):
                if not ahead and any(isinstance(x, Rep) and x.most is None for x in walk(body)):
                    self.deep.append("unbounded lookbehind")
                return f"(?{'' if ahead else '<'}{'!' if negated else '='}{self.spell(body, cs.ALL)})"
            case Back(index):
                return f"(?P=g{self.number[index]})" if self.python else f"\\{self.number[index]}(?:)"
            case At(place):
                return self.place(place)
            case Cluster():
                self.deep.append("grapheme cluster")
                return "\\X"
            case Rep():
                return self.loop(n, after)
        raise TypeError(n)

    def loop(self, n: Rep, after: cs.Ranges) -> str:
        bounds = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((n.least, n.most)) or f"{{{n.least}{'' if n.most == n.least else ',' if n.most is None else f',{n.most}'}}}"
        lazy = "" if n.greedy else "?"
        if isinstance(n.body, Chars):
            return f"{self.set(n.body)}{bounds}{lazy}"
        body = self.spell(n.body, cs.union(first(n.body), after))
        if self.python and n.greedy and n.least <= 1 and n.most != 1 and nullable(n.body) and any(isinstance(x, Group) and x.index in self.number for x in walk(n.body)):
            return self.filled(body, n)
        if n.most is None or n.most > SHALLOW:
            decided = not nullable(n.body) and not cs.intersection(first(n.body), after) and one_way(n.body, cs.union(first(n.body), after))
            if decided and n.greedy:
                lazy = "+"  # giving iterations back can't help, so Java needs no stack for them
            else:
                self.deep.append("deep loop")
        return f"{body}{bounds}{lazy}" if isinstance(n.body, Group) else f"(?:{body}){bounds}{lazy}"


    def filled(self, body: str, n: Rep) -> str:
        """A loop whose iterations after the first must take text, and which ends after a first one that takes none; so
        groups keep what they last took. What is left of the text tells whether an iteration took any."""
        self.loops += 1
        one, more = f"r{self.loops}a", f"r{self.loops}b"
        left = lambda name: f"(?P={name})\\Z"
        again = f"(?:(?=(?P<{more}>[\\s\\S]*))(?:{body})(?!{left(more)})){'*' if n.most is None else f'{{0,{n.most - 1}}}'}"
        return f"(?:(?=(?P<{one}>[\\s\\S]*))(?:{body})(?:(?!{left(one)}){again}|(?={left(one)}))){'' if n.least else '?'}"


def parse(pattern: str, size_limit: int = SIZE_LIMIT, nest_limit: int = NEST_LIMIT) -> Parsed:
    parsed = Reader(pattern, nest_limit).read()
    if size(parsed.node) > size_limit:
        raise PatternError("ExpansionTooLarge", pattern, 0, len(pattern))
    return parsed
