"""Compiled patterns as column functions.

compile(pattern) reads the dialect on the driver; a Pattern's methods give ordinary Columns over Spark's own functions.
route() says how: literal (contains, startsWith, ...), native (the JVM's matcher, on a spelling that means the same), or
outside (an Arrow UDF), for what the JVM's matcher can't run exactly or within its stack. Null text gives null.
"""

from __future__ import annotations

import builtins
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import dialect
from .dialect import Alt, At, Seq, Speller, always, literal_of, nullable, required_literal
from .outside import MATCH, Places, found, search

#: Characters that `escape` leaves a backslash before (fixed values of the dialect), and those with a letter of their own.
SPECIAL, LETTERS = "\\.*+?|^$()[]{}#", {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape(text: str) -> str:
    """A pattern that matches the text itself."""
    return "".join(LETTERS.get(c) or (f"\\{c}" if c in SPECIAL or c in " \f" else c) for c in text)


def escape_column(text: Column) -> Column:
    """escape() of each value."""
    out = F.regexp_replace(text, r"([\\.*+?|^$()\[\]{}# \f])", r"\\$1")
    for c, spelled in LETTERS.items():
        out = F.replace(out, F.lit(c), F.lit(spelled))
    return out


@dataclass(frozen=True)
class Options:
    """size_limit and nest_limit bound the pattern, seconds a search outside the JVM; jit and optimize_prefixes are Spark's and the speller's own business."""

    size_limit: int = dialect.SIZE_LIMIT
    nest_limit: int = dialect.NEST_LIMIT
    seconds: float | None = 10.0
    jit: bool = False
    optimize_prefixes: bool = False


class Pattern:
    def __init__(self, pattern: str, options: Options = Options()):
        self.pattern, self.options = pattern, options
        self.parsed = dialect.parse(pattern, options.size_limit, options.nest_limit)
        self.unseen = dialect.looked(self.parsed.node)
        self.node = dialect.sealed(self.parsed.node, self.unseen)
        self.node = merged(self.node) if options.optimize_prefixes else self.node
        self.nullable = nullable(self.node)
        self._whole = self._spelled(builtins.set())
        self.needed = required_literal(self.node)

    def _spelled(self, kept: builtins.set[int], python: bool = False) -> Speller:
        return Speller(dialect.Parsed(self.node, self.parsed.groups, self.parsed.names), kept, python)

    # ---- what it is

    def __repr__(self) -> str:
        return f"Pattern({self.pattern!r}, route={self.route()!r})"

    def as_str(self) -> str:
        return self.pattern

    def capture_names(self) -> list[str]:
        """Names of groups, by their numbers."""
        return sorted(self.parsed.names, key=self.parsed.names.get)

    @property
    def group_count(self) -> int:
        return self.parsed.groups

    def route(self, op: str = "is_match") -> str:
        if op == "is_match" and self._literal() is not None:
            return "literal"
        return "outside" if self._reasons(op) else "native"

    engine_name = route

    def explain(self, op: str = "is_match") -> str:
        return f"{self.route(op)}: {', '.join(self._reasons(op)) or self._java()}"

    def _reasons(self, op: str) -> list[str]:
        out = list(dict.fromkeys(self._whole.deep))
        if op in ("captures", "captures_all", "capture_spans"):
            if any(nullable(n.body) and not always(self.node, n.index) and n.index not in self.unseen for n in dialect.walk(self.node) if isinstance(n, dialect.Group)):
                out.append("a group may take no part or match nothing")  # the JVM's functions give the same text for both
            elif any(isinstance(n, dialect.Rep) and nullable(n.body) and any(isinstance(x, dialect.Group) for x in dialect.walk(n)) for n in dialect.walk(self.node)):
                out.append("group in a loop that may match nothing")
        if op == "capture_spans" and not out and self._pieces() is None:
            out.append("a group inside a loop or a branch")
        return out

    def _literal(self) -> tuple[str, bool, bool] | None:
        """(text, bound to the start, bound to the end) if that is all there is."""
        items = list(self.node.items) if isinstance(self.node, Seq) else [self.node]
        start = bool(items) and items[0] == At("start")
        items = items[start:]
        end = bool(items) and items[-1] == At("end")
        text = literal_of(Seq(tuple(items[: len(items) - end])))
        return None if not text else (text, start, end)

    def _java(self, kept: builtins.set[int] = frozenset()) -> str:
        return self._guarded(self._spelled(builtins.set(kept)).text if kept else self._whole.text)

    def _guarded(self, java: str) -> str:
        """The JVM also looks for empty matches between the halves of a character, and right after a match: neither counts."""
        return f"(?![\\x{{DC00}}-\\x{{DFFF}}])(?>{java})(?:(?!\\G)|\\A)" if self.nullable else java

    def _before(self, text: Column) -> Column:
        """What comes before the first match; only where there is one."""
        if self.nullable:  # split() drops an empty text before an empty match
            return F.regexp_extract(text, f"\\A[\\s\\S]*?(?={self._java()})", 0)
        return F.split(text, self._java(), 2)[0]

    def _first(self, text: Column, java: str) -> Column:
        """The first match's text, or null."""
        if self.nullable:
            return F.when(text.rlike(java), F.regexp_extract(text, java, 0))
        return F.regexp_substr(text, F.lit(java))

    def _outside(self, op: str, text: Column, kept: builtins.set[int] = frozenset(), **more) -> Column:
        return search(op, self._spelled(builtins.set(kept), python=True).text, text, seconds=self.options.seconds, **more)

    def _sifted(self, text: Column, found: Column) -> Column:
        """found, tested only where the text holds what every match holds; contains() also reaches the Parquet scan."""
        return (F.contains(text, F.lit(self.needed)) & found) if self.needed else found

    def _where(self, text: Column, found: Column, empty: Column | None = None) -> Column:
        """found, searched only where the text holds what every match holds; else empty."""
        if not self.needed:
            return found
        sifted = F.when(F.contains(text, F.lit(self.needed)), found)
        return sifted if empty is None else sifted.when(text.isNotNull(), empty)

    def _alone(self) -> bool:
        """A match says nothing about what is around it, so it can be taken apart by itself."""
        return not any(isinstance(n, dialect.Look | At) for n in dialect.walk(self.node))

    # ---- tests and matches

    def is_match(self, text: Column) -> Column:
        if (literal := self._literal()) is not None:
            value, start, end = literal
            return text == value if start and end else text.startswith(value) if start else text.endswith(value) if end else F.contains(text, F.lit(value))
        if self._reasons("is_match"):
            return self._sifted(text, self._outside("is_match", text))
        return self._sifted(text, text.rlike(self._java()))

    def count(self, text: Column) -> Column:
        if self._reasons("count"):
            return self._outside("count", text)
        return self._where(text, F.regexp_count(text, F.lit(self._java())), F.lit(0))

    def find_text(self, text: Column) -> Column:
        """The first match's text, or null."""
        if self._reasons("find"):
            return self._outside("find", text).getField("text")
        return self._where(text, self._first(text, self._java()))

    def find(self, text: Column) -> Column:
        """The first match: start and end in bytes, text; null if there is none."""
        if self._reasons("find"):
            return self._outside("find", text)
        value = self._where(text, self._first(text, self._java()))
        start = F.octet_length(self._before(text))
        return F.when(value.isNotNull(), F.struct(start.alias("start"), (start + F.octet_length(value)).alias("end"), value.alias("text"))).otherwise(F.lit(None).cast(MATCH))

    def find_all(self, text: Column) -> Column:
        """Texts of all matches."""
        if self._reasons("find_all"):
            return self._outside("find_all", text)
        return self._where(text, F.regexp_extract_all(text, F.lit(self._java()), F.lit(0)), F.array().cast("array<string>"))

    def spans(self, text: Column) -> Column:
        """All matches as start, end (bytes), text."""
        if self._reasons("find_all"):
            return self._outside("spans", text)
        java = F.lit(self._java())
        both = F.struct(F.split(text, java, -1).alias("gaps"), F.regexp_extract_all(text, java, F.lit(0)).alias("texts"))
        placed = bound(both, lambda b: _placed_pieces(b["gaps"], b["texts"]))
        return self._where(text, F.when(text.isNotNull(), placed), F.array().cast(ArrayType(MATCH)))

    # ---- groups

    def _names(self) -> list[str]:
        by_number = {i: n for n, i in self.parsed.names.items()}
        return ["match", *(by_number.get(g, f"group{g}") for g in range(1, self.group_count + 1))]

    def _value(self, found: Column, java: str, g: int) -> Column:
        """Group g of the first match in found (the match itself with 0)."""
        return F.lit(None).cast("string") if g in self.unseen else self._took(F.regexp_extract(found, java, g), g)

    def _took(self, value: Column, g: int) -> Column:
        """A group that may take no part matches some text if it does: so no text is none."""
        return F.nullif(value, F.lit("")) if g and not always(self.node, g) else value

    def captures(self, text: Column, spans: bool = False) -> Column:
        """A struct of the first match and its groups by name (group<n> without one); null for groups that took no part."""
        kept, names = builtins.set(range(1, self.group_count + 1)), self._names()
        if self._reasons("capture_spans" if spans else "captures"):
            return self._outside("captures", text, kept, names=names, spans=spans, unseen=self.unseen)
        if spans:
            return self._placed(text, self.find(text))
        java = self._java(kept)
        if self._alone():  # the text is searched once, its match taken apart
            first = self._where(text, self._first(text, java))
            return F.when(first.isNotNull(), self._apart(first, java))
        groups = F.struct(*[self._value(text, java, i).alias(n) for i, n in enumerate(names)])
        return self._where(text, F.when(text.rlike(java), groups))

    def _apart(self, found: Column, java: str) -> Column:
        names = self._names()
        return F.struct(found.alias(names[0]), *[self._value(found, java, i).alias(n) for i, n in enumerate(names) if i])

    def _pieces(self) -> tuple[str, dict[int, int], dict[int, list[int]]] | None:
        """A spelling in which all pieces of a match are groups, its numbers of the pattern's groups, and for each of these
        the numbers of the pieces before it;
        None if a group stands inside a loop (but that of a group alone, taken once or not), a branch or a look."""
        before: dict[int, list[int]] = {}
        count = self.group_count

        def held(n) -> bool:
            return any(isinstance(x, dialect.Group) and x.index not in self.unseen for x in dialect.walk(n))

        def pieced(n, done: list[int]):
            """n with all of it in groups; done: pieces before it, and then n's too."""
            nonlocal count
            match n:
                case dialect.Rep(dialect.Group(body, index), 0, 1, _) if not held(body):
                    before[index] = list(done)
                    done.append(index)
                    return n
                case dialect.Group(body, index):
                    before[index] = list(done)
                    inner = pieced(body, list(done)) if held(body) else body
                    done.append(index)
                    return None if inner is None else dialect.Group(inner, index)
                case Seq(items) if held(n):
                    out = [pieced(x, done) for x in items]
                    return None if None in out else Seq(tuple(out))
            if held(n):
                return None
            if isinstance(n, dialect.Look | At):
                return n
            count += 1
            done.append(count)
            return dialect.Group(n, count)

        node = pieced(self.node, [])
        if node is None:
            return None
        number = {n.index: i for i, n in enumerate((n for n in dialect.walk(node) if isinstance(n, dialect.Group)), 1)}
        spelled = Speller(dialect.Parsed(numbered(node, number), count, self.parsed.names), builtins.set(number.values()))
        return None if spelled.deep else (spelled.text, number, {g: [number[x] for x in pieces] for g, pieces in before.items()})

    def _placed(self, text: Column, found: Column) -> Column:
        """The groups of a match (start, end, text) placed by the lengths of the pieces before them."""
        spelled, number, before = self._pieces()
        java, alone = self._guarded(spelled), self._alone()
        source = found["text"] if alone else text
        size = lambda g: F.octet_length(F.regexp_extract(source, java, g))
        whole = [found.alias(self._names()[0])]
        for g, name in enumerate(self._names()):
            if g:
                value = F.lit(None).cast("string") if g in self.unseen else self._took(F.regexp_extract(source, java, number[g]), g)
                start = found["start"] + sum(map(size, before.get(g, [])), F.lit(0))
                placed = F.struct(start.cast("int").alias("start"), (start + F.octet_length(value)).cast("int").alias("end"), value.alias("text"))
                whole.append(F.when(value.isNotNull(), placed).otherwise(F.lit(None).cast(MATCH)).alias(name))
        return F.when(found.isNotNull(), F.struct(*whole))

    def captures_all(self, text: Column, spans: bool = False) -> Column:
        kept, names = builtins.set(range(1, self.group_count + 1)), self._names()
        if spans and self._alone() and not self._reasons("capture_spans"):
            return F.transform(self.spans(text), lambda m: self._placed(text, m))
        if spans or self._reasons("captures_all"):
            return self._outside("captures_all", text, kept, names=names, spans=spans, unseen=self.unseen)
        java = self._java(kept)
        none = F.array().cast(ArrayType(StructType([StructField(n, StringType()) for n in names])))
        if self._alone():
            groups = F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(0)), lambda m: self._apart(m, java))
        else:
            each = lambda i: F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(0 if i in self.unseen else i)), lambda v: F.lit(None).cast("string") if i in self.unseen else self._took(v, i))
            groups = F.arrays_zip(*[each(i).alias(n) for i, n in enumerate(names)])
        return self._where(text, groups, none)

    def group(self, text: Column, which: int | str, strict: bool = False) -> Column:
        """One group of the first match; strict: an absent one is an error."""
        name = self._names()[which] if isinstance(which, int) else which
        if name not in self._names():
            raise KeyError(name)
        value = self.captures(text).getField(name)
        return F.when(value.isNotNull() | text.isNull(), value).otherwise(F.raise_error(F.lit(f"no group {name}")).cast("string")) if strict else value

    # ---- replacement (the replacement is plain text)

    def replace(self, text: Column, by: str) -> Column:
        """The first match replaced."""
        if self._reasons("replace"):
            return self._outside("replace", text, by=by)
        if self.nullable:
            before, value = self._before(text), F.regexp_extract(text, self._java(), 0)
            rest = F.substring(text, F.char_length(before) + F.char_length(value) + 1, F.char_length(text))
            return self._where(text, F.when(text.rlike(self._java()), F.concat(before, F.lit(by), rest)).otherwise(text), text)
        parts = F.split(text, self._java(), 2)
        return self._where(text, F.when(text.rlike(self._java()), F.concat(parts[0], F.lit(by), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise(text), text)

    def replace_all(self, text: Column, by: str) -> Column:
        if self._reasons("replace_all"):
            return self._outside("replace_all", text, by=by)
        return self._where(text, F.regexp_replace(text, self._java(), by.replace("\\", "\\\\").replace("$", "\\$")), text)

    # ---- with a limit: {value, error}

    def _tried(self, op: str, text: Column, value: Column) -> Column | None:
        """value and no error, where the search can't run long: natively, and without references."""
        if self._reasons(op) or any(isinstance(n, dialect.Back) for n in dialect.walk(self.node)):
            return None
        return F.when(text.isNotNull(), F.struct(value.alias("value"), F.lit(None).cast("string").alias("error")))

    def try_is_match(self, text: Column) -> Column:
        tried = self._tried("is_match", text, self.is_match(text))
        return self._outside("is_match", text, as_error=True) if tried is None else tried

    def try_find(self, text: Column) -> Column:
        tried = self._tried("find", text, self.find(text))
        return self._outside("find", text, as_error=True) if tried is None else tried

    def try_captures(self, text: Column, spans: bool = False) -> Column:
        if (tried := self._tried("capture_spans" if spans else "captures", text, self.captures(text, spans))) is not None:
            return tried
        kept = builtins.set(range(1, self.group_count + 1))
        return self._outside("captures", text, kept, names=self._names(), spans=spans, unseen=self.unseen, as_error=True)


#: Matches of a text that are placed by one running sum; sums of such blocks are added up by another.
BLOCK = 16


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(items: Column, start: Column, size, told, kind: str) -> Column:
    """told(item, what comes before it) of each item, where size(item) adds up from start. It copies what it has for each item, so
    items are few."""
    begin = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(items, begin, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.array_append(acc["out"], told(x, acc["at"])).alias("out")), lambda acc: acc["out"])


def _placed_pieces(gaps: Column, texts: Column) -> Column:
    """start, end and text of matches from the texts between them and their own."""
    n = F.size(texts)
    # a text that starts with an empty match has no gap before it in split()
    gaps = F.when(F.size(gaps) == n, F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
    items = F.zip_with(F.slice(gaps, F.lit(1), n), texts, lambda g, t: F.struct(F.octet_length(g).alias("gap"), F.octet_length(t).alias("size"), t.alias("text")))
    blocks = bound(items, lambda items: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK))))
    whole = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + x["size"])
    one = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["text"].alias("text"))
    match = "array<struct<start:int,end:int,text:string>>"

    def placed(blocks: Column) -> Column:
        starts = _running(F.transform(blocks, whole), F.lit(0), lambda x: x, lambda x, at: at, "array<int>")
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: _running(block, at, lambda x: x["gap"] + x["size"], one, match)))

    return F.when(n > 0, bound(blocks, placed)).otherwise(F.array().cast(match))


def match_length(match: Column) -> Column:
    """Bytes of a match (start, end, text)."""
    return match.getField("end") - match.getField("start")


def match_is_empty(match: Column) -> Column:
    return match.getField("end") == match.getField("start")


def match_bytes(match: Column) -> Column:
    """The match's text in UTF-8."""
    return F.encode(match.getField("text"), "UTF-8")


def merged(n):
    """Neighbouring literal branches with a common start share it: the|them|they becomes the(?:|m|y); order is kept."""
    if isinstance(n, Alt):
        out: list = []
        for b in map(merged, n.branches):
            items = b.items if isinstance(b, Seq) else (b,)
            before = out[-1] if out else ()
            if before and items and before[0] == items[0] and isinstance(items[0], dialect.Chars):
                rest = merged(Alt((_tail(before), Seq(items[1:]))))
                out[-1] = (items[0], rest)
            else:
                out.append(items)
        branches = tuple(Seq(x) if len(x) != 1 else x[0] for x in out)
        return branches[0] if len(branches) == 1 else Alt(branches)
    match n:
        case Seq(items):
            return Seq(tuple(map(merged, items)))
        case dialect.Group(body, index):
            return dialect.Group(merged(body), index)
        case dialect.Rep(body, least, most, greedy):
            return dialect.Rep(merged(body), least, most, greedy)
    return n


def numbered(n, number: dict[int, int]):
    """n with other numbers of its groups."""
    match n:
        case dialect.Group(body, index):
            return dialect.Group(numbered(body, number), number[index])
        case dialect.Back(index):
            return dialect.Back(number.get(index, index))
        case Seq(items):
            return Seq(tuple(numbered(x, number) for x in items))
        case Alt(branches):
            return Alt(tuple(numbered(x, number) for x in branches))
        case dialect.Rep(body, least, most, greedy):
            return dialect.Rep(numbered(body, number), least, most, greedy)
        case dialect.Look(body, ahead, negated):
            return dialect.Look(numbered(body, number), ahead, negated)
    return n


def _tail(items: tuple):
    return items[1] if len(items) == 2 and isinstance(items[1], Alt) else Seq(items[1:])


@lru_cache(maxsize=256)
def _searcher(pattern: str, seconds: float | None):
    p = compile(pattern, seconds=seconds)
    return p._spelled(builtins.set(), python=True).text


def rows_of(pattern: str, text: str, seconds: float | None = 10.0) -> list[dict]:
    """start, end (bytes) and text of all matches in one text, outside Spark's functions."""
    places = Places(text)
    return [places.place(m) for m in found(_searcher(pattern, seconds), text, seconds)]


def compile(pattern: str, **options) -> Pattern:  # noqa: A001
    return Pattern(pattern, Options(**options))
