"""The few searches that the JVM's matcher can't run safely or exactly, as Arrow UDFs over the regex module."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from .errors import MatchLimitExceeded

MATCH = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())])


@lru_cache(maxsize=256)
def _compiled(spelled: str) -> regex.Pattern:
    return regex.compile(spelled, regex.V0)


def found(spelled: str, text: str, seconds: float | None) -> Iterator[regex.Match]:
    """All matches. After one, the search goes on at its end, after an empty one at the next character; an empty match
    at the end of the match before it is no match. seconds: for all searches in the text together, not for what the
    caller does between them."""
    pattern, at, last, left = _compiled(spelled), 0, -1, seconds
    try:
        while at <= len(text):
            begun = time.monotonic()
            if (m := pattern.search(text, at, timeout=left)) is None:
                return
            if left is not None:
                left = max(left - (time.monotonic() - begun), 1e-9)
            start, end = m.span()
            if not start == end == last:
                yield m
            last, at = end, max(end, start + 1)
    except TimeoutError as e:
        raise MatchLimitExceeded(f"over {seconds} s on {len(text)} characters") from e


class Places:
    """Byte offsets of matches that come in order: each stretch of the text is encoded once."""

    def __init__(self, text: str):
        self.text, self.at, self.byte, self.plain = text, 0, 0, text.isascii()

    def of(self, at: int) -> int:
        if self.plain:
            return at
        self.byte += len(self.text[self.at : at].encode("utf-8")) if at >= self.at else -len(self.text[at : self.at].encode("utf-8"))
        self.at = at
        return self.byte

    def place(self, m: regex.Match, group: int | str = 0) -> dict | None:
        """Byte offsets and text of a group; None if it took no part."""
        start, end = m.span(group)
        return None if start < 0 else {"start": self.of(start), "end": self.of(end), "text": m.group(group)}


def _groups(m: regex.Match, places: Places | None, names: list[str], unseen: frozenset[int]) -> dict:
    of = lambda i: f"g{i}" if i else 0
    return {n: None if i in unseen else places.place(m, of(i)) if places else m.group(of(i)) for i, n in enumerate(names)}


def _replaced(spelled: str, text: str, by: str, most: int, seconds: float | None) -> str:
    out, at = [], 0
    for i, m in enumerate(found(spelled, text, seconds)):
        if i == most:
            break
        out += [text[at : m.start()], by]
        at = m.end()
    return "".join([*out, text[at:]])


def search(op: str, spelled: str, text: Column, names: list[str] | None = None, spans: bool = False, unseen: frozenset[int] = frozenset(), by: str = "", seconds: float | None = None, as_error: bool = False) -> Column:
    """op: is_match, find, find_all, spans, count, captures, captures_all, replace, replace_all. unseen: groups that are null always. as_error: {value, error} instead of failing."""
    names = names or []
    one = StructType([StructField(n, MATCH if spans else StringType()) for n in names])
    kinds: dict[str, DataType] = {"is_match": BooleanType(), "find": MATCH, "find_all": ArrayType(StringType()), "spans": ArrayType(MATCH), "count": IntegerType(), "captures": one, "captures_all": ArrayType(one), "replace": StringType(), "replace_all": StringType()}
    kind = StructType([StructField("value", kinds[op]), StructField("error", StringType())]) if as_error else kinds[op]

    def value(t: str):
        matches = found(spelled, t, seconds)
        match op:
            case "is_match":
                return next(matches, None) is not None
            case "find":
                return Places(t).place(m) if (m := next(matches, None)) else None
            case "find_all":
                return [m.group() for m in matches]
            case "spans":
                places = Places(t)
                return [places.place(m) for m in matches]
            case "count":
                return sum(1 for _ in matches)
            case "captures":
                return _groups(m, Places(t) if spans else None, names, unseen) if (m := next(matches, None)) else None
            case "captures_all":
                places = Places(t) if spans else None
                return [_groups(m, places, names, unseen) for m in matches]
            case "replace":
                return _replaced(spelled, t, by, 1, seconds)
        return _replaced(spelled, t, by, -1, seconds)

    def tried(t: str):
        try:
            return {"value": value(t), "error": None}
        except MatchLimitExceeded as e:
            return {"value": None, "error": f"MatchLimitExceeded: {e}"}

    def run(texts: pa.Array) -> pa.Array:
        each = tried if as_error else value
        return pa.array([None if t is None else each(t) for t in texts.to_pylist()], type=arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return F.arrow_udf(run, kind)(text)
