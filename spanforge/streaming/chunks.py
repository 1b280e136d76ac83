"""Matches in texts that arrive in pieces, and sessions of matches.

A text's chunks come in any order and over any number of batches. What the state keeps of a text is its undecided end: the
characters from which a match could still start or that one could look back to, which the pattern's width bounds, and
chunks that have come before their turn. So the matches are those of the whole text, however it is cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import dialect
from ..functions.outside import _compiled
from ..functions.patterns import Pattern

#: The state store that keyed state of this kind needs (fixed name).
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FOUND = "match_no int, start long, end long, text string"


def reach(node) -> tuple[int, int, int] | None:
    """Characters that a match may hold, see before its start and see after its end, at most; None if there is no bound."""
    groups = {x.index: x.body for x in dialect.walk(node) if isinstance(x, dialect.Group)}

    def width(n, within: frozenset[int] = frozenset()) -> float:
        match n:
            case dialect.Chars():
                return 1
            case dialect.Seq(items):
                return sum(width(x, within) for x in items)
            case dialect.Alt(branches):
                return max((width(b, within) for b in branches), default=0)
            case dialect.Rep(body, _, most, _):
                one = width(body, within)
                return 0 if not one else float("inf") if most is None else one * most
            case dialect.Group(body, _):
                return width(body, within)
            case dialect.Back(index):
                return float("inf") if index in within or index not in groups else width(groups[index], within | {index})
            case dialect.Look() | dialect.At():
                return 0
        return float("inf")

    def looks(n, ahead: bool) -> float:
        if isinstance(n, dialect.At):
            return 2 if n == dialect.At("end_line_feed") and ahead else 1
        inner = max((looks(x, ahead) for x in dialect.children(n)), default=0)
        # what a look sees from its place, and what looks inside it see from its end or start
        return inner + width(n.body) if isinstance(n, dialect.Look) else inner

    sizes = width(node), looks(node, False), looks(node, True)
    return None if float("inf") in sizes else tuple(map(int, sizes))


class Undecided:
    """A text's end that is still undecided, and where the search in it goes on."""

    def __init__(self, saved: str | None = None):
        self.text, self.byte, self.at, self.last, self.match_no, self.turn, self.waiting, self.ended = json.loads(saved) if saved else ("", 0, 0, -1, 0, None, {}, False)

    def saved(self) -> str:
        return json.dumps([self.text, self.byte, self.at, self.last, self.match_no, self.turn, self.waiting, self.ended])

    def more(self, spelled: str, bounds: tuple[int, int, int], chunk: str, ends: bool) -> Iterator[tuple[int, int, int, str]]:
        """match_no, start, end (bytes of the whole text), text of the matches that are decided with this chunk."""
        width, behind, ahead = bounds
        self.text += chunk
        text, pattern = self.text, _compiled(spelled)
        sure = len(text) if ends else len(text) - width - ahead  # starts up to here are decided
        seen, byte = 0, self.byte
        while self.at <= sure:
            m = pattern.search(text, self.at)
            if m is None or m.start() > sure:
                self.at = max(self.at, sure + 1)
                break
            start, end = m.span()
            if not start == end == self.last:
                byte += len(text[seen:start].encode("utf-8"))
                seen, found = start, m.group()
                self.match_no += 1
                yield self.match_no, byte, byte + len(found.encode("utf-8")), found
            self.last, self.at = end, max(end, start + 1)
        kept = max(0, min(self.at, len(text)) - max(behind, 1))  # one character at least, so that no later place looks like the text's start
        self.byte += len(text[:kept].encode("utf-8"))
        self.text, self.at, self.last, self.ended = text[kept:], self.at - kept, self.last - kept, ends


class _Chunks(StatefulProcessor):
    def __init__(self, names: list[str], spelled: str, bounds: tuple[int, int, int], first: int, most_waiting: int):
        self.names, self.spelled, self.bounds, self.first, self.most_waiting = names, spelled, bounds, first, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("undecided", StructType([StructField("saved", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        left = Undecided(known[0] if known else None)
        if left.turn is None:
            left.turn = self.first
        for row in rows:
            if row["seq"] is not None and row["seq"] >= left.turn and not left.ended:
                left.waiting.setdefault(str(row["seq"]), [row["text"] or "", bool(row["ends"])])  # a chunk that comes again counts once
        while not left.ended and (chunk := left.waiting.pop(str(left.turn), None)) is not None:
            left.turn += 1
            for found in left.more(self.spelled, self.bounds, *chunk):
                yield Row(*self.names)(*key, *found)
        if left.ended:
            left.text, left.waiting = "", {}
        if sum(len(t) for t, _ in left.waiting.values()) > self.most_waiting:
            raise ValueError(f"chunks of over {self.most_waiting} characters wait for chunk {left.turn} of text {key}")
        self.state.update((left.saved(),))

    def close(self) -> None:
        pass


def chunk_matches(stream: DataFrame, keys: list[str], seq_col: str, text_col: str, last_col: str, pattern: Pattern, first: int = 0, most_waiting: int = 1 << 24) -> DataFrame:
    """keys, match_no, start, end (bytes of the whole text), text: the matches in texts whose chunks a stream brings.

    seq_col numbers a text's chunks from `first` on, last_col marks its last one. A chunk before its turn waits, of one
    that comes again the first counts, and so does none after the last; a null text is an empty chunk, rows with a null
    number count for nothing. The pattern must have a greatest width (ValueError otherwise). The session's state store
    must be RocksDB's: see STORE."""
    bounds = reach(pattern.node)
    if bounds is None:
        raise ValueError(f"no greatest width: {pattern.pattern}")
    schema = StructType([*[StructField(k, stream.schema[k].dataType) for k in keys], *StructType.fromDDL(FOUND).fields])
    rows = stream.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.col(f"`{seq_col}`").cast("long").alias("seq"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{last_col}`"), F.lit(False)).alias("ends"))
    spelled = pattern._spelled(set(), python=True).text
    return rows.groupBy(*keys).transformWithState(_Chunks(schema.names, spelled, bounds, first, most_waiting), schema, "append", "None")


def match_sessions(rows: DataFrame, time_col: str, keys: list[str], text_col: str, pattern: Pattern, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """keys, session_start, session_end, rows, matches: rows with matches, in sessions that end after `gap` without one.

    Over a stream, rows later than the watermark `late` are left out, and a session comes when the watermark passes its end."""
    found = rows.withWatermark(time_col, late) if rows.isStreaming else rows
    found = found.select(*keys, F.col(time_col).alias("at"), pattern.count(F.col(text_col)).cast("long").alias("n")).where("n > 0 AND at IS NOT NULL")
    sums = found.groupBy(*keys, F.session_window("at", gap).alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("matches"))
    return sums.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "rows", "matches")
