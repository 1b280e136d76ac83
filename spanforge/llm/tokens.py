"""Token ids of whole texts by the tokenizers library, remembered by word."""

from __future__ import annotations

import os
from array import array

#: Words whose ids a worker remembers, twice: the newest, and those before them.
REMEMBERED = 400_000
#: Below this code point, str.isalpha() and the vocabulary's own \p{L} agree in every Unicode version.
_SETTLED = "ɐ"
#: How byte-level vocabularies write a space.
_SPACE = "Ġ"
#: ASCII marks; a run of them after letters is one piece (an apostrophe may start a contraction).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Maps a space-free part of a text to the ids (as bytes) of that part with the space before it.

    The vocabulary's splitting pattern starts a new piece at every single space between two other characters, and makes
    a single line feed there a piece of its own, so the ids of a text are those of its parts, put together. A part that
    starts with a line feed has no space before it. A part that touches more white space maps to None."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spell = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.older: dict[str, bytes | None] = {}
        self.line = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Of a space and letters, one piece of the splitting pattern."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.spell(_SPACE + word)]).tobytes()

    def renew(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()

    def __missing__(self, part: str) -> bytes | None:
        if part in self.older:
            ids = self.older[part]
        elif part.isalpha() and (part.isascii() or max(part) < _SETTLED):
            ids = self.word(part)
        elif (core := part.rstrip(_MARKS)) and core != part and core.isalpha() and (core.isascii() or max(core) < _SETTLED):
            tail = part[len(core) :]
            ids = (self.get(core) or self.word(core)) + (self.get("\0" + tail) or self.tail(tail))
        elif part[:1] == "\n" and (core := part[1:]) and not core[0].isspace() and not core[-1].isspace():
            ids = self.line + self.encode(core)
        elif not part or part[0].isspace() or part[-1].isspace():
            ids = None
        else:
            ids = self.encode(f" {part}")
        self[part] = ids
        return ids

    def tail(self, tail: str) -> bytes:
        ids = self["\0" + tail] = self.encode(tail)
        return ids


class Encoder:
    """ids(text): all ids of the whole text as little-endian unsigned 32-bit integers; null counts as empty."""

    def __init__(self, path: str, end_id: int | None = 2):
        self.words = WordIds(path)
        self.end = b"" if end_id is None else array("I", [end_id]).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return self.end
        self.words.renew()
        if "\0" in text:
            return self.words.encode(text) + self.end
        first, *parts = text.replace("\n", " \n").split(" ")
        found = [*map(self.words.__getitem__, parts)]
        if None in found or not first or first[0].isspace() or first[-1].isspace():
            return self._joined(text.split(" ")) + self.end
        return b"".join([self.words.encode(first), *found, self.end])

    def _joined(self, parts: list[str]) -> bytes:
        """The same where spaces touch other white space: such parts stay together."""
        runs, run = [], [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if part and before and not part[0].isspace() and not before[-1].isspace():
                runs.append(run)
                run = [part]
            else:
                run.append(part)
        runs.append(run)
        texts = [" ".join(r) for r in runs]
        return b"".join([self.words.encode(texts[0]), *(self.words.encode(f" {t}") for t in texts[1:])])


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None = 2) -> Encoder:
    """One for each worker process, which serves many tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
