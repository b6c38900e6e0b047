"""Token ids of whole texts, with bounded per-worker caches of words and word pieces.

Both vocabularies split a text at places that depend only on the characters around them, so a text
that keeps to the characters of ``PLAIN`` can be cut at its blanks. A word seen before costs a look-up; a
new one is cut into pieces, each encoded once per worker by the tokenizers library. Any other text
(other scripts, control characters, runs that could touch a special token) is handed over to the library
whole.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters whose class (letter, digit, space, other) is the same for ``re`` and the tokenizer.
PLAIN = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿-ÿ]*")
SPACED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: What mostly follows a word, always a piece of its own after a letter.
ENDINGS = frozenset(".,;:!?")
#: A run of white space that goes on beyond a blank, so that a piece could cross it.
CROSSING = re.compile(r"\s \s|\s \Z")
#: The letter that byte-level vocabularies write for each byte: its own where that can be seen.
SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTER = {b: b for b in SEEN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - SEEN))}
BLANK = chr(LETTER[32])
CACHED_CHARS = 32
#: Words of a slice whose ids are gathered in one step.
GATHERED = 1 << 17
#: Bytes of a dict's entry, its key and its value beside their characters.
ENTRY = 190


class _Bounded(dict):
    """A dict that starts anew when it holds ``limit`` bytes, and still finds what it held before."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit, self.before, self.held = make, limit // 2, {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key) or self.make(key)
        if len(key) <= CACHED_CHARS:
            self.held += ENTRY + len(key) + len(value)
            if self.held > self.limit:
                self.before, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``batch(texts)``: the ids of each text, unsigned 32-bit integers.

    ``kind`` is "bytes" for a byte-level vocabulary whose pieces carry their leading space, "words"
    for a lower-casing one that drops white space. ``limit`` bounds the caches in bytes.
    """

    def __init__(self, path: str, kind: str, limit: int = 48 << 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.pieces = _Bounded(self.piece, limit)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """The library's model alone: a piece of a plain text is neither normalized nor cut any further."""
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", BLANK)
        else:
            letters = piece.encode().decode("latin-1").translate(LETTER)
        found = self.model.tokenize(letters)
        return array("I", [t.id for t in found]).tobytes()

    def mixed(self, word: str) -> bytes:
        """A word of letters and other characters; of a byte-level vocabulary, with the blank before it."""
        if word[-1:] in ENDINGS and (body := word[:-1]).lstrip(" ").isalpha():
            return self.pieces[body] + self.pieces[word[-1]]
        return b"".join([self.pieces[x] for x in WORDS.findall(word)]) if self.kind == "words" else self.cut(word)

    def cut(self, text: str) -> bytes:
        return b"".join([self.pieces[x] for x in SPACED.findall(text)])

    def plain(self, text: str) -> bool:
        """Whether the text may be cut at its blanks."""
        if "<|" in text or not PLAIN.fullmatch(text):
            return False
        if self.kind == "words":  # white space parts pieces and is dropped
            return True
        doubtful = text[-1:] == " " or any(x in text for x in ("  ", " \n", " \t", " \r"))
        return not (doubtful and CROSSING.search(text))

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [ids for part in self.slices(texts) for ids in part]

    def slices(self, texts: list[str], chars: int = 1 << 20) -> Iterator[list[np.ndarray]]:
        """The ids of each text, in slices of whole texts of about ``chars`` characters."""
        part, held = [], 0
        for text in texts:
            part.append(text)
            held += len(text)
            if held >= chars:
                yield self._slice(part)
                part, held = [], 0
        if part:
            yield self._slice(part)

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        out = [None if self.plain(t) else np.frombuffer(self.whole(t), "<u4") for t in texts]
        some = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(some, self._cut_at_blanks([texts[k] for k in some]) if some else (), strict=True):
            out[k] = ids
        return out

    def _cut_at_blanks(self, texts: list[str]) -> list[np.ndarray]:
        """Every different word is looked up once; the ids of all words are then gathered in one step."""
        lower = self.kind == "words"
        rows = pa.array([t.lower() for t in texts] if lower else texts, pa.large_string())
        lists = pc.ascii_split_whitespace(rows) if lower else pc.split_pattern(rows, " ")
        ends, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        different = coded.dictionary
        whole = pc.utf8_is_alpha(different).to_numpy(zero_copy_only=False).tolist()
        if not lower:
            different = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), different, pa.scalar("", pa.large_string()))
        pieces, mixed = self.pieces, self.mixed
        # an array of objects is made at once, a list of them one by one
        held = [pieces[w] if one else mixed(w) for w, one in zip(different.to_numpy(zero_copy_only=False).tolist(), whole, strict=True)]
        if not lower:  # no blank stands before the first word of a text
            at[ends[:-1]] = len(held) + np.arange(len(texts))
            held += [self.cut(t.split(" ", 1)[0]) for t in texts]
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, first = np.frombuffer(b"".join(held), "<u4"), np.cumsum(size) - size
        out = []
        cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, ends[-1], GATHERED)), len(texts)])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = at[ends[a] : ends[z]]
            each = size[some]
            done = np.r_[0, np.cumsum(each)]
            place = np.repeat(first[some] - done[:-1], each)
            place += np.arange(done[-1])
            every, bounds = ids[place], done[ends[a : z + 1] - ends[a]].tolist()
            out += [every[i:k] for i, k in zip(bounds[:-1], bounds[1:], strict=True)]
        return out


def release() -> None:
    """Give freed memory back to the system: an idle worker would hold it beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, limit: int = 48 << 20) -> Encoder:
    """One encoder per worker process, reused by its later tasks; ``limit`` as in ``Encoder``."""
    if (path, kind, limit) not in _encoders:
        _encoders[path, kind, limit] = Encoder(path, kind, limit)
    return _encoders[path, kind, limit]
