"""Whole texts to token ids, through the installed tokenizer libraries.

Words recur, so a text is cut at boundaries that no token spans, and each
distinct chunk goes through the library once while it stays in the cache.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: A blank before white space: there cuts before blanks could change the pre-split.
_UNSAFE = re.compile(r" \s")
#: A run of white space may always be cut off in front.
_RUNS = re.compile(r"(?<=\S)(?=\s)")
#: Token boundaries of both pre-splits: between a letter or number and a mark, around a single new line.
_MARKS = re.compile(r"(?<=[^\W_])(?=[,.!?;:])|(?<=\S)(?=\n)|(?<=\S\n)(?=[^\W_])")
#: One word of Latin letters, which is a single token of the pre-split.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
CACHE_ENTRIES = 700_000
_AT_ONCE = 256


class _Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes, in two generations."""

    def __init__(self, encode_many, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries = entries
        self.encode_many = encode_many
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks) -> None:
        """Chunks in neither generation: cut between a letter and a mark, and encode the parts that are new."""
        new, parts = [], {}
        older, split = self.older.get, _MARKS.split
        for x in chunks:
            if (found := older(x)) is not None:
                self[x] = found
            elif x[1:].isalpha() or len(pieces := split(x)) == 1:
                new.append(x)
            else:
                parts[x] = pieces
        if parts:
            new += {y for x in parts.values() for y in x if y not in self}
        self.update(zip(new, self.encode_many(new), strict=True))
        self.update((x, b"".join(map(self.__getitem__, y))) for x, y in parts.items())

    def join(self, chunks: list[str]) -> bytes:
        found = list(map(self.get, chunks))
        if None in found:
            if len(self) > self.entries:
                self.older = dict(self)
                self.clear()
                found = [None] * len(chunks)
            missing = [i for i, y in enumerate(found) if y is None]
            self._learn({chunks[i] for i in missing})
            for i in missing:
                found[i] = self[chunks[i]]
        return b"".join(found)


def _shown() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


_SHOWN = _shown()


def _part_marks(text: str, sign: str) -> str:
    """`sign` before each comma or full stop, if all stand after a letter or number (or a blank that is dropped); else the text as it is."""
    for mark in ",.":
        parts = text.split(mark)
        if all(x[-1:].isalnum() or (sign == " " and x[-1:] == " ") for x in parts[:-1]):
            text = (sign + mark).join(parts)
    return text


class LibraryEncoder:
    """ids of a `tokenizers` file, without special tokens; their strings are ordinary text."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._plain, self._parted = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        self._mark, self._mark_id = "<|endoftext|>", self._plain.token_to_id("<|endoftext|>")
        self._drops_blanks = b'"Removed"' in self._plain.pre_tokenizer.__getstate__()
        self._merge = self._plain.model.tokenize
        self._chunks = _Chunks(self._encode_many, entries)

    def _encode_many(self, chunks: list[str]) -> list[bytes]:
        """Plain words go straight to the library's merges, all else through its whole chain."""
        out: list[bytes | None] = [None] * len(chunks)
        rest, lower, merge = [], self._drops_blanks, self._merge
        for i, x in enumerate(chunks):
            if _WORD(x) and len(x) < 64:
                low = x.lower() if lower else x
                if len(low) == len(x):
                    shown = (low if low[0] != " " else "\u0120" + low[1:]) if low.isascii() else low.encode().decode("latin-1").translate(_SHOWN)
                    out[i] = array("I", [t.id for t in merge(shown)]).tobytes()
                    continue
            rest.append(i)
        for lo in range(0, len(rest), _AT_ONCE):
            part = rest[lo : lo + _AT_ONCE]
            for i, ids in zip(part, self._through_chain([chunks[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _through_chain(self, chunks: list[str]) -> list[bytes]:
        """One call for all: the end mark parts them, as the library treats what stands around it by itself."""
        joined = self._mark.join(chunks)
        if "<|" in joined.replace(self._mark, "", len(chunks) - 1) or joined.count("<|") >= len(chunks):
            return [np.array(self._plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in chunks]
        ids = np.array(self._parted.encode(joined, add_special_tokens=False).ids, "<u4")
        ends = [*np.flatnonzero(ids == self._mark_id).tolist(), len(ids)]
        raw, out, at = ids.tobytes(), [], 0
        for end in ends:
            out.append(raw[4 * at : 4 * end])
            at = end + 1
        return out

    def split(self, text: str) -> list[str]:
        """Chunks that the tokenizer treats independently of each other; commas and stops after words are their own."""
        if self._drops_blanks:  # white space never reaches a token, nor does the case of letters
            low = text.lower()
            if len(low) == len(text) and (text.isascii() or ("\u03a3" not in text and unicodedata.is_normalized("NFC", text))):
                text = low
            return [x for x in _part_marks(text.replace("\n", " "), " ").split(" ") if x]
        if _UNSAFE.search(text):
            return _RUNS.split(text)
        if "\0" in text:
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]
        return _part_marks(text, "\0").replace(" ", "\0 ").split("\0")

    def encode_bytes(self, text: str) -> bytes:
        if self._drops_blanks and "\u0130" in text:  # the one letter whose lower case ends in a mark, which may join a run
            return np.array(self._plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._chunks.join(self.split(text)) if text else b""

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")


@lru_cache(maxsize=4)
def library_encoder(path: str, entries: int = CACHE_ENTRIES) -> LibraryEncoder:
    return LibraryEncoder(path, entries)


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a local rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut a long text in front of runs of white space, into pieces of about `limit` characters.

    A match that holds a non-blank character ends before the next white space, and a
    run of white space is matched from its first character, so no match spans a cut.
    A stretch without white space stays whole, whatever its length.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        found = _RUNS.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]
