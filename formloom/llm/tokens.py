"""Tokenizers as they are used on executors: loaded once per Python worker, exact, bounded in memory.

Two ways to the same ids:

* :class:`RankEncoder` wraps the tiktoken library with a local rank file.
* :class:`PieceEncoder` wraps the tokenizers library. A text is cut into the
  pre-tokenizer's matches, and each distinct match goes through the library
  once; its ids are kept as packed bytes. A text with any character outside a
  small checked set goes through the library as a whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

#: Letters of ASCII and Latin-1, spelled out so that the engine of `re` agrees with the library's.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Anything else than printable ASCII, tab, newline and Latin-1 letters and their two signs.
_UNCHECKED = re.compile("[^\t\n\x20-\x7eÀ-ÿ]")
#: What the pre-tokenizers match, on the checked characters only. Alternatives that can't start alike stand in order of frequency.
_BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTER}0-9]+| ?[0-9]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[^\s{_LETTER}0-9]+|[0-9]")
#: A place where no match of the pattern can span: a letter or digit, then a space or newline.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def safe_chunks(text: str, size: int = 1 << 16):
    """Cuts ``text`` into chunks of about ``size`` characters at places that no match spans.

    A match of the pattern may start with one blank and else keeps to one class of
    characters, and its only look-ahead sits inside a run of white space, so the
    place between a letter or digit and the white space after it always ends a
    match and starts another. Text without such a place stays in one chunk.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class RankEncoder:
    """Byte-level BPE by the tiktoken library with the ranks of a local file."""

    def __init__(self, path: str, pattern: str, chunk: int = 1 << 16):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk = chunk

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= self.chunk:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return b"".join(self.encoding.encode_to_numpy(x, disallowed_special=()).astype("<u4").tobytes() for x in safe_chunks(text, self.chunk))

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the tokens, which need not end on a character."""
        return self.encoding.decode_bytes(memoryview(ids).cast("I").tolist())


class PieceEncoder:
    """BPE by the tokenizers library from a local JSON file, without special tokens.

    ``words``: the file cuts words without their blanks and lower-cases them.
    ``most``: pieces kept in memory. When there are more, they become the older half, and
    only those that are used again are carried over. ``width``: bytes of a packed id, 2 or 4.
    """

    def __init__(self, path: str, words: bool, most: int = 300_000, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words, self.most, self.width = words, most, width
        self.code, self.kind = ("H", "<u2") if width == 2 else ("I", "<u4")
        self.pattern = _WORD_LEVEL if words else _BYTE_LEVEL
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A piece of its own kind that parts others in one call: it matches alone, and its id appears in no other piece.
        self.between, self.parts = (" 0 ", re.compile(r"\s|\d")) if words else ("\n", re.compile(r"\s\Z|\n"))
        (self.mark,) = self.tokenizer.encode(self.between.strip(" "), add_special_tokens=False).ids

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces; those that can be are encoded many at once, parted by the mark."""
        import numpy as np

        found: dict[str, bytes] = {}
        alone = [x for x in pieces if self.parts.search(x)]
        found.update(zip(alone, self._library(alone), strict=True))
        rest = [x for x in pieces if x not in found]
        texts = [self.between.join(rest[at : at + 256]) for at in range(0, len(rest), 256)]
        for at, made in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            some, packed = rest[256 * at : 256 * (at + 1)], array(self.code, made.ids).tobytes()
            ends = [*(np.flatnonzero(np.frombuffer(packed, dtype=self.kind) == self.mark) * self.width).tolist(), len(packed)]
            if len(ends) != len(some):
                raise ValueError("the tokenizer joins pieces across its mark")
            start = 0
            for piece, end in zip(some, ends, strict=True):
                found[piece] = packed[start:end]
                start = end + self.width
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what isn't known of all of them goes through the library together."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        findall, known = self.pattern.findall, self.known
        cut = [None if _UNCHECKED.search(x) else findall(x.lower() if self.words else x) for x in texts]
        if new := set().union(*filter(None, cut)).difference(known):
            again = {x: ids for x in new if (ids := self.older.get(x))}
            learnt = again | self._learn([x for x in new if x not in again])
            kept = [x for x in learnt if len(x) <= 64]
            # copies side by side: the strings at hand would keep whole blocks of memory from being used again
            known.update(zip("\0".join(kept).split("\0") if kept else (), map(learnt.__getitem__, kept), strict=True))
            long = {x: ids for x, ids in learnt.items() if len(x) > 64}
            known.update(long)
        out = [self._library([x])[0] if own is None else b"".join(map(known.__getitem__, own)) for x, own in zip(texts, cut, strict=True)]
        if new:
            for x in long:
                del known[x]
        return out


def portions(values, most: int = 1 << 20):
    """Lists of values of about ``most`` bytes together, and the place of the first."""
    held, size, at = [], 0, 0
    for i, value in enumerate(values):
        held.append(value)
        size += len(value) if value else 1
        if size >= most:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)


@lru_cache(maxsize=4)
def piece_encoder(path: str, words: bool, most: int = 300_000, width: int = 4) -> PieceEncoder:
    return PieceEncoder(path, words, most, width)


def text_of(value: bytes | None) -> str:
    """A text column as bytes: null is empty, bytes that are not UTF-8 become U+FFFD."""
    return value.decode("utf-8", "replace") if value else ""
