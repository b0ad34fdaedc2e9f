"""Worker-side access to a public tokenizer: exact token ids of space-delimited
pieces, kept in bounded caches.

A byte-level BPE tokenizer with the usual pre-token pattern starts a new pre-token
at every single space that a non-space follows, whatever comes before. So a text
may be cut there, the pieces encoded on their own and the ids joined, and the
result is that of the whole text. Texts with other white space at a cut are given
to the library whole. Tokenizers for which the argument fails (a normaliser, a
prefix space, special tokens with white space or stripping) are always used whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

CACHE = 150_000
LONGEST = 64  # longer pieces aren't kept
#: Pre-token pattern with the white space spelled out (Unicode White_Space).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Characters whose classes are the same in every Unicode version since 6.
_KNOWN = re.compile("[\\x00-\\u024f\\u0391-\\u03a1\\u03a3-\\u03ff\\u0400-\\u0481\\u2010-\\u2027]*\\Z")
_ODD_START = re.compile(f"[{_WS}]|\\Z")


class Unsafe(Exception):
    """The text has white space at a cut."""


class _Cache(dict):
    """Two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, size: int = CACHE) -> None:  # noqa: ANN001
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def put(self, items: dict) -> None:
        if len(self) + len(items) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(items)

    def forget(self) -> None:
        """Drop the old generation."""
        self.old = {}


class Pieces:
    """Ids of texts as little-endian int32 bytes."""

    def __init__(self, path: str, cache: int = CACHE, pre_tokens: int | None = None) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.specials = [a["content"] for a in added]
        self.splits = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
            and spec["model"].get("type") == "BPE"
            and not any(re.search(r"\s", a["content"]) or a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") for a in added)
        )
        self.marks = tuple({s[:2] for s in self.specials})
        self.findall = regex.compile(_PATTERN).findall
        self.pre_tokens = _Cache(self.whole, pre_tokens or cache)
        self.pieces = _Cache(self._piece, cache)
        self.sizes = np.zeros(0, np.int64)

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _parts(self, text: str) -> bytes:
        if any(m in text for m in self.marks) or not _KNOWN.match(text):
            return self.whole(text)
        return b"".join(map(self.pre_tokens.__getitem__, self.findall(text)))

    def _piece(self, piece: str) -> bytes:
        if _ODD_START.match(piece):
            raise Unsafe
        return self._parts(" " + piece)

    def learn(self, texts: Iterable[str]) -> None:
        """Encode the texts' new pieces in one call of the library. Joined by spaces each
        still starts a pre-token, and the tokens' lengths in bytes tell which ids are its
        own; if they don't add up, nothing is kept. Ids don't depend on what is learnt."""
        if not self.splits:
            return
        if not len(self.sizes):
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.sizes[list(vocab.values())] = list(map(len, vocab))  # a character stands for a byte
        seen = set().union(*[text.split(" ") for text in texts]) - {""}
        new = [p for p in seen if p not in self.pieces and len(p) <= LONGEST and not p[:1].isspace()][: self.pieces.size]
        old = self.pieces.old
        known = {p: old[p] for p in new if p in old}  # else they could be dropped before their use
        self.pieces.put(known)
        new = [p for p in new if p not in known]
        joined = " " + " ".join(new)
        if any(m in joined for m in self.marks):
            new = [p for p in new if not any(m in p for m in self.marks)]
            joined = " " + " ".join(new)
        if not new:
            return
        data = joined.encode()
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data))
        reached = np.cumsum(self.sizes[ids])
        stops = np.searchsorted(reached, ends)
        if len(ids) and reached[-1] == len(data) and (reached[stops] == ends).all():
            raw, to = ids.tobytes(), ((stops + 1) * 4).tolist()
            self.pieces.put({p: raw[a:b] for p, a, b in zip(new, [0, *to], to)})

    def encode(self, text: str) -> bytes:
        if not self.splits:
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.pieces.__getitem__, rest))
        except Unsafe:
            return self._parts(text)
        return self._parts(first) + ids if first else ids

    def forget(self) -> None:
        """What an idle worker needn't hold: the caches' old generations."""
        self.pre_tokens.forget()
        self.pieces.forget()


class Lengths:
    """Token counts of texts: a table of frequent pieces, then a cache."""

    def __init__(self, pieces: Pieces, table: dict[str, int]) -> None:
        self.pieces = pieces
        self.counts = _Cache(lambda piece: len(pieces._piece(piece)) // 4, CACHE + len(table))
        self.counts.update(table)
        pieces.pieces = {}  # counts replace the ids of pieces

    def count(self, text: str) -> int:
        if not self.pieces.splits:
            return len(self.pieces.whole(text)) // 4
        first, *rest = text.split(" ")
        try:
            n = sum(map(self.counts.__getitem__, rest))
        except Unsafe:
            return len(self.pieces._parts(text)) // 4
        return n + len(self.pieces._parts(first)) // 4 if first else n


class Decoder:
    """Bytes of ids, by one table lookup for all ids of a text."""

    def __init__(self, path: str, tokenizer=None) -> None:  # noqa: ANN001
        from tokenizers import Tokenizer

        tokenizer = tokenizer or Tokenizer.from_file(path)
        back = {c: b for b, c in _byte_characters().items()}
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        parts = []
        for i in range(size):
            token = tokenizer.id_to_token(i) or ""
            parts.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        where = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[where].tobytes()


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_OPEN: dict[tuple, object] = {}


def shared(kind: type, path: str, *args: object) -> object:
    """One object per worker process and tokenizer; its caches live on from task to task."""
    key = (kind.__name__, path)
    if key not in _OPEN:
        _OPEN[key] = kind(path, *args)
    return _OPEN[key]
