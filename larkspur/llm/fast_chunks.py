"""Cutting a text where byte-level pre-tokenisation always cuts, so that what
was encoded once can be looked up.

A single space between two characters that are no white space starts a new
piece, and a line feed between two such characters is a piece of its own. In
a line of printable characters (``str.isprintable`` is false for every white
space but the space) with no space at its ends and no two in a row, all cuts
are of that kind.
"""

from __future__ import annotations

from collections.abc import Callable

CACHE_LIMIT = 300_000  # chunks that one worker keeps; emptied when full


class Encoded(dict):
    """chunk -> encoded form, computed when first asked for, or many at once."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str = "", limit: int = CACHE_LIMIT):
        super().__init__()
        self.encode, self.prefix, self.limit = encode, prefix, limit

    def fill(self, chunks: set[str], encode_many: Callable[[list[str]], list[bytes]]) -> None:
        """Encode the short unknown ones of ``chunks`` together."""
        new = [c for c in chunks - self.keys() if len(c) <= 64]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = [c for c in chunks if len(c) <= 64]
        self.update(zip(new, encode_many([self.prefix + c for c in new]), strict=True))

    def __missing__(self, chunk: str) -> bytes:
        got = self.encode(self.prefix + chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = got
        return got


class ChunkEncoder:
    """Encodes whole texts, chunk by chunk where that is safe. ``encode``
    gives the encoded bytes of any text; they must concatenate. ``encode_many``
    does the same for many short texts at once."""

    def __init__(self, encode: Callable[[str], bytes], special: tuple[str, ...] = (),
                 encode_many: Callable[[list[str]], list[bytes]] | None = None):
        self.encode, self.special, self.encode_many = encode, special, encode_many
        self.first, self.spaced = Encoded(encode), Encoded(encode, " ")
        self.line_feed = encode("\n")

    def all(self, texts: list[str]) -> list[bytes]:
        """The texts' encodings; what is new in them is encoded together."""
        if self.encode_many:
            self.spaced.fill({w for t in texts for line in t.split("\n") for w in line.split(" ")[1:]}, self.encode_many)
            self.first.fill({line.partition(" ")[0] for t in texts for line in t.split("\n")}, self.encode_many)
        return [self(t) for t in texts]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode(text)
        out, spaced, first = [], self.spaced.__getitem__, self.first
        for i, line in enumerate(text.split("\n")):
            if not line or line[0] == " " or line[-1] == " " or "  " in line or not line.isprintable():
                return self.encode(text)
            if i:
                out.append(self.line_feed)
            words = line.split(" ")
            out.append(first[words[0]])
            out.extend(map(spaced, words[1:]))
        return b"".join(out)
