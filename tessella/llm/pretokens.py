"""Byte-level BPE vocabularies and the pre-tokens that they cut texts into."""

from __future__ import annotations

import base64
from functools import lru_cache

#: The white space of Unicode's White_Space property, as a character class's inside.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """The pattern compiled so that its white space is the property's: control characters 1C to 1F aren't in it."""
    import regex

    own = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return regex.compile(own)


def default_vocabulary() -> tuple[str, str]:
    """The path and the pattern of the public byte-level vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN



class Segments(dict):
    """Token ids, as little-endian bytes, of space-led segments of text; learns missing ones, within a bound.

    No pre-token spans a space other than as its first character, and a run of white space gives
    its last space to what follows. So a text without two spaces in a row is cut into pre-tokens
    alike as a whole and segment by segment, where each segment but the first starts with its space.
    """

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        super().__init__()
        self.encode, self.most = encoding(path, pattern).encode_ordinary, most

    def __missing__(self, segment: str) -> bytes:
        from array import array

        ids = array("I", self.encode(" " + segment)).tobytes()
        if len(segment) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[segment] = ids
        return ids

    def ids(self, text: str) -> bytes:
        from array import array

        if "  " in text:
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))
