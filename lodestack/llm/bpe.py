"""Byte-level BPE ids of whole texts, with a bounded cache of the stretches between spaces.

The ids equal those of the ``tokenizers`` library for the same vocabulary. A
token never spans the border before a space that a visible character follows, so
a text without runs of white space behind a space is encoded stretch by stretch,
and stretches seen before cost one dictionary look-up. Other texts are encoded
in one piece, and texts with the string of a special token by the library itself.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

#: Stretches kept at a time, and the longest that is kept.
CACHED, LONGEST = 300_000, 48
_ODD = re.compile(r" (?:\s|$)")


class _Stretches(dict):
    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, stretch: str) -> bytes:
        ids = np.array(self.encode(self.lead + stretch), "<u4").tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[stretch] = ids
        return ids


class ByteBpe:
    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.plain = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(vocabulary)
        with open(vocabulary) as file:
            self.special = [x["content"] for x in json.load(file)["added_tokens"]]
        self.first, self.rest = _Stretches(self.plain, ""), _Stretches(self.plain, " ")

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _ODD.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))


@functools.cache
def byte_bpe(vocabulary: str | None = None, ranks: str | None = None) -> ByteBpe:
    """One per Python worker. The paths default to the public tokenizers' files."""
    import public_tokenizers

    return ByteBpe(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
