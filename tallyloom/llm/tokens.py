"""Token ids of whole texts, exactly as the tokenizer file gives them.

The vocabulary also comes as a table of merge ranks, whose encoder is several times faster. It is used
for texts of characters up to Latin Extended-A, whose classes are the same in every version of the
character tables. The pre-tokeniser starts a new piece at every blank that a character other than
white space follows, and merges never cross a piece, so any text may be cut there: of a text with other
characters, only the cuts that hold them go to the tokenizer file itself. Special strings do as well.
"""

from __future__ import annotations

import base64
import re
from itertools import groupby

import numpy as np

_CUT = re.compile(r"(?= \S)")
_BEYOND_LATIN = re.compile("[^\u0000-ſ]")


def _latin(text: str) -> bool:
    return text.isascii() or not _BEYOND_LATIN.search(text)


class TokenIds:
    """Ids in a row as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ranks = _ranks(ranks_file, pattern) if ranks_file else None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._ranks is None or any(s in text for s in self._special):
            return self._exact(text)
        if _latin(text):
            return bytes(self._ranks(text, set()))
        runs = groupby(_CUT.split(text), _latin)
        return b"".join(
            bytes(self._ranks("".join(cuts), set())) if latin else self._exact("".join(cuts))
            for latin, cuts in runs
        )

    def _exact(self, text: str) -> bytes:
        ids = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()


def _ranks(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_to_tiktoken_buffer


_LOADED: dict[tuple, TokenIds] = {}


def loaded(tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None) -> TokenIds:
    """One instance for each worker process, as loading takes longer than a small task."""
    key = (tokenizer_file, ranks_file, pattern)
    if key not in _LOADED:
        _LOADED[key] = TokenIds(*key)
    return _LOADED[key]
