"""Encoding with a tokenizers file, by a cache of pre-tokens.

Both supported patterns cut a text into pre-tokens which are encoded one by one. Texts of ASCII and
Latin-1 letters are cut here by the same pattern and each distinct pre-token is given to the library's model
once; other texts, and those with a special token's string, go to the library whole."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
from tokenizers import Tokenizer

_BLANK, _LETTER = "\t-\r ", "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(r"[^\x00-\x7eÀ-ÖØ-öø-ÿ]")
#: The pre-token patterns of the two families, over the characters above.
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
_WORDS = re.compile(f"{_SUFFIX}|[{_LETTER}]+|[0-9]|[^{_BLANK}{_LETTER}0-9]+")
_BYTES = re.compile(f"{_SUFFIX}| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Pre-tokens that a worker keeps: about 200 bytes each.
CACHE = 500_000


def _byte_letters() -> dict[int, str]:
    """For str.translate: the letters that stand for the UTF-8 bytes of ASCII and Latin-1 characters in a byte-level vocabulary. Printable bytes stand for themselves, others take the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class _Ids(dict):
    """Ids of pre-tokens as bytes; new ones come from the model alone, at a fraction of the library's whole way."""

    def __init__(self, model, width: int):
        super().__init__()
        self.one, self.table, self.width = model.tokenize, _byte_letters(), width

    def __missing__(self, pre: str) -> bytes:
        ids = self[pre] = b"".join([t.id.to_bytes(self.width, "little") for t in self.one(pre.translate(self.table))])
        return ids


class Encoder:
    def __init__(self, path: str):
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.folds = self.tokenizer.normalizer is not None
        self.pattern = _WORDS if self.folds else _BYTES
        self.cache = _Ids(self.tokenizer.model, self.dtype.itemsize)
        self.plain = self._agrees()

    def _agrees(self) -> bool:
        """Whether the cached way gives the library's ids on a probe of every branch of the patterns."""
        probe = "It's  DON'T we've\n\n a1b22 ...x!! \t é Ñandú-3 '' 'll  end \n"
        try:
            return self._cached([probe])[0] == self._whole([probe])[0]
        finally:
            self.cache.clear()

    def _whole(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(ids), self.dtype).tobytes()
        ends = list(accumulate((len(x) * self.dtype.itemsize for x in ids), initial=0))
        return [raw[a:b] for a, b in pairwise(ends)]

    def _cached(self, texts: list[str]) -> list[bytes]:
        find, get = self.pattern.findall, self.cache.__getitem__
        if len(self.cache) > CACHE:
            self.cache.clear()
        return [b"".join(map(get, find(t.lower() if self.folds else t))) for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype."""
        easy = [self.plain and not _OTHER.search(t) and not any(s in t for s in self.specials) for t in texts]
        fast = iter(self._cached([t for t, e in zip(texts, easy) if e]) if any(easy) else ())
        slow = iter(self._whole([t for t, e in zip(texts, easy) if not e]) if not all(easy) else ())
        return [next(fast) if e else next(slow) for e in easy]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its cache lasts over tasks. A worker is one of many on its machine: the library takes no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
