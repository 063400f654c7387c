"""Cached word encoding with the tokenizers library, for use inside Arrow functions."""

from __future__ import annotations

import os
import re

import numpy as np

#: The characters with the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A safe boundary lies before white space that follows another character: byte-level pre-tokenizers never join across it.
WITH_SPACE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: For tokenizers that drop white space.
WITHOUT_SPACE = re.compile(f"[^{SPACE}]+")

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def by_size(sizes: list[int], most: int):
    """Slices of rows whose sizes sum up to at most `most`, single rows at least."""
    at = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


_LATIN = "a-z\xdf-\xf6\xf8-\xff"
LATIN_WORD = re.compile(f"[{_LATIN}]+")
#: For lower-cased texts and tokenizers that drop white space: letters end before white space or plain punctuation, and
#: punctuation ends before white space; both are cuts of the pre-tokenizer. Whatever else there is stays whole.
LETTERS_OR_REST = re.compile(rf"[{_LATIN}]+(?=[ \t\n\r.,;:!?|]|\Z)|[.,;:!?|]+(?=[ \t\n\r]|\Z)|[^{SPACE}]+")


def lowered(text: str) -> str:
    """The text in lower case where that is what a lower-casing tokenizer sees: not where special strings could appear
    by it, or where lower case depends on neighbours."""
    return text if "<|" in text or "Σ" in text or "İ" in text else text.lower()


class WordCache:
    """value(ids) of each word, encoded in batches as words are first met.

    Short words stay for two generations of up to `most` entries; a word met again moves to the younger one.
    """

    def __init__(self, path: str, value, most: int = 500_000, longest: int = 48, batch: int = 2_000):
        self.path, self.value, self.most, self.longest, self.batch, self.known, self.older = path, value, most, longest, batch, {}, {}

    def table(self, words: set[str]) -> dict:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = []
        for w in words:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    new.append(w)
        if not new:
            return self.known
        out = self.encode(new)
        if all(len(w) <= self.longest for w in new):
            self.known.update(out)
            return self.known
        self.known.update((w, v) for w, v in out.items() if len(w) <= self.longest)
        return {**{w: self.known[w] for w in words if w in self.known}, **out}

    def encode(self, words: list[str]) -> dict:
        encode, out, at = tokenizer(self.path).encode_batch_fast, {}, 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and end - at < self.batch and (size == 0 or size + len(words[end]) < 200_000):
                size += len(words[end])
                end += 1
            part = words[at:end]
            out.update(zip(part, (self.value(e.ids) for e in encode(part, add_special_tokens=False)), strict=True))
            at = end
        return out


class EndedWordCache(WordCache):
    """Packed 32-bit ids of words, for a tokenizer that lower-cases and marks word ends: plain words are encoded many at a
    time, joined by blanks, and their ids told apart at the ids that end a word."""

    def __init__(self, path: str, suffix: str = "</w>", **more):
        super().__init__(path, lambda ids: np.array(ids, "<i4").tobytes(), **more)
        t = tokenizer(path)
        self.ends = np.array([(t.id_to_token(i) or "").endswith(suffix) for i in range(t.get_vocab_size(with_added_tokens=True))])

    def encode(self, words: list[str]) -> dict:
        plain = [w for w in words if LATIN_WORD.fullmatch(w)]
        out = super().encode([w for w in words if not LATIN_WORD.fullmatch(w)]) if len(plain) < len(words) else {}
        groups = [plain[a : a + 64] for a in range(0, len(plain), 64)]
        for part, e in zip(groups, tokenizer(self.path).encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<i4")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) == len(part):
                raw = ids.tobytes()
                out.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, [0, *cut[:-1]], cut, strict=True))
            else:
                out.update(super().encode(part))
        return out


_caches: dict = {}


def cache(kind: str, path: str, make) -> WordCache:
    """One cache per kind, tokenizer and Python worker."""
    if (kind, path) not in _caches:
        _caches[kind, path] = make(path)
    return _caches[kind, path]
