"""Token ids of whole texts for a tokenizer file of the ``word_bpe`` kind, with a memo of words.

Such a tokenizer lower-cases, drops white space and splits words before it merges pairs, so the ids of a
text are those of its white-space-delimited chunks in order. Chunks repeat; each distinct one is merged
once per worker and kept by its 64-bit hash, up to ``MEMO`` chunks. Texts for which that shortcut is not certain (characters beyond
Latin Extended-A, control characters, the tokenizer's special strings) go through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from packetloom.llm.text import Words, buffers, gather

MEMO = 800_000
NONE = 1 << 40
#: Longer words go through the tokenizer: merging many words at once takes a round for each merge of the longest one.
LONG = 400
LAST = 0x180
#: Characters for which lower-casing, composition and white space need the tokenizer's own rules.
_ODD = r"[^\t-\r -~\x{a1}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}]|<\|"
_KINDS: dict[str, str] = {"L": "", "N": "", "O": ""}
for _c in map(chr, range(0x21, LAST)):
    _k = unicodedata.category(_c)[0]
    _KINDS[_k if _k in "LN" else "O"] += re.escape(_c)
#: The tokenizer's split: contractions, runs of letters, single numbers, runs of anything else.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_KINDS['L']}]+|[{_KINDS['N']}]|[{_KINDS['O']}]+")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """``ids`` of many texts at once; chunks not seen before are merged together, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._forget()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: in each round every word merges its leftmost pair of the lowest rank."""
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.frombuffer(b"".join(coded), np.uint8)
        sym, last = self.inner[flat], np.cumsum(size) - 1
        sym[last] = self.final[flat[last]]
        rank = np.full(len(sym), NONE)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[last] = NONE  # the pair that starts at a symbol; none at a word's end
        name, done = np.arange(len(words)), [b""] * len(words)
        while len(name):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            active = least < NONE
            for k in np.flatnonzero(~active):
                done[name[k]] = sym[first[k] : first[k] + size[k]].astype("<u4").tobytes()
            keep = np.repeat(active, size)
            sym, rank, name, least, size = sym[keep], rank[keep], name[active], least[active], size[active]
            if not len(name):
                break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            owner = np.repeat(np.arange(len(name)), size)[hit]
            hit = hit[np.r_[True, owner[1:] != owner[:-1]]]
            sym[hit] = self.merged[rank[hit]]
            final = rank[hit + 1] == NONE
            final &= np.isin(hit + 1, np.cumsum(size) - 1, assume_unique=True)
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, rank = sym[stay], rank[stay]
            hit -= np.arange(len(hit))
            size = size - 1
            rank[hit[final]] = NONE
            hit2 = hit[~final]
            rank[hit2] = self._ranks(sym[hit2], sym[hit2 + 1])
            before = hit[~np.isin(hit, np.cumsum(size) - size, assume_unique=True)]
            rank[before - 1] = self._ranks(sym[before - 1], sym[before])
        return done

    def _learn(self, words: Words, which: np.ndarray, hashes: np.ndarray) -> None:
        """Put the ids of some words into the memo."""
        text = words.data.tobytes()
        chunks = [text[a:b].decode() for a, b in zip(words.starts[which].tolist(), words.ends[which].tolist())]
        parts = [(c,) if c.isalpha() else _PIECE.findall(c) for c in chunks]
        pieces = dict.fromkeys(p for ps in parts for p in ps)
        short = [p for p in pieces if len(p) <= LONG]
        merged = dict(zip(short, self.merge(short)))
        for p in pieces.keys() - merged.keys():
            merged[p] = np.array(self.whole.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        ids = [b"".join([merged[p] for p in ps]) for ps in parts]
        if len(self.known) + len(ids) > MEMO:
            self._forget()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.size = np.insert(self.size, at, size)
        self.start = np.insert(self.start, at, self.used + np.cumsum(size) - size)
        new = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(new) > len(self.flat):
            self.flat = np.r_[self.flat[: self.used], np.zeros(max(len(new), len(self.flat)), np.uint32)]
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)

    def _forget(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of the texts in them."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), "", texts))
        words = Words(*buffers(plain))
        hashes, back = np.unique(words.hashes(), return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = self.known[np.minimum(at, max(len(self.known) - 1, 0))] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            sample = np.zeros(len(hashes), np.int64)
            sample[back] = np.arange(len(back))
            before = len(self.known)
            if before + int(new.sum()) > MEMO and before:
                self._forget()
                new[:] = True
            self._learn(words, sample[new], hashes[new])
            at = np.searchsorted(self.known, hashes)
        sizes = self.size[at[back]] if len(back) else np.zeros(0, np.int64)
        flat = self.flat[gather(self.start[at[back]], sizes)] if len(back) else np.zeros(0, np.uint32)
        ends = np.r_[0, np.cumsum(sizes)]
        offsets = ends[words.first]
        if odd.any():
            parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            flat, offsets = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return flat, offsets


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
