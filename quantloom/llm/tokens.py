"""Token ids by public tokenizer files, exactly as the tokenizer library gives them, with words cached.

The file's pre-tokenizer never spans white space, so the ids of a text are the ids of its white-space separated words one
after another. Texts within a plain Latin alphabet take that path; any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import gc
import re

import numpy as np

#: Characters for which lower-casing and normalisation work on each character alone and every class of the patterns agrees:
#: ASCII with its six white-space characters, Latin-1 letters and signs without superscripts and fractions, Latin Extended-A
#: without dotted I, and common punctuation.
PLAIN = re.compile("[\t-\r -~¡-¬®-±´¶-¸º»¿-įı-ņŊ-ž‐-‧€]*")
#: The file's split pattern for such texts, after lower-casing.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

_encoders: dict[str, "WordEncoder"] = {}


class MergeTable:
    """Byte-pair merges of many short pieces side by side: one NumPy step merges each piece's pair of lowest rank.

    A piece starts as its bytes' tokens, the last one with the word-end suffix, and takes its leftmost pair of lowest rank
    until no pair has a merge, as the tokenizer's own merging does."""

    NONE = 1 << 30
    MASK, SPREAD = (1 << 19) - 1, 0x1E3779B97F4A7C15  # a hash index with linear probing, filled to about a tenth

    def __init__(self, file: str):
        import json

        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 in order
        own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        other = [b for b in range(256) if b not in set(own)]
        letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs])
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.slots, self.probes = np.full(self.MASK + 1, -1, np.int32), 0
        for i, at in enumerate(((self.key * self.SPREAD) >> 44 & self.MASK).tolist()):
            tries = 0
            while self.slots[at] >= 0:
                at, tries = (at + 1) & self.MASK, tries + 1
            self.slots[at], self.probes = i, max(self.probes, tries + 1)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = np.where((a >= 0) & (b >= 0), a * np.int64(self.size) + b, -1)
        slot = (pair * self.SPREAD) >> 44 & self.MASK
        at = self.slots[slot]
        for _ in range(self.probes):
            miss = (at >= 0) & (self.key[at] != pair)
            if not miss.any():
                break
            slot = np.where(miss, (slot + 1) & self.MASK, slot)
            at = self.slots[slot]
        return np.where(at >= 0, self.rank[at], np.int32(self.NONE))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(max(2, -(-len(p) // 2) * 2) if p else 0, []).append(i)
        for width, members in by_size.items():
            step = max(1, (1 << 21) // max(width, 1))
            for lo in range(0, len(members) if width else 0, step):
                part = members[lo : lo + step]
                for i, ids in zip(part, self._encode([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _encode(self, pieces: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        n = np.array([len(p) for p in pieces])
        rows, cols = np.arange(len(pieces)), np.arange(width)
        s = np.where(cols < n[:, None], self.inner[raw], -1)
        s[rows, n - 1] = self.final[raw[rows, n - 1]]
        done = np.empty((len(pieces), width), "<u4")
        counts = np.empty(len(pieces), np.int64)
        r = self._ranks(s[:, :-1], s[:, 1:])
        while len(rows):
            at = r.argmin(1)
            best = r[np.arange(len(rows)), at]
            more = best < self.NONE
            if not more.all():
                stop = ~more
                done[rows[stop]] = s[stop].astype("<u4")
                counts[rows[stop]] = n[stop]
                rows, s, r, n, at, best = rows[more], s[more], r[more], n[more], at[more], best[more]
            if not len(rows):
                break
            i = np.arange(len(rows))
            s[i, at] = self.merged[best]
            move = cols[:-1] > at[:, None]
            s[:, :-1] = np.where(move, s[:, 1:], s[:, :-1])
            s[:, -1] = -1
            if width > 2:
                r[:, :-1] = np.where(cols[:-2] > at[:, None], r[:, 1:], r[:, :-1])
            r[:, -1] = self.NONE
            n = n - 1
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            r[i, left] = np.where(at > 0, self._ranks(s[i, left], s[i, at]), r[i, left])
            inside = np.minimum(at, width - 2)
            r[i, inside] = np.where(at < width - 1, self._ranks(s[i, at], s[i, right]), r[i, inside])
        return [d[:c].tobytes() for d, c in zip(done, counts.tolist())]


class WordEncoder:
    """ids(text) as little-endian unsigned 32-bit bytes. The two caches are emptied when full; they only save time."""

    def __init__(self, path: str, max_words: int = 400_000, max_pieces: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = MergeTable(path)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.max_words, self.max_pieces = max_words, max_pieces

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # hundreds of thousands of live strings and no cycles
        try:
            return self._encode_batch(texts)
        finally:
            gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        split = [t.lower().split() if p else None for t, p in zip(texts, plain)]
        words = self.words
        missing = set().union(*(s for s in split if s is not None)) - words.keys() if any(plain) else set()
        if missing:
            if len(words) + len(missing) > self.max_words:
                words.clear()
                missing = set().union(*(s for s in split if s is not None))
            self._learn(missing)
        rest = iter(self._ids([t for t, p in zip(texts, plain) if not p]))
        return [next(rest) if s is None else b"".join(map(words.__getitem__, s)) for s in split]

    def _learn(self, missing: set[str]) -> None:
        pieces = self.pieces
        parts = [(w, (w,) if w.isalpha() else PIECES.findall(w)) for w in missing]
        new = {p for _, ps in parts for p in ps}
        if len(pieces) + len(new) > self.max_pieces:
            pieces.clear()
        new -= pieces.keys()
        fresh = [(p, p.encode()) for p in new]
        short = [f for f in fresh if len(f[1]) <= 40]
        pieces.update(zip([p for p, _ in short], self.merges.encode([b for _, b in short])))
        long = [p for p, b in fresh if len(b) > 40]
        pieces.update(zip(long, self._ids(long)))
        self.words.update((w, pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])) for w, ps in parts)


def word_encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each file and worker process; path defaults to the public 49k word file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def rank_encoder(path: str | None = None):
    """The byte-level encoder of a rank file (default: the public 50k file) with the package's split pattern."""
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]
