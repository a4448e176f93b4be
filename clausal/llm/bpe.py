"""Byte-level BPE encoding and decoding: speculate and verify.

A word's tokens are first guessed by greedy longest match against the vocabulary.
The guess is the true encoding exactly when every adjacent pair of tokens is
compatible, that is, when no merge across their border would have come first; all
pairs of many words are tested at once with array operations. Only words with an
incompatible pair are merged step by step.

Defined results: a null or empty text has no tokens and decodes to the empty text;
the special tokens of the vocabulary are recognised inside texts; repeated rows are
encoded alike; a very long text is encoded whole; an empty table gives no rows; other columns pass through unless an output column has their name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from clausal.llm.common import slices

#: The published pre-tokenisation pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The letters and numbers that Unicode 16.0, by which the vocabulary's library classes characters, has over 15.1.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]

#: Words whose encodings a worker remembers, and the longest word it does so for.
CACHE_WORDS, CACHE_CHARS = 400_000, 64

#: Words of more bytes are merged with a heap.
HEAP_FROM = 120

NEVER, BARRED = np.int64(1) << 40, 1 << 40

#: The same pattern for the standard library's quicker engine, and a test for the characters on which the two may differ.
NEAR_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
FAR = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u0557]")

PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def newer_characters() -> str:
    """A character class of the letters and numbers that `regex` knows and Unicode 16.0 doesn't; empty if there are none."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    new = [ord(c) for m in regex.finditer(r"[\p{L}\p{N}]+", every) for c in m[0] if unicodedata.category(c) == "Cn"]
    new = [c for c in new if not any(a <= c <= b for a, b in UNICODE_16)]
    runs: list[list[int]] = []
    for c in new:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Codec:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        stand_in = byte_alphabet()
        vocab = model["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(stand_in[c] for c in text) if all(c in stand_in for c in text) else text.encode()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.ids = {b: i for i, b in enumerate(self.token_bytes) if b and i not in set(self.special.values())}
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        first = np.full(size, len(merges), dtype=np.int64)
        np.minimum.at(first, made, np.arange(len(merges)))
        use = first[made] == np.arange(len(merges))
        self.rank[made[use]] = np.arange(len(merges))[use]
        self.left[made[use]], self.right[made[use]] = left[use], right[use]
        self.size = size
        keys = left * size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.made_by = made.tolist()
        self.reach: dict[bytes, int] = {}  # the longest token by its first two bytes
        for t in self.ids:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.sound = self._sound_tokens()
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.near_words = re.compile(NEAR_PATTERN)
        self.words = self.odd_words = regex.compile(PATTERN)
        new = newer_characters()
        self.odd = regex.compile(f"[{new}]") if new else None
        if new:
            self.odd_words = regex.compile(PATTERN.replace(r" ?\p{L}+", rf" ?(?:(?![{new}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{new}])\p{{N}})+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])+"))
        self.cache: dict[str, bytes] = {}
        self.exact_words = 0

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of tokens a and b comes before a merge that shapes their inner ends.

        Walks back through the merges: the end formed last is split first. While a piece
        of rank r stood unmerged, a crossing merge wins if it ranks below r, and on the
        right side also if it ties, as merges go from left to right.
        """
        a, b = np.asarray(a, dtype=np.int64).copy(), np.asarray(b, dtype=np.int64).copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        ok, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossed = self._pair_rank(x, y) < limit[live]
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            from_left = rx > ry
            a[live] = np.where(from_left, self.right[x], x)
            b[live] = np.where(from_left, y, self.left[y])
            limit[live] = np.where(from_left, rx, ry + 1)
        return ok

    def _sound_tokens(self) -> np.ndarray:
        """Tokens whose own bytes encode to just that token."""
        sound = self.rank < 0
        made = np.flatnonzero(self.rank >= 0)
        fits = np.zeros(self.size, dtype=bool)
        fits[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            sound[t] = fits[t] and sound[self.left[t]] and sound[self.right[t]]
        return sound

    def _greedy(self, word: bytes) -> list[int]:
        ids, reach, out, i, n = self.ids, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 2], 1))
            while j > i:
                t = ids.get(word[i:j])
                if t is not None:
                    out.append(t)
                    break
                j -= 1
            i = max(j, i + 1)  # a byte without a token of its own is dropped, as the vocabulary has no unknown token
        return out

    def _merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of the lowest rank, the leftmost of equals."""
        self.exact_words += 1
        toks = [t for b in word if (t := self.byte_ids[b]) >= 0]
        if len(toks) > HEAP_FROM:
            return self._merged_by_heap(toks)
        rank_of, size = self.rank_of, self.size
        ranks = [rank_of.get(a * size + b, BARRED) for a, b in zip(toks, toks[1:], strict=False)]
        while ranks and (least := min(ranks)) < BARRED:
            i = ranks.index(least)
            made = toks[i] = self.made_by[least]
            del toks[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of.get(toks[i - 1] * size + made, BARRED)
            if i < len(ranks):
                ranks[i] = rank_of.get(made * size + toks[i + 1], BARRED)
        return toks

    def _merged_by_heap(self, toks: list[int]) -> list[int]:
        """The same over a linked list, in n log n steps, for very long words."""
        rank_of, size, n = self.rank_of, self.size, len(toks)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := rank_of.get(toks[i] * size + toks[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if toks[i] != a or j < 0 or toks[j] != b:
                continue
            toks[i], toks[j], after[i] = self.made_by[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := rank_of.get(toks[p] * size + toks[q])) is not None:
                    heapq.heappush(heap, (r, p, toks[p], toks[q]))
        return [t for t in toks if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        guess = [self._greedy(w) for w in raw]
        counts = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        flat = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(counts.sum()))
        owner = np.repeat(np.arange(len(guess)), counts)
        failed = np.zeros(len(guess), dtype=bool)
        failed[owner[~self.sound[flat]]] = True
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)
            failed[owner[inner[~good[back]]]] = True
        for i in np.flatnonzero(failed):
            guess[i] = self._merged(raw[i])
        return [PACK[len(g)](*g) if len(g) < len(PACK) else np.array(g, dtype="<u4").tobytes() for g in guess]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        pieces, new = [], set()
        for text in texts:
            parts = self.split_special.split(text or "") if self.split_special else [text or ""]
            words: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    words.append(part)
                elif part:
                    if not FAR.search(part):
                        words += self.near_words.findall(part)
                    else:
                        words += (self.odd_words if self.odd and self.odd.search(part) else self.words).findall(part)
            pieces.append(words)
            new.update(words)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache
        missing = [w for w in new if w not in known]
        for s in self.special:
            known[s] = np.array([self.special[s]], dtype="<u4").tobytes()
        missing = [w for w in missing if w not in self.special]
        packed = dict(zip(missing, self.encode_words(missing), strict=True))
        known.update((w, p) for w, p in packed.items() if len(w) <= CACHE_CHARS)
        # long words aren't kept beyond this batch
        packed = {w: p for w, p in packed.items() if len(w) > CACHE_CHARS}
        get = (lambda w: known[w] if w in known else packed[w]) if packed else known.__getitem__
        return [b"".join(map(get, words)) for words in pieces]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", errors="replace")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_codecs: dict[str, Codec] = {}


def _codec(spec: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encodes the text column by the vocabulary file and decodes the ids again.

    Returns the columns of `keep` with n_tokens, ids_sha256 and decoded_sha256, and with
    `with_ids` the ids (array of int) and the decoded text. The file is read on the driver
    and broadcast; its size is fixed by the vocabulary, not by the data.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    extra = ", ids array<int>, decoded string" if with_ids else ""
    source = docs.select(*keep, text)
    kept = [f for f in source.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for part in slices(batches, text):
            packed = codec.encode_batch(part.column(text).to_pylist())
            decoded = [codec.decode(p) for p in packed]
            out = {f.name: part.column(f.name) for f in kept}
            out["n_tokens"] = pa.array([len(p) // 4 for p in packed], pa.int64())
            out["ids_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in packed])
            out["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{ddl}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
