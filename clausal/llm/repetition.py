"""Quality rules on repetition, by suffix arrays over words.

The words of many texts form one array. A suffix array by prefix doubling, in which a
suffix never matches one of another text, gives the longest common prefix of neighbours;
its intervals are the maximal repeated substrings of each text. The union of their spans
gives the share of repeated words, and the highest prefix the longest repeat.

Defined results: a null or empty text, or one of separators only, has no words and fails
the base rule; repeated rows are judged alike, each by its own text; a very long text
is measured whole; an empty table gives no rows; only the columns in `keep` are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausal.llm.common import WORD, slices

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]+")


def repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that starts there and elsewhere in the same text too.

    `ids` are the words of all texts in a row and `doc` the text of each, ascending.
    Doubling stops where no two suffixes are tied. The ranks of each level are kept, so
    that the common prefix of neighbours is found by descending through the levels.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.int64)
    _, rank = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True)
    counts = np.bincount(rank)
    # a rank is the place of its group in sorted order, so that there is room to split the group
    tied, rank = np.flatnonzero(counts[rank] > 1), np.r_[0, np.cumsum(counts)[:-1]][rank]
    ends = np.searchsorted(doc, doc, side="right")  # of the text of each position
    levels, k = [rank], 1
    while len(tied):
        after = tied + k
        second = np.where(after < ends[tied], rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[tied]))
        first, then = rank[tied][order], second[order]
        new_group = np.r_[True, first[1:] != first[:-1]]
        step = np.r_[True, (first[1:] != first[:-1]) | (then[1:] != then[:-1])]
        start = np.maximum.accumulate(np.where(new_group, np.arange(len(order)), 0))
        at = np.maximum.accumulate(np.where(step, np.arange(len(order)), 0))
        rank = rank.copy()
        rank[tied[order]] = first + (at - start)
        levels.append(rank)
        same = ~step
        again = same | np.r_[same[1:], False]
        tied = np.sort(tied[order][again])
        k *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b]) if n > 1 else np.zeros(0, dtype=np.int64)
    x, y = a[live], b[live]
    common = np.zeros(len(live), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        in_text = (x < ends[a[live]]) & (y < ends[b[live]])
        equal = in_text & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        step = equal.astype(np.int64) << level
        x, y, common = x + step, y + step, common + step
    lcp[live] = common
    out = np.zeros(n, dtype=np.int64)
    out[order[:-1]] = lcp
    out[order[1:]] = np.maximum(out[order[1:]], lcp)
    return out


def covered(length: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """Words of each text in the union of its repeated strings of at least so many words."""
    n = len(length)
    start = np.flatnonzero(length >= least)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[start] += 1
    np.subtract.at(edge, start + length[start], 1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def measure(texts: list[str | None], window: int, repeat_words: int) -> dict[str, np.ndarray]:
    """Counts of each text: words, their characters, symbols, repeated lines, repeated words, and the longest repeat."""
    n = len(texts)
    seen: dict[str, int] = {}
    n_words, chars, symbols, lines = (np.zeros(n, dtype=np.int64) for _ in range(4))
    parts: list[np.ndarray] = []
    for i, text in enumerate(texts):
        words = _WORDS.findall(text or "")
        n_words[i] = len(words)
        if not words:
            continue
        chars[i] = sum(map(len, words))
        symbols[i] = sum(map(len, _SYMBOLS.findall(text)))
        if "\n" in text:
            earlier: set[str] = set()
            for line in text.split("\n"):
                if line in earlier:
                    lines[i] += 1
                elif _WORDS.search(line):
                    earlier.add(line)
        for w in words:
            seen.setdefault(w, len(seen))
        parts.append(np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(n), n_words)
    length = repeats(ids, doc)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, doc, length)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines,
        "n_repeat_words": covered(length, doc, n, window), "n_long_repeat_words": covered(length, doc, n, repeat_words), "longest_repeat": longest,
    }


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_words: int = 10, window: int = 5, base_percent: int = 20, repeat_words: int = 10, max_percent: int = 15, max_repeat: int = 200) -> DataFrame:
    """Measures the repetition of every text and gives a verdict.

    The base rule fails texts of under `least_words` words, or with over `base_percent`
    percent of words in repeated windows of `window` words. Beyond it a text is kept if
    repeated strings of `repeat_words` words and more cover at most `max_percent` percent
    of it and none has more than `max_repeat` words.
    """
    source = docs.select(*keep, text)
    kept = [f for f in source.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            m = measure(part.column(text).to_pylist(), window, repeat_words)
            failed = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > base_percent * m["n_words"])
            good = ~failed & (100 * m["n_long_repeat_words"] <= max_percent * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            out = {f.name: part.column(f.name) for f in kept} | {k: pa.array(v, pa.int64()) for k, v in m.items()}
            yield pa.RecordBatch.from_pydict(out | {"base_failed": pa.array(failed), "kept": pa.array(good)})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{ddl}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_long_repeat_words bigint, longest_repeat bigint, base_failed boolean, kept boolean")
