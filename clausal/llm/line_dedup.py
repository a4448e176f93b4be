"""Line deduplication by pairwise alignment.

Lines are hashed to 128 bits. Documents that share a line form pairs: of a rare line, of at
most RARE documents, every two of them; of any other line every document and the first
one that has the line. Each pair is aligned by patience diff over all the lines that both
have: lines unique on both sides anchor it by their longest increasing subsequence, and
what lies between anchors is aligned in the same way. Shared lines that this leaves over,
for they cross or repeat, are aligned once more in runs of their own: adjacent lines that
the earlier document has in the same order. A run of lines that one pair aligns is a common
block; blocks of `block_words` words or more are deleted from the later document.

A passage may be frequent, and have its lines in one order in the first document that has
them and in another in those that share it. So windows of adjacent lines, as short as
`block_words` words allow, are hashed like lines, find pairs like these, and are common
blocks for all documents but the first that has them. Two documents with a common passage
of so many words share all its windows, and these cover it, whatever else they have and
however often they have it.

Documents are ordered by id (null last), rows of one id by a key of their text. Lines are
counted by an aggregate before anything is joined; a frequent line costs one pair a document.

Defined results: lines are what lies between line feeds; lines without words are never
shared, neither end a block nor count in it, and go where they lie between lines that go;
a null or empty text has none and stays as it is; a very long text is a document like any
other; repeated rows are one document and are treated alike; an empty table gives no rows;
all columns pass through, but for a column n_gone, which gives way to the output's, and
n_chars, where there is one, which follows the text of the documents that lose lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausal.llm.common import WORD, dropped, held_keys, marked, slices, text_key, unused, written

_WORDS = re.compile(WORD)

LAST = (1 << 63) - 1

#: Documents of a line that are all paired with one another.
RARE = 6


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, stop) of the shortest windows of at least so many words from each line on and up to each line, if they have several lines."""
    sums = [0, *accumulate(words)]
    out: set[tuple[int, int]] = set()
    for i in range(len(words)):
        out.add((i, bisect_left(sums, sums[i] + least)))
        out.add((bisect_right(sums, sums[i + 1] - least) - 1, i + 1))
    return sorted((a, b) for a, b in out if a >= 0 and b <= len(words) and b - a > 1)


def shared_lines(docs: DataFrame, least: int) -> DataFrame:
    """(h, id, key, at, words): a row for each document and distinct line with a word, with the places of the line.

    A place is the number of the line among those with words, and in the lower 32 bits its number among all.
    Windows of several lines have rows too, with the places they start at and their number of lines, negated, as words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, ids, keys, at, words = [], [], [], [], []
            for i, key, text in zip(part.column("id").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                places: dict[tuple[bytes, int], list[int]] = {}
                lines: list[tuple[int, bytes, int]] = []
                for place, line in enumerate((text or "").split("\n")):
                    if n := len(_WORDS.findall(line)):
                        digest = xxhash.xxh3_128_digest(line.encode())
                        p = len(lines) << 32 | place
                        places.setdefault((digest, n), []).append(p)
                        lines.append((p, digest, n))
                for a, b in windows([n for _, _, n in lines], least):
                    digest = xxhash.xxh3_128_digest(b"".join(x for _, x, _ in lines[a:b]))
                    places.setdefault((digest, a - b), []).append(lines[a][0])
                for (digest, n), ps in places.items():
                    h.append(digest)
                    ids.append(i)
                    keys.append(key)
                    at.append(ps)
                    words.append(n)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.binary()), "id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "at": pa.array(at, pa.list_(pa.int64())), "words": pa.array(words, pa.int32())})

    source = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), text_key().alias("key"), "text")
    return source.mapInArrow(run, "h binary, id long, key long, at array<long>, words int")


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(later: dict[int, int], earlier: dict[int, int]) -> list[int]:
    """Places of the later document that patience diff aligns with the earlier one.

    Both map places to numbers of lines. A stretch of either side is aligned by the lines
    that are unique in both stretches; what has none of these, by equal ends.
    """
    mine, other = set(later.values()), set(earlier.values())
    x = [(p, later[p]) for p in sorted(later) if later[p] in other]
    y = [(p, earlier[p]) for p in sorted(earlier) if earlier[p] in mine]
    out: list[int] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a][1] == y[c][1]:
            out.append(x[a][0])
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1][1] == y[d - 1][1]:
            b, d = b - 1, d - 1
            out.append(x[b][0])
        if a == b or c == d:
            continue
        once_x, once_y = Counter(line for _, line in x[a:b]), Counter(line for _, line in y[c:d])
        at = {y[j][1]: j for j in range(c, d) if once_y[y[j][1]] == 1}
        anchors = [(i, at[x[i][1]]) for i in range(a, b) if once_x[x[i][1]] == 1 and x[i][1] in at]
        chosen = [anchors[i] for i in increasing([j for _, j in anchors])]
        out += [x[i][0] for i, _ in chosen]
        if chosen:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip([(a - 1, c - 1), *chosen], [*chosen, (b, d)], strict=True)]
    return sorted(out)


def left_over(later: dict[int, int], earlier: dict[int, int], done: list[int]) -> list[list[int]]:
    """The later document's places that aren't done, in runs of adjacent lines that the earlier one has in the same order."""
    places: dict[int, list[int]] = {}
    for q in sorted(earlier):
        places.setdefault(earlier[q], []).append(q)
    out: list[list[int]] = []
    at = -1
    for p in sorted(later.keys() - done):
        qs = places[later[p]]
        k = bisect_right(qs, at)
        if out and p == out[-1][-1] + 1 and k < len(qs):
            out[-1].append(p)
            at = qs[k]
        else:
            out.append([p])
            at = qs[0]
    return out


def blocks(places: set[int], words: dict[int, int], least: int) -> list[int]:
    """Those places that lie in runs of at least so many words."""
    out: list[int] = []
    run: list[int] = []
    for p in [*sorted(places), None]:
        if run and (p is None or p != run[-1] + 1):
            if sum(words[x] for x in run) >= least:
                out += run
            run = []
        if p is not None:
            run.append(p)
    return out


def common_blocks(later: list[dict], earlier: list[dict], least: int) -> list[tuple[int, int]]:
    """(start, stop) of the runs of lines of the later document that are blocks in common with the earlier one.

    Both are lists of lines, each with h, its places and its number of words.
    """
    number = {x["h"]: i for i, x in enumerate(earlier)}
    words, mine, theirs = {}, {}, {}
    for x in later:
        if (i := number.get(x["h"])) is not None:
            for v in x["at"]:
                mine[v >> 32], words[v >> 32] = i, x["words"]
    for i, x in enumerate(earlier):
        for v in x["at"]:
            theirs[v >> 32] = i
    done = aligned(mine, theirs)
    gone = set(blocks(set(done), words, least))
    for places in left_over(mine, theirs, done):
        gone.update(blocks(set(places), words, least))
    return runs(gone)


def runs(places: set[int]) -> list[tuple[int, int]]:
    """(start, stop) of the runs of adjacent places."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def flags_of(lines: list[dict], spans: list[dict]) -> list[bool]:
    """Whether the line at a place goes, up to the last that does, for spans of lines with words; lines without words go between those that go."""
    lies = {v >> 32: v & 0xFFFFFFFF for x in lines for v in x["at"]}
    gone = {p for s in spans for p in range(s["start"], s["stop"])}
    flags = [False] * (lies[max(gone)] + 1)
    for start, stop in runs(gone):
        for x in range(lies[start], lies[stop - 1] + 1):
            flags[x] = True
    return flags


def few(batch: pa.RecordBatch, rows: int = 128) -> Iterator[dict]:
    """The rows of a batch as dictionaries, of which only so many are held at a time."""
    for i in range(0, batch.num_rows, rows):
        yield from batch.slice(i, rows).to_pylist()


def deletions(docs: DataFrame, block_words: int = 25) -> DataFrame:
    """(id, key, gone): for each later document that loses lines, whether the line at a place goes, up to the last that does."""
    lines = written(shared_lines(docs, block_words), "lines")
    place = F.struct("id", "key")
    # in a table of its own, so that the join with it can be split where a line is very frequent
    stats = lines.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("df")).filter("first <> last")
    stats = written(stats.select("h", "first", "df"), "stats")
    shared = written(lines.join(stats, "h"), "shared")
    dropped(lines)
    dropped(stats)
    later = shared.filter("id <> first.id or key <> first.key")
    pairs = later.select("id", "key", F.col("first.id").alias("id_e"), F.col("first.key").alias("key_e"))
    rare = shared.filter(F.col("df").between(3, RARE) & (F.col("words") > 0)).select("h", "id", "key")  # of two documents one is the first
    other = rare.select(F.col("h").alias("h_e"), F.col("id").alias("id_e"), F.col("key").alias("key_e"))
    near = rare.join(other, (F.col("h") == F.col("h_e")) & ((F.col("id") > F.col("id_e")) | (F.col("id") == F.col("id_e")) & (F.col("key") > F.col("key_e"))))
    pairs = pairs.unionByName(near.select("id", "key", "id_e", "key_e")).distinct()
    # a set: repeated rows give the same lines
    lists = written(shared.filter("words > 0").groupBy("id", "key").agg(F.collect_set(F.struct("h", "at", "words")).alias("lines")), "lists")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {"id": [], "key": [], "start": [], "stop": []}
            for row in few(batch):
                for start, stop in common_blocks(row["lines"], row["lines_e"], block_words):
                    for c, v in zip(found, (row["id"], row["key"], start, stop), strict=True):
                        found[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64() if c in ("id", "key") else pa.int32()) for c, v in found.items()})

    both = pairs.join(lists, ["id", "key"]).join(lists.withColumnsRenamed({"id": "id_e", "key": "key_e", "lines": "lines_e"}), ["id_e", "key_e"])
    blocks_of = both.select("id", "key", "lines", "lines_e").mapInArrow(align, "id long, key long, start int, stop int")
    passages = later.filter("words < 0").select("id", "key", "words", F.explode("at").alias("v")).select("id", "key", F.shiftright("v", 32).cast("int").alias("start"), (F.shiftright("v", 32) - F.col("words")).cast("int").alias("stop"))
    spans = blocks_of.unionByName(passages).groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [flags_of(row["lines"], row["spans"]) for row in few(batch.select(["lines", "spans"]))]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "key": batch.column("key"), "gone": pa.array(gone, pa.list_(pa.bool_()))})

    gone = written(spans.join(lists, ["id", "key"]).select("id", "key", "lines", "spans").mapInArrow(flags, "id long, key long, gone array<boolean>"), "gone")
    dropped(shared)
    dropped(lists)
    return gone


def dedup_lines(docs: DataFrame, block_words: int = 25, drop_emptied: bool = False) -> DataFrame:
    """The documents without the common blocks that an earlier document has, with n_gone, the number of lines deleted.

    With `drop_emptied`, documents that lose all their words are dropped.
    """
    columns = docs.columns
    at, key, flags, mark = unused(docs, "at", "key", "gone", "mark")
    gone = deletions(docs, block_words)
    held = held_keys(gone, F.xxhash64("id", "key"))
    place = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), text_key())
    known = marked(docs, F.xxhash64(*place), held, mark)
    # texts that lose nothing aren't shuffled
    met = known.filter(mark).withColumns({at: place[0], key: place[1]}).join(gone.withColumnsRenamed({"id": at, "key": key, "gone": flags}), [at, key], "left")
    loses = F.col(flags).isNotNull()
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))
    n_gone = F.when(loses, F.size(F.filter(flags, lambda g: g))).otherwise(0).cast("long")
    changed = {"text": F.when(loses, F.array_join(left, "\n")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(loses, F.length(changed["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = [c for c in columns if c != "n_gone"]
    out = met.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in kept], n_gone.alias("n_gone"))
    out = known.filter(~F.col(mark)).select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_gone")).unionByName(out)
    if drop_emptied:
        out = out.filter((F.col("n_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out
