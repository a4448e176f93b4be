"""Exact BM25 top-k search: an inverted index in shards, with block-max dynamic pruning.

Every scan partition is cut into shards of at most SHARD documents. A shard is one row:
its documents, sorted so that documents with the same frequent words stand together, and
for each term the postings. Document frequencies are summed over all shards, so that
scores are global, and the shards' answers merge exactly.

About the square root of all shards are searched first. The k-th best of their answers is
a floor that each query's k best reach at least, and the other shards only score again in
double precision what reaches it; equal scores rank by id.

In a shard, rare terms are added from their postings and frequent ones by matrix products,
for many queries at a time. What the rare terms give, and the greatest score of each
frequent term in each block of BLOCK documents, bound what a block can give to a query;
products are spared for blocks whose bound lies below the floor. This is block-max WAND
with blocks aligned over all terms. A shard without floors takes them from each query's
most promising blocks.

Queries pass in groups of a bounded number of queries and of terms, each broadcast to all shards.

Defined results: terms are lower-cased runs of letters and digits, each counted once in a
query; only documents that share a term with the query are ranked; null and empty texts
are never found and as queries find nothing; repeated rows are documents of their own;
a null id ranks last among equals; very long texts are indexed and asked whole; an empty
table of documents or of queries gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausal.llm.common import dropped, slices, text_key, written

_TOKENS = re.compile(r"[^\W_]+")

#: Documents of a shard, of a block, and queries that run against a shard at a time and in one broadcast.
SHARD, BLOCK, BATCH, GROUP = 12_288, 256, 384, 8_192

#: Terms of the queries in one broadcast, about, which take 4 bytes each and 16 more for each different one.
GROUP_TERMS = 3_000_000

#: Terms in at least so large a share of a shard's documents are scored by matrix products.
FREQUENT = 1 / 32

K1, B = 1.2, 0.75

LAST = (1 << 63) - 1


class Terms:
    """Hashed terms of texts; remembers the hashes of words."""

    def __init__(self, cache: int = 100_000):
        self.cache, self.known = cache, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes, ascending, and how often each occurs."""
        words = _TOKENS.findall((text or "").lower())
        known = self.known
        if len(known) > self.cache:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.unique(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)), return_counts=True)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + count), one after the other; no count is 0."""
    if not len(counts):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    steps = np.ones(ends[-1], dtype=np.int64)
    steps[0] = starts[0]
    steps[ends[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(steps, out=steps)


def packed_shard(ids: list[int | None], docs: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, bytes]:
    """A shard's arrays: ids and lengths by document, then terms, the end of each term's postings, their documents and counts.

    Counts take 16 bits; the postings with greater ones, and these, are listed in `more`.
    """
    sizes = np.array([len(t) for t, _ in docs], dtype=np.int64)
    terms = np.concatenate([t for t, _ in docs]) if docs else np.zeros(0, dtype=np.uint64)
    counts = np.concatenate([c for _, c in docs]) if docs else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    distinct, number, df = np.unique(terms, return_inverse=True, return_counts=True)
    # documents with the same of the most frequent terms stand together
    top = np.argsort(-df, kind="stable")[:24]
    place = np.full(len(distinct), -1)
    place[top] = np.arange(len(top))
    bits = np.zeros(len(docs), dtype=np.int64)
    hit = place[number] >= 0
    np.bitwise_or.at(bits, owner[hit], np.int64(1) << (len(top) - 1 - place[number[hit]]))
    order = np.argsort(-bits, kind="stable")
    new = np.empty(len(docs), dtype=np.int64)
    new[order] = np.arange(len(docs))
    by = np.lexsort((new[owner], number))
    counts = counts[by].astype(np.int64)
    more = np.flatnonzero(counts > 65535)
    lengths = np.array([int(c.sum()) for _, c in docs], dtype=np.int32)
    return {
        "ids": np.array([LAST if i is None else i for i in ids], dtype=np.int64)[order].tobytes(), "lengths": lengths[order].tobytes(),
        "terms": distinct.tobytes(), "ends": np.cumsum(df).astype(np.int32).tobytes(), "docs": new[owner][by].astype(np.uint16).tobytes(), "counts": np.minimum(counts, 65535).astype(np.uint16).tobytes(), "more": np.concatenate([more, counts[more]]).astype(np.int64).tobytes(),
    }


def indexed(docs: DataFrame) -> DataFrame:
    """One row for each shard of (doc_id, text)."""
    names = ["ids", "lengths", "terms", "ends", "docs", "counts", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size, read = 0, Terms()
        numbers = count(TaskContext.get().partitionId() << 32)

        def row() -> pa.RecordBatch:
            shard = packed_shard(ids, found)
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *(pa.array([shard[n]], pa.binary()) for n in names)], names=["shard", *names])

        for part in slices(batches):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids.append(i)
                found.append(read(text))
                size += len(found[-1][0])
                if len(ids) == SHARD or size > 8_000_000:
                    yield row()
                    ids, found, size = [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["shard long", *(f"{n} binary" for n in names)]))


def statistics(index: DataFrame) -> tuple[DataFrame, int, float, int]:
    """(term, df) over all shards, the number of documents, their mean length and the number of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                terms = np.frombuffer(b.column("terms")[i].as_py(), dtype=np.int64)
                ends = np.frombuffer(b.column("ends")[i].as_py(), dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms), "df": pa.array(np.diff(ends, prepend=0).astype(np.int64))})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = [np.frombuffer(x, dtype=np.int32) for x in b.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x) for x in lengths], pa.int64()), "words": pa.array([int(x.sum()) for x in lengths], pa.int64())})

    total = index.select("lengths").mapInArrow(sums, "n long, words long").agg(F.sum("n"), F.sum("words"), F.count(F.lit(1))).first()
    n = total[0] or 0
    df = index.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return df, n, (total[1] or 0) / max(n, 1), total[2]


class Asked(NamedTuple):
    """A group of queries: ids, keys, scores that each one's k best reach at least (0: not known), and their terms as places in one ascending list."""

    ids: np.ndarray
    keys: np.ndarray
    floors: np.ndarray
    ends: np.ndarray
    places: np.ndarray
    terms: np.ndarray
    idf: np.ndarray


class Shard:
    """A shard ready for the search of a group of queries."""

    def __init__(self, row: dict[str, bytes], mean: float, asked: Asked):
        self.asked = asked
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.n = len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        terms = np.frombuffer(row["terms"], dtype=np.uint64)
        ends = np.frombuffer(row["ends"], dtype=np.int32).astype(np.int64)
        self.start, self.df = np.r_[0, ends[:-1]], np.diff(ends, prepend=0)
        docs = np.frombuffer(row["docs"], dtype=np.uint16)
        self.docs = docs.astype(np.int64)
        # the group's terms as the shard's, or -1
        at = np.searchsorted(terms, asked.terms)
        at[at == len(terms)] = 0
        self.number = (np.where(terms[at] == asked.terms, at, -1) if len(terms) else np.full(len(asked.terms), -1)).astype(np.int32)
        idf = np.zeros(len(terms))
        idf[self.number[self.number >= 0]] = asked.idf[self.number >= 0]
        tf = np.frombuffer(row["counts"], dtype=np.uint16).astype(np.float64)
        at, counts = np.frombuffer(row["more"], dtype=np.int64).reshape(2, -1)
        tf[at] = counts
        lengths = np.frombuffer(row["lengths"], dtype=np.int32)
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        owner = np.repeat(np.arange(len(terms), dtype=np.int32), self.df)
        gain = tf * (K1 + 1) / (tf + norm[self.docs]) * idf[owner]  # what a posting adds to the score of a query with its term
        self.gain = gain.astype(np.float32)
        # frequent terms as a dense matrix for each block, of the terms that it has, and block maxima
        frequent = np.flatnonzero((self.df >= max(FREQUENT * self.n, 2)) & (idf > 0))
        self.column = np.full(len(terms), -1)
        self.column[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), self.blocks * BLOCK), dtype=np.float32)
        at = ranges(self.start[frequent], self.df[frequent])
        dense[np.repeat(np.arange(len(frequent)), self.df[frequent]), self.docs[at]] = self.gain[at]
        self.most = dense.reshape(len(frequent), self.blocks, BLOCK).max(axis=2) if self.n else dense
        self.columns = [np.flatnonzero(self.most[:, b]) for b in range(self.blocks)]
        self.dense = [dense[c, b * BLOCK : (b + 1) * BLOCK] for b, c in enumerate(self.columns)]
        # the forward index, for exact scores
        by_doc = np.argsort(docs, kind="stable")
        self.sizes = np.bincount(self.docs, minlength=self.n)
        self.doc_start = np.cumsum(self.sizes) - self.sizes
        self.doc_terms, self.doc_gain = owner[by_doc], gain[by_doc]

    def exact(self, doc: int, numbers: np.ndarray) -> float:
        """A document's score for terms (numbers ascending), in double precision and in the order of terms."""
        mine = slice(self.doc_start[doc], self.doc_start[doc] + self.sizes[doc])
        terms, gain = self.doc_terms[mine], self.doc_gain[mine]
        if len(numbers) < len(terms):
            at = np.searchsorted(terms, numbers)
            at[at == len(terms)] = 0
            return float(np.sum(gain[at[terms[at] == numbers]]))
        at = np.searchsorted(numbers, terms)
        at[at == len(numbers)] = 0
        return float(np.sum(gain[numbers[at] == terms]))

    def search(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query that finds any: its place in the group, and of the documents that reach its floor the scores and ids of the k best."""
        for begin in range(0, len(self.asked.ids), BATCH):
            yield from self._batch(begin, k)

    def _batch(self, begin: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        floor = self.asked.floors[begin : begin + BATCH].copy()
        nq = len(floor)
        # the shard's terms of each query
        ends = self.asked.ends[begin : begin + nq]
        starts = np.r_[self.asked.ends[begin - 1] if begin else 0, ends[:-1]]
        numbers = self.number[self.asked.places[starts[0] : ends[-1]]]
        owner = np.repeat(np.arange(nq), ends - starts)[numbers >= 0]
        numbers = numbers[numbers >= 0]
        border = np.searchsorted(owner, np.arange(nq + 1))
        column = self.column[numbers]
        has = np.zeros((nq, len(self.most)), dtype=np.float32)
        has[owner[column >= 0], column[column >= 0]] = 1
        rare, rare_owner = numbers[column < 0], owner[column < 0]
        score = np.zeros((nq, self.blocks * BLOCK), dtype=np.float32)
        for q in range(0, nq, 8):  # so many queries at a time, whose scores stay in the cache
            own = slice(*np.searchsorted(rare_owner, (q, q + 8)))
            counts = self.df[rare[own]]
            postings = ranges(self.start[rare[own]], counts)
            each = np.bincount(rare_owner[own] - q, weights=counts, minlength=8).astype(np.int64)
            np.add.at(score[q : q + 8].reshape(-1), self.docs[postings] + np.repeat(np.arange(8) * score.shape[1], each), self.gain[postings])
        # sums of m terms in single precision are off by m roundings at most
        slack = 1e-5 + 1.2e-7 * (ends - starts)
        bound = (score.reshape(nq, self.blocks, BLOCK).max(axis=2) + has @ self.most) * (1 + 2 * slack)[:, None] + 1e-5
        done = np.zeros((nq, self.blocks), dtype=bool)

        def add(live: np.ndarray) -> None:
            """Completes the scores of (query, block) pairs, block by block for all its queries at once."""
            for b in np.flatnonzero(live.any(axis=0)):
                qs = np.flatnonzero(live[:, b])
                if len(self.columns[b]):
                    score[qs, b * BLOCK : (b + 1) * BLOCK] += np.take(has[qs], self.columns[b], axis=1) @ self.dense[b]
            done[live] = True

        new = np.flatnonzero(floor <= 0) if self.n > k else []
        if len(new):  # queries without a floor get one from their most promising blocks
            first = min(self.blocks, max(2, -(-2 * k // BLOCK)))
            best = np.argpartition(-bound[new], first - 1, axis=1)[:, :first]
            live = np.zeros((nq, self.blocks), dtype=bool)
            live[new[:, None], best] = True
            add(live)
            floor[new] = np.partition(score[new, : self.n], -k, axis=1)[:, -k]
        add((bound >= floor[:, None]) & ~done)
        if len(new):
            floor[new] = np.partition(score[new, : self.n], -k, axis=1)[:, -k]
        least = np.maximum(floor * (1 - 3 * slack) - 1e-5, 1e-30).astype(np.float32)
        qs, docs = np.divmod(np.flatnonzero(score >= least[:, None]), score.shape[1])
        for q, some in zip(range(nq), np.split(docs, np.searchsorted(qs, np.arange(1, nq))), strict=True):
            if len(some):
                mine = numbers[border[q] : border[q + 1]]
                scores = np.array([self.exact(d, mine) for d in some.tolist()])
                order = np.lexsort((self.ids[some], -scores))[:k]
                order = order[scores[order] >= self.asked.floors[begin + q]]
                yield begin + q, scores[order], self.ids[some[order]]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of (doc_id, text) for each query (query_id, text)."""
    spark = docs.sparkSession
    index = written(indexed(docs), "index")
    df, n, mean, shards = statistics(index)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Terms()
        for part in slices(batches):
            terms = [read(t)[0].view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"query_id": part.column("query_id"), "key": part.column("key"), "terms": pa.array(terms, pa.list_(pa.int64()))})

    asked = queries.select(F.col("query_id").cast("long"), text_key().alias("key"), "text").dropDuplicates(["query_id", "key"]).mapInArrow(parse, "query_id long, key long, terms array<long>")
    rows = asked.select("query_id", "key", F.explode("terms").alias("term")).join(df, "term")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = rows.groupBy("query_id", "key").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms"))
    weighed = written(weighed, "queries")
    asked_for, terms = weighed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    groups = max(-(-asked_for // GROUP), -(-terms // GROUP_TERMS))
    # the first answers come from about the square root of the number of shards
    turn = F.pmod(F.xxhash64("shard"), F.lit(max(1, round(shards**0.5))))
    first = index.agg(F.min(turn)).first()[0]
    answers = []

    def search(some: DataFrame, asked: Asked) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    asked = sent.value
                    shard = Shard({c: b.column(c)[i].as_py() for c in b.schema.names}, mean, asked)
                    found = list(shard.search(k))
                    if found:
                        qs = np.repeat([q for q, _, _ in found], [len(ids) for _, _, ids in found])
                        scores, doc_ids = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
                        yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked.ids[qs]), "key": pa.array(asked.keys[qs]), "doc_id": pa.array(doc_ids), "score": pa.array(scores)})

        answers.append(written(some.drop("shard").mapInArrow(run, "query_id long, key long, doc_id long, score double"), "answers"))
        sent.destroy()
        return answers[-1]

    place = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "doc_id")
    for g in range(groups):
        chosen = weighed.filter(F.pmod(F.xxhash64("query_id", "key"), F.lit(groups)) == g) if groups > 1 else weighed
        part = chosen.select("query_id", "key", F.col("terms.term").alias("t"), F.col("terms.idf").alias("w")).toArrow().combine_chunks()  # about GROUP queries
        if not part.num_rows:
            continue
        lists = part["t"].combine_chunks()
        each, at, places = np.unique(lists.flatten().to_numpy().view(np.uint64), return_index=True, return_inverse=True)
        sizes = pc.list_value_length(lists).to_numpy()
        places, ends = places[np.lexsort((places, np.repeat(np.arange(len(sizes)), sizes)))], np.cumsum(sizes)
        group = Asked(part["query_id"].to_numpy(), part["key"].to_numpy(), np.zeros(len(ends)), ends, places.astype(np.int32), each, part["w"].combine_chunks().flatten().to_numpy()[at])
        del part, lists
        found = search(index.filter(turn == first), group)
        # the rest need only reach the k-th of the first answers
        last = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == k).select("query_id", "key", "score").toArrow()
        floors = dict(zip(zip(last["query_id"].to_pylist(), last["key"].to_pylist(), strict=True), last["score"].to_pylist(), strict=True))
        search(index.filter(turn != first), group._replace(floors=np.array([floors.get(x, 0.0) for x in zip(group.ids.tolist(), group.keys.tolist(), strict=True)])))
    if not answers:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    best = every.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    dropped(weighed)
    dropped(index)
    return best.select("query_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")
