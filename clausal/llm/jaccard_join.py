"""N-gram Jaccard join: parity sketches, pigeonhole candidates, exact verification.

Every document is a set of hashed word shingles. Within a size band the shingles are
dealt to m parts and each part keeps a parity sketch: every shingle flips one bit of
2**64, and as such a sketch is sparse, it is kept as the XOR of random words, one for each
of its bits. Sketches differ in at most as many bits as sets differ in elements. Sets that
reach the threshold differ in at most d elements, so at least m - d parts are untouched
and equal; documents meet in the buckets of equal parts. Parts of a few shingles say
little; a document files them only if it has m - d of them or more, as otherwise a strong
part is among the untouched ones anyway. Of the buckets that a set is filed in, the most
common ones go, one fewer than any link shares: two linked sets still meet in one that stays.

Documents of equal sets form a class, of which one row goes on. In a bucket every class is
first compared with hubs, a few classes of the bucket. Verified links give components.
What is still apart in a bucket, across components, meets by what sets it apart from a
hub, the class in the midst of its group, passes a test on a whole-set sketch of fixed
width and is verified pair by pair, so that no link between components is lost, while a
group of copies, linked or not, costs a few comparisons a member.

Defined results: a null or empty text has an empty set and is linked with nothing; with
fewer words than a shingle has, the whole word sequence is the one element; repeated rows
share a class; a null id counts as greater than all others; a very long text has one set
like any other, in a band of its size; an empty table gives no rows; other columns don't
matter to link_groups, and keep_one returns them as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausal.llm.common import WORD, dropped, held_keys, marked, released, slices, text_key, unused, written
from clausal.llm.components import components

_WORDS = re.compile(WORD.encode())

#: Parts beyond d + 1, at least and by share of d: the more, the more buckets a link shares at least.
SPARE, SPARE_SHARE = 2, 0.25

#: Width of a size band: its upper border divided by the lower.
BAND = 1.5

#: 64-bit words of the whole-set sketch by which far pairs of a bucket are told apart.
WIDE = 16

#: Passes over the buckets: shuffles hold about so small a part of them at a time.
PASSES = 4

#: Members up to which an open bucket's are paired with one another.
SMALL = 8

#: Digests of sets that a task remembers, so as to file equal ones once.
SEEN = 200_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(29))) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, k: int, cache: int = 100_000):
        self.k, self.cache, self.known = k, cache, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        k, known, out = self.k, self.known, []
        if len(known) > self.cache:
            known.clear()
        for text in texts:
            words = _WORDS.findall((text or "").encode().lower())  # bytes: lowers A-Z alone
            if not words:
                out.append(np.zeros(0, dtype=np.uint64))
                continue
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
            n = max(1, len(h) - k + 1)
            s = np.zeros(n, dtype=np.uint64)
            for i in range(min(k, len(h))):
                s = mixed(s * _M3 + h[i : i + n])
            out.append(np.unique(s))
        return out


def band_plan(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """The size bands: (least size, size after it, d, m). Two linked sets of which the larger is in band b differ by at most d."""
    bands, lo = [], 1
    while lo < most:
        hi = max(lo + 1, int(lo * BAND))
        # |A ^ B| <= (1 - J) / (1 + J) (|A| + |B|), and both have at most hi - 1
        d = (100 - percent) * 2 * (hi - 1) // (100 + percent)
        bands.append((lo, hi, d, d + 1 + (max(SPARE, int(SPARE_SHARE * d)) if d > 1 else 0)))
        lo = hi
    return bands


def strong_from(percent: int) -> int:
    """How many shingles a part needs to be filed: the most, up to three, that leave a spare of m - d parts.

    Sizes of parts are about Poisson, and least at a band's lower border. The number is the
    same for all documents of a join, which the least number of shared buckets rests on.
    """
    mean = 1 / ((1 + SPARE_SHARE) * BAND * 2 * (100 - percent) / (100 + percent))
    weak, chance = 0.0, math.exp(-mean)
    for k in range(3):
        weak, chance = weak + chance, chance * mean / (k + 1)
        if weak * (1 + SPARE_SHARE) > 0.7 * SPARE_SHARE:
            return max(1, k)
    return 3


def parts_of(s: np.ndarray, band: int, d: int, m: int, strong: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Part numbers to file for a set in a band, their parity sketches and sizes, and how many of them any linked set shares at least."""
    h = mixed(s + np.uint64(band * int(_M3) & 0xFFFFFFFFFFFFFFFF))
    part = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    counts = np.bincount(part, minlength=m)
    bits = mixed(h)[np.argsort(part, kind="stable")]
    parity = np.zeros(m, dtype=np.uint64)
    full = np.flatnonzero(counts)
    parity[full] = np.bitwise_xor.reduceat(bits, np.r_[0, np.cumsum(counts[full])[:-1]])
    filled = np.flatnonzero(counts >= strong)
    weak = m - len(filled)
    # with all parts filed one is shared at least: the other set may file its strong parts alone
    file, need = (np.arange(m), 1) if weak >= m - d else (filled, m - d - weak)
    return file, parity[file], counts[file], need


def wide_sketch(s: np.ndarray) -> np.ndarray:
    h = mixed(s ^ _M2)
    flips = np.bincount((h % np.uint64(64 * WIDE)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def filed(s: np.ndarray, own: int, bands: list[tuple[int, int, int, int]], percent: int, strong: int) -> list[tuple[np.ndarray, int]]:
    """(bucket keys, shared at least) of a set for its own band and for the next one."""
    out = []
    for b in (own, own + 1):
        lo, _, d, m = bands[b]
        if not len(s) or not d or b > own and 100 * len(s) < percent * lo:
            out.append((np.zeros(0, dtype=np.uint64), len(s) + 1))  # only equal sets are near, or no set of the next band is near enough
            continue
        numbers, parity, counts, need = parts_of(s, b, d, m, strong)
        head = np.full(len(numbers), b, dtype=np.uint64) << np.uint64(48)
        out.append((mixed(mixed(head + numbers.astype(np.uint64)) + parity * _M3 + counts.astype(np.uint64)), need))
    return out


def sketched(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """A row for every row of docs: (doc_id, key, sig, h, n), its text key, the digest of its set, 63 bits of that, and the set's size; then where it is filed.

    `need0` and `need1` are the numbers of buckets that a linked set shares at least in the
    own band and in the next; k0, k1, .. are the buckets, a column for each pass, and c0,
    c1, .. say how many of these belong to the own band. Of the rows of a task that have
    equal sets only one is filed.
    """
    bands, strong = band_plan(percent), strong_from(percent)
    lows = np.array([b[0] for b in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        for part in slices(batches):
            sizes, sigs, needs, keys, owner, slot = [], [], ([], []), [], [], []
            for i, s in enumerate(shingler.sets(part.column("text").to_pylist())):
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                new = len(s) and sigs[-1] not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sigs[-1])
                where = filed(s, int(np.searchsorted(lows, len(s), side="right")) - 1, bands, percent, strong) if new else [(np.zeros(0, dtype=np.uint64), 1)] * 2
                for j, (found, need) in enumerate(where):
                    needs[j].append(need)
                    keys.append(found)
                    owner.append(np.full(len(found), i))
                    slot.append(np.full(len(found), j))
            key, own, which = np.concatenate(keys), np.concatenate(owner).astype(np.int64), np.concatenate(slot)
            out = {
                "doc_id": part.column("doc_id"), "key": part.column("key"), "sig": pa.array(sigs, pa.binary()),
                "h": pa.array(np.frombuffer(b"".join(sigs), dtype=np.int64)[::2] & ~1), "n": pa.array(sizes, pa.int64()), "need0": pa.array(needs[0], pa.int32()), "need1": pa.array(needs[1], pa.int32()),
            }
            for p in range(PASSES):
                mine = key % np.uint64(PASSES) == p
                counts = np.bincount(own[mine], minlength=len(sizes))
                ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                out[f"c{p}"] = pa.array(np.bincount(own[mine & (which == 0)], minlength=len(sizes)), pa.int32())
                out[f"k{p}"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[mine].view(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, key long, sig binary, h long, n long, need0 int, need1 int, " + ", ".join(f"c{p} int, k{p} array<long>" for p in range(PASSES))
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(run, schema)


def met_in_buckets(full: DataFrame) -> list[DataFrame]:
    """(bucket, cnt, slot, need), a table for each pass: the members of all buckets that hold two sets or more.

    A slot is a set in a band: `h`, plus one for the next band. Buckets are counted by a
    hash aggregate, whose rows of one bucket combine before the shuffle, and only members
    of repeated buckets come out of the join; the passes bound the disk that shuffles hold.
    """
    parts = []
    for p in range(PASSES):
        rows = full.select("h", "need0", "need1", f"c{p}", F.posexplode(f"k{p}").alias("pos", "bucket"))
        after = F.col("pos") >= F.col(f"c{p}")
        rows = rows.select("bucket", (F.col("h") + after.cast("long")).alias("slot"), F.when(after, F.col("need1")).otherwise(F.col("need0")).alias("need"))
        ends = rows.groupBy("bucket").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count(F.lit(1)).alias("cnt")).filter("lo < hi").select("bucket", "cnt")
        parts.append(written(rows.join(ends, "bucket").select("bucket", "cnt", "slot", "need"), "buckets"))
        del rows, ends
        released(full.sparkSession)
    return parts


def rarest(met: DataFrame) -> DataFrame:
    """(bucket, slot): of each slot's buckets all but the `need` - 1 most common ones.

    Two linked sets share `need` buckets or more, so they share one of those left, whatever
    the order, as long as it is the same for all. A slot has as many rows as its set has parts.
    """
    once = met.groupBy("slot", "bucket").agg(F.first("cnt").alias("cnt"), F.first("need").alias("need"))
    place = Window.partitionBy("slot").orderBy(F.desc("cnt"), F.desc("bucket"))
    return once.withColumn("place", F.row_number().over(place)).filter("place >= need").select("bucket", "slot")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(nid, n, items, wide) of the wanted classes (nid, cid, rkey, sig), from the texts of their first rows.

    A bitmap of fixed size at most goes to all tasks, so that hardly any other texts are
    read, and only sets are shuffled, not texts.
    """
    held = held_keys(wanted, F.xxhash64("cid", "rkey"))
    found = marked(docs.select("doc_id", "text"), F.xxhash64(F.col("doc_id").cast("long"), text_key()), held, "wanted").filter("wanted").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        for part in slices(batches):
            rows = []
            for s in shingler.sets(part.column("text").to_pylist()):
                sig = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and sig not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sig)
                    rows.append((sig, s))
            yield pa.RecordBatch.from_pydict({
                "sig": pa.array([sig for sig, _ in rows], pa.binary()), "n": pa.array([len(s) for _, s in rows], pa.int64()),
                "items": pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64())), "wide": pa.array([wide_sketch(s).view(np.int64) for _, s in rows], pa.list_(pa.int64())),
            })

    once = found.mapInArrow(run, "sig binary, n long, items array<long>, wide array<long>").dropDuplicates(["sig"])
    return once.join(wanted.select("sig", "nid"), "sig").select("nid", "n", "items", "wide")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold, compared in integers."""
    a = sets.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    b = sets.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = pairs.join(a, "a").join(b, "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    common = F.size(F.array_intersect("ia", "ib"))
    return both.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _open(rows: DataFrame) -> DataFrame:
    """The rows (bucket, nid, label) of buckets with two labels or more, with the number of members."""
    ends = rows.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("members")).filter("least < most")
    return rows.join(ends.select("bucket", "members"), "bucket")


def _midst(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, midst): of the members (nid, hub) of each group the one whose set differs least from all others'.

    The differences of a set of n elements and N others add up to a constant plus N n less
    twice the number of members that have each of its elements.
    """
    each = groups.select("hub", "nid").join(sets.select("nid", "items"), "nid").select("hub", "nid", F.explode("items").alias("e"))
    common = each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("c"))
    held = each.join(common, ["hub", "e"]).groupBy("hub", "nid").agg(F.sum("c").alias("held"), F.count(F.lit(1)).alias("n"))
    members = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    apart = F.col("members") * F.col("n") - 2 * F.col("held")
    return held.join(members, "hub").groupBy("hub").agg(F.min(F.struct(apart.alias("apart"), "nid")).alias("best")).select("hub", F.col("best.nid").alias("midst"))


def _beside_hubs(large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with the hubs of large open buckets, and buckets (bucket, nid, linked, n, owes, has, strict, loose) in which their other members meet if they may be linked.

    A member x is held as D(x), what it and its bucket's hub h don't have in common. Sets
    are linked if (100 + percent) |D(x) ^ D(y)| <= (100 - percent) (|x| + |y|), so if y isn't
    linked with h, D(x) and D(y) have an element in common, and more than
    (|D(x)| + (|h| - |x|) (100 - percent) / (100 + percent)) / 2 of them; whatever y is,
    all but as many of D(x) as linked sets may differ in. So members meet by the rarest
    elements of D(x), which are the changes that few others have too, and a group of
    copies with changes of their own makes no pairs. Both bounds hold for two members that
    aren't linked with h, so the greater one counts for these (`strict`).

    Of what a pair has in common, let e be the rarest: all of it is in the places up to e's,
    from the most common on, so 2 (100 + percent) times either place is at least owes(x) +
    owes(y), with owes(x) = (100 + percent) |D(x)| - (100 - percent) |x|. So a member has, by
    e, its place times that less what it owes itself, and two meet by e only if what each has
    does for what the other owes. Members of unlike texts that have a few passages in
    common have elements of each in many buckets, but in places that don't do. Buckets of one group agree on a hub,
    by votes of their members, and take the member in the midst of the group in its place:
    what a hub has that no other member has is in D(x) of all, and if that were more than
    x has of its own, all would meet by it.
    """
    own = large.select("bucket", "nid", "label")
    votes = own.join(_central(own).select("bucket", "hub.nid").withColumnRenamed("nid", "hub"), "bucket").groupBy("nid", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("nid").agg(F.max(F.struct("c", "hub")).alias("best")).select("nid", "best.hub")
    chosen = own.join(best, "nid").groupBy("bucket", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "hub")).alias("best"))
    groups = written(own.join(chosen.select("bucket", "best.hub"), "bucket").select("nid", "label", "hub").distinct(), "groups")
    met = groups.join(_midst(groups, sets), "hub").select("nid", "label", F.col("midst").alias("hub")).filter("nid <> hub").distinct()
    both = met.join(sets.select("nid", "n", "items"), "nid").join(sets.select(F.col("nid").alias("hub"), F.col("n").alias("nh"), F.col("items").alias("of_hub")), "hub")
    diffs = both.select("nid", "label", "hub", "n", "nh", F.concat(F.array_except("items", "of_hub"), F.array_except("of_hub", "items")).alias("d"))
    size = F.size("d").cast("long")
    diffs = written(diffs.withColumn("linked", (100 + percent) * size <= (100 - percent) * (F.col("n") + F.col("nh"))), "diffs")
    dropped(groups)
    least = (100 + percent) * size + (100 - percent) * (F.col("nh") - F.col("n")) + 1
    far = F.greatest(F.lit(1), size - F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent + 1e-9)) / (100 + percent) + 1e-9))
    near = F.greatest(far, F.ceil(least / (2 * (100 + percent)) - 1e-9))
    owes = (100 + percent) * size - (100 - percent) * F.col("n")
    rows = diffs.select("nid", "label", "hub", "linked", "n", near.alias("near"), far.alias("far"), owes.alias("owes"), F.explode("d").alias("e")).withColumn("bucket", F.xxhash64("hub", "e"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")
    place = Window.partitionBy("nid", "hub").orderBy(F.desc("cnt"), F.desc("bucket"))
    ranked = rows.join(counts, "bucket").withColumn("place", F.row_number().over(place)).withColumn("has", 2 * (100 + percent) * F.col("place") - F.col("owes"))
    # elements met once come last, so the first near - 1 or far - 1 places of D(x) may go
    ranked = written(ranked.filter("place >= if(linked, near, far)").select("bucket", "nid", "linked", "n", "owes", "has", (F.col("place") >= F.col("near")).alias("strict")), "ranked")
    # what a member has by this bucket must do for the one that owes least
    ends = ranked.groupBy("bucket").agg(F.min(F.when(F.col("strict") & ~F.col("linked"), F.col("owes"))).alias("strict_least"), F.min(F.when(~F.col("linked"), F.col("owes"))).alias("least"), F.min(F.when(F.col("linked"), F.col("owes"))).alias("linked_least"), F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")
    meets = F.when(F.col("linked"), F.col("has") >= F.col("least")).otherwise(F.col("strict") & (F.col("has") >= F.col("strict_least")))
    kept = ranked.join(ends, "bucket").withColumn("strict", F.coalesce(meets, F.lit(False))).withColumn("loose", F.coalesce(~F.col("linked") & (F.col("has") >= F.col("linked_least")), F.lit(False)))
    changes = written(kept.filter("strict or loose").select("bucket", "nid", "linked", "n", "owes", "has", "strict", "loose"), "changes")
    dropped(ranked)
    links = written(diffs.filter("linked").select(F.col("nid").alias("a"), F.col("hub").alias("b")), "links")
    dropped(diffs)
    return links, changes


def _meetings(changes: DataFrame, percent: int) -> DataFrame:
    """(a, b), once for each bucket by which they may be linked: members of different labels."""
    y = changes.select(F.col("bucket").alias("bucket_y"), F.col("nid").alias("b"), F.col("label").alias("lb"), F.col("linked").alias("linked_y"), F.col("n").alias("nb"), F.col("owes").alias("owes_y"), F.col("has").alias("has_y"), F.col("strict").alias("strict_y"))
    apart = (F.col("bucket") == F.col("bucket_y")) & (F.col("label") != F.col("lb"))
    does = (F.col("has") >= F.col("owes_y")) & (F.col("has_y") >= F.col("owes")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
    neither = changes.filter("not linked and strict").join(y.filter("not linked_y and strict_y"), apart & (F.col("nid") < F.col("b")) & does)
    either = changes.filter("not linked and loose").join(y.filter("linked_y and strict_y"), apart & does)
    return neither.select(F.col("nid").alias("a"), "b").unionByName(either.select(F.col("nid").alias("a"), "b"))


def _across(rows: DataFrame, changes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that sizes and whole-set sketches leave possible: all of a bucket in rows, and those of changes that may be linked."""
    pairs = _meetings(changes, percent)
    # sizes fall into cells one threshold wide: a set meets those of its own cell and of the next
    sized = rows.select("bucket", "nid", "label").join(sets.select("nid", "n"), "nid").withColumn("cell", F.floor(F.log(F.col("n")) / (math.log(100 / percent) * (1 + 1e-9))))
    x = sized.select("bucket", F.explode(F.array("cell", F.col("cell") + 1)).alias("at"), F.col("nid").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), "cell")
    y = sized.select(F.col("bucket").alias("bucket_y"), F.col("cell").alias("at_y"), F.col("nid").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    once = (F.col("cell") < F.col("at_y")) | (F.col("a") < F.col("b"))
    near = (F.col("la") != F.col("lb")) & once & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = pairs.unionByName(x.join(y, (F.col("bucket") == F.col("bucket_y")) & (F.col("at") == F.col("at_y")) & near).select("a", "b")).distinct()
    wide = sets.select("nid", "n", "wide")
    both = pairs.join(wide.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a").join(wide.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b")
    apart = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
    return written(both.filter((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))


def _joined(labels: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The labels with further links (a, b); the stars so far hold all that the links so far say."""
    out = components(reduce(DataFrame.unionByName, [labels.select(F.col("node").alias("a"), F.col("label").alias("b")), *links]))
    for frame in (labels, *links):
        dropped(frame)
    return out


def _central(open_rows: DataFrame) -> DataFrame:
    """(bucket, hub): of each bucket the member (nid, label) that is in most open buckets, as copies with few changes are."""
    degrees = open_rows.groupBy("nid").agg(F.count(F.lit(1)).alias("h"))
    return open_rows.join(degrees, "nid").groupBy("bucket").agg(F.max(F.struct("h", "nid", "label")).alias("hub"))


def _by_hubs(rows: DataFrame, labels: DataFrame, links: list[DataFrame], sets: DataFrame, percent: int, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """The labels after so many rounds over buckets (bucket, nid), or fewer if they have little more to give, and the links that these don't hold yet.

    A round takes a hub of each bucket that is still open, first the most central one, then
    any, and every class of another component in such buckets tries the hub that it meets most often.
    """
    for turn in range(rounds):
        open_rows = written(_open(_labelled(rows, labels).select("bucket", "nid", "label")), "open")
        hubs = _central(open_rows) if turn == 0 else open_rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "nid").alias("h"), "nid", "label")).alias("hub"))
        tries = open_rows.join(hubs, "bucket").filter("label <> hub.label")
        votes = tries.groupBy("nid", F.col("hub.nid").alias("hub")).agg(F.count(F.lit(1)).alias("c"))
        pairs = written(votes.groupBy("nid").agg(F.max(F.struct("c", "hub")).alias("best")).select(F.col("nid").alias("a"), F.col("best.hub").alias("b")), "pairs")
        more = written(verified(pairs, sets, percent), "links")
        found, tried = more.count(), pairs.count()
        links = [*links, more]
        dropped(open_rows)
        dropped(pairs)
        if found * 16 < tried or not found:
            break
        labels, links = _joined(labels, links), []
    return labels, links


def link_groups(docs: DataFrame, percent: int = 80, k: int = 5, rounds: int = 6) -> DataFrame:
    """(doc_id, key, n_shingles, label, component_id) of every row: the components of all pairs with 100 |A & B| >= percent |A | B|.

    key is the row's text key, label a number of the component (null for an empty set),
    component_id its least doc_id. Intermediate tables go to the shared folder and are
    deleted after their last read; only the two that the result reads stay.
    """
    spark = docs.sparkSession
    full = written(sketched(docs, percent, k).withColumn("nid", F.monotonically_increasing_id()), "sketches")
    rows = written(full.select("doc_id", "key", "sig", "n"), "rows")
    # of equal sets the row of the least id stands for all
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "nid", "key")
    classes = full.filter("n > 0").groupBy("sig").agg(F.min(place).alias("first"), F.first("h").alias("h"))
    classes = written(classes.select("sig", "h", F.col("first.nid").alias("nid"), F.col("first.doc_id").alias("cid"), F.col("first.key").alias("rkey")), "classes")
    met = met_in_buckets(full)
    dropped(full)
    del full
    # from here on nodes are classes; two sets of one h, should there be any, both stand where it does
    kept = rarest(reduce(DataFrame.unionByName, met)).withColumn("h", F.col("slot").bitwiseAND(F.lit(-2))).join(classes.select("h", "nid"), "h").select("bucket", "nid")
    kept = written(kept, "kept")
    for part in met:
        dropped(part)
    del met
    ends = kept.groupBy("bucket").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).filter("lo < hi").select("bucket")
    shared = written(kept.join(ends, "bucket"), "shared")
    dropped(kept)
    del kept, ends
    released(spark)
    wanted = classes.join(shared.select("nid").distinct(), "nid", "left_semi")
    sets = written(sets_of(docs, wanted, k), "sets")
    labels = spark.createDataFrame([], "node long, label long")
    labels, links = _by_hubs(shared, labels, [], sets, percent, rounds)
    # a bucket is open while it holds two components
    open_rows = written(_open(_labelled(shared, labels)), "open")
    if not open_rows.isEmpty():
        beside, changes = _beside_hubs(open_rows.filter(F.col("members") > SMALL), sets, percent)
        small = open_rows.filter(F.col("members") <= SMALL).select("bucket", "nid")
        labels, links = _by_hubs(small.unionByName(changes.select("bucket", "nid")), labels, [*links, beside], sets, percent, rounds)
        pairs = _across(_labelled(small, labels), _labelled(changes, labels), sets, percent)
        more = written(verified(pairs, sets, percent), "links")
        links = [*links, more]
        dropped(changes)
        dropped(pairs)
    labels = _joined(labels, links)
    dropped(open_rows)
    named = classes.select("nid", "sig", "cid").join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("sig", "cid", F.coalesce("label", "nid").alias("label"))
    least = named.groupBy("label").agg(F.min("cid").alias("component_id"))
    by_sig = written(named.join(least, "label").select("sig", "label", "component_id"), "components")
    for frame in (labels, classes, shared, sets):
        dropped(frame)
    out = rows.select("doc_id", "key", "sig", F.col("n").alias("n_shingles")).join(by_sig, "sig", "left")
    out = out.select("doc_id", "key", "n_shingles", "label", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out._clausal_reads = (rows, by_sig)
    return out


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The documents without all but one of each group: the row of the least id stays, of equal ids the one of the least text key.

    All columns stay as they are. Rows with an empty set are linked with nothing and all stay.
    """
    groups = link_groups(docs, percent, k)
    at, key = unused(docs, "at", "key")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "key")
    first = groups.filter("n_shingles > 0").groupBy("label").agg(F.min(place).alias("first"))
    first = written(first.select(F.col("first.id").alias(at), F.col("first.key").alias(key)), "chosen")
    for frame in groups._clausal_reads:
        dropped(frame)
    columns = docs.columns
    keyed = docs.withColumns({at: F.coalesce("doc_id", F.lit((1 << 63) - 1)), key: text_key()})
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = keyed.filter(worded).join(first, [at, key], "left_semi").dropDuplicates([at, key])
    return chosen.select(columns).unionByName(docs.filter(~worded).select(columns))
