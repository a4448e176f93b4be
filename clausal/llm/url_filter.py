"""URL filtering by association rules.

Every URL becomes a set of tokens: its scheme, host labels and suffixes, path words and
query keys, all of them. Tokens too rare among the blocked URLs for any rule go before
mining, and tokens that stand in the same labelled URLs are mined as one, as their number
of combinations would grow without bound. FP-growth over the labelled URLs mines frequent token combinations; with the
label as a token of its own, rules "combination => blocked" come with their confidence.
Rules are pruned by support, by confidence, both absolute and against the share of blocked
URLs, and where a part of a combination is already
as sure. An inverted index from a rule's rarest token to the rule matches them.

Written rules (host, path) come first: a rule fits its host and all subdomains if the
URL's path starts with the rule's; the longest fitting rule wins. They are looked up by
the host's suffixes.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no
written rule, and is judged by its few tokens; URLs and
page ids repeat freely, and of several labels of a page the highest counts; labels other than
0 and 1 are ignored; without labels nothing is blocked but by written rules; a very long URL
is judged by all its tokens; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]

_BLOCKED = "\x00blocked"

LAST = (1 << 63) - 1

_WORD = re.compile(r"[^\W\d_]+|[0-9]+")


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(labels: list[str]) -> list[str]:
    """The suffixes of a host of two labels or more, the longest last; those too long for a host name as digests."""
    out, suffix = [], labels[-1]
    for label in reversed(labels[:-1]):
        suffix = f"{label}.{suffix}"
        if len(suffix) > 253:
            suffix = "#" + xxhash.xxh3_128_hexdigest(suffix.encode())
        out.append(suffix)
    return out


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL."""
    head, mark, rest = (url or "").partition("://")
    host, path, query = re.fullmatch(r"([^/?#]*)([^?#]*)(.*)", rest if mark else head, re.DOTALL).groups()
    labels = host.lower().split(".")
    out = [f"scheme:{head.lower()}"] if mark else []
    out += [f"host:{h}" for h in host_suffixes(labels)]
    out += [f"label:{w}" for label in labels for w in _WORD.findall(label)]
    out += [f"path:{w if w.isalpha() else '0' * min(len(w), 9)}" for w in _WORD.findall(path.lower())]
    out += [f"key:{k.partition('=')[0]}" for k in re.split("[?&#]", query.lower()) if k]
    return list(dict.fromkeys(out))


def written_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    labels = host.split(".") if host else []
    fits = [(text, verdict) for i in range(len(labels)) for start, text, verdict in rules.get(".".join(labels[i:]), ()) if path.startswith(start)]
    return max(fits, key=lambda r: len(r[0]), default=None)


def mined_rules(urls: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, most_tokens: int, min_rows: int, min_lift: float = 1.5) -> list[tuple[tuple[str, ...], float]]:
    """(tokens, confidence) of the rules for blocking, from urls (id, url) and labels (id, blocked).

    Their number doesn't grow with the data: with support s and t tokens a URL in the mean,
    at most t / s tokens are frequent, and combinations are of `most_tokens` at most.
    """
    kept = labels.filter("id is not null and blocked in (0, 1)").groupBy("id").agg(F.max("blocked").alias("blocked"))
    marked = urls.join(kept, "id").select("url", "blocked")
    total, bad = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    if not bad:
        return []
    # a rule must also be surer than chance: by so much more than the share of blocked URLs, unless that leaves no room
    min_confidence = max(min_confidence, min(min_lift * bad / total, 0.95))
    support = max(min_support, min(1.0, min_rows / total))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {"token": [], "n": [], "hits": [], "low": [], "high": []}
            for u, n, hits in zip(b.column("url").to_pylist(), b.column("n").to_pylist(), b.column("hits").to_pylist(), strict=True):
                digest = xxhash.xxh3_128_intdigest(repr(u).encode())
                have = tokens(u)
                found["token"] += have
                for c, v in (("n", n), ("hits", hits), ("low", digest & LAST), ("high", digest >> 65)):
                    found[c] += [v] * len(have)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c == "token" else pa.int64()) for c, v in found.items()})

    # what a rule needs at least of each of its tokens; equal digests stand for the same URLs
    each = marked.groupBy("url").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("hits")).mapInArrow(counted, "token string, n long, hits long, low long, high long")
    able = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.bit_xor("low").alias("low"), F.bit_xor("high").alias("high")).filter(F.col("hits") >= math.ceil(support * total))
    alike: dict[tuple[int, ...], list[str]] = {}
    for r in able.collect():
        alike.setdefault((r["n"], r["hits"], r["low"], r["high"]), []).append(r["token"])
    if not alike:
        return []
    members = {min(ts): sorted(ts) for ts in alike.values()}
    stands = {t: first for first, ts in members.items() for t in ts}

    def baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [list({stands[t] for t in tokens(u) if t in stands}) + [_BLOCKED] * y for u, y in zip(b.column("url").to_pylist(), b.column("blocked").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"items": pa.array(items, pa.list_(pa.string()))})

    items = marked.select("url", F.col("blocked").cast("int")).mapInArrow(baskets, "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.filter(F.size("items") <= most_tokens + 1).select("items", "freq")
    blocked = sets.filter(F.array_contains("items", _BLOCKED)).select(F.array_sort(F.array_remove("items", _BLOCKED)).alias("k"), F.col("freq").alias("hits")).filter(F.size("k") > 0)
    every = sets.filter(~F.array_contains("items", _BLOCKED)).select(F.array_sort("items").alias("k"), "freq")
    rules = blocked.join(every, "k").filter(F.col("hits") >= min_confidence * F.col("freq"))
    found = {tuple(r["k"]): r["hits"] / r["freq"] for r in rules.collect()}

    def implied(k: tuple[str, ...]) -> bool:
        return any(found.get(k[:i] + k[i + 1 :], 0) >= found[k] for i in range(len(k)))

    return sorted((tuple(sorted(ts)), c) for k, c in found.items() if not implied(k) for ts in product(*(members[t] for t in k)))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], min_support: float = 0.001, min_confidence: float = 0.6, most_tokens: int = 3, min_rows: int = 8) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page (page_id, url).

    labels: (page_id, blocked). rule is the written rule that decides, else null; then the
    verdict is block where a mined rule matches, and confidence that of the surest.
    """
    urls = pages.select(F.col("page_id").alias("id"), "url")
    mined = mined_rules(urls, labels.select(F.col("page_id").alias("id"), "blocked"), min_support, min_confidence, most_tokens, min_rows)
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, host + path, verdict))
    common = Counter(t for k, _ in mined for t in k)
    index: dict[str, list[tuple[frozenset[str], float]]] = {}
    for k, c in mined:
        index.setdefault(min(k, key=lambda t: (common[t], t)), []).append((frozenset(k), c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rule, verdict, confidence = [], [], []
            for url, host, path in zip(b.column("url").to_pylist(), b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                fits = written_rule(host, path, by_host)
                surest = 0.0
                if not fits and index:
                    have = set(tokens(url))
                    surest = max((c for t in have for k, c in index.get(t, ()) if k <= have), default=0.0)
                rule.append(fits[0] if fits else None)
                verdict.append(fits[1] if fits else "block" if surest else "allow")
                confidence.append(surest or None)
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "host": b.column("host"), "path": b.column("path"), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string()), "confidence": pa.array(confidence, pa.float64())})

    source = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return source.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, confidence double")
