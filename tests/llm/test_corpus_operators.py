"""Operators over the whole corpus: toxicity, line dedup, near duplicates, mixing, search, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from clausal.llm import jaccard_join, line_dedup, mixing, search, toxicity
from clausal.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---- components ---------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(frame(spark, edges, "a long, b long")).collect()}
    assert all(got[x] == root(x) for x in got)
    assert {x for a, b in edges if a != b for x in (a, b)} == set(got)
    assert components(frame(spark, [], "a long, b long")).count() == 0


# ---- near duplicates --------------------------------------------------------------------------------------


def shingles(text, k):
    words = [w.encode().lower() for w in WORDS.findall(text or "")]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def groups(rows, percent, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def near_rows(rng):
    rows = []
    for g in range(14):
        base = prose(rng, rng.choice([3, 8, 15, 40, 130, 400]), 5000).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "x", "The"])
            rows.append(" ".join(copy))
    chain = prose(rng, 200, 9000).split()
    for i in range(0, 60, 3):  # neighbours are near, the ends are far apart
        rows.append(" ".join([f"c{j}" for j in range(i)] + chain[i:]))
    rows += ["a", "A", "a b", "a  b\n", "a b c", "", None, " \t", "Ä b c d", "ä b c d", *["same text here again"] * 6]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, "other text of three here now")]


@pytest.mark.parametrize("percent,k,rounds", [(90, 3, 6), (70, 2, 1)])
def test_link_groups_equal_brute_force(spark, percent, k, rounds):
    rows = near_rows(random.Random(percent))
    sets, roots = groups(rows, percent, k)
    least: dict = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = Counter((i, len(s), i if not s else least[r]) for (i, _), s, r in zip(rows, sets, roots, strict=True))
    got = jaccard_join.link_groups(frame(spark, rows), percent, k, rounds).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_exact_stage_alone(spark, monkeypatch):
    """Without any hub rounds the open buckets alone must find every link."""
    rows = near_rows(random.Random(11))
    _, roots = groups(rows, 85, 3)
    got = jaccard_join.link_groups(frame(spark, rows), 85, 3, rounds=0).collect()
    label = {(r.doc_id, r.key): r.label for r in got}
    assert len({r for r, (_, t) in zip(roots, rows, strict=True) if shingles(t, 3)}) == len({v for v in label.values() if v is not None})


def test_keep_one(spark):
    rows = [(*r, "s", "e") for r in near_rows(random.Random(6))]
    df = frame(spark, rows, "doc_id long, text string, source string, key string")
    kept = jaccard_join.keep_one(df, 80, 5).collect()
    sets, roots = groups([(i, t) for i, t, *_ in rows], 80, 5)
    best: dict = {}
    for (i, *_), s, r in zip(rows, sets, roots, strict=True):
        if s:
            best[r] = min(i, best.get(r, i))
    want = Counter(best.values()) + Counter(i for (i, *_), s in zip(rows, sets, strict=True) if not s)
    assert Counter(r.doc_id for r in kept) == want and set(kept[0].asDict()) == {"doc_id", "text", "source", "key"}
    assert jaccard_join.keep_one(df.limit(0)).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v w")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.link_groups(frame(spark, rows), 80, 5).collect())
    assert got == Counter({(None, 2): 2, (2, 2): 1, (None, None): 1})
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(frame(spark, rows), 80, 5).collect()) == ["2", "None"]


def test_copies_that_each_differ_from_the_rest(spark):
    """A large group of copies with changes of their own, in which only small clusters are linked."""
    rng = random.Random(33)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for g in range(30):
        own = list(base)
        for _ in range(9):
            own[rng.randrange(len(own))] = f"g{g}_{rng.randrange(10**6)}"
        for _ in range(rng.randint(1, 3)):
            copy = list(own)
            copy[rng.randrange(len(copy))] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    _, roots = groups(rows, 90, 3)
    for rounds in (6, 0):
        got = jaccard_join.link_groups(frame(spark, rows), 90, 3, rounds).collect()
        label = {r.doc_id: r.component_id for r in got}
        least: dict = {}
        for (i, _), r in zip(rows, roots, strict=True):
            least.setdefault(r, i)
        assert all(label[i] == least[r] for (i, _), r in zip(rows, roots, strict=True))
    assert 25 < len(least) < len(rows)


# ---- line dedup ------------------------------------------------------------------------------------------------


def line(n, start):
    return " ".join(f"{start}{i}" for i in range(n))


def test_line_dedup(spark):
    p, q, short = line(30, "p"), line(20, "q"), line(5, "s")
    rows = [
        (1, f"{line(9, 'a')}\n{p}\n{q}\n{short}", 1),
        (2, f"{p}\n{q}\n{line(8, 'b')}", 2),
        (3, f"{line(7, 'c')}\n{short}\n{line(7, 'd')}", 3),
        (4, f"{line(7, 'e')}\n{q}\n{line(7, 'f')}", 4),
        (5, f"{q}\n{short}", 5),
        (6, p, 6),
        (7, None, 7),
        (8, "", 8),
        (9, "\n\n", 9),
        (6, p, 6),
        (None, f"{p}\nend", 10),
        (1, f"{p}\nsame id, other text", 11),
    ]
    df = frame(spark, rows, "doc_id long, text string, n_chars long")
    got = Counter((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(df).collect())
    assert got[1, rows[0][1], 1] + got[1, "same id, other text", len("same id, other text")] in (1, 2)
    assert got[2, line(8, "b"), len(line(8, "b"))] == 1
    assert got[3, rows[2][1], 3] == 1 and got[4, rows[3][1], 4] == 1  # blocks of under 25 words stay
    assert got[5, "", 0] == 1 and got[6, "", 0] == 2
    assert got[7, None, 7] == got[8, "", 8] == got[9, "\n\n", 9] == 1
    assert got[None, "end", 3] == 1
    left = {r.doc_id for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()}
    assert left == {1, 2, 3, 4, 7, 8, 9, None}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_leaves_each_passage_once(spark):
    rng = random.Random(8)
    passages = [line(55 + i, f"x{i}_") for i in range(6)]
    rows = []
    for i in range(80):
        lines = [prose(rng, 12, 10**6) for _ in range(rng.randint(1, 5))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            lines.insert(rng.randrange(len(lines) + 1), p)
        rows.append((i, "\n".join(lines)))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for p in passages:
        holders = [i for i, t in rows if p in t]
        assert [i for i in sorted(out) if p in out[i].text] == holders[:1]
    for i, t in rows:
        assert [x for x in out[i].text.split("\n") if x not in passages] == [x for x in t.split("\n") if x not in passages]


def test_alignment_is_in_order():
    """Lines that cross aren't aligned; a longest common order of unique lines is, and what lies between is aligned too."""
    later, earlier = {0: 1, 1: 2, 2: 3, 3: 9, 4: 9}, {0: 3, 1: 1, 2: 2, 3: 9, 5: 9}
    assert line_dedup.aligned(later, earlier) == [0, 1, 3, 4]
    assert line_dedup.aligned({0: 1, 1: 9, 2: 9}, {4: 1, 5: 9, 6: 9}) == [0, 1, 2]
    assert line_dedup.increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]
    assert line_dedup.aligned({0: 1, 1: 1}, {0: 1, 1: 1}) == [0, 1]
    assert line_dedup.aligned({0: 5, 1: 7, 2: 7, 3: 6}, {0: 5, 1: 7, 2: 8, 3: 7, 4: 6}) == [0, 1, 2, 3]
    assert line_dedup.aligned({}, {0: 1}) == line_dedup.aligned({0: 2}, {0: 1}) == []


def patience(x, y):
    """Index pairs of a patience diff of two lists, by recursion on slices."""
    if not x or not y:
        return []
    if x[0] == y[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in patience(x[1:], y[1:]))]
    if x[-1] == y[-1]:
        return [*patience(x[:-1], y[:-1]), (len(x) - 1, len(y) - 1)]
    unique = [(i, y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 and y.count(v) == 1]
    best = []
    for i, j in unique:  # a longest increasing chain that ends here
        tails = [c for c in (u[2] for u in best) if c[-1][1] < j]
        best.append((i, j, [*max(tails, key=len, default=[]), (i, j)]))
    chain = max((u[2] for u in best), key=len, default=[])
    if not chain:
        return []
    out, at = [], (-1, -1)
    for i, j in [*chain, (len(x), len(y))]:
        a, b = at[0] + 1, at[1] + 1
        out += [(a + p, b + q) for p, q in patience(x[a:i], y[b:j])]
        out += [(i, j)] * (i < len(x))
        at = (i, j)
    return out


def in_order(few, many):
    """Whether the lines occur in the same order in a document."""
    rest = iter(many)
    return all(v in rest for v in few)


def test_line_dedup_equals_pairwise_patience(spark):
    """What a patience diff aligns with an earlier document through a rare line goes, and nothing goes but blocks of one earlier document."""
    rng = random.Random(21)
    pool = [line(rng.choice([6, 9, 14]), f"v{i}_") for i in range(150)]
    rows, texts = [], []
    for i in range(70):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 8))]
        if texts and rng.random() < 0.7:  # part of an earlier document, with lines put in or left out
            old = rng.choice(texts)
            a = rng.randrange(len(old))
            part = [x for x in old[a : a + rng.randint(2, 9)] if rng.random() < 0.9]
            lines[rng.randrange(len(lines)) : 0] = part
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines)), line(7, f"own{i}_"))
        texts.append(lines)
        rows.append((i, "\n".join(lines)))
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    df = Counter(x for lines in texts for x in set(lines))
    gone_in_all = 0
    for i, lines in enumerate(texts):
        gone = set()
        for earlier in texts[:i]:
            if not any(df[v] <= line_dedup.RARE for v in set(lines) & set(earlier)):
                continue
            mine, theirs = [k for k, v in enumerate(lines) if v in earlier], [v for v in earlier if v in lines]
            places = [mine[a] for a, _ in patience([lines[k] for k in mine], theirs)]
            while places:
                run = [places.pop(0)]
                while places and places[0] == run[-1] + 1:
                    run.append(places.pop(0))
                if sum(len(lines[k].split()) for k in run) >= 25:
                    gone.update(run)
        may = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(v.split()) for v in lines[a:b]) >= 25 and any(in_order(lines[a:b], e) for e in texts[:i]):
                    may.update(range(a, b))
        left = [x for x in out[i] if x]
        assert not Counter(left) - Counter(v for k, v in enumerate(lines) if k not in gone)
        assert not Counter(v for k, v in enumerate(lines) if k not in may) - Counter(left)
        gone_in_all += len(gone)
    assert gone_in_all > 60


def test_line_dedup_finds_copies_of_what_another_document_has_crossed(spark):
    lines = [line(10, f"k{i}_") for i in range(6)]
    rows = [(1, "\n".join(reversed(lines))), (2, "\n".join(lines)), (3, "\n".join(lines))]
    out = {r.doc_id: (r.text, r.n_gone) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out == {1: (rows[0][1], 0), 2: (rows[1][1], 0), 3: ("", 6)}


def test_line_dedup_takes_a_block_from_one_document(spark):
    """Lines that each another document has are no common block, long as they are together."""
    lines = [line(10, f"k{i}_") for i in range(3)]
    rows = [(i, f"{v}\n{line(9, f'o{i}_')}") for i, v in enumerate(lines)] + [(9, "\n".join(lines))]
    assert all(r.n_gone == 0 for r in line_dedup.dedup_lines(frame(spark, rows)).collect())


def test_line_dedup_columns_and_long_texts(spark):
    many = "\n".join(line(5, f"l{i}_") for i in range(4000))
    rows = [(1, many, "a", "b", "c", 7), (2, f"x\n{many}\ny", "a", "b", "c", 7), (2, f"x\n{many}\ny", "a", "b", "c", 7)]
    df = frame(spark, rows, "doc_id long, text string, _at string, _key string, _gone string, n_gone int")
    out = sorted((r.doc_id, r.text == many or r.text, r._at, r._key, r._gone, r.n_gone) for r in line_dedup.dedup_lines(df).collect())
    assert out == [(1, True, "a", "b", "c", 0), *[(2, "x\ny", "a", "b", "c", 4000)] * 2]


def common_passages(rows, least):
    """The texts without what lies in a passage of that many words that an earlier document has too, line by line."""
    split = [[x for x in t.split("\n") if x.split()] for _, t in rows]
    had, out = set(), []
    for lines in split:
        gone, own = set(), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                passage = tuple(lines[a:b])
                if sum(len(x.split()) for x in passage) >= least:
                    own.add(passage)
                    if passage in had:
                        gone.update(range(a, b))
        had |= own
        out.append([x for i, x in enumerate(lines) if i not in gone])
    return out


def passage(n, start):
    """Lines of six words, of n words in all."""
    return "\n".join(line(6, f"{start}{i}_") for i in range(n // 6))


def test_line_dedup_crossed_and_repeated_passages(spark):
    p, q, r = passage(60, "p"), passage(54, "q"), passage(30, "r")
    own = [line(8, f"own{i}_") for i in range(12)]
    rows = [
        (1, f"{p}\n{own[0]}\n{q}\n{r}"),
        (2, f"{q}\n{p}"),  # crossed
        (3, f"{own[1]}\n{q}\n{p}\n{own[2]}"),
        (4, f"{r}\n{p}\n{own[3]}\n{p}\n{own[4]}"),  # twice in the later document, beside a line that is unique
        (5, f"{own[5]}\n{own[6]}\n{own[7]}\n{own[5]}\n{own[6]}\n{own[7]}\n{own[8]}"),  # twice in the holder; short lines
        (6, f"{own[8]}\n{own[9]}\n{own[5]}\n{own[6]}\n{own[7]}\n{own[8]}"),
        (7, "\n".join(reversed(p.split("\n")))),  # lines, but no passage
    ]
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[1] == rows[0][1].split("\n") and out[5] == rows[4][1].split("\n") and out[7] == rows[6][1].split("\n")
    assert out[2] == [""] and out[3] == [own[1], own[2]] and out[4] == [own[3], own[4]] and out[6] == [own[8], own[9]]


def test_line_dedup_leaves_no_passage_of_an_earlier_document(spark):
    rng = random.Random(11)
    pool = [line(rng.choice([2, 5, 9, 14]), f"z{i}_") for i in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for (i, _), kept in zip(rows, common_passages(rows, 25), strict=True):
        assert not Counter(x for x in out[i].split("\n") if x) - Counter(kept)


def test_line_dedup_passes_over_blank_lines(spark):
    paragraphs = [line(20, f"y{i}_") for i in range(10)]
    short = [line(4, f"s{i}_") for i in range(8)]
    rows = [
        (1, "title\n\n" + "\n\n".join(paragraphs) + "\n\nend\n\n" + "\n".join(short)),
        (2, "\n\nother\n\n" + "\n\n".join(paragraphs) + "\n\nlast\n"),
        (3, "\n \t\n".join(paragraphs)),  # without words, but not empty
        (4, "\n\n".join(paragraphs[:1]) + "\n\n\nown words\n\n" + paragraphs[5]),  # too short
        (5, "x\n" + "\n\n\n".join(short) + "\ny"),
    ]
    out = {r.doc_id: (r.text, r.n_gone) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[1] == (rows[0][1], 0) and out[4] == (rows[3][1], 0)
    assert out[2] == ("\n\nother\n\n\nlast\n", 19) and out[3] == ("", 19) and out[5] == ("x\ny", 22)


def test_left_over_lines_go_in_runs():
    """Crossed and repeated lines are aligned in runs of their own, in the order of the earlier document."""
    later, earlier = {0: 3, 1: 1, 2: 2, 3: 1, 4: 2}, {0: 1, 1: 7, 2: 2, 3: 3}
    assert line_dedup.left_over(later, earlier, [0]) == [[1, 2], [3, 4]]


# ---- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        words = prose(rng, rng.randint(20, 300), 4000).split()
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "nasty"])
        docs.append((i, " ".join(words), "en", "keep"))
        labels.append((i, int(toxic != (rng.random() < 0.03))))
    docs += [(None, None, "en", "keep"), (5000, "", "en", "keep"), (5001, "vile rotten nasty " * 5000, "en", "keep")]
    df = frame(spark, docs, "doc_id long, text string, lang string, predicted string")
    out = toxicity.scored(df, frame(spark, [*labels, (1, 5), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) and set(out[0].asDict()) == {"doc_id", "text", "lang", "score", "predicted"}
    true = {i for i, t, *_ in docs if t and re.search("vile|rotten|nasty", t)}
    held = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.doc_id in true) == bool(r.predicted) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    none = toxicity.scored(df, frame(spark, [], "doc_id long, toxic int")).collect()
    assert all(r.score == 0 for r in none)


def test_held_out_labels_dont_matter(spark):
    rng = random.Random(5)
    docs = frame(spark, [(i, prose(rng, 40, 200)) for i in range(120)])
    labels = [(i, i % 2) for i in range(120)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.scored(docs, frame(spark, x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    examples = [(np.unique(np.append(rng.integers(100, 3000, 40), [7] if y else [8])).astype(np.int32), y) for y in rng.integers(0, 2, 400)]
    at, w = toxicity.fit(examples)
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert weights[7] > 1 and weights[8] < -1 and len(weights) < 300


# ---- mixing ----------------------------------------------------------------------------------------------------------------


def mix_rows(rng):
    sources = ["hot"] * 60 + ["b", "a", "zé", None, "tiny"]
    return [(i, prose(rng, rng.randint(0, 60)), rng.choice(sources)) for i in range(600)] + [(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (700, "only words " * 2000, "b"), (701, "dup", "tiny"), (701, "dup", "tiny")]


def water(sizes, weights):
    target, full = {}, set()
    total = sum(sizes.values())
    while True:
        left, open_ = total - sum(3 * sizes[s] for s in full), sum(weights[s] for s in sizes if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rows = mix_rows(random.Random(2))
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORDS.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    source_of = {}
    for i, t, s in rows:
        source_of.setdefault((i, size(t)), s)
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    longest = {s: max(size(t) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    again = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_report(df.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_training_sequence(spark):
    rows = mix_rows(random.Random(2))
    df = frame(spark, rows, "doc_id long, text string, source string")
    report = Counter()
    for r in mixing.mix_report(df).collect():
        if r.size:
            report[r.doc_id] += r.taken // r.size
    sequence = mixing.mixed(df).collect()
    assert Counter(r.doc_id for r in sequence) == +report and set(sequence[0].asDict()) == {"doc_id", "text", "source"}
    # the fading source comes early, the growing one late
    places: dict = {}
    for i, r in enumerate(sequence):
        places.setdefault(r.source, []).append(i)
    rank = {s: i for i, s in enumerate(sorted(s for s in places if s))}
    mean = {s: sum(p) / len(p) for s, p in places.items() if s}
    steady = mean[min(rank, key=lambda s: rank[s] % 3)]
    assert mean["b"] < steady + len(sequence) * 0.2
    assert mixing.mixed(df.limit(0)).count() == mixing.mix_report(df.limit(0)).count() == 0
    assert mixing.mixed(frame(spark, [(1, None, "a")], "doc_id long, text string, source string")).count() == 0


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    schedule = ((0.0, 2.0), (0.25, 0.0), (1.0, 1.0))

    def area(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            total += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return total

    df = spark.range(0, 101).select((F.col("id") / 100).alias("s")).select("s", mixing.position(F.col("s"), F.lit(0), (schedule,)).alias("t"))
    for r in df.collect():
        assert abs(area(r.t) / area(1.0) - r.s) < 1e-9


# ---- search -------------------------------------------------------------------------------------------------------------------


def bm25(rows, queries, k):
    terms = [(i, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t in rows]
    n, mean = len(terms), sum(sum(c.values()) for _, c in terms) / len(terms)
    df = Counter(w for _, c in terms for w in c)
    idf = {w: math.log(1 + (n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    out = {}
    for q, t in queries:
        asked = set(re.findall(r"[^\W_]+", (t or "").lower())) & df.keys()
        scores = []
        for i, c in terms:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            if s := sum(idf[w] * c[w] * 2.2 / (c[w] + norm) for w in asked & c.keys()):
                scores.append((-round(s, 8), i if i is not None else 1 << 62))
        out[q] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("shard,block,frequent", [(16384, 128, 1 / 32), (64, 8, 1 / 4), (64, 8, 2.0)])
def test_search_equals_brute_force(spark, monkeypatch, shard, block, frequent):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "FREQUENT", frequent)
    monkeypatch.setattr(search, "GROUP", 7)
    rng = random.Random(12)
    zipf = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(n))
    rows = [(i, zipf(rng.randint(1, 120))) for i in range(400)] + [(500, "same w1 text"), (501, "same w1 text"), (502, None), (503, ""), (None, "same w1 text"), (504, "w2 " * 70000)]
    queries = [(i, t) for i, t in rows if i is not None and i % 20 == 0] + [(9000, "unseen"), (9001, None)]
    got: dict = {}
    for r in search.top_k(frame(spark, rows), frame(spark, queries, "query_id long, text string"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, round(r.score, 8)))
    for q, want in bm25(rows, queries, 5).items():
        mine = [(-s, i if i is not None else 1 << 62) for _, i, s in sorted(got.get(q, []))]
        assert [i for _, i in mine] == [i for _, i in want], q
        assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(mine, want))
    assert search.top_k(frame(spark, []), frame(spark, [], "query_id long, text string")).count() == 0


def test_search_scores_few_documents_again_once_floors_are_known(monkeypatch):
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randint(5, 120)))) for i in range(1600)]
    rows[900] = (900, rows[40][1])  # as good as the query itself
    queries, read, again = rows[::40], search.Terms(), []
    docs, own = [read(t) for _, t in rows], [read(t)[0] for _, t in queries]
    terms, df = np.unique(np.concatenate([t for t, _ in docs]), return_counts=True)
    idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    ids = np.array([i for i, _ in queries])
    asked = search.Asked(ids, ids, np.zeros(len(ids)), np.cumsum([len(t) for t in own]), np.searchsorted(terms, np.concatenate(own)).astype(np.int32), terms, idf)
    packed = [search.packed_shard([i for i, _ in rows[a : a + 100]], docs[a : a + 100]) for a in range(0, 1600, 100)]
    exact = search.Shard.exact
    monkeypatch.setattr(search.Shard, "exact", lambda self, *a: again.append(1) or exact(self, *a))
    best: dict[int, list] = {q: [] for q in range(len(ids))}

    def run(shards, asked):
        again.clear()
        for row in shards:
            for q, scores, found in search.Shard(row, sum(int(c.sum()) for _, c in docs) / len(docs), asked).search(5):
                best[q] = sorted([*best[q], *zip((-scores).tolist(), found.tolist(), strict=True)])[:5]
        return len(again) / len(shards) / len(ids)

    first = run(packed[:4], asked)
    rest = run(packed[4:], asked._replace(floors=np.array([-best[q][-1][0] for q in range(len(ids))])))
    assert first >= 5 and rest < 2  # documents of a shard that a query scores in double precision
    for q, want in enumerate(bm25(rows, queries, 5).values()):
        assert [i for _, i in best[q]] == [i for _, i in want], q
        assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(best[q], want, strict=True))


def test_search_counts_words_beyond_16_bits(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 40, 300)) for i in range(300)] + [(400, "spam " * 500_000 + "ham " * 500_000), (401, "spam " * 65_536 + "w1"), (402, "spam w1")]
    queries = [(1, "spam ham"), (2, "spam"), (3, "w1 ham")]
    got: dict = {}
    for r in search.top_k(frame(spark, rows), frame(spark, queries, "query_id long, text string"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for q, want in bm25(rows, queries, 5).items():
        mine = sorted(got[q])
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert all(abs(s + t) < 1e-6 for (_, _, s), (t, _) in zip(mine, want, strict=True))


# ---- pipeline --------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(260):
        words = prose(rng, rng.randint(30, 120), 10**5).split()
        if i % 6 == 0:
            words[3:3] = ["vile", "rotten", "nasty"]
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(1000, f"{passage}\nfirst", "en", "s1", 1), (1001, f"{passage}\nsecond", "en", "s1", 1), (1002, docs[7][1] + " more", "en", "s2", 1), (1003, docs[8][1], "en", "s2", 1), (1004, "", "en", "s3", 0), (1005, None, None, None, None)]
    frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen[name] = df.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    clean = {i for i, *_ in docs} - {i for i in range(0, 260, 6)}
    assert ids["toxicity"] == clean
    assert ids["line_dedup"] == clean - {1003}
    assert {r.doc_id: r.text for r in seen["line_dedup"]}[1001] == "second"
    assert ids["near_duplicates"] == clean - {1003, 1002}
    assert ids["mixing"] <= ids["near_duplicates"] and len(seen["mixing"]) == len(seen["bpe"])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in run) == Counter((r.doc_id, r.ids_sha256) for r in seen["bpe"])


def test_pipeline_of_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, [(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, [], schema), str(tmp_path)).count() == 0


def test_ftrl_equals_a_plain_version():
    """The weights of the vectorised fit are those of the published update, coordinate by coordinate."""
    rng = random.Random(9)
    examples = [(np.array(sorted(rng.sample(range(30), 6)), dtype=np.int32), rng.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    bias = 1 << toxicity.BITS
    z, n = Counter(), Counter()

    def weight(i):
        shrink = 0.0 if i == bias else l1
        if abs(z[i]) <= shrink:
            return 0.0
        return -(z[i] - math.copysign(shrink, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for x, y in examples:
            at = [*x.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    at, w = toxicity.fit(examples, alpha, beta, l1, l2, 2)
    want = {i: weight(i) for i in [*range(30), bias] if weight(i)}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)).keys() == want.keys()
    assert all(abs(want[i] - v) < 1e-9 for i, v in zip(at.tolist(), w.tolist(), strict=True))


def test_hub_in_the_midst_of_its_group_makes_no_pairs_by_its_own_elements(spark):
    # 40 sets around a common part with 12 elements of their own each, and one with 40, which is met first and as often
    common = list(range(100))
    members = [(i, common + [1000 * (i + 1) + j for j in range(12 if i < 40 else 40)]) for i in range(41)]
    sets = spark.createDataFrame([(i, len(s), s, []) for i, s in members], "nid long, n long, items array<long>, wide array<long>")
    large = spark.createDataFrame([(7, i, i) for i, _ in members], "bucket long, nid long, label long")
    links, changes = jaccard_join._beside_hubs(large, sets, 90)
    assert links.count() == 0
    ends = changes.groupBy("bucket").count().filter("count > 1").agg({"count": "sum"}).first()[0] or 0
    assert ends <= 41


def test_texts_of_a_few_shared_passages_make_no_pairs(spark):
    """Members that have many passages in common with many others, but none with all of another's, are told apart by places; links between them stay."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    passages = [[1000 * p + j for j in range(20)] for p in range(1, 13)]
    members = [(i, sorted({e for p in rng.sample(passages, 6) for e in p} | {10**6 + 100 * i + j for j in range(20)})) for i in range(60)]
    members += [(60 + i, sorted(set(members[i][1]) - set(members[i][1][:2 + i]) | {2 * 10**6 + i})) for i in range(8)]  # linked with members 0 to 7
    held = {i: set(s) for i, s in members}
    sets = spark.createDataFrame([(i, len(s), s, jaccard_join.wide_sketch(np.array(s, dtype=np.uint64)).view(np.int64).tolist()) for i, s in members], "nid long, n long, items array<long>, wide array<long>")
    large = spark.createDataFrame([(7, i, i) for i, _ in members], "bucket long, nid long, label long")
    links, changes = jaccard_join._beside_hubs(large, sets, 80)
    changes = changes.withColumn("label", F.col("nid"))
    assert jaccard_join._meetings(changes, 80).count() <= 4 * len(members)
    pairs = jaccard_join._across(large.limit(0), changes, sets, 80)
    found = {(min(r), max(r)) for r in jaccard_join.verified(pairs, sets, 80).collect()} | {(min(r), max(r)) for r in links.collect()}
    want = {(a, b) for a in held for b in held if a < b and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}
    assert {(i, 60 + i) for i in range(8)} <= want
    hubs = {b for _, b in (tuple(r) for r in links.collect())}
    together = {a for a, b in found if b in hubs} | {b for a, b in found if a in hubs} | hubs
    assert found <= want and all(p in found or set(p) <= together for p in want)
