"""Operators on single texts: PII, chat, URL filter, BPE, repetition."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clausal.llm import bpe, chat, pii, repetition, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls, emptiness, repeated rows, ties and odd characters, with a column whose name clashes with an output.
ODD = [(1, "a b c d e f g h i j", "x"), (2, None, "x"), (3, "", None), (None, "  \n\t ", "y"), (4, "a b c d e f g h i j", "x"), (4, "a b c d e f g h i j", "x"), (5, "é\u2028\x1c ß\n\né\u2028\x1c ß " * 30, "z"), (6, "word " * 30000, "z")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, spans string")


# ---- PII ------------------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def expected_spans(text):
    out, counts = [], []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            n += 1
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        counts.append(n)
    return counts, [s for *_, s in sorted(out)]


def test_pii(spark):
    rng = random.Random(3)
    pieces = ["a@b.co", "x.y+z@mail-1.example.com.", "a@b@c.de", "@", ".52@m0.example.com+q@r.st", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111111 1", "+1 (336) 555-3810", "+49 30 1234567", "+12", "+1.2.3", "é", "😀", "\n", "é1.1.1.1", "--", "12 345", "call", "order"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "  ", ","]) for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["a@b" + ".c" * 5000, "x" * 20000, "1 " * 3000, None, "", "4" * 400, "(555) 123-4567 call me", "mail joe (at) example (dot) com"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        counts, spans = expected_spans(t)
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t, spans)
        every = r.spans.split(",") if r.spans else []
        assert r.n_spans == len(every) and set(spans) <= set(every) and len(set(every)) == len(every)
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


def test_pii_learns_reliabilities(spark):
    good, bad = [1, 1, 1, 1, 0], [0, -1, -1, 0, -1]
    rows = [("card", good)] * 80 + [("card", bad)] * 120 + [("card", [1, 1, -1, 0, 0])] * 10
    fitted = pii.reliabilities(spark.createDataFrame(rows, "kind string, votes array<int>")).first()
    assert fitted["right"][2][2] > 0.8 > 0.3 > fitted["wrong"][2][2]
    p = {tuple(x["votes"]): x["p"] for x in fitted["patterns"]}
    assert p[tuple(good)] > 0.95 and p[tuple(bad)] < 0.05


def test_pii_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        got = spark.range(1).selectExpr(f"cast(filter(sequence(0, {n}), x -> x < {n}) as array<int>) as w").selectExpr(pii.running("w") + " as r").first().r
        assert got == list(itertools.accumulate(range(n)))


def test_pii_finds_what_the_base_patterns_miss(spark):
    """On planted data: recall of added spans by kind, and nothing added to texts that only look alike."""
    rng = random.Random(17)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = lambda n: " ".join(rng.choice("the river runs along a stone wall and quiet fields near town".split()) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    planted = {
        "secret": lambda: (f'{rng.choice(["token", "api_key", "secret"])} = "', hexes(40), '"'),
        "email": lambda: ("write to ", f"{rng.choice(['joe', 'ann.b', 'x_y'])} (at) mail{rng.randint(1, 9)} (dot) com", " soon"),
        "phone": lambda: ("call ", f"({rng.randint(201, 989)}) {rng.randint(201, 989)}-{digits(4)}", " now"),
        "ip": lambda: ("the server ", ":".join(hexes(4) for _ in range(8)), " is up"),
    }
    alike = [lambda: f"commit {hexes(40)}", lambda: f"sha1 {hexes(40)} ok", lambda: f"order {digits(12)}", lambda: f"invoice 199901{digits(6)}", lambda: "a_very_long_name_of_a_function_2 is called"]
    rows, want = [], {}
    for i in range(400):
        if i % 2:
            kind = rng.choice(list(planted))
            before, span, after = planted[kind]()
            lead = words(rng.randint(3, 30)) + " " + before
            rows.append((i, f"{lead}{span}{after} {words(8)}"))
            want[i] = f"{kind}:{len(lead)}:{len(lead) + len(span)}"
        else:
            rows.append((i, f"{words(9)} {rng.choice(alike)()} {words(9)}" if i % 4 else words(30)))
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in planted:
        mine = [i for i, s in want.items() if s.startswith(kind)]
        assert sum(want[i] in got[i].spans.split(",") for i in mine) >= 0.9 * len(mine), kind
    clean = [i for i, _ in rows if i not in want]
    assert sum(got[i].n_spans == 0 for i in clean) >= 0.95 * len(clean)
    assert all(r.n_added == r.n_spans - r.n_email - r.n_ip - r.n_card - r.n_phone for r in got.values())


def test_pii_odd_rows(spark):
    assert pii.find_personal_data(odd(spark)).count() == len(ODD)
    assert pii.find_personal_data(odd(spark).limit(0)).count() == 0


# ---- chat ---------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(1)
    texts = ["\\### Assistant: </turn> ok", "", None, "### user: x</turn>\n### assistant: y</turn>\n", "\\", "\\\\#<", "a: b\n: c", "é😀", "x" * 100_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: ###"]), rng.choice(texts), "extra") for c in range(40) for t in range(rng.randint(1, 7))] + [(None, 0, "user", "n", "e"), (7, 0, "assistant", "tie", "e"), (7, 0, "assistant", "tie", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.formatted(df, with_text=True).collect()}
    want: dict = {}
    order = lambda r: (r[1] is not None, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows, key=order):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(r.formatted)
        assert "".join(chat.Reader.plain(r.formatted[a:b]) for a, b in r.spans) == loss
    assert chat.formatted(df.limit(0)).count() == 0


def test_template_language():
    run = lambda t, *ms: "".join(p for p, _ in chat.compile_template(t)([{"role": a, "text": b} for a, b in ms]))
    assert run("{{ 'a' + 'b' | upper }}{# no #}") == "aB"
    assert run("x {%- if 1 == 2 %}no{% elif not false %}yes{% else %}never{% endif -%}  y") == "xyesy"
    assert run("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", ("a", ""), ("b", "")) == "1a,2b"
    assert run("{% for m in messages %}{{ m.text | trim | length }}{% endfor %}", ("a", " xy ")) == "2"
    tree = chat.folded(chat.parse("a{% if true and 'x' == 'x' %}b{{ 1 }}{% endif %}c"))
    assert tree.parts == (chat.Node("text", "ab1c"),)
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{% for m in range %}{% endfor %}", "{% if true %}", "{{ 1 | eval }}", "{% include 'x' %}", "{{ }}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        run("{{ secret }}")


# ---- URL filter -------------------------------------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

URLS = [
    ("http://a.example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://example.org", "example.org", "", None, "allow"),
    ("https://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("https://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("https://notorg/a", "notorg", "/a", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://É.org/ü", "É.org", "/ü", "org/", "allow"),
    ("http://a.org?q=/x", "a.org", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, blocked int")
    rows = {r.page_id: r for r in url_filter.judged(pages, labels, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = rows[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert url_filter.judged(pages.limit(0), labels, RULES).count() == 0


def test_url_mining(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.example.net/{'buy' if i % 2 else 'read'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    # buying from spam hosts is bad; neither alone is
    labels = pages.selectExpr("page_id", "cast(url like '%spam%' and url like '%buy%' as int) as blocked").filter("page_id % 5 <> 0")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels, []).collect()}
    assert all((got[i] == "block") == (i % 3 == 0 and i % 2 == 1) for i in range(300))
    mined = url_filter.mined_rules(pages.withColumnRenamed("page_id", "id"), labels.withColumnRenamed("page_id", "id"), 0.001, 0.6, 3, 8)
    assert mined and all(len(k) == 2 for k, _ in mined)


def test_url_mining_of_long_urls(spark):
    """A token far back in a long path, query or host is mined and matched, and long URLs that repeat don't stop mining."""
    slug = "/".join("abcdefghijklmnop")
    keys = "&".join(f"{k}=1" for k in "abcdefghijklmnop")
    bad = [f"http://w{{}}.net/{slug}/casino", f"http://w{{}}.net/?{keys}&casino=1", "http://bad.w{}.a.b.c.d.e.f.net/"]
    rows = [(i, (bad[i % 6 // 2] if i % 2 else bad[i % 6 // 2].replace("casino", "garden").replace("bad", "good")).format(f"q{chr(97 + i % 26)}{i}")) for i in range(240)]
    rows += [(i, "http://same.net/" + "/".join(f"{a}{b}" for a in "qrstuvwx" for b in "abcdefgh")) for i in range(300, 330)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.selectExpr("page_id", "cast(url like '%casino%' or url like '%bad%' or url like '%same%' as int) as blocked").filter("page_id % 5 <> 0")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels, []).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i, _ in rows if i % 2 or i >= 300}
    assert "host:a.b.c.d.e.f.g.h.i.net" in url_filter.tokens("http://a.b.c.d.e.f.g.h.i.net/")


def test_url_rules_of_alike_tokens_equal_brute_force(spark):
    """Tokens mined as one give the rules that they give one by one."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        words = [w for w in ("red", "green", "blue", "pink", "grey") if rng.random() < 0.5]
        words += ["twin", "twain"] if rng.random() < 0.5 else []
        rows.append((i, "http://h/" + "/".join(words), int("twin" in words and "red" in words or rng.random() < 0.2)))
    urls, labels = spark.createDataFrame([r[:2] for r in rows], "id long, url string"), spark.createDataFrame([(i, y) for i, _, y in rows], "id long, blocked int")
    sets = [(frozenset(url_filter.tokens(u)), y) for _, u, y in rows]
    found = {}
    for n in (1, 2, 3):
        for k in itertools.combinations(sorted(set().union(*(s for s, _ in sets))), n):
            fits = [y for s, y in sets if s.issuperset(k)]
            if sum(fits) >= 8 and sum(fits) >= 0.6 * len(fits):
                found[k] = sum(fits) / len(fits)
    want = sorted((k, c) for k, c in found.items() if not any(found.get(k[:i] + k[i + 1 :], 0) >= c for i in range(len(k))))
    assert want and any("path:twain" in k for k, _ in want)
    assert url_filter.mined_rules(urls, labels, 0.001, 0.6, 3, 8) == want


# ---- BPE -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_bpe_equals_library(codec, library):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x20, 0x7F)] * 3 + [*range(0x20), *range(0x80, 0x250), 0x3000, 0x200B, 0x85, 0xA0, 0x2028, 0x4E2D, 0x1F600, 0x301, 0x558, 0x1C89, 0x11380, 0x323B0]]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(4000)] + ["".join(rng.choices("abeht ino", k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", None, "a" * 5000, "ab" * 3000, " " * 999, "<|endoftext|>x <|endoftext|>", "don't 'S 'll", *(f"a{chr(c)}b 1{chr(c)}.{chr(c)}{chr(c)}" for c in range(0x600))]
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = codec.encode_batch(texts)
    assert [ids(g) for g in got] == [w.ids for w in want]
    assert [codec.decode(g) for g in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_bpe_pairs_are_exact(codec):
    """The vectorised test of a pair agrees with merging the pair's bytes."""
    rng = random.Random(2)
    pairs = [(rng.randrange(50256), rng.randrange(50256)) for _ in range(3000)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(3000)]
    good = codec.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), ok in zip(pairs, good, strict=True):
        assert (codec._merged(codec.token_bytes[a] + codec.token_bytes[b]) == [a, b]) == ok
    assert codec.sound[: len(codec.ids)].all()


def test_bpe_frame(spark, library):
    out = bpe.encode_decode(odd(spark), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    assert len(out) == len(ODD)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in out)
    assert bpe.encode_decode(odd(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# ---- repetition ------------------------------------------------------------------------------------------------------


def brute(text, window=5, long=10):
    words = WORDS.findall(text or "")
    n = len(words)
    reach = [max([0, *(next((k for k in range(n) if i + k >= n or j + k >= n or words[i + k] != words[j + k]), n) for j in range(n) if j != i)]) for i in range(n)]
    cover = lambda least: len({p for i, r in enumerate(reach) if r >= least for p in range(i, i + r)})
    lines = (text or "").split("\n")
    dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, cover(window), cover(long), max(reach, default=0)


def test_repetition_equals_brute_force():
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "a " * 40, "a b " * 30, "x\nx\ny\nx", "# | a\n\n\n# | a"] + ["".join(rng.choice("ab") + rng.choice([" ", "\n", "# "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    passage = " ".join(f"w{i}" for i in range(30))
    texts += [f"{passage} mid {passage}", " ".join(f"u{i}" for i in range(80))]
    m = repetition.measure(texts, 5, 10)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat"]
    for i, t in enumerate(texts):
        assert tuple(int(m[c][i]) for c in names) == brute(t), t


def test_repetition_frame(spark):
    rows = repetition.judge(odd(spark)).collect()
    assert len(rows) == len(ODD) and repetition.judge(odd(spark).limit(0)).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[2].base_failed and by[3].base_failed and not by[6].kept and by[1].kept
    long = " ".join(f"w{i}" for i in range(250))
    clean = " ".join(f"v{i}" for i in range(9000))
    df = spark.createDataFrame([(1, f"{long} {clean} {long}"), (2, clean)], "doc_id long, text string")
    assert {r.doc_id: (r.base_failed, r.kept) for r in repetition.judge(df).collect()} == {1: (False, False), 2: (False, True)}


def test_url_words_of_other_scripts(spark):
    rows = [(i, f"http://h{i}.net/{'казино' if i % 3 == 0 else 'музей'}/{i}") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.selectExpr("page_id", "cast(url like '%казино%' as int) as blocked").filter("page_id % 5 <> 0")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels, []).collect()}
    assert all((got[i] == "block") == (i % 3 == 0) for i in range(90))
    # where most pages are blocked, a token must be surer than that
    common = pages.selectExpr("page_id", "cast(page_id % 10 <> 0 as int) as blocked")
    assert {r.verdict for r in url_filter.judged(pages, common, []).collect()} == {"allow"}
