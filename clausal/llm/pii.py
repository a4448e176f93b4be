"""Personal data and secrets by weak supervision, in DataFrame and SQL functions only.

Base spans follow fixed patterns and always count. Beyond them, a wider pattern proposes
candidates (spelt-out addresses, numbers without a plus sign, IPv6, long keys), on which
labelers vote for, against, or not at all: the format, a gazetteer (endings, country
codes, issuer numbers, names of keys), a checksum or structure test, and words of the
context on either side for and against. Expectation-maximisation over the counts of vote
patterns estimates how each labeler votes on true and on false spans of each kind; the resulting probabilities are the soft labels of a naive Bayes classifier over
the shape and context of spans, which makes the decision.

Positions are code points, ends exclusive. Texts are read once; only spans and votes are
kept. Vote patterns (5 kinds x 3**5) and the classifier's table (5 kinds x 7 features of
bounded values) have a fixed size, so they may be sent to the driver.

Defined results: a null or empty text has no spans; a very long text is read whole, in time
near its length; repeated rows each get theirs; of candidates that tie with a base span in
kind and place one stays; without candidates nothing is added; an empty table gives no
rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausal.llm.common import dropped, written

KINDS = ("email", "ip", "card", "phone")

#: Secrets have no base pattern: the method alone finds them.
ALL_KINDS = (*KINDS, "secret")

# Possessive forms of the base patterns: what follows a run never is of its characters, so the
# matches are the same, and no text makes them backtrack. \G lets a match follow another one.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: The wider candidates.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|\.)[\])]|\.)\x20?[A-Za-z0-9-]++)++"
IP6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"
SECRET = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{20,}+"
NUMBER = r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){9,18}+(?![0-9])"
WIDE = f"{EMAIL}|{SPELT_EMAIL}|{IP6}|{SECRET}|(?<![0-9.]){IP}(?![0-9.])|{NUMBER}"

_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# The gazetteers. Endings of two letters are country codes and count as known.
ENDINGS = "com org net edu gov mil int info biz name pro aero coop museum app dev cloud online site shop store tech blog news xyz example test local invalid".split()
# Country codes of one and two digits; those of three digits begin with one of the zones.
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
COUNTRY_ZONES = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
# Issuers of cards by first digits and number of digits.
ISSUERS = r"^(?:4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|2(?:2[2-9]|[3-6]|7[01])[0-9]{12,13}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|62[0-9]{14,17})$"
KEY_PREFIXES = r"^(?:sk|pk|rk|ghp|gho|ghs|xoxb|xoxp|AKIA|ASIA|AIza|glpat|npm|shpat)"
FOR_WORDS = {
    "email": "mail email e-mail contact write reply kontakt correo courriel adresse address".split(),
    "ip": "ip ipv4 ipv6 host server address addr client remote from gateway dns login".split(),
    "card": "card visa mastercard amex credit debit payment karte tarjeta carte kreditkarte cvv".split(),
    "phone": "call phone tel telephone mobile fax cell whatsapp dial appel telefon teléfono téléphone móvil".split(),
    "secret": "token secret key apikey api_key password passwd pwd bearer authorization credential credentials auth access private".split(),
}
AGAINST_WORDS = {
    "email": ["example", "noreply"],
    "ip": "version release v section chapter build firmware".split(),
    "card": "isbn issn invoice order tracking serial item ean upc iban account".split(),
    "phone": "isbn issn invoice order tracking serial item version id no nr ref date".split(),
    "secret": "sha sha1 sha256 md5 hash commit checksum digest etag revision build id uuid".split(),
}

#: Characters of context on either side of a span that labelers see.
CONTEXT = 40

LABELERS = ("format", "gazetteer", "structure", "context_for", "context_against")

FEATURES = 7

_SPAN = "struct<m:string,s:int,before:string,after:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(w: str, chunk: int = 64) -> str:
    """SQL for the running sums of an array of ints, in two levels, so that the cost stays near its length."""
    sums = lambda c, start: f"slice(aggregate({c}, array({start}), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, greatest(size({c}), 1))"
    chunks = f"transform(sequence(0, greatest(size({w}) - 1, 0) div {chunk}), c -> slice({w}, c * {chunk} + 1, {chunk}))"
    ahead = "aggregate(chunks, array(0), (a, c) -> concat(a, array(element_at(a, -1) + aggregate(c, 0, (t, x) -> t + x))))"
    return _let(chunks, "chunks", _let(ahead, "ahead", f"flatten(transform(chunks, (c, j) -> {sums('c', 'ahead[j]')}))"))


def found(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern as array<struct<m, s, before, after>>: the match, its start, and the text on either side of it up to the next match.

    The pieces between matches give the positions, so the text is scanned twice whatever the number of matches.
    """
    spans = f"transform(ms, (m, i) -> named_struct('m', m, 's', ends[i] - length(m), 'before', lower(right(p[i], {CONTEXT})), 'after', lower(left(p[i + 1], {CONTEXT}))))"
    lengths = "transform(ms, (m, i) -> length(p[i]) + length(m))"
    return _let(f"split({text}, {_quoted(pattern)}, -1)", "p", _let(f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", "ms", _let(lengths, "w", _let(running("w"), "ends", spans))))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


#: For each kind: a cheap test of whether a text can have one, the pattern, and the test of a match.
BASE = {
    "email": ("contains(t, '@')", EMAIL, "true"),
    "ip": (r"t rlike r'[0-9]\.[0-9]'", IP, f"x.m rlike {_quoted(_OCTETS)}"),
    "card": (r"t rlike r'[0-9](?:[\x20-]?[0-9]){13}'", CARD, f"length({_digits('x.m')}) between 14 and 19 and luhn_check({_digits('x.m')})"),
    "phone": ("contains(t, '+')", PHONE, f"length({_digits('x.m')}) between 10 and 15"),
}


def base_spans(kind: str) -> str:
    """SQL for the base spans of a kind in column t, as array<struct<m, s, before, after>>."""
    possible, pattern, passes = BASE[kind]
    return f"if({possible}, filter({found('t', pattern)}, x -> {passes}), cast(array() as array<{_SPAN}>))"


def _key(kind: str, x: str) -> str:
    """SQL for a span as text that sorts by start, then kind."""
    return f"concat(lpad(cast({x}.s as string), 10, '0'), '{ALL_KINDS.index(kind)}', '{kind}:', {x}.s, ':', {x}.s + length({x}.m))"


def _joined(keys: str) -> str:
    return f"array_join(transform(array_sort({keys}), k -> substring(k, 12)), ',')"


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email .. n_phone, base, candidates) of every row; base has sortable keys of the base spans."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = df.select("doc_id", "t", *[F.expr(base_spans(k)).alias(k) for k in KINDS])
    wide = f"if(t rlike r'[0-9].{{0,2}}[0-9]|@|[\\[(]at[\\])]|(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{{20}}', {found('t', WIDE)}, cast(array() as array<{_SPAN}>))"
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.expr("concat(" + ", ".join(f"transform({k}, x -> {_key(k, 'x')})" for k in KINDS) + ")")
    df = df.select("doc_id", *counts, base.alias("base"), F.expr(wide).alias("wide"))
    kind = (
        r"case when x.m rlike r'@|[\[(]at[\])]' then 'email' when contains(x.m, ':') or x.m rlike r'^[0-9]+(\.[0-9]+){3}$' then 'ip' "
        r"when x.m rlike r'[A-Za-z_]' then 'secret' when length(" + _digits("x.m") + r") >= 14 and not startswith(x.m, '+') then 'card' else 'phone' end"
    )
    named = f"transform(wide, x -> named_struct('kind', {kind}, 'm', x.m, 's', x.s, 'before', x.before, 'after', x.after))"
    return df.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.expr(f"transform({named}, x -> {_voted('x')})").alias("candidates"))


def _words(x: str, sides: tuple[str, ...], words: list[str]) -> str:
    pattern = f"r'(?<![\\p{{L}}0-9])(?:{'|'.join(words)})(?![\\p{{L}}0-9])'"
    return "(" + " or ".join(f"{x}.{s} rlike {pattern}" for s in sides) + ")"


def _listed(values: list[str]) -> str:
    return ", ".join(repr(v) for v in values)


def _vote(yes: str, no: str = "false") -> str:
    return f"when {yes} then 1 when {no} then -1 else 0"


def _voted(x: str) -> str:
    """SQL for a candidate with its votes (1 for, -1 against, 0 none) and its features."""
    digits, m = _digits(f"{x}.m"), f"{x}.m"
    ending = f"lower(regexp_extract({m}, r'([A-Za-z0-9-]+)$', 1))"
    code = f"regexp_extract({m}, r'^\\+([0-9]{{1,3}})', 1)"
    votes = {
        "format": {
            "email": _vote(f"{m} rlike r'^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++$'"),
            "ip": _vote(f"{m} rlike {_quoted(_OCTETS)} or contains({m}, ':')", "true"),
            "card": _vote(f"{m} rlike r'^[0-9]{{14,19}}$|^[0-9]{{4}}([\\x20-])[0-9]{{4}}\\1[0-9]{{4}}\\1[0-9]{{2,7}}$|^[0-9]{{4}}([\\x20-])[0-9]{{6}}\\2[0-9]{{4,5}}$'", f"{m} rlike r'[().]'"),
            "phone": _vote(f"startswith({m}, '+') or {m} rlike r'^\\(?[0-9]{{3}}\\)?[\\x20.-]?[0-9]{{3}}[\\x20.-][0-9]{{4}}$'", f"{m} rlike r'^[0-9]{{8}}[.-]|^(?:19|20)[0-9]{{2}}[.-][0-9]{{2}}[.-][0-9]{{2}}'"),
            "secret": _vote(f"{m} rlike {_quoted(KEY_PREFIXES)} or {m} rlike r'^(?:[0-9a-f]+|[0-9A-F]+)$' and length({m}) in (32, 40, 48, 64, 96, 128)"),
        },
        "gazetteer": {
            "email": _vote(f"{ending} in ({_listed(ENDINGS)}) or {ending} rlike '^[a-z]{{2}}$'", f"{ending} rlike '^[0-9]+$'"),
            "ip": _vote(f"contains({m}, ':') or try_cast(regexp_extract({m}, '^([0-9]+)', 1) as int) between 1 and 223", "true"),
            "card": _vote(f"{digits} rlike {_quoted(ISSUERS)}", f"substring({digits}, 1, 1) in ('0', '1', '7', '8')"),
            "phone": _vote(f"{code} <> '' and (substring({code}, 1, 1) in ({_listed([c for c in COUNTRY_CODES if len(c) == 1])}) or substring({code}, 1, 2) in ({_listed([c for c in COUNTRY_CODES if len(c) == 2] + COUNTRY_ZONES)}))", f"startswith({m}, '+0')"),
            "secret": _vote(f"{x}.before rlike r'(?i)(?:{'|'.join(FOR_WORDS['secret'])})[\\x20\"\\x27]*(?:=|:|=>)[\\x20\"\\x27]*$'"),
        },
        "structure": {
            "email": _vote(f"not startswith({m}, '.') and not contains({m}, '..')", "true"),
            "ip": _vote(f"not {m} rlike r'(^|\\.)0[0-9]'", "true"),
            "card": _vote(f"luhn_check({digits})", "true"),
            "phone": _vote(f"length({digits}) between 10 and 15 and size(array_distinct(split({digits}, ''))) > 3", "true"),
            "secret": _vote(f"size(array_distinct(split(lower({m}), ''))) >= 10 and {m} rlike '[0-9].*[A-Za-z].*[0-9].*[A-Za-z]'", "true"),
        },
        "context_for": {k: _vote(_words(x, ("before", "after"), FOR_WORDS[k])) for k in ALL_KINDS},
        "context_against": {k: _vote("false", _words(x, ("before",), AGAINST_WORDS[k])) for k in ALL_KINDS},
    }
    cast = [f"case {x}.kind " + " ".join(f"when '{k}' then coalesce(case {votes[n][k]} end, 0)" for k in ALL_KINDS) + " end" for n in LABELERS]
    signs = "concat_ws('', " + ", ".join(f"if(contains({m}, '{c}'), '{c}', '')" for c in ("+", "(", "-", ".", " ", ":", "@", "[", "_")) + ")"
    edge = lambda side, at: f"case when {x}.{side} = '' then 'none' when {x}.{side} rlike r'{at[0]}[\\p{{L}}]{at[1]}' then 'letter' when {x}.{side} rlike r'{at[0]}\\s{at[1]}' then 'space' when {x}.{side} rlike r'{at[0]}[0-9]{at[1]}' then 'digit' else 'sign' end"
    features = [f"least(length({digits}), 20)", f"least(length({m}) div 4, 20)", signs, edge("before", ("", "$")), edge("after", ("^", "")), "v[3]", "v[4]"]
    return _let(f"array({', '.join(cast)})", "v", f"named_struct('kind', {x}.kind, 's', {x}.s, 'e', {x}.s + length({m}), 'votes', v, 'features', array({', '.join(f'cast({f} as string)' for f in features)}))")


#: What labelers are taken to do before any vote, with the weight of so many votes: the chances of
#: a vote against, none, and for, on true and on false spans.
HABITS = {
    "format": ((0.05, 0.35, 0.6), (0.4, 0.4, 0.2)),
    "gazetteer": ((0.05, 0.35, 0.6), (0.4, 0.4, 0.2)),
    "structure": ((0.05, 0.1, 0.85), (0.65, 0.1, 0.25)),
    "context_for": ((0.01, 0.49, 0.5), (0.01, 0.89, 0.1)),
    "context_against": ((0.02, 0.97, 0.01), (0.6, 0.39, 0.01)),
}
HABIT_VOTES = 10


def reliabilities(candidates: DataFrame, turns: int = 40) -> DataFrame:
    """(kind, prior, right, wrong, patterns) by expectation-maximisation over the counts of vote patterns.

    right and wrong: for each labeler the chances that it votes against, not at all, and for
    a true and a false span. patterns: the probability of truth for each vote pattern. One row a kind.
    """
    counts = candidates.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("c"))
    grouped = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "c"))).alias("h"))  # at most 3**5 patterns a kind
    n = len(LABELERS)

    def log_chance(p: str, rates: str) -> str:
        return f"aggregate(zip_with({p}, {rates}, (v, r) -> ln(r[v + 1])), 0D, (s, y) -> s + y)"

    def posterior(x: str, m: str) -> str:
        return f"1 / (1 + exp(least(greatest(ln(1 - {m}.prior) + {log_chance(f'{x}.votes', f'{m}.wrong')} - ln({m}.prior) - {log_chance(f'{x}.votes', f'{m}.right')}, -500D), 500D)))"

    def total(of: str) -> str:
        return f"aggregate(q, 0D, (s, y) -> s + {of})"

    habit = lambda truth: "array(" + ", ".join("array(" + ", ".join(f"{x}D" for x in HABITS[name][truth]) + ")" for name in LABELERS) + ")"
    rate = lambda w, truth: f"transform(sequence(0, {n - 1}), j -> transform(sequence(0, 2), v -> ({total(f'if(y.votes[j] + 1 = v, y.c * {w}, 0D)')} + {HABIT_VOTES} * {habit(truth)}[j][v]) / ({total(f'y.c * {w}')} + {HABIT_VOTES})))"
    step = f"transform(array(transform(h, x -> named_struct('votes', x.votes, 'c', x.c, 'p', {posterior('x', 'm')}))), q -> named_struct('prior', ({total('y.c * y.p')} + 1) / ({total('y.c')} + 2), 'right', {rate('y.p', 0)}, 'wrong', {rate('(1 - y.p)', 1)}))[0]"
    start = f"named_struct('prior', 0.5D, 'right', {habit(0)}, 'wrong', {habit(1)})"
    fitted = grouped.select("kind", "h", F.expr(f"aggregate(sequence(1, {turns}), {start}, (m, i) -> {step})").alias("m"))
    return fitted.select("kind", "m.prior", "m.right", "m.wrong", F.expr(f"transform(h, x -> named_struct('votes', x.votes, 'p', {posterior('x', 'm')}))").alias("patterns"))


def classifier(candidates: DataFrame, fitted: DataFrame) -> dict[str, float]:
    """The naive Bayes table trained on the soft labels: log-odds by 'kind|feature|value', and 'kind' for the prior."""
    soft = fitted.select("kind", F.explode("patterns").alias("x")).select("kind", "x.votes", "x.p")
    counts = candidates.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.join(F.broadcast(soft), ["kind", "votes"])  # soft: at most 5 x 3**5 rows
    parts = rows.select("kind", "c", "p", F.posexplode("features").alias("f", "value"))
    by_value = parts.groupBy("kind", "f", "value").agg(F.sum(F.col("c") * F.col("p")).alias("yes"), F.sum(F.col("c") * (1 - F.col("p"))).alias("no"))
    by_kind = rows.groupBy("kind").agg(F.sum(F.col("c") * F.col("p")).alias("all_yes"), F.sum(F.col("c") * (1 - F.col("p"))).alias("all_no"))
    odds = by_value.join(F.broadcast(by_kind), "kind").select(F.concat_ws("|", "kind", "f", "value").alias("k"), (F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 1))).alias("w"))
    prior = by_kind.select(F.col("kind").alias("k"), F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("w"))
    return {r["k"]: r["w"] for r in odds.unionByName(prior).collect()}


def find_personal_data(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added) of every row of (doc_id, text).

    The first counts and the digest are of the base spans. spans joins these and the
    candidates that the classifier gives at least `threshold`, as kind:start:end by start,
    then kind; n_spans counts them, n_added those that the method adds.
    """
    rows = written(scanned(docs), "spans")
    candidates = rows.select(F.explode("candidates").alias("c")).select("c.*")
    fitted = written(reliabilities(candidates), "reliabilities")
    table = classifier(candidates, fitted)
    dropped(fitted)
    if table:
        odds = F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv])
        log_odds = lambda c: reduce(lambda a, i: a + F.coalesce(odds[F.concat_ws("|", c["kind"], F.lit(str(i)), F.get(c["features"], i))], F.lit(0.0)), range(FEATURES), F.coalesce(odds[c["kind"]], F.lit(0.0)))
        chosen = F.filter("candidates", lambda c: log_odds(c) >= F.log(F.lit(threshold / (1 - threshold))))
        rank = F.create_map(*[F.lit(v) for i, k in enumerate(ALL_KINDS) for v in (k, str(i))])
        added = F.transform(chosen, lambda c: F.concat(F.lpad(c["s"].cast("string"), 10, "0"), rank[c["kind"]], F.concat_ws(":", c["kind"], c["s"], c["e"])))
    else:
        added = F.array().cast("array<string>")
    every = rows.withColumn("every", F.array_union("base", added))
    n = F.size("every").cast("long")
    return every.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("every")).alias("spans"), n.alias("n_spans"), (n - F.size("base")).alias("n_added"))
