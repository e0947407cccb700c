"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts.

Seed entities are the fixed kinds (email, ip, card, phone) and a quarter, by hash, of the values of secret shape (long hexadecimal runs).
Other values of secret shape and other tokens with a digit are instances that patterns may discover; what a fixed kind's check
refuted (a card number failing Luhn's test) is none, but counts against patterns. The lexical patterns of a token are
its two words before it, the word before it with the word after it, and the word before it with the token's shape. A pattern
that enough distinct accepted values, and enough of its instances, support is scored by the share that instances have of its
occurrences: anywhere in the corpus, with whatever word, for patterns of words, among tokens of its shape for the others. Tokens
take the noisy-or of their patterns' scores; those scored high enough count as entities in the next round. The rounds run on the bipartite table of patterns and values until one
neither accepts a value nor raises an accepted one's score.

Spans of discovered tokens are of kind context, those of seeds of their own kind. Values of secret shape that no pattern finds are
reported as secret all the same: the patterns decide what they are called, never whether they are masked.

Defined results: a null or empty text has no spans. Rows are judged one by one, so repeated rows repeat their spans; equal starts
are ordered by kind, then end. An empty table gives an empty table. Extra columns are ignored by ``find`` and kept by ``redact``.
Starts and ends are code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialize

#: Kinds in their order. The group repetitions of the plain forms are written with look-behinds on single characters, as
#: repeated groups recurse in Java's matcher and very long runs would exhaust its stack; the matches are the same.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))*(?<![\x20-])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
SECRET = r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])"
#: Tokens that may be identifiers: they hold a digit.
TOKEN = r"(?<![\p{L}\p{N}_.@+-])[\p{L}_.@+-]*+[0-9][\p{L}\p{N}_.@+-]*"
KINDS = [*BASE, "secret", "context"]
#: Numbers of the kinds beyond the fixed ones; the last two never leave this module.
SECRET_KIND, TOKEN_KIND, UNSEEN_SECRET, REFUTED = 4, 5, 6, 7
#: Scores of accepted values that rise by less in all leave the rounds settled.
SETTLED = 1e-6


@dataclass(frozen=True)
class Bootstrap:
    min_values: int = 5
    #: Least share of a pattern's occurrences that are instances, and of those that are accepted.
    min_pattern: float = 0.8
    min_known: float = 0.1
    min_score: float = 0.8
    min_token_chars: int = 6
    #: One value in so many of secret shape is a seed.
    seed_one_in: int = 4


def _spans(text: str, found: str, regex: str, kind: int) -> str:
    """SQL for the spans of the matches in ``found``: what lies between them gives their places."""
    between = f"split({text}, r'{regex}', -1)"
    step = (
        "(a, m) -> named_struct('at', a.at + length(a.p[a.i]) + length(m), 'i', a.i + 1, 'p', a.p, 'out', "
        f"array_append(a.out, named_struct('start', a.at + length(a.p[a.i]), 'kind', {kind}, 'end', a.at + length(a.p[a.i]) + length(m), 'value', m)))"
    )
    empty = "cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>)"
    start = f"named_struct('at', 0, 'i', 0, 'p', {between}, 'out', {empty})"
    return f"CASE WHEN size({found}) > 0 THEN aggregate({found}, {start}, {step}, a -> a.out) ELSE {empty} END"


def luhn(digits: str) -> str:
    """SQL: does a string of digits pass Luhn's check?"""
    d = f"cast(substr(reverse({digits}), i + 1, 1) AS int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + CASE WHEN i % 2 = 0 THEN {d} WHEN {d} < 5 THEN 2 * {d} ELSE 2 * {d} - 9 END) % 10 = 0"


VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), q -> length(trim(LEADING '0' FROM q)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM q) AS int), 0) <= 255)",
    "card": f"length(regexp_replace(x.value, '[ -]', '')) BETWEEN 12 AND 19 AND {luhn("regexp_replace(x.value, '[ -]', '')")}",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 9 AND 15",
}


#: Of matches that fail, those that look like the kind but for its check.
LIKE = {"ip": "true", "card": "length(regexp_replace(x.value, '[ -]', '')) BETWEEN 12 AND 19"}


def _raw_matches(docs: DataFrame, tokens: bool) -> DataFrame:
    text = F.col("text")
    none = F.expr("cast(array() AS array<string>)")
    found = lambda r, has: F.when(has, F.regexp_extract_all(text, F.lit(r), F.lit(0))).otherwise(none)
    digit = text.rlike("[0-9]")
    cols = {"m_email": found(EMAIL, text.contains("@")), "m_ip": found(IP, digit), "m_card": found(CARD, digit), "m_phone": found(PHONE, text.contains("+"))}
    if tokens:
        cols |= {"m_secret": found(SECRET, digit), "m_token": found(TOKEN, digit)}
    return docs.withColumns(cols)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds base: array of (start, kind number, end, value), by start, then kind, of whole texts."""
    return _located(docs, tokens=False).drop("m_email", "m_ip", "m_card", "m_phone")


def _located(docs: DataFrame, tokens: bool) -> DataFrame:
    docs = _raw_matches(docs.withColumn("text", F.coalesce("text", F.lit(""))), tokens)
    parts = []
    for k, name in enumerate(BASE):
        parts.append(f"filter({_spans('text', f'm_{name}', BASE[name], k)}, x -> {VALID[name]})")
    docs = docs.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    if not tokens:
        return docs
    failed = [f"filter({_spans('text', f'm_{name}', BASE[name], k)}, x -> {LIKE[name]} AND NOT ({VALID[name]}))" for k, name in enumerate(BASE) if name in LIKE]
    return docs.withColumn("refuted", F.expr(f"concat({', '.join(failed)})"))


def _patterns(start: str, end: str, value: str) -> str:
    """SQL: hashes of a token's patterns. Words within 64 characters count; up to three other characters may stand between."""
    before = f"substring(text, greatest(1, {start} - 63), least({start}, 64))"
    left = f"regexp_extract({before}, r'(\\S+\\s+\\S+)\\s+\\S{{0,3}}$', 1)"
    last = f"regexp_extract({before}, r'(\\S+)\\s+\\S{{0,3}}$', 1)"
    after = f"regexp_extract(substring(text, {end} + 1, 64), r'^\\S{{0,3}}\\s+(\\S+)', 1)"
    runs = f"regexp_replace(regexp_replace(lower({value}), r'\\p{{L}}+', 'a'), '[0-9]+', '9')"
    shape = f"concat(CASE WHEN length({runs}) <= 12 THEN {runs} ELSE 'mixed' END, floor(log2(length({value}))))"
    return (
        "array_compact(array("
        f"CASE WHEN {left} != '' THEN {_hash('before', f"lower(split({left}, r'\\s+')[0])", f"lower(split({left}, r'\\s+')[1])")} END, "
        f"CASE WHEN {last} != '' AND {after} != '' THEN {_hash('around', f'lower({last})', f'lower({after})')} END, "
        f"CASE WHEN {last} != '' THEN {_hash('shape', f'lower({last})', shape)} END))"
    )


def _hash(kind: str, a: str, b: str) -> str:
    """SQL: a pattern's hash. Patterns of words, which all texts can hold, are even, those of shapes odd."""
    low = "| 1L" if kind == "shape" else "& -2L"
    return f"(xxhash64('{kind}', {a}, {b}) {low})"


def candidates(docs: DataFrame, keys: list[str], b: Bootstrap) -> DataFrame:
    """keys, base spans, ents (seeds, tokens that may be identifiers, refuted ones, each with value and pattern hashes) and pairs (hashes
    of all patterns of words in the texts with any)."""
    located = _located(docs.select(*keys, "text"), tokens=True)
    secret = f"filter({_spans('text', 'm_secret', SECRET, SECRET_KIND)}, s -> NOT exists(base, x -> x.start < s.end AND s.start < x.end))"
    secret = f"transform({secret}, s -> named_struct('start', s.start, 'kind', CASE WHEN pmod(xxhash64(lower(s.value)), {b.seed_one_in}) = 0 THEN {SECRET_KIND} ELSE {UNSEEN_SECRET} END, 'end', s.end, 'value', s.value))"
    token = f"{_spans('text', 'm_token', TOKEN, TOKEN_KIND)}"
    located = located.withColumn("secret", F.expr(secret)).withColumn("token", F.expr(token))
    seeds = located.withColumn("seeds", F.expr("concat(base, secret)"))
    ok = f"length(t.value) >= {b.min_token_chars} AND NOT exists(seeds, x -> x.start < t.end AND t.start < x.end)"
    kind = f"CASE WHEN exists(refuted, x -> x.start < t.end AND t.start < x.end) THEN {REFUTED} ELSE t.kind END"
    free = f"transform(filter(token, t -> {ok}), t -> named_struct('start', t.start, 'kind', {kind}, 'end', t.end, 'value', t.value))"
    seeds = seeds.withColumn("free", F.expr(free))
    ent = f"transform(concat(seeds, free), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'value', xxhash64(lower(x.value)), 'patterns', {_patterns('x.start', 'x.end', 'x.value')}))"
    words = F.when(F.size("seeds") + F.size("free") > 0, F.split("text", r"\s+")).otherwise(F.expr("cast(array() AS array<string>)"))
    found = seeds.select(*keys, F.expr("transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))").alias("base"), F.expr(ent).alias("ents"), words.alias("w"))
    return found.withColumn("pairs", F.expr(_PAIRS)).drop("w")


#: SQL: hashes of every two words that another follows, and of every two words around another.
_PAIRS = (
    f"CASE WHEN size(w) > 2 THEN flatten(transform(sequence(0, size(w) - 3), i -> array({_hash('before', 'lower(w[i])', 'lower(w[i + 1])')}, {_hash('around', 'lower(w[i])', 'lower(w[i + 2])')}))) "
    "ELSE cast(array() AS array<bigint>) END"
)


def _background(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each wanted pattern occurs in rows of (context)."""
    return pairs.join(contexts, "context").groupBy("context").agg(F.count(F.lit(1)).alias("occurs"))


def learn(docs: DataFrame, ents: DataFrame, b: Bootstrap) -> DataFrame:
    """Values (hashes) of tokens that confident patterns single out, with their score."""
    occ = ents.select(F.explode("ents").alias("e")).select("e.value", "e.kind", F.explode("e.patterns").alias("context"))
    graph = materialize(occ.groupBy("context", "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") <= SECRET_KIND).alias("seed"), F.max(F.col("kind") == REFUTED).alias("refuted")))
    # Patterns can gain support from tokens that are accepted later, so all values count towards the support asked for here.
    able = F.when(~F.col("refuted"), F.col("n"))
    wanted = graph.groupBy("context").agg(F.count(able).alias("k"), F.sum(able).alias("n"), F.sum("n").alias("here")).where(F.col("k") >= b.min_values)
    wanted = materialize(wanted.where(F.col("n") >= b.min_pattern * F.col("here")).select("context", "n", "here"))
    shapes, pairs = F.col("context") % 2 != 0, F.col("context") % 2 == 0
    # What texts with entities hold of a pattern of words bounds its score from above: those that can't reach min_pattern, like
    # those of common words, needn't be counted in all texts.
    some = _background(ents.select(F.explode("pairs").alias("context")), wanted.where(pairs).select("context"))
    left = materialize(wanted.join(some, "context").where(F.col("n") >= b.min_pattern * F.col("occurs")).select("context"))
    words = docs.select(F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    # Exploded without a name in between: a filter on a named array would be pushed below the split and repeat it for every word.
    occurs = _background(words.select(F.explode(F.expr(_PAIRS)).alias("context")), left)
    occurs = materialize(occurs.unionAll(wanted.where(shapes).select("context", F.col("here").alias("occurs"))))
    graph = graph.join(occurs, "context")
    # A value that a check refuted anywhere is never accepted.
    refuted = graph.groupBy("value").agg(F.max("seed").alias("s"), F.max("refuted").alias("refuted")).where("refuted AND NOT s").select("value")
    score = graph.join(refuted, "value", "left_anti").groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    state = (-1, 0.0)
    while True:
        on = graph.join(score, "value")
        accepted = F.col("score") >= b.min_score
        known = F.sum(F.when(accepted, F.col("n")).otherwise(F.lit(0).cast("long"))) / F.sum("n")
        pattern = on.groupBy("context").agg(F.count_if(accepted).alias("values"), known.alias("known"), (F.sum("n") / F.max("occurs")).alias("p"))
        pattern = pattern.where((F.col("values") >= b.min_values) & (F.col("known") >= b.min_known) & (F.col("p") >= b.min_pattern)).select("context", F.least("p", F.lit(1.0)).alias("p"))
        found = graph.join(pattern, "context").groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("s"))
        score = score.join(found, "value", "left").select("value", F.greatest("score", F.coalesce("s", F.lit(0.0))).alias("score"))
        score = materialize(score)
        now = score.where(F.col("score") >= b.min_score).agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if now[0] == state[0] and now[1] <= state[1] + SETTLED:
            break
        state = (now[0], now[1])
    seeds = graph.where("seed").select("value").distinct()
    return score.where(F.col("score") >= b.min_score).join(seeds, "value", "left_anti")


def find(docs: DataFrame, b: Bootstrap | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, base and spans of every row: arrays of (start, kind number, end)."""
    b = b or Bootstrap()
    ents = materialize(candidates(docs, list(keys), b).withColumn("_row", F.monotonically_increasing_id()))
    values = learn(docs, ents, b)
    place = "named_struct('start', x.start, 'kind', x.kind, 'end', x.end)"
    secrets = f"transform(filter(ents, x -> x.kind = {SECRET_KIND}), x -> {place})"
    open_ = ents.select("_row", F.explode(F.expr(f"filter(ents, x -> x.kind IN ({TOKEN_KIND}, {UNSEEN_SECRET}))")).alias("e")).select("_row", "e.start", "e.kind", "e.end", "e.value")
    named = open_.join(values.select("value", F.lit(True).alias("hit")), "value", "left").where(f"hit OR kind = {UNSEEN_SECRET}")
    named = named.withColumn("kind", F.when(F.col("hit"), TOKEN_KIND).otherwise(SECRET_KIND))
    extra = named.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    none = "cast(array() AS array<struct<start:int,kind:int,end:int>>)"
    return ents.join(extra, "_row", "left").select(*keys, "base", F.expr(f"array_sort(concat(base, {secrets}, coalesce(extra, {none})))").alias("spans"))


def label(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS bigint)").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(label("base"), 256).alias("base_sha256"), label("spans").alias("spans"))


def redact(docs: DataFrame, b: Bootstrap | None = None) -> DataFrame:
    """The same rows and columns; every span's text gives way to its kind in brackets, and n_chars, if there, is counted anew."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    keyed = materialize(docs.select(F.struct(*others).alias("row"), F.col("text"), F.monotonically_increasing_id().alias("key")))
    # Written first, so that the planner knows its size and moves all texts only where it is large.
    spans = materialize(find(keyed, b, ("key",)).where("size(spans) > 0").select("key", "spans"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    # Overlapping spans are cut once: a span that starts before the last end is skipped up to that end.
    step = (
        "(a, x) -> CASE WHEN x.end <= a.at THEN a WHEN x.start < a.at THEN named_struct('at', x.end, 'out', a.out) "
        f"ELSE named_struct('at', x.end, 'out', array_append(a.out, concat(substring(text, a.at + 1, x.start - a.at), {names}[x.kind]))) END"
    )
    text = f"aggregate(spans, named_struct('at', 0, 'out', cast(array() AS array<string>)), {step}, a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"
    out = keyed.join(spans, "key", "left").withColumn("text", F.expr(f"CASE WHEN spans IS NULL THEN text ELSE {text} END"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
