"""Quality rules: base counts of words and lines, and tokeniser fertility.

Two public vocabularies measure every text: a byte-level BPE gives characters per token and the entropy of the
token distribution, a piece BPE with byte fallback gives the share of pieces that fell back to single bytes.
A text is rejected where a measure leaves the band of its language (or, where the language has too few rows, of its script).

Bands come from the spread of ordinary texts, over all rows: those that pass the base rule. Their lower limit lies below the median
by so many times the distance from the median up to the ninth decile, their upper limit above it by so many times the distance down to
the first decile. So a third of all rows that are junk on one side widens the band on the other side only. Entropy grows with a text's
length: it has a band, from below, for each language and power of two of tokens. A text low in both measures leaves a narrower joint
band: two distances in each are as rare among normal values (2.6 deviations, twice) as three in one (3.8 deviations). Languages and
scripts with too few rows keep to the fixed limits. Quantiles are merged from digests of bounded size.

Defined results: a null or empty text has no words, so it fails the base rule (fewer than 50 words); measures of a
text without tokens are 0 and reject nothing by themselves. Repeated rows and ties give the same verdict each, an empty table gives an
empty table, and other columns are carried or ignored as asked.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import held, materialize

WHITE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string"


@dataclass(frozen=True)
class Band:
    """Fixed limits, ends included, that hold besides those from the spread; entropy is in bits, divided by the most that the text's length allows."""

    chars_per_token: tuple[float, float] = (1.0, 12.0)
    byte_share: float = 0.10
    entropy: tuple[float, float] = (0.30, 1.0)


@dataclass(frozen=True)
class FertilityRules:
    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    pieces: str = "piece_bpe_32k.model"
    min_words: int = 50
    max_repeat_percent: int = 50
    by_script: dict[str, Band] = field(default_factory=lambda: {"latin": Band(), "cyrillic": Band((0.8, 12.0), 0.15), "cjk": Band((0.25, 4.0), 0.60), "other": Band((0.25, 12.0), 0.90)})
    #: Limits from the spread of ordinary texts, in distances from the median to the deciles, and rows that a band is taken from at least.
    below: float = 3.0
    below_both: float = 2.0
    above: float = 4.0
    min_rows: int = 50
    #: Bands up to this number are broadcast.
    few_bands: int = 100_000


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated 3-word windows of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII white space only
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines, seen, dup = data.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        distinct = set(windows)
        if len(distinct) < n - 2:
            count = Counter(windows)
            mark = np.zeros(n + 2, bool)
            at = np.fromiter((count[w] > 1 for w in windows), bool, n - 2)
            mark[: n - 2] |= at
            mark[1 : n - 1] |= at
            mark[2:n] |= at
            repeated = int(mark.sum())
    return n, chars, symbols, dup, repeated


class _Vocabularies:
    """A worker's tokenisers, and which characters the piece vocabulary has only as bytes."""

    def __init__(self, ranks_path: str, pieces_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.falls: dict[str, bool] = {}

    @classmethod
    def get(cls, *key) -> _Vocabularies:
        own = held("quality")
        if key not in own:
            own[key] = cls(*key)
        return own[key]

    def byte_share(self, text: str, words: list[bytes]) -> float:
        """Of all pieces of the words, the share that are single bytes. Only characters without a piece fall back, so texts without such have none."""
        falls = False
        for c in set(text):
            if c not in self.falls:
                self.falls[c] = c not in " \t\n\r\x0b\x0c" and bool(self.is_byte[self.pieces.encode(c)].any())
            falls |= self.falls[c]
        if not falls:
            return 0.0
        ids = self.pieces.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return sum(int(self.is_byte[x].sum()) for x in ids) / max(1, sum(map(len, ids)))


def script_of(text: str, ascii_only: bool) -> str:
    """The script of most letters; ties go to the first by name."""
    if ascii_only:
        return "latin"
    tally: Counter[str] = Counter()
    for c in text:
        o = ord(c)
        if o < 0x250:
            if c.isalpha():
                tally["latin"] += 1
        elif 0x400 <= o < 0x530:
            tally["cyrillic"] += 1
        elif 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0:
            tally["cjk"] += 1
        elif c.isalpha():
            tally["other"] += 1
    return max(sorted(tally), key=tally.get) if tally else "latin"


def measure(docs: DataFrame, rules: FertilityRules | None = None, tokenizer_dir: str | None = None, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns and every measure of each whole text; one pass, no shuffle."""
    rules = rules or FertilityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        place = (lambda n: os.path.join(tokenizer_dir, n)) if tokenizer_dir else public_tokenizers.path
        voc = _Vocabularies.get(place(rules.vocabulary), place(rules.pieces))
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                ids = voc.bpe.encode_to_numpy(text) if text else np.zeros(0, np.uint32)
                entropy = 0.0
                if len(ids) > 1:
                    p = np.unique(ids, return_counts=True)[1] / len(ids)
                    entropy = float(-(p * np.log2(p)).sum() / math.log2(len(ids)))
                rows.append((*base_counts(text), len(ids), len(text) / max(1, len(ids)), voc.byte_share(text, words), min(1.0, max(0.0, entropy)), script_of(text, len(data) == len(text))))
            out = [pa.array(c) for c in zip(*rows)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], schema=_schema(batch.schema))

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{fields}, {MEASURES}")


def _schema(given: pa.Schema) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([*list(given)[1:], *((n, kinds[k]) for n, k in (x.split() for x in MEASURES.split(", ")))])


def _failed(rules: FertilityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def _keys() -> dict[str, Column]:
    """What bands are looked up by: language and script, alone and with the power of two of tokens."""
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("string")
    names = {"lang": F.concat(F.lit("lang:"), F.lower(F.col("lang"))), "script": F.concat(F.lit("script:"), F.col("script"))}
    return names | {f"{k}_size": F.concat(v, F.lit(":"), size) for k, v in names.items()}


def bands(measured: DataFrame, rules: FertilityRules | None = None) -> DataFrame:
    """band (a key) and its limits low_chars, high_chars, low_bits, joint_chars, joint_bits: from all rows that pass the base rule."""
    rules = rules or FertilityRules()
    ordinary = measured.where((F.col("n_tokens") > 0) & ~_failed(rules))
    own = ordinary.select(F.explode(F.array_compact(F.array(*_keys().values()))).alias("band"), "chars_per_token", _bits().alias("bits"))
    deciles = lambda c: F.percentile_approx(c, [0.1, 0.5, 0.9], 10_000)
    per = own.groupBy("band").agg(deciles("chars_per_token").alias("c"), deciles("bits").alias("e"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.min_rows)
    low = lambda c, times: F.col(c)[1] - times * (F.col(c)[2] - F.col(c)[1])
    high = F.col("c")[1] + rules.above * (F.col("c")[1] - F.col("c")[0])
    joint = [low("c", rules.below_both).alias("joint_chars"), low("e", rules.below_both).alias("joint_bits")]
    return per.select("band", low("c", rules.below).alias("low_chars"), high.alias("high_chars"), low("e", rules.below).alias("low_bits"), *joint)


def _bits() -> Column:
    return F.col("entropy") * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))


def judge(measured: DataFrame, rules: FertilityRules | None = None) -> DataFrame:
    """Adds base_failed, band (whose limits hold), reject_reason (null if kept) and kept. ``measured`` is read twice: give a written table."""
    rules = rules or FertilityRules()
    limits = materialize(bands(measured, rules))
    few = limits.count() <= rules.few_bands
    out, found = measured, {}
    for k, key in _keys().items():
        side = limits.select(F.col("band").alias(f"_{k}"), F.struct(*limits.columns).alias(f"_of_{k}"))
        out = out.withColumn(f"_{k}", key).join(F.broadcast(side) if few else side, f"_{k}", "left")
        found[k] = F.col(f"_of_{k}")
    own, sized = F.coalesce(found["lang"], found["script"]), F.coalesce(found["lang_size"], found["script_size"])
    fixed = F.lit(None).cast("string")
    for name, b in rules.by_script.items():
        reason = (
            F.when(~F.col("chars_per_token").between(*b.chars_per_token), "characters per token")
            .when(F.col("byte_share") > b.byte_share, "byte fallback")
            .when((F.col("n_tokens") > 1) & ~F.col("entropy").between(*b.entropy), "token entropy")
        )
        fixed = F.when(F.col("script") == name, reason).otherwise(fixed)
    both = (F.col("chars_per_token") < own["joint_chars"]) & (_bits() < sized["joint_bits"])
    spread = F.when(~F.col("chars_per_token").between(own["low_chars"], own["high_chars"]), "characters per token").when((_bits() < sized["low_bits"]) | both, "token entropy")
    failed = _failed(rules)
    why = F.when(failed, "base rule").when(F.col("n_tokens") > 0, F.coalesce(fixed, spread))
    out = out.withColumns({"base_failed": failed, "band": F.coalesce(own["band"], F.lit("none")), "reject_reason": why})
    return out.drop(*(f"_{k}" for k in found), *(f"_of_{k}" for k in found)).withColumn("kept", F.col("reject_reason").isNull())


def quality(docs: DataFrame, rules: FertilityRules | None = None, tokenizer_dir: str | None = None) -> DataFrame:
    """Measures and verdict of every row of documents(doc_id, text, lang)."""
    return judge(materialize(measure(docs, rules, tokenizer_dir)), rules)


def kept_rows(docs: DataFrame, rules: FertilityRules | None = None, tokenizer_dir: str | None = None) -> DataFrame:
    """The rows whose text is kept, with all their columns; without a shuffle of texts."""
    columns = [c for c in docs.columns if c != "text"]
    lang = F.col("lang") if "lang" in columns else F.lit(None).cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), lang.alias("lang"), "text", F.col("text").alias("_text"))
    judged = judge(materialize(measure(own, rules, tokenizer_dir, keep=("_row", "_text", "lang"))), rules)
    return judged.where("kept").select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
