"""Near duplicates by DartMinHash.

A text is the multiset of its five-word shingles. Every unit of weight of a shingle is a strip of its own; darts hit the strip at
ranks of a Poisson process that is a pure function of shingle, unit and dart number, so texts that share a unit see the same darts.
Darts are thrown in the order of rank until about k (ln k + 2) of them have hit the text as a whole; each dart belongs to one of
k coordinates, and the earliest of each coordinate is the signature. Two signatures agree in a coordinate with a probability equal to the
weighted Jaccard similarity. Bands of ROWS coordinates are joined: a pair of similarity 0.8 meets in one of BANDS bands
with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9999.

Links are verified on the whole multisets. Copies are collapsed first. In a bucket each text is compared with two hubs;
then every text outside its bucket's largest component is compared with the texts of the bucket in other components: all of them if
the bucket is small, else those that prefix filtering leaves. So every pair that meets and isn't linked through others is
compared or shown to be below the threshold, without listing the pairs of a group of similar texts.

Defined results: texts without words (null, empty, punctuation) are classes of their own; texts of one to four words are
one shingle; repeated rows fall into one class; the class id is the least key in it; an empty table gives an
empty table; extra columns are ignored by ``classes`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import drop_table, held, materialize, shingle_hashes, words_of

THRESHOLD = 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
#: Share of equal coordinates below which a pair isn't verified: five standard deviations under the threshold.
LEAST_AGREEMENT = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / K)
#: Buckets of more texts than this are searched through rare shingles.
LARGE = 64

_A, _B, _C, _D, _E = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def dart_minhash(shingles: np.ndarray, sizes: np.ndarray, k: int = K) -> np.ndarray:
    """Signatures (texts by k, unsigned 64-bit) of texts whose shingles stand one after another, sorted within each; rows of empty texts are 0."""
    with np.errstate(over="ignore"):
        n = len(sizes)
        sig, done = np.zeros((n, k), np.uint64), sizes == 0
        doc = np.repeat(np.arange(n), sizes)
        first = np.ones(len(shingles), bool)
        first[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
        starts = np.nonzero(first)[0]
        unit = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
        strip = _mix(shingles.astype(np.uint64) + _A * (unit.astype(np.uint64) + np.uint64(1)))
        limit = k * (math.log(k) + 2) / np.maximum(1, sizes)
        while not done.all():
            at = np.nonzero(~done[doc])[0]
            base, d, rank = strip[at], doc[at], np.zeros(len(at))
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            throw = np.uint64(0)
            while len(base):
                throw += np.uint64(1)
                h = _mix(base + _D * throw)
                rank = rank - np.log1p(-(h >> np.uint64(11)).astype(float) * 2.0**-53)
                ok = rank < limit[d]
                base, d, rank = base[ok], d[ok], rank[ok]
                dart = _mix(h[ok] ^ _E)
                hits.append((d * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), rank, dart))
            cell, when, dart = (np.concatenate(x) for x in zip(*hits))
            order = np.argsort(-when, kind="stable")  # the earliest is written last
            flat, full = sig.reshape(-1), np.zeros(n * k, bool)
            flat[cell[order]] = dart[order]
            full[cell] = True
            done = done | full.reshape(n, k).all(1)
            limit = limit * 2  # texts with a coordinate that no dart has met are thrown at again, further
        return sig


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays as multisets."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    both, side = both[order], order < len(a)
    edge = np.nonzero(np.append(True, both[1:] != both[:-1]))[0]
    n_a = np.add.reduceat(side, edge, dtype=np.int64)
    n = np.diff(np.append(edge, len(both)))
    shared = int(np.minimum(n_a, n - n_a).sum())
    return shared / (len(both) - shared) if len(both) else 0.0


def _signatures(docs: DataFrame, key: str) -> DataFrame:
    """_row, key, content (two hashes and the size), bands, agree (a byte per coordinate) and sh (sorted 32-bit shingles)."""
    kind = docs.schema[key].dataType.simpleString()
    words = docs.select(F.col(key).alias("key"), words_of(F.col("text")).alias("_w"))
    sh = words.select("key", F.expr(shingle_hashes("_w")).alias("s")).select("key", "s", F.xxhash64("s").alias("c1"), F.xxhash64(F.lit(7), "s").alias("c2"), F.monotonically_increasing_id().alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("neardup")
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy().view(np.uint64).copy()
            ends = np.cumsum(sizes)
            for a, b in zip(ends - sizes, ends):
                flat[a:b].sort()
            sig = dart_minhash(flat, sizes)
            with np.errstate(over="ignore"):
                band = np.zeros((len(sizes), BANDS), np.uint64)
                for r in range(ROWS):
                    band = _mix(band * _D + sig[:, r::ROWS])
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(sizes > 0, BANDS, 0))), pa.int32()), pa.array(band[sizes > 0].reshape(-1).view(np.int64)))
            short = (flat >> np.uint64(32)).astype("<u4")
            agree = (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), batch.column(0), batch.column(2), batch.column(3), pa.array(sizes), bands, pa.array([x.tobytes() for x in agree], pa.binary()), pa.array([short[a:b].tobytes() for a, b in zip(ends - sizes, ends)], pa.binary())],
                ["_row", "key", "c1", "c2", "size", "bands", "agree", "sh"],
            )

    return sh.mapInArrow(run, f"_row long, key {kind}, c1 long, c2 long, size long, bands array<long>, agree binary, sh binary")


def _pairs_in(table: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both ends."""
    own = table.select(F.col("_row"), *columns)
    for end in "ab":
        pairs = pairs.join(own.select(F.col("_row").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)).hint("merge"), end)
    return pairs


def _verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs (a, b)."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(f"agree_{e}")).to_pylist()), np.uint8).reshape(-1, K) for e in "ab")
            ok = (x == y).mean(1) >= LEAST_AGREEMENT - (THRESHOLD - threshold)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(e)).filter(pa.array(ok)) for e in "ab"], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(f"sh_{e}")) for e in "ab")
            ok = [weighted_jaccard(np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")) >= threshold for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(e)).filter(pa.array(ok, pa.bool_())) for e in "ab"], ["a", "b"])

    near = materialize(_pairs_in(texts, pairs, ["agree"]).mapInArrow(agree, "a long, b long"))
    links = materialize(_pairs_in(texts, near, ["sh"]).mapInArrow(exact, "a long, b long"))
    drop_table(near)
    return links


def _prefix_pairs(texts: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components, one of them outside the largest of a large bucket, that can reach the threshold.

    Prefix filtering: under any one order of shingles, two texts whose overlap is at least ``need`` share a shingle among the first
    size - need + 1 of each. Here the order puts shingles that the bucket's most typical text lacks first. A text's edits are
    mostly its own and join nothing, so texts with too many of them drop out without a comparison, and no pair that can reach
    the threshold is lost.
    """
    group = large.groupBy(F.col("major").alias("g"), "id").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("major")).alias("minor"), F.first("meets").alias("meets"), F.first("size").alias("size"))
    group = materialize(group)
    typical = group.groupBy("g").agg(F.max_by("id", F.struct((~F.col("minor")).alias("inside"), "meets", "id")).alias("ref"), F.min("size").alias("least"), F.count_if("minor").alias("minors")).where("minors > 0")
    sh = texts.select(F.col("_row").alias("id"), "sh")
    refs = typical.join(sh.withColumnRenamed("id", "ref").hint("merge"), "ref").select("g", "least", F.col("sh").alias("ref_sh"))
    own = group.join(refs, "g").join(sh.hint("merge"), "id").select("g", "id", "least", "ref_sh", "sh")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for g, i, least, ref, sh in zip(*(c.to_pylist() if k < 3 else c for k, c in enumerate(batch.columns))):
                x, base = (_units(np.frombuffer(v.as_buffer(), "<u4")) for v in (sh, ref))
                order = x[np.lexsort((x, np.isin(x, base)))]
                n = len(order)
                need = math.ceil(threshold / (1 + threshold) * (n + max(least, math.ceil(threshold * n))) - 1e-9)
                keep = order[: max(0, n - need + 1)]
                for c, v in zip(cols, (np.full(len(keep), g), np.full(len(keep), i), np.arange(len(keep), dtype=np.int32), keep)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["g", "id", "pos", "token"])

    heads = materialize(own.mapInArrow(first, "g long, id long, pos int, token long"))
    shared = heads.groupBy("g", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "token")
    both = heads.join(shared.hint("merge"), ["g", "token"]).join(group.select("g", "id", "comp", "minor", "size").hint("merge"), ["g", "id"])
    both = materialize(both)
    x = both.where("minor").selectExpr("g", "id AS x", "size AS nx", "pos AS px", "token", "comp AS cx")
    y = both.selectExpr("g", "id AS y", "size AS ny", "pos AS py", "token", "comp AS cy", "minor AS my")
    need = f"ceil({threshold} / (1 + {threshold}) * (nx + ny) - 1e-9)"
    pairs = x.join(y.hint("merge"), ["g", "token"]).where(f"cx != cy AND (NOT my OR x < y) AND nx - px >= {need} AND ny - py >= {need} AND least(nx, ny) >= {need}")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _units(sh: np.ndarray) -> np.ndarray:
    """Sorted shingles as a set: the second of equal ones differs from the first."""
    at = np.arange(len(sh))
    new = np.append(True, sh[1:] != sh[:-1])
    return ((at - np.maximum.accumulate(np.where(new, at, 0))) << 32) + sh.astype(np.int64)


def components(links: DataFrame) -> DataFrame:
    """id and comp (the least id it is linked to, over any number of links) of every id in links (a, b), by large and small stars."""
    e = materialize(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u != v").distinct())
    while True:
        # Done when each id has one link, to an id that has none to a lesser one.
        ends = e.selectExpr("u AS x", "1 AS up").unionAll(e.selectExpr("v AS x", "0 AS up"))
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty():
            return e.selectExpr("u AS id", "v AS comp").unionAll(e.selectExpr("v AS id", "v AS comp").distinct())
        both = e.unionAll(e.selectExpr("v", "u"))
        large = both.join(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m")), "u").where("v > u").selectExpr("v AS u", "m AS v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").unionAll(least.selectExpr("u", "m AS v")).where("u != v").distinct()
        old, e = e, materialize(small)
        drop_table(old)


def _with_comp(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def classes(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key and class_id of every row."""
    table = materialize(_signatures(docs, key), "lz4")
    worded = table.where("size > 0")
    content = ["c1", "c2", "size"]
    reps = materialize(worded.groupBy(*content).agg(F.min(F.struct("key", "_row")).alias("m")).select(*content, "m.key", "m._row"))
    keys = worded.join(reps.select("_row"), "_row", "left_semi").select("_row", "size", F.posexplode("bands").alias("band", "v"))
    buckets = keys.groupBy("band", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keys.join(buckets.hint("merge"), ["band", "v"]).select("band", "v", "n", "size", F.col("_row").alias("id")))
    most = met.groupBy("id").agg(F.sum("n").alias("meets"))
    members = materialize(met.join(most.hint("merge"), "id"))
    texts = materialize(table.join(members.select(F.col("id").alias("_row")).distinct().hint("merge"), "_row", "left_semi").select("_row", "agree", "sh"), "lz4")
    # Each text with two hubs of each of its buckets: the one that meets most others over all bands, and one by hash.
    hubs = members.groupBy("band", "v").agg(F.array(F.max_by("id", F.struct("meets", "id")), F.min_by("id", F.xxhash64("id"))).alias("hubs"))
    met = members.join(hubs.hint("merge"), ["band", "v"]).select("id", F.explode(F.array_distinct("hubs")).alias("hub")).where("id != hub")
    comp = components(_verified(texts, met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), threshold))
    # Each text outside its bucket's largest component with those of other components: in small buckets with all, in large ones with
    # all that share a rare enough shingle.
    m = _with_comp(members, comp)
    sizes = m.groupBy("band", "v", "comp").agg(F.count(F.lit(1)).alias("k"))
    major = sizes.groupBy("band", "v").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("band", "v", "major")
    m = materialize(m.join(major, ["band", "v"]))
    small = m.where(F.col("n") <= LARGE)
    minor = small.where("comp != major").select("band", "v", F.col("id").alias("x"), F.col("comp").alias("cx"))
    met = minor.join(small, ["band", "v"]).where("comp != cx AND (comp = major OR x < id)").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
    met = met.unionAll(_prefix_pairs(texts, m.where(F.col("n") > LARGE), threshold)).distinct()
    found = _verified(texts, met, threshold)
    if not found.isEmpty():
        of = lambda end: comp.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}"))
        joined = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        ids = comp.unionAll(found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("comp")))
        comp = materialize(ids.join(merged, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
    # Classes are named by their least key; copies share the class of their representative.
    rep = reps.join(comp.withColumnRenamed("id", "_row"), "_row", "left").withColumn("comp", F.coalesce("comp", "_row"))
    name = rep.groupBy("comp").agg(F.min("key").alias("class_id"))
    named = rep.join(name, "comp").select(*content, "class_id")
    out = worded.select("key", *content).join(named, content).select("key", "class_id").unionAll(table.where("size = 0").select("key", F.col("key").alias("class_id")))
    return out.select(F.col("key").alias(key), "class_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The row of the least key of each class, with all its columns; rows that share a key are one document. Rows without a key stay."""
    named = docs.where(F.col(key).isNotNull())
    own = classes(named, key, threshold).where(F.col(key) == F.col("class_id")).select(F.col(key).alias("own")).distinct()
    kept = named.alias("d").join(own.alias("o"), F.col(f"d.{key}") == F.col("o.own"), "left_semi")
    return kept.dropDuplicates([key]).unionAll(docs.where(F.col(key).isNull()))
