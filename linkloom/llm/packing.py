"""Best-fit packing by patterns of lengths.

Documents become token ids and an end id; those beyond the capacity are cut into full pieces and a rest. Packing works on the
histogram of piece lengths alone, so its cost doesn't grow with the corpus: the histogram has at most ``capacity`` bars.
Patterns of up to three length classes that nearly fill a sequence are enumerated, non-negative least squares fits their
repeat counts to the histogram, the counts are rounded down to what the bars hold, each pattern takes the longest fitting
lengths of its classes, and the residual pieces go, longest first, to the open sequence with the least room that holds
them. Every piece then finds its slot from its rank among pieces of its length.

Defined results: a null or empty text is one piece that holds only the end id. Repeated rows are packed once each. An empty
table gives an empty table. Extra columns are ignored, or carried by ``pack`` if they are on the piece table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import held, materialize

CAPACITY = 2048
END_ID = 0
#: Length classes that the patterns are made of, and documents in a pattern at most.
CLASSES, PATTERN_DOCS = 64, 3


class _Tokens:
    """A worker's tokeniser. The ids of white-space-bounded chunks are kept up to a bound."""

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.most, self.ids = Tokenizer.from_file(path), most, {}
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [x.content.encode() for x in self.t.get_added_tokens_decoder().values()]

    @classmethod
    def get(cls, *key) -> _Tokens:
        own = held("packing")
        if key not in own:
            own[key] = cls(*key)
        return own[key]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, as the tokeniser gives for the whole text.

        The vocabulary drops white space before it merges, and folds case letter by letter, so chunks between
        ASCII white space are independent. Texts that hold a special token's string are encoded whole.
        """
        data = text.encode("utf-8", "replace")
        low = data.lower()  # ASCII letters only
        if any(s in low for s in self.special):
            return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks, ids = low.split(), self.ids
        try:
            return b"".join(map(ids.__getitem__, chunks))
        except KeyError:
            new = list({c for c in chunks if c not in ids})
            if len(ids) + len(new) > self.most:  # what came first is met most often, so the later half goes
                for c in list(islice(reversed(ids), self.most // 2)):
                    del ids[c]
                new = list({c for c in chunks if c not in ids})
            self._learn(new)
            return b"".join(map(ids.__getitem__, chunks))

    def _learn(self, chunks: list[bytes]) -> None:
        """Words of letters alone are one pre-token each, so many are encoded as one text and cut after each word-end id."""
        words, marked, rest = set(), [], []
        for c in chunks:
            w, tail = c.decode(), ""
            if w[-1] in ".,;:!?" and len(w) > 1:  # after a letter, one such mark is a pre-token of its own
                w, tail = w[:-1], w[-1]
            if not w.lower().isalpha():
                rest.append(c)
            elif tail:
                marked.append((c, w, tail))
                words.add(w)
            else:
                words.add(w)
        words = [w for w in words if w.encode() not in self.ids]
        if words:
            ids = np.array(self.t.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) == len(words):
                data, at = ids.tobytes(), 0
                for w, end in zip(words, (4 * ends).tolist()):
                    self.ids[w.encode()] = data[at:end]
                    at = end
            else:
                rest += [w.encode() for w in words]
        rest += [t.encode() for t in {t for _, _, t in marked} if t.encode() not in self.ids]
        for c, e in zip(rest, self.t.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)):
            self.ids[c] = np.array(e.ids, "<u4").tobytes()
        for c, w, tail in marked:
            self.ids[c] = self.ids[w.encode()] + self.ids[tail.encode()]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cached_words: int = 1_200_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit). A worker keeps the ids of up to cached_words words, about 200 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        t = _Tokens.get(tokenizer or public_tokenizers.path("word_bpe_49k.json"), cached_words)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = t.encode(text or "") + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = data[4 * at : 4 * (at + capacity)]
                    for c, v in zip(cols, (doc, k, at, len(part) // 4, part)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| with x >= 0, by accelerated projected gradients."""
    g, h = a.T @ a, a.T @ b
    v = np.ones(len(g)) / np.sqrt(len(g))
    for _ in range(30):
        v = g @ v
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(g))
    t = 1.0
    for _ in range(rounds):
        x2 = np.maximum(0, y - (g @ y - h) / step)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = x2 + (t - 1) / t2 * (x2 - x), x2, t2
    return x


def patterns(capacity: int, classes: int = CLASSES) -> list[tuple[int, ...]]:
    """Class combinations (class c: lengths up to (c + 1) * width) of one to PATTERN_DOCS documents whose upper ends leave less than a class of room."""
    width = -(-capacity // classes)
    top = capacity // width
    out = []
    for c in range(1, top + 1):
        if top - c == 0:
            out.append((c,))
        for d in range(1, min(c, top - c) + 1):
            e = top - c - d
            if e == 0:
                out.append((c, d))
            elif 0 < e <= d and PATTERN_DOCS >= 3:
                out.append((c, d, e))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, int]]:
    """Compositions (lengths of one sequence, in order) with repeat counts that place every piece; figures of the fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    open_: dict[tuple[int, ...], int] = {}
    if left[capacity]:
        open_[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    width = -(-capacity // CLASSES)
    pats = patterns(capacity)
    top = capacity // width
    bars = np.array([left[(c - 1) * width + 1 : c * width + 1].sum() for c in range(1, top + 1)], float)
    fitted = 0
    if bars.sum():
        a = np.zeros((top, len(pats)))
        for j, p in enumerate(pats):
            for c in p:
                a[c - 1, j] += 1
        weight = np.sqrt(np.arange(1, top + 1))[:, None]  # long pieces are harder to place later
        repeat = np.floor(nnls(a * weight, bars * weight[:, 0] / bars.max()) * bars.max() + 1e-6).astype(np.int64)
        for j in sorted(range(len(pats)), key=lambda j: (-pats[j][0], pats[j])):
            todo = int(repeat[j])
            while todo > 0:  # each step uses up a length or the count
                used: list[int] = []
                room = capacity
                for k, c in enumerate(pats[j]):
                    rest = pats[j][k + 1 :]
                    # The last one takes the longest that fits, of its class or above.
                    high = min(c * width, room - sum((x - 1) * width + 1 for x in rest)) if rest else room
                    span = left[(c - 1) * width + 1 : high + 1].copy()
                    for u in used:
                        if (c - 1) * width < u <= high:
                            span[u - (c - 1) * width - 1] -= 1
                    found = np.nonzero(span > 0)[0]
                    if not len(found):
                        break
                    used.append((c - 1) * width + 1 + int(found[-1]))
                    room -= used[-1]
                if len(used) < len(pats[j]):
                    break
                need = {u: used.count(u) for u in used}
                n = min(todo, *(int(left[u]) // m for u, m in need.items()))
                for u, m in need.items():
                    left[u] -= n * m
                open_[tuple(used)] = open_.get(tuple(used), 0) + n
                todo -= n
                fitted += n
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for p, n in open_.items():
        room[capacity - sum(p)][p] = n
    filled = np.array([sum(x.values()) for x in room])
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.nonzero(filled[length:capacity])[0]
            if len(fits):
                r = length + int(fits[0])
                p = min(room[r])
                m = 1
            else:
                r, p, m = capacity, (), capacity // length  # new sequences take as many as they hold
            n = min(int(left[length]) // m, room[r][p]) if p else int(left[length]) // m
            if n == 0:
                m, n = int(left[length]), 1
            if p:
                room[r][p] -= n
                filled[r] -= n
                if not room[r][p]:
                    del room[r][p]
            q = p + (length,) * m
            room[r - length * m][q] = room[r - length * m].get(q, 0) + n
            filled[r - length * m] += n
            left[length] -= n * m
    out = [(p, n) for x in room for p, n in sorted(x.items())]
    return out, {"sequences": sum(n for _, n in out), "compositions": len(out), "by_pattern": fitted}


def _slots(compositions: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of the slots, their first sequence and their offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    nxt: dict[int, int] = {}
    base = 0
    for p, n in compositions:
        at = 0
        for length in p:
            rows.setdefault(length, []).append((nxt.get(length, 0), base, at))
            nxt[length] = nxt.get(length, 0) + n
            at += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in rows.items()}


def pack(piece_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with a length column (1 to capacity); other columns are carried.

    A first pass numbers the pieces of each length within each task's output and is written to the shared folder. Sums of
    those counts over the tasks give every piece its rank among all of its length, so no task gathers a length's pieces.
    Only the histogram (at most ``capacity`` rows) reaches the driver; the slots, sent back, are bounded likewise.
    """
    spark = piece_table.sparkSession
    names = piece_table.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_table.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            order = np.argsort(length, kind="stable")
            value, at, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(at, n) + np.repeat(seen[value], n)
            seen[value] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*names, "_part", "_rank"])

    held = materialize(piece_table.mapInArrow(number, f"{fields}, _part int, _rank long"))
    counts = materialize(held.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    bars = counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    slots = spark.sparkContext.broadcast(_slots(plan({r["length"]: r["n"] for r in bars}, capacity)[0]))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            length, rank = col("length").to_numpy(), col("_rank").to_numpy() + col("_first").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.nonzero(length == n)[0]
                start, base, offset = slots.value[n]
                j = np.searchsorted(start, rank[at], "right") - 1
                seq[at], off[at] = base[j] + rank[at] - start[j], offset[j]
            yield pa.RecordBatch.from_arrays([*map(col, names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return held.join(firsts, ["_part", "length"]).mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole packed sequences: sequence_id, n_tokens, ids and the spans of their pieces. At most one capacity of ids meets in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
        F.aggregate("p.ids", F.expr("cast('' AS binary)"), lambda a, x: F.concat(a, x)).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("spans"),
    )
