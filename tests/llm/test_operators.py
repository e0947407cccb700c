"""The training-data operators on small fixtures, held against plain versions, round trips and defined edge cases."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import chat, decontaminate, licenses, neardup, packing, pii, quality, substring, toxicity, urlgraph
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, item string, words string, spans string, value string, row string, own string"
rng = random.Random(5)
SYLLABLES = ["the", "ing", "er", "on", "and", "re", "at", "en", "tion", "ti", "es", "or", "is", "was", "for", "with", "man", "work", "all", "over"]
VOCAB = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(3000)})


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs(spark, texts):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", None, *["x"] * 7) for i, t in texts], DOCS)


EDGE = [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "one two three four"), (905, "!!! ???"), (906, "é ñ 日本 " * 3), (907, "a" * 50_000), (908, "ha " * 20_000), (908, "ha " * 20_000), (None, "no key here at all my friend")]


@pytest.fixture(scope="module")
def texts():
    base = {i: prose(120 + 7 * i, i) for i in range(12)}
    out = dict(base)
    for i in range(12, 18):  # copies with one word changed
        w = base[i - 12].split()
        w[40] = "changed"
        out[i] = " ".join(w)
    out[18] = out[19] = base[3]
    out[20] = prose(80, 50) + " " + " ".join(base[5].split()[20:90]) + " " + prose(90, 51)
    out[21] = prose(30, 52) + " Released under the MIT License. " + prose(40, 53) + " Licensed under CC BY-NC 4.0.\n" + prose(9, 54)
    return out


def test_quality(spark, texts):
    rows = {i: t for i, t in [*texts.items(), *EDGE]} | {30: "a b c " * 40 + "\nx\nx\n\n#$ | x\n"}
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, rows.items())).collect()}
    for i, t in rows.items():
        if t is None or len(t) < 2000:
            r = got[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
    assert got[0]["kept"] and not got[901]["kept"] and not got[908]["kept"]
    assert got[906]["byte_share"] >= 0 and quality.quality(docs(spark, [])).count() == 0
    assert quality.kept_rows(docs(spark, rows.items())).columns == docs(spark, []).columns


def test_quality_bands(spark):
    fallback = " ".join(chr(0x1F900 + i) + chr(0x1FA00 + i) for i in range(60))
    good = {i: prose(60 + i % 90, 3000 + i) for i in range(120)}
    # A third of all rows is junk of one kind; some tables stand among prose.
    junk = {1000 + i: " ".join(w + "$$$" for w in prose(60 + i, 4000 + i).upper().split()) for i in range(60)}
    tables = {2000 + i: " | ".join(prose(90, 5000 + i).split()) for i in range(10)}
    rows = {r["doc_id"]: r for r in quality.quality(docs(spark, [*good.items(), *junk.items(), *tables.items(), (3000, fallback)])).collect()}
    assert sum(rows[i]["kept"] for i in good) >= 118
    assert not any(rows[i]["kept"] for i in junk) and {rows[i]["reject_reason"] for i in junk} == {"characters per token"}
    assert sum(rows[i]["reject_reason"] == "token entropy" or not rows[i]["kept"] for i in tables) >= 9
    assert rows[3000]["byte_share"] > 0.5 and rows[3000]["reject_reason"] is not None
    few = {r["doc_id"]: r for r in quality.quality(docs(spark, [(1, good[1]), (2, junk[1000]), (3, fallback)])).collect()}
    assert few[1]["kept"] and few[1]["band"] == "none" and few[3]["reject_reason"] in ("byte fallback", "characters per token")


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="needs the public vocabularies")
def test_fertility_measures(spark, texts):
    """Characters per token, byte share and entropy against encoding every text with both vocabularies."""
    import base64
    from collections import Counter

    import public_tokenizers
    import sentencepiece
    import tiktoken

    rules = quality.FertilityRules()
    with open(public_tokenizers.path(rules.vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(rules.pieces))
    odd = {80: "caf\u00e9 \U0001f9ff x \u65e5\u672c\u8a9e \u0001 y", 81: "\u1e9e\u2603 " * 30, 82: "plain", 83: "\u0416\u0438\u0437\u043d\u044c " * 9}
    rows = {i: t for i, t in [*texts.items(), *odd.items(), *EDGE] if i is not None}
    got = {r["doc_id"]: r for r in quality.measure(docs(spark, rows.items())).collect()}
    for i, t in rows.items():
        ids, n = bpe.encode(t or "", disallowed_special=()), Counter()
        n.update(ids)
        pieces = [x for w in (t or "").encode().split() for x in sp.encode(w.decode())]
        entropy = -sum(k / len(ids) * np.log2(k / len(ids)) for k in n.values()) / np.log2(len(ids)) if len(ids) > 1 else 0.0
        assert got[i]["n_tokens"] == len(ids) and got[i]["chars_per_token"] == pytest.approx(len(t or "") / max(1, len(ids)))
        assert got[i]["byte_share"] == pytest.approx(sum(sp.is_byte(x) for x in pieces) / max(1, len(pieces))) and got[i]["entropy"] == pytest.approx(entropy, abs=1e-9)


def test_near_duplicates(spark, texts):
    rows = texts | {i: t for i, t in EDGE if i is not None}
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [*rows.items(), (908, "ha " * 20_000)])).collect()}
    assert got == brute.near_classes(rows) | {i: i for i in (900, 901, 902, 905)}
    kept = neardup.deduplicated(docs(spark, [*texts.items(), *EDGE]))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert None in ids and sorted(i for i in ids if i is not None) == sorted(set(got.values())) and kept.columns == docs(spark, []).columns
    assert neardup.classes(docs(spark, [])).count() == 0


def test_large_groups_of_near_copies(spark):
    """More near copies than a bucket may be searched pair by pair, at all distances around the threshold."""
    base, rows = prose(150, 9).split(), {}
    for i in range(160):
        r, w = random.Random(i), list(base)
        for k in r.sample(range(150), i % 9):
            w[k] = f"edit{i}x{k}"
        rows[i] = " ".join(w)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, rows.items())).collect()}
    assert got == brute.near_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    a = np.sort(r.integers(0, 2**63, 300)).astype(np.uint64)
    a = np.sort(np.concatenate([a, a[:60]]))
    b = np.sort(np.concatenate([a[:300], r.integers(0, 2**63, 50).astype(np.uint64)]))
    sig = neardup.dart_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]), 2048)
    assert abs((sig[0] == sig[1]).mean() - neardup.weighted_jaccard(a, b)) < 0.05
    assert neardup.dart_minhash(np.zeros(0, np.uint64), np.array([0])).shape == (1, neardup.K)


def test_decontamination(spark, texts):
    items = {i: prose(20 + 5 * i, 100 + i) for i in range(8)} | {8: "one two three", 9: None, 10: ""}
    rows = dict(texts)
    for i in range(8):
        w = items[i].split()
        if i % 2:
            w[len(w) // 2] = "other"  # fewer shingles than needed in short items
        rows[40 + i] = prose(60, 200 + i) + " " + " ".join(w) + " " + prose(60, 300 + i)
    rows[50] = "ONE, two; three"
    bench = spark.createDataFrame(items.items(), "item_id long, text string")
    own = [*rows.items(), *EDGE]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contamination(docs(spark, own), bench).collect()}
    assert got == {k: pytest.approx(v) for k, v in brute.contamination(dict(own), items).items()} and len(got) >= 6
    clean = decontaminate.decontaminated(docs(spark, own), bench)
    assert clean.count() == len(own) - len({d for d, _ in got}) and clean.columns == docs(spark, []).columns
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs(spark, own), bench.limit(0)).count() == 0


def test_licenses(spark, texts):
    more = {60: "see: this work is LICENSED under the gnu general public license, version 3.", 61: "Licensed under the Apache Software License, Version 2.0."}
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.licenses(docs(spark, [*texts.items(), *more.items(), *EDGE])).collect()}
    assert got == {(21, "MIT"): 1.0, (21, "CC-BY-NC-4.0"): 1.0, (60, "GPL-3.0"): 1.0}
    assert licenses.licenses(docs(spark, [])).count() == 0


def test_licenses_against_brute_force(spark):
    """Every window of every template's size, with whole texts, edited ones and version numbers that tell licenses apart."""
    r, rows = random.Random(31), {}
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        for k in r.sample(range(len(w)), len(w) // 60):
            w[k] = "edited"
        rows[i] = f"{prose(r.randint(0, 50), 100 + i)} {' '.join(w)} {prose(r.randint(0, 50), 300 + i)}"
    got = {(x["doc_id"], x["template"]): x["containment"] for x in licenses.scan(docs(spark, rows.items())).collect()}
    want = brute.containments(rows, {f"{n}#{i}": t for i, (n, t) in enumerate(licenses.TEMPLATES)}, licenses.THRESHOLD)
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) >= len(rows)
    named = {(x["doc_id"], x["license"]) for x in licenses.licenses(docs(spark, rows.items())).collect()}
    assert all((i, n) in named for i, (n, _) in enumerate(licenses.TEMPLATES))


def test_personal_data(spark):
    cases = [
        "a@b.c_d@e.f x@y..z q@w.e. mail.a+b@c-d.e-f", "1.2.3.4.5 256.1.1.1 0.0.0.0 01.002.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559!!", "+1 (017) 555-7713 +123 +1234567890123456789",
        "4111  1111 1111 1111 1111", "é+49 (030) 12345678é", "1 2 3 4 5 6 7 8 9 0 1 2", "@@", "a@b", "9" * 3000, "a." * 5000 + "@" + "b." * 5000, "+" + "1 " * 4000, "x@" + "y" * 100,
    ]
    r = random.Random(2)
    cases += ["".join(r.choice("0129 .-+()@ab_") for _ in range(80)) for _ in range(400)]
    rows = [*enumerate(cases), *EDGE]
    got = {x["doc_id"]: x for x in pii.digest(pii.find(docs(spark, rows))).collect()}
    for i, t in rows:
        x = got[i]
        assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"], x["base_sha256"]) == brute.personal(t), (i, t)
    assert pii.find(docs(spark, [])).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"some words {i} here staff number u{i}@x.example.com and more") for i in range(9)] + [(20, "her staff number ZX-77812-Q is"), (23, "the ZX-77812-Q again of 555123999 here"), (24, None)]
    got = {x["doc_id"]: x["spans"] for x in pii.digest(pii.find(docs(spark, rows))).collect()}
    assert got[20] == "context:17:27" and got[23] == "context:4:14"
    masked = {x["doc_id"]: x for x in pii.redact(docs(spark, rows)).collect()}
    assert masked[20]["text"] == "her staff number [CONTEXT] is" and masked[24]["text"] is None and masked[0]["text"] == "some words 0 here staff number [EMAIL] and more" and masked[0]["n_chars"] == len(masked[0]["text"])


def test_planted_identifiers(spark):
    """Identifiers behind induced patterns of words, around them and of their shape; look-alikes elsewhere and refuted numbers stay."""
    r, rows, planted, decoys = random.Random(21), [], {}, {}
    for i in range(240):
        code = f"{r.choice('QXZ')}{r.choice('KLM')}-{r.randint(100000, 999999)}"
        value = f"{prose(1, 9000 + i)}{i}@mail.example.com" if i % 3 == 0 else code
        lead, tail = [(f"patient record {value} was", 1), (f"{prose(1, 8000 + i)} owner {value} signed", 2), (f"{prose(1, 8500 + i)} mailto: {value} {prose(1, 8700 + i)}", 3)][i % 9 // 3]
        text = f"{prose(20, i)} {lead} {prose(10, 500 + i)}"
        rows.append((i, text))
        if i % 3 and tail < 3:
            planted[i] = (text.index(value), text.index(value) + len(value))
    for i in range(300, 360):
        value = f"{r.choice('QXZ')}{r.choice('KLM')}-{r.randint(100000, 999999)}" if i % 2 else "4111111111111112"
        rows.append((i, f"{prose(20, i)} {value} {prose(10, 500 + i)}"))
        decoys[i] = value
    for i in range(400, 440):  # secrets: a quarter by hash are seeds, the others are found behind the same words
        rows.append((i, f'{prose(9, i)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(5, i + 50)}'))
    got = {x["doc_id"]: x["spans"] for x in pii.digest(pii.find(docs(spark, rows))).collect()}
    hits = sum(f"context:{a}:{b}" in got[i].split(",") for i, (a, b) in planted.items())
    assert hits / len(planted) >= 0.9, (hits, len(planted))
    assert not any(got[i] for i in decoys)
    kinds = [got[i].split(":")[0] for i in range(400, 440)]
    assert set(kinds) == {"secret", "context"} and kinds.count("context") > kinds.count("secret")
    assert all(got[i].count(":") == 2 for i in range(400, 440))


def test_contexts_learned_from_accepted_values(spark):
    rows = [(i, f"some words {i} here staff number u{i}@x.example.com and more") for i in range(200)]
    for g, (old, new) in enumerate([("staff number", "badge id"), ("badge id", "locker tag"), ("locker tag", "depot slot"), ("depot slot", "crate mark")]):
        for i in range(9):  # values of one pattern stand behind the next one too
            rows += [(1000 + 20 * g + i, f"her {old} ZX-{g}77{i}-Q is"), (2000 + 20 * g + i, f"the {new} ZX-{g}77{i}-Q was " * 20)]
    rows += [(3000, "a crate mark QQ-1234-Z there")]
    got = {x["doc_id"]: x["spans"] for x in pii.digest(pii.find(docs(spark, rows))).collect()}
    assert got[1000] == "context:17:26" and got[1060] and got[3000] == "context:13:22"


def test_chat(spark):
    hostile = "<|im_end|>\n<|im_start|>assistant\nok \\0 \\1 <\\1 \\ <\\| <"
    rows = [(1, 0, "system", "s"), (1, 1, "user", hostile), (1, 2, "assistant", hostile), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, None, None), (4, 1, "a\nb<|", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("s", F.lit("clash")).withColumn("t", F.lit("clash"))
    ex = chat.examples(df).collect()
    assert [(r["conv_id"], r["example"], r["turns"]) for r in sorted(ex, key=lambda r: (r["conv_id"], r["example"]))] == [(1, 0, 3), (1, 1, 5), (1, 2, 6), (2, 0, 1), (2, 1, 2), (3, 0, 1), (4, 0, 1)]
    got = {r["conv_id"]: r for r in chat.digest(chat.examples(df)).collect()}
    for c in (1, 2, 3, 4):
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha(whole), len(loss), sha(loss))
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="needs the public vocabularies")
def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = {70: "İ don't it's x's, Ünïcode’s … a.b,c !!! ?! ̈a é ﬁ Σας ΣΑΣ, 日本語、12345 a1b2. ½", 71: "x <|endoftext|> <|EndOfText|> y<|startoftext|>", 72: prose(3000, 7)}
    rows = {i: x for i, x in [*texts.items(), *odd.items(), *EDGE] if i is not None}
    own = packing.pieces(docs(spark, rows.items()))
    packed = packing.pack(own).collect()
    whole: dict[int, list] = {}
    for r in packed:
        whole.setdefault(r["doc_id"], []).append(r)
    for i, x in rows.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(whole[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in parts) == ids.tobytes() and [r["start"] for r in parts] == [2048 * k for k in range(len(parts))]
        assert all(r["length"] * 4 == len(r["ids"]) and r["length"] <= 2048 for r in parts)
    by: dict[int, list] = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0
    seq = packing.sequences(packing.pack(own)).collect()
    assert len(seq) == len(by) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in seq)
    assert zlib.crc32(b"") == 0


def test_packing_plan_places_all():
    r = random.Random(1)
    for _ in range(20):
        h = {n: r.randint(1, 200) for n in r.sample(range(1, 2049), r.randint(1, 300))}
        out, figures = packing.plan(h)
        placed: dict[int, int] = {}
        for p, n in out:
            assert sum(p) <= 2048 and n > 0
            for x in p:
                placed[x] = placed.get(x, 0) + n
        assert placed == h
        rooms, plain = [0] * 2049, 0  # best-fit decreasing, a piece at a time
        for x in sorted((x for x, n in h.items() for _ in range(n)), reverse=True):
            room = next((k for k in range(x, 2048) if rooms[k]), 2048)
            plain += room == 2048
            rooms[room] -= room != 2048
            rooms[room - x] += 1
        assert figures["sequences"] <= 1.02 * plain + 3


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = prose(60, 1000 + i).split()
        bad = i % 5 == 0
        if bad:
            w[r.randrange(60)] = r.choice(["vilebad", "rottenword", "awfulness"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs(spark, [*rows, *EDGE]), lab).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert np.mean([got[i]["predicted"] == dict(labels)[i] for i in held]) >= 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values())
    # Without any confirmed clean row: documents without a label are the unlabelled text, and the prior comes from both.
    alone = {x["doc_id"]: x for x in toxicity.toxicity(docs(spark, rows), lab.where("toxic = 1 AND doc_id % 2 = 0")).collect()}
    assert np.mean([alone[i]["predicted"] == dict(labels)[i] for i in held]) >= 0.9
    assert all(x["score"] < 1e-9 for x in toxicity.toxicity(docs(spark, rows[:5]), lab.limit(0)).collect())
    assert toxicity.toxicity(docs(spark, []), lab).count() == 0


def test_urls(spark):
    link = lambda *h: "".join(f'<a href="https://{x}/p">x</a>' for x in h)
    pages = [
        (1, "https://Good.org/a?x", link("friend.net", "good.org")), (2, "http://bad.com/de/x", link("good.org")), (3, "http://friend.net#f", "<a href='/local'>"), (4, "https://shill.net/", link("bad.com", "bad.com")), (5, "https://www.example.org/en/12", None),
        (6, "https://example.org/en/2", ""), (7, None, None), (8, "no scheme", None), (9, "https://x.fr.com/fr/", None), (10, "a://B://c/d", None), (11, "https://org", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: r for r in urlgraph.judge(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 3, 5, 6, 7, 8, 9, 10, 11)] == [
        ("good.org", "/a", "org/"), ("friend.net", "", None), ("www.example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("", "", None), ("", "", None), ("x.fr.com", "/fr/", "com/fr/"), ("b:", "//c/d", None), ("org", "", None),
    ]
    assert {i: got[i]["verdict"] for i in got} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert got[3]["trust"] > 0 and got[4]["distrust"] > 0
    assert urlgraph.judge(df.limit(0)).count() == 0


def test_pagerank_against_dense(spark):
    r = random.Random(6)
    n = 12
    e = [(f"h{a}", f"h{b}", r.randint(1, 3)) for a in range(n) for b in range(n) if a != b and r.random() < 0.2]
    hosts = spark.createDataFrame([(f"h{i}", float(i < 2)) for i in range(n)], "host string, good double")
    s = urlgraph.Spread()
    got = {x["host"]: x["rank"] for x in urlgraph.personalised_pagerank(hosts, spark.createDataFrame(e, "src string, dst string, n long"), "good", s).collect()}
    m, v = np.zeros((n, n)), np.array([0.5 if i < 2 else 0.0 for i in range(n)])
    for a, b, k in e:
        m[int(b[1:]), int(a[1:])] = k
    out = m.sum(0)
    x = v.copy()
    for _ in range(200):
        x = (0.15 + 0.85 * x[out == 0].sum()) * v + 0.85 * (m / np.where(out, out, 1)) @ x
    assert [got[f"h{i}"] for i in range(n)] == pytest.approx(x.tolist(), abs=1e-5)


def test_verdicts_spread_over_links(spark):
    """Hosts of which no rule says anything, against both walks solved densely; among them a chain of 25 hops to a blocked host."""
    r = random.Random(16)
    hosts = [f"h{i}.net" for i in range(20)] + [f"c{i}.net" for i in range(25)]
    links = {h: r.sample(hosts[:20] + ["good.org", "bad.com"], r.randint(0, 4)) for h in hosts[:20]}
    links |= {f"c{i}.net": [f"c{i + 1}.net" if i < 24 else "bad.com"] for i in range(25)}
    links |= {"good.org": hosts[:6], "bad.com": ["h19.net"]}
    pages = [(i, f"https://{h}{'/de/x' if h == 'bad.com' else '/a'}", "".join(f'<a href="//{x}/">' for x in to)) for i, (h, to) in enumerate(links.items())]
    got = {x["host"]: x for x in urlgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    names = sorted(links)
    m = np.zeros((len(names), len(names)))
    for h, to in links.items():
        for x in to:
            if x != h:
                m[names.index(x), names.index(h)] += 1

    def walk(m, seed):
        v = np.array([float(n == seed) for n in names])
        out, x = m.sum(0), v.copy()
        for _ in range(400):
            x = (0.15 + 0.85 * x[out == 0].sum()) * v + 0.85 * (m / np.where(out, out, 1)) @ x
        return x

    trust, distrust = walk(m, "good.org"), walk(m.T, "bad.com")
    blocked = {n for n, a, b in zip(names, trust, distrust) if b > 0.75 * (a + b)}
    assert {n for n in names if got[n]["verdict"] == "block"} == (blocked | {"bad.com"}) - {"good.org"}
    assert "c0.net" in blocked and 3 < len(blocked & set(hosts[:20])) < 20
    assert [got[n]["trust"] for n in names] == pytest.approx(trust.tolist(), abs=1e-5)


def test_screen_of_many_shingles(spark, texts, monkeypatch):
    """Known shingles in a table, broadcast or not, find what those compiled into the scan find."""
    from linkloom.llm import screen

    bench = spark.createDataFrame([(i, " ".join(texts[i].split()[10:60])) for i in range(6)], "item_id long, text string")
    run = lambda: sorted(map(tuple, decontaminate.contamination(docs(spark, [*texts.items(), *EDGE]), bench).collect()), key=str)
    inline = run()
    monkeypatch.setattr(screen, "INLINE", 10)
    assert run() == inline and len(inline) >= 6
    monkeypatch.setattr(screen, "FEW_KNOWN", 10)
    assert run() == inline


def test_passages(spark):
    shared, fuzzy = prose(70, 500), prose(80, 501).split()
    edited = list(fuzzy)
    for k in (15, 33, 52, 66):
        edited[k] = "edit"
    del edited[40]
    rows = {1: prose(50, 1) + " " + shared + " " + prose(60, 2), 2: shared + " " + prose(40, 3), 3: prose(10, 4) + " " + shared, 4: prose(90, 5) + " " + " ".join(fuzzy), 5: " ".join(edited) + " " + prose(44, 6), 6: prose(200, 7), 7: "ha " * 100, 8: "x " + "ha " * 80 + "y", 9: prose(30, 500) + " " + prose(99, 8)}
    got: dict[int, set] = {}
    for r in substring.passages(docs(spark, [*rows.items(), *EDGE])).collect():
        assert r["identity"] >= 0.8
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        got.setdefault(r["other_doc_id"], set()).update(range(r["other_start"], r["other_end"]))
    assert set(got) == {1, 2, 3, 4, 5, 7, 8, 908}
    assert set(range(50, 120)) <= got[1] and set(range(0, 70)) <= got[2] and set(range(10, 80)) <= got[3] and len(got[4] & set(range(90, 170))) >= 70
    assert substring.passages(docs(spark, [])).count() == 0


def test_passages_between_own_words(spark):
    shared = [prose(55, 700 + i) for i in range(6)]
    rows = [(i, " ".join(f"{x} {prose(20, 1000 * i + j)}" for j, x in enumerate(shared))) for i in (1, 2)]
    got = {}
    for r in substring.passages(docs(spark, rows)).collect():
        assert r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        got.setdefault(r["other_doc_id"], set()).update(range(r["other_start"], r["other_end"]))
    for i in (1, 2):
        assert all(set(range(75 * j, 75 * j + 55)) <= got[i] for j in range(6))


def test_passages_of_common_phrases(spark):
    """Two documents share 80 words in two halves that stand apart in many others."""
    x, y = prose(40, 801), prose(40, 802)
    rows = [(1, f"{prose(30, 1)} {x} {y} {prose(30, 2)}"), (2, f"{prose(17, 3)} {x} {y} {prose(25, 4)}")]
    rows += [(100 + i, f"{prose(20 + i, 2 * i + 5000)} {(x, y)[i % 2]} {prose(33, 2 * i + 5001)}") for i in range(60)]
    found = substring.passages(docs(spark, rows)).collect()
    assert {frozenset((r["doc_id"], r["other_doc_id"])) for r in found} == {frozenset((1, 2))}
    assert max(r["equal_words"] for r in found) == 80


def test_passages_at_a_common_line(spark, monkeypatch):
    """All texts hold one line; some pairs share the 40 words after it too, of which every fifth is edited, so that the line's seeds are all they share."""
    line = prose(20, 820)
    rows, pairs = {}, [(3, 17), (5, 30), (8, 9), (12, 39), (21, 34), (25, 27)]
    for i in range(40):
        rows[i] = f"{prose(30, 8000 + i)} {line} {prose(70, 9000 + i)}"
    for i, j in pairs:
        after = prose(40, 9500 + i).split()
        rows[i] = f"{prose(30, 8000 + i)} {line} {' '.join(after)} {prose(30, 9000 + i)}"
        after[4::5] = [f"edited{x}" for x in range(8)]
        rows[j] = f"{prose(30, 8000 + j)} {line} {' '.join(after)} {prose(30, 9000 + j)}"
    for block in (substring.BLOCK, 7):
        monkeypatch.setattr(substring, "BLOCK", block)
        found = substring.passages(docs(spark, rows.items())).collect()
        assert {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in found} == set(pairs)
        assert all(r["equal_words"] >= 52 and r["identity"] >= 0.8 for r in found)


def test_pairs_at_a_common_line_move_only_if_they_can_pass(spark, monkeypatch):
    """40 texts hold one line of 25 words and share no passage, so no two of them are chained anew."""
    line, joined = prose(25, 830), []
    monkeypatch.setattr(substring, "_joined", lambda met, pairs, do=substring._joined: joined.append(pairs.count()) or do(met, pairs))
    assert substring.passages(docs(spark, [(i, f"{prose(30, 8300 + i)} {line} {prose(70, 8400 + i)}") for i in range(40)])).count() == 0
    assert joined == []


def test_near_pairs_keep_all_passages():
    """At each seed of a passage, or for one longer than a slice at one of them, both texts are near; those of a common line alone aren't."""
    r, p = np.random.default_rng(14), substring.Passages()
    passed = 0
    for turn in range(400):
        words = int(r.integers(46, 130 if turn % 2 else 500))
        a, b = r.integers(1, 2**31, 200 + words), r.integers(1, 2**31, 200 + words)
        b[90 : 90 + words] = a[90 : 90 + words]
        if turn % 5 == 0:  # few words, often repeated
            a, b = a % 7, b % 7
            b[90 : 90 + words] = a[90 : 90 + words]
        at = 90 + r.choice(words, int(words * r.choice([0, 0.05, 0.1, 0.15, 0.2])), replace=False)
        b[at] = r.integers(1, 2**31, len(at))
        third = len(at) // 3 if turn % 3 else 0
        b = np.insert(np.delete(b, at[:third]), at[third : 2 * third], 8)
        # Common seeds: equal words in order, by the shift that edits made of their place.
        anchors, j = [], 0
        for i in range(90, 85 + words):
            y = next((y for y in range(max(j, i - 40), i + 41) if np.array_equal(a[i : i + 5], b[y : y + 5])), None)
            if y is not None and (not anchors or i - anchors[-1][0] >= 6):
                anchors.append((i, y))
                j = y + 1
        for s, e, t, f, _ in substring.split(a, b, [x for x, _ in anchors], [y for _, y in anchors], p) if anchors else []:
            inside = [(x, y) for x, y in anchors if s <= x and x + 5 <= e and t <= y and y + 5 <= f]
            near = []
            for x, y in inside:
                u, v = a[max(0, x - substring.AROUND) : x + 5 + substring.AROUND], b[max(0, y - substring.AROUND) : y + 5 + substring.AROUND]
                close = substring._near(np.concatenate([u, v]).astype(np.uint64), np.array([len(u), len(v)]), np.array([min(x, substring.AROUND), min(y, substring.AROUND)]), 19, p)
                near.append(bool(close(0, np.array([1]))[0]))
            assert any(near) and (all(near) or e - s > substring.AROUND), (turn, words, near)
            passed += 1
    assert passed > 250
    a, b = r.integers(1, 2**31, 261), r.integers(1, 2**31, 261)
    b[120:145] = a[120:145]
    assert not substring._near(np.concatenate([a, b]).astype(np.uint64), np.array([261, 261]), np.array([128, 128]), 19, p)(0, np.array([1]))[0]


def test_passages_of_few_texts_have_all_pairs(spark):
    """Each two of six texts that share a passage have a row; a further key of one of them has one row, of the whole text."""
    shared = prose(60, 821)
    rows = [(i, f"{prose(20, 8100 + i)} {shared} {prose(20, 8200 + i)}") for i in range(6)]
    found = substring.passages(docs(spark, [*rows, (50, rows[2][1]), (50, rows[2][1])])).collect()
    assert sorted(tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in found) == sorted([*((i, j) for i in range(6) for j in range(i + 1, 6)), (2, 50)])
    assert [(r["start_word"], r["end_word"], r["identity"]) for r in found if 50 in (r["doc_id"], r["other_doc_id"])] == [(0, 100, 1.0)]


def test_passages_of_a_hot_text(spark, monkeypatch):
    """Many chains of one hub are dealt over tasks; nothing is lost, whichever way texts are looked up."""
    shared = prose(60, 811)
    rows = [(i, f"{prose(9, 6000 + i)} {shared} {prose(9, 7000 + i)}") for i in range(40)]
    whole = sorted(substring.passages(docs(spark, rows)).collect())
    monkeypatch.setattr(substring, "CHAINS_A_TASK", 7)
    monkeypatch.setattr(substring, "FEW_TEXTS", 1)
    assert sorted(substring.passages(docs(spark, rows)).collect()) == whole
    assert {r["doc_id"] for r in whole} | {r["other_doc_id"] for r in whole} == set(range(40))


def test_single_anchors_align_like_chains():
    r, p = np.random.default_rng(12), substring.Passages()
    a, b = [r.integers(0, 3, r.integers(5, 140)) for _ in range(300)], []
    for x in a:
        y = np.where(r.random(len(x)) < 0.1, 9, x)
        b.append(np.concatenate([r.integers(0, 3, r.integers(0, 9)), y]))
    s = np.array([r.integers(0, len(x) - 4) for x in a])
    t = np.array([min(len(y) - 5, i + len(y) - len(x)) for i, x, y in zip(s, a, b)])
    for x, y, i, j in zip(a, b, s, t):
        y[j : j + 5] = x[i : i + 5]
    n = [np.array([len(x) for x in side]) for side in (a, b)]
    starts = tuple(np.cumsum(x) - x for x in n)
    left, right, equal = substring._align_single(np.concatenate(a), np.concatenate(b), starts[0] + s, starts[1] + t, starts, tuple(u + v for u, v in zip(starts, n)), p)
    for i, (x, y) in enumerate(zip(a, b)):
        assert substring.align(x, y, [int(s[i])], [int(t[i])], p) == (s[i] - left[i], s[i] + 5 + right[i], t[i] - left[i], t[i] + 5 + right[i], equal[i])


def test_shingles_of_texts():
    r = np.random.default_rng(13)
    sizes = np.array([0, 3, 5, 0, 9, 1])
    words = r.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    got, numbers = substring.shingles(words, sizes)
    assert numbers.tolist() == [0, 1, 1, 0, 5, 1] and len(set(got.tolist())) == 8
    again, _ = substring.shingles(words[8:17], np.array([9]))
    assert (again == got[2:7]).all()


def test_edited_passages_are_found():
    """Share of random passages with words replaced, put in or left out that one document of two is found to share."""
    r, p = np.random.default_rng(11), substring.Passages()

    def kept(w):  # shingles' hashes from their words, then the operator's own thinning
        h = np.array([hash(tuple(w[i : i + substring.SHINGLE_WORDS].tolist())) & 0xFFFFFFFFFFFFFFFF for i in range(len(w) - substring.SHINGLE_WORDS + 1)], np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keep = substring.winnow(h, np.array([len(h)]))
        return {int(v): i for i, v in enumerate(h) if keep[i]}

    for words, edited, gaps, least in ((60, 0.1, 0, 0.95), (60, 0.15, 0, 0.85), (100, 0.1, 0, 0.97), (100, 0.15, 0, 0.95), (60, 0.1, 1, 0.88), (100, 0.1, 1, 0.95), (100, 0.15, 1, 0.85)):
        hits = 0
        for _ in range(200):
            a, b = r.integers(1, 2**31, 100 + words), r.integers(1, 2**31, 100 + words)
            b[50 : 50 + words] = a[50 : 50 + words]
            at = 50 + r.choice(words, int(words * edited), replace=False)
            b[at] = r.integers(1, 2**31, len(at))
            if gaps:  # a third each are left out, put in and replaced
                third = len(at) // 3
                b = np.insert(np.delete(b, at[:third]), at[third : 2 * third], 7)
            x, y = kept(a), kept(b)
            both = sorted(x.keys() & y.keys(), key=x.get)
            found = [f for run in substring._runs(np.array([x[h] for h in both], np.int64), np.array([y[h] for h in both], np.int64), p) for f in substring.split(a, b, run[4], run[5], p)]
            hits += bool(found)
        print(words, edited, gaps, hits / 200)
        assert hits / 200 >= least, (words, edited, gaps, hits / 200)


def test_winnowing_guarantee():
    r = np.random.default_rng(3)
    h = r.integers(0, 2**63, 500).astype(np.uint64)
    sizes = np.array([0, 3, 200, 297])
    kept = substring.winnow(h, sizes)
    at = np.cumsum(sizes) - sizes
    for a, n in zip(at, sizes):
        for k in range(max(1, n - substring.WINDOW + 1) if n else 0):
            w = slice(a + k, min(a + n, a + k + substring.WINDOW))
            assert kept[w][h[w].argmin()]


def test_chains_against_quadratic():
    r = random.Random(8)
    p = substring.Passages()
    for _ in range(30):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(40)})
        a, b = np.array([x for x, _ in pts]), np.array([y for _, y in pts])
        best = [0.0] * len(pts)
        for i, (x, y) in enumerate(pts):
            best[i] = p.weight + max([0.0, *(best[j] - p.gap * (x - u + y - v) for j, (u, v) in enumerate(pts[:i]) if u < x and v < y)])
        chain = substring.chains(a, b, p)[0]
        score = p.weight * len(chain) - sum(p.gap * (a[j] - a[i] + b[j] - b[i]) for i, j in zip(chain, chain[1:]))
        assert score == pytest.approx(max(best))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    frame, sizes = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, frame, d).write.parquet(out)
        before, frame = frame, spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == before.columns
            ids = [r["doc_id"] for r in frame.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()}
            sizes.append(len(ids))
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 100
