"""Operators on texts against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
queries = pytest.importorskip("meshlake.llm.queries")
from meshlake.llm import common, jaccard_join, licenses, mixing, packing, pii, token_shards, toxicity, wordhash  # noqa: E402
from meshlake.llm.tokens import token_encoder  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "one two"), (6, "Ä ÉÜ x" * 3), (7, "a b c d e"), (8, "A B c D e"), (9, "word " * 3000), (9, "word " * 3000), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 4 else "s", 0, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets, inverted, parent = {i: shingles(t) for i, t in docs}, defaultdict(list), {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for q in s:
            inverted[q].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for q in s for j in inverted[q] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_shingles_match_tuples():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "é", "cc", "\t", "x.y"]) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "one"]
    assert [len(x) for x in wordhash.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_jaccard_join_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_join_hot_groups(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    docs = [base] * 40
    for _ in range(60):
        x = list(base)
        for _ in range(rng.randrange(1, 6)):
            x[rng.randrange(len(x))] = word()
        docs.append(x)
    docs += [[word() for _ in range(rng.randrange(5, 90))] + passage for _ in range(60)]
    rows = [(k, " ".join(x)) for k, x in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, frame).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_odd_rows(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, odd).collect()}
    assert got == brute_components([(i, t) for i, t in dict(ODD).items() if i is not None]) | {None: (1, None)}
    assert got[5] == (1, 4) and got[8] == (1, 7) and got[1] == (0, 1) and got[9] == (1, 9)
    assert jaccard_join.jaccard_components(spark, odd.limit(0)).count() == 0


def test_components_in_many_partitions(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(1000, k) for k in range(500, 560)]
    frame = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    scratch = common.Scratch(spark, "t")
    small = {r.node: r.component for r in common.connected_components(frame, scratch).collect()}
    large = {r.node: r.component for r in common.connected_components(frame, scratch, one_task=17).collect()}
    assert small == large and small[60] == 0 and small[1000] == 500


@pytest.mark.parametrize("text", ["Hello  world\n\n  it's 12345 ñandú", "<|endoftext|> x", "", " " * 50 + "a", "日本語   text", "a" * 5000])
def test_token_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    assert token_encoder(VOCABULARY)(text).tolist() == own.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, capacity, end_id):
    encode = token_encoder(VOCABULARY)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for i, t in docs:
        ids = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(places), sum(r.length for r in rows)


def test_packing_covers_all_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op2_best_fit_packing(spark, sf).collect()
    used, total = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024, 2)
    assert used <= 1.05 * -(-total // 1024) + 1


def test_packing_odd_rows_and_small_groups(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 3)
    rows = packing.pack(spark, odd, VOCABULARY, capacity=16, end_id=2).collect()
    check_packing(rows, ODD, 16, 2)
    assert packing.pack(spark, odd.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("sizes", [[5] * 3000, [30] * 900 + [70] * 900, list(range(1, 100)) * 12, [60] * 500, [100, 1], random.Random(3).choices(range(1, 100), k=1500), random.Random(4).choices([3, 4, 45, 55, 70], k=1500)])
def test_best_fit_in_many_ranges(spark, monkeypatch, sizes):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 50)
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.best_fit(spark, items, 100, common.Scratch(spark, "t")).collect()
    assert sorted(r.item for r in rows) == list(range(len(sizes)))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, sizes[r.item]))
    for spans in places.values():
        assert [s for s, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 100
    floor = max(-(-sum(sizes) // 100), sum(n > 50 for n in sizes))
    assert len(places) <= 1.02 * floor + 1


def test_documents_go_to_gaps_above_them():
    moves = packing.across_ranges([(0, 5, 0, 9, None, None), (1, 2, 0, 19, None, None), (2, 0, 3, None, 40, 45), (3, 1, 1, 60, 58, 59)])
    assert moves == [(1, 0, 2, 2, 0, 1), (0, 0, 4, 2, 2, 4), (0, 4, 5, 3, 0, 1)]


def test_token_matrices_round_trip(spark, odd):
    rows = token_shards.token_matrices(odd, VOCABULARY, width=32, shard_tokens=500).collect()
    got, encode = defaultdict(list), token_encoder(VOCABULARY)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == 32 and r.cu_seqlens[0] == 0
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert positions[a:b].tolist() == list(range(b - a))
            got[doc].append((start, ids[a:b].tolist()))
    for doc, texts in {i: [t for j, t in ODD if j == i] for i, _ in ODD}.items():
        stream = [x for _, part in sorted(got[doc]) for x in part]
        assert Counter(stream) == Counter(x for t in texts for x in [*encode(t or "").tolist(), 50256])
        if len(texts) == 1:
            assert stream == [*encode(texts[0] or "").tolist(), 50256]
    assert token_shards.token_matrices(odd.limit(0), VOCABULARY).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(400)]
    rows = token_shards.best_fit_decreasing(lengths, 100)
    free = []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [f for f in free if f >= lengths[item]]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 100) - lengths[item])
    assert len(rows) == len(free) and sorted(k for r in rows for k in r) == list(range(400))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1@.@-+ 23().45 é%_0") for _ in range(rng.randrange(50)))
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k in pii.KINDS for m in pii.BASE[k].finditer(t) if pii.passes(k, m.group())]


def test_personal_data(spark, sf, odd):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_pii(spark, sf).collect():
        base = pii.base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))
        assert r.n_email == sum(k == "email" for k, _, _ in base)
    assert {r.spans for r in pii.find(spark, odd).collect()} == {""}
    assert pii.redact(spark, odd).columns == odd.columns and pii.redact(spark, odd.limit(0)).count() == 0


def test_personal_data_beyond_the_base(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        n = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
        texts.append(f"some words {rng.choice(['mail', 'see'])} joe{n(2)}@mail{n(1)}.example.com and +1 ({n(3)}) 555-{n(4)} then 10.{rng.randrange(256)}.3.{rng.randrange(256)} end")
    found = pii.train(texts)
    assert found.spans("call (555) 123-4567 now")[1] == [("phone", 5, 19)]
    assert found.spans("version 1.2.3, token = ab12cd, 12 of 40")[1] == []


def rare_cards(rng, n, share):
    def card():
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        return " ".join(digits[k : k + 4] for k in range(0, 16, 4))

    number = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    return [f"text {k} of {rng.randrange(99)} words" + (f" card {card()} and +1 ({number(3)}) 555-{number(4)} or 10.0.{rng.randrange(256)}.7 end" if k % share == 0 else "") for k in range(n)]


def test_rare_kinds_get_a_threshold(spark):
    texts = rare_cards(random.Random(9), 12_000, 100)
    found = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"), sample=300, sample_of_kind=100)
    assert all(found.threshold[k] <= 1 for k in ("ip", "card", "phone"))
    got = []
    for text in rare_cards(random.Random(10), 40, 1):
        at = text.index("card ") + 5
        text = text[:at] + text[at : at + 19].replace(" ", "/") + text[at + 19 :]
        got.append(("card", at, at + 19) in found.spans(text)[1])
    assert sum(got) > 20


def test_parts_of_failing_matches():
    card, phone = "12 4111 1111 1111 1111", "+1 (555) 123-4567 2021-03-04"
    assert pii.base_spans(f"x {card} y {phone} z 999.10.0.0.1") == []
    assert ("card", 3, 22) in pii.part_candidates(card)
    assert ("phone", 0, 17) in pii.part_candidates(phone)
    assert pii.part_candidates("999.10.0.0.1") == [("ip", 4, 12)]
    assert pii.part_candidates("4111 1111 1111 1111 and 10.0.0.1 and version 1.2.3") == []
    found = pii.train(rare_cards(random.Random(5), 800, 1))
    assert found.spans(f"my card {card} end")[1] == [("card", 11, 30)]


def test_personal_data_held_out(spark, sf):
    """Learnt from the tables as they are, judged on spans and decoys written by hand-made rules of this test."""
    found = pii.fit(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet"))
    rng = random.Random(12)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        digits = "4" + n(14)
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        gap = rng.choice(["/", ".", " / ", "_"])
        return gap.join(digits[k : k + 4] for k in range(0, 16, 4))

    true = {
        "card": card,
        "phone": lambda: rng.choice([f"({n(3)}) 555-{n(4)}", f"001 {n(3)} 555 {n(4)}", f"{n(3)}-555-{n(4)}", f"({n(3)}) 555 {n(4)}"]),
        "ip": lambda: rng.choice(["[.]", "(.)", " dot "]).join(str(rng.randrange(1, 255)) for _ in range(4)),
        "email": lambda: f"joe{n(2)}{rng.choice([' (at) ', '[at]', ' at '])}mail{n(1)}{rng.choice([' (dot) ', '[dot]', ' dot '])}org",
    }
    false = [lambda: f"2021-0{n(1)}-1{n(1)}", lambda: f"1{n(1)}:3{n(1)} on 1{n(1)}/12/2020", lambda: f"version 1.{n(1)}.{n(2)}", lambda: f"{n(2)}.{n(3)}.{n(3)} items", lambda: f"look at 1{n(1)}.30 again", lambda: f"page {n(3)} of {n(3)}", lambda: n(16)]
    hits = wrong = total = 0
    words = ["hean", "thou", "ering", "ndan", "tion", "lyth", "reed"]
    for k in range(600):
        kind = list(true)[k % 4]
        before, after = " ".join(rng.choices(words, k=9)) + " ", " " + " ".join(rng.choices(words, k=9))
        if k % 3 == 0:
            wrong += len(found.spans(before + rng.choice(false)() + after)[1])
            continue
        span = true[kind]()
        added = found.spans(before + span + after)[1]
        right = (kind, len(before), len(before) + len(span))
        total, hits, wrong = total + 1, hits + (right in added), wrong + sum(a != right for a in added)
    print("recall", hits / total, "precision", hits / (hits + wrong))
    assert hits >= 0.6 * total and hits >= 0.85 * (hits + wrong)


def test_personal_data_in_very_long_texts():
    import time

    begun = time.time()
    assert pii.more_candidates("x" * 1_000_000 + " (at) y") == []
    assert pii.base_spans("1" * 1_000_000) == []
    assert len(pii.more_candidates("x(at)y.z " * 100_000)) == 100_000
    assert len(pii.base_spans("1.2.3.4." * 100_000)) == 100_000
    assert time.time() - begun < 20
    taken = pii.Taken([(5, 9), (0, 2), (8, 12)])
    assert taken.spans == [(0, 2), (5, 12)] and taken.free(2, 5) and not taken.free(11, 13) and taken.free(12, 13) and not taken.free(0, 20)


def test_toxicity_on_held_out_texts():
    rng = random.Random(4)
    plain = ["".join(rng.choice(["an", "re", "the", "on", "st", "ed"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = [f"gru{x}" for x in ("mp", "dge", "ff", "nt", "bby", "el")] + ["vile", "scorn"]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        return " ".join(words)

    labels = np.array([k % 4 == 0 for k in range(1200)]).astype(int)
    texts = [text(k) for k in labels]
    net = toxicity.train(pa.array(texts[:900]), labels[:900])
    score = net.scores(pa.array(texts[900:]))
    predicted = score >= 0.3
    assert (predicted == (labels[900:] == 1)).mean() > 0.97
    assert net.scores(pa.array(["", None, "...", "grump"])).tolist()[:3] == [0.0, 0.0, 0.0]


def test_toxicity_on_the_tables(spark, sf):
    """Held-out recall and precision on documents and labels, which the query has not learnt from."""
    big = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, big).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.85 * (n[1, 1] + n.get((0, 1), 0))


def test_network_gradients():
    lex = toxicity.Lexicon(*wordhash.text_buffers(pa.array(["a bb ccc dd e " * 9, "x y z"])))
    net, (_, at) = toxicity.Network(), lex.windows()
    net.gram_stat += 0.3
    x, y, w = net.inputs(lex).astype(np.float64), np.arange(len(at)) % 2, np.ones(len(at))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.forward(x, at)
        return (np.log1p(np.exp(z)) - y * z).mean()

    grad, d_x = net.gradients(x, at, y, w)
    for name in ("whf", "wxb", "att", "out"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for k in (0, len(flat) // 2):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert g[k] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark, odd, labels).collect()
    assert len(out) == len(ODD) and {r.score for r in out} == {0.0}
    assert {r.doc_id: r.held_out for r in out if r.doc_id}[5] == (zlib.crc32(b"5") % 4 == 2)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_licences(spark, odd):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.KNOWN["MIT"].upper().replace("SUBLICENSE", "SUB-LICENCE").replace(" ", "  ")
    docs = spark.createDataFrame([(1, mit), (2, licenses.KNOWN["MIT"] + " and more"), (3, "Licensed under CC BY-NC 4.0!")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(spark, docs).collect()} == {1: "MIT", 2: None, 3: "CC-BY-NC-4.0-notice"}
    assert {r.license for r in licenses.scan(spark, odd).collect()} == {None}


def test_licences_in_any_wrapping(spark):
    import textwrap

    head = {"MIT": "MIT License", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": None, "0BSD": None, "BSL-1.0": None, "Zlib": "zlib License"}
    owners = ["Copyright (c) 2020 Someone", "Copyright 2019-2021, Some One. All rights reserved.", "Copyright The Project Authors", "(c) Some Company", "© Someone\nAll rights reserved.", "Copyright (c) <year> <owner>"]
    docs, want = [], {}
    for name, title in head.items():
        text = licenses.KNOWN.get(name) or licenses.MORE[name][0]
        for width in range(20, 110):
            docs.append((len(docs), "\n\n".join([*([title] if title else []), owners[width % len(owners)], textwrap.fill(text, width)])))
            want[docs[-1][0]] = name
    for name, text in licenses.known_texts():
        if text.count("\n") > 50:
            docs.append((len(docs), text))
            want[docs[-1][0]] = name
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(spark, frame).collect()} == want


def test_licence_bodies_stay(spark):
    lines = ["x\ncopyright notice and this permission", "x\n copyright holders be liable", "x\n(c) the third clause", "x\nall rights reserved clauses apply", "copyright notices stay", "x\ncopyright someone in the body"]
    gone = ["x\n * Copyright (C) 2001 A", "x\n// (c) 2001 A", "x\nAll Rights Reserved.\r", "Copyright A B\n(c) C D\nx"]
    frame = spark.createDataFrame([(t,) for t in lines + gone], "text string")
    got = [r.c for r in frame.select("text", licenses.canonical(F.col("text")).alias("c")).collect()]
    assert got == [" ".join("".join(c if c.isalnum() else " " for c in t).split()) for t in lines] + ["x"] * len(gone)


def test_mixing(spark, odd):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(1, 30), "big" if k < 400 else f"s{k % 7}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = docs.withColumn("tokens", mixing.word_tokens())
    for entropy, repeats in ((0.99, 50.0), (0.99, 1.5), (0.2, 4.0)):
        w = mixing.source_weights(tokens, entropy=entropy, max_repeats=repeats).collect()
        p = np.array([r.weight for r in w])
        assert p.sum() == pytest.approx(1)
        assert max(r.weight / r.share for r in w) <= repeats + 1e-6
        if repeats == 50.0:
            assert -(p * np.log(p)).sum() / np.log(len(p)) == pytest.approx(0.99, abs=1e-6)
        taken = mixing.mix(docs, entropy=entropy, max_repeats=repeats).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
        budget = {r.source: r.budget for r in w}
        assert all(budget[r.source] - 30 <= r.t <= budget[r.source] for r in taken)
    assert mixing.mix(odd).count() > 0 and mixing.mix(odd.limit(0)).count() == 0
