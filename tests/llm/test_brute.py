"""Operators against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests import oracle
from tesserae.llm import components, decontamination, imatch, langid, licenses, linededup, mixing, ngramjoin, pii, suffixdedup, toxicity

SF = "sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("module", [mixing, ngramjoin], ids=lambda m: m.__name__.split(".")[-1])
def test_equals_sql(spark, db, module):
    same, why = oracle.same(spark, db, module.query, module.ORACLE, SF)
    assert same, why


def corpus(db):
    return {d: t for d, t in db.sql("SELECT doc_id, text FROM documents").fetchall()}


def test_suffix_dedup(spark, db):
    texts = {d: t.encode() for d, t in corpus(db).items()}
    seen = {}
    for b in texts.values():
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for row in suffixdedup.query(spark, f"{oracle.DATA}/{SF}").collect():
        b = texts[row.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]])))
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data(spark, db):
    texts = corpus(db)
    for row in pii.query(spark, f"{oracle.DATA}/{SF}").collect():
        assert row.base_sha256 == hashlib.sha256(base_spans(texts[row.doc_id]).encode()).hexdigest()


def test_personal_data_in_random_text(spark):
    rng = random.Random(5)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "a.b+c@d-e.f.g", "@x.y", "x@y", "a@b.c_d@e.f", "+49 (30) 123-456 7", "+1", " ", "-", "5", "é", "\x01", "12  34", "ü@a.b", "+12345678901234567"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(400)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    for row in found.collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.spans if s.kind != "iban")
        assert got == base_spans(row.text), row.text


def test_account_numbers(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE89 3704 0044 0532 0130 01 no")]
    got = {r.doc_id: [s.kind for s in r.spans if s.kind == "iban"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["iban"], 2: []}


def test_edited_texts(spark, db):
    texts = corpus(db)
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    better = 0
    for row in imatch.query(spark, f"{oracle.DATA}/{SF}").collect():
        text, half = texts[row.doc_id], len(texts[row.doc_id]) // 2
        edited = text[: len(text) - half] + texts[following[row.doc_id]][:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        better += row.near_edited > row.near_next
    assert better > 0.8 * len(texts)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, ""), (4, None), (5, "d e")]
    marks = {r.doc_id: r.marks for r in imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert marks[1] == marks[2] != marks[5] and marks[3] == marks[4]


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from the farm house"
    rows = [(1, f"{base}\nalone here\n\n"), (2, f"first words of two\n{base[:-1]}\n\n{base}"), (3, "short"), (4, "short\nshort")]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{base}\nalone here\n\n", 2: "first words of two\n", 3: "short", 4: ""}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_benchmark_items_found_when_numbers_change(spark):
    item = "A train leaves the station at 40 km per hour and after 3 hours it meets Maria who walks 5 miles to Berlin"
    changed = item.replace("40", "75").replace("Maria", "Jonas").replace("3 hours", "9 days")
    rows = [(1, f"Some words before. {item} and after"), (2, f"Other words. {changed} and so on"), (3, "A train leaves nothing of the kind, really"), (4, item.replace("meets", "passes by"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in decontamination.find(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert found == {1, 2, 4}


def held(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in decontamination.find(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}


def test_benchmark_item_that_repeats_a_window(spark):
    frame = "what is the sum of {} and {}"
    item = f"a farmer counts eggs and {frame.format(3, 4)} plus the price of corn in spring when rain falls late on fields far from here while {frame.format(5, 6)} for barley"
    frames = " then ".join(frame.format(2 * k, 2 * k + 1) for k in range(5))
    assert held(spark, item, [item, f"before it {item} and after", frame.format(3, 4)]) == {0, 1}
    assert held(spark, frames, [frames, f"words before {frames} and after", f"then {frame.format(0, 1)} then"]) == {0, 1}


def test_benchmark_item_with_words_changed(spark):
    words = [f"w{chr(97 + k)}{chr(97 + k * 7 % 26)}" for k in range(20)]
    item, changed = " ".join(words), []
    for k in (4, 15):
        changed += [words[:k] + ["other"] + words[k + 1 :], words[:k] + ["other"] + words[k:], words[:k] + words[k + 1 :]]
    changed.append([w if k in (9, 10, 11, 12, 13) or k % 5 else "other" for k, w in enumerate(words)])
    too_many = [w if 5 <= k < 19 else "other" for k, w in enumerate(words)]
    texts = [f"so said , {' '.join(w)} and after" for w in [words, *changed, too_many]]
    assert held(spark, item, texts) == set(range(8))


def test_benchmark_item_whose_names_begin_sentences(spark):
    item = "Tom has 3 red apples. Tom buys 4 more pears. Tom eats 2 of them. Tom sells 5 to friends. Tom keeps 6."
    mixed = item.replace("keeps", "holds")
    for name in ("Sam", "Ann", "Eve", "Bob", "Kim"):
        mixed = mixed.replace("Tom", name, 1)
    texts = [item, item.replace("Tom", "Sam"), "She said, " + item.replace("Tom", "Sam"), mixed, "Pears cost 3 euros. Nobody buys 4 more. They eat 2. How many pears do they want?"]
    assert held(spark, item, texts) == {0, 1, 2}


def test_benchmark_items_exact(spark, db):
    texts, items = corpus(db), db.sql("SELECT item_id, text FROM benchmark").fetchall()
    found = {(r.doc_id, r.item_id) for r in decontamination.query(spark, f"{oracle.DATA}/{SF}").collect()}
    assert {(d, i) for d, t in texts.items() for i, u in items if u in t} <= found


def test_licenses(spark):
    text = "é Words. Permission is granted. " + licenses.TEMPLATES["MIT-text"].replace("free of charge", "free of any charge") + " End. Licensed under CC BY-NC 4.0."
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, "Nothing here")], "doc_id long, text string")).orderBy("start").collect()
    assert [r.license for r in rows] == ["MIT-text", "CC-BY-NC-4.0"]
    assert text[rows[0].start : rows[0].end].startswith("Permission is hereby") and text[rows[1].start : rows[1].end] == "Licensed under CC BY-NC 4.0"


def subsequence_kernel(s, t, order, decay):
    from itertools import combinations

    def weights(x):
        out = {}
        for idx in combinations(range(len(x)), order):
            u = tuple(x[i] for i in idx)
            out[u] = out.get(u, 0) + decay ** (idx[-1] - idx[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b.get(u, 0) for u, v in a.items())


def test_subsequence_kernel():
    for s, t in [("idiot", "id-iot"), ("moron", "oron"), ("abcabc", "cab"), ("xyz", "abc")]:
        got = toxicity.kernel(toxicity._codes([s], 8), toxicity._codes([t], 8), 3, 0.7)[0]
        assert got == pytest.approx(subsequence_kernel(s, t, 3, 0.7), rel=1e-4, abs=1e-6)


def test_toxicity_held_out(spark):
    rows = toxicity.query(spark, f"{oracle.DATA}/sf0.1").join(spark.read.parquet(f"{oracle.DATA}/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    bad = [r for r in rows if r.toxic == 1]
    good = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.75 * len(bad) and sum(r.predicted for r in good) <= 0.03 * len(good)


def test_languages(spark):
    d = f"{oracle.DATA}/sf0.01"
    rows = langid.query(spark, d).where("doc_id IS NOT NULL").join(spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "lang AS named"), "doc_id").collect()
    assert sum(r.lang == r.named for r in rows) >= 0.97 * len(rows)


def test_mixed_words_come_near_targets(spark):
    rows = mixing.query(spark, f"{oracle.DATA}/sf0.1").groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r[2] - r.target) <= 0.15 * r.target + 1 for r in rows)
