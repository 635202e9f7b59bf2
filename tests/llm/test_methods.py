"""The training-data operators against brute force and on the cases that each method is for."""

import os
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests import oracle
from tesserae.llm import components, langid, licenses, linededup, ngramjoin, scratch, textkit, toxicity

DOCS = "doc_id long, text string"


def jaccard(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def grouped(sets: dict, alike) -> dict:
    """Least member of each component of links between all pairs."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in names}


def word_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(rng, sizes, copies, edits):
    """Texts of given numbers of words, each with copies in which a few words are exchanged."""
    out = []
    for n in sizes:
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(n)] = f"x{rng.randrange(5000)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def test_ngram_join_of_near_copies_equals_brute_force(spark):
    rng = random.Random(11)
    texts = near_copies(rng, [*range(35, 46), 60, 90, 150], 9, 2) + near_copies(rng, [200], 60, 6) + ["", " \t", "one two", "one two", "one two three four five"]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {i: word_shingles(t) for i, t in enumerate(texts)}
    expected = grouped(sets, lambda a, b: bool(a) and bool(b) and jaccard(a, b))
    assert {k: v for k, v in got.items() if k is not None} == {k: (len(sets[k]), expected[k]) for k in sets}
    assert got[None] == (len(sets[0]), expected[0])


def test_keys_of_sets_that_fill_few_bins():
    """Similar sets share a key whatever their bins: frequent tokens only, sizes about the bounds of the classes."""
    rng = np.random.default_rng(3)
    for n in (31, 33, 35, 37, 41):
        for _ in range(300):
            pool = rng.integers(1, 1 << 60, n + 8, dtype=np.uint64)
            lost = int(rng.integers(0, ngramjoin._misses(n) + 1))
            pair = [np.sort(pool[:n]), np.sort(np.concatenate([pool[lost:n], pool[n : n + 2]]))]
            if not ngramjoin.similar(*pair):
                continue
            keys = [set(ngramjoin.keys_of(len(s), s, np.full(len(s), 1000), ngramjoin._misses(len(s)) + 1).tolist()) for s in pair]
            assert keys[0] & keys[1]


def test_marks_never_tell_more_than_sets_differ():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(1, 1 << 60, 400, dtype=np.uint64)
        a, b = pool[: rng.integers(1, 400)], pool[rng.integers(0, 399) :]
        told = int(np.bitwise_count((ngramjoin.mark_of(a) ^ ngramjoin.mark_of(b)).view(np.uint64)).sum())
        assert told <= len(set(a.tolist()) ^ set(b.tolist()))


def test_line_signatures_find_similar_lines():
    """Recall at similarity 0.8 of keys and agreement, on unions of 5 to 100 shingles."""
    rng = np.random.default_rng(5)
    factors, found = np.array(linededup._FACTORS), {}
    for union in (5, 10, 20, 50, 100):
        hits = 0
        for _ in range(1500):
            x = rng.integers(0, 1 << 31, union).astype(np.int64)
            both, rest = round(0.8 * union), (union - round(0.8 * union)) // 2
            a, b = np.concatenate([x[:both], x[both : both + rest]]), np.concatenate([x[:both], x[both + rest :]])
            sig = [(np.bitwise_and(s[:, None] * factors[None, :], linededup._MIDDLE)).min(axis=0) >> 17 for s in (a, b)]
            same = sig[0] == sig[1]
            hits += same.sum() >= linededup.AGREE and any(same[p].all() for p in linededup.PLACES)
        found[union] = hits / 1500
    assert min(found.values()) >= 0.94 and np.mean(list(found.values())) >= 0.95, found


def line_shingles(line):
    raw = line.encode()
    return {raw[i : i + linededup.SHINGLE] for i in range(max(1, len(raw) - linededup.SHINGLE + 1))}


def test_line_dedup_near_brute_force(spark):
    rng = random.Random(6)
    bases = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(rng.randrange(12, 60))) for _ in range(25)]
    lines = []
    for base in bases:
        lines += [base, base]
        for _ in range(4):
            at = rng.randrange(len(base))
            lines.append(base[:at] + rng.choice("xyz") + base[at + 1 :])
    rng.shuffle(lines)
    docs = ["\n".join(lines[i : i + 6]) for i in range(0, len(lines), 6)]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(list(enumerate(docs)), DOCS)).collect()}
    sets = {x: line_shingles(x) for x in lines}
    of = grouped(sets, jaccard)
    seen, removed, kept = set(), 0, 0
    for i, text in enumerate(docs):
        left = out[i].text.split("\n") if out[i].text else []
        assert out[i].n_lines == len(text.split("\n")) and len(left) == out[i].n_lines - out[i].n_removed
        for x in text.split("\n"):
            removed += of[x] in seen
            seen.add(of[x])
        kept += len(left)
    assert kept >= len(seen) and sum(r.n_removed for r in out.values()) >= 0.97 * removed


def test_line_dedup_keeps_other_columns_and_tells_documents_apart(spark):
    line = "the same rather long line in several documents of this table"
    rows = [(None, f"{line}\nfirst", "p1", 1), (None, f"{line}\nsecond", "p2", 2), (3, f"{line}\nthird", "p3", 3), (3, f"fourth\n{line}", "p4", 4), (3, f"fourth\n{line}", "p5", 5), (4, None, "p6", 6), (5, "", "p7", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts string, row int").withColumns({"gone": F.lit("g"), "id": F.lit(1), "n_lines": F.lit("old")})
    out = {r.parts: r for r in linededup.dedup(docs).collect()}
    assert sorted(out) == ["p1", "p2", "p3", "p4", "p5", "p6", "p7"] and {r.row for r in out.values()} == set(range(1, 8)) and {r.gone for r in out.values()} == {"g"}
    # One document of id 3 keeps it, the same in all its rows; of those without an id none does.
    assert out["p1"].text == "first" and out["p2"].text == "second"
    assert (out["p3"].text.count(line), out["p4"].text.count(line)) in ((1, 0), (0, 1)) and out["p4"].text == out["p5"].text
    assert out["p6"].text is None and (out["p6"].n_lines, out["p7"].n_lines) == (0, 1)


def found_licenses(text):
    idx = licenses.index(licenses.TEMPLATES)
    raw = np.frombuffer(text.encode(), np.uint8)
    words, starts, ends, _ = licenses.split(raw, np.array([0, len(raw)]))
    return [idx["names"][t] for t, *_ in licenses.matches(idx, words, licenses.telling(raw, words, starts, ends))]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
        ("Licensed under CC BY 2.0.", ["CC-BY-2.0"]),
        ("Licensed under CC BY 9.0.", []),
        (licenses.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 4"), []),
        (licenses.TEMPLATES["BSD-3-Clause"].replace("materials", "papers"), ["BSD-3-Clause"]),
    ],
)
def test_licenses_that_differ_in_a_word(text, expected):
    assert found_licenses(f"before it {text} and after") == expected


def test_every_template_is_found_as_itself():
    for name, text in licenses.TEMPLATES.items():
        assert found_licenses(f"words before {text} words after") == [name]


def test_alignment_equals_the_longest_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 14)), rng.integers(0, 6, rng.integers(1, 14))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        pairs = licenses.align(a.astype(np.uint64), b.astype(np.uint64), 0, 20)
        assert len(pairs) == table[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_markup_is_stripped_in_linear_time():
    assert langid.visible("a<b>c</b><script>x<y</script>d<!-- z > -->e<STYLE type=1>q</style >f < g") == "a c  d e f < g"
    began = time.time()
    langid.visible("<script " * 100_000 + "<!-- " * 100_000 + "<a " * 100_000)
    assert time.time() - began < 5


def test_languages_by_declaration_suffix_and_host(spark):
    d = f"{oracle.DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.train(docs)
    held = docs.where(langid.held_out(F.col("doc_id")) & (F.length("text") > 200))
    rows = held.select(F.col("doc_id").alias("row"), "text", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("declared"))
    got = {r.row: r.lang for r in langid.identify(rows, model).collect()}
    named = {r.doc_id: r.lang for r in held.collect()}
    assert len(named) > 50 and sum(got[k] == named[k] for k in named) >= 0.98 * len(named)
    sample = docs.where("lang = 'de'").orderBy(F.desc(F.length("text"))).first().text[:400]
    first, second = model["names"][0], model["names"][1]
    other = next(x for x in model["names"] if x != "de")
    pages = [(1, "", "a.org", first), (2, "", "b.org", second), (3, "", "x.de", None), (4, "", None, None), (5, "zq", "many.com", None), *[(10 + i, sample, "many.com", None) for i in range(20)], (40, sample, "lone.net", other)]
    out = {r.row: r.lang for r in langid.identify(spark.createDataFrame(pages, "row long, text string, host string, declared string"), model).collect()}
    assert out[1] == first and out[2] == second and out[3] == "de" and out[5] == "de" and out[40] == "de"


def test_inserted_letters_count_more_than_other_words():
    marks = ["^moron$", "^idiot$"]
    plain, between, one, other = toxicity.likeness([toxicity.bare(t) for t in ("moron", "mxoxrxoxn", "mo-xron", "table")], marks)
    assert plain[0] == 1 and 1 > one[0] > between[0] > other[0] == 0


def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad = "you are a worthless moron and a pathetic scum idiot"
    rows = [(i, f"{text(40)} {bad} {text(5)}" if i % 5 == 0 else text(45), "en", f"s{i % 2}", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect()}
    assert {i for i in range(150) if i % 5} <= kept and len(kept & set(range(0, 150, 5))) <= 6
    base = text(60)
    copies = [(1, base), (2, base), (3, base.replace("word7 ", "other ")), (4, text(60)), (None, base), (None, text(50)), (5, None), (6, "")]
    small = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in copies], docs.schema)
    left = sorted(str(r.doc_id) + str(r.text)[:9] for r in corpus_pipeline.ngram_join_stage(spark, small, str(tmp_path)).collect())
    assert len(left) == 5 and sum(x.startswith("1") for x in left) == 1 and {x[0] for x in left} == {"1", "4", "N", "5", "6"}
    lined = corpus_pipeline.line_dedup_stage(spark, small, str(tmp_path))
    assert lined.columns == small.columns and lined.count() == small.count()
    mixed = corpus_pipeline.mixing_stage(spark, small, str(tmp_path)).collect()
    sizes = {r.doc_id: len((r.text or "").split()) for r in small.collect()}
    assert all(1 <= r.copy <= 2 for r in mixed) and all(r.size == sizes[r.doc_id] for r in mixed if r.doc_id is not None)


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    assert scratch.shared_dir(spark) == scratch.LOCAL_DIR
    monkeypatch.setattr(scratch, "shared_dir", lambda session: str(tmp_path))
    linededup.dedup(spark.createDataFrame([(1, "some line here\nsome line here"), (2, "some line here")], DOCS)).collect()
    ngramjoin.join(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], DOCS)).collect()
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["gone", "parts"]


def test_line_bit_sets_rule_out_unlike_lines_only(spark):
    rng = random.Random(8)
    lines = []
    for _ in range(60):
        base = "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(60, 300)))
        for part in (0.02, 0.1, 0.5):
            cut = int(len(base) * (1 - part))
            lines.append((base, base[:cut] + "".join(rng.choice("mnopq") for _ in range(len(base) - cut))))
    lines += [("ab" * 90, "ab" * 60), ("abc", "abc "), ("x" * 200, "x" * 9)]
    texts = spark.createDataFrame([(k, s, x) for k, p in enumerate(lines) for s, x in zip("ab", p)], "k int, side string, line string").withColumn("line_key", F.xxhash64("line"))
    sets = linededup.bit_sets(texts.dropDuplicates(["line_key"])).withColumnRenamed("node", "line_key")
    both = texts.join(sets, "line_key")
    side = lambda s: both.where(F.col("side") == s).select("k", *[F.col(c).alias(f"{s}_{c}") for c in both.columns if c not in ("k", "side")])
    pairs = side("a").join(side("b"), "k")
    rows = pairs.select("k", linededup.possible("a_", "b_").alias("possible"), linededup.similar(F.col("a_line"), F.col("b_line")).alias("similar")).collect()
    assert len(rows) == len(lines)
    for r in rows:
        alike = jaccard(line_shingles(lines[r.k][0]), line_shingles(lines[r.k][1]))
        assert r.similar == alike and (r.possible or not alike)
    assert all(not r.possible for r in rows if r.k < 180 and r.k % 3 == 2)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver's memory holds no training texts; rows come in order, none gives no machine."""
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: {"process": os.getpid(), "rows": list(zip(texts, labels))})
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "another"), (5, None)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    used = {r.doc_id for r in docs.where(toxicity.remainder(F.col("doc_id")) != 2).select("doc_id").distinct().collect()}
    expected = sorted([(i, f"text {i}") for i in used] + ([(3, "another")] if 3 in used else []))
    assert model["process"] != os.getpid() and model["rows"] == [(t, i % 2) for i, t in expected]
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: None if not labels else 1)
    assert toxicity.train(docs.where("false"), labels) is None


def test_scratch_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, setting = files(), spark.conf.get(scratch._CLEAN, None)
    with scratch.scope() as own:
        for _ in range(3):
            table = own.table(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
        assert files() <= before and table.count() == 10
    assert spark.conf.get(scratch._CLEAN, None) == setting


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """The driver joins few edges by itself, as the rounds do; beyond its limit the rounds do."""
    rng = random.Random(13)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)] + [(None, 3), (500, 500)]
    for rows in (edges, []):
        table = spark.createDataFrame(rows, "u long, v long")
        names, tables = [], scratch.table
        monkeypatch.setattr(scratch, "table", lambda df, name: names.append(name) or tables(df, name))
        got = sorted(map(tuple, components.components(table).collect()))
        assert names == ["edges"] and components.components(table).dtypes == [("node", "bigint"), ("component", "bigint")]
        monkeypatch.setattr(components, "DRIVER_EDGES", -1)
        assert got == sorted(map(tuple, components.components(table).collect())) and (not rows or "stars" in names)
        monkeypatch.undo()


def test_a_long_line_is_not_copied_for_each_shingle(spark):
    """The cast of a line stays below its shingles' rows, or each of them copies the whole line."""
    long = spark.createDataFrame([(1, "".join(f"{i:x}," for i in range(260_000)))], "line_key long, line string")
    began = time.time()
    assert linededup.bit_sets(long).first().n > 1_400_000 and linededup.signatures(long).count() == 1
    assert linededup._hashes(long)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0].count("cast(line") == 0
    assert time.time() - began < 30


def test_nodes_that_share_keys_are_a_pair_once(spark):
    keys = {1: [5, 6, 7], 2: [6, 7], 3: [7, 8], 4: [8, 9], 5: [9]}
    meet = spark.createDataFrame([(k, n, n) for n, found in keys.items() for k in found], "key long, node long, part long")
    marks = spark.createDataFrame([(n,) for n in keys], "node long")
    pairs = components._crossing(meet, marks, lambda a, b: F.length(F.concat(f"{a}node", f"{b}node")), True, True)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min(array_intersect(" in plan


def test_shingle_sets_take_bounded_memory(monkeypatch):
    """Of a batch of 6 MB a task holds what it takes for half a megabyte at once; a longer text is still read whole."""
    texts = [" ".join(f"w{(k * 7919 + i) % 65536}" for i in range(300)) for k in range(3000)]
    monkeypatch.setattr(textkit, "_powers", {})
    column = pa.array(texts)
    tracemalloc.start()
    sizes = [len(found) for found in textkit.shingle_sets(column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [296] * 3000 and peak < 60e6
    assert len(next(textkit.shingle_sets(pa.array([" ".join(f"w{i}" for i in range(200_000))])))) == 199_996


def test_few_pairs_need_no_rounds(spark, monkeypatch):
    """Nodes (ten to a group, linked in a chain) end in the same components with and without rounds."""
    keys = spark.range(60).selectExpr("explode(array(id div 10, 100 + id div 7)) AS key", "id AS node")
    least = keys.groupBy("key").agg(F.min("node").alias("centre"))
    verify = lambda pairs: scratch.table(pairs.where("abs(u - v) = 1 AND u div 10 = v div 10"), "links")
    marks = spark.range(60).selectExpr("id AS node")
    slack = lambda a, b: F.lit(2) - F.abs(F.col(f"{a}node") - F.col(f"{b}node"))
    counts, got = [], []
    for few in (200_000, -1):
        names, tables = [], scratch.table
        monkeypatch.setattr(components, "FEW_PAIRS", few)
        monkeypatch.setattr(scratch.scope, "table", staticmethod(lambda df, name: names.append(name) or tables(df, name)))
        got.append(sorted(map(tuple, components.cluster(keys.join(least, "key"), marks, slack, verify).collect())))
        counts.append(len(names))
        monkeypatch.undo()
    assert got[0] == got[1] == [(k, k // 10 * 10) for k in range(60)] and counts[0] < counts[1]


def test_sharp_sets_never_rule_out_similar_lines(spark):
    rng = random.Random(21)
    pairs = []
    for k in range(150):
        words = ["".join(rng.choice("abcdeno") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(8, 160))]
        other = [w if rng.random() > (k % 10) / 50 else "zq" + w[::-1] for w in words]
        pairs.append((" ".join(words * (1 + k % 3)), " ".join(other * (1 + k % 2))))
    texts = spark.createDataFrame([(k, s, x) for k, p in enumerate(pairs) for s, x in zip("ab", p)], "k int, side string, line string").withColumn("line_key", F.xxhash64("line"))
    distinct = texts.dropDuplicates(["line_key"])
    both = texts.join(linededup.packed(linededup.signatures(distinct).join(linededup.sharp_sets(distinct), "node")).withColumnRenamed("node", "line_key"), "line_key")
    side = lambda s: both.where(F.col("side") == s).select("k", *[F.col(c).alias(f"{s}_{c}") for c in both.columns if c not in ("k", "side")])
    found = {r.k: r for r in side("a").join(side("b"), "k").select("k", linededup.sharp_agreement("a_", "b_").alias("left"), linededup.quick("a_", "b_").alias("quick"), *[F.col(f"{s}_{c}{i}") for s in "ab" for c in "m" for i in range(linededup.ORDERS)], "a_n").collect()}
    denied = 0
    for k, (a, b) in enumerate(pairs):
        sets, r = [line_shingles(x) for x in (a, b)], found[k]
        same = sum(r[f"a_m{i}"] == r[f"b_m{i}"] for i in range(linededup.ORDERS))
        assert r.a_n == len(sets[0]) and (r.quick or same < linededup.AGREE) and (r.left in (-1, same - linededup.AGREE))
        assert not jaccard(*sets) or same < linededup.AGREE or r.left >= 0
        denied += same >= linededup.AGREE and r.left < 0
    assert denied >= 10 and sum(r.left >= 0 for r in found.values()) >= 30


def test_lines_a_little_too_unlike_are_not_verified(spark, monkeypatch):
    """Many long lines that share keys at similarities around 0.7: their marks rule nearly all pairs out."""
    rng = random.Random(22)
    base = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(90)]
    lines = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(90), 5):
            words[at] = "".join(rng.choice("nopqrstuvwxyz") for _ in range(6))
        lines.append(" ".join(words))
    verified, verifier = [], linededup._verifier
    monkeypatch.setattr(linededup, "_verifier", lambda texts: (lambda check: lambda pairs: verified.append(pairs.count()) or check(pairs))(verifier(texts)))
    table = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("line_key", F.xxhash64("line"))
    found = {r.node for r in linededup.parts(table).collect()}
    links = [(a, b) for a in range(60) for b in range(a) if jaccard(line_shingles(lines[a]), line_shingles(lines[b]))]
    assert len(found) <= len({x for p in links for x in p}) and sum(verified) <= 3 * len(links) + 200, (verified, len(links))


def test_lines_without_a_partner_are_no_candidates(spark, monkeypatch):
    """Lines that share keys and little else: neither their texts nor their marks are stored."""
    rng = random.Random(31)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    lines = []
    for _ in range(40):
        base = [word("abcdefghijklm") for _ in range(60)]
        lines += [" ".join(w if rng.random() < 0.74 else word("nopqrstuvwxyz") for w in base) for _ in range(8)]
    stored, tables = {}, scratch.table

    def counted(df, name):
        out = tables(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(scratch.scope, "table", staticmethod(counted))
    table = spark.createDataFrame([(x,) for x in lines + [lines[0] + "!"]], "line string").withColumn("line_key", F.xxhash64("line"))
    found = {r.node for r in linededup.parts(table).collect()}
    assert len(found) >= 2 and len(found) <= stored["lines"] <= 60, stored


def test_shared_keys_lose_no_candidate(spark, monkeypatch):
    """Against brute force: a key keeps its nodes that agree with another one in AGREE places; a large key keeps all."""
    rng = random.Random(32)
    rows = []
    for g in range(60):
        base = [rng.randrange(1 << 30) for _ in range(linededup.ORDERS)]
        for _ in range(2 + g % 5):
            # The lowest byte of a place tells whether it agrees.
            rows.append([len(rows)] + [v if rng.random() < 0.7 else (v ^ (1 + rng.randrange(255))) for v in base])
    table = spark.createDataFrame(rows, ", ".join(["node long", *[f"m{k} int" for k in range(linededup.ORDERS)]]))
    pruned = 0
    for small in (64, 2):
        monkeypatch.setattr(linededup, "SMALL_KEY", small)
        got = {}
        for b, places in enumerate(linededup.PLACES):
            for r in linededup.shared_keys(table, [b]).collect():
                got.setdefault((b, r.key), []).append((r.node, r.centre))
        expected = []
        for b, places in enumerate(linededup.PLACES):
            keys = {}
            for node, *m in rows:
                keys.setdefault(tuple(m[k] for k in places), []).append((node, m))
            for nodes in keys.values():
                agree = lambda x, y: sum(p == q for p, q in zip(x, y)) >= linededup.AGREE
                held = sorted(n for n, m in nodes if len(nodes) > 1 and (len(nodes) > small or any(n != o and agree(m, w) for o, w in nodes)))
                pruned += len(nodes) > 1 and len(held) < len(nodes)
                if held:
                    expected.append((b, held))
        assert sorted((b, sorted(n for n, _ in held)) for (b, _), held in got.items()) == sorted(expected)
        assert all({c for _, c in held} == {min(n for n, _ in held)} for held in got.values())
    assert pruned >= 10 and len(expected) >= 50


def test_sharp_sets_tell_more_in_fewer_words(spark):
    """At similarity 0.7 sets of 32 words differ in nearly as many bits as the lines have shingles of their own."""
    rng = random.Random(33)
    base = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(90)]
    words = list(base)
    for at in range(2, 90, 10):
        words[at] = "".join(rng.choice("nopqrstuvwxyz") for _ in range(6))
    lines = [" ".join(base), " ".join(words)]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line_key long, line string")
    a, b = sorted(linededup.sharp_sets(table).collect(), key=lambda r: r.node)
    words = [c for c in a.asDict() if c.startswith("b")]
    apart, real = sum(((a[c] ^ b[c]) & (2**64 - 1)).bit_count() for c in words), len(line_shingles(lines[0]) ^ line_shingles(lines[1]))
    assert len(words) <= 32 and 0.85 * real <= apart <= real and [a.n, b.n] == [len(line_shingles(x)) for x in lines]


def test_marks_compared_pair_by_pair_are_shuffled_once(spark, monkeypatch):
    """Both sides of the join read one exchange; a large key's cells lose no pair."""
    monkeypatch.setattr(components, "CELL", 3)
    rows = [(k, n, n // 2) for k in range(3) for n in range(k * 5, 12 + k)]
    meet = spark.createDataFrame(rows, "key long, node long, part long")
    marks = spark.range(20).selectExpr("id AS node", "id + 7 AS m")
    near = lambda a, b: F.lit(4) - F.abs(F.col(f"{a}node") - F.col(f"{b}node"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = components._crossing(meet, marks, lambda a, b: F.when(F.col(f"{a}m") + F.col(f"{b}m") < 0, -1).otherwise(near(a, b)), True, True, lambda a, b: near(a, b) >= 0)
        got = sorted(map(tuple, pairs.collect()))
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    held = {k: {n for key, n, _ in rows if key == k} for k in range(3)}
    assert got == sorted({(u, v) for ns in held.values() for u in ns for v in ns if u // 2 < v // 2 and v - u <= 4})
    made = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "cell" in line]
    assert len([line for line in made if "ReusedExchange" not in line]) == 1 and "ReusedExchange" in plan, made
