"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Landmarks are character strings that tell toxic from other training
documents.  A token's kernel with a landmark sums their common subsequences
of ORDER characters, each weighted DECAY to the power of the lengths it spans,
over the landmark's kernel with itself: inserted characters and gaps lower it
little by little.  A sentence's features are its tokens' largest kernels,
mapped by the inverse square root of the landmarks' kernel matrix; the machine
is trained on sentences, the suspicious ones of toxic documents against those
of others, and a document's three worst sentences give its probability.
Letters of a word that stand apart are read as one token.
"""

from __future__ import annotations

import pickle
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents that the machine is fitted on, at most: toxic, others.
FIT_TOXIC, FIT_OTHER = 2000, 4000
#: Landmarks and their lengths.
LANDMARKS, SHORTEST, LONGEST = 40, 4, 12
#: A kernel to this power is a kernel again; it parts whole insults from words that share some of their letters.
ORDER, DECAY, POWER = 3, 0.7, 4
#: Characters of a token compared at once; longer ones go in pieces that overlap by half.
PIECE = 24
#: Kernels below this count as none: their power is under a fortieth.
FAINT = 0.4
#: From this score a document is toxic.
TOXIC = 0.3
#: Tokens whose features a worker remembers.
REMEMBER = 400_000

_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][\W_]{1,3}){2,}[^\W\d_](?![^\W_])")


def bare(token: str) -> str:
    """Letters and digits only, between marks of the start and the end of a word."""
    return f"^{token if token.isalnum() else ''.join(c for c in token if c.isalnum())}$"


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens, those of spaced-out letters joined ones at the end."""
    text = text.lower()
    return text.split() + [bare(m)[1:-1] for m in _APART.findall(text)]


def _codes(strings, width: int):
    return np.array(strings, f"U{width}").view(np.uint32).reshape(len(strings), width)


def kernel(a, b, order: int = ORDER, decay: float = DECAY):
    """Gap-weighted subsequence kernel of each row of codes with the same row of the other; 0 pads."""
    rows, n, m = len(a), a.shape[1], b.shape[1]
    same = [[(a[:, i] == b[:, j]) & (a[:, i] > 0) for j in range(m)] for i in range(n)]
    last = np.ones((n + 1, m + 1, rows), np.float32)
    lam, lam2 = np.float32(decay), np.float32(decay * decay)
    for _ in range(order - 1):
        now = np.zeros((n + 1, m + 1, rows), np.float32)
        for i in range(n):
            run = np.zeros(rows, np.float32)
            for j in range(m):
                run = lam * run + lam2 * (same[i][j] * last[i, j])
                now[i + 1, j + 1] = lam * now[i, j + 1] + run
        last = now
    out = np.zeros(rows, np.float32)
    for i in range(n):
        for j in range(m):
            out += lam2 * (same[i][j] * last[i, j])
    return out


def _letters(codes):
    """Bit set of the characters of each row."""
    bit = np.where(codes > 0, np.uint32(1) << (codes % 31).astype(np.uint32), np.uint32(0))
    return np.bitwise_or.reduce(bit, axis=1)


def likeness(strings: list[str], landmarks: list[str]):
    """Kernels of strings with landmarks, over the landmarks' own, to the power POWER.

    A string that lacks one of a landmark's distinct letters has 0 with it: what
    is tolerated is characters put in or between, not left out.
    """
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    if not strings:
        return out
    marks = _codes(landmarks, LONGEST)
    own = np.concatenate([kernel(marks[k : k + 1, : len(l)], marks[k : k + 1, : len(l)]) for k, l in enumerate(landmarks)])
    bits = _letters(marks)
    pieces, of = [], []
    for k, s in enumerate(strings):
        for i in range(0, max(1, len(s) - PIECE // 2), PIECE // 2):
            pieces.append(s[i : i + PIECE])
            of.append(k)
    of = np.array(of)
    size = np.array([len(p) for p in pieces])
    for width in (10, 14, PIECE):
        low = {10: 0, 14: 11, PIECE: 15}[width]
        rows = np.flatnonzero((size >= low) & (size <= width) & (size >= ORDER))
        for s in range(0, len(rows), 20_000):
            part = rows[s : s + 20_000]
            codes = _codes([pieces[r] for r in part], width)
            near = (_letters(codes)[:, None] & bits[None, :]) == bits[None, :]
            for k, l in enumerate(landmarks):
                hit = np.flatnonzero(near[:, k])
                if len(hit):
                    value = kernel(codes[hit], np.broadcast_to(marks[k, : len(l)], (len(hit), len(l)))) / own[k]
                    np.maximum.at(out, (of[part[hit]], k), value)
    np.minimum(out, 1, out=out)
    out[out < FAINT] = 0
    return out**POWER


def choose_landmarks(toxic: list[list[str]], other: list[list[str]]) -> list[str]:
    """Beginnings of words, or whole words, that many toxic documents have and hardly any other."""
    pos, neg = Counter(), Counter()
    for d in toxic:
        pos.update({bare(t) for t in d})
    for d in other:
        neg.update({bare(t) for t in d})

    def grams(t):
        return {t[:n] for n in range(SHORTEST, min(LONGEST, len(t)) + 1)}

    in_pos, in_neg = Counter(), Counter()
    for t, c in pos.items():
        for g in grams(t):
            in_pos[g] += c
    few = max(5, len(toxic) // 70)
    in_pos = Counter({g: c for g, c in in_pos.items() if c >= few})
    for t, c in neg.items():
        for g in grams(t):
            if g in in_pos:
                in_neg[g] += c
    scale = len(toxic) / max(1, len(other))
    worth = {g: c - 10 * scale * in_neg[g] for g, c in in_pos.items() if c > 20 * scale * in_neg[g]}
    best = sorted(worth, key=lambda g: (-worth[g], -len(g), g))[:3000]
    kept, docs_of, holds = set(best), defaultdict(set), defaultdict(set)
    for k, d in enumerate(toxic):
        for t in {bare(t) for t in d}:
            docs_of[t].add(k)
    for t in docs_of:
        for g in grams(t) & kept:
            holds[g].add(t)
    chosen, explained = [], set()

    def gain(g):
        """Documents with a token that holds g and none of the chosen, less those expected to have it by chance."""
        found = set().union(*(docs_of[t] for t in holds[g] - explained)) if holds[g] - explained else ()
        return len(found) - 10 * scale * in_neg[g]

    gains = {g: gain(g) for g in best}
    while gains and len(chosen) < LANDMARKS:
        g = max(gains, key=lambda g: (gains[g], len(g), g))
        if gains[g] < few:
            break
        # The longest string in nearly the same documents says most.
        longer = [h for h in gains if g in h and gains[h] >= 0.9 * gains[g]]
        g = max(longer, key=lambda h: (len(h), gains[h], h))
        chosen.append(g)
        explained |= holds[g]
        gains = {h: x if holds[h].isdisjoint(holds[g]) else gain(h) for h, x in gains.items() if h != g}
    return chosen


def _sentences(tokens: list[str], known: dict) -> list:
    """Largest kernels of each sentence that has a token with features."""
    hits = [(i, v) for i, t in enumerate(tokens) if (v := known[t]) is not None]
    if not hits:
        return []
    if len(hits) == 1:
        return [hits[0][1]]
    out, at, now = [], hits[0][0], hits[0][1]
    for i, v in hits[1:]:
        if any(t[-1] in ".!?" for t in tokens[at:i]):
            out.append(now)
            now = v
        else:
            now = np.maximum(now, v)
        at = i
    return [*out, now]


def features(known: dict, tokens, landmarks) -> None:
    """Adds tokens not yet known: their kernels, or None where all are faint."""
    fresh = list({t for t in tokens if t not in known})
    for s in range(0, len(fresh), 20_000):
        part = fresh[s : s + 20_000]
        for t, row in zip(part, likeness([bare(t) for t in part], landmarks)):
            known[t] = row.copy() if row.any() else None


def once(docs: list[list[str]]) -> list[int]:
    """Indices of the documents of which no near copy comes before: two of three least token hashes agree."""
    seen, out = set(), []
    for k, d in enumerate(docs):
        words = [t.encode() for t in set(d)]
        least = [min((zlib.crc32(w, salt) for w in words), default=0) for salt in (1, 77777, 3141592)]
        pairs = {(i, least[i], least[(i + 1) % 3]) for i in range(3)}
        if seen.isdisjoint(pairs) or not words:
            out.append(k)
        seen |= pairs
    return out


def fit(texts, labels: list[int]) -> dict | None:
    """The machine, or None without documents of both labels or without landmarks."""
    # One string a word: the driver holds thousands of documents.
    words: dict = {}
    docs = [[words.setdefault(w, w) for w in tokens_of(t)] for t in texts]
    first = once(docs)
    docs, labels = [docs[k] for k in first], [labels[k] for k in first]
    toxic = [d for d, y in zip(docs, labels) if y]
    other = [d for d, y in zip(docs, labels) if not y]
    if not toxic or not other:
        return None
    landmarks = choose_landmarks(toxic, other)
    if not landmarks:
        return None
    known: dict = {}
    features(known, {t for d in docs for t in d}, landmarks)
    gram = likeness(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    bags = [_sentences(d, known) or [np.zeros(len(landmarks), np.float32)] for d in docs]
    labels = np.array(labels)
    # Sentences of a toxic document that hold a landmark nearly whole, or its worst one, are toxic; those of others are not.
    x, y = [], []
    for bag, toxic_doc in zip(bags, labels):
        bag = np.array(bag, float)
        worst = bag.max(axis=1)
        if toxic_doc:
            bag = bag[(worst >= 0.9) | (worst == worst.max())]
        x.append(bag)
        y.append(np.full(len(bag), 1.0 if toxic_doc else -1.0))
    x, y = np.vstack(x), np.concatenate(y)
    x = np.hstack([x @ root, np.ones((len(x), 1))])
    # Sentences of either label weigh the same together.
    w = _squared_hinge(x, y, np.where(y > 0, 500.0 / max(1, (y > 0).sum()), 500.0 / max(1, (y < 0).sum())))
    weights, bias = root @ w[:-1], w[-1]
    margins = np.array([worst_margins(b, weights, bias) for b in bags])
    return {"landmarks": landmarks, "weights": weights, "bias": bias, "platt": _platt(margins, labels)}


def worst_margins(sentences, weights, bias) -> list[float]:
    """The three largest margins of a document's sentences, at least those of a sentence without features."""
    found = sorted((max(0.0, float(v @ weights)) for v in sentences), reverse=True)[:3]
    return [x + bias for x in found + [0.0] * (3 - len(found))]


def _squared_hinge(x, y, c, rounds: int = 30):
    """Newton steps for half the squared norm of the weights plus the weighted squared hinge losses."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    before = None
    for _ in range(rounds):
        on = 1 - y * (x @ w) > 0
        if before is not None and (on == before).all():
            break
        before = on
        xa = x[on] * c[on, None]
        w = np.linalg.solve(ridge + xa.T @ x[on], xa.T @ y[on])
    return w


def _platt(margins, labels, rounds: int = 50):
    """Logistic weights of a document's margins and the offset; the targets are Platt's smoothed ones."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    t = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([margins, np.ones((len(margins), 1))])
    w = np.array([1.0, 0.0, 0.0, 0.0])
    ridge = np.diag([0.1, 0.1, 0.1, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - t) + ridge @ w)
    return w


def scorer(model):
    """Scores of texts by a machine; without one, all are 0."""

    known: dict = {}

    def run(texts) -> list[float]:
        if model is None:
            return [0.0] * len(texts)
        if len(known) > REMEMBER:
            known.clear()
        docs = [tokens_of(t) for t in texts]
        features(known, (t for d in docs for t in d), model["landmarks"])
        out = []
        for d in docs:
            margins = worst_margins(_sentences(d, known), model["weights"], model["bias"])
            value = float(np.dot([*margins, 1.0], model["platt"]))
            out.append(float(1 / (1 + np.exp(-np.clip(value, -30, 30)))))
        return out

    return run


def _score(held):
    def run(batches):
        score = scorer(held.value)
        for batch in batches:
            out, texts = [], batch.column(1)
            # A bounded number of characters at a time.
            part, size = [], 0
            for t in texts:
                t = t.as_py() or ""
                part.append(t)
                size += len(t)
                if size > 1_000_000:
                    out += score(part)
                    part, size = [], 0
            out += score(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return run


def remainder(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _fitted(batches):
    """The machine of all rows (doc_id, text, toxic), pickled."""
    texts, labels = [], []
    for batch in batches:
        texts.append(batch.column(1))
        labels += batch.column(2).to_pylist()
    model = fit((t.as_py() for part in texts for t in part), labels)
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fits on a bounded sample, chosen by hash, of the labelled documents whose remainder is not 2."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 2)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n1, n0 = labels.agg(F.count(F.when(F.col("toxic") > 0, 1)), F.count(F.when(F.col("toxic") <= 0, 1))).first()
    k1, k0 = max(1, -(-n1 // FIT_TOXIC)), max(1, -(-n0 // FIT_OTHER))
    draw = F.pmod(F.xxhash64("doc_id"), F.when(F.col("toxic") > 0, k1).otherwise(k0)) == 0
    # A few thousand rows by construction.
    chosen = F.broadcast(labels.where(draw).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text IS NOT NULL").select("doc_id", "text", "toxic")
    # The fit is a task's: its texts and kernels would take hundreds of megabytes of the driver's memory.
    made = rows.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``score``, the probability that they are toxic; whole texts are read.

    Null and empty texts score as a document without a suspicious token; equal
    texts score the same; without labels of both kinds all scores are 0; an
    empty table gives no rows; a column named score is replaced.
    """
    labels = scratch.columns(labels, "doc_id", "toxic")
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "score")]
    docs = docs.select("doc_id", "text", *rest)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(held), f"{kinds}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = remainder(F.col("doc_id")) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
