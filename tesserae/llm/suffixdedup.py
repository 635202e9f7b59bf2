"""Repeated 200-byte strings by sorted suffixes.

A suffix is kept for sorting only at anchors: of the 153 places where
``LEAD`` bytes still fit into a 200-byte window, the one whose 8 bytes hash
least (leftmost of equals).  Equal windows have the same anchor at the same
offset, so two equal windows always meet as two suffixes that begin with the
same ``LEAD`` bytes.  A hashed count of those leading bytes drops suffixes
that are alone.  The others, with the bytes before them, are range-partitioned
by their leading bytes with sampled splitters, sorted in each bucket by
multikey quicksort on 8-byte digits, and compared: for each offset the windows
that hold an anchor are equal or not.  A run of equal leading bytes lies on
one side of every splitter, so nothing has to be compared across a boundary
but the run at the bucket's edge, which is whole.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk
from .ngramjoin import _power

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
NO_ID = (1 << 63) - 1
LEAD = 48
OFFSETS = LENGTH - LEAD + 1
GRAM = 8
ROOM = OFFSETS - 1 + LENGTH
#: Anchors that a map task gathers before it sends them, and that one task sorts.
GATHER = 200_000
WINDOWS = 20_000
TASK_ROWS = 2_000_000
TASK_WINDOWS = 40_000
#: Documents sampled for the splitters, by hash: so many at least, and so many for each bucket.
SAMPLE, PER_BUCKET = 2000, 4


def _prefix(data):
    n = len(data)
    up, down = tk.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.BYTE[data] * up[:n], out=sums[1:])
    return sums, down


def anchors(data, at):
    """Anchors of all rows of a chunk (places in the chunk) and hashes of their leading bytes."""
    n, size = len(data), np.diff(at)
    none = np.zeros(0, np.int64)
    if n < LENGTH or not (size >= LENGTH).any():
        return none, none.astype(np.uint64)
    sums, down = _prefix(data)
    bits = np.uint64(int(n).bit_length())
    grams = tk.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    value = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(value) // OFFSETS) + 1
    whole = np.full(blocks * OFFSETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole[: len(value)] = value
    whole = whole.reshape(blocks, OFFSETS)
    ahead = np.minimum.accumulate(whole, axis=1).reshape(-1)
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - LENGTH + 1
    least = np.minimum(behind[:starts], ahead[OFFSETS - 1 : OFFSETS - 1 + starts])
    ok = np.zeros(n + 1, np.int8)  # +1 where a row's windows start, -1 after the last
    long = size >= LENGTH
    np.add.at(ok, at[:-1][long], 1)
    np.add.at(ok, at[1:][long] - LENGTH + 1, -1)
    ok = np.cumsum(ok[:starts], dtype=np.int64) > 0
    mark = np.zeros(n, bool)
    mark[(least[ok] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    found = np.flatnonzero(mark)
    return found, tk.mix((sums[found + LEAD] - sums[found]) * down[found] + np.uint64(LEAD))


def _sent(rows):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])


def _counter(kept: int, cut: int):
    """Rows (text hash, text) -> blobs of (leading hash, text hash, place) for each bucket of leading hashes."""
    width = -(-(kept - cut) // 8)

    def flush(parts):
        lead = np.concatenate([p[0] for p in parts]) >> np.uint64(64 - kept)
        text = np.concatenate([p[1] for p in parts])
        place = np.concatenate([p[2] for p in parts])
        bucket = (lead >> np.uint64(kept - cut)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << cut) + 1))
        out = []
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            if i < j:
                own = order[i:j]
                first = np.flatnonzero(np.concatenate([[True], text[own][1:] != text[own][:-1]]))
                runs = np.diff(np.append(first, j - i))
                low = lead[own] & np.uint64((1 << (kept - cut)) - 1)
                out.append((b, tk.pack(text[own][first].tobytes(), tk.planes(runs, 4), tk.planes(place[own], 5), tk.planes(low, width))))
        yield from _sent(out)

    def run(batches):
        seen, parts, held = set(), [], 0
        for batch in batches:
            names = np.array(batch.column(0)).view(np.uint64)
            for i, j, data, at in tk.chunks(batch.column(1)):
                found, lead = anchors(data, at)
                row = np.searchsorted(at, found, "right") - 1
                fresh = np.zeros(j - i, bool)
                for k in np.unique(row):
                    if names[i + k] not in seen:
                        seen.add(names[i + k])
                        fresh[k] = True
                keep = fresh[row]
                if keep.any():
                    parts.append((lead[keep], names[i:j][row[keep]], found[keep] - at[row[keep]]))
                    held += int(keep.sum())
                if held >= GATHER:
                    yield from flush(parts)
                    seen, parts, held = set(), [], 0
        if held:
            yield from flush(parts)

    return run


def _shared(kept: int, cut: int):
    """A bucket's suffixes whose leading bytes occur at two places: (text, places) once for each text."""
    width = -(-(kept - cut) // 8)

    def run(key, table):
        texts, places, leads = [], [], []
        for blob in table.column("blob"):
            text, runs, place, low = tk.unpack(blob.as_py())
            text = np.frombuffer(text, "<u8")
            runs = tk.from_planes(runs, len(text), 4).astype(np.int64)
            n = int(runs.sum())
            texts.append(np.repeat(text, runs))
            places.append(tk.from_planes(place, n, 5))
            leads.append(tk.from_planes(low, n, width))
        t, p, k = np.concatenate(texts), np.concatenate(places), np.concatenate(leads)
        order = np.lexsort((p, t, k))
        t, p, k = t[order], p[order], k[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
        t, p, k = t[new], p[new], k[new]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        keep = np.repeat(size > 1, size)
        return _by_text(t[keep], p[keep])

    return run


def _by_text(t, p):
    order = np.lexsort((p, t))
    t, p = t[order], p[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])[: len(t)])
    ends = np.append(first[1:], len(t))
    return pa.table({"text_key": tk.signed(t[first]), "places": pa.array([p[i:j].astype("<u8").tobytes() for i, j in zip(first, ends)], pa.binary())})


def _windows(data, place, size):
    """The ROOM bytes around each place of one text, zero outside it."""
    padded = np.zeros(size + 2 * ROOM, np.uint8)
    padded[ROOM : ROOM + size] = data
    view = np.lib.stride_tricks.sliding_window_view(padded, ROOM)
    return view[place + ROOM - (OFFSETS - 1)]


def _cutter(splitters, spread: int):
    """Rows (text hash, text, places) -> blobs of suffixes with the bytes before them for each range of leading bytes."""
    buckets = len(splitters) + 1

    def flush(parts, turn):
        windows = np.concatenate([p[0] for p in parts])
        text, place, before, after = (np.concatenate([p[c] for p in parts]) for c in range(1, 5))
        out = []
        # Suffixes that are equal with all around them need no other proof: only one of them goes on.
        starts = np.arange(len(windows)) * ROOM
        same = tk.span_hashes(windows.reshape(-1), starts, starts + ROOM, np.arange(256, dtype=np.uint8))
        order = np.lexsort((place, text, same))
        new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        full = (before[order] == OFFSETS - 1) & (after[order] == LENGTH)
        # The same row of the same text twice is no repeat.
        own = np.concatenate([[False], ~new[1:] & (text[order][1:] == text[order][:-1]) & (place[order][1:] == place[order][:-1])])
        done = np.repeat((size > 1) & (np.add.reduceat(own.astype(np.int64), first) == 0), size) & full
        sent = order[~done | new]
        if done.any():
            o = order[done]
            out.append((buckets + turn % spread, tk.pack(text[o].tobytes(), tk.planes(place[o] - OFFSETS + 1, 5), tk.planes(place[o] + LENGTH, 5))))
        sent.sort()
        lead = np.ascontiguousarray(windows[sent][:, OFFSETS - 1 : OFFSETS + 15]).view("S16").reshape(-1)
        bucket = np.searchsorted(splitters, lead, "right")
        for b in np.unique(bucket):
            o = sent[bucket == b]
            out.append((int(b), tk.pack(text[o].tobytes(), tk.planes(place[o], 5), tk.planes(before[o], 1), tk.planes(after[o], 1), windows[o].tobytes())))
        yield from _sent(out)

    def run(batches):
        parts, held, turn = [], 0, 0
        for batch in batches:
            names = np.array(batch.column(0)).view(np.uint64)
            lists = batch.column(2)
            for i, j, data, at in tk.chunks(batch.column(1)):
                for k in range(j - i):
                    place = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in lists[i + k].as_py()])).astype(np.int64)
                    size = int(at[k + 1] - at[k])
                    # Longer lists go in parts: what is gathered stays bounded.
                    for s in range(0, len(place), WINDOWS):
                        p = place[s : s + WINDOWS]
                        parts.append((
                            _windows(data[at[k] : at[k + 1]], p, size), np.full(len(p), names[i + k]), p.astype(np.uint64),
                            np.minimum(p, OFFSETS - 1).astype(np.uint64), np.minimum(size - p, LENGTH).astype(np.uint64),
                        ))
                        held += len(p)
                        if held >= WINDOWS:
                            yield from flush(parts, turn)
                            parts, held, turn = [], 0, turn + 1
        if held:
            yield from flush(parts, turn)

    return run


def multikey_order(digits):
    """Row order of a matrix of unsigned digits: sorts by the first digit, then each run of equals by the next."""
    order = np.argsort(digits[:, 0], kind="stable")
    tied = np.concatenate([[False], digits[order, 0][1:] == digits[order, 0][:-1]])
    for d in range(1, digits.shape[1]):
        run = np.cumsum(~tied)
        open_ = tied | np.append(tied[1:], False)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        rows = order[at]
        again = np.lexsort((digits[rows, d], run[at]))
        order[at] = rows[again]
        same = digits[order[1:], d] == digits[order[:-1], d]
        tied[1:] &= same
    return order


def _repeated(windows, before, after):
    """For each suffix the largest and least offset at which its window occurs again, -1 if none does."""
    n = len(windows)
    high, low = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    sums = np.zeros((n, ROOM + 1), np.uint64)
    up, down = tk.powers(ROOM + 1)
    np.cumsum(tk.BYTE[windows] * up[:ROOM], axis=1, out=sums[:, 1:])
    for o in range(OFFSETS):
        rows = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(rows) < 2:
            continue
        a = OFFSETS - 1 - o
        value = tk.mix((sums[rows, a + LENGTH] - sums[rows, a]) * down[a])
        order = np.argsort(value)
        value = value[order]
        same = value[1:] == value[:-1]
        both = np.zeros(len(rows), bool)
        both[1:] |= same
        both[:-1] |= same
        hit = rows[order[both]]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return high, low


def _merge(text, start, end):
    """Union of the spans of each text: (text, starts and ends) once for each text."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    out_text, out_spans, i = [], [], 0
    edges = np.append(np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]), len(text))
    for i, j in zip(edges[:-1], edges[1:]):
        s, e = start[i:j], np.maximum.accumulate(end[i:j])
        new = np.concatenate([[True], s[1:] > e[:-1]])
        last = np.append(np.flatnonzero(new)[1:] - 1, j - i - 1)
        out_text.append(text[i])
        out_spans.append(np.concatenate([s[new], e[last]]).astype("<i8").tobytes())
    return pa.table({"text_key": pa.array(tk.signed(np.array(out_text, np.uint64))), "spans": pa.array(out_spans, pa.binary())})


def _compare(buckets: int):
    def run(key, table):
        b = key[0].as_py()
        parts = [tk.unpack(x.as_py()) for x in table.column("blob")]
        text = np.concatenate([np.frombuffer(p[0], "<u8") for p in parts])
        sizes = [len(p[0]) // 8 for p in parts]
        place = np.concatenate([tk.from_planes(p[1], n, 5) for p, n in zip(parts, sizes)]).astype(np.int64)
        if b >= buckets:
            end = np.concatenate([tk.from_planes(p[2], n, 5) for p, n in zip(parts, sizes)]).astype(np.int64)
            return _merge(text, place, end)
        before = np.concatenate([tk.from_planes(p[2], n, 1) for p, n in zip(parts, sizes)]).astype(np.int64)
        after = np.concatenate([tk.from_planes(p[3], n, 1) for p, n in zip(parts, sizes)]).astype(np.int64)
        windows = np.concatenate([np.frombuffer(p[4], np.uint8).reshape(-1, ROOM) for p in parts])
        del parts
        digits = np.ascontiguousarray(windows[:, OFFSETS - 1 : OFFSETS - 1 + LEAD]).view(">u8").astype(np.uint64)
        order = multikey_order(digits)
        alike = (digits[order[1:]] == digits[order[:-1]]).all(axis=1)
        # Runs of equal leading bytes, a bounded number of rows at a time.
        edges = np.flatnonzero(np.concatenate([[True], ~alike]))
        texts, starts, ends = [], [], []
        i = 0
        while i < len(order):
            k = np.searchsorted(edges, i + 10_000, "right") - 1
            j = int(edges[k]) if k >= 0 and edges[k] > i else int(edges[np.searchsorted(edges, i, "right")]) if edges[-1] > i else len(order)
            if len(order) - i <= 10_000:
                j = len(order)
            rows = order[i:j]
            i = j
            rows = rows[np.lexsort((place[rows], text[rows]))]
            once = np.concatenate([[True], (text[rows][1:] != text[rows][:-1]) | (place[rows][1:] != place[rows][:-1])])
            rows = rows[once]
            high, low = _repeated(windows[rows], before[rows], after[rows])
            hit = high >= 0
            texts.append(text[rows[hit]])
            starts.append(place[rows[hit]] - high[hit])
            ends.append(place[rows[hit]] - low[hit] + LENGTH)
        return _merge(np.concatenate(texts), np.concatenate(starts), np.concatenate(ends))

    return run


def _leads(batches):
    for batch in batches:
        found = []
        for _, _, data, at in tk.chunks(batch.column(0)):
            places, _ = anchors(data, at)
            found += [bytes(data[p : p + 16]) for p in places[::8]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["lead"])


def _spans_of(lists) -> list[tuple[int, int]]:
    """Merged spans of one text from the pieces of several buckets."""
    parts = [np.frombuffer(x, "<i8") for x in lists]
    pairs = sorted((int(s), int(e)) for p in parts for s, e in zip(p[: len(p) // 2], p[len(p) // 2 :]))
    out = []
    for s, e in pairs:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _apply(batches):
    """Rows (doc_id, text, copies, pieces) -> the text's spans, its bytes without them."""
    for batch in batches:
        size, starts, ends, kept = [], [], [], []
        for text, copies, pieces in zip(batch.column(1), batch.column(2), batch.column(3)):
            raw = text.as_buffer().to_pybytes()
            if copies.as_py() and len(raw) >= LENGTH:
                spans = [(0, len(raw))]
            else:
                spans = _spans_of(pieces.as_py() or []) if len(raw) >= LENGTH else []
            at, rest = 0, []
            for s, e in spans:
                rest.append(raw[at:s])
                at = e
            rest.append(raw[at:])
            size.append(len(raw))
            starts.append([s for s, _ in spans])
            ends.append([e for _, e in spans])
            kept.append(b"".join(rest))
        kinds = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(starts, kinds), pa.array(ends, kinds), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "starts", "ends", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each document's bytes without those that a repeated 200-byte string covers.

    Returns doc_id, n_bytes, starts and ends (the removed runs, byte offsets,
    end exclusive) and kept (the remaining bytes).  Texts are UTF-8 bytes; a
    null text counts as empty; a text shorter than 200 bytes loses nothing;
    repeated rows and equal texts are repeats of each other; an empty table
    gives no rows; columns other than doc_id and text are left out.
    """
    docs = scratch.columns(docs, "doc_id", "text")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    sizes = docs.select("id", "text_key", F.octet_length("text").alias("n"))
    classes = sizes.groupBy("text_key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = scratch.table(classes, "texts")
    rows, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    expected = max(1, total // 70)
    kept, cut = min(64, _power(expected) + 16), _power(expected / TASK_ROWS)
    long = docs.where(F.octet_length("text") >= LENGTH)
    sent = long.select("text_key", "text").mapInArrow(_counter(kept, cut), "bucket int, blob binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared(kept, cut), "text_key long, places binary")
    shared = scratch.table(shared, "shared")
    n = shared.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()[0] // 8

    parts = int(max(1, n // TASK_WINDOWS))
    few = F.pmod(F.col("text_key"), F.lit(max(1, rows // max(SAMPLE, PER_BUCKET * parts)))) == 0
    leads = long.where(few).select("text").mapInArrow(_leads, "lead binary").toArrow()["lead"].to_pylist()
    leads = np.sort(np.array(leads, "S16"))
    cuts = np.unique(leads[np.arange(1, parts) * len(leads) // parts]) if len(leads) else leads
    cutter = _cutter(cuts, parts)

    places = shared.groupBy("text_key").agg(F.collect_list("places").alias("lists"))
    places = scratch.table(places.join(classes.select("text_key", "id"), "text_key"), "places")
    suffixes = long.join(places, ["text_key", "id"]).select("text_key", "text", "lists")
    suffixes = suffixes.mapInArrow(cutter, "bucket int, blob binary")
    found = suffixes.groupBy("bucket").applyInArrow(_compare(len(cuts) + 1), "text_key long, spans binary")
    found = found.groupBy("text_key").agg(F.collect_list("spans").alias("pieces"))
    found = found.join(classes.where("copies > 1").select("text_key", F.lit(True).alias("again")), "text_key", "full")
    found = scratch.table(found, "spans")
    out = docs.join(found, "text_key", "left").select("id", "text", F.coalesce("again", F.lit(False)).alias("again"), "pieces")
    out = out.mapInArrow(_apply, "id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "starts", "ends", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
