"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of punctuation; numbers, names (capitalised
inside a sentence) and units after a number become typed placeholders.  A
capitalised word that begins a sentence may be a name or not: windows are
searched with it as a word and as a name, and an exchanged one counts where it
maps one to one.
Windows of the canonical words are hash-joined with those of the benchmark's
items; the windows that lie along one item give the words it has in common
with the document, and the values in the item's placeholders must map to the
document's one to one.  So a question whose numbers or names are exchanged
throughout is found, and text that merely has the same frame is not.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words in a window; share of an item's words that must be in common; share of its placeholders that must be consistent.
WINDOW, COVER, CONSISTENT = 5, 0.8, 0.8
#: Benchmark items held by every task at most; more are joined in further passes of as many.
ITEMS = 20_000
#: Units that become a placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles metre metres meter meters inch inches foot feet g kg mg lb lbs oz gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons l ml litre litres liter liters s sec second seconds min "
    "minute minutes h hour hours day days week weeks month months year years percent % $ usd eur dollar dollars euro "
    "euros cent cents mph kmh km/h m/s hz khz mhz ghz kb mb gb tb w kw kwh v a j kj cal kcal c f k degrees"
).split()

_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 36, 37]] = True  # also $ and %
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True  # ! . : ?
#: Kind of a capitalised word that begins a sentence, which may be a name.
LEAD = 4
NUMBER, NAME, UNIT = (tk.mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _folded(data):
    """Lower-case bytes, also of the two-byte Latin letters C3 80-9E, and where an upper-case letter begins."""
    low = tk.LOWER[data]
    upper = (data >= 65) & (data <= 90)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[second] += 0x20
    upper[:-1] |= second[1:]
    return low, upper


_SAME = np.arange(256, dtype=np.uint8)


def canonical(data, at):
    """Canonical hashes and plain hashes of the words of each row, the kinds of placeholders (0 none, LEAD a word with its plain hash), first indices, starts and ends."""
    low, upper = _folded(data)
    starts, ends, _, first = tk.words(data, at)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int8), first, starts, ends
    # Punctuation around a word goes; a word of punctuation alone stays whole.
    solid = np.append(np.cumsum(_WORDY[data]), 0)
    count = solid[ends - 1] - np.where(starts > 0, solid[starts - 1], 0)
    at_solid = np.flatnonzero(_WORDY[data])
    base = np.where(starts > 0, solid[starts - 1], 0)
    has = count > 0
    s, e = starts.copy(), ends.copy()
    if len(at_solid):
        s[has] = at_solid[base[has]]
        e[has] = at_solid[base[has] + count[has] - 1] + 1
    plain = tk.span_hashes(low, s, e, _SAME)
    kind = np.zeros(n, np.int8)
    digit = np.append(np.cumsum(_DIGIT[data]), 0)
    kind[(digit[e - 1] - np.where(s > 0, digit[s - 1], 0)) > 0] = 1
    begins = np.zeros(n, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    after_stop = np.ones(n, bool)
    after_stop[1:] = _STOP[data[ends[:-1] - 1]]
    kind[(kind == 0) & upper[s] & ~begins & ~after_stop] = 2
    units = unit_hashes()
    unit = np.zeros(n, bool)
    unit[1:] = (kind[:-1] == 1) & ~begins[1:] & np.isin(plain[1:], units)
    kind[unit] = 3
    kind[(kind == 0) & upper[s]] = LEAD
    shown = np.select([kind == 1, kind == 2, kind == 3], [NUMBER, NAME, UNIT], plain)
    return shown, plain, kind, first, starts, ends


_units = []


def unit_hashes():
    if not _units:
        raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        s, e, _, _ = tk.words(raw, np.array([0, len(raw)]))
        _units.append(np.sort(tk.span_hashes(raw, s, e, _SAME)))
    return _units[0]


def _frames(shown, first):
    """Window hashes with the index of their first word; rows of fewer words have none."""
    n = len(shown) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        out += shown[j : j + n] * np.uint64(pow(tk.STEP, j, 1 << 64))
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    ok = np.flatnonzero(np.arange(n) + WINDOW <= row_end)
    return tk.mix(out[ok]), ok


def _both_frames(shown, kind, first):
    """Windows with words that begin a sentence as they are, and those that differ when these are names."""
    frames, where = _frames(shown, first)
    named, _ = _frames(_named(shown, kind), first)
    other = np.flatnonzero(named != frames)
    return np.append(frames, named[other]), np.append(where, where[other])


def _named(shown, kind):
    return np.where(kind == LEAD, NAME, shown)


def index(item_ids: list[int], texts: list[str]) -> dict:
    """The benchmark's windows in hash order, with item and place, and its words."""
    column = pa.array(texts, pa.large_string())
    hashes, item, place, words = [], [], [], {}
    for i, j, data, at in tk.chunks(column):
        shown, plain, kind, first, _, _ = canonical(data, at)
        frames, where = _both_frames(shown, kind, first)
        row = np.searchsorted(first, where, "right") - 1
        hashes.append(frames)
        item.append(row + i)
        place.append(where - first[row])
        for r in range(j - i):
            words[i + r] = (plain[first[r] : first[r + 1]], kind[first[r] : first[r + 1]], shown[first[r] : first[r + 1]])
    hashes, item, place = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
    order = np.argsort(hashes, kind="stable")
    return {"ids": item_ids, "hash": hashes[order], "item": item[order], "place": place[order], "words": words}


def _agree(item_words, doc_words, lined) -> float:
    """Share of the lined-up placeholders whose values map one to one, 1 without placeholders."""
    (plain_i, kind_i, _), (plain_d, kind_d) = item_words, doc_words
    pairs = [(int(kind_i[a]), int(plain_i[a]), int(plain_d[b])) for a, b in lined if 0 < kind_i[a] < LEAD and kind_d[b] == kind_i[a]]
    if not pairs:
        return 1.0
    there, back = {}, {}
    for k, x, y in pairs:
        there.setdefault((k, x), {}).setdefault(y, 0)
        there[k, x][y] += 1
        back.setdefault((k, y), {}).setdefault(x, 0)
        back[k, y][x] += 1
    good = 0
    for k, x, y in pairs:
        good += y == max(there[k, x], key=lambda v: (there[k, x][v], v)) and x == max(back[k, y], key=lambda v: (back[k, y][v], v))
    return good / len(pairs)


def _settled(item_words, doc_words, lined: dict) -> dict:
    """The lined-up words without those that agree as names only, where a sentence begins, and do not map one to one; none if those names are most of it."""
    (plain_i, kind_i, shown_i), (plain_d, _, shown_d) = item_words, doc_words
    named = {a for a, b in lined.items() if shown_i[a] != shown_d[b]}
    if not named:
        return lined
    there, back = {}, {}
    for a, b in lined.items():
        if a in named or kind_i[a] in (2, LEAD):
            x, y = int(plain_i[a]), int(plain_d[b])
            there.setdefault(x, Counter())[y] += 1
            back.setdefault(y, Counter())[x] += 1
    bad = set()
    for a in named:
        x, y = int(plain_i[a]), int(plain_d[lined[a]])
        if y != max(there[x], key=lambda v: (there[x][v], v)) or x != max(back[y], key=lambda v: (back[y][v], v)):
            bad.add(a)
    if len(named) - len(bad) > sum(kind_i[a] == 0 for a in lined):
        return {}
    return {a: b for a, b in lined.items() if a not in bad}


# Below, item_shown and shown have a row for each reading of the words; words are the same where one reading agrees.


def _on_lines(item_shown, shown, lines):
    """How many of an item's words stand at their own places on each diagonal (document place less item place)."""
    n, size = item_shown.shape[1], shown.shape[1]
    out = np.zeros(len(lines), np.int64)
    for i in range(0, len(lines), 4096):
        at = lines[i : i + 4096, None] + np.arange(n)
        inside = (at >= 0) & (at < size)
        at = np.where(inside, at, 0)
        same = np.zeros(at.shape, bool)
        for ours, theirs in zip(item_shown, shown):
            same |= theirs[at] == ours
        out[i : i + 4096] = (inside & same).sum(axis=1)
    return out


def _line(item_shown, shown, d: int) -> dict:
    """The words that an item has at their own places on a diagonal: item place -> document place."""
    a, b = max(0, -d), min(item_shown.shape[1], shown.shape[1] - d)
    places = np.flatnonzero((item_shown[:, a:b] == shown[:, a + d : b + d]).any(axis=0)) + a
    return dict(zip(places.tolist(), (places + d).tolist()))


def _aligned(item_shown, shown, d: int, seeded, band: int) -> dict:
    """Most words that an item and the document around a diagonal have in the same order: item place -> document place.

    Of alignments with as many words, the one with most words on the diagonal, then on those in ``seeded``, counts.
    """
    n = item_shown.shape[1]
    x0, x1 = max(0, d - band), min(shown.shape[1], d + n + band)
    text = shown[:, x0:x1]
    width = x1 - x0
    bonus = np.zeros(n + width, np.int64)  # by diagonal, counted from x0 - n
    near = seeded[(seeded >= x0 - n) & (seeded < x0 + width)]
    bonus[near - x0 + n] = 1
    bonus[d - x0 + n] = 2
    word = 3 * n
    now = np.zeros(width + 1, np.int64)
    up, left = np.zeros((n, (width + 8) // 8), np.uint8), np.zeros((n, (width + 8) // 8), np.uint8)
    for u in range(n):
        before = now
        now = before.copy()
        same = np.flatnonzero((text == item_shown[:, u, None]).any(axis=0))
        now[same + 1] = np.maximum(now[same + 1], before[same] + word + bonus[same - u + n])
        now = np.maximum.accumulate(now)
        up[u] = np.packbits(now == before)
        left[u, : (width + 7) // 8] = np.packbits(now[1:] == now[:-1])
    lined, u, x = {}, n, width
    while u and x:
        if up[u - 1, x >> 3] >> (7 - (x & 7)) & 1:
            u -= 1
        elif left[u - 1, (x - 1) >> 3] >> (7 - ((x - 1) & 7)) & 1:
            x -= 1
        else:
            u, x = u - 1, x - 1
            lined[u] = x0 + x
    return lined


def _chains(item_shown, shown, p, q):
    """Windows in document order, cut where their diagonal changes much: a copy may have gained, lost or moved words."""
    n = item_shown.shape[1]
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    cuts = np.flatnonzero((np.diff(p) > n) | (np.abs(np.diff(p - q)) > max(3, n // 4))) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(p))):
        lined, taken = {}, set()
        for x, y in zip(p[a:b].tolist(), q[a:b].tolist()):
            for j in range(WINDOW):
                if y + j not in lined and x + j not in taken and (item_shown[:, y + j] == shown[:, x + j]).any():
                    lined[y + j] = x + j
                    taken.add(x + j)
        # Words left between windows count where both sides have the same number of them.
        keys = sorted(lined)
        for u, v in zip(keys[:-1], keys[1:]):
            if v - u > 1 and lined[v] - lined[u] == v - u:
                for j in range(1, v - u):
                    if lined[u] + j not in taken and (item_shown[:, u + j] == shown[:, lined[u] + j]).any():
                        lined[u + j] = lined[u] + j
                        taken.add(lined[u] + j)
        yield lined


def _match(idx: dict, plain, kind, shown, places, found_item, found_place) -> list:
    """One document's windows that an item has -> items it holds: (item, cover, consistency, first and end word)."""
    out = []
    readings = np.stack([shown, _named(shown, kind)])
    for item in np.unique(found_item):
        own = found_item == item
        p, q = places[own], found_place[own]
        item_words = idx["words"][item]
        n = len(item_words[2])
        best = None

        def hold(lined):
            nonlocal best
            lined = _settled(item_words, (plain, kind, shown), lined)
            cover = len(lined) / n
            if cover >= COVER and (best is None or cover > best[1]):
                steady = _agree(item_words, (plain, kind), lined.items())
                if steady >= CONSISTENT:
                    best = (int(item), cover, steady, min(lined.values()), max(lined.values()) + 1)

        item_readings = np.stack([item_words[2], _named(item_words[2], item_words[1])])
        # First with words that begin a sentence as they are, then also as names.
        for k in (1, 2):
            if best is None or best[1] < 1:
                _follow(item_readings[:k], readings[:k], p, q, hold, lambda: best[1] if best else 0)
        if best:
            out.append(best)
    return out


def _follow(item_shown, shown, p, q, hold, reached) -> None:
    """Gives ``hold`` the alignments of an item with the document by the windows at p and q, until one has every word."""
    n, size = item_shown.shape[1], shown.shape[1]
    need = COVER * n
    # A window that an item repeats has several places in it, so each diagonal is followed by itself first.
    lines = np.unique(p - q)
    common = _on_lines(item_shown, shown, lines)
    best_first = np.argsort(-common, kind="stable")
    for k in best_first:
        if common[k] < need or common[k] <= reached() * n:
            break
        hold(_line(item_shown, shown, int(lines[k])))
    if reached() == 1:
        return
    for lined in _chains(item_shown, shown, p, q):
        hold(lined)
    # Words put in or left out, also beyond the end windows: an alignment around each diagonal that can have enough words.
    band = max(3, n // 4)
    low, high = np.maximum(lines - 2 * band, 0), np.minimum(lines + n + 2 * band, size)
    here = np.any([np.isin(theirs, ours) for ours, theirs in zip(item_shown, shown)], axis=0)
    known = np.append(0, np.cumsum(here))
    open_ = known[high] - known[low] >= need
    for k in best_first:
        d = int(lines[k])
        if not open_[k] or reached() == 1:
            continue
        if np.any([np.isin(ours, theirs[low[k] : high[k]]) for ours, theirs in zip(item_shown, shown)], axis=0).sum() < need:
            open_[k] = False
            continue
        lined = _aligned(item_shown, shown, d, lines, 2 * band)
        if len(lined) < need:
            # No diagonal whose own band lies in this one has more.
            open_[np.abs(lines - d) <= band] = False
        else:
            hold(lined)
            hold(_aligned(item_shown, shown, d, lines, band))


_KINDS = "item_id long, cover double, consistency double, start long, end long"


def _search(held):
    def run(batches):
        idx = held.value
        for batch in batches:
            rows, out = [], []
            for i, j, data, at in tk.chunks(batch.column(1)):
                shown, plain, kind, first, starts, ends = canonical(data, at)
                frames, where = _both_frames(shown, kind, first)
                order = np.argsort(where, kind="stable")
                frames, where = frames[order], where[order]
                low = np.searchsorted(idx["hash"], frames)
                hit = np.zeros(len(frames), bool)
                inside = low < len(idx["hash"])
                hit[inside] = idx["hash"][low[inside]] == frames[inside]
                if not hit.any():
                    continue
                frames, where, low = frames[hit], where[hit], low[hit]
                high = np.searchsorted(idx["hash"], frames, "right")
                count = high - low
                at_index = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                word = np.repeat(where, count)
                row = np.searchsorted(first, word, "right") - 1
                edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
                for a, b in zip(edges[:-1], edges[1:]):
                    r = row[a]
                    f, g = first[r], first[r + 1]
                    take = at_index[a:b]
                    for item, cover, steady, s, e in _match(idx, plain[f:g], kind[f:g], shown[f:g], word[a:b] - f, idx["item"][take], idx["place"][take]):
                        rows.append(i + int(r))
                        out.append((idx["ids"][item], cover, steady, int(starts[f + s] - at[r]), int(ends[f + e - 1] - at[r])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]],
                    ["id", "item_id", "cover", "consistency", "start", "end"],
                )

    return run


def _without(held, text: int):
    """Batches without the rows whose own text, the column at ``text``, holds an item."""

    def run(batches):
        search = _search(held)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text)], ["row", "text"])
            keep = np.ones(batch.num_rows, bool)
            for found in search([rows]):
                keep[found.column(0).to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return run


def _indexes(benchmark: DataFrame):
    """The index of each ``ITEMS`` items, as a broadcast."""
    items = scratch.columns(benchmark, "item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    passes = max(1, -(-items.count() // ITEMS))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").toArrow()
        if part.num_rows:
            yield benchmark.sparkSession.sparkContext.broadcast(index(part.column(0).to_pylist(), part.column(1).to_pylist()))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, in all their columns, whose own text holds no item; whatever ids they have or share plays no part."""
    for held in _indexes(benchmark):
        docs = docs.mapInArrow(_without(held, docs.columns.index("text")), docs.schema)
    return docs


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, cover, consistency, start, end): the benchmark items that each whole text holds, with byte spans.

    Texts or items that are null, empty or shorter than a window match
    nothing; repeated rows are each searched; an item that a document holds
    several times is reported where it is covered best; empty tables give no
    rows; columns other than the key, item_id and text are left out.  Items
    are held by every task, ``ITEMS`` at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[key].cast("long").alias("id"), "text")
    out = None
    for held in _indexes(benchmark):
        found = docs.mapInArrow(_search(held), f"id long, {_KINDS}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"id long, {_KINDS}")
    return out.withColumnRenamed("id", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
