"""Language identification by fusing evidence.

The posterior of a language given a text is, up to a constant, the product of
the likelihood of its byte trigrams (naive Bayes, tempered, since trigrams are
not independent), of the language declared in its markup, of the suffix of its
address, and of its host's prior.  Host priors are soft counts of text
posteriors, aggregated by host and smoothed towards those of the host's
domain, these towards the suffix's, and these towards all; a row's own text is
left out of its prior.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents that the likelihoods are fitted on, at most, and the hashed trigrams they tell apart.
FIT, CELLS = 6000, 1 << 16
#: Trigrams that a text counts for at most; added to every count.
EFFECTIVE, ADDED = 40.0, 0.5
#: Probability that a declaration, or a country's suffix, names the right language.
DECLARED, SUFFIX = 0.9, 0.8
#: Documents' worth of the parent's prior at each level.
SMOOTH = 5.0
#: Languages of country suffixes.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "jp": "ja"}

#: One document in so many is never fitted on, so that accuracy can be measured.
HELD_OUT = 8

_SCRIPT = re.compile(r"<(script|style)(?![\w-])", re.IGNORECASE)


def visible(html: str) -> str:
    """What markup shows: tags, comments, scripts and styles are a space each; what never ends hides nothing but its mark.

    Each kind of end is searched from where the last search stopped, and not
    again once there is none, so the work is linear in the text.
    """
    out, at, lower, never = [], 0, html.lower(), set()

    def end_of(mark: str, start: int) -> int:
        if mark in never:
            return -1
        found = lower.find(mark, start)
        if found < 0:
            never.add(mark)
        return found

    while (tag := html.find("<", at)) >= 0:
        out.append(html[at:tag])
        kind = _SCRIPT.match(html, tag)
        if kind:
            close = end_of(f"</{kind[1].lower()}", tag)
            end = html.find(">", close) if close >= 0 else end_of(">", tag)
        elif html.startswith("<!--", tag):
            close = end_of("-->", tag + 4)
            end = close + 2 if close >= 0 else end_of(">", tag)
        else:
            end = end_of(">", tag)
        out.append(" " if end >= 0 else "<")
        at = end + 1 if end >= 0 else tag + 1
    out.append(html[at:])
    return "".join(out)


def trigrams(data, at):
    """Cells of all byte trigrams of lower-cased texts, and each text's first."""
    low = tk.LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    cells = ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = row[2:] == row[:-2]
    return cells[ok], np.searchsorted(row[:-2][ok], np.arange(len(at)))


def fit(texts: list[str], langs: list[str]) -> dict:
    """Log-likelihoods of trigrams for each language, and the languages in order."""
    names = sorted(set(langs))
    counts = np.full((len(names), CELLS), ADDED)
    which = np.array([names.index(x) for x in langs])
    for i, j, data, at in tk.chunks(pa.array(texts, pa.large_string())):
        cells, first = trigrams(data, at)
        for k in range(i, j):
            counts[which[k]] += np.bincount(cells[first[k - i] : first[k - i + 1]], minlength=CELLS)
    return {"names": names, "log": np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)}


def _likelihoods(held, markup: bool):
    def run(batches):
        model = held.value
        for batch in batches:
            text = batch.column(1)
            if markup:
                text = pa.array([visible(t.as_py() or "") for t in text], pa.large_string())
            out = np.zeros((len(text), len(model["names"])))
            for i, j, data, at in tk.chunks(text):
                cells, first = trigrams(data, at)
                n = np.diff(first)
                for k, log in enumerate(model["log"]):
                    sums = np.concatenate([[0.0], np.cumsum(log[cells], dtype=np.float64)])
                    out[i:j, k] = sums[first[1:]] - sums[first[:-1]]
                out[i:j] *= (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
            lists = pa.array(list(out), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists], ["row", *batch.schema.names[2:], "text_log"])

    return run


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT)) == 0


def train(docs: DataFrame) -> dict | None:
    """Fits on a bounded sample by hash of the documents that name a language; None without any."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    n = known.count()
    key = F.xxhash64("doc_id", F.length("text"))
    rows = known.where(F.pmod(key, F.lit(max(1, -(-n // FIT)))) == 0).orderBy("doc_id", "text").toArrow()
    if not rows.num_rows:
        return None
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(rows: DataFrame, model: dict | None, markup: bool = False) -> DataFrame:
    """Rows (row, text, host, declared) -> (row, lang, posterior, text_lang).

    Null or empty texts are decided by the other evidence; a null host shares
    the prior of all null hosts; a declaration or suffix of no known language
    says nothing; ties go to the first language by name; repeated rows are
    each identified and counted; an empty table gives no rows; without a model
    languages are null.
    """
    rows = scratch.columns(rows, "row", "text", "host", "declared")
    if model is None:
        return rows.select("row", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"))
    names = model["names"]
    held = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.select("row", "text", "host", "declared").mapInArrow(
        _likelihoods(held, markup), f"row {kind}, host string, declared string, text_log array<double>"
    )
    labels = F.split(F.lower("host"), r"\.")
    suffix = F.element_at(labels, -1)
    domain = F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), suffix)
    scored = scratch.table(scored.withColumns({"suffix": suffix, "domain": domain}), "likelihoods")
    logs = [F.col("text_log")[k] for k in range(len(names))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raw = [F.exp(x - top) for x in logs]
    whole = sum(raw[1:], raw[0])
    each = [f"p{k}" for k in range(len(names))]
    scored = scored.withColumns({p: x / whole for p, x in zip(each, raw)})
    levels = ("suffix", "domain", "host")
    sums = [F.sum(p).alias(p) for p in each]
    by_host = scratch.table(scored.groupBy(*levels).agg(*sums, F.count("*").alias("n")), "hosts")
    total = by_host.agg(*[F.sum(p) for p in each], F.sum("n")).first()
    n = total[-1] or 0
    base = [((total[k] or 0.0) + SMOOTH / len(names)) / (n + SMOOTH) for k in range(len(names))]
    # Of each host its own counts, its domain's and its suffix's.
    hosts = by_host.select(*levels)
    for level in levels:
        own = by_host.groupBy(level).agg(*[F.sum(c).alias(f"{level}_{c}") for c in (*each, "n")]).withColumnRenamed(level, "_key")
        hosts = hosts.join(own, hosts[level].eqNullSafe(own["_key"])).drop("_key")
    hosts = scratch.table(hosts.withColumnRenamed("host", "_host").drop("domain", "suffix"), "priors")
    joined = scored.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    prior = [F.lit(b) for b in base]
    for level in levels:
        # A row's own text says nothing about its prior.
        rest = F.col(f"{level}_n") - 1 + SMOOTH
        joined = joined.withColumns({f"_{level}{k}": (F.greatest(F.col(f"{level}_{p}") - F.col(p), F.lit(0.0)) + SMOOTH * prior[k]) / rest for k, p in enumerate(each)})
        prior = [F.col(f"_{level}{k}") for k in range(len(names))]
    nation = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])[F.coalesce("suffix", F.lit(""))]
    declared = F.lower(F.substring("declared", 1, 2))
    wrong = max(1, len(names) - 1)

    def says(named, right: float, lang: str):
        odds = F.when(named == lang, right).otherwise((1 - right) / wrong)
        return F.when(named.isin(names), F.log(odds)).otherwise(F.lit(0.0))

    logs = [
        F.col("text_log")[k] + F.log(prior[k]) + says(declared, DECLARED, lang) + says(nation, SUFFIX, lang) for k, lang in enumerate(names)
    ]
    joined = joined.withColumn("log", F.array(*logs)).withColumn("most", F.array_max("log"))
    total = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    known = F.array(*[F.lit(x) for x in names])
    first = lambda values, top: F.element_at(known, F.array_position(values, top).cast("int"))
    text_lang = first(F.col("text_log"), F.array_max("text_log"))
    return joined.select("row", first(F.col("log"), F.col("most")).alias("lang"), (1 / total).alias("posterior"), text_lang.alias("text_lang"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents (a source is their host) and pages, each by its own evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = train(docs)
    plain = docs.select(F.col("doc_id").alias("row"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("declared"))
    url_host = F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    marked = pages.select(F.col("page_id").alias("row"), F.col("html").alias("text"), F.when(url_host != "", url_host).alias("host"), F.when(lang != "", lang).alias("declared"))
    none = F.lit(None).cast("long")
    a = identify(plain, model).select(F.col("row").alias("doc_id"), none.alias("page_id"), "lang", "posterior", "text_lang")
    b = identify(marked, model, markup=True).select(none.alias("doc_id"), F.col("row").alias("page_id"), "lang", "posterior", "text_lang")
    return a.unionByName(b)
