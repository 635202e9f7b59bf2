"""Queries of culling and of the comparison of renders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cull, fidelity
from ..sources.adapters import SIGNALS_SQL, signals
from .common import ORACLES, QUERIES, RGB, pixel_query, table_query
from .filters import ENDS, alpha_query

LUM = ENDS + ", lum AS (SELECT img, x, y, floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5 + 0.000000001)::INT AS l FROM px)"
pixel_query("cull_luminance", cull.luminance, "SELECT img, x, y, l AS lum FROM lum", LUM)


def blocks(n: int, m: int) -> str:
    """Means of n by m blocks, by maps from places to blocks."""
    one = lambda c, size, k: f"(SELECT img, c, p FROM (SELECT img, {size}, unnest(range({k})) AS c FROM ends) a, (SELECT unnest(range(200)) AS p) b WHERE p < {size} AND p >= floor(c * {size} / {k}.0::DOUBLE) AND p < greatest(floor(c * {size} / {k}.0::DOUBLE) + 1, least({size}, floor((c + 1) * {size} / {k}.0::DOUBLE))))"
    return LUM + f", mx AS {one('x', 'w', n)}, my AS {one('y', 'h', m)}, small AS (SELECT l.img, mx.c AS x, my.c AS y, avg(l) AS v FROM lum l JOIN mx ON mx.img = l.img AND mx.p = l.x JOIN my ON my.img = l.img AND my.p = l.y GROUP BY ALL)"


pixel_query("cull_resample", lambda px: cull.resample(cull.luminance(px), 9, 8).withColumn("v", F.round("v", 9)), "SELECT img, x::INT AS x, y::INT AS y, round(v, 9) AS v FROM small", blocks(9, 8))
_SHARP = LUM + """, lap AS (SELECT img, x, y, lag(l) OVER r + lead(l) OVER r + lag(l) OVER c + lead(l) OVER c - 4 * l AS q FROM lum WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
tiles AS (SELECT img, least(3, floor((y - 1) / ((h - 2) / 4.0::DOUBLE))) * 4 + least(3, floor((x - 1) / ((w - 2) / 4.0::DOUBLE))) AS t, var_pop(q) AS v FROM lap JOIN ends USING (img) WHERE q IS NOT NULL AND w >= 8 AND h >= 8 GROUP BY ALL),
top AS (SELECT img, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, t) AS k FROM tiles) WHERE k <= 3 GROUP BY img),
sharp AS (SELECT img, round(coalesce(t.v / greatest(25, var_pop(l)) * 100, 0), 6) AS sharpness FROM lum LEFT JOIN top t USING (img) GROUP BY img, t.v)"""
pixel_query("cull_sharpness", lambda px: cull.sharpness(cull.luminance(px)).withColumn("sharpness", F.round("sharpness", 6)), "SELECT * FROM sharp", _SHARP)
_EXPOSED = "SELECT img, round(avg(l) / 255, 9) AS mean, round(avg((l <= 4)::INT), 9) AS clip_low, round(avg((l >= 251)::INT), 9) AS clip_high FROM lum GROUP BY img"
_rounded = lambda df, *names: df.withColumns({c: F.round(c, 9) for c in names})
pixel_query("cull_exposure", lambda px: _rounded(cull.exposure(cull.luminance(px)), "mean", "clip_low", "clip_high"), _EXPOSED, LUM)
_SIGNED = "(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END)::BIGINT"
_POW = "sum(CASE WHEN {0} THEN CASE WHEN y * 8 + x = 0 THEN 9223372036854775808::HUGEINT ELSE (1::BIGINT << (63 - y * 8 - x)::INT)::HUGEINT END ELSE 0 END)"
_DHASH = blocks(9, 8) + ", g AS (SELECT *, lead(v) OVER (PARTITION BY img, y ORDER BY x) AS n FROM small), dh AS (SELECT img, " + _POW.format("v > n") + " AS u FROM g WHERE x < 8 GROUP BY img)"
pixel_query("cull_dhash", lambda px: cull.d_hash(cull.luminance(px)), f"SELECT img, {_SIGNED.format('u')} AS dhash FROM dh", _DHASH)
_PHASH = blocks(32, 32) + """, rw AS (SELECT img, y, u, sum(v * cos((2 * x + 1) * u * pi() / 64)) AS v FROM small, (SELECT unnest(range(8)) AS u) k GROUP BY ALL),
cf AS (SELECT img, t AS y, u AS x, sum(v * cos((2 * y + 1) * t * pi() / 64)) AS v FROM rw, (SELECT unnest(range(8)) AS t) k GROUP BY img, t, u),
md AS (SELECT img, median(v) AS m FROM (SELECT img, v FROM cf WHERE x + y > 0 UNION ALL SELECT img, max(v) FROM cf WHERE x + y > 0 GROUP BY img) GROUP BY img),
ph AS (SELECT img, """ + _POW.format("v > m") + " AS u FROM cf JOIN md USING (img) GROUP BY img)"
pixel_query("cull_phash", lambda px: cull.p_hash(cull.luminance(px)), f"SELECT img, {_SIGNED.format('u')} AS phash FROM ph", _PHASH)


def _signal_query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(signals(spark, sf_dir))
    ORACLES[name] = f"WITH RECURSIVE {SIGNALS_SQL}{sql}"


_signal_query(
    "cull_exposure_badge", lambda s: s.select("path", cull.exposure_badge(F.col("mean"), F.col("clip_low"), F.col("clip_high")).alias("badge")),
    " SELECT path, CASE WHEN mean > 0.86::DOUBLE OR (clip_high > 0.12::DOUBLE AND mean > 0.5) THEN 'over' WHEN mean < 0.09::DOUBLE OR (clip_low > 0.25 AND mean < 0.25) THEN 'under' END AS badge FROM s",
)
_signal_query(
    "cull_hamming", lambda s: s.select("path", cull.hamming(F.col("dhash"), F.col("phash")).alias("apart")), " SELECT path, bit_count(xor(dhash, phash))::INT AS apart FROM s",
)
_GROUPS = """, n AS (SELECT dhash, phash, min(path) AS node FROM s GROUP BY ALL),
pr AS (SELECT a.node AS a, b.node AS b, a.dhash AS ad, a.phash AS ap, b.dhash AS bd, b.phash AS bp, bit_count(xor(a.dhash, b.dhash)) AS d, bit_count(xor(a.phash, b.phash)) AS p FROM n a JOIN n b ON a.node < b.node),
cd AS (SELECT * FROM pr WHERE d <= 12 AND p <= 14),
ed AS (SELECT DISTINCT c.a, c.b FROM cd c JOIN s x ON x.dhash = c.ad AND x.phash = c.ap JOIN s y ON y.dhash = c.bd AND y.phash = c.bp
  WHERE x.capture IS NULL OR y.capture IS NULL OR abs(x.capture - y.capture) <= 300000 OR (d <= 6 AND p <= 7)),
rc AS (SELECT node AS x, node AS y FROM n UNION SELECT rc.x, e.t FROM rc JOIN (SELECT a AS f, b AS t FROM ed UNION ALL SELECT b, a FROM ed) e ON e.f = rc.y),
gr AS (SELECT x AS node, min(y) AS "group" FROM rc GROUP BY x),
nm AS (SELECT path, "group" FROM s JOIN n USING (dhash, phash) JOIN gr USING (node)),
dup AS (SELECT path, "group" FROM nm WHERE "group" IN (SELECT "group" FROM nm GROUP BY 1 HAVING count(*) > 1))"""
_signal_query("cull_duplicates", lambda s: cull.duplicates(s), f'{_GROUPS} SELECT path, "group" FROM dup')
_JUDGE = """, cm AS (SELECT coalesce(camera::VARCHAR, '') AS cam, median(sharpness) AS own, count(*) AS n FROM s GROUP BY 1),
j0 AS (SELECT s.*, CASE WHEN n >= 3 THEN own ELSE (SELECT median(sharpness) FROM s) END AS ref FROM s JOIN cm ON cam = coalesce(camera::VARCHAR, '')),
j1 AS (SELECT *, CASE WHEN ref > 0 THEN sharpness / ref ELSE 1 END AS rel FROM j0),
j2 AS (SELECT *, sharpness < 6 OR (rel < 0.3::DOUBLE AND sharpness < 24) AS soft,
  CASE WHEN mean > 0.86::DOUBLE OR (clip_high > 0.12::DOUBLE AND mean > 0.5) THEN 'over' WHEN mean < 0.09::DOUBLE OR (clip_low > 0.25 AND mean < 0.25) THEN 'under' END AS exp FROM j1),
j3 AS (SELECT *, least(1, greatest(0, 0.75 * least(1, greatest(0, ln(1 + sharpness) / ln(1 + greatest(ref, 6) * 2))) + 0.25
  - least(0.5, clip_high * 2 + clip_low * 1.5 + greatest(0, abs(mean - 0.46::DOUBLE) - 0.2::DOUBLE)) - CASE WHEN eyes_closed > 0 AND faces > 0 THEN 0.35::DOUBLE * eyes_closed / faces ELSE 0 END
  - CASE WHEN soft THEN 0.2::DOUBLE ELSE 0 END)) AS score, concat_ws(' ', CASE WHEN soft THEN 'blurry' END, CASE WHEN eyes_closed > 0 THEN 'eyes-closed' END, exp) AS b FROM j2)"""
_shown = lambda j: j.select("path", F.round("relative", 6).alias("relative"), F.round("score", 6).alias("score"), F.concat_ws(" ", "badges").alias("badges"))
_signal_query("cull_judge", lambda s: _shown(cull.judge(s)), f"{_JUDGE} SELECT path, round(rel, 6) AS relative, round(score, 6) AS score, b AS badges FROM j3")
_BEST = _GROUPS + _JUDGE + """, jg AS (SELECT j3.*, "group" FROM j3 LEFT JOIN dup USING (path)),
tp AS (SELECT "group", coalesce(max(sharpness) FILTER (exp IS NULL), max(sharpness)) AS top FROM jg WHERE "group" IS NOT NULL GROUP BY 1),
rk AS (SELECT path, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, path) = 1 AS best FROM jg WHERE "group" IS NOT NULL),
jb AS (SELECT jg.path, "group", coalesce(best, false) AS best, concat_ws(' ', nullif(b, ''), CASE WHEN "group" IS NOT NULL THEN 'duplicate' END, CASE WHEN "group" IS NOT NULL AND sharpness < 0.4::DOUBLE * top AND NOT soft THEN 'blurry' END) AS badges
  FROM jg LEFT JOIN tp USING ("group") LEFT JOIN rk USING (path))"""
_signal_query("cull_best", lambda s: cull.judge(s, cull.duplicates(s)).select("path", "group", "best", F.concat_ws(" ", "badges").alias("badges")), f"{_BEST} SELECT * FROM jb")
_marks = lambda s: s.select("path", (F.col("path") % 3 - 1).cast("int").alias("flag"))
_signal_query(
    "cull_rejects", lambda s: cull.rejects(cull.judge(s, cull.duplicates(s)), _marks(s), True),
    f"""{_BEST} SELECT path FROM jb WHERE path % 3 = 1 AND (badges LIKE '%blurry%' OR badges LIKE '%eyes%' OR badges LIKE '%over%' OR badges LIKE '%under%' OR ("group" IS NOT NULL AND NOT best))""",
)


def _mirrored(px):
    """A second render: the raster with its columns swapped in pairs."""
    return px.withColumn("x", F.when(F.col("x") % 2 == 0, F.col("x") + 1).otherwise(F.col("x") - 1))


_WHITE = lambda p: [f"({p}.{c} * ({p}.a / 255.0::DOUBLE) + 255 * (1 - {p}.a / 255.0::DOUBLE))" for c in RGB]
_DIFF = ", df AS (SELECT p.img, (" + " + ".join(f"abs({a} - {b})" for a, b in zip(_WHITE("p"), _WHITE("q"))) + ") / 3 AS d FROM pa p JOIN pa q ON q.img = p.img AND q.y = p.y AND q.x = CASE WHEN p.x % 2 = 0 THEN p.x + 1 ELSE p.x - 1 END)"
_METRIC = _DIFF + """, bn AS (SELECT img, least(floor(d / 255 * 4096 + 0.000000001), 4096) AS bin, count(*) AS n, sum(d) AS s FROM df GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY bin ROWS UNBOUNDED PRECEDING) AS below, sum(n) OVER (PARTITION BY img) AS total FROM bn),
mt AS (SELECT img, round(sum(s) / max(total), 6) AS mae, round(min(bin) FILTER (below >= ceil(total * 0.95::DOUBLE)) * 255 / 4096.0::DOUBLE, 6) AS p95 FROM cu GROUP BY img)"""


def _metrics(px):
    return _rounded6(fidelity.metrics(fidelity.aligned(px, _mirrored(px))))


def _rounded6(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mae", "p95")})


alpha_query("compare_metrics", _metrics, "SELECT * FROM mt", _METRIC)


def _outcome_query(name: str, make, sql: str) -> None:
    """On errors made from events: value over ten, minus a little, in place of renders."""
    QUERIES[name] = lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("img"), F.round(F.col("value") / 10 - 0.4, 6).alias("mae")))
    ORACLES[name] = f"WITH o AS (SELECT event_id AS img, round(value / 10 - 0.4::DOUBLE, 6) AS mae FROM events) {sql}"


_VERDICT = "CASE WHEN mae > 10 THEN 'over' WHEN mae <= 0 THEN 'exact' WHEN mae <= 1 THEN 'within1' WHEN mae <= 3 THEN 'within3' ELSE 'within10' END"
_outcome_query("compare_classify", lambda o: o.select("img", fidelity.classify(F.col("mae")).alias("verdict")), f"SELECT img, {_VERDICT} AS verdict FROM o")
_outcome_query("compare_error_histogram", fidelity.error_histogram, "SELECT CASE WHEN mae <= 0 THEN 0 ELSE least(31, floor(mae / 0.5)) END::INT AS bucket, count(*) AS n FROM o GROUP BY 1")
_outcome_query("compare_tally", fidelity.tally, f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM o GROUP BY 1")
_outcome_query("compare_worst", fidelity.worst, "SELECT img, mae FROM o ORDER BY mae DESC, img LIMIT 5")
_GRID = ENDS + ", wh AS (SELECT p.img, floor(x * 16 / w::DOUBLE)::INT AS gx, floor(y * 16 / h::DOUBLE)::INT AS gy, " + ", ".join(f"{v} AS {c}" for v, c in zip(_WHITE("p"), RGB)) + " FROM pa p JOIN ends USING (img))"
alpha_query(
    "compare_grid", lambda px: fidelity.grid(px).withColumns({c: F.round(c, 6) for c in RGB}),
    "SELECT img, gx, gy, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in RGB) + " FROM wh GROUP BY ALL", _GRID,
)


def _sidecars(read):
    """Sidecars written from events: attributes or elements, some rejected, some without marks."""
    from ..sources.formats import marks_of, sidecar_name

    i = F.col("event_id")
    rating = F.when(i % 7 == 0, -1).otherwise((i % 8).cast("int"))
    body = F.when(
        i % 2 == 0, F.format_string('<rdf:Description xmp:Rating="%d" xmp:Label="%s" ops:Pick = "%d" ops:Stars="3"/>', rating, F.element_at(F.array(F.lit("Red"), F.lit(" green "), F.lit("Pink")), (i % 3 + 1).cast("int")), (i % 5 - 2).cast("int"))
    ).otherwise(F.format_string("<xmp:Rating>%d</xmp:Rating>", rating))
    xml = F.when(i % 11 == 0, "<x:xmpmeta/>").when(i % 13 == 0, body).otherwise(F.concat(F.lit("<x:xmpmeta>\n"), body, F.lit("\n</x:xmpmeta>")))
    name = F.when(i % 3 == 0, F.concat(F.lit(".hidden"), i.cast("string"))).otherwise(F.concat(F.lit("a.b"), i.cast("string"), F.lit(".jpg")))
    rows = read("events").select(sidecar_name(name).alias("name"), marks_of(xml).alias("m")).where("m IS NOT NULL")
    return rows.select("name", "m.*")


table_query(
    "cull_sidecars", _sidecars,
    """WITH e AS (SELECT event_id AS i, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 8 END AS r FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
       SELECT CASE WHEN i % 3 = 0 THEN '.hidden' || i ELSE 'a.b' || i END || '.xmp' AS name,
         (CASE WHEN r >= 0 THEN least(5, r) WHEN i % 2 = 0 THEN 3 ELSE 0 END)::INT AS rating,
         (CASE WHEN r < 0 THEN -1 WHEN i % 2 = 0 THEN sign(i % 5 - 2) ELSE 0 END)::INT AS flag,
         (CASE WHEN i % 2 = 0 THEN CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END ELSE 0 END)::INT AS label FROM e""",
)
