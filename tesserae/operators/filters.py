"""Filters of whole rasters: rows (img, x, y, r, g, b[, a]) with levels 0..255, every place of an image present.

Neighbourhoods are window functions along rows, then along columns, so a
filter of any size is two shuffles on (img, row) and (img, column); beyond the
canvas its edge repeats.  Filters that mix colours weigh them by alpha where
there is any.  Distortions sample the source at computed places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tone
from ..functions.blend import TIE, _unit
from .raster import sized

RGB = ("r", "g", "b")


def to_level(v: Column) -> Column:
    """Nearest level, halves up."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)) + (0.5 + TIE)).cast("int")


def _out(px: DataFrame, channels: dict) -> DataFrame:
    """The rows with new levels; alpha, if there is any and it is not given, stays."""
    rest = [F.col("a")] if "a" in px.columns and "a" not in channels else []
    return px.select("img", "x", "y", *[v.alias(c) for c, v in channels.items()], *rest)


def _taps(columns, reach: int, line: str, along: str) -> dict:
    """For each column its values ``-reach`` to ``reach`` places along a line, the ends repeated."""
    place = Window.partitionBy("img", line).orderBy(along)
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c, k: F.col(c) if k == 0 else F.coalesce(F.lag(c, -k).over(place), F.first(c).over(whole)) if k < 0 else F.coalesce(F.lead(c, k).over(place), F.last(c).over(whole))
    return {c: [at(c, k) for k in range(-reach, reach + 1)] for c in columns}


def convolved(px: DataFrame, columns, weights, line: str, along: str) -> DataFrame:
    """Weighted sums along a line; ``weights`` has an odd length."""
    taps = _taps(columns, len(weights) // 2, line, along)
    px = px.withColumns({f"_t{k}_{c}": v for c in columns for k, v in enumerate(taps[c])})
    out = {c: sum((F.col(f"_t{k}_{c}") * w for k, w in enumerate(weights)), F.lit(0.0)) for c in columns}
    return px.withColumns(out).drop(*[f"_t{k}_{c}" for c in columns for k in range(len(weights))])


def square(px: DataFrame, columns, reach: int) -> tuple[DataFrame, dict]:
    """The rows with a column for each neighbour in a square, and their names by (column, dx, dy)."""
    side = range(-reach, reach + 1)
    taps = _taps(columns, reach, "y", "x")
    px = px.withColumns({f"_h{dx + reach}_{c}": taps[c][dx + reach] for c in columns for dx in side})
    names = [f"_h{dx + reach}_{c}" for c in columns for dx in side]
    taps = _taps(names, reach, "x", "y")
    px = px.withColumns({f"_v{dy + reach}{n}": taps[n][dy + reach] for n in names for dy in side}).drop(*names)
    return px, {(c, dx, dy): F.col(f"_v{dy + reach}_h{dx + reach}_{c}") for c in columns for dx in side for dy in side}


def weighed(px: DataFrame, change) -> DataFrame:
    """``change`` on columns _r.._a that hold colour times alpha, and back to levels; opaque rasters have no alpha to weigh by."""
    if "a" not in px.columns:
        px = change(px.withColumns({f"_{c}": F.col(c).cast("double") for c in RGB}), [f"_{c}" for c in RGB])
        return _out(px, {c: to_level(F.col(f"_{c}")) for c in RGB})
    px = px.withColumns({f"_{c}": F.col(c) * F.col("a") / 255.0 for c in RGB} | {"_a": F.col("a").cast("double")})
    px = change(px, ["_r", "_g", "_b", "_a"])
    alpha = F.nullif(F.col("_a"), F.lit(0.0))
    return _out(px, {c: F.coalesce(to_level(F.col(f"_{c}") * 255.0 / alpha), F.lit(0)) for c in RGB} | {"a": to_level(F.col("_a"))})


def gaussian_weights(sigma: float) -> list[float]:
    reach = math.ceil(3 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [v / sum(raw) for v in raw]


def _wide(px, columns, sigma: float, line: str, along: str) -> DataFrame:
    """One pass of the extended box filter whose variance is a quarter of the Gaussian's: a box with part of one more place at either end."""
    s2 = sigma * sigma / 4
    r = int((math.sqrt(1 + 12 * s2) - 1) / 2)
    part = min(1.0, max(0.0, (2 * r + 1) * (r * (r + 1) - 3 * s2) / (6 * (s2 - (r + 1) ** 2))))
    place = Window.partitionBy("img", line).orderBy(along)
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = px.withColumns({"_i": F.row_number().over(place) - 1, "_n": F.count("*").over(whole)})
    ends = ends.withColumns({"_lo": F.greatest(F.lit(0), r - F.col("_i")), "_hi": F.greatest(F.lit(0), r - (F.col("_n") - 1 - F.col("_i")))})
    near = place.rowsBetween(-r, r)

    def one(c):
        first, last = F.first(c).over(whole), F.last(c).over(whole)
        box = F.sum(c).over(near) + first * F.col("_lo") + last * F.col("_hi")
        tails = F.coalesce(F.lag(c, r + 1).over(place), first) + F.coalesce(F.lead(c, r + 1).over(place), last)
        return (box + part * tails) / (2 * r + 1 + 2 * part)

    return ends.withColumns({c: one(c) for c in columns}).drop("_i", "_n", "_lo", "_hi")


def gaussian(px: DataFrame, columns, sigma: float) -> DataFrame:
    """Blurred columns: the sampled kernel below a deviation of 2.5, beyond it four passes of extended boxes of the same variance."""
    if sigma < 0.05:
        return px
    if sigma < 2.5:
        for line, along in (("y", "x"), ("x", "y")):
            px = convolved(px, columns, gaussian_weights(sigma), line, along)
        return px
    for _ in range(4):
        for line, along in (("y", "x"), ("x", "y")):
            px = _wide(px, columns, sigma, line, along)
    return px


def gaussian_blur(px, radius: float):
    return weighed(px, lambda p, columns: gaussian(p, columns, radius))


def _blurred(px, radius: float) -> DataFrame:
    """The rows with _r, _g, _b blurred, weighed by alpha."""
    if "a" not in px.columns:
        return gaussian(px.withColumns({f"_{c}": F.col(c).cast("double") for c in RGB}), [f"_{c}" for c in RGB], radius)
    px = px.withColumns({f"_{c}": F.col(c) * F.col("a") / 255.0 for c in RGB} | {"_a": F.col("a") / 255.0})
    px = gaussian(px, ["_r", "_g", "_b", "_a"], radius)
    return px.withColumns({f"_{c}": F.when(F.col("_a") > 1e-4, F.col(f"_{c}") / F.col("_a")).otherwise(0.0) for c in RGB})


def unsharp_mask(px, amount: float, radius: float, threshold: float = 0.0):
    if amount <= 0 or radius <= 0:
        return px
    apart = lambda c: F.col(c) - F.col(f"_{c}")
    new = lambda c: to_level(F.when(F.abs(apart(c)) >= threshold, F.col(c) + amount / 100 * apart(c)).otherwise(F.col(c)))
    return _out(_blurred(px, radius), {c: new(c) for c in RGB})


def high_pass(px, radius: float):
    if radius <= 0:
        return _out(px, {c: F.lit(128) for c in RGB})
    return _out(_blurred(px, radius), {c: to_level(F.col(c) - F.col(f"_{c}") + 128) for c in RGB})


def frequency_separation(px, radius: float):
    """Adds low_* and high_*: a blur whose distance from the original is odd, and the halved rest; linear light of both gives the original back."""
    low = gaussian_blur(px, radius).select("img", "x", "y", *[F.col(c).alias(f"low_{c}") for c in RGB])
    px = px.join(low, ["img", "x", "y"])
    even = lambda c: (F.col(c) - F.col(f"low_{c}")) % 2 == 0
    px = px.withColumns({f"low_{c}": F.when(even(c) & (F.col(f"low_{c}") < 255), F.col(f"low_{c}") + 1).when(even(c), F.col(f"low_{c}") - 1).otherwise(F.col(f"low_{c}")) for c in RGB})
    return px.withColumns({f"high_{c}": F.floor((F.col(c) - F.col(f"low_{c}") + 255) / 2).cast("int") for c in RGB})


def custom(px, kernel, scale: float = 1.0, offset: float = 0.0):
    """An odd square of weights, by rows; the weighted sum over ``scale`` plus ``offset``."""
    side = math.isqrt(len(kernel))
    reach = side // 2
    columns = RGB if "a" not in px.columns else (*RGB, "a")
    if "a" in columns:
        px = px.withColumns({f"_{c}": F.col(c) * F.col("a") / 255.0 for c in RGB} | {"_a": F.col("a").cast("double")})
    else:
        px = px.withColumns({f"_{c}": F.col(c).cast("double") for c in RGB})
    px, at = square(px, [f"_{c}" for c in columns], reach)
    total = {c: sum((at[(f"_{c}", dx, dy)] * float(w) for (dy, dx), w in zip(((j, i) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1)), kernel) if w), F.lit(0.0)) for c in columns}
    if "a" not in columns:
        return _out(px, {c: to_level(total[c] / scale + offset) for c in RGB})
    px = px.withColumn("_o", F.least(F.lit(255.0), F.greatest(F.lit(0.0), total["a"] / scale)))
    mixed = lambda c: F.least(F.col("_o"), F.greatest(F.lit(0.0), total[c] / scale + offset * F.col("_o") / 255.0))
    return _out(px, {c: F.coalesce(to_level(mixed(c) * 255.0 / F.nullif(F.col("_o"), F.lit(0.0))), F.lit(0)) for c in RGB} | {"a": to_level(F.col("_o"))})


def median(px, radius: int, threshold: float | None = None):
    """The median of a square, of alpha too; with a threshold only where it is further than that from the pixel (dust and scratches)."""
    columns = [c for c in (*RGB, "a") if c in px.columns]
    px, at = square(px, columns, radius)
    side = range(-radius, radius + 1)
    middle = (2 * radius + 1) ** 2 // 2 + 1
    found = {c: F.element_at(F.array_sort(F.array(*[at[(c, dx, dy)] for dx in side for dy in side])), middle) for c in columns}
    if threshold is not None:
        found = {c: F.when(F.abs(F.col(c) - v) > threshold, v).otherwise(F.col(c)) for c, v in found.items()}
    return _out(px, {c: v.cast("int") for c, v in found.items()})


def find_edges(px):
    """Dark lines on white: each channel's gradient by Sobel, halved."""
    px, at = square(px, list(RGB), 1)

    def one(c):
        gx = sum((at[(c, 1, k)] * w - at[(c, -1, k)] * w for k, w in ((-1, 1), (0, 2), (1, 1))), F.lit(0))
        gy = sum((at[(c, k, 1)] * w - at[(c, k, -1)] * w for k, w in ((-1, 1), (0, 2), (1, 1))), F.lit(0))
        return to_level(255 - F.sqrt(gx * gx + gy * gy) / 2)

    return _out(px, {c: one(c) for c in RGB})


def emboss(px, angle: float, height: float, amount: float):
    """Grey where flat: the difference of samples towards the light and away from it."""
    turn = math.radians(angle)
    dx, dy = math.cos(turn) * height / 2, -math.sin(turn) * height / 2
    px, at = square(px, list(RGB), math.ceil(max(abs(dx), abs(dy))) + 1)

    def sample(c, ox, oy):
        x0, y0 = math.floor(ox), math.floor(oy)
        tx, ty = ox - x0, oy - y0
        top = at[(c, x0, y0)] + (at[(c, x0 + 1, y0)] - at[(c, x0, y0)]) * tx
        low = at[(c, x0, y0 + 1)] + (at[(c, x0 + 1, y0 + 1)] - at[(c, x0, y0 + 1)]) * tx
        return top + (low - top) * ty

    return _out(px, {c: to_level(128 + (sample(c, dx, dy) - sample(c, -dx, -dy)) * (amount / 100)) for c in RGB})


def surface_blur(px, radius: int, threshold: float):
    """A mean in which neighbours count less the further their level is, none beyond two and a half thresholds."""
    reach = 2.5 * min(255.0, max(1.0, threshold))
    px, at = square(px, list(RGB), radius)
    side = range(-radius, radius + 1)

    def one(c):
        weight = lambda v: F.greatest(F.lit(0.0), 1 - F.abs(v - F.col(c)) / reach)
        near = F.array(*[F.struct(weight(at[(c, dx, dy)]).alias("w"), (at[(c, dx, dy)] - F.col(c)).alias("d")) for dx in side for dy in side])
        both = F.aggregate(near, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("d")), lambda s, v: F.struct((s["w"] + v["w"]).alias("w"), (s["d"] + v["w"] * v["d"]).alias("d")))
        return to_level(F.col(c) + both["d"] / both["w"])

    return _out(px, {c: one(c) for c in RGB})


def solarize(px):
    return _out(px, {c: F.when(F.col(c) > 127, 255 - F.col(c)).otherwise(F.col(c)) for c in RGB})


def invert(px):
    return _out(px, {c: 255 - F.col(c) for c in RGB})


def desaturate(px):
    grey = F.ceil((F.greatest(*RGB) + F.least(*RGB)) / 2).cast("int")
    return _out(px, {c: grey for c in RGB})


def apply_adjustment(px, kind: str, **settings):
    """Any adjustment, destructively; alpha stays."""
    px = tone.apply(px.withColumns({c: F.col(c) / 255.0 for c in RGB}), kind, **settings)
    return _out(px, {c: to_level(F.col(c) * 255.0) for c in RGB})


def _sized(px: DataFrame) -> DataFrame:
    """The rows with their image's _w and _h; one row an image."""
    return px.join(F.broadcast(sized(px).select("img", F.col("w").alias("_w"), F.col("h").alias("_h"))), "img")


def offset(px, dx: int, dy: int, wrap: bool = True):
    """Shifted; what leaves one edge comes back on the other, or the place left is transparent black."""
    px = _sized(px)
    moved = [F.col("x") + dx, F.col("y") + dy]
    if wrap:
        return px.select("img", F.pmod(moved[0], "_w").cast("int").alias("x"), F.pmod(moved[1], "_h").cast("int").alias("y"), *[c for c in (*RGB, "a") if c in px.columns])
    gone = (F.col("x") < dx) | (F.col("y") < dy) | (F.col("x") >= F.col("_w") + dx) | (F.col("y") >= F.col("_h") + dy)
    rows = px.select("img", (F.pmod(moved[0], "_w")).cast("int").alias("x"), (F.pmod(moved[1], "_h")).cast("int").alias("y"), "_w", "_h", *RGB, (F.col("a") if "a" in px.columns else F.lit(255)).alias("a"))
    return rows.select("img", "x", "y", *[F.when(gone, 0).otherwise(F.col(c)).alias(c) for c in (*RGB, "a")])


def vignette(px, amount: float, midpoint: float = 50.0, feather: float = 50.0):
    """Darker (in linear light) or lighter corners."""
    px = _sized(px)
    nx, ny = (F.col("x") + 0.5 - F.col("_w") / 2) / (F.col("_w") / 2), (F.col("y") + 0.5 - F.col("_h") / 2) / (F.col("_h") / 2)
    far = F.sqrt((nx * nx + ny * ny) / 2)
    start, width, a = 0.15 + 0.75 * midpoint / 100, 0.05 + 0.9 * feather / 100, amount / 100
    px = px.withColumn("_t", _unit((far - start) / width)).withColumn("_s", F.col("_t") * F.col("_t") * (3 - 2 * F.col("_t")))

    def one(c):
        if a < 0:
            new = tone.from_linear(tone.to_linear(F.col(c) / 255.0) * (1 + a * F.col("_s"))) * 255.0
        else:
            new = F.col(c) + (255.0 - F.col(c)) * a * F.col("_s")
        return F.when(F.col("_s") <= 0, F.col(c)).otherwise(to_level(new))

    return _out(px, {c: one(c) for c in RGB})


def warp(px, u: Column, v: Column, where: Column | None = None):
    """Each place takes the bilinear sample of the source at (u, v), in pixels with centres at halves; elsewhere than ``where`` it stays.

    The source's places bring their right and lower neighbours along, so a
    place that moves asks for one row, and the join is as large as the raster;
    it is never broadcast, since rasters are far larger than their tables.
    """
    rows = _sized(px)
    alpha = F.col("a") if "a" in px.columns else F.lit(255)
    mixed = {f"_{c}": F.col(c) * alpha / 255.0 for c in RGB} | {"_a": alpha.cast("double")}
    names = list(mixed)

    def levels(total):
        out = {c: F.coalesce(to_level(total[f"_{c}"] * 255.0 / F.nullif(total["_a"], F.lit(0.0))), F.lit(0)) for c in RGB}
        if "a" in px.columns:
            out["a"] = to_level(total["_a"])
        return [v.alias(c) for c, v in out.items()]

    clamped = lambda c, size: F.least(F.greatest(c - 0.5, F.lit(0.0)), F.col(size) - 1.0)
    moved = rows if where is None else rows.where(where)
    moved = moved.select("img", "x", "y", clamped(u, "_w").alias("_u"), clamped(v, "_h").alias("_v"))
    moved = moved.withColumns({"sx": F.floor("_u").cast("int"), "sy": F.floor("_v").cast("int")})
    # Beyond the last column or row the weight is 0.
    source = px.select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), *[v.alias(c) for c, v in mixed.items()])
    right, below = Window.partitionBy("img", "sy").orderBy("sx"), Window.partitionBy("img", "sx").orderBy("sy")
    source = source.withColumns({f"{c}10": F.coalesce(F.lead(c).over(right), F.col(c)) for c in names})
    source = source.withColumns({f"{c}{i}1": F.coalesce(F.lead(f).over(below), F.col(f)) for c in names for i, f in ((0, c), (1, f"{c}10"))})
    tx, ty = F.col("_u") - F.col("sx"), F.col("_v") - F.col("sy")
    at = lambda c: F.col(c) * ((1 - tx) * (1 - ty)) + F.col(f"{c}01") * ((1 - tx) * ty) + F.col(f"{c}10") * (tx * (1 - ty)) + F.col(f"{c}11") * (tx * ty)
    out = moved.join(source.hint("merge"), ["img", "sx", "sy"]).select("img", "x", "y", *levels({c: at(c) for c in names}))
    if where is None:
        return out
    return out.unionByName(rows.where(~F.coalesce(where, F.lit(False))).select("img", "x", "y", *levels(mixed)))


def _about() -> tuple:
    """A place's distance from the middle, by axes and over the inscribed circle's radius."""
    dx, dy = F.col("x") + 0.5 - F.col("_w") / 2, F.col("y") + 0.5 - F.col("_h") / 2
    return dx, dy, F.sqrt(dx * dx + dy * dy) / (F.least("_w", "_h") / 2)


def twirl(px, angle: float):
    """A turn that fades from the middle to the inscribed circle."""
    dx, dy, d = _about()
    t = (1 - d) * (1 - d) * math.radians(angle)
    return warp(px, F.col("_w") / 2 + dx * F.cos(t) - dy * F.sin(t), F.col("_h") / 2 + dx * F.sin(t) + dy * F.cos(t), d < 1)


def _radial(px, factor, d, dx, dy):
    return warp(px, F.col("_w") / 2 + dx * factor, F.col("_h") / 2 + dy * factor, (d < 1) & (d > 0))


def pinch(px, amount: float):
    dx, dy, d = _about()
    return _radial(px, F.pow(F.sin(math.pi / 2 * d), F.lit(-0.6 * amount / 100)), d, dx, dy)


def spherize(px, amount: float):
    dx, dy, d = _about()
    a = amount / 100
    target = d + (F.asin(d) * (2 / math.pi) - d) * a if a > 0 else d + (F.sin(d * (math.pi / 2)) - d) * -a
    return _radial(px, target / d, d, dx, dy)


#: Wavelengths of ripple.
WAVES = {"small": 10.0, "medium": 24.0, "large": 48.0}


def ripple(px, amount: float, size: str = "medium"):
    wave = WAVES[size]
    amp, k = amount / 100 * wave * 0.08, math.tau / wave
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    return warp(px, cx + amp * F.sin(cy * k), cy + amp * F.sin(cx * k))


def polar_coordinates(px, to_polar: bool = True):
    w, h = F.col("_w"), F.col("_h")
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    if to_polar:
        nx, ny = (cx - w / 2) / (w / 2), (cy - h / 2) / (h / 2)
        turn = F.pmod(F.atan2(nx, -ny), F.lit(math.tau)) / math.tau
        return warp(px, F.pmod(turn * w, w), F.least(F.sqrt(nx * nx + ny * ny) * h, h - 0.5))
    turn, far = cx / w * math.tau, cy / h
    return warp(px, w / 2 + F.sin(turn) * far * w / 2, h / 2 - F.cos(turn) * far * h / 2)


#: Reach and weight by distance of each way to resample.
def _lanczos(x):
    x = abs(x)
    return 1.0 if x < 1e-8 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if x < 3 else 0.0


def _cubic(x):
    x = abs(x)
    return ((1.5 * x - 2.5) * x) * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0


RESAMPLE = {"nearest": (0.5, lambda x: float(abs(x) <= 0.5)), "bilinear": (1.0, lambda x: max(0.0, 1 - abs(x))), "bicubic": (2.0, _cubic), "lanczos": (3.0, _lanczos)}


def axis_taps(src: int, dst: int, method: str) -> list[tuple]:
    """(place, source place, weight) of one axis; weights of a place add up to 1."""
    reach, weight = RESAMPLE[method]
    ratio = src / dst
    scale = max(1.0, ratio)
    out = []
    for i in range(dst):
        centre = (i + 0.5) * ratio
        span = range(max(0, math.floor(centre - reach * scale)), min(src, math.ceil(centre + reach * scale)))
        raw = [weight((j + 0.5 - centre) / scale) for j in span]
        total = sum(raw)
        raw = [w / total for w in raw] if abs(total) > 1e-8 else [1 / len(raw)] * len(raw)
        out += [(i, j, w) for j, w in zip(span, raw) if w]
    return out


def resize(px, width: int, height: int, new_width: int, new_height: int, method: str = "bicubic"):
    """Rasters of one size resampled along rows, then along columns; the taps, as many as an axis has places, are broadcast."""

    def change(rows, columns):
        for axis, src, dst in (("x", width, new_width), ("y", height, new_height)):
            taps = rows.sparkSession.createDataFrame(axis_taps(src, dst, method), "_to int, _from int, _k double")
            other = "y" if axis == "x" else "x"
            rows = rows.join(F.broadcast(taps), F.col(axis) == F.col("_from"))
            rows = rows.groupBy("img", F.col("_to").alias(axis), other).agg(*[F.sum(F.col(c) * F.col("_k")).alias(c) for c in columns])
        return rows if "a" not in px.columns else rows.withColumn("a", F.lit(0))

    return weighed(px, change)


def canvas_size(px, width: int, height: int, new_width: int, new_height: int, anchor: str = "center"):
    """Rasters moved onto another canvas; what lies beyond it is cut, places that were not there stay absent."""
    fx = 0 if "left" in anchor else 2 if "right" in anchor else 1
    fy = 0 if "top" in anchor else 2 if "bottom" in anchor else 1
    # Halved towards zero.
    ox, oy = int((new_width - width) * fx / 2), int((new_height - height) * fy / 2)
    moved = px.withColumns({"x": F.col("x") + ox, "y": F.col("y") + oy})
    return moved.where(F.col("x").between(0, new_width - 1) & F.col("y").between(0, new_height - 1))
