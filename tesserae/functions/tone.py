"""Tone and colour adjustments of rasters whose channels r, g, b are in 0..1.

Each takes a DataFrame and its settings and returns the DataFrame with new
channels; alpha and all other columns pass through.  Steps that use a channel
several times are projections of their own, so no expression is repeated.
Settings are on the reference's scales: percent, degrees or levels 0..255.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blend import _unit

RGB = ("r", "g", "b")


def _c() -> list[Column]:
    return [F.col(c) for c in RGB]


def _set(px: DataFrame, channels) -> DataFrame:
    return px.withColumns(dict(zip(RGB, channels)))


def luma(c) -> Column:
    """Rec. 601, which adjustments use; blending and histograms use other weights."""
    return 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = _unit((v - low) / (high - low))
    return t * t * (3 - 2 * t)


def to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def hsl(px: DataFrame) -> DataFrame:
    """Adds hue (degrees), sat and light; greys have hue and saturation 0."""
    px = px.withColumns({"_mx": F.greatest(*RGB), "_mn": F.least(*RGB)}).withColumns({"light": (F.col("_mx") + F.col("_mn")) / 2, "_d": F.col("_mx") - F.col("_mn")})
    r, g, b = _c()
    d, grey = F.nullif(F.col("_d"), F.lit(0.0)), F.col("_d") == 0
    sector = F.when(F.col("_mx") == r, F.pmod((g - b) / d, F.lit(6.0))).when(F.col("_mx") == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    sat = d / F.greatest(1 - F.abs(2 * F.col("light") - 1), F.lit(1e-6))
    return px.withColumns({"hue": F.when(grey, 0.0).otherwise(60 * sector), "sat": F.when(grey, 0.0).otherwise(F.least(sat, F.lit(1.0)))}).drop("_mx", "_mn", "_d")


def from_hsl(px: DataFrame) -> DataFrame:
    """Channels from hue, sat and light, which are dropped."""
    px = px.withColumn("_c", (1 - F.abs(2 * F.col("light") - 1)) * F.col("sat")).withColumn("_h", F.pmod(F.col("hue") / 60, F.lit(6.0)))
    px = px.withColumn("_x", F.col("_c") * (1 - F.abs(F.pmod("_h", F.lit(2.0)) - 1))).withColumn("_m", F.col("light") - F.col("_c") / 2)
    full, part, sector = F.col("_c"), F.col("_x"), F.floor("_h")

    def channel(first, second):
        return F.col("_m") + F.when(sector.isin(*first), full).when(sector.isin(*second), part).otherwise(0.0)

    return _set(px, [channel((0, 5), (1, 4)), channel((1, 2), (0, 3)), channel((3, 4), (2, 5))]).drop("_c", "_h", "_x", "_m", "hue", "sat", "light")


def brightness_contrast(px, brightness=0.0, contrast=0.0, legacy=False):
    b, c = brightness / 150, contrast / 100
    if legacy:
        return _set(px, [_unit((v + b * 150 / 255 - 0.5) * (1 + c) + 0.5) for v in _c()])
    g = 1 / (1 + 1.5 * b) if b >= 0 else 1 - 1.5 * b
    k = 1 + 3 * c if c >= 0 else 1 / (1 - 1.5 * c)
    px = _set(px, [_unit(F.pow(v, F.lit(g))) for v in _c()])
    return _set(px, [F.when(v < 0.5, 0.5 * F.pow(2 * v, F.lit(k))).otherwise(1 - 0.5 * F.pow(2 * (1 - v), F.lit(k))) for v in _c()])


def levels(px, master=None, red=None, green=None, blue=None):
    """Each a dict of in_black, in_white, gamma, out_black, out_white; the master curve acts after the channel's own."""

    def one(v, s):
        if not s:
            return v
        low = s.get("in_black", 0) / 255
        span = max(s.get("in_white", 255) / 255, low + 1e-3) - low
        gamma = min(9.99, max(0.01, s.get("gamma", 1.0)))
        t = _unit((v - low) / span)
        t = t if gamma == 1 else F.pow(t, F.lit(1 / gamma))
        a, z = s.get("out_black", 0) / 255, s.get("out_white", 255) / 255
        return a + (z - a) * t

    px = _set(px, [one(v, s) for v, s in zip(_c(), (red, green, blue))])
    return _set(px, [one(v, master) for v in _c()])


def monotone(points) -> list[tuple]:
    """Pieces (x0, x1, y0, y1, slope0, slope1) of the monotone cubic through points on 0..255."""
    pts = []
    for x, y in sorted((x / 255, y / 255) for x, y in points):
        if not pts or x - pts[-1][0] >= 1e-6:
            pts.append((x, y))
    if len(pts) < 2:
        return []
    run = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(pts, pts[1:])]
    slope = [run[0], *((p + q) / 2 if p * q > 0 else 0.0 for p, q in zip(run, run[1:])), run[-1]]
    for i, d in enumerate(run):
        if abs(d) < 1e-9:
            slope[i] = slope[i + 1] = 0.0
        elif (size := (slope[i] ** 2 + slope[i + 1] ** 2) ** 0.5 / abs(d)) > 3:
            slope[i], slope[i + 1] = slope[i] * 3 / size, slope[i + 1] * 3 / size
    return [(a[0], b[0], a[1], b[1], s, t) for a, b, s, t in zip(pts, pts[1:], slope, slope[1:])]


def curve(v: Column, points) -> Column:
    pieces = monotone(points)
    if not pieces:
        return v
    out = None
    for x0, x1, y0, y1, s, t in pieces:
        h = x1 - x0
        u = (v - x0) / h
        y = y0 + u * (h * s + u * ((3 * (y1 - y0) - h * (2 * s + t)) + u * (h * (s + t) - 2 * (y1 - y0))))
        out = F.when(v <= x1, y) if out is None else out.when(v <= x1, y)
    return _unit(F.when(v <= pieces[0][0], pieces[0][2]).otherwise(out.otherwise(pieces[-1][3])))


def curves(px, master=None, red=None, green=None, blue=None):
    px = _set(px, [curve(v, p) if p else v for v, p in zip(_c(), (red, green, blue))])
    return _set(px, [curve(v, master) for v in _c()]) if master else px


def exposure(px, exposure=0.0, offset=0.0, gamma=1.0):
    g = 1 / min(9.99, max(0.01, gamma))
    px = _set(px, [F.greatest(to_linear(v) * 2.0**exposure + offset, F.lit(0.0)) for v in _c()])
    return _set(px, [_unit(from_linear(v if g == 1 else F.pow(v, F.lit(g)))) for v in _c()])


def vibrance(px, vibrance=0.0, saturation=0.0):
    vib, sat = vibrance / 100, saturation / 100
    r, g, b = _c()
    k = F.lit(1 + sat)
    if vib:
        skin = F.when((r >= g) & (g >= b), 0.5).otherwise(1.0)
        k = k * (1 + (vib * (1 - (F.greatest(*RGB) - F.least(*RGB))) * skin if vib > 0 else vib))
    px = px.withColumns({"_k": F.greatest(k, F.lit(0.0)), "_l": luma(_c())})
    return _set(px, [_unit(F.col("_l") + (v - F.col("_l")) * F.col("_k")) for v in _c()]).drop("_k", "_l")


#: The six hue ranges (reds, yellows, greens, cyans, blues, magentas) as falloff start, plateau, falloff end in degrees.
HUE_BANDS = [(315, 345, 15, 45), (15, 45, 75, 105), (75, 105, 135, 165), (135, 165, 195, 225), (195, 225, 255, 285), (255, 285, 315, 345)]


def band_weight(band, hue: Column) -> Column:
    """A trapezoid on the circle: 1 on the plateau, falling in straight lines to 0 at the ends."""
    ahead = lambda v: (v - band[0]) % 360
    rise, flat, span = ahead(band[1]), ahead(band[2]), ahead(band[3])
    at = F.pmod(hue - band[0], F.lit(360.0))
    fall = (span - at) / (span - flat) if span > flat else F.lit(1.0)
    return F.when(at > span, 0.0).when(at < rise, at / (rise or 1)).when(at <= flat, 1.0).otherwise(fall)


def _alpha(percent: float) -> float:
    inc = percent / 100
    return inc if inc <= 0 else 1e6 if inc >= 1 else inc / (1 - inc)


def _saturate(px, alpha: Column) -> DataFrame:
    """Chroma pushed away from the HSL midpoint, never past full saturation."""
    px = px.withColumns({"_a": alpha, "_mx": F.greatest(*RGB), "_mn": F.least(*RGB)}).withColumn("_l", (F.col("_mx") + F.col("_mn")) / 2)
    s = (F.col("_mx") - F.col("_mn")) / F.greatest(1 - F.abs(2 * F.col("_l") - 1), F.lit(1e-6))
    room = F.greatest(1 / F.greatest(s, F.lit(1e-6)) - 1, F.lit(0.0))
    px = px.withColumn("_a", F.when(F.col("_mx") > F.col("_mn"), F.greatest(F.lit(-1.0), F.least(F.col("_a"), room))).otherwise(0.0))
    return _set(px, [F.when(F.col("_a") == 0, v).otherwise(_unit(v + (v - F.col("_l")) * F.col("_a"))) for v in _c()]).drop("_a", "_mx", "_mn", "_l")


def _rotate(px, by: Column) -> DataFrame:
    px = hsl(px.withColumns({"_by": by, "_r": F.col("r"), "_g": F.col("g"), "_b": F.col("b")}))
    px = from_hsl(px.withColumn("hue", F.pmod(F.col("hue") + F.col("_by"), F.lit(360.0))))
    return _set(px, [F.when(F.col("_by") == 0, F.col(f"_{c}")).otherwise(F.col(c)) for c in RGB]).drop("_by", "_r", "_g", "_b")


def hue_saturation(px, hue=0.0, saturation=0.0, lightness=0.0, ranges=None, bands=HUE_BANDS, colorize=False):
    """``ranges`` are six (hue, saturation, lightness), by band; with ``colorize`` hue, saturation and lightness replace the colour."""
    if colorize:
        px = hsl(px)
        dl = max(-1.0, min(1.0, lightness / 100))
        light = F.col("light") + (1 - F.col("light")) * dl if dl > 0 else F.col("light") * (1 + dl)
        px = px.withColumns({"hue": F.lit(float(hue % 360)), "sat": F.lit(min(1.0, max(0.0, saturation / 100))), "light": _unit(light)})
        return _set(from_hsl(px), [_unit(v) for v in _c()])
    active = [(b, r) for b, r in zip(bands, ranges or []) if any(r)]
    if active:
        px = hsl(px).withColumns({f"_w{k}": F.when(F.col("sat") > 0, band_weight(b, F.col("hue"))).otherwise(0.0) for k, (b, _) in enumerate(active)}).drop("hue", "sat", "light")
        total = lambda f: sum((F.col(f"_w{k}") * f(r) for k, (_, r) in enumerate(active)), F.lit(0.0))
        px = px.withColumns({"_dh": total(lambda r: float(r[0])), "_dl": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total(lambda r: r[2] / 100))), "_da": total(lambda r: _alpha(r[1]))})
        px = px.drop(*[f"_w{k}" for k in range(len(active))])
        px = _rotate(px, F.col("_dh")).withColumns({"_top": F.greatest(*RGB), "_low": F.least(*RGB)})
        px = _set(px, [_unit(F.when(F.col("_dl") > 0, v + (F.col("_top") - v) * F.col("_dl")).otherwise(v + (v - F.col("_low")) * F.col("_dl"))) for v in _c()])
        px = _saturate(px, F.col("_da")).drop("_dh", "_dl", "_da", "_top", "_low")
    if hue:
        px = _rotate(px, F.lit(float(hue)))
    if lightness:
        dl = max(-1.0, min(1.0, lightness / 100))
        px = _set(px, [v + (1 - v) * dl if dl > 0 else v * (1 + dl) for v in _c()])
    if saturation:
        px = _saturate(px, F.lit(_alpha(saturation)))
    return _set(px, [_unit(v) for v in _c()])


def color_balance(px, shadows=(0, 0, 0), midtones=(0, 0, 0), highlights=(0, 0, 0), preserve_luminosity=True):
    px = px.withColumn("_l", luma(_c()))

    def one(v, s, m, h):
        dark = _unit(1 - v / 0.333) * 0.7 + (1 - smoothstep(0.0, 0.5, v)) * 0.3
        light = _unit((v - 0.667) / 0.333) * 0.7 + smoothstep(0.5, 1.0, v) * 0.3
        middle = _unit(1 - F.abs(v - 0.5) * 2)
        return _unit(v + (s / 100 * dark + m / 100 * middle + h / 100 * light) * 0.25)

    px = _set(px, [one(*x) for x in zip(_c(), shadows, midtones, highlights)])
    if preserve_luminosity:
        px = px.withColumn("_l", F.col("_l") - luma(_c()))
        px = _set(px, [_unit(v + F.col("_l")) for v in _c()])
    return px.drop("_l")


def black_white(px, weights=(40, 60, 40, 60, 20, 80), tint=None):
    """Weights in percent of reds, yellows, greens, cyans, blues, magentas; ``tint`` is a colour in 0..255."""
    w = [x / 100 for x in weights]
    r, g, b = _c()
    px = px.withColumns({"_mx": F.greatest(*RGB), "_mn": F.least(*RGB)}).withColumn("_mid", r + g + b - F.col("_mx") - F.col("_mn"))
    primary = F.when(r == F.col("_mx"), w[0]).when(g == F.col("_mx"), w[2]).otherwise(w[4])
    # The least channel is the last of equals, and the secondary colour is of the other two.
    low = F.when((b <= r) & (b <= g), w[1]).when(g <= r, w[5]).otherwise(w[3])
    grey = _unit(F.col("_mn") + (F.col("_mx") - F.col("_mid")) * primary + (F.col("_mid") - F.col("_mn")) * low)
    px = px.withColumn("_y", grey)
    if tint is None:
        return _set(px, [F.col("_y")] * 3).drop("_mx", "_mn", "_mid", "_y")
    t = [x / 255 for x in tint]
    bright = max(1e-3, 0.299 * t[0] + 0.587 * t[1] + 0.114 * t[2])
    px = _set(px, [_unit(x / bright * F.col("_y")) for x in t]).withColumn("_d", F.col("_y") - luma(_c()))
    return _set(px, [_unit(v + F.col("_d")) for v in _c()]).drop("_mx", "_mn", "_mid", "_y", "_d")


def photo_filter(px, color=(236, 138, 0), density=25.0, preserve_luminosity=True):
    px = px.withColumn("_l", luma(_c()))
    px = _set(px, [v + (v * (k / 255) - v) * (density / 100) for v, k in zip(_c(), color)])
    if preserve_luminosity:
        px = px.withColumn("_l", F.col("_l") - luma(_c()))
        px = _set(px, [v + F.col("_l") for v in _c()])
    return _set(px, [_unit(v) for v in _c()]).drop("_l")


def channel_mixer(px, red=(100, 0, 0, 0), green=(0, 100, 0, 0), blue=(0, 0, 100, 0), monochrome=False):
    c = _c()
    row = lambda m: _unit((m[0] * c[0] + m[1] * c[1] + m[2] * c[2]) / 100 + m[3] / 100)
    return _set(px, [row(red)] * 3 if monochrome else [row(red), row(green), row(blue)])


def invert(px):
    return _set(px, [1 - v for v in _c()])


def posterize(px, levels=4):
    n = min(255, max(2, levels))
    return _set(px, [F.least(F.floor(v * n), F.lit(n - 1)) / (n - 1) for v in _c()])


def threshold(px, level=128):
    return _set(px, [F.when(luma(_c()) >= level / 255, 1.0).otherwise(0.0)] * 3)


def gradient_at(stops, t: float) -> list[float]:
    """Colour (0..255 channels) of stops (place, colour) at ``t``."""
    stops = sorted(stops, key=lambda s: s[0])
    if t <= stops[0][0]:
        return list(stops[0][1])
    for (p, a), (q, b) in zip(stops, stops[1:]):
        if t <= q:
            return [x + (y - x) * (t - p) / max(q - p, 1e-6) for x, y in zip(a, b)]
    return list(stops[-1][1])


def gradient_map(px, stops=((0.0, (0, 0, 0)), (1.0, (255, 255, 255))), reverse=False):
    """A table of 256 colours looked up by luma, with interpolation."""
    table = [gradient_at(stops, 1 - i / 255 if reverse else i / 255) for i in range(256)]
    px = px.withColumn("_x", _unit(luma(_c())) * 255).withColumn("_i", F.least(F.floor("_x"), F.lit(254)).cast("int"))
    one = lambda k: F.array(*[F.lit(row[k] / 255) for row in table])
    low = [F.element_at(one(k), F.col("_i") + 1) for k in range(3)]
    high = [F.element_at(one(k), F.col("_i") + 2) for k in range(3)]
    return _set(px, [a + (z - a) * (F.col("_x") - F.col("_i")) for a, z in zip(low, high)]).drop("_x", "_i")


def selective_color(px, colors, absolute=False):
    """``colors``: name -> (cyan, magenta, yellow, black) in percent; names are those of COLORS."""
    r, g, b = _c()
    px = px.withColumns({"_mx": F.greatest(*RGB), "_mn": F.least(*RGB)}).withColumn("_mid", r + g + b - F.col("_mx") - F.col("_mn"))
    mx, mn, mid = F.col("_mx"), F.col("_mn"), F.col("_mid")
    red, green = r == mx, (g == mx) & (r != mx)
    blue = ~(red | green)
    no_blue, no_green = b == mn, (g == mn) & (b != mn)
    no_red = ~(no_blue | no_green)
    first, second = mx - mid, mid - mn
    weights = {
        "reds": F.when(red, first), "greens": F.when(green, first), "blues": F.when(blue, first),
        "yellows": F.when(no_blue, second), "cyans": F.when(no_red, second), "magentas": F.when(no_green, second),
        "whites": _unit((mn - 0.5) * 2), "blacks": _unit((0.5 - mx) * 2), "neutrals": _unit(1 - (F.abs(mx - 0.5) + F.abs(mn - 0.5))),
    }
    out = []
    for ch, v in enumerate(_c()):
        total = F.lit(0.0)
        for name, four in colors.items():
            ink = (four[ch] + four[3]) / 100
            if ink:
                scale = F.lit(1.0) if absolute or ink < 0 else 1 - v
                total = total + F.coalesce(weights[name], F.lit(0.0)) * ink * scale
        out.append(_unit(v - total))
    return _set(px, out).drop("_mx", "_mn", "_mid")


def color_lookup(px, size: int, table, strength=1.0):
    """Trilinear lookup in a cube of size**3 colours in 0..1, red varying fastest."""
    if size < 2 or len(table) < size**3:
        return px
    s = min(1.0, max(0.0, strength))
    px = px.withColumns({f"_x{k}": _unit(v) * (size - 1) for k, v in enumerate(_c())})
    px = px.withColumns({f"_i{k}": F.least(F.floor(f"_x{k}"), F.lit(size - 2)).cast("int") for k in range(3)})
    px = px.withColumns({f"_t{k}": F.col(f"_x{k}") - F.col(f"_i{k}") for k in range(3)})
    cube = [F.array(*[F.lit(float(row[k])) for row in table]) for k in range(3)]
    part = lambda k, up: F.col(f"_t{k}") if up else 1 - F.col(f"_t{k}")

    def looked(k):
        total = F.lit(0.0)
        for corner in range(8):
            dr, dg, db = corner & 1, corner >> 1 & 1, corner >> 2
            at = ((F.col("_i2") + db) * size + F.col("_i1") + dg) * size + F.col("_i0") + dr + 1
            total = total + F.element_at(cube[k], at) * part(0, dr) * part(1, dg) * part(2, db)
        return total

    out = [_unit(v + (looked(k) - v) * s) for k, v in enumerate(_c())]
    return _set(px, out).drop(*[f"_{n}{k}" for n in "xit" for k in range(3)])


def _lattice(px, name: str, x: Column, y: Column, seed: int) -> DataFrame:
    """-1..1 at whole places, in a column; the steps are projections, so none is repeated."""

    def scaled(v, by):
        v = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        low, high = v.bitwiseAND(F.lit(0xFFFF)), F.shiftright(v, 16)
        return (low * by + F.shiftleft((high * by).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))

    px = px.withColumn("_q", scaled(y, 0x85EBCA77).bitwiseXOR(F.lit(seed)))
    for step in (lambda c: c.bitwiseXOR(F.shiftright(c, 16)), lambda c: scaled(c, 0x7FEB352D), lambda c: c.bitwiseXOR(F.shiftright(c, 15)),
                 lambda c: scaled(c, 0x846CA68B), lambda c: c.bitwiseXOR(F.shiftright(c, 16))):
        px = px.withColumn("_q", step(F.col("_q")))
    px = px.withColumn("_q", F.col("_q").bitwiseXOR(scaled(x, 0x9E3779B1)))
    for step in (lambda c: c.bitwiseXOR(F.shiftright(c, 16)), lambda c: scaled(c, 0x7FEB352D), lambda c: c.bitwiseXOR(F.shiftright(c, 15)),
                 lambda c: scaled(c, 0x846CA68B), lambda c: c.bitwiseXOR(F.shiftright(c, 16))):
        px = px.withColumn("_q", step(F.col("_q")))
    return px.withColumn(name, F.col("_q").bitwiseAND(F.lit(0xFFFF)) / 65535.0 + F.shiftright("_q", 16) / 65535.0 - 1).drop("_q")


def mixed(value: int) -> int:
    """The 32-bit mix of a whole number, for seeds."""
    value ^= value >> 16
    value = value * 0x7FEB352D & 0xFFFFFFFF
    value ^= value >> 15
    value = value * 0x846CA68B & 0xFFFFFFFF
    return value ^ value >> 16


def grain(px, amount=25.0, size=1.5, roughness=50.0, seed=1):
    """Brightness noise fixed to pixel places (x, y), strongest in the midtones."""
    if amount <= 0:
        return px
    size, rough, strength = (size if size > 0 else 1.0), min(1.0, max(0.0, roughness / 100)), min(amount / 100, 1.0) * 0.35
    u, v = (F.col("x") + 0.5) / size, (F.col("y") + 0.5) / size
    px = px.withColumns({"_cx": F.floor(u), "_cy": F.floor(v), "_tx": u - F.floor(u), "_ty": v - F.floor(v)})
    px = px.withColumns({t: F.col(t) * F.col(t) * (3 - 2 * F.col(t)) for t in ("_tx", "_ty")})
    for dx in (0, 1):
        for dy in (0, 1):
            px = _lattice(px, f"_n{dx}{dy}", F.col("_cx") + dx, F.col("_cy") + dy, seed)
    px = _lattice(px, "_fine", F.col("x"), F.col("y"), mixed(seed ^ 0xA511E9B3))
    top = F.col("_n00") + (F.col("_n10") - F.col("_n00")) * F.col("_tx")
    low = F.col("_n01") + (F.col("_n11") - F.col("_n01")) * F.col("_tx")
    px = px.withColumn("_s", (top + (low - top) * F.col("_ty")) * 1.6)
    px = px.withColumns({"_s": F.col("_s") + (F.col("_fine") - F.col("_s")) * rough, "_l": _unit(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"))})
    px = px.withColumn("_s", F.col("_s") * strength * (0.4 + 2.4 * F.col("_l") * (1 - F.col("_l"))))
    return _set(px, [_unit(c + F.col("_s")) for c in _c()]).drop("_cx", "_cy", "_tx", "_ty", "_n00", "_n01", "_n10", "_n11", "_fine", "_s", "_l")


ADJUSTMENTS = {
    "brightness-contrast": brightness_contrast, "levels": levels, "curves": curves, "exposure": exposure, "vibrance": vibrance,
    "hue-saturation": hue_saturation, "color-balance": color_balance, "black-white": black_white, "photo-filter": photo_filter,
    "channel-mixer": channel_mixer, "invert": invert, "posterize": posterize, "threshold": threshold, "gradient-map": gradient_map,
    "selective-color": selective_color, "color-lookup": color_lookup, "grain": grain,
}


def apply(px: DataFrame, kind: str, **settings) -> DataFrame:
    return ADJUSTMENTS[kind](px, **settings)
