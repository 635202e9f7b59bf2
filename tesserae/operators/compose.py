"""The layer fold: layers of a document composited bottom to top.

A document's rows are places (img, x, y) with, for each pixel layer, four
columns in 0..1 (``<source>_r`` to ``<source>_a``) and a column for each mask.
The tree of layers is driver-side metadata: dicts with ``kind`` and the common
properties of LAYER.  Every composite is a projection of the one before, so a
whole stack stays in one stage without a shuffle.

Kinds: ``pixel`` (source), ``fill`` (color, or gradient with stops, from_ and
to), ``adjustment`` (adjust, settings), ``group`` (children, pass_through).
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tone
from ..functions.blend import _unit, blend

#: A layer's properties and what they are where none is given.
LAYER = {"visible": True, "opacity": 1.0, "fill_opacity": 1.0, "blend": "normal", "clip": False, "knockout": "none", "mask": None, "density": 1.0}
CHANNELS = ("r", "g", "b", "a")


def _get(layer: dict, name: str):
    return layer.get(name, LAYER.get(name))


def dissolve_noise(px: DataFrame, name: str) -> DataFrame:
    """A number in 0..1 from each place: a 64-bit hash in four 16-bit limbs, as decimals would round and longs overflow."""

    def times(limbs, by):
        parts = [by >> 16 * k & 0xFFFF for k in range(4)]
        out, carry = [], F.lit(0).cast("long")
        for k in range(4):
            total = sum((limbs[i] * parts[k - i] for i in range(k + 1)), carry)
            out.append(total.bitwiseAND(F.lit(0xFFFF)))
            carry = F.shiftright(total, 16)
        return out

    def stage(px, limbs):
        px = px.withColumns({f"_h{k}": v for k, v in enumerate(limbs)})
        return px, [F.col(f"_h{k}") for k in range(4)]

    def shifted(limbs, by):
        """xor with itself shifted right, by less than 32 bits."""
        step, bits = divmod(by, 16)
        at = lambda k: limbs[k] if k < 4 else F.lit(0).cast("long")
        moved = [F.shiftright(at(k + step), bits).bitwiseOR(F.shiftleft(at(k + step + 1), 16 - bits).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
        return [a.bitwiseXOR(b) for a, b in zip(limbs, moved)]

    def whole(c):
        v = F.col(c).cast("long")
        return [F.shiftright(v, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]

    a, b = times(whole("x"), 0x9E3779B97F4A7C15), times(whole("y"), 0xC2B2AE3D27D4EB4F)
    px, h = stage(px, [p.bitwiseXOR(q) for p, q in zip(a, b)])
    px, h = stage(px, shifted(h, 31))
    px, h = stage(px, times(h, 0x94D049BB133111EB))
    px, h = stage(px, shifted(h, 29))
    top = h[3] * 256 + F.shiftright(h[2], 8)
    return px.withColumn(name, top / float(1 << 24)).drop(*[f"_h{k}" for k in range(4)])


class _Fold:
    def __init__(self, px: DataFrame):
        self.px, self.names = px, count()

    def buffer(self, columns) -> list[str]:
        """A new buffer of four columns."""
        k = next(self.names)
        names = [f"_b{k}{c}" for c in CHANNELS]
        self.px = self.px.withColumns(dict(zip(names, columns)))
        return names

    def number(self, column: Column) -> str:
        name = f"_n{next(self.names)}"
        self.px = self.px.withColumn(name, column)
        return name

    def empty(self) -> list[str]:
        return self.buffer([F.lit(0.0)] * 4)

    def over(self, buf, src, strength: Column, mode: str) -> list[str]:
        """``src`` over ``buf``, both with straight alpha."""
        sa = F.col(src[3]) * strength
        if mode == "dissolve":
            noise = f"_n{next(self.names)}"
            self.px = dissolve_noise(self.px, noise)
            sa, mode = F.when(F.col(noise) < sa, 1.0).otherwise(0.0), "normal"
        sa = F.col(self.number(sa))
        ab = F.col(buf[3])
        ao = F.col(self.number(sa + ab * (1 - sa)))
        cb, cs = [F.col(c) for c in buf[:3]], [F.col(c) for c in src[:3]]
        mixed = [F.when(ab > 0, m).otherwise(s) for m, s in zip(blend(mode, cb, cs), cs)]
        out = [F.when(sa <= 0, b).otherwise((sa * (1 - ab) * s + sa * ab * m + (1 - sa) * ab * b) / F.nullif(ao, F.lit(0.0))) for b, s, m in zip(cb, cs, mixed)]
        return self.buffer([*out, F.when(sa <= 0, ab).otherwise(ao)])

    def adjusted(self, buf, layer) -> list[str]:
        own = [c for c in ("r", "g", "b") if c in self.px.columns]
        self.px = self.px.withColumns({f"_keep_{c}": F.col(c) for c in own} | {c: F.col(b) for c, b in zip(("r", "g", "b"), buf)})
        self.px = tone.apply(self.px, layer["adjust"], **layer.get("settings", {}))
        out = self.buffer([F.col("r"), F.col("g"), F.col("b"), F.col(buf[3])])
        self.px = self.px.withColumns({c: F.col(f"_keep_{c}") for c in own}).drop(*[f"_keep_{c}" for c in own], *[c for c in ("r", "g", "b") if c not in own])
        return out

    def mask(self, layer) -> Column:
        name = _get(layer, "mask")
        return F.lit(1.0) if name is None else 1 - _get(layer, "density") * (1 - F.col(name))

    def fill(self, layer) -> list[str]:
        if "color" in layer:
            return self.buffer([F.lit(v / 255) for v in (*layer["color"], 255)[:4]])
        (x0, y0), (x1, y1) = layer["from_"], layer["to"]
        dx, dy = x1 - x0, y1 - y0
        length = math.sqrt(max(dx * dx + dy * dy, 1e-9))
        px, py = F.col("x") + 0.5 - x0, F.col("y") + 0.5 - y0
        along, beside = (px * dx + py * dy) / length, (py * dx - px * dy) / length
        turn = F.pmod(F.atan2(py, px) - math.atan2(dy, dx), F.lit(math.tau)) / math.tau
        t = {
            "linear": along / length, "reflected": F.abs(along / length), "radial": F.sqrt(px * px + py * py) / length,
            "diamond": F.greatest(F.abs(along), F.abs(beside)) / length, "angle": turn,
        }[layer["gradient"]]
        t = _unit(t)
        t = 1 - t if layer.get("reverse") else t
        place = F.col(self.number(F.floor(t * 511 + 0.5).cast("int") + 1))
        table = [tone.gradient_at([(p, (*c, 255)[:4]) for p, c in layer["stops"]], i / 511) for i in range(512)]
        return self.buffer([F.element_at(F.array(*[F.lit(row[k] / 255) for row in table]), place) for k in range(4)])

    def layers(self, layers, buf, scope) -> list[str]:
        """``scope``: floors of shallow and deep knockout, and the name of the shape that adjustments are confined to."""
        at = 0
        while at < len(layers):
            base, end = layers[at], at + 1
            while end < len(layers) and _get(layers[end], "clip"):
                end += 1
            clipped = layers[at + 1 : end]
            takes = base["kind"] != "adjustment" and not _get(base, "clip")
            if clipped and takes:
                if _get(base, "visible"):
                    buf = self.clipping(base, [c for c in clipped if _get(c, "visible")], buf, scope)
            else:
                for layer in (base, *clipped):
                    if _get(layer, "visible"):
                        buf = self.layer(layer, buf, scope)
            at = end
        return buf

    def clipping(self, base, clipped, buf, scope) -> list[str]:
        """The base alone, what is clipped to it with the base's alpha kept, then the whole with the base's opacity and mode."""
        plain = {**base, "opacity": _get(base, "fill_opacity"), "blend": "normal", "knockout": "none"}
        plain["fill_opacity"] = 1.0
        inner = {"shallow": None, "deep": None, "shape": None}
        group = self.layer(plain, self.empty(), inner, has_clip=True)
        alpha = group[3]
        for layer in clipped:
            group = [*self.layer(layer, group, inner)[:3], alpha]
        floor = self.floor(base, scope)
        if floor:
            buf = self.knockout(buf, group, F.col(alpha), F.lit(_get(base, "opacity")), _get(base, "blend"), floor)
        else:
            buf = self.over(buf, group, F.lit(_get(base, "opacity")), _get(base, "blend"))
        self.cover(scope, F.col(alpha))
        return buf

    def floor(self, layer, scope):
        """What a knockout shows: the canvas as its scope opened, or the document's Background where there is one."""
        kind = _get(layer, "knockout")
        return None if kind == "none" else scope["shallow"] if kind == "shallow" else scope["deep"] or scope["shallow"]

    def cover(self, scope, cover: Column) -> None:
        if scope["shape"]:
            shape = F.col(scope["shape"])
            scope["shape"] = self.number(shape + (1 - shape) * cover)

    def knockout(self, buf, src, cover: Column, strength: Column, mode: str, floor) -> list[str]:
        """Inside ``cover`` the source over the floor in place of the buffer, mixed by premultiplied colour."""
        through = self.over(floor, src, strength, mode)
        s = F.col(self.number(cover))
        ad, at = F.col(buf[3]), F.col(through[3])
        ar = F.col(self.number(ad + (at - ad) * s))
        mix = lambda d, t: _unit((F.col(d) * ad + (F.col(t) * at - F.col(d) * ad) * s) / F.nullif(ar, F.lit(0.0)))
        out = [F.when(s <= 0, F.col(d)).when(ar <= 0, 0.0).otherwise(mix(d, t)) for d, t in zip(buf[:3], through[:3])]
        return self.buffer([*out, F.when(s <= 0, ad).otherwise(F.greatest(ar, F.lit(0.0)))])

    def place(self, layer, src, buf, scope) -> list[str]:
        mask, strength = self.mask(layer), F.lit(_get(layer, "opacity") * _get(layer, "fill_opacity"))
        floor = self.floor(layer, scope)
        if floor:
            cover = F.col(src[3]) * mask
            out = self.knockout(buf, src, cover, strength * mask, _get(layer, "blend"), floor)
            self.cover(scope, cover)
            return out
        out = self.over(buf, src, strength * mask, _get(layer, "blend"))
        self.cover(scope, F.col(src[3]) * mask * _get(layer, "fill_opacity"))
        return out

    def layer(self, layer, buf, scope, has_clip=False) -> list[str]:
        kind = layer["kind"]
        if kind == "pixel":
            return self.place(layer, [f"{layer['source']}_{c}" for c in CHANNELS], buf, scope)
        if kind == "fill":
            return self.place(layer, self.fill(layer), buf, scope)
        if kind == "adjustment":
            new = self.adjusted(buf, layer)
            amount = F.lit(_get(layer, "opacity") * _get(layer, "fill_opacity")) * self.mask(layer)
            amount = amount * F.col(scope["shape"]) if scope["shape"] and scope.get("confined") else amount
            amount = F.col(self.number(F.when(F.col(buf[3]) > 0, amount).otherwise(0.0)))
            cb, cs = [F.col(c) for c in buf[:3]], [F.col(c) for c in new[:3]]
            mixed = cs if _get(layer, "blend") == "normal" else blend(_get(layer, "blend"), cb, cs)
            return self.buffer([*[b + (m - b) * amount for b, m in zip(cb, mixed)], F.col(buf[3])])
        return self.group(layer, buf, scope, has_clip)

    def group(self, layer, buf, scope, has_clip) -> list[str]:
        fill, through = _get(layer, "fill_opacity"), layer.get("pass_through", False)
        confined = bool(scope.get("confined")) or fill < 1 or has_clip
        shape = self.number(F.lit(0.0)) if confined or scope["shape"] else None
        if through and _get(layer, "blend") == "normal" and _get(layer, "knockout") == "none":
            inner = {"shallow": buf, "deep": scope["deep"], "shape": shape, "confined": confined}
            after = self.layers(layer["children"], buf, inner)
            part = F.lit(_get(layer, "opacity") * fill) * self.mask(layer)
            if scope["shape"]:
                self.cover(scope, F.col(inner["shape"]) * fill * self.mask(layer))
            return self.buffer([F.col(b) + (F.col(a) - F.col(b)) * part for a, b in zip(after, buf)])
        inner = {"shallow": self.empty(), "deep": scope["deep"] if through else None, "shape": shape if confined else None, "confined": confined}
        return self.place(layer, self.layers(layer["children"], self.empty(), inner), buf, scope)


def composite(px: DataFrame, layers: list[dict]) -> DataFrame:
    """(img, x, y, r, g, b, a): the layers, bottom first, over nothing.

    Deep knockout shows the bottom layer where it is marked ``background``.
    """
    fold = _Fold(px)
    empty = fold.empty()
    scope = {"shallow": empty, "deep": None, "shape": None}
    if layers and layers[0].get("background"):
        scope["deep"] = under = fold.layers(layers[:1], empty, dict(scope))
        out = fold.layers(layers[1:], under, scope)
    else:
        out = fold.layers(layers, empty, scope)
    return fold.px.select("img", "x", "y", *[F.col(b).alias(c) for b, c in zip(out, CHANNELS)])
