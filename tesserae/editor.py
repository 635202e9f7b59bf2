"""The command facade: ``{op, ...params}`` on a document, with undo, transactions and merged steps.

A document is one DataFrame of places (img, x, y) with four columns in 0..1
for each pixel layer and a column for each mask, and a tree of layers kept on
the driver.  A command makes a new state of both; DataFrames are immutable
plans, so a snapshot costs nothing and undo is going back to an older plan.
Nothing runs until a result is asked for, and then as one plan; the same
commands edit every image of the table at once.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.blend import quantise
from .operators import compose, filters, raster, selection

CHANNELS = compose.CHANNELS
RGB = ("r", "g", "b")
#: Fixed value: steps that can be undone.
STEPS = 200


#: Filters that act on a layer of levels and give one back.
FILTERS = (
    "gaussian_blur", "unsharp_mask", "high_pass", "custom", "median", "find_edges", "emboss", "surface_blur", "solarize", "invert", "desaturate", "apply_adjustment", "offset", "vignette",
    "twirl", "pinch", "spherize", "ripple", "polar_coordinates",
)


class Invalid(ValueError):
    """A command that can't be carried out; the document stays as it was."""


@dataclass
class Document:
    px: DataFrame
    width: int
    height: int
    layers: list = field(default_factory=list)
    active: int | None = None
    selection: str | None = None  # a column of coverage 0..255; none selects everything
    resolution: float = 72.0
    next_id: int = 1

    def copy(self) -> Document:
        return Document(self.px, self.width, self.height, copy.deepcopy(self.layers), self.active, self.selection, self.resolution, self.next_id)

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def walk(self, layers=None):
        for layer in self.layers if layers is None else layers:
            yield layer
            yield from self.walk(layer.get("children", []))

    def find(self, layer_id) -> dict:
        for layer in self.walk():
            if layer["id"] == layer_id:
                return layer
        raise Invalid(f"no layer {layer_id}")

    def slot(self, layer_id, siblings=None, parent=None):
        """(parent id, siblings, place) of a layer."""
        siblings = self.layers if siblings is None else siblings
        for k, layer in enumerate(siblings):
            if layer["id"] == layer_id:
                return parent, siblings, k
            if found := self.slot(layer_id, layer.get("children", []), layer["id"]) if layer.get("children") else None:
                return found
        return None

    def take(self, layer_id) -> dict:
        found = self.slot(layer_id)
        if not found:
            raise Invalid(f"no layer {layer_id}")
        if self.active in {x["id"] for x in self.walk([found[1][found[2]]])}:
            self.active = None
        return found[1].pop(found[2])

    def put_above(self, anchor, layer) -> None:
        found = self.slot(anchor) if anchor is not None else None
        if found:
            found[1].insert(found[2] + 1, layer)
        else:
            self.layers.append(layer)

    def name(self, base: str) -> str:
        return f"{base} {1 + sum(x['name'].startswith(base) for x in self.walk())}"


class History:
    """Undo and redo stacks of states; runs of one merge key are one step, transactions are recorded at their end."""

    def __init__(self):
        self.undo_stack, self.redo_stack, self.open, self.txn = [], [], None, None

    def record(self, before: Document, label: str, key: str | None) -> None:
        if self.txn:
            self.txn["changed"], self.txn["label"] = True, self.txn["label"] or label
            return
        self.redo_stack = []
        if key is not None and key == self.open and self.undo_stack:
            return
        self.undo_stack = [*self.undo_stack, (before, label)][-STEPS:]
        self.open = key

    def begin(self, now: Document, label: str | None) -> None:
        if self.txn:
            self.txn["depth"] += 1
        else:
            self.open, self.txn = None, {"before": now, "label": label, "depth": 1, "changed": False}

    def end(self) -> str | None:
        if not self.txn:
            return None
        self.txn["depth"] -= 1
        if self.txn["depth"]:
            return None
        done, self.txn = self.txn, None
        if not done["changed"]:
            return None
        self.record(done["before"], done["label"] or "Edit", None)
        return done["label"] or "Edit"

    def commit(self) -> None:
        if self.txn:
            self.txn["depth"] = 1
            self.end()

    def step(self, now: Document, back: bool):
        self.commit()
        source, target = (self.undo_stack, self.redo_stack) if back else (self.redo_stack, self.undo_stack)
        if not source:
            return now, None
        state, label = source.pop()
        target.append((now, label))
        self.open = None
        return state, label

    def go(self, now: Document, n: int) -> Document:
        self.commit()
        while len(self.undo_stack) != n:
            now, label = self.step(now, len(self.undo_stack) > n)
            if label is None:
                break
        return now


class Editor:
    def __init__(self, px: DataFrame, width: int, height: int):
        self.doc, self.history, self.revision, self._columns = Document(px, width, height), History(), 0, 0

    def exec(self, command: dict | str) -> dict:
        """Carries out a command; one that fails raises Invalid and changes nothing."""
        params = dict(json.loads(command) if isinstance(command, str) else command)
        op = params.pop("op", None)
        if op is None:
            raise Invalid("missing `op`")
        if op.startswith("edit."):
            return self._session(op[5:], params)
        domain, _, name = op.partition(".")
        run = getattr(self, f"_{domain}_{name.replace('-', '_')}", None) or (self._filter if domain == "filter" else None)
        if run is None:
            raise Invalid(f"unknown operation {op}")
        before, kept = self.doc.copy(), self.doc
        try:
            done = run(name, **params) if run == self._filter else run(**params)
        except TypeError as wrong:
            self.doc = before
            raise Invalid(f"{op}: {wrong}") from wrong
        except Exception:
            self.doc = before
            raise
        del kept
        label, key, data = (done + (None, None))[:3] if isinstance(done, tuple) else (done, None, None)
        if label:
            self.history.record(before, label, key)
            if domain == "doc":
                self.history = History()
        self.revision += 1
        return {"changed": bool(label), "label": label, "data": data, "revision": self.revision}

    def run(self, commands) -> Editor:
        for command in commands:
            self.exec(command)
        return self

    def _session(self, name: str, params: dict) -> dict:
        h, changed, label = self.history, False, None
        if name in ("undo", "redo"):
            self.doc, label = h.step(self.doc, name == "undo")
            changed = label is not None
        elif name == "history-go":
            self.doc, changed = h.go(self.doc, params["index"]), True
        elif name == "seal":
            h.open = None
        elif name == "begin":
            h.begin(self.doc.copy(), params.get("label"))
        elif name == "end":
            label = h.end()
            changed = label is not None
        elif name == "cancel":
            changed = bool(h.txn and h.txn["changed"])
            self.doc, h.txn = (h.txn["before"] if h.txn else self.doc), None
        elif name == "squash":
            h.commit()
            if changed := len(h.undo_stack) > params["index"]:
                if params.get("discard"):
                    self.doc = h.go(self.doc, params["index"])
                else:
                    h.undo_stack = [*h.undo_stack[: params["index"]], (h.undo_stack[params["index"]][0], params.get("label", "Edit"))]
                h.redo_stack, h.open = [], None
        elif name == "clear-history":
            self.history = History()
        else:
            raise Invalid(f"unknown operation edit.{name}")
        self.revision += changed
        return {"changed": changed, "label": label, "revision": self.revision}

    # Columns and pixels.

    def _fresh(self, stem: str) -> str:
        self._columns += 1
        return f"{stem}{self._columns}"

    def _store(self, columns) -> str:
        """Four columns as a new pixel source."""
        name = self._fresh("p")
        self.doc.px = self.doc.px.withColumns({f"{name}_{c}": v for c, v in zip(CHANNELS, columns)})
        return name

    def _column(self, stem: str, value) -> str:
        name = self._fresh(stem)
        self.doc.px = self.doc.px.withColumn(name, value)
        return name

    def _cover(self):
        return F.lit(1.0) if self.doc.selection is None else F.col(self.doc.selection) / 255.0

    def _merged(self, layers) -> str:
        """Layers composited alone, as a new source of whole levels."""
        fold = compose._Fold(self.doc.px)
        out = fold.layers(layers, fold.empty(), {"shallow": fold.empty(), "deep": None, "shape": None})
        self.doc.px = fold.px
        return self._store([quantise(F.col(c)) / 255.0 for c in out])

    def _pixels(self, layer_id=None) -> dict:
        layer = self.doc.find(self.doc.active if layer_id is None else layer_id)
        if layer["kind"] != "pixel":
            raise Invalid(f"`{layer['name']}` has no pixels")
        if layer.get("locks", {}).get("all") or layer.get("locks", {}).get("pixels"):
            raise Invalid(f"`{layer['name']}` is locked")
        return layer

    def _add(self, layer: dict, above=None):
        layer = {"id": self.doc.new_id(), **layer}
        self.doc.put_above(self.doc.active if above is None else above, layer)
        self.doc.active = layer["id"]
        return layer["id"]

    def _edit(self, layer: dict, new, label: str):
        """New levels of a layer mixed in where selected: whole numbers, premultiplied, halves up; locked transparency stays."""
        old = [F.col(f"{layer['source']}_{c}") for c in CHANNELS]
        cover = F.lit(255) if self.doc.selection is None else F.col(self.doc.selection)
        o, n = [quantise(v).cast("long") for v in old], [v.cast("long") for v in new]
        wo, wn = o[3] * (255 - cover), n[3] * cover
        total = wo + wn
        mixed = [F.when(total > 0, F.floor((a * wo + b * wn + F.floor(total / 2)) / F.nullif(total, F.lit(0)))).otherwise(0) for a, b in zip(o[:3], n[:3])]
        alpha = o[3] if layer.get("locks", {}).get("transparency") else F.floor((total + 127) / 255)
        layer["source"] = self._store([v / 255.0 for v in (*mixed, alpha)])
        return label

    # Documents and layers.

    def _doc_new(self, width, height, background=None, resolution=None):
        if not (0 < width <= 100_000 and 0 < height <= 100_000):
            raise Invalid("canvas must be 1..100000 px on each side")
        images = self.doc.px.select("img").distinct()
        px = images.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
        self.doc = Document(px, width, height, resolution=resolution or 72.0)
        color = (*background, 255)[:4] if background else (0, 0, 0, 0)
        self._add({"name": "Background" if background else "Layer 1", "kind": "pixel", "source": self._store([F.lit(v / 255.0) for v in color])})
        return "New Document"

    def _doc_open_pixels(self, source, name=None):
        """``source``: the prefix of four columns of the document's table that hold the pixels."""
        self.doc.layers, self.doc.selection, self.doc.next_id, self.doc.active = [], None, 1, None
        self._add({"name": "Background", "kind": "pixel", "source": source})
        return "Open"

    def _doc_set_resolution(self, resolution):
        self.doc.resolution = min(10_000.0, max(1.0, resolution))
        return "Image Resolution"

    def _layer_add_pixel(self, name=None, above=None):
        made = self._add({"name": name or self.doc.name("Layer"), "kind": "pixel", "source": self._store([F.lit(0.0)] * 4)}, above)
        return "New Layer", None, {"id": made}

    def _layer_import(self, source, name=None, above=None, x=0, y=0):
        """Pixels from four columns of the table, moved by (x, y)."""
        made = self._add({"name": name or self.doc.name("Layer"), "kind": "pixel", "source": source}, above)
        if x or y:
            self._shift(self.doc.find(made), x, y)
        return "Place", None, {"id": made}

    def _layer_set_pixels(self, source, id=None, respect_selection=False, label="Edit Pixels"):
        layer = self._pixels(id)
        kept, self.doc.selection = self.doc.selection, self.doc.selection if respect_selection else None
        done = self._edit(layer, [quantise(F.col(f"{source}_{c}")) for c in CHANNELS], label)
        self.doc.selection = kept
        return done

    def _mask_column(self):
        return None if self.doc.selection is None else self._column("m", F.col(self.doc.selection) / 255.0)

    def _layer_add_adjustment(self, adjust, settings=None, name=None, above=None):
        made = self._add({"name": name or self.doc.name("Adjustment"), "kind": "adjustment", "adjust": adjust, "settings": settings or {}, "mask": self._mask_column()}, above)
        return "New Adjustment Layer", None, {"id": made}

    def _layer_set_adjustment(self, id, adjust, settings=None):
        layer = self.doc.find(id)
        if layer["kind"] != "adjustment":
            raise Invalid("not an adjustment layer")
        layer.update(adjust=adjust, settings=settings or {})
        return "Adjustment", f"adjust:{id}"

    def _layer_add_fill(self, fill, name=None, above=None):
        made = self._add({"name": name or self.doc.name("Fill"), "kind": "fill", "mask": self._mask_column(), **fill}, above)
        return "New Fill Layer", None, {"id": made}

    def _layer_set_fill(self, id, fill):
        layer = self.doc.find(id)
        if layer["kind"] != "fill":
            raise Invalid("not a fill layer")
        for old in ("color", "gradient", "stops", "from_", "to", "reverse"):
            layer.pop(old, None)
        layer.update(fill)
        return "Fill", f"fill:{id}"

    def _layer_group(self, ids, name=None):
        slots = [(self.doc.slot(i), i) for i in ids]
        if not ids or not all(s for s, _ in slots):
            raise Invalid("nothing to group")
        if len({s[0] for s, _ in slots}) > 1:
            raise Invalid("layers to group must share a parent")
        parent, siblings, top = max((s for s, _ in slots), key=lambda s: s[2])
        children = [siblings[s[2]] for s, _ in sorted(slots, key=lambda s: s[0][2])]
        for child in children:
            siblings.remove(child)
        made = {"id": self.doc.new_id(), "name": name or self.doc.name("Group"), "kind": "group", "pass_through": True, "children": children}
        siblings.insert(top + 1 - len(children), made)
        self.doc.active = made["id"]
        return "Group Layers", None, {"id": made["id"]}

    def _layer_ungroup(self, id):
        group = self.doc.find(id)
        if group["kind"] != "group":
            raise Invalid("not a group")
        _, siblings, at = self.doc.slot(id)
        siblings[at : at + 1] = group["children"]
        self.doc.active = group["children"][0]["id"] if group["children"] else None
        return "Ungroup Layers"

    def _layer_delete(self, ids):
        gone = 0
        for layer_id in ids:
            if self.doc.slot(layer_id):
                self.doc.take(layer_id)
                gone += 1
        if not gone:
            raise Invalid("no layers deleted")
        if self.doc.active is None and self.doc.layers:
            self.doc.active = self.doc.layers[-1]["id"]
        return "Delete Layer" if gone == 1 else f"Delete {gone} Layers"

    def _layer_duplicate(self, ids):
        last = None
        for layer_id in ids:
            twin = copy.deepcopy(self.doc.find(layer_id))
            for layer in self.doc.walk([twin]):
                layer["id"] = self.doc.new_id()
            twin["name"] += " copy"
            self.doc.put_above(layer_id, twin)
            last = twin["id"]
        self.doc.active = last
        return "Duplicate Layer", None, {"id": last}

    def _layer_move(self, id, index, parent=None):
        if parent is not None:
            if parent in {x["id"] for x in self.doc.walk([self.doc.find(id)])}:
                raise Invalid("cannot move a group into itself")
            if self.doc.find(parent)["kind"] != "group":
                raise Invalid("target is not a group")
        own, _, at = self.doc.slot(id) or (None, None, None)
        layer = self.doc.take(id)
        index -= own == parent and at < index
        siblings = self.doc.layers if parent is None else self.doc.find(parent)["children"]
        siblings.insert(min(index, len(siblings)), layer)
        self.doc.active = id
        return "Move Layer"

    def _layer_reorder(self, id, direction):
        found = self.doc.slot(id)
        if not found:
            raise Invalid(f"no layer {id}")
        _, siblings, at = found
        last = len(siblings) - 1
        to = {"up": min(at + 1, last), "down": max(at - 1, 0), "top": last, "bottom": 0}[direction]
        if to == at:
            return None
        siblings.insert(to, siblings.pop(at))
        self.doc.active = id
        return "Arrange Layer"

    def _layer_props(self, id, **props):
        layer, label, key = self.doc.find(id), "Layer Properties", None
        for name in ("name", "visible", "opacity", "fill_opacity", "blend", "clip", "locks", "color_label", "pass_through"):
            if name not in props:
                continue
            value = props.pop(name)
            if name in ("opacity", "fill_opacity"):
                value, label = min(1.0, max(0.0, value)), "Opacity" if name == "opacity" else "Fill Opacity"
                key = f"{name.replace('_', '-')}:{id}"
            elif name == "color_label":
                value = min(7, value)
            else:
                label = {"name": "Rename Layer", "blend": "Blend Mode", "pass_through": "Blend Mode", "locks": "Lock Layer", "visible": "Show Layer" if value else "Hide Layer",
                         "clip": "Create Clipping Mask" if value else "Release Clipping Mask"}[name]
            if name != "pass_through" or layer["kind"] == "group":
                layer[name] = value
        if props:
            raise Invalid(f"unknown properties {sorted(props)}")
        return label, key

    def _shift(self, layer, dx, dy):
        """A layer's pixels, and those of its children, moved; what comes in from outside is transparent."""
        for child in self.doc.walk([layer]):
            names = [f"{child['source']}_{c}" for c in CHANNELS] if child["kind"] == "pixel" else []
            masks = [child["mask"]] if child.get("mask") else []
            if not names + masks:
                continue
            new = {n: self._fresh("s") for n in names + masks}
            moved = self.doc.px.select("img", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(o).alias(n) for o, n in new.items()])
            self.doc.px = self.doc.px.join(moved, ["img", "x", "y"], "left").fillna(0.0, list(new.values()))
            if names:
                child["source"] = self._store([F.col(new[n]) for n in names])
            if masks:
                child["mask"] = new[masks[0]]

    def _layer_offset(self, ids, dx, dy):
        for layer_id in ids:
            layer = self.doc.find(layer_id)
            if layer.get("locks", {}).get("all") or layer.get("locks", {}).get("position"):
                raise Invalid(f"`{layer['name']}` is locked")
        if not (dx or dy):
            return None
        for layer_id in ids:
            self._shift(self.doc.find(layer_id), dx, dy)
        return "Move", f"offset:{list(ids)}"

    def _layer_set_active(self, id=None):
        if id is not None:
            self.doc.find(id)
        self.doc.active = id
        return None

    def _flat(self, layer, source) -> None:
        for old in ("children", "pass_through", "adjust", "settings", "color", "gradient", "stops", "from_", "to", "reverse"):
            layer.pop(old, None)
        layer.update(kind="pixel", source=source)

    def _layer_merge_down(self, id):
        found = self.doc.slot(id)
        if not found or found[2] == 0:
            raise Invalid("there is no layer below to merge into")
        _, siblings, at = found
        below = siblings[at - 1]
        self._flat(below, self._merged(siblings[at - 1 : at + 1]))
        siblings.pop(at)
        below.update(mask=None, blend="normal", opacity=1.0, fill_opacity=1.0, clip=False)
        self.doc.active = below["id"]
        return "Merge Down"

    def _layer_merge_visible(self):
        shown = [x for x in self.doc.layers if x.get("visible", True)]
        if not shown:
            raise Invalid("no visible layers")
        kept, source = shown[0], self._merged(shown)
        self.doc.layers = [x for x in self.doc.layers if not x.get("visible", True) or x is kept]
        self._flat(kept, source)
        kept.update(mask=None, blend="normal", opacity=1.0, clip=False)
        self.doc.active = kept["id"]
        return "Merge Visible"

    def _layer_flatten(self):
        source = self._merged(self.doc.layers)
        self.doc.layers = [{"id": self.doc.new_id(), "name": "Background", "kind": "pixel", "source": source}]
        self.doc.active = self.doc.layers[0]["id"]
        return "Flatten Image"

    def _layer_stamp_visible(self):
        source = self._merged(self.doc.layers)
        layer = {"id": self.doc.new_id(), "name": self.doc.name("Stamp"), "kind": "pixel", "source": source}
        self.doc.layers.append(layer)
        self.doc.active = layer["id"]
        return "Stamp Visible", None, {"id": layer["id"]}

    def _layer_rasterize(self, id):
        layer = self.doc.find(id)
        if layer["kind"] not in ("fill", "group"):
            raise Invalid(f"`{layer['name']}` cannot be rasterized")
        self._flat(layer, self._merged([{**layer, "mask": None, "opacity": 1.0, "blend": "normal"}]))
        return "Rasterize Layer"

    def _layer_add_mask(self, id=None, from_="reveal-all"):
        layer = self.doc.find(self.doc.active if id is None else id)
        if "selection" in from_ and self.doc.selection is None:
            raise Invalid("there is no selection")
        cover = {"reveal-all": lambda: F.lit(1.0), "hide-all": lambda: F.lit(0.0), "selection": self._cover, "hide-selection": lambda: 1 - self._cover()}[from_]()
        layer.update(mask=self._column("m", cover), density=1.0)
        return "Add Layer Mask"

    def _layer_delete_mask(self, id=None, apply=False):
        layer = self.doc.find(self.doc.active if id is None else id)
        if not layer.get("mask"):
            raise Invalid("the layer has no mask")
        if apply:
            old = [F.col(f"{layer['source']}_{c}") for c in CHANNELS]
            alpha = F.floor(quantise(old[3]) * quantise(F.col(layer["mask"])) / 255) / 255.0
            layer["source"] = self._store([*old[:3], alpha])
        layer.update(mask=None, density=1.0)
        return "Apply Layer Mask" if apply else "Delete Layer Mask"

    def _layer_mask_props(self, id, enabled=None, density=None, linked=None):
        layer = self.doc.find(id)
        if not (layer.get("mask") or layer.get("off_mask")):
            raise Invalid("the layer has no mask")
        if enabled is not None:
            held = layer.get("mask") or layer.get("off_mask")
            layer.update(mask=held if enabled else None, off_mask=None if enabled else held)
        if density is not None:
            layer["density"] = min(1.0, max(0.0, density))
        return "Mask Properties"

    def _layer_set_mask_pixels(self, id, source):
        self.doc.find(id)["mask"] = self._column("m", F.col(source))
        return "Edit Mask"

    def _layer_from_selection(self, id=None, cut=False):
        layer = self._pixels(id)
        old = [F.col(f"{layer['source']}_{c}") for c in CHANNELS]
        source = self._store([*old[:3], F.floor(quantise(old[3]) * self._cover() + 0.5) / 255.0])
        if cut:
            self._layer_clear(layer["id"])
        made = {"id": self.doc.new_id(), "name": self.doc.name("Layer"), "kind": "pixel", "source": source}
        self.doc.put_above(layer["id"], made)
        self.doc.active = made["id"]
        return "Layer Via Cut" if cut else "Layer Via Copy", None, {"id": made["id"]}

    def _layer_clear(self, id=None):
        layer = self._pixels(id)
        return self._edit(layer, [quantise(F.col(f"{layer['source']}_{c}")) for c in RGB] + [F.lit(0)], "Clear")

    def _layer_fill_selection(self, color, id=None, opacity=1.0):
        layer = self._pixels(id)
        own = layer["source"]
        fold = compose._Fold(self.doc.px)
        ink = fold.buffer([F.lit(v / 255.0) for v in (*color, 255)[:4]])
        out = fold.over([f"{own}_{c}" for c in CHANNELS], ink, self._cover() * opacity, "normal")
        self.doc.px = fold.px
        alpha = f"{own}_a" if layer.get("locks", {}).get("transparency") else out[3]
        layer["source"] = self._store([quantise(F.col(c)) / 255.0 for c in (*out[:3], alpha)])
        return "Fill"

    # The whole image.

    def _moved(self, x, y, width, height) -> None:
        """Every plane by new places; those off the canvas go, those that were not there are transparent."""
        here = self.doc.px.select(x.cast("int").alias("_x"), y.cast("int").alias("_y"), *[c for c in self.doc.px.columns if c not in ("x", "y")])
        here = here.withColumnsRenamed({"_x": "x", "_y": "y"}).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
        if width > self.doc.width or height > self.doc.height:
            images = self.doc.px.select("img").distinct()
            every = images.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
            here = every.join(here, ["img", "x", "y"], "left").fillna(0)
        self.doc.px, self.doc.width, self.doc.height = here, width, height

    def _image_crop(self, x, y, width, height, delete_cropped=True):
        if width <= 0 or height <= 0:
            raise Invalid("crop must be at least 1x1")
        self._moved(F.col("x") - x, F.col("y") - y, width, height)
        return "Crop"

    def _image_canvas_size(self, width, height, anchor="center"):
        if width <= 0 or height <= 0:
            raise Invalid("canvas must be at least 1x1")
        fx, fy = 0 if "left" in anchor else 2 if "right" in anchor else 1, 0 if "top" in anchor else 2 if "bottom" in anchor else 1
        ox, oy = int((width - self.doc.width) * fx / 2), int((height - self.doc.height) * fy / 2)
        self._moved(F.col("x") + ox, F.col("y") + oy, width, height)
        return "Canvas Size"

    def _image_rotate(self, turns=1):
        w, h, x, y = self.doc.width, self.doc.height, F.col("x"), F.col("y")
        if turns % 4 == 0:
            return None
        nx, ny, nw, nh = {1: (h - 1 - y, x, h, w), 2: (w - 1 - x, h - 1 - y, w, h), 3: (y, w - 1 - x, h, w)}[turns % 4]
        self.doc.width, self.doc.height = nw, nh
        self._moved(nx, ny, nw, nh)
        return {1: "Rotate 90° Clockwise", 2: "Rotate 180°", 3: "Rotate 90° Counter Clockwise"}[turns % 4]

    def _image_flip(self, horizontal=True):
        x = self.doc.width - 1 - F.col("x") if horizontal else F.col("x")
        y = F.col("y") if horizontal else self.doc.height - 1 - F.col("y")
        self._moved(x, y, self.doc.width, self.doc.height)
        return "Flip Canvas Horizontal" if horizontal else "Flip Canvas Vertical"

    # Selections.

    def _select(self, new: DataFrame | None, mode="replace", feather=0.0, label="Select"):
        if new is None:
            self.doc.selection = None
            return label
        new = selection.feather(new, feather) if feather else new
        old = None if self.doc.selection is None else self.doc.px.select("img", "x", "y", F.col(self.doc.selection).alias("cover"))
        name = self._fresh("sel")
        merged = selection.merge(self.doc.px, old, new, mode).withColumnRenamed("cover", name)
        self.doc.px = self.doc.px.join(merged, ["img", "x", "y"])
        self.doc.selection = name
        return label

    def _select_all(self):
        self.doc.selection = self._column("sel", F.lit(255))
        return "Select All"

    def _select_none(self):
        return self._select(None, label="Deselect")

    def _select_invert(self):
        self.doc.selection = self._column("sel", F.lit(0) if self.doc.selection is None else 255 - F.col(self.doc.selection))
        return "Inverse"

    def _select_rect(self, x, y, width, height, feather=0.0, mode="replace"):
        return self._select(selection.rect(self.doc.px, x, y, width, height), mode, feather, "Rectangular Marquee")

    def _select_ellipse(self, x, y, width, height, feather=0.0, mode="replace"):
        return self._select(selection.ellipse(self.doc.px, x, y, width, height), mode, feather, "Elliptical Marquee")

    def _select_polygon(self, points, feather=0.0, mode="replace"):
        return self._select(selection.polygon(self.doc.px, points), mode, feather, "Lasso")

    def _select_mask(self, source, feather=0.0, mode="replace"):
        return self._select(self.doc.px.select("img", "x", "y", quantise(F.col(source)).alias("cover")), mode, feather, "Select Mask")

    def _select_layer_alpha(self, id=None, mode="replace"):
        layer = self._pixels(id)
        return self._select(self.doc.px.select("img", "x", "y", quantise(F.col(f"{layer['source']}_a")).alias("cover")), mode, 0.0, "Load Selection")

    def _changed(self, change, label):
        if self.doc.selection is None:
            raise Invalid("there is no selection")
        new = change(self.doc.px.select("img", "x", "y", F.col(self.doc.selection).alias("cover")))
        return self._select(new, "replace", 0.0, label)

    def _select_feather(self, radius):
        return self._changed(lambda s: selection.feather(s, radius), "Feather")

    def _select_grow(self, by):
        return self._changed(lambda s: selection.grow(s, by), "Expand")

    def _select_shrink(self, by):
        return self._changed(lambda s: selection.shrink(s, by), "Contract")

    def _select_border(self, width):
        return self._changed(lambda s: selection.border(s, width), "Border")

    def _select_smooth(self, radius):
        return self._changed(lambda s: selection.smooth(s, radius), "Smooth")

    def _here(self) -> DataFrame:
        """The composite with alpha, which selections by colour read."""
        return self.flatten()

    def _select_magic_wand(self, x, y, tolerance=32, contiguous=True, smooth=True, mode="replace"):
        return self._select(selection.magic_wand(self._here(), x, y, tolerance, contiguous, smooth), mode, 0.0, "Magic Wand")

    def _select_color_range(self, color=None, preset=None, fuzziness=40.0, mode="replace"):
        if color is None and preset is None:
            raise Invalid("give a color or a preset")
        return self._select(selection.color_range(self._here(), color, preset, fuzziness), mode, 0.0, "Color Range")

    def _select_similar(self, tolerance=32):
        return self._changed(lambda s: selection.similar(self._here(), s, tolerance), "Similar")

    # Filters and results.

    def _filter(self, name: str, id=None, **settings):
        run = getattr(filters, name.replace("-", "_"), None) if name.replace("-", "_") in FILTERS else None
        if run is None:
            raise Invalid(f"unknown operation filter.{name}")
        layer = self._pixels(id)
        levels = self.doc.px.select("img", "x", "y", *[quantise(F.col(f"{layer['source']}_{c}")).alias(c) for c in CHANNELS])
        names = {c: self._fresh("f") for c in CHANNELS}
        done = run(levels, **settings).select("img", "x", "y", *[F.col(c).alias(n) for c, n in names.items()])
        self.doc.px = self.doc.px.join(done, ["img", "x", "y"])
        return self._edit(layer, [F.col(n) for n in names.values()], name.replace("-", " ").title())

    def flatten(self) -> DataFrame:
        """(img, x, y, r, g, b, a): the composite in levels."""
        out = compose.composite(self.doc.px, self.doc.layers)
        return out.select("img", "x", "y", *[quantise(F.col(c)).alias(c) for c in CHANNELS])

    def _analyze_histogram(self):
        return None, None, self.histogram()

    def _analyze_pick(self, x, y, size=1):
        return None, None, raster.pick(self.flatten(), x, y, size)

    def operations(self) -> list[str]:
        """Every operation that :meth:`exec` knows."""
        own = [name[1:].replace("_", ".", 1).replace("_", "-") for name in dir(self) if name.startswith(("_doc_", "_layer_", "_image_", "_select_", "_analyze_"))]
        session = [f"edit.{name}" for name in ("undo", "redo", "history-go", "seal", "squash", "begin", "end", "cancel", "clear-history")]
        return sorted(own + session + [f"filter.{name.replace('_', '-')}" for name in FILTERS])

    def histogram(self) -> DataFrame:
        return raster.histogram(self.flatten().where("a > 0"))

    def layer_rows(self) -> DataFrame:
        """(id, parent, ord, name, kind, visible, opacity, blend, clip) of the tree, 0 for the parent of the top layers."""
        rows = []

        def listed(layers, parent):
            for k, layer in enumerate(layers):
                get = lambda n, layer=layer: layer.get(n, compose.LAYER[n])
                rows.append((layer["id"], parent, k, layer["name"], layer["kind"], get("visible"), float(get("opacity")), get("blend"), get("clip")))
                listed(layer.get("children", []), layer["id"])

        listed(self.doc.layers, 0)
        return self.doc.px.sparkSession.createDataFrame(rows, "id int, parent int, ord int, name string, kind string, visible boolean, opacity double, blend string, clip boolean")
