"""Named tools over rasters and open documents, as a server would offer them.

Rasters are DataFrames (img, x, y, r, g, b, a) of levels; every tool edits all
images of the table at once and gives a plan.  Documents stay open by name, a
bounded number of them; saved ones are a folder of Parquet (the places) and
JSON (the tree).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .editor import Document, Editor, Invalid
from .operators import filters
from .operators.raster import sized

CHANNELS = ("r", "g", "b", "a")
#: Fixed value: documents that are open at once.
OPEN = 8


def _editor(px: DataFrame, width: int, height: int) -> Editor:
    alpha = F.col("a") / 255.0 if "a" in px.columns else F.lit(1.0)
    rows = px.select("img", "x", "y", *[(F.col(c) / 255.0).alias(f"in_{c}") for c in "rgb"], alpha.alias("in_a"))
    editor = Editor(rows, width, height)
    editor.exec({"op": "doc.open-pixels", "source": "in"})
    return editor


def image_info(px: DataFrame) -> DataFrame:
    """(img, width, height, pixels, opaque) of each raster."""
    alpha = F.col("a") if "a" in px.columns else F.lit(255)
    own = px.groupBy("img").agg(F.count("*").alias("pixels"), F.min(alpha == 255).alias("opaque"))
    return sized(px).withColumnsRenamed({"w": "width", "h": "height"}).join(own, "img")


def run_operations(px: DataFrame, width: int, height: int, operations: list[dict]) -> DataFrame:
    """Commands on the rasters as one-layer documents; the first that fails is named."""
    editor = _editor(px, width, height)
    for k, command in enumerate(operations):
        try:
            editor.exec(command)
        except Invalid as wrong:
            raise Invalid(f"operation {k} ({command.get('op')}): {wrong}") from wrong
    return editor.flatten()


def resize_image(px: DataFrame, width: int, height: int, new_width: int | None = None, new_height: int | None = None, method: str = "bicubic") -> DataFrame:
    """A missing side follows from the other by the picture's proportions."""
    if new_width is None and new_height is None:
        raise Invalid("give a width or a height")
    new_width = new_width or max(1, int(width * new_height / height + 0.5))
    new_height = new_height or max(1, int(height * new_width / width + 0.5))
    return filters.resize(px, width, height, new_width, new_height, method)


def crop_image(px: DataFrame, width: int, height: int, x: int, y: int, new_width: int, new_height: int) -> DataFrame:
    return run_operations(px, width, height, [{"op": "image.crop", "x": x, "y": y, "width": new_width, "height": new_height}])


def rotate_flip_image(px: DataFrame, width: int, height: int, turns: int = 0, flip: str | None = None) -> DataFrame:
    steps = [{"op": "image.rotate", "turns": turns}] if turns % 4 else []
    return run_operations(px, width, height, steps + ([{"op": "image.flip", "horizontal": flip == "horizontal"}] if flip else []))


def adjust_image(px: DataFrame, width: int, height: int, kind: str, **settings) -> DataFrame:
    return run_operations(px, width, height, [{"op": "filter.apply-adjustment", "kind": kind, **settings}])


def filter_image(px: DataFrame, width: int, height: int, name: str, **settings) -> DataFrame:
    return run_operations(px, width, height, [{"op": f"filter.{name}", **settings}])


def batch_edit(px: DataFrame, width: int, height: int, recipes: dict[str, list[dict]]) -> DataFrame:
    """Every image by every recipe: the rows with a column recipe."""
    out = None
    for name, operations in recipes.items():
        made = run_operations(px, width, height, operations).withColumn("recipe", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return out


class Sessions:
    """Open documents by name."""

    def __init__(self):
        self.editors: dict[str, Editor] = {}

    def _get(self, name: str) -> Editor:
        if name not in self.editors:
            raise Invalid(f"no open document {name}")
        return self.editors[name]

    def open_document(self, name: str, px: DataFrame, width: int, height: int) -> dict:
        if name not in self.editors and len(self.editors) >= OPEN:
            raise Invalid(f"{OPEN} documents are open")
        self.editors[name] = _editor(px, width, height)
        return self.document_state(name)

    def apply_operations(self, name: str, operations: list[dict], label: str = "Edit") -> dict:
        """All as one step, or none."""
        editor = self._get(name)
        editor.exec({"op": "edit.begin", "label": label})
        try:
            editor.run(operations)
        except Exception:
            editor.exec({"op": "edit.cancel"})
            raise
        editor.exec({"op": "edit.end"})
        return self.document_state(name)

    def undo(self, name: str) -> dict:
        return self._get(name).exec({"op": "edit.undo"})

    def redo(self, name: str) -> dict:
        return self._get(name).exec({"op": "edit.redo"})

    def document_state(self, name: str) -> dict:
        editor = self._get(name)
        doc = editor.doc
        return {
            "width": doc.width, "height": doc.height, "active": doc.active, "revision": editor.revision, "layers": [x["id"] for x in doc.walk()],
            "undo": [label for _, label in editor.history.undo_stack], "redo": [label for _, label in reversed(editor.history.redo_stack)],
        }

    def render_preview(self, name: str, size: int = 64) -> DataFrame:
        """The composite, no side longer than ``size``."""
        doc = self._get(name).doc
        scale = min(1.0, size / max(doc.width, doc.height))
        new = [max(1, int(v * scale + 0.5)) for v in (doc.width, doc.height)]
        return filters.resize(self._get(name).flatten(), doc.width, doc.height, *new, "bilinear")

    def save_document(self, name: str, path: str) -> None:
        """Places as Parquet with only the columns that the tree names, and the tree as JSON."""
        doc = self._get(name).doc
        used = {f"{x['source']}_{c}" for x in doc.walk() if x["kind"] == "pixel" for c in CHANNELS} | {x["mask"] for x in doc.walk() if x.get("mask")} | ({doc.selection} if doc.selection else set())
        doc.px.select("img", "x", "y", *sorted(used)).write.mode("overwrite").parquet(f"{path}/places")
        tree = {"width": doc.width, "height": doc.height, "layers": doc.layers, "active": doc.active, "selection": doc.selection, "resolution": doc.resolution, "next_id": doc.next_id}
        spark = doc.px.sparkSession
        spark.createDataFrame([(json.dumps(tree),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/tree")

    def load_document(self, spark: SparkSession, name: str, path: str) -> dict:
        """A saved document; sizes and kinds are checked before it is built."""
        tree = json.loads(spark.read.text(f"{path}/tree").first().value)
        if not (0 < tree["width"] <= 100_000 and 0 < tree["height"] <= 100_000):
            raise Invalid("canvas must be 1..100000 px on each side")
        px = spark.read.parquet(f"{path}/places")
        editor = Editor(px, tree["width"], tree["height"])
        editor.doc = Document(px, **tree)
        for layer in editor.doc.walk():
            if layer["kind"] not in ("pixel", "fill", "adjustment", "group"):
                raise Invalid(f"unknown layer kind {layer['kind']}")
        # New columns must not take the names of saved ones.
        editor._columns = max([0, *(int(d) for c in px.columns if (d := "".join(x for x in c.split("_")[0] if x.isdigit())))])
        self.editors[name] = editor
        return self.document_state(name)

    def close_document(self, name: str) -> None:
        self._get(name)
        del self.editors[name]

