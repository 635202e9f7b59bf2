"""Queries of the command facade: scripts of commands, their layers, their history and what they draw."""

from __future__ import annotations

from ..editor import Editor
from ..sources.adapters import LAYERED_SQL, SIDE, layered
from .common import ORACLES, QUERIES, level
from .stacks import RGBA, over, start
from .tones import d

#: The document's height in rows; images have 64 columns.
HEIGHT = 40
DOC = LAYERED_SQL + f", page AS (SELECT * FROM doc WHERE y < {HEIGHT})"
START = start("b0", "page")


def opened(spark, sf_dir) -> Editor:
    editor = Editor(layered(spark, sf_dir).where(f"y < {HEIGHT}"), SIDE, HEIGHT)
    return editor.run([{"op": "doc.open-pixels", "source": "la"}, {"op": "layer.import", "source": "lb", "name": "B"}, {"op": "layer.import", "source": "lc", "name": "C"}])


def _drawn(name: str, commands: list[dict], steps: str, last: str, places: str = "x, y") -> None:
    QUERIES[f"editor_{name}"] = lambda spark, sf_dir: opened(spark, sf_dir).run(commands).flatten()
    ORACLES[f"editor_{name}"] = f"WITH {DOC}{steps} SELECT img, {places}, " + ", ".join(f"{level(f'{last}_{c}')} AS {c}" for c in RGBA) + f" FROM {last}"


def _rows(name: str, commands: list[dict], make, columns: str, rows: list[tuple]) -> None:
    """A script whose result is metadata, given row by row as the commands' definitions say."""
    QUERIES[f"editor_{name}"] = lambda spark, sf_dir: make(opened(spark, sf_dir).run(commands))
    one = lambda v: "true" if v is True else "false" if v is False else d(v) if isinstance(v, float) else repr(v)
    ORACLES[f"editor_{name}"] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


_TREE = "id, parent, ord, name, kind, visible, opacity, blend, clip"


def _tree(editor: Editor):
    return editor.layer_rows()


_rows(
    "layers",
    [
        {"op": "layer.add-fill", "fill": {"color": [10, 20, 30]}, "name": "Tint"}, {"op": "layer.group", "ids": [3, 2], "name": "G"}, {"op": "layer.duplicate", "ids": [2]},
        {"op": "layer.reorder", "id": 4, "direction": "bottom"}, {"op": "layer.move", "id": 3, "index": 1}, {"op": "layer.props", "id": 3, "opacity": 0.4, "blend": "multiply"},
        {"op": "layer.delete", "ids": [1]}, {"op": "edit.undo"}, {"op": "layer.props", "id": 6, "name": "Top"},
    ],
    _tree, _TREE,
    [
        (4, 0, 0, "Tint", "fill", True, 1.0, "normal", False), (3, 0, 1, "C", "pixel", True, 0.4, "multiply", False), (1, 0, 2, "Background", "pixel", True, 1.0, "normal", False),
        (5, 0, 3, "G", "group", True, 1.0, "normal", False), (2, 5, 0, "B", "pixel", True, 1.0, "normal", False), (6, 5, 1, "Top", "pixel", True, 1.0, "normal", False),
    ],
)
_rows(
    "ungroup_and_merge",
    [
        {"op": "layer.group", "ids": [2, 3]}, {"op": "layer.ungroup", "id": 4}, {"op": "layer.props", "id": 3, "clip": True, "visible": False}, {"op": "layer.merge-visible"},
        {"op": "layer.stamp-visible"}, {"op": "layer.add-adjustment", "adjust": "invert"},
    ],
    _tree, _TREE,
    [(1, 0, 0, "Background", "pixel", True, 1.0, "normal", False), (3, 0, 1, "C", "pixel", False, 1.0, "normal", True), (5, 0, 2, "Stamp 1", "pixel", True, 1.0, "normal", False),
     (6, 0, 3, "Adjustment 1", "adjustment", True, 1.0, "normal", False)],
)


def _steps(editor: Editor):
    spark = editor.doc.px.sparkSession
    labels = [(k, "undo", label) for k, (_, label) in enumerate(editor.history.undo_stack)] + [(k, "redo", label) for k, (_, label) in enumerate(reversed(editor.history.redo_stack))]
    return spark.createDataFrame(labels, "place int, stack string, label string")


_opacity = [{"op": "layer.props", "id": 2, "opacity": v} for v in (0.9, 0.8, 0.7)]
_rows(
    "history_merges", [*_opacity, {"op": "edit.seal"}, _opacity[0], {"op": "layer.props", "id": 2, "name": "Again"}, {"op": "edit.undo"}], _steps, "place, stack, label",
    [(0, "undo", "Place"), (1, "undo", "Place"), (2, "undo", "Opacity"), (3, "undo", "Opacity"), (0, "redo", "Rename Layer")],
)
_rows(
    "history_transactions",
    [
        {"op": "edit.begin", "label": "Batch"}, *_opacity, {"op": "edit.begin"}, {"op": "layer.props", "id": 3, "visible": False}, {"op": "edit.end"}, {"op": "edit.end"},
        {"op": "edit.begin"}, {"op": "layer.delete", "ids": [3]}, {"op": "edit.cancel"}, {"op": "layer.delete", "ids": [3]}, {"op": "layer.add-pixel"}, {"op": "edit.squash", "index": 3, "label": "Tidy"},
        {"op": "layer.add-pixel"}, {"op": "edit.history-go", "index": 3},
    ],
    _steps, "place, stack, label", [(0, "undo", "Place"), (1, "undo", "Place"), (2, "undo", "Batch"), (0, "redo", "Tidy"), (1, "redo", "New Layer")],
)

_A = START + over("b1", "b0", "la")
_drawn("undo_redo", [{"op": "layer.delete", "ids": [3]}, {"op": "layer.props", "id": 2, "blend": "screen"}, {"op": "edit.undo"}, {"op": "edit.undo"}, {"op": "edit.redo"}], _A + over("b2", "b1", "lb"), "b2")


def whole(name: str, source: str, rows: str | None = None) -> str:
    """A buffer in whole levels."""
    return f", {name} AS (SELECT *, " + ", ".join(f"{level(f'{source}_{c}')} / 255.0::DOUBLE AS {name}_{c}" for c in RGBA) + f" FROM {rows or source})"


_drawn(
    "merge_down", [{"op": "layer.props", "id": 2, "blend": "multiply", "opacity": 0.6}, {"op": "layer.merge-down", "id": 2}],
    _A + over("b2", "b1", "lb", "0.6::DOUBLE", "multiply") + whole("w", "b2") + over("b3", "w", "lc"), "b3",
)
_drawn("flatten", [{"op": "layer.props", "id": 3, "opacity": 0.5}, {"op": "layer.flatten"}], _A + over("b2", "b1", "lb") + over("b3", "b2", "lc", "0.5::DOUBLE"), "b3")
_drawn(
    "rasterize_group", [{"op": "layer.group", "ids": [2, 3]}, {"op": "layer.props", "id": 4, "opacity": 0.5}, {"op": "layer.rasterize", "id": 4}],
    _A + start("g0", "b1") + over("g1", "g0", "lb") + over("g2", "g1", "lc") + whole("w", "g2") + over("b2", "b1", "w", "0.5::DOUBLE", rows="w"), "b2",
)
_RECT = "(CASE WHEN x BETWEEN 10 AND 39 AND y BETWEEN 5 AND 24 THEN 255 ELSE 0 END)"
_rect = {"op": "select.rect", "x": 10, "y": 5, "width": 30, "height": 20}
_INK = ", ink AS (SELECT *, 250 / 255.0::DOUBLE AS ink_r, 20 / 255.0::DOUBLE AS ink_g, 90 / 255.0::DOUBLE AS ink_b, 1.0::DOUBLE AS ink_a FROM b1)"
_drawn(
    "fill_selection", [{"op": "layer.delete", "ids": [3]}, _rect, {"op": "layer.fill-selection", "id": 2, "color": [250, 20, 90], "opacity": 0.5}],
    _A + _INK + over("f", "lb", "ink", f"({_RECT} / 255.0::DOUBLE * 0.5::DOUBLE)", rows="ink") + whole("w", "f") + over("b2", "b1", "w", rows="w"), "b2",
)
_drawn(
    "fill_selection_locked", [{"op": "layer.delete", "ids": [3]}, {"op": "layer.props", "id": 2, "locks": {"transparency": True}}, _rect, {"op": "layer.fill-selection", "id": 2, "color": [250, 20, 90]}],
    _A + _INK + over("f", "lb", "ink", f"({_RECT} / 255.0::DOUBLE)", rows="ink") + whole("k", "f") + ", w AS (SELECT *, k_r AS w_r, k_g AS w_g, k_b AS w_b, lb_a AS w_a FROM k)" + over("b2", "b1", "w", rows="w"), "b2",
)
_drawn(
    "clear", [{"op": "layer.delete", "ids": [3]}, _rect, {"op": "layer.clear", "id": 2}],
    _A + f", w AS (SELECT *, lb_r AS w_r, lb_g AS w_g, lb_b AS w_b, CASE WHEN {_RECT} > 0 THEN 0.0::DOUBLE ELSE lb_a END AS w_a FROM b1)" + over("b2", "b1", "w", rows="w"), "b2",
)
_drawn(
    "layer_via_copy", [{"op": "select.mask", "source": "m"}, {"op": "layer.from-selection", "id": 2}, {"op": "layer.delete", "ids": [3, 2]}],
    _A + f", w AS (SELECT *, lb_r AS w_r, lb_g AS w_g, lb_b AS w_b, floor({level('lb_a')} * ({level('m')} / 255.0::DOUBLE) + 0.5) / 255 AS w_a FROM b1)" + over("b2", "b1", "w", rows="w"), "b2",
)
_drawn(
    "apply_mask", [{"op": "select.mask", "source": "m"}, {"op": "layer.delete", "ids": [3]}, {"op": "layer.add-mask", "id": 2, "from_": "hide-selection"}, {"op": "layer.delete-mask", "id": 2, "apply": True}],
    _A + f", w AS (SELECT *, lb_r AS w_r, lb_g AS w_g, lb_b AS w_b, ({level('lb_a')} * (255 - {level('m')}) // 255) / 255.0::DOUBLE AS w_a FROM b1)" + over("b2", "b1", "w", rows="w"), "b2",
)
_EDIT = lambda o, n, c: f"(({o} * 255 * (255 - {c}) + {n} * 255 * {c} + 32512) // 65025)"
_drawn(
    "filter_selection", [{"op": "layer.delete", "ids": [2, 3]}, {"op": "select.mask", "source": "m"}, {"op": "filter.solarize", "id": 1}],
    ", w AS (SELECT *, " + ", ".join(f"{_EDIT(level(f'la_{c}'), f'(CASE WHEN {level(f"la_{c}")} > 127 THEN 255 - {level(f"la_{c}")} ELSE {level(f"la_{c}")} END)', level('m'))} / 255.0::DOUBLE AS w_{c}" for c in "rgb") + ", 1.0::DOUBLE AS w_a FROM page)", "w",
)
_drawn(
    "adjust_selection", [{"op": "select.mask", "source": "m"}, {"op": "layer.add-adjustment", "adjust": "invert", "above": 2}],
    _A + over("b2", "b1", "lb") + ", b3 AS (SELECT *, " + ", ".join(f"b2_{c} + (1 - 2 * b2_{c}) * ({level('m')} / 255.0::DOUBLE) AS b3_{c}" for c in "rgb") + ", b2_a AS b3_a FROM b2)" + over("b4", "b3", "lc"), "b4",
)
_B = _A + over("b2", "b1", "lb") + over("b3", "b2", "lc")
for _turns, _places in {1: f"{HEIGHT - 1} - y AS x, x AS y", 2: f"63 - x AS x, {HEIGHT - 1} - y AS y", 3: "y AS x, 63 - x AS y"}.items():
    _drawn(f"rotate_{_turns}", [{"op": "image.rotate", "turns": _turns}], _B, "b3", _places)
_drawn("flip_vertical", [{"op": "image.flip", "horizontal": False}], _B, "b3", f"x, {HEIGHT - 1} - y AS y")
_drawn("crop", [{"op": "image.crop", "x": 8, "y": 4, "width": 30, "height": 20}], _B + ", b4 AS (SELECT * FROM b3 WHERE x BETWEEN 8 AND 37 AND y BETWEEN 4 AND 23)".replace("SELECT *", "SELECT *, " + ", ".join(f"b3_{c} AS b4_{c}" for c in RGBA)), "b4", "x - 8 AS x, y - 4 AS y")
_drawn(
    "canvas_size", [{"op": "image.canvas-size", "width": 70, "height": HEIGHT + 4, "anchor": "center"}],
    _B + f", pl AS (SELECT img, x, y FROM (SELECT DISTINCT img FROM page) i, (SELECT unnest(range(70)) AS x) a, (SELECT unnest(range({HEIGHT + 4})) AS y) b)"
    + ", w AS (SELECT pl.img, pl.x, pl.y, " + ", ".join(f"coalesce(b3_{c}, 0) AS w_{c}" for c in RGBA) + " FROM pl LEFT JOIN b3 ON b3.img = pl.img AND b3.x = pl.x - 3 AND b3.y = pl.y - 2)", "w", "x::INT AS x, y::INT AS y",
)
_drawn(
    "offset", [{"op": "layer.delete", "ids": [3]}, {"op": "layer.offset", "ids": [2], "dx": 5, "dy": -3}],
    _A + ", s AS (SELECT b1.*, " + ", ".join(f"coalesce(p.lb_{c}, 0) AS s_{c}" for c in RGBA) + " FROM b1 LEFT JOIN page p ON p.img = b1.img AND p.x = b1.x - 5 AND p.y = b1.y + 3)" + over("b2", "b1", "s", rows="s"), "b2",
)
_drawn(
    "new_document", [{"op": "doc.new", "width": 9, "height": 7, "background": [10, 200, 30]}, {"op": "layer.add-fill", "fill": {"color": [255, 0, 0, 51]}}],
    ", w AS (SELECT img, x, y, (10 * 0.8::DOUBLE + 51) / 255 AS w_r, 160 / 255.0::DOUBLE AS w_g, 24 / 255.0::DOUBLE AS w_b, 1.0::DOUBLE AS w_a FROM (SELECT DISTINCT img FROM page) i, (SELECT unnest(range(9)) AS x) a, (SELECT unnest(range(7)) AS y) b)", "w", "x::INT AS x, y::INT AS y",
)
_SEED = ", hard AS (SELECT p.*, CASE WHEN greatest(abs(r0 - s0), abs(g0 - s1), abs(b0 - s2)) <= 60 THEN 1 ELSE 0 END AS hit FROM lv p JOIN (SELECT img, r0 AS s0, g0 AS s1, b0 AS s2 FROM lv WHERE x = 12 AND y = 9) q USING (img))"
_LV = ", lv AS (SELECT *, " + ", ".join(f"{level(f'b1_{c}')} AS {c}0" for c in "rgb") + " FROM b1)"
_drawn(
    "fill_by_colour", [{"op": "layer.delete", "ids": [2, 3]}, {"op": "select.magic-wand", "x": 12, "y": 9, "tolerance": 60, "contiguous": False, "smooth": False}, {"op": "layer.fill-selection", "id": 1, "color": [0, 0, 255]}],
    _A + _LV + _SEED + ", w AS (SELECT img, x, y, CASE WHEN hit = 1 THEN 0.0::DOUBLE ELSE b1_r END AS w_r, CASE WHEN hit = 1 THEN 0.0::DOUBLE ELSE b1_g END AS w_g, CASE WHEN hit = 1 THEN 1.0::DOUBLE ELSE b1_b END AS w_b, b1_a AS w_a FROM hard)", "w",
)
