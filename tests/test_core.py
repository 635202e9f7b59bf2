import pytest
from pyspark.sql import functions as F

from tests import oracle
from tesserae import editor, tools
from tesserae.functions import blend, tone
from tesserae.sources import formats
from tesserae.operators import cull, filters, graph, library, raster, relational, selection
from tesserae.plans import queries as plans

SF = "sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, db, name):
    same, why = oracle.same(spark, db, plans.QUERIES[name], plans.ORACLES[name], SF)
    assert same, why


def grid(spark, side, value):
    rows = [(0, x, y, *value(x, y)) for x in range(side) for y in range(side)]
    return spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int")


def test_flat_image_stays_flat(spark):
    px = grid(spark, 9, lambda x, y: (40, 90, 200))
    for out in (raster.box_blur(px, 3), raster.pixelate(px, 4), raster.extreme(px, 2, True)):
        assert {tuple(r) for r in out.select("r", "g", "b").distinct().collect()} == {(40, 90, 200)}


def test_box_blur_equals_brute_force(spark):
    value = lambda x, y: ((x * 37 + y * 11) % 256, (x * y) % 256, (x ^ y) % 256)
    out = {(r.x, r.y): (r.r, r.g, r.b) for r in raster.box_blur(grid(spark, 12, value), 2).collect()}
    at = lambda v: min(11, max(0, v))
    for (x, y), got in out.items():
        near = [value(at(x + i), at(y + j)) for i in range(-2, 3) for j in range(-2, 3)]
        assert got == tuple(int(sum(c) / 25 + 0.5) for c in zip(*near))


@pytest.mark.parametrize("mode", ["hue", "saturation", "color", "luminosity"])
def test_whole_colour_modes_stay_in_range(spark, mode):
    rows = spark.createDataFrame([(0.1, 0.9, 0.3, 0.8, 0.2, 0.5), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.2, 0.9, 0.1)], "a double, b double, c double, d double, e double, f double")
    out = rows.select(*[x.alias(f"o{k}") for k, x in enumerate(blend.blend(mode, [rows.a, rows.b, rows.c], [rows.d, rows.e, rows.f]))])
    for row in out.collect():
        assert all(-1e-9 <= v <= 1 + 1e-9 for v in row)


def test_subtract_nothing_keeps_a_selection(spark):
    rows = spark.range(256).select(raster.combine("subtract", F.col("id"), F.lit(0)).alias("v"), "id")
    assert rows.where("v <> id").count() == 0


def test_names_are_unique(spark):
    items = spark.createDataFrame([(1, "A", 1, "2020-01-01"), (2, "a", 1, "2020-01-01"), (3, "b", 1, "2020-01-01")], "path int, kind string, rating int, capture string")
    names = [r.name for r in library.named(items.withColumn("capture", F.to_timestamp("capture"))).orderBy("path").collect()]
    assert names == ["a_20200101_1", "a_20200101_1-2", "b_20200101_1"]


def test_components_equal_brute_force(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (20, 3), *[(100 + i, 101 + i) for i in range(30)]]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, **{100 + i: 100 for i in range(31)}}


def test_two_frames_eight_bits_apart_group_by_time(spark):
    far = [(1, 0, 0, 0), (2, 0xFF, 0xFF, 3_600_000)]
    near = [(1, 0, 0, 0), (2, 0xFF, 0xFF, 1000)]
    schema = "path long, dhash long, phash long, capture long"
    assert cull.duplicates(spark.createDataFrame(far, schema)).count() == 0
    assert {tuple(r) for r in cull.duplicates(spark.createDataFrame(near, schema)).collect()} == {(1, 1), (2, 1)}
    assert {tuple(r) for r in cull.duplicates(spark.createDataFrame([(5, 7, 7, None), (3, 7, 7, None)], schema)).collect()} == {(5, 3), (3, 3)}


def test_wand_floods_around_bends(spark):
    picture = ["..#...", ".##.#.", "....#.", "#####.", "......"]
    rows = [(0, x, y, *([0] * 3 if c == "." else [255] * 3)) for y, line in enumerate(picture) for x, c in enumerate(line)]
    px = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int")
    got = {(r.x, r.y) for r in selection.magic_wand(px, 0, 0, 10, contiguous=True).where("cover > 0").collect()}
    reached, todo = set(), [(0, 0)]
    while todo:
        x, y = todo.pop()
        if 0 <= x < 6 and 0 <= y < 5 and picture[y][x] == "." and (x, y) not in reached:
            reached.add((x, y))
            todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    assert got == reached


def test_asof_join_takes_the_latest_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60), ("b", 10, 1)], "k string, t int, v int")
    assert {(r.id, r.v) for r in relational.asof_join(left, right, "k", "t", ["v"]).collect()} == {(1, 50), (2, None), (3, None), (4, None)}


def test_warp_of_nothing_is_the_picture(spark):
    px = grid(spark, 7, lambda x, y: (x * 30, y * 30, (x * y * 7) % 256))
    out = filters.warp(px, F.col("x") + 0.5, F.col("y") + 0.5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, px.collect()))


def test_frequency_layers_give_the_picture_back(spark):
    px = grid(spark, 8, lambda x, y: ((x * 37 + y * 11) % 256, (x * y) % 256, (x ^ y) * 9 % 256))
    for r in filters.frequency_separation(px, 1.5).collect():
        assert all(r[f"low_{c}"] + 2 * r[f"high_{c}"] - 255 == r[c] for c in "rgb")


def test_adjustments_keep_other_columns(spark):
    px = grid(spark, 3, lambda x, y: (40, 90, 200)).withColumns({c: F.col(c) / 255.0 for c in "rgb"}).withColumn("a", F.lit(0.5))
    for kind, run in tone.ADJUSTMENTS.items():
        more = {"colors": {"reds": (1, 2, 3, 4)}} if kind == "selective-color" else {"size": 2, "table": [(0, 0, 0)] * 8} if kind == "color-lookup" else {}
        assert sorted(run(px, **more).columns) == sorted(px.columns), kind


def test_a_failed_command_changes_nothing(spark):
    px = spark.createDataFrame([(0, x, y, 0.1, 0.2, 0.3, 1.0) for x in range(3) for y in range(2)], "img int, x int, y int, l_r double, l_g double, l_b double, l_a double")
    ed = editor.Editor(px, 3, 2)
    ed.run([{"op": "doc.open-pixels", "source": "l"}, {"op": "layer.add-pixel"}])
    rows = sorted(map(tuple, ed.layer_rows().collect()))
    for bad in (
        {"op": "layer.delete", "ids": [99]}, {"op": "layer.move", "id": 1, "index": 0, "parent": 2}, {"op": "nothing.here"}, {"op": "filter.none"}, {"op": "layer.merge-down", "id": 1},
        {"op": "image.crop", "x": 0, "y": 0, "width": 0, "height": 1}, {"op": "layer.props", "id": 1, "colour": 3}, {"op": "select.grow", "by": 2}, {"op": "layer.rasterize", "id": 1}, {},
    ):
        with pytest.raises(editor.Invalid):
            ed.exec(bad)
    assert sorted(map(tuple, ed.layer_rows().collect())) == rows and len(ed.history.undo_stack) == 1
    assert ed.exec({"op": "edit.undo"})["label"] == "New Layer" and ed.exec({"op": "edit.undo"}) == {"changed": False, "label": None, "revision": ed.revision}


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_documents_are_kept_by_name(spark, tmp_path):
    px = grid(spark, 6, lambda x, y: (x * 40, y * 40, 90)).withColumn("a", F.lit(255))
    held = tools.Sessions()
    assert held.open_document("one", px, 6, 6)["layers"] == [1]
    steps = [{"op": "select.rect", "x": 1, "y": 1, "width": 3, "height": 2}, {"op": "layer.fill-selection", "color": [1, 2, 3]}, {"op": "layer.add-adjustment", "adjust": "invert"}]
    assert held.apply_operations("one", steps, "Both")["undo"] == ["Both"]
    with pytest.raises(editor.Invalid):
        held.apply_operations("one", [{"op": "layer.add-pixel"}, {"op": "layer.delete", "ids": [77]}])
    assert held.document_state("one")["undo"] == ["Both"] and held.undo("one")["label"] == "Both" and held.redo("one")["label"] == "Both"
    held.save_document("one", f"{tmp_path}/saved")
    rows = lambda name: sorted(map(tuple, held.editors[name].flatten().collect()))
    assert held.load_document(spark, "two", f"{tmp_path}/saved")["layers"] == [1, 2] and rows("two") == rows("one")
    inside = {r[1:3]: r[3:6] for r in rows("one")}
    assert inside[(1, 1)] == (254, 253, 252) and inside[(0, 0)] == (0, 0, 90)
    assert held.render_preview("two", 3).count() == 9
    held.close_document("one")
    with pytest.raises(editor.Invalid):
        held.undo("one")


def test_tools_edit_whole_tables(spark):
    px = grid(spark, 5, lambda x, y: (x * 50, y * 50, 90))
    assert tuple(tools.image_info(px).first()) == (0, 5, 5, 25, True)
    assert {(r.x, r.y, r.r) for r in tools.rotate_flip_image(px, 5, 5, 1).collect()} == {(4 - y, x, x * 50) for x in range(5) for y in range(5)}
    assert tools.resize_image(px, 5, 5, new_width=10).count() == 100 and tools.crop_image(px, 5, 5, 1, 1, 2, 3).count() == 6
    both = tools.batch_edit(px, 5, 5, {"plain": [], "negative": [{"op": "filter.invert"}]})
    assert {(r.recipe, r.b) for r in both.collect()} == {("plain", 90), ("negative", 165)}
    with pytest.raises(editor.Invalid, match="operation 1"):
        tools.run_operations(px, 5, 5, [{"op": "filter.invert"}, {"op": "filter.nothing"}])


def test_cubes():
    body = "\n".join(f"{r} {g} {b}" for b in (0, 2) for g in (0, 2) for r in (0, 2))
    size, table = formats.parse_cube(f'TITLE "x"\n# note\nLUT_3D_SIZE 2\nDOMAIN_MAX 2 2 2\n{body}\n')
    assert size == 2 and table == [(r, g, b) for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    for bad in ("LUT_1D_SIZE 2\n0 0 0", "LUT_3D_SIZE 2\n0 0 0", ""):
        with pytest.raises(ValueError):
            formats.parse_cube(bad)


@pytest.mark.parametrize("name", ["pinch", "spherize", "twirl", "polar_coordinates", "polar_to_rectangular", "ripple"])
def test_warps_never_broadcast_pixels(spark, name):
    """A raster is far larger than the table that its size is guessed from."""
    plan = plans.QUERIES[f"filter_{name}"](spark, f"{oracle.DATA}/{SF}")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [img" in line and ", sy" in line]
    assert joins and all("SortMergeJoin" in line for line in joins) and "hashpartitioning(img" in plan


def test_warp_takes_alpha_and_places_that_stay(spark):
    rows = [(0, x, y, 200 * (x % 2), 10 * x, 7 * y, 255 if x != 3 else 0) for x in range(6) for y in range(5)]
    px = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int, a int")
    out = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in filters.warp(px, F.col("x") + 1.0, F.col("y") + 0.5, F.col("y") < 2).collect()}
    value = {(x, y): (r, g, b, a) for _, x, y, r, g, b, a in rows}
    for (x, y), got in out.items():
        near = [value[(x, y)]] if y >= 2 else [value[(x, y)], value[(min(5, x + 1), y)]]
        alpha = sum(v[3] for v in near) / len(near)
        mixed = [sum(v[k] * v[3] for v in near) / len(near) / alpha if alpha else 0 for k in range(3)]
        assert got == tuple(int(v + 0.5 + 1e-9) for v in (*mixed, alpha)), (x, y)
    assert len(out) == 30


def test_flood_of_a_tall_image_takes_few_rounds(spark):
    """A channel that winds down 80 rows, beside one that is apart from it."""
    hit = lambda x, y: x == 6 or (x < 5 if y % 4 == 0 else x == (0 if y % 8 < 4 else 4))
    rows = [(i, x, y, *([200 if hit(x, y) else 0] * 3)) for i in range(2) for x in range(7) for y in range(80)]
    px = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int")
    rounds = []
    keep = lambda table: (rounds.append(1), graph.kept(table))[1]
    out = selection.magic_wand(px, 0, 0, 10, contiguous=True, keep=keep).where("cover > 0").collect()
    assert {(r.img, r.x, r.y) for r in out} == {(i, x, y) for i, x, y, r, _, _ in rows if r and x < 6} and len(rounds) < 20


def test_block_means_of_small_and_tall_images(spark):
    """Every block has a mean: of images smaller than the blocks are many, and of those taller than 200 places."""
    sizes = {0: (1, 1), 1: (3, 2), 2: (7, 10), 3: (64, 11), 4: (2, 433)}
    level = lambda i, x, y: (x * 37 + y * 91 + i) % 256
    rows = [(i, x, y, level(i, x, y)) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)]
    lum = spark.createDataFrame(rows, "img int, x int, y int, lum int")
    for n, m in ((9, 8), (32, 32)):
        out = {(r.img, r.x, r.y): r.v for r in cull.resample(lum, n, m).collect()}
        span = lambda k, size, n: range(k * size // n, max(k * size // n + 1, min(size, (k + 1) * size // n)))
        expected = {}
        for i, (w, h) in sizes.items():
            for cx in range(n):
                for cy in range(m):
                    found = [level(i, x, y) for x in span(cx, w, n) for y in span(cy, h, m)]
                    expected[(i, cx, cy)] = sum(found) / len(found)
        assert out.keys() == expected.keys() and all(abs(out[k] - expected[k]) < 1e-9 for k in out)
