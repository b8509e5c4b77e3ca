"""Literal cases: small inputs with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.operators import detection, evaluation, layout, pixels, rasters, recognition
from pagewright.operators.graph import connected
from pagewright.plans import pipelines
from pagewright.plans.models import Model, Slot
from pagewright.sources import tables
from pagewright.streaming import streams


def regions(spark, rows, page_w=400.0, page_h=300.0, direction="Horizontal"):
    made = [(1, i, text, *map(float, box), 0.9) for i, (text, *box) in enumerate(rows)]
    d = spark.createDataFrame(made, "page_id long, seq int, text string, x double, y double, w double, h double, det_conf double")
    return d.withColumns({"quad": g.quad_from_rect(*[F.col(c) for c in "xywh"]), "direction": F.lit(direction), "page_w": F.lit(page_w), "page_h": F.lit(page_h)})


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def quad(*points):
    return F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


RECT = [(10, 10), (50, 10), (50, 30), (10, 30)]


def test_unclip_moves_edges_outward(spark):
    q = value(spark, g.quad_unclip(quad(*RECT), F.lit(1.5)))
    assert [(p["x"], p["y"]) for p in q] == [(0, 0), (60, 0), (60, 40), (0, 40)]
    flat = value(spark, g.quad_unclip(quad((1, 1), (1, 1), (1, 1), (1, 1)), F.lit(1.5)))
    assert {(p["x"], p["y"]) for p in flat} == {(1, 1)}


def test_tilt(spark):
    c = math.cos(math.pi / 4)
    turned = [(x * c - y * c, x * c + y * c) for x, y in RECT]
    assert value(spark, g.quad_is_aligned(quad(*RECT))) and not value(spark, g.quad_is_aligned(quad(*turned)))


def test_resize_plans(spark):
    square = value(spark, g.resize_plan_square(F.lit(200), F.lit(100), 512))
    assert (square["content_w"], square["content_h"], square["pad_y"]) == (512, 256, 128)
    limit = value(spark, g.resize_plan_limit(F.lit(800), F.lit(300), F.lit(640)))
    assert (limit["content_w"], limit["content_h"], limit["resized_w"], limit["resized_h"], limit["scale_x"]) == (640, 240, 640, 256, 1.25)
    small = value(spark, g.resize_plan_limit(F.lit(100), F.lit(60), F.lit(1600)))
    assert (small["content_w"], small["content_h"], small["resized_w"], small["resized_h"]) == (100, 60, 128, 64)


@pytest.mark.parametrize(("w", "h", "want"), [(10, 100, 48), (4000, 48, 2048), (97, 48, 128)])
def test_recognition_width(spark, w, h, want):
    assert value(spark, g.rec_width(F.lit(w), F.lit(h))) == want


def test_line_join_and_gaps(spark):
    r = regions(spark, [("hello", 10, 10, 40, 12), ("world", 70, 11, 40, 12), ("next", 10, 40, 40, 12)])
    assert one(layout.page_text(r))["text"] == "hello world\nnext"


def test_numbered_lines_keep_blank_rows(spark):
    r = regions(spark, [("1# a", 10, 10, 80, 12), ("3b c", 10, 58, 80, 12), ("4- item", 10, 82, 80, 12), ("5 x", 10, 106, 80, 12)])
    assert one(layout.page_text(r))["text"] == "1  # a\n2\n3  b c\n4  - item\n5  x"


def test_outlier_number_is_ignored(spark):
    slots = spark.createDataFrame([(1, i, i, 0, f"{n} x") for i, n in enumerate((1, 2, 3, 241))], "page_id long, slot int, line_no int, k int, text string")
    assert one(layout.numbering_start(slots))["start"] == 1


CELLS = [("姓名", 10, 10, 40, 12), ("金额", 200, 10, 40, 12), ("张三", 10, 40, 40, 12), ("100", 200, 40, 40, 12), ("李四", 10, 70, 40, 12), ("2000", 200, 70, 40, 12)]


def test_table_text_and_csv(spark):
    cells = layout.table_cells(regions(spark, CELLS))
    assert one(layout.table_text(cells))["text"] == "姓名  金额\n张三  100\n李四  2000"
    assert one(layout.table_csv(cells))["text"] == "姓名,金额\n张三,100\n李四,2000"
    assert one(layout.layout_text(regions(spark, CELLS)))["layout"] == "table"


def test_prose_is_no_table(spark):
    r = regions(spark, [(f"line {i}", 10, 10 + 30 * i, 300, 12) for i in range(4)])
    assert layout.table_cells(r).count() == 0
    assert one(layout.layout_text(r))["layout"] == "spatial"


def test_vertical_columns(spark):
    r = regions(spark, [("左", 10, 10, 12, 40), ("右", 10, 60, 12, 40), ("上", 60, 10, 12, 40), ("下", 60, 60, 12, 40)], direction="Vertical")
    assert one(layout.layout_text(r))["text"] == "上下\n左右"


def test_spatial_text_keeps_columns(spark):
    r = regions(spark, [("ab", 0, 0, 20, 10), ("cd", 100, 0, 20, 10), ("ef", 0, 60, 20, 10), ("gh", 0, 75, 20, 10)])
    assert one(layout.spatial_text(r))["text"].startswith("ab        cd\n\n")


def test_gutter_goes_and_neighbours_merge(spark):
    rows = [x for i in range(5) for x in ((str(i), 5, 10 + 40 * i, 14, 12), ("text", 60, 10 + 40 * i, 120, 12))] + [("more", 184, 10, 90, 12)]
    r = regions(spark, sorted(rows, key=lambda x: (x[2], x[1])))
    got = sorted((x["y"], x["a"], x["b"]) for x in layout.merge_regions(r).select(g.top(F.col("quad")).alias("y"), g.left(F.col("quad")).alias("a"), g.right(F.col("quad")).alias("b")).collect())
    assert len(got) == 5 and all(a >= 48 for _, a, _ in got) and got[0][2] >= 270


def test_components_join_across_rows(spark):
    grid = ["#.#", "#.#", "###", "...", "#.."]
    fg = spark.createDataFrame([(1, y, x, 1.0) for y, row in enumerate(grid) for x, c in enumerate(row) if c == "#"], "image_id long, y int, x int, p double")
    stats = detection.component_stats(detection.components(fg)).collect()
    assert sorted(s["n"] for s in stats) == [1, 7]


def test_min_area_rect_of_straight_and_turned(spark):
    turned = {(round(x * 0.7 - y * 0.7), round(x * 0.7 + y * 0.7)) for x in range(0, 41) for y in range(0, 21)}
    straight = {(x, y) for x in range(41) for y in range(21)}
    rows = [(1, y, x + 100, 1.0) for x, y in straight] + [(2, y, x + 100, 1.0) for x, y in turned]
    runs = detection.label_runs(spark.createDataFrame(rows, "image_id long, y int, x int, p double"))
    q = F.col("quad")
    size = {r["image_id"]: (r["w"], r["h"]) for r in detection.min_area_rect(runs).select("image_id", g.quad_width(q).alias("w"), g.quad_height(q).alias("h")).collect() if r["w"] > 5}
    assert size[1] == (40, 20)
    assert abs(size[2][0] - 40) < 3 and abs(size[2][1] - 20) < 3


def test_graph_of_structs(spark):
    e = spark.createDataFrame([((1, i + 1), (1, i)) for i in range(9)] + [((2, 5), (2, 7))], "a struct<p:int,k:int>, b struct<p:int,k:int>")
    roots = {tuple(r["node"]): tuple(r["root"]) for r in connected(e).collect()}
    assert roots[(1, 9)] == (1, 0) and roots[(2, 7)] == (2, 5)
    assert connected(e.limit(0)).count() == 0


def test_ctc(spark):
    steps = spark.createDataFrame([(1, i, c, 0.5) for i, c in enumerate((0, 1, 1, 2, 0, 3))] + [(2, 0, 0, 0.9)], "crop_id long, t int, idx int, conf double")
    chars = spark.createDataFrame([(0, "<blank>"), (1, "a"), (2, "b"), (3, "c")], "idx int, ch string")
    got = {r["crop_id"]: (r["text"], r["confidence"]) for r in recognition.ctc_decode(steps, chars).collect()}
    assert got == {1: ("abc", 0.5), 2: ("", 0.0)}


def test_dictionaries(spark):
    lines = lambda *x: spark.createDataFrame([(i + 1, v) for i, v in enumerate(x)], "seq int, value string")
    as_dict = lambda df: dict(map(tuple, df.collect()))
    assert as_dict(tables.number_chars(lines("a", " ", "", "b"))) == {0: "<blank>", 1: "a", 2: " ", 3: "b"}
    assert as_dict(tables.number_chars(lines("　", "a", "b")))[1] == " "
    assert tables.builtin_char_dict(spark).count() == 1 + len(tables.BUILTIN_CHARS)


def test_labels_and_rejects(spark, tmp_path):
    (tmp_path / "labels.txt").write_bytes("a.png\tone\ttwo\r\n\nbroken\na.png\t\n  b.png\tx \n".encode())
    samples, rejects = tables.read_labels(spark, str(tmp_path))
    assert [(r["image_path"], r["label_text"]) for r in samples.orderBy("seq").collect()] == [("a.png", "one\ttwo"), ("b.png", "x")]
    assert sorted(r["value"] for r in rejects.collect()) == ["a.png", "broken"]


def test_mojibake(spark):
    wrong = "中文示".encode().decode("cp1252", errors="replace")
    for s, want in ((wrong, "中文示" if "�" not in wrong else wrong), ("plain", "plain"), ("中文", "中文"), ("café", "café")):
        assert value(spark, t.repair_mojibake(F.lit(s))) == want


def test_templates(spark):
    f = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [0.0, 3.0])], "sample_id long, label string, feature array<double>")
    model = recognition.train_templates(f)
    probe = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.714]), (3, [-1.0, 0.0]), (4, [1.0])], "sample_id long, feature array<double>")
    got = {r["sample_id"]: (r["text"], round(r["confidence"], 3)) for r in recognition.match_templates(probe, model).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 0.714), 3: ("", 0.0), 4: ("", 0.0)}
    with pytest.raises(Exception, match="differ in length"):
        recognition.train_templates(f.union(probe.filter("sample_id = 4").selectExpr("sample_id", "'a'", "feature"))).collect()


def test_split_and_checkpoint(spark):
    single = evaluation.split_every_fifth(spark.createDataFrame([(7,)], "seq long")).first()
    assert single["in_train"] and single["in_validation"]
    m = spark.createDataFrame([("r", 1, 0.5, 0.8), ("r", 2, 0.4, 0.8), ("r", 3, 0.4, 0.8), ("r", 4, 0.1, 0.7)], "run string, epoch int, loss double, accuracy double")
    assert one(evaluation.best_checkpoint(m))["epoch"] == 3


def test_empty_evaluations(spark):
    none = spark.createDataFrame([], "sample_id long, prediction string, target string, confidence double")
    assert one(evaluation.validation_accuracy(none))[0] == 1.0 and one(evaluation.line_accuracy(none))[0] == 0.0 and one(evaluation.char_accuracy(none))[0] == 0.0


def test_augmentation_keeps_sizes(spark):
    px = spark.range(160 * 48).select(F.lit(1).cast("long").alias("image_id"), F.floor(F.col("id") / 160).cast("int").alias("y"), (F.col("id") % 160).cast("int").alias("x"), *[F.lit(200).alias(c) for c in "rgb"])
    out = pixels.augment(px)
    assert out.count() == 160 * 48 and out.filter("r < 0 or r > 255").count() == 0


def bmp(path, w, h, colour):
    row = bytes(colour[::-1]) * w
    row += b"\0" * (-len(row) % 4)
    size = 54 + len(row) * h
    head = b"BM" + size.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    path.write_bytes(head + row * h)


def test_images_and_continuous_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bmp(tmp_path / "in" / "a.bmp", 5, 3, (10, 20, 30))
    (tmp_path / "in" / "b.png").write_bytes(b"not an image")
    images, rejects = tables.read_images(spark, str(tmp_path / "in"))
    assert (images.count(), rejects.count()) == (1, 1)
    px = pixels.to_pixels(images)
    assert px.count() == 15 and px.select("r", "g", "b").distinct().first()[:] == (10, 20, 30)
    q = streams.stream_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), pixels.sizes_of, availableNow=True)
    q.awaitTermination(120)
    assert [(r["src_w"], r["src_h"]) for r in spark.read.parquet(str(tmp_path / "out" / "pages")).collect()] == [(5, 3)]
    bad = spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()
    assert [(r["origin"].rsplit("/")[-1], r["reason"]) for r in bad] == [("b.png", "undecodable")]
    bmp(tmp_path / "in" / "again.bmp", 5, 3, (10, 20, 30))  # the same picture, in a later batch
    bmp(tmp_path / "in" / "c.bmp", 4, 3, (10, 20, 30))
    streams.stream_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), pixels.sizes_of, availableNow=True).awaitTermination(120)
    assert sorted((r["src_w"], r["src_h"]) for r in spark.read.parquet(str(tmp_path / "out" / "pages")).collect()) == [(4, 3), (5, 3)]
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1


def test_recognition_within_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        bmp(tmp_path / "in" / f"{i}.bmp", 40 + i, 30, (250, 250, 250))
        raw = bytearray((tmp_path / "in" / f"{i}.bmp").read_bytes())
        row = -(-3 * (40 + i) // 4) * 4
        for y in range(10, 20):
            raw[54 + row * y + 30 : 54 + row * y + 90] = bytes(60)  # a dark bar
        (tmp_path / "in" / f"{i}.bmp").write_bytes(raw)
    model = spark.createDataFrame([("bar", 1, [0.125] * 64)], "label string, sample_count long, feature array<double>")
    read = pipelines.template_recognizer(model, 8, 8, threshold=0.0)
    q = streams.stream_recognition(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda: read, 64, {"box_threshold": 0.3, "min_area": 4.0}, availableNow=True)
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out" / "pages")).collect()
    assert len(got) == 3 and {r["text"] for r in got} == {"bar"}


def test_progress_stream(spark, tmp_path):
    spark.createDataFrame([("r", 1, 1, 2, 0.9, 0.1), ("r", 1, 2, 2, 0.7, 0.3), ("r", 2, 1, 2, 0.5, 0.3)], streams.PROGRESS).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(streams.PROGRESS).json(str(tmp_path / "in"))
    runs = spark.createDataFrame([("r", 0.3), ("s", 0.95)], "run string, accuracy double")
    for q in streams.stream_progress(source, str(tmp_path / "out"), str(tmp_path / "cp"), runs, availableNow=True):
        q.awaitTermination(120)
    assert {r["epoch"]: r["batches"] for r in streams.latest(spark, str(tmp_path / "out" / "epochs"), ["run", "epoch"]).collect()} == {1: 2, 2: 1}
    assert streams.latest(spark, str(tmp_path / "out" / "best"), ["run"]).first()["epoch"] == 2
    # a run whose events are all worse than its start keeps that, also over a restart
    for epoch in (1, 2):
        spark.createDataFrame([("s", epoch, 1, 2, 0.1, 0.5 + epoch / 10)], streams.PROGRESS).write.mode("append").json(str(tmp_path / "in"))
        for q in streams.stream_progress(source, str(tmp_path / "out"), str(tmp_path / "cp"), runs, availableNow=True):
            q.awaitTermination(120)
    best = {r["run"]: (r["epoch"], r["accuracy"]) for r in streams.latest(spark, str(tmp_path / "out" / "best"), ["run"]).collect()}
    assert best == {"r": (2, 0.3), "s": (0, 0.95)}


def test_registry_round_trip(spark, tmp_path):
    rows = [("my model!", 5, "base", "w", "d", (1, 2, 0.5, 0.1)), ("z", 9, "base", "w", "d", (1, 2, 0.7, 0.1))]
    tables.register_model(spark.createDataFrame(rows, tables.MANIFEST), str(tmp_path / "models"))
    (tmp_path / "models" / "bad").mkdir()
    (tmp_path / "models" / "bad" / "part.json").write_text("{not json")
    got = tables.list_models(spark, str(tmp_path / "models")).collect()
    assert [r["name"] for r in got] == ["z", "my model!"]
    t_rows = spark.createDataFrame([("m", "a", 2, [0.5])], tables.TEMPLATES)
    tables.save_templates(t_rows, str(tmp_path / "t"))
    assert tables.load_templates(spark, str(tmp_path / "t")).first()["feature"] == [0.5]


def test_failed_rows_keep_their_error(spark):
    def fn(pdf):
        if (pdf["seq"] == 3).any():
            raise ValueError("no")
        return pdf.assign(text="t", confidence=1.0)

    d = spark.range(8).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("seq"))
    got = pipelines.apply_recognizer(d, fn).collect()
    assert len(got) == 8 and [r["seq"] for r in got if r["error"]] == [3]


def test_models_are_set_up_once_and_swapped(spark):
    made = spark.sparkContext.accumulator(0)

    def factory(text):
        def load():
            made.add(1)
            return lambda pdf: pdf.assign(text=text, confidence=1.0)

        return load

    d = spark.range(0, 4000, 1, 40).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("seq"))
    slot = Slot("reader", "1", factory("one"))
    assert {r["text"] for r in pipelines.apply_recognizer(d, slot).collect()} == {"one"}
    first = made.value
    assert 1 <= first <= 8 < 40  # by worker, not by task or batch
    slot.swap("2", factory("two"))
    assert {r["text"] for r in pipelines.apply_recognizer(d, slot).collect()} == {"two"}
    assert first < made.value <= 2 * 8


def test_detectors_read_pixels_and_keep_errors(spark):
    images = rasters_of(spark, range(6), 9, 7)

    def load():
        def fn(px):
            if px[0, 0, 0] == grid_of(3, 1, 1)[0][0][0]:
                raise ValueError("no")
            return [(0, 0, px.shape[1], px.shape[0], px[0, 0, 1] / 255)]

        return fn

    boxes, failed = pipelines.apply_detector(images, Model("whole", "1", load))
    assert {r["page_id"]: r["det_conf"] for r in boxes.collect()} == {i: grid_of(i, 1, 1)[0][0][1] / 255 for i in range(6) if i != 3}
    assert [(r["page_id"], r["error"]) for r in failed.collect()] == [(3, "ValueError: no")]


def test_labels_of_several_files(spark, tmp_path):
    for name, text in (("a.txt", "x.png\tab\ny.png\tb\n"), ("b.txt", "z.png\tcd\n")):
        (tmp_path / name).write_text(text)
    samples, _ = tables.read_labels(spark, str(tmp_path))
    assert [(r["seq"], r["label_text"]) for r in samples.orderBy("seq").collect()] == [(1, "ab"), (2, "b"), (3, "cd")]
    chars = spark.createDataFrame([(i + 1, c) for i, c in enumerate("abcd")], "idx int, ch string")
    coded = recognition.encode_labels(samples, chars).orderBy("seq").collect()
    assert [r["label_indices"] for r in coded] == [[1, 2], [2], [3, 4]]


def test_lines_of_a_split_file_are_in_order(spark, tmp_path):
    (tmp_path / "one.txt").write_text("".join(f"n{i}\tv{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = tables._lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["line"], r["seq"], r["value"]) for r in lines] == [(i + 1, i + 1, f"n{i}\tv{i}") for i in range(5000)]


def test_numbers_with_far_off_values_and_hot_keys(spark):
    rows = [(i * 3, "hot" if i % 3 else None) for i in range(3000)] + [(1 << 60, "hot"), (-(1 << 60), "one")]
    d = spark.createDataFrame(rows, "seq long, key string")
    for keys in ([], ["key"]):
        of = {}
        for seq, key in sorted(rows):
            of.setdefault(key if keys else 0, []).append(seq)
        want = {seq: k for seqs in of.values() for k, seq in enumerate(seqs)}
        got = evaluation.numbered(d, keys)
        assert {r["seq"]: r["_place"] for r in got.collect()} == want
        ranged = evaluation.split_every_fifth(d)
        assert ranged.filter("in_validation").count() == 601


def test_edits_against_a_plain_table(spark):
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choices("abé中 ", k=r.randrange(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        assert evaluation.edits(a, b) == row[-1]
    assert evaluation.edits("x" * 20_000, "y" + "x" * 19_990) == 11 - 1


def test_templates_in_blocks(spark):
    f = spark.createDataFrame([(i, f"l{i:03}", [math.cos(i), math.sin(i), i / 50.0]) for i in range(60)], "sample_id long, label string, feature array<double>")
    model = recognition.train_templates(f)
    one, many = (sorted(map(str, recognition.match_templates(f, model, block_bytes=n).collect())) for n in (1 << 20, 200))
    assert one == many and len(one) == 60


def test_components_of_random_images(spark):
    r = random.Random(9)
    grid = {(i, y, x) for i in range(4) for y in range(20) for x in range(30) if r.random() < 0.55}
    fg = spark.createDataFrame([(i, y, x, 0.9) for i, y, x in grid], "image_id long, y int, x int, p double")
    want = {}
    for start in sorted(grid):
        if start in want:
            continue
        todo = [start]
        while todo:
            i, y, x = todo.pop()
            if (i, y, x) in grid and (i, y, x) not in want:
                want[i, y, x] = start[1:]
                todo += [(i, y + 1, x), (i, y - 1, x), (i, y, x + 1), (i, y, x - 1)]
    got = {(q["image_id"], q["y"], q["x"]): q["label"] for q in detection.components(fg).collect()}
    assert got.keys() == want.keys()
    groups = lambda d, name: {frozenset(k for k in d if name(d[k]) == n and k[0] == i) for i in range(4) for n in {name(v) for v in d.values()}} - {frozenset()}
    assert groups(got, lambda v: (v["image_id"], v["y"], v["x0"])) == groups(want, lambda v: v)


def test_runs_without_epochs_keep_their_start(spark):
    rows = spark.createDataFrame([("r", 1, 0.5, 0.8), ("t", 1, 0.9, 0.5), ("t", 2, 0.8, 0.6), ("u", 1, 0.4, 0.7)], "run string, epoch int, loss double, accuracy double")
    runs = spark.createDataFrame([("r", 0.1), ("s", 0.4), ("t", 0.95), ("u", 0.7)], "run string, accuracy double")
    got = {r["run"]: tuple(r)[1:] for r in evaluation.best_checkpoint(rows, runs).collect()}
    inf = float("inf")
    assert got == {"r": (1, 0.5, 0.8), "s": (0, inf, 0.4), "t": (0, inf, 0.95), "u": (1, 0.4, 0.7)}
    got = {r["run"]: tuple(r)[1:] for r in evaluation.best_checkpoint(rows, runs.select("run")).collect()}
    assert got["s"] == (0, inf, 0.0) and got["t"] == (2, 0.8, 0.6)


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(1, 300)] + [(999, 500)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 500 for i in range(1, 300)) and got[999] == 500


def grid_of(image, w, h):
    """The pixels that fixtures.pixels gives an image, by row and column."""
    return [[((x * 7 + y * 13 + image * 17) % 256, (x * 11 + y * 3 + image * 5) % 256, (x * 2 + y * 29 + image * 31) % 256) for x in range(w)] for y in range(h)]


def pixel_table(spark, images, w, h):
    rows = [(i, y, x, *px) for i in images for y, row in enumerate(grid_of(i, w, h)) for x, px in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")


def weights(src, dst, kernel):
    out = []
    for d in range(dst):
        at = (d + 0.5) * src / dst - 0.5
        if kernel == "bilinear":
            s0 = min(max(math.floor(at), 0), src - 1)
            w1 = min(max(at - s0, 0.0), 1.0)
            taps = {}
            for s, w in ((s0, 1 - w1), (min(s0 + 1, src - 1), w1)):
                taps[s] = taps.get(s, 0) + w
        else:
            wide = max(src / dst, 1.0)
            taps = {s: max(1 - abs((s - at) / wide), 0.0) for s in range(src)}
        total = sum(taps.values())
        out.append({s: w / total for s, w in taps.items() if w})
    return out


def scaled(grid, w, h, kernel):
    """grid of tuples of numbers, scaled along x, then along y."""
    n = len(grid[0][0])
    rows = [[tuple(sum(w * row[s][c] for s, w in taps.items()) for c in range(n)) for taps in weights(len(row), w, kernel)] for row in grid]
    return [[tuple(sum(w * rows[s][x][c] for s, w in taps.items()) for c in range(n)) for x in range(w)] for taps in weights(len(rows), h, kernel)]


def light(r, g_, b):
    return min(max(r / 255 * 0.299 + g_ / 255 * 0.587 + b / 255 * 0.114, 0.0), 1.0)


@pytest.mark.parametrize("size", [(24, 16), (13, 29)])
def test_template_features_against_brute_force(spark, size):
    w, h = size
    got = {r["image_id"]: r["feature"] for r in pixels.template_feature(pixel_table(spark, range(3), w, h), 12, 10).collect()}
    for i in range(3):
        gray = [[(light(*px),) for px in row] for row in grid_of(i, w, h)]
        luma = sum(math.floor(v[0] * 255 + 0.5) for row in gray for v in row) // (w * h)
        scale = min(12 / w, 10 / h)
        dw, dh = (int(min(max(math.floor(v * scale + 0.5), 1), most)) for v, most in ((w, 12), (h, 10)))
        small, canvas = scaled(gray, dw, dh, "triangle"), [[luma / 255] * 12 for _ in range(10)]
        for y in range(dh):
            for x in range(dw):
                canvas[y + (10 - dh) // 2][x + (12 - dw) // 2] = small[y][x][0]
        flat = [v for row in canvas for v in row]
        flat = [min(max(1 - v if sum(flat) / len(flat) > 0.5 else v, 0.0), 1.0) for v in flat]
        norm = math.sqrt(sum(v * v for v in flat))
        assert got[i] == pytest.approx([v / norm for v in flat], abs=1e-9)


def test_model_free_detection_against_brute_force(spark):
    size, ratio = 40, 1.5
    got = detection.detect_model_free(pixel_table(spark, range(4), 24, 16), size, "bilinear", box_threshold=0.3, min_area=1.0).collect()
    for i in range(4):
        dw, dh = 40, math.floor(16 * 40 / 24 + 0.5)
        pad = (size - dh) // 2
        canvas = [[(255.0,) * 3 for _ in range(size)] for _ in range(size)]
        for y, row in enumerate(scaled(grid_of(i, 24, 16), dw, dh, "bilinear")):
            canvas[y + pad] = list(row)
        v = [[light(*px) for px in row] for row in canvas]
        inverted = sum(map(sum, v)) / size**2 > 0.5
        p = {}
        for y in range(size):
            for x in range(size):
                near = [v[b][a] for b, a in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= a < size and 0 <= b < size]
                p[y, x] = min(max((1 - v[y][x] if inverted else v[y][x]) * 0.75 + sum(abs(v[y][x] - n) for n in near) / len(near) * 0.25, 0), 1)
        left, boxes = {k for k, q in p.items() if q > 0.3}, []
        while left:
            todo, own = [min(left)], []
            while todo:
                k = todo.pop()
                if k in left:
                    left.remove(k)
                    own.append(k)
                    todo += [(k[0] + 1, k[1]), (k[0] - 1, k[1]), (k[0], k[1] + 1), (k[0], k[1] - 1)]
            ys, xs = [k[0] for k in own], [k[1] for k in own]
            bw, bh, score = max(xs) - min(xs), max(ys) - min(ys), sum(p[k] for k in own) / len(own)
            if score >= 0.3 and bw * bh >= 1:
                d = bw * bh * ratio / (2 * (bw + bh))
                back = lambda q, off, most, scale, end: min(max(min(max(q - off, 0), most) * scale, 0), end)
                boxes.append((back(min(xs) - d, 0, dw, 24 / dw, 24), back(min(ys) - d, pad, dh, 16 / dh, 16), score))
        mine = [(q["quad"][0]["x"], q["quad"][0]["y"], q["det_conf"]) for q in got if q["page_id"] == i]
        assert boxes and sorted(mine) == pytest.approx(sorted(boxes), abs=1e-6) if len(boxes) == 1 else all(a == pytest.approx(b, abs=1e-6) for a, b in zip(sorted(mine), sorted(boxes), strict=True))


def test_least_rectangles_against_brute_force(spark):
    r = random.Random(4)
    grid = {(i, y, x) for i in range(3) for y in range(14) for x in range(14) if r.random() < 0.5}
    runs = detection.label_runs(spark.createDataFrame([(i, y, x, 0.9) for i, y, x in grid], "image_id long, y int, x int, p double"))
    points = {}
    for q in runs.collect():
        points.setdefault(q["label"], set()).update((float(x), float(q["y"])) for x in range(q["x0"], q["x1"] + 1))
    for q in detection.min_area_rect(runs).withColumn("area", g.quad_area(F.col("quad"))).collect():
        own = points[q["label"]]
        least = math.inf
        for ax, ay in own:
            for bx, by in own:
                if (n := math.hypot(bx - ax, by - ay)) > 0:
                    ux, uy = (bx - ax) / n, (by - ay) / n
                    along, across = [x * ux + y * uy for x, y in own], [y * ux - x * uy for x, y in own]
                    least = min(least, (max(along) - min(along)) * (max(across) - min(across)))
        assert q["area"] == pytest.approx(0 if least == math.inf else least, abs=1e-6)


def rasters_of(spark, images, w, h):
    rows = [(i, w, h, bytearray(v for row in grid_of(i, w, h) for px in row for v in px)) for i in images]
    return spark.createDataFrame(rows, rasters.RASTER)


@pytest.mark.parametrize("size", [1, 3, 8, 50])
def test_tiles_give_what_whole_images_give(spark, size):
    """Kernels on tiles with halos, on pixel tables, and by the plain definition."""
    w, h, images = 17, 11, range(3)
    tiled, px = rasters.tiles(rasters_of(spark, images, w, h), size), pixel_table(spark, images, w, h)
    one = lambda px: np.ones(px.shape[:2], bool)
    p = rasters.tile_pixels(tiled, lambda a, r: [rasters.text_probability(rasters.luma(a), one(a), r["mean"])], "p double")
    blur = rasters.tile_pixels(tiled, lambda a, r: list(np.moveaxis(rasters.box_blur(a.astype(np.int32), one(a), r["width"], r["height"]), 2, 0)), "r int, g int, b int")
    assert sorted(map(tuple, blur.collect())) == sorted(map(tuple, pixels.aug_blur(px).collect()))
    got = {tuple(r)[:3]: r["p"] for r in p.collect()}
    assert got == pytest.approx({tuple(r)[:3]: r["p"] for r in pixels.text_probability(pixels.to_gray(px)).collect()}, abs=1e-12)
    for i in images:
        v = [[light(*c) for c in row] for row in grid_of(i, w, h)]
        dark = sum(map(sum, v)) / (w * h) > 0.5
        for y in range(h):
            for x in range(w):
                near = [v[b][a] for b, a in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= a < w and 0 <= b < h]
                want = (1 - v[y][x] if dark else v[y][x]) * 0.75 + sum(abs(v[y][x] - n) for n in near) / len(near) * 0.25
                assert got[i, y, x] == pytest.approx(min(max(want, 0), 1), abs=1e-12)
    plan = tiled.withColumns({"dst_w": F.lit(7), "dst_h": F.lit(19)})
    for kernel in ("bilinear", "triangle"):
        small = {tuple(r)[:3]: r["v"] for r in rasters.resample(plan, kernel).collect()}
        want = {(i, y, x): v[0] for i in images for y, row in enumerate(scaled([[(light(*c),) for c in row] for row in grid_of(i, w, h)], 7, 19, kernel)) for x, v in enumerate(row)}
        assert small == pytest.approx(want, abs=1e-9)


def test_tile_kernels_need_no_exchange(spark):
    tiled = rasters.tiles(rasters_of(spark, range(2), 9, 9), 4)
    plan = rasters.tile_pixels(tiled, lambda a, r: [rasters.ink(rasters.luma(a), r["mean"])], "v double")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lanczos_weights_are_those_of_the_table(spark):
    sizes = spark.createDataFrame([(1, 23, 9), (2, 5, 31)], "image_id long, src int, dst int")
    for kernel in ("bilinear", "triangle", "lanczos3"):
        got = {(r["image_id"], r["d"], r["s"]): r["w"] for r in pixels.axis_weights(sizes, kernel).collect()}
        want = {(i, d, s): v for i, src, dst in ((1, 23, 9), (2, 5, 31)) for (d, s), v in np.ndenumerate(rasters.axis_weights(src, dst, kernel)) if v}
        assert {k: v for k, v in got.items() if abs(v) > 1e-12} == pytest.approx({k: v for k, v in want.items() if abs(v) > 1e-12}, abs=1e-9)


def test_augmentation_follows_content(spark):
    """An image under two ids is changed alike, another is not; the seed is the pixel table's; small images are not blurred."""
    px = pixel_table(spark, [4], 20, 12)
    twice = px.unionByName(px.withColumn("image_id", F.lit(900).cast("long"))).unionByName(pixel_table(spark, [5], 20, 12))
    got = {}
    for r in pixels.augment(twice).collect():
        got.setdefault(r["image_id"], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert got[4] == got[900] != got[5]
    seeds = {r["image_id"]: r["content"] for r in pixels.content_hash(twice).collect()}
    assert seeds[4] == seeds[900] == rasters.content(np.array(grid_of(4, 20, 12)), np.ones((12, 20), bool)) != seeds[5]
    u = [rasters.uniform(seeds[4], k) for k in range(4)]
    assert u[1] == value(spark, pixels.image_uniform(F.lit(seeds[4]), 1))
    plain = pixels.aug_contrast(pixels.aug_brightness(px, F.lit(u[0] * 0.3 - 0.15)), F.lit(1.0 + (u[1] * 0.4 - 0.2)))
    chain = pixels.aug_blur(pixels.aug_noise(plain, 0.02, F.lit(u[2] > 0.4), F.lit(seeds[4])), F.lit(u[3] > 0.7))
    assert got[4] == {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in chain.collect()}
    tiny = pixel_table(spark, [1], 4, 9)
    assert sorted(map(tuple, pixels.aug_blur(tiny).collect())) == sorted(map(tuple, tiny.collect()))


def test_training_tensors_against_the_pixel_operators(spark):
    """Every number of every tensor, from augment and model_input on pixel tables; parts of a batch; both sides."""
    w, h = 20, 12
    samples = spark.createDataFrame([(i, f"{i}.png", "ab"[: 1 + i % 2] + ("?" if i == 3 else "")) for i in range(11)] + [(11, "11.png", "??")], "seq long, image_path string, label_text string")
    images = rasters_of(spark, range(12), w, h).withColumn("image_path", F.concat("image_id", F.lit(".png")))
    chars = spark.createDataFrame([(0, "<blank>"), (1, "a"), (2, "b")], "idx int, ch string")
    packed = pipelines.training_tensors(samples, images, chars, batch=4, pack_bytes=200_000).collect()
    px = pixel_table(spark, range(11), w, h)
    plan = spark.range(11).select(F.col("id").alias("image_id"), *[F.lit(v).alias(k) for k, v in {"src_w": w, "src_h": h, "dst_w": 80, "dst_h": 48, "canvas_w": 96, "canvas_h": 48, "pad_x": 0, "pad_y": 0}.items()])
    plainly = {r["image_id"]: r["values"] for r in pixels.model_input(px, plan).collect()}
    changed = {r["image_id"]: r["values"] for r in pixels.model_input(pixels.augment(px), plan).collect()}
    seen = {}
    for r in packed:
        n = len(r["seqs"])
        assert r["shape"] == [n, 3, 48, 96] and (n == 1 or len(r["tensor"]) <= 200_000)
        tensor = np.frombuffer(r["tensor"], "<f4").reshape(n, -1)
        labels = np.array(r["padded"]).reshape(n, -1)
        for k, seq in enumerate(r["seqs"]):
            want = changed[seq] if r["side"] == "train" else plainly[seq]
            assert tensor[k].tolist() == pytest.approx(want, abs=1e-6)
            assert labels[k][: r["label_lengths"][k]].tolist() == [1, 2][: 1 + seq % 2] and not labels[k][r["label_lengths"][k] :].any()
            seen.setdefault((r["side"], r["batch_no"]), []).append((r["part"], seq))
    order = [i for i in range(11) if i % 5]
    assert {k: [s for _, s in sorted(v)] for k, v in seen.items()} == {("train", 0): order[:4], ("train", 1): order[4:], ("validation", 0): [0, 5, 10]}
    assert max(p for v in seen.values() for p, _ in v) > 0  # some come in parts


def test_rotated_boxes_are_judged_by_their_own_area(spark):
    """A staircase has a large upright box and a small turned one; the cap counts what is left."""
    stairs = [(1, y + d, y + k, 0.9) for y in range(12) for k in (0, 1) for d in (0,)]
    block = [(1, y + 30, x, 0.9) for y in range(6) for x in range(9)]
    thin = [(1, 50, x, 0.9) for x in range(20)]
    prob = spark.createDataFrame(stairs + block + thin, "image_id long, y int, x int, p double")
    meta = spark.createDataFrame([(1, 0, 0, 64, 64, 1.0, 1.0, 64, 64)], "image_id long, pad_x int, pad_y int, content_w int, content_h int, scale_x double, scale_y double, orig_w int, orig_h int")
    tops = lambda **k: sorted(round(r["t"]) for r in detection.detect_regions(prob, meta, unclip_ratio=0.0, **k).withColumn("t", g.top(F.col("quad"))).collect())
    assert tops(min_area=20.0) == [0, 30]
    assert tops(min_area=20.0, rotated=True) == [30]
    assert tops(min_area=10.0, rotated=True) == [0, 30]
    assert tops(min_area=20.0, rotated=True, max_candidates=1) == [30]
    assert tops(min_area=20.0, max_candidates=1) == [0]


def test_rotated_detection_against_brute_force(spark):
    r = random.Random(11)
    grid = {(i, y, x): r.choice([0.35, 0.7, 0.95]) for i in range(4) for y in range(24) for x in range(24) if r.random() < 0.42}
    prob = spark.createDataFrame([(*k, v) for k, v in grid.items()], "image_id long, y int, x int, p double")
    meta = spark.createDataFrame([(i, 0, 0, 24, 24, 2.0, 1.0, 48, 24) for i in range(4)], "image_id long, pad_x int, pad_y int, content_w int, content_h int, scale_x double, scale_y double, orig_w int, orig_h int")
    got = detection.detect_regions(prob, meta, 0.3, 0.6, 1.5, 8.3, 3, rotated=True).collect()
    want = []
    for i in range(4):
        left, kept = {k[1:] for k in grid if k[0] == i}, 0
        while left:
            todo, own = [min(left)], []
            while todo:
                k = todo.pop()
                if k in left:
                    left.remove(k)
                    own.append(k)
                    todo += [(k[0] + 1, k[1]), (k[0] - 1, k[1]), (k[0], k[1] + 1), (k[0], k[1] - 1)]
            score, least = sum(grid[i, *k] for k in own) / len(own), None
            for a in own:
                for b in own:
                    if (n := math.dist(a, b)) > 0:
                        ux, uy = (b[1] - a[1]) / n, (b[0] - a[0]) / n
                        along, across = [x * ux + y * uy for y, x in own], [y * ux - x * uy for y, x in own]
                        area = (max(along) - min(along)) * (max(across) - min(across))
                        least = area if least is None else min(least, area)
            if score >= 0.6 and (least or 0) >= 8.3 and kept < 3:
                kept += 1
                want.append((i, round(score, 9)))
    assert want and sorted((q["page_id"], round(q["det_conf"], 9)) for q in got) == sorted(want)


def test_rasters_and_pixel_tables_are_detected_alike(spark):
    px, images = pixel_table(spark, range(3), 30, 20), rasters_of(spark, range(3), 30, 20)
    for rotated in (False, True):
        a, b = (sorted(map(str, d.collect())) for d in (detection.detect_model_free(px, 48, box_threshold=0.3, min_area=2.0, rotated=rotated), detection.detect_in_rasters(images, 48, box_threshold=0.3, min_area=2.0, rotated=rotated)))
        assert a and a == b


def test_labels_are_looked_up_in_their_rows(spark):
    chars = spark.createDataFrame([(0, "<blank>"), (1, "a"), (2, "bx"), (3, "a"), (4, "\U0001f600"), (5, "")], "idx int, ch string")
    samples = spark.createDataFrame([(1, "ab?a"), (2, ""), (3, None), (4, "\U0001f600é\U0001f601b"), (5, "zzz")], "seq int, label_text string")
    got = recognition.encode_labels(samples, chars)
    assert {r["seq"]: r["label_indices"] for r in got.collect()} == {1: [3, 2, 3], 2: [], 3: [], 4: [4, 2], 5: []}
    kept = recognition.keep_known(samples.select(F.col("seq").alias("key"), F.col("label_text").alias("label")), chars, 2)
    assert {r["key"]: r["label"] for r in kept.collect()} == {1: "aba", 4: "\U0001f600b"}
    for d in (got, kept):
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert recognition.encode_labels(samples, chars.limit(0)).filter("size(label_indices) > 0").count() == 0


def test_numbering_against_all_pairs_and_on_a_long_page(spark):
    r = random.Random(2)
    pages, want = [], {}
    for page in range(60):
        numbers = [None if r.random() < 0.2 else k + r.choice([1, 1, 1, 2, 3, 40]) for k in range(r.randint(2, 14))]
        blank = r.random() < 0.5
        pages += [(page, k, k, 0, f"{n} x" if n is not None else "x") for k, n in enumerate(numbers)] + ([(page, len(numbers), len(numbers) - 1, 1, "")] if blank else [])
        c = [(k, n) for k, n in enumerate(numbers) if n is not None]
        if len(c) < 3 or not (blank or max(n for _, n in c) > len(numbers) + 2):
            continue
        rated = []
        for k, n in c:
            exact, near = (sum(abs(n - k + j - m) <= e for j, m in c) for e in (0, 1))
            if n - k >= 0 and exact >= 3:
                rated.append((exact, near, -k, n - k))
        if rated:
            want[page] = max(rated)[3]
    slots = spark.createDataFrame(pages, "page_id long, slot int, line_no int, k int, text string")
    assert {q["page_id"]: q["start"] for q in layout.numbering_start(slots).collect()} == want
    long = spark.range(50_000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("seq"), g.quad_from_rect(F.lit(10.0), 24.0 * F.col("id"), F.lit(300.0), F.lit(12.0)).alias("quad"), F.concat((F.col("id") + 7).cast("string"), F.lit(" w")).alias("text"))
    text = one(layout.page_text(long))["text"].split("\n")
    assert len(text) == 50_000 and text[0] == "    7  w" and text[-1] == "50006  w"


def test_two_registries_in_one_folder(spark, tmp_path):
    root = str(tmp_path / "models")
    tables.register_model(spark.createDataFrame([("net", 5, "base", "w", "d", (1, 2, 0.5, 0.1))], tables.MANIFEST), root)
    rows = [("t one", 7, 32, 24, 0.4, [("a", 2, [0.6, 0.8]), ("b", 1, [1.0, 0.0])], (3, 4, 0.9, 0.2)), ("t/two", 8, 32, 32, 0.4, [], (0, 0, 0.0, 0.0))]
    tables.save_template_models(spark.createDataFrame(rows, tables.TEMPLATE_MODEL), f"file://{root}")
    (tmp_path / "models" / "bad").mkdir()
    (tmp_path / "models" / "bad" / tables.TEMPLATE_FILE).write_text('{"name": "broken", ')
    got = tables.list_template_models(spark, root)
    assert [(r["model_dir"], r["name"], r["template_count"], r["accuracy"]) for r in got.collect()] == [("8-t-two", "t/two", 0, 0.0), ("7-t-one", "t one", 2, 0.9)]
    assert "feature" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["label"], tuple(r["feature"])) for r in tables.load_template_models(spark, root).collect()} == {("a", (0.6, 0.8)), ("b", (1.0, 0.0))}
    assert [r["name"] for r in tables.list_models(spark, root, "part-*.json").collect()] == ["net"]


def test_long_pairs_are_dealt_over_tasks(spark):
    r = random.Random(6)
    texts = ["".join(r.choices("abcdef ", k=600)) for _ in range(60)]
    rows = [(i, t[:300] + "zz" + t[305:], t, 0.5) for i, t in enumerate(texts)] + [(100, None, "x", 0.1), (101, " a ", "a", 0.2), (102, "kitten", "sitting", 0.3)]
    d = spark.createDataFrame(rows, "sample_id long, prediction string, target string, confidence double").coalesce(1)
    got = {q["sample_id"]: q for q in evaluation.eval_report(d).withColumn("part", F.spark_partition_id()).collect()}
    assert {k: q["distance"] for k, q in got.items() if k < 100} == {i: evaluation.edits(p.strip(), t.strip()) for i, p, t, _ in rows[:60]}
    assert (got[100]["distance"], got[101]["distance"], got[101]["exact"], got[102]["distance"]) == (None, 0, True, 3)
    assert len({q["part"] for k, q in got.items() if k < 100}) > 3


def test_many_templates_and_ties(spark):
    """Clusters, blocks and matrices give what all pairs give; of templates alike the greatest label wins."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    rows = np.concatenate([c + r.normal(scale=0.15, size=(60, 16)) for c in centres])
    rows = np.concatenate([rows, rows[:40]])  # alike under two labels
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    labels = [f"l{i:04}" for i in range(len(rows))]
    probes = np.concatenate([rows[::7], r.normal(size=(80, 16)), rows[:5] * 3.0, -rows[:3], np.zeros((1, 16))])
    model = spark.createDataFrame([(label, 1, row.tolist()) for label, row in zip(labels, rows, strict=True)] + [("short", 1, [1.0, 0.0])], "label string, sample_count long, feature array<double>")
    f = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(probes)] + [(999, [0.9, 0.1]), (1000, [1.0] * 5)], "sample_id long, feature array<double>")
    want = {999: ("short", 0.9), 1000: ("short", 0.0)}
    for i, p in enumerate(probes):
        s, label = max((min(max(float((p * row).sum()), 0.0), 1.0), label) for label, row in zip(labels, rows, strict=True))
        want[i] = (label, s) if s > 0 else ("short", 0.0)
    for size in (1 << 24, 9000, 4000):
        got = {q["sample_id"]: (q["text"], q["confidence"]) for q in recognition.match_templates(f, model, 0.0, size).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-12)


def test_clusters_pass_over_templates():
    """Well parted templates: most clusters are not looked at."""
    r = np.random.default_rng(1)
    rows = np.repeat(np.eye(40), 50, axis=0) + r.normal(scale=0.005, size=(2000, 40))
    c = recognition._Clusters([str(i) for i in range(2000)], rows / np.linalg.norm(rows, axis=1)[:, None])
    angle = np.arccos(np.clip(c.rows[:1] @ c.centres.T, -1, 1))
    assert (np.cos(np.clip(angle - c.radius, 0, np.pi)) < 0.9).mean() > 0.9
    assert c.best(c.rows[:3])[1][1] == "1"


GLYPHS = {"bar": ["######", "######", "......", "......"], "post": ["##....", "##....", "##....", "##...."], "step": ["##....", "####..", "######", "######"]}


def drawn(text_rows, scale=4):
    """A white page with glyphs in lines, and its pixels."""
    page = np.full((40 * len(text_rows) + 20, 60 * max(map(len, text_rows)) + 40, 3), 255, np.uint8)
    for y, row in enumerate(text_rows):
        for x, name in enumerate(row):
            if name:
                mask = np.array([[c == "#" for c in line] for line in GLYPHS[name]]).repeat(scale, 0).repeat(scale, 1)
                at = page[20 + 40 * y : 20 + 40 * y + mask.shape[0], 20 + 60 * x : 20 + 60 * x + mask.shape[1]]
                at[mask] = 20
    return page


def test_pages_of_glyphs_are_read_in_order(spark):
    """The whole job on drawn pages: what was drawn is what is read, line by line; by rasters and by pixel tables alike."""
    pages = {1: [["bar", "step"], ["post", "bar"]], 2: [["step", "step", "bar"]], 3: [["post", ""], ["", "step"]]}
    images = spark.createDataFrame([(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in ((i, drawn(rows)) for i, rows in pages.items())], rasters.RASTER)
    params = {"box_threshold": 0.3, "min_area": 20.0, "unclip_ratio": 0.3}
    boxes = detection.detect_in_rasters(images, 160, **params)
    crops = pipelines.crop_rasters(images, boxes, 2.0).collect()
    # templates from the glyphs where they were drawn
    known = []
    for i, rows in pages.items():
        own = sorted((c for c in crops if c["page_id"] == i), key=lambda c: c["seq"])
        names = [n for row in rows for n in row if n]
        assert len(own) == len(names)
        known += [(k, n, rasters.template_feature(rasters.array_of(c.asDict()), 16, 16).tolist()) for k, (c, n) in enumerate(zip(own, names, strict=True))]
    model = recognition.train_templates(spark.createDataFrame(known, "sample_id long, label string, feature array<double>"))
    regions, texts = pipelines.recognize_rasters(images, pipelines.raster_template_recognizer(model, 16, 16), 160, orientation_threshold=2.0, **params)
    want = {i: [[n for n in row if n] for row in rows] for i, rows in pages.items()}
    got = {r["page_id"]: [line for line in r["text"].split("\n") if line] for r in texts.collect()}
    assert {i: [" ".join(row) for row in rows] for i, rows in want.items()} == got
    px = spark.createDataFrame([(i, y, x, *map(int, v)) for i, rows in pages.items() for y, line in enumerate(drawn(rows)) for x, v in enumerate(line)], "image_id long, y int, x int, r int, g int, b int")
    same = pipelines.recognize_pages(px, pipelines.template_recognizer(model, 16, 16), 160, orientation_threshold=2.0, **params)[1]
    assert {r["page_id"]: r["text"] for r in same.collect()} == {r["page_id"]: r["text"] for r in texts.collect()}


def test_cut_and_turned_crops_are_those_of_the_pixel_operators(spark):
    quads = [[(8.3, 1.1), (16.3, 7.1), (10.3, 15.1), (2.3, 9.1)], [(-3.0, 2.0), (9.0, 2.5), (8.7, 30.0), (-3.3, 29.0)]]
    q = spark.createDataFrame([(0, k, [(float(x), float(y)) for x, y in p], 24, 16) for k, p in enumerate(quads)], "image_id long, crop_id long, quad array<struct<x:double,y:double>>, page_w int, page_h int")
    page = np.array(grid_of(0, 24, 16), np.uint8)
    got = {}
    for r in pixels.crop_rotated(pixel_table(spark, [0], 24, 16), q).collect():
        got.setdefault(r["image_id"], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    for k, p in enumerate(quads):
        assert {(y, x): tuple(map(int, v)) for y, row in enumerate(rasters.cut_rotated(page, p)) for x, v in enumerate(row)} == got[k]
    px = pixel_table(spark, range(8), 9, 6)
    names = spark.range(8).select(F.col("id").alias("image_id"), F.lit("Horizontal").alias("direction"))
    for r in pixels.needs_rotation(pixels.to_gray(px), names, 0.02).collect():
        sure, turn = rasters.upside_down(np.array(grid_of(r["image_id"], 9, 6), np.uint8), 0.02)
        assert (r["confidence"], r["rotate"]) == (pytest.approx(sure, abs=1e-12), turn)


def test_detection_square_by_bands_is_the_whole_one(spark, sf_dir):
    from pagewright import fixtures

    px = np.random.default_rng(1).integers(0, 256, (30, 50, 3), np.uint8)
    canvas = np.full((200, 200, 3), 255.0)
    canvas[40:160] = rasters.scaled(px, 200, 120)
    v = rasters.luma(canvas)
    plain = rasters.text_probability(v, np.ones(v.shape, bool), v.mean())
    assert detection.model_free_probability(px, 200) == pytest.approx(plain, abs=1e-12)
    for a, b in zip(detection._runs_of(plain, 0.3), detection._model_free_runs(px, 200, "triangle", 0.3), strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    # a file of ids is one task's, what is made of them must not be
    assert all(made(spark, sf_dir).rdd.getNumPartitions() > 1 for made in (fixtures.images, fixtures.pixels))


@pytest.mark.parametrize("name", ["p20_model_input", "p6_pad_canvas", "p7_crop", "p8_crop_rotated"])
def test_pixels_are_not_broadcast(spark, sf_dir, name):
    """Spark takes exploded pixels for as small as the ids that they come from."""
    from pagewright.queries import QUERIES

    assert "Broadcast" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_models_of_one_folder_get_a_file_each(spark, tmp_path):
    rows = [("net", 5, base, "w", "d", (1, 2, 0.5, 0.1)) for base in ("base", "other")]
    tables.register_model(spark.createDataFrame(rows, tables.MANIFEST).coalesce(1), str(tmp_path))
    assert tables.files_below(spark, str(tmp_path), "*.json").count() == 2


def test_registry_files_are_written_and_read_by_tasks(spark, tmp_path):
    root = tmp_path / "models"
    rows = [("net", 5, "base", "w", "d", (1, 2, 0.5, 0.1)), ("net", 5, "other", "w", "d", (3, 4, 0.5, 0.1)), *((f"n{i}", i, "b", "w", "d", (i, 0, 0.0, 0.0)) for i in range(50))]
    tables.register_model(spark.createDataFrame(rows, tables.MANIFEST).coalesce(1), str(root))
    (root / "deep" / "er").mkdir(parents=True)
    (root / "deep" / "er" / "m.json").write_text('{\n "name": "nested",\n "created_at": 99\n}')
    (root / "_hidden").mkdir()
    for bad in ("_hidden/m.json", "deep/.m.json", "deep/m.txt"):
        (root / bad).write_text('{"name": "no", "created_at": 1}')
    (root / "deep" / "wrong.json").write_text('{"name": "no", "created_at": "x"}')
    got = tables.list_models(spark, str(root)).collect()
    assert [r["created_at"] for r in got] == [99, *range(49, 4, -1), 5, 5, *range(4, -1, -1)]
    assert {r["base_model_name"] for r in got if r["name"] == "net"} == {"base", "other"}  # one file each
    assert got[0]["model_dir"] == "er" and tables.files_below(spark, str(root), "*.json").rdd.getNumPartitions() > 1


def test_images_are_not_broadcast_to_be_cut(spark, sf_dir):
    import re

    from pagewright import fixtures

    images = rasters.of_images(fixtures.images(spark, sf_dir))
    boxes = images.select(F.col("image_id").alias("page_id"), F.lit(1).alias("seq"), quad((1, 1), (9, 1), (9, 9), (1, 9)).alias("quad"))
    cut = pipelines.crop_rasters(images, boxes)
    plan = cut._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "rgb" in plan and not re.search(r"BroadcastExchange\nInput \[\d+\]: \[[^\]]*rgb", plan)
    assert cut.count() == images.count()


def test_recognizer_answers_with_a_dict_and_goes_on_by_frames(spark):
    d = spark.range(0, 100, 1, 1).selectExpr("id page_id", "cast(id % 7 as int) seq", "concat('t', id) text")

    def fn(pdf):
        if (pdf["page_id"] == 40).any():
            return {"text": list(pdf["text"])[1:], "confidence": [0.5] * len(pdf)}  # too few
        return {"text": list(pdf["text"].str.upper()), "confidence": [0.5] * len(pdf)}

    made = pipelines.apply_recognizer(d, fn)
    got = {r["page_id"]: r for r in made.collect()}
    assert len(got) == 100 and [i for i, r in got.items() if r["error"]] == [40]
    assert got[40]["text"] is None and got[40]["confidence"] is None and "0 texts" in got[40]["error"]
    assert all(r["text"] == f"T{i}" and r["confidence"] == 0.5 for i, r in got.items() if i != 40)


def test_layout_text_is_found_in_the_pages_row(spark):
    names = ["ab", "c", "d e", "fg", "h"]
    pages = [regions(spark, [(x, 20 + 200 * (i % 2), 10 + 30 * (i // 2), 30, 12) for i, x in enumerate(names)]), regions(spark, [(x, 300 - 30 * (i // 2), 10 + 60 * (i % 2), 12, 50) for i, x in enumerate(names)], direction="Vertical"), regions(spark, [(x, 20, 10 + 50 * i, 30, 12) for i, x in enumerate(names)])]
    d = pages[0].unionByName(pages[1].withColumn("page_id", F.lit(2).cast("long"))).unionByName(pages[2].withColumn("page_id", F.lit(3).cast("long")))
    made = layout.layout_text(d)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ExistingRDD" not in plan.replace("Scan ExistingRDD[page_id", "")  # nothing is stored between
    got = {r["page_id"]: (r["layout"], r["text"]) for r in made.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "table", 2: "vertical", 3: "spatial"}
    assert got[1][1] == one(layout.table_text(layout.table_cells(pages[0])))["text"]
    assert got[2][1] == one(layout.vertical_text(pages[1]))["text"]
    assert got[3][1] == one(layout.spatial_text(pages[2]))["text"]


def test_training_stores_no_labels_and_keeps_rows_of_one_number(spark, monkeypatch):
    stored = []
    real = pipelines.checkpointed
    monkeypatch.setattr(pipelines, "checkpointed", lambda d: stored.append(d.columns) or real(d))
    rows = [(1, "a", "xyz"), (1, "b", "y"), (1, "b", "zz"), (None, "a", "x"), (None, "b", "yy"), (2, "a", "?"), (3, "none", "x"), (4, "a", "xyzxy")]
    samples = spark.createDataFrame(rows, "seq long, image_path string, label_text string")
    sizes = spark.createDataFrame([("a", 100, 48), ("b", 200, 48)], "image_path string, w int, h int")
    chars = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "idx int, ch string")
    got = pipelines.prepare_training(samples, sizes, chars).collect()
    assert stored and not any({"label_text", "label_indices"} & set(c) for c in stored)
    want = sorted((str(s), i, t) for s, i, t in rows if t != "?" and i != "none" and s is not None)  # numbered() leaves out null numbers
    assert sorted((str(r["seq"]), r["image_path"], r["label_text"]) for r in got) == want
    for r in got:
        group = [x["label_length"] for x in got if (x["side"], x["batch_no"], x["width"]) == (r["side"], r["batch_no"], r["width"])]
        assert r["label_indices"] == ["xyz".index(c) + 1 for c in r["label_text"]] and r["w"] == {"a": 100, "b": 200}[r["image_path"]]
        assert r["padded"] == r["label_indices"] + [0] * (max(group) - r["label_length"])
