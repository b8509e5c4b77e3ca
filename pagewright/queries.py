"""The registered queries of the reference's operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import geometry as g
from .functions import text as t
from .operators import detection, evaluation, layout, pixels, rasters, recognition
from .plans import pipelines
from .plans.lineage import checkpointed, scratch
from .plans.models import Model
from .sources import tables
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query with its SQL."""
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


# geometry: expressions on boxes


def flat(q) -> list:
    return [F.get(q, F.lit(i))[c].alias(f"{c}{i}") for i in range(4) for c in "xy"]


def rect(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"{x0} AS x0, {y0} AS y0, {x1} AS x1, {y0} AS y1, {x1} AS x2, {y1} AS y2, {x0} AS x3, {y1} AS y3"


def on_regions(name: str, columns: Callable[[], list], sql: str, source=fx.regions, cte: str = fx.REGIONS) -> None:
    QUERIES[name] = lambda spark, sf_dir: source(spark, sf_dir).select("page_id", "seq", *columns())
    ORACLES[name] = f"WITH {cte} SELECT page_id, seq, {sql} FROM r"


TILTED = fx.REGIONS.replace("\nr AS", "\nr0 AS") + """, r1 AS (SELECT *, (seq % 3)::DOUBLE AS d FROM r0),
r AS (SELECT *, x AS px0, y AS py0, x + w AS px1, y + d AS py1, x + w - d AS px2, y + h + d AS py2, x - d AS px3, y + h AS py3, sqrt(w * w + d * d) AS ew, sqrt(d * d + h * h) AS eh FROM r1)"""
on_regions("g1_quad_from_rect", lambda: flat(g.quad_from_rect(*[F.col(c) for c in "xywh"])), rect("x", "y", "x + w", "y + h"))
on_regions("g2_edges", lambda: [g.quad_width(F.col("quad")).alias("width"), g.quad_height(F.col("quad")).alias("height"), g.quad_area(F.col("quad")).alias("area")], "ew AS width, eh AS height, ew * eh AS area", fx.tilted, TILTED)
on_regions("g3_rect", lambda: [g.left(F.col("quad")).alias("x0"), g.top(F.col("quad")).alias("y0"), g.right(F.col("quad")).alias("x1"), g.bottom(F.col("quad")).alias("y1")], "x - d AS x0, y AS y0, x + w AS x1, y + h + d AS y1", fx.tilted, TILTED)
on_regions("g4_center", lambda: [g.center_x(F.col("quad")).alias("cx"), g.center_y(F.col("quad")).alias("cy")], "(x - d + x + w) / 2 AS cx, (y + y + h + d) / 2 AS cy", fx.tilted, TILTED)
on_regions("g5_clamp", lambda: flat(g.quad_clamp(F.col("quad"), F.lit(150.0), F.lit(60.0))), ", ".join(f"least(greatest(p{c}{i}, 0.0), {m}) AS {c}{i}" for i in range(4) for c, m in (("x", 150.0), ("y", 60.0))), fx.tilted, TILTED)
on_regions("g6_aligned", lambda: [g.quad_is_aligned(F.col("quad")).alias("aligned")], "d <= greatest(w, 1.0) * 0.04 AND d <= greatest(h, 1.0) * 0.04 AS aligned", fx.tilted, TILTED)
on_regions("g8_unclip", lambda: flat(g.quad_unclip(F.col("quad"), F.lit(1.5))), rect("x - b", "y - b", "x + w + b", "y + h + b"), cte=fx.REGIONS.replace("\nr AS", "\nr0 AS") + ", r AS (SELECT *, w * h * 1.5::DOUBLE / (2 * (w + h)) AS b FROM r0)")
_META = {"pad_x": 5, "pad_y": 9, "content_w": 300, "content_h": 50, "scale_x": 1.5, "scale_y": 2.0, "orig_w": 440, "orig_h": 95}
_BACK = {"x": lambda v: f"least(greatest(least(greatest({v} - 5, 0.0), 300.0) * 1.5::DOUBLE, 0.0), 440.0)", "y": lambda v: f"least(greatest(least(greatest({v} - 9, 0.0), 50.0) * 2.0::DOUBLE, 0.0), 95.0)"}
on_regions("g9_to_original", lambda: flat(g.quad_to_original(F.col("quad"), {k: F.lit(v) for k, v in _META.items()})), rect(_BACK["x"]("x"), _BACK["y"]("y"), _BACK["x"]("(x + w)"), _BACK["y"]("(y + h)")))
on_regions("g15_direction", lambda: [g.text_direction(F.col("w"), F.col("h")).alias("direction")], "CASE WHEN h > floor(w * 5 / 4) THEN 'Vertical' ELSE 'Horizontal' END AS direction")
on_regions("a15_score_regions", lambda: [(F.col("det_conf") * F.col("rec_conf")).alias("confidence"), ((F.length(t.strip(F.col("text"))) > 0) & (F.col("det_conf") * F.col("rec_conf") >= 0.9)).alias("in_text")], "det_conf * rec_conf AS confidence, length(trim(text)) > 0 AND det_conf * rec_conf >= 0.9 AS in_text")
QUERIES["a15_score_regions"] = lambda spark, sf_dir: layout.score_regions(fx.regions(spark, sf_dir), 0.9).select("page_id", "seq", "confidence", "in_text")


def on_parts(name: str, columns: Callable[[], list], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 37 % 3000 + 1).cast("int").alias("w"), (F.col("p_size") * 41 % 2000 + 1).cast("int").alias("h"), F.col("p_name").alias("name"))
        return d.select("key", *columns())

    QUERIES[name] = run
    ORACLES[name] = f"WITH d AS (SELECT p_partkey AS key, CAST(p_partkey * 37 % 3000 + 1 AS INT) AS w, CAST(p_size * 41 % 2000 + 1 AS INT) AS h, p_name AS name FROM part) SELECT key, {sql} FROM d"


_SQ = "least(512.0::DOUBLE / w, 512.0::DOUBLE / h)"
_CW, _CH = (f"CAST(least(greatest(round({s} * {_SQ}), 1), 512) AS INT)" for s in "wh")
on_parts("g10_plan_square", lambda: [g.resize_plan_square(F.col("w"), F.col("h"), 512)[c].alias(c) for c in ("content_w", "content_h", "pad_x", "pad_y", "scale_x", "scale_y")], f"{_CW} AS content_w, {_CH} AS content_h, (512 - {_CW}) // 2 AS pad_x, (512 - {_CH}) // 2 AS pad_y, w / {_CW}::DOUBLE AS scale_x, h / {_CH}::DOUBLE AS scale_y")
_LI = "least(960.0::DOUBLE / greatest(w, h), 1.0)"
_LW, _LH = (f"CAST(greatest(round({s} * {_LI}), 1) AS INT)" for s in "wh")
on_parts("g11_plan_limit", lambda: [g.resize_plan_limit(F.col("w"), F.col("h"), F.lit(960))[c].alias(c) for c in ("resized_w", "resized_h", "content_w", "content_h", "scale_x", "scale_y")], f"({_LW} + 31) // 32 * 32 AS resized_w, ({_LH} + 31) // 32 * 32 AS resized_h, {_LW} AS content_w, {_LH} AS content_h, w / {_LW}::DOUBLE AS scale_x, h / {_LH}::DOUBLE AS scale_y")
_RC = "CAST(least(greatest(round(w * 48.0::DOUBLE / h), 48), 2048) AS INT)"
on_parts("g12_rec_width", lambda: [g.rec_content_width(F.col("w"), F.col("h")).alias("content"), g.rec_width(F.col("w"), F.col("h")).alias("width")], f"{_RC} AS content, CASE WHEN {_RC} <= 48 OR {_RC} >= 2048 THEN {_RC} ELSE least(({_RC} + 31) // 32 * 32, 2048) END AS width")
_B = ["(w % 300 - 5)", "(w % 70 - 3)", "(w % 400)", "(w % 90)"]
_X0, _Y0 = f"least(greatest(least({_B[0]}, {_B[2]}), 0), w - 1)", f"least(greatest(least({_B[1]}, {_B[3]}), 0), h - 1)"
_X1, _Y1 = f"least(greatest(greatest({_B[0]}, {_B[2]}), {_X0} + 1), w)", f"least(greatest(greatest({_B[1]}, {_B[3]}), {_Y0} + 1), h)"


def _annotated():
    box = F.array(*[F.col("w") % a * 1.0 + b for a, b in ((300, -5), (70, -3), (400, 0), (90, 0))])
    return g.annotation_rect(box, F.col("w"), F.col("h"))


on_parts("g14_annotation_rect", lambda: [_annotated()[c].alias(a) for c, a in zip("xywh", ("x", "y", "cw", "ch"), strict=True)], ", ".join(f"CASE WHEN {_X1} - {_X0} >= 2 AND {_Y1} - {_Y0} >= 2 THEN CAST({e} AS INT) END AS {a}" for e, a in ((_X0, "x"), (_Y0, "y"), (f"{_X1} - {_X0}", "cw"), (f"{_Y1} - {_Y0}", "ch"))))
on_parts("t3_lpad_number", lambda: [t.lpad_number(F.col("w"), F.lit(3)).alias("padded")], "CASE WHEN w < 100 THEN lpad(CAST(w AS VARCHAR), 3, ' ') ELSE CAST(w AS VARCHAR) END AS padded")
on_parts("t12_csv_escape", lambda: [t.csv_escape(F.concat("name", F.when(F.col("w") % 3 == 0, ",x").when(F.col("w") % 3 == 1, '"q"').otherwise(""))).alias("field")], "CASE WHEN w % 3 = 0 THEN chr(34) || name || ',x' || chr(34) WHEN w % 3 = 1 THEN chr(34) || name || repeat(chr(34), 2) || 'q' || repeat(chr(34), 3) ELSE name END AS field")
on_parts("t16_sanitize_name", lambda: [t.sanitize_name(F.concat(F.lit("  "), "name", F.lit("!é/")), "model").alias("clean")], "CASE WHEN length(trim(regexp_replace(name, '[^A-Za-z0-9_-]', '-', 'g'), '-')) > 0 THEN trim(regexp_replace(name, '[^A-Za-z0-9_-]', '-', 'g'), '-') ELSE 'model' END AS clean")
on_parts("t17_names", lambda: [t.display_name(F.col("name"), (F.col("w") % 101) / 100.0).alias("shown"), t.finetuned_name(F.col("name"), F.lit("set")).alias("tuned")], "name || ' (' || (w % 101) || '%)' AS shown, name || '-set-finetuned' AS tuned")
on_parts("p17_uniform", lambda: [pixels.image_uniform(F.col("key"), 3).alias("u")], "CAST(('0x' || substr(md5(key || ':3'), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 AS u")


@query("g13_crop_rect", f"""WITH {fx.REGIONS}, c AS (SELECT *, least(greatest(x, 0), 399) AS a, least(greatest(y, 0), 299) AS b, least(greatest(x + w, 0), 399) AS e, least(greatest(y + h, 0), 299) AS f FROM r),
p AS (SELECT *, least(greatest(greatest(e - a, 1) * 0.02::DOUBLE, 2), 12) AS px, least(greatest(greatest(f - b, 1) * 0.45::DOUBLE, 2), greatest(greatest(f - b, 1) * 0.1::DOUBLE, 8)) AS py FROM c),
o AS (SELECT page_id, seq, greatest(floor(a - px), 0) AS x0, greatest(floor(b - py), 0) AS y0, greatest(ceil(e + px), floor(a + 1)) AS x1, greatest(ceil(f + py), floor(b + 1)) AS y1 FROM p)
SELECT page_id, seq, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y, CAST(least(x1 - x0, 400 - x0) AS INT) AS cw, CAST(least(y1 - y0, 300 - y0) AS INT) AS ch FROM o""")
def g13(spark, sf_dir):
    d = fx.regions(spark, sf_dir).withColumn("c", g.crop_rect(F.col("quad"), F.lit(400), F.lit(300)))
    return d.select("page_id", "seq", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


_NEXT = f"WITH {fx.REGIONS}, b AS (SELECT *, lead(x) OVER w1 AS nx, lead(y) OVER w1 AS ny, lead(w) OVER w1 AS nw, lead(h) OVER w1 AS nh FROM r WINDOW w1 AS (PARTITION BY page_id ORDER BY seq)), n AS (SELECT * FROM b WHERE nx IS NOT NULL)"
_SHARE = "(abs(y + h / 2 - ny - nh / 2) <= (h + nh) * 0.5 * 0.7 OR least(y + h, ny + nh) - greatest(y, ny) >= (h + nh) * 0.5 * 0.5)"


@query("g7_g16_g17_pairs", f"{_NEXT} SELECT page_id, seq, {_SHARE} AS same_line, {_SHARE} AND (least(x + w, nx + nw) - greatest(x, nx) >= (h + nh) * 0.5 * 0.4 OR nx - (x + w) <= (h + nh) * 0.5 * 1.2) AS merges, least(x, nx) AS ux, least(y, ny) AS uy, greatest(x + w, nx + nw) - least(x, nx) AS uw, greatest(y + h, ny + nh) - least(y, ny) AS uh FROM n")
def g16(spark, sf_dir):
    d = fx.regions(spark, sf_dir).withColumn("q2", F.lead("quad").over(W.partitionBy("page_id").orderBy("seq"))).filter("q2 is not null")
    u = g.quad_union(F.col("quad"), F.col("q2"))
    return d.select("page_id", "seq", g.shares_line(F.col("quad"), F.col("q2")).alias("same_line"), g.should_merge(F.col("quad"), F.col("q2")).alias("merges"), g.left(u).alias("ux"), g.top(u).alias("uy"), g.quad_width(u).alias("uw"), g.quad_height(u).alias("uh"))


@query("g19_presets", "WITH p(preset, long_side, box_threshold, unclip_ratio, min_area, rotated) AS (VALUES ('fast', 960, 0.6, 1.5, 10.0, false), ('balanced', 1280, 0.6, 1.6, 6.0, false), ('high', 1600, 0.5, 1.7, 4.0, true)) SELECT preset, count(*) AS n, CAST(long_side AS INT) AS long_side, CAST(unclip_ratio AS DOUBLE) AS unclip_ratio, rotated FROM supplier JOIN p ON preset = ['fast', 'balanced', 'high'][s_suppkey % 3 + 1] GROUP BY ALL")
def g19(spark, sf_dir):
    name = F.element_at(F.array(F.lit("fast"), F.lit("balanced"), F.lit("high")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    d = fx.table(spark, sf_dir, "supplier").withColumn("preset", name).join(F.broadcast(g.preset_params(spark)), "preset")
    return d.groupBy("preset", "long_side", "unclip_ratio", "rotated").agg(F.count(F.lit(1)).alias("n"))


# gutters and merging

_GUT = f"WITH {fx.GUTTER}, c AS (SELECT b.* FROM r b WHERE b.x <= 48 AND b.x + b.w <= 48 AND b.w <= 36 AND b.h <= 24 AND b.w <= b.h * 2.2 + 8 AND EXISTS (SELECT 1 FROM r o WHERE o.page_id = b.page_id AND o.seq <> b.seq AND (abs(o.y + o.h / 2 - b.y - b.h / 2) <= (o.h + b.h) * 0.35 OR least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y) >= (o.h + b.h) * 0.25) AND o.x > b.x + b.w + b.h * 0.8 AND o.w > b.w * 1.5)), e AS (SELECT page_id, least(greatest(max(x + w), 0) + avg(h) * 0.8::DOUBLE, 60.0) AS gutter_right FROM c GROUP BY page_id HAVING count(*) >= 5), k AS (SELECT r.* FROM r LEFT JOIN e USING (page_id) WHERE NOT coalesce(x <= gutter_right AND x + w <= gutter_right AND w <= 36 AND h <= 24 AND w <= h * 2.2 + 8, false))"
query("g18_j1_gutter_candidates", f"{_GUT} SELECT page_id, seq FROM c")(lambda spark, sf_dir: layout.gutter_candidates(fx.gutter_regions(spark, sf_dir)).select("page_id", "seq"))
query("j2_gutter_right", f"{_GUT} SELECT page_id, gutter_right FROM e")(lambda spark, sf_dir: layout.gutter_right(fx.gutter_regions(spark, sf_dir)))
query("j3_drop_gutter", f"{_GUT} SELECT page_id, seq FROM k")(lambda spark, sf_dir: layout.drop_gutter(fx.gutter_regions(spark, sf_dir)).select("page_id", "seq"))
QUERIES["r2_merge_regions"] = lambda spark, sf_dir: layout.merge_regions(fx.gutter_regions(spark, sf_dir)).select("page_id", "seq", g.left(F.col("quad")).alias("x0"), g.right(F.col("quad")).alias("x1"), "det_conf")
ORACLES["r2_merge_regions"] = f"{_GUT} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS INT) AS seq, CASE WHEN page_id % 4 = 0 THEN 4.0 + page_id % 5 ELSE x END AS x0, x + w AS x1, det_conf FROM k WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS INT), x, x + w, det_conf FROM k WHERE page_id % 4 = 0"

# order and lines

_LINE = f"""{fx.REGIONS}, o AS (SELECT *, y + h / 2 AS cy, lag(x) OVER w1 AS lx, lag(y) OVER w1 AS ly, lag(w) OVER w1 AS lw, lag(h) OVER w1 AS lh, lag(text) OVER w1 AS lt FROM r WINDOW w1 AS (PARTITION BY page_id ORDER BY seq)),
f AS (SELECT *, CASE WHEN ly IS NULL OR abs(y + h / 2 - ly - lh / 2) <= (h + lh) * 0.5 * 0.7 OR least(y + h, ly + lh) - greatest(y, ly) >= (h + lh) * 0.5 * 0.5 THEN 0 ELSE 1 END AS fresh FROM o),
l AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page_id ORDER BY seq) AS INT) AS line_no FROM f),
pc AS (SELECT *, CASE WHEN lag(line_no) OVER w2 = line_no AND x - lx - lw > (h + lh) * 0.5 * 0.7 AND regexp_matches(lt, '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || trim(text) AS piece FROM l WINDOW w2 AS (PARTITION BY page_id ORDER BY seq)),
j AS (SELECT page_id, line_no, avg(cy) AS center_y, avg(h) AS height, string_agg(piece, '' ORDER BY seq) AS text FROM pc GROUP BY page_id, line_no)"""
query("r1_reading_order", f"WITH {fx.REGIONS}, o AS (SELECT *, lag(y) OVER w1 AS ly, lag(h) OVER w1 AS lh FROM r WINDOW w1 AS (PARTITION BY page_id ORDER BY y, x, seq)), b AS (SELECT *, CAST(sum(CASE WHEN y - ly > (h + lh) * 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y, x, seq ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM o) SELECT page_id, seq, band, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, x, seq) AS INT) AS order_no FROM b")(lambda spark, sf_dir: layout.reading_order(fx.regions(spark, sf_dir)).select("page_id", "seq", "band", "order_no"))
query("r3_group_lines", f"WITH {_LINE} SELECT page_id, seq, line_no FROM l")(lambda spark, sf_dir: layout.group_lines(fx.regions(spark, sf_dir)).select("page_id", "seq", "line_no"))
query("t4_join_line", f"WITH {_LINE} SELECT * FROM j")(lambda spark, sf_dir: layout.join_line(layout.group_lines(fx.regions(spark, sf_dir))))
_PITCH = """gp AS (SELECT *, center_y - lag(center_y) OVER (PARTITION BY page_id ORDER BY line_no) AS gap FROM j),
ga AS (SELECT page_id, list_sort(list(gap) FILTER (WHERE gap > 0)) AS gaps, avg(height) AS height FROM gp GROUP BY page_id),
lo AS (SELECT *, CASE WHEN gaps IS NULL THEN 0 ELSE (len(gaps) + 1) // 2 END AS m FROM ga),
pt AS (SELECT page_id, greatest(CASE WHEN m = 0 THEN height WHEN m % 2 = 0 THEN (gaps[m // 2] + gaps[m // 2 + 1]) * 0.5 ELSE gaps[m // 2 + 1] END, 1.0) AS pitch FROM lo)"""
query("a11_line_pitch", f"WITH {_LINE}, {_PITCH} SELECT * FROM pt")(lambda spark, sf_dir: layout.line_pitch(layout.join_line(layout.group_lines(fx.regions(spark, sf_dir)))))
_SLOTS = """nx AS (SELECT j.*, lead(center_y) OVER (PARTITION BY page_id ORDER BY line_no) AS ny FROM j),
bl AS (SELECT nx.*, CAST(coalesce(least(greatest(round(greatest(ny - center_y, 0) / pitch), 1) - 1, 32), 0) AS INT) AS blank FROM nx JOIN pt USING (page_id)),
sl AS (SELECT page_id, CAST(base + k AS INT) AS slot, line_no, CAST(k AS INT) AS k, CASE WHEN k = 0 THEN text ELSE '' END AS text
  FROM (SELECT *, sum(blank + 1) OVER (PARTITION BY page_id ORDER BY line_no) - blank - 1 AS base FROM bl), unnest(range(0, blank + 1)) AS u(k))"""
query("r14_expand_slots", f"WITH {_LINE}, {_PITCH}, {_SLOTS} SELECT * FROM sl")(lambda spark, sf_dir: layout.expand_slots(layout.join_line(layout.group_lines(fx.regions(spark, sf_dir)))))
_NUM_J = "nl AS (SELECT doc_id AS page_id, n - 1 AS n, x[n] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(n)), nk AS (SELECT * FROM nl WHERE n % 5 <> 3), j AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS line_no, 24.0::DOUBLE * n + 6 AS center_y, 12.0::DOUBLE AS height, trim((n + 1) || ' ' || line) AS text FROM nk)"
_START = """cn AS (SELECT page_id, slot, TRY_CAST(nullif(regexp_extract(text, '^[0-9]+'), '') AS BIGINT) AS num FROM sl WHERE k = 0),
cc AS (SELECT page_id, slot, num FROM cn WHERE num <= 4294967295),
ct AS (SELECT page_id, count(*) AS slots, count(*) FILTER (WHERE k = 0) AS lines FROM sl GROUP BY page_id),
ok AS (SELECT page_id FROM cc JOIN ct USING (page_id) GROUP BY page_id HAVING count(*) >= 3 AND (any_value(slots) > any_value(lines) OR max(num) > any_value(lines) + 2)),
ra AS (SELECT a.page_id, a.slot, a.num - a.slot AS start, count(*) FILTER (WHERE a.num - a.slot + b.slot = b.num) AS exact, count(*) FILTER (WHERE abs(a.num - a.slot + b.slot - b.num) <= 1) AS near FROM cc a JOIN cc b USING (page_id) JOIN ok USING (page_id) GROUP BY a.page_id, a.slot, a.num),
st AS (SELECT page_id, arg_max(start, (exact, near, -slot)) AS start FROM ra WHERE start >= 0 AND exact >= 3 GROUP BY page_id)"""
query("t1_r15_numbering_start", f"WITH {_NUM_J}, {_PITCH}, {_SLOTS}, {_START} SELECT page_id, start FROM st")(lambda spark, sf_dir: layout.numbering_start(layout.expand_slots(layout.join_line(layout.group_lines(fx.numbered(spark, sf_dir))))))
_TEXT = """pg AS (SELECT sl.*, start, start + slot AS num, count(*) OVER (PARTITION BY page_id) AS n FROM sl LEFT JOIN st USING (page_id)),
rs AS (SELECT *, CASE WHEN starts_with(text, CAST(num AS VARCHAR)) THEN ltrim(substr(text, length(CAST(num AS VARCHAR)) + 1)) ELSE text END AS rest, length(CAST(start + n - 1 AS VARCHAR)) AS wd FROM pg),
tx AS (SELECT page_id, slot, CASE WHEN start IS NULL THEN rtrim(text) ELSE repeat(' ', greatest(wd - length(CAST(num AS VARCHAR)), 0)) || num || CASE WHEN length(trim(rest)) > 0 THEN '  ' || rtrim(rest) ELSE '' END END AS line FROM rs)
SELECT page_id, string_agg(line, chr(10) ORDER BY slot) AS text FROM tx GROUP BY page_id"""
query("page_text", f"WITH {_LINE}, {_PITCH}, {_SLOTS}, {_START}, {_TEXT}")(lambda spark, sf_dir: layout.page_text(fx.regions(spark, sf_dir)))
query("t2_t5_numbered_page_text", f"WITH {_NUM_J}, {_PITCH}, {_SLOTS}, {_START}, {_TEXT}")(lambda spark, sf_dir: layout.page_text(fx.numbered(spark, sf_dir)))

# estimators, rows, columns, tables

query("a10_char_width", f"WITH {fx.REGIONS}, s AS (SELECT page_id, list_sort(list(w / greatest(length(text), 1))) AS a FROM r GROUP BY page_id) SELECT page_id, greatest(a[len(a) // 2 + 1], 400 / 160.0::DOUBLE, 1.0) AS char_width FROM s")(lambda spark, sf_dir: layout.char_width(fx.regions(spark, sf_dir)))
_MED = "mh AS (SELECT page_id, list_sort(list(h))[count(*) // 2 + 1] AS median_height FROM r GROUP BY page_id)"
query("a12_median_height", f"WITH {fx.REGIONS}, {_MED} SELECT * FROM mh")(lambda spark, sf_dir: layout.median_height(fx.regions(spark, sf_dir)))
query("a13_vertical_dominant", f"WITH {fx.REGIONS} SELECT page_id, count(*) >= 2 AND 2 * count(*) FILTER (WHERE direction = 'Vertical') > count(*) AS vertical FROM r GROUP BY page_id")(lambda spark, sf_dir: layout.vertical_dominant(fx.regions(spark, sf_dir)))
query("a16_confidence_bands", f"WITH {fx.REGIONS} SELECT CASE WHEN det_conf * rec_conf >= 0.85 THEN 'high' WHEN det_conf * rec_conf >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM r GROUP BY 1")(lambda spark, sf_dir: layout.score_regions(fx.regions(spark, sf_dir)).groupBy(layout.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n")))
_COLS = f"{_MED}, lx AS (SELECT r.*, x - lag(x) OVER (PARTITION BY page_id ORDER BY x, seq) AS gap FROM r), cl AS (SELECT lx.*, CAST(sum(CASE WHEN gap > greatest(median_height * 1.2, 4.0) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS INT) AS col_no FROM lx JOIN mh USING (page_id)), ce AS (SELECT page_id, col_no, avg(x) AS edge FROM cl GROUP BY page_id, col_no)"
query("r5_column_edges", f"WITH {fx.REGIONS}, {_COLS} SELECT * FROM ce")(lambda spark, sf_dir: layout.column_edges(fx.regions(spark, sf_dir)))
_NEAR = "na AS (SELECT r.*, ce.col_no, row_number() OVER (PARTITION BY r.page_id, seq ORDER BY abs(x - edge), ce.col_no) AS k FROM r JOIN ce USING (page_id)), nc AS (SELECT * FROM na WHERE k = 1)"
query("j8_assign_columns", f"WITH {fx.REGIONS}, {_COLS}, {_NEAR} SELECT page_id, seq, col_no FROM nc")(lambda spark, sf_dir: layout.assign_columns(fx.regions(spark, sf_dir), layout.column_edges(fx.regions(spark, sf_dir))).select("page_id", "seq", "col_no"))


def _fold(name: str, key: str, center: str, extent: str) -> str:
    """A recursive fold in SQL: boxes in order of key, each joining the last group if near its mean."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {key}, seq) AS k, {center} AS c, {extent} AS e FROM r),
fold AS (SELECT page_id, seq, k, 0 AS g, c AS sc, e AS se, 1.0::DOUBLE AS n FROM ord WHERE k = 1
  UNION ALL SELECT o.page_id, o.seq, o.k, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN sc + o.c ELSE o.c END, CASE WHEN near THEN se + o.e ELSE o.e END, CASE WHEN near THEN n + 1 ELSE 1 END
  FROM (SELECT o.*, f.g, f.sc, f.se, f.n, abs(o.c - f.sc / f.n) <= greatest(f.se / f.n, o.e) * 0.6 AS near FROM fold f JOIN ord o ON o.page_id = f.page_id AND o.k = f.k + 1) o),
{name} AS (SELECT r.*, CAST(g AS INT) AS grp FROM r JOIN fold USING (page_id, seq))"""


_ROWS = _fold("rw", "y + h / 2", "y + h / 2", "h") + ", rp AS (SELECT *, grp AS row_no, CAST(row_number() OVER (PARTITION BY page_id, grp ORDER BY x, y + h / 2, seq) AS INT) AS row_pos FROM rw)"
_REC = f"WITH RECURSIVE {fx.REGIONS}"
query("r4_cluster_rows", f"{_REC}, {_ROWS} SELECT page_id, seq, row_no, row_pos FROM rp")(lambda spark, sf_dir: layout.cluster_rows(fx.regions(spark, sf_dir)).select("page_id", "seq", "row_no", "row_pos"))
_VERT = _fold("vw", "-(x + w / 2)", "x + w / 2", "w") + ", vp AS (SELECT *, grp AS col_no, CAST(row_number() OVER (PARTITION BY page_id, grp ORDER BY y, -(x + w / 2), seq) AS INT) AS col_pos FROM vw), vl AS (SELECT page_id, col_no, string_agg(trim(text), '' ORDER BY col_pos) AS line FROM vp GROUP BY page_id, col_no), vt AS (SELECT page_id, string_agg(line, chr(10) ORDER BY col_no) AS text FROM vl GROUP BY page_id)"
query("r6_vertical_order", f"{_REC}, {_VERT} SELECT page_id, seq, col_no, col_pos FROM vp")(lambda spark, sf_dir: layout.vertical_order(fx.regions(spark, sf_dir)).select("page_id", "seq", "col_no", "col_pos"))
query("t10_vertical_text", f"{_REC}, {_VERT} SELECT * FROM vt")(lambda spark, sf_dir: layout.vertical_text(fx.regions(spark, sf_dir)))
_TABLE = f"{_ROWS}, {_COLS}, {_NEAR}, pr AS (SELECT rp.*, nc.col_no FROM rp JOIN nc USING (page_id, seq)), rd AS (SELECT page_id, row_no, count(DISTINCT col_no) AS used, count(*) AS n FROM pr GROUP BY page_id, row_no), tb AS (SELECT page_id, sum(n) AS n, count(*) AS n_rows, count(*) FILTER (WHERE used >= 2) AS wide FROM rd GROUP BY page_id), nn AS (SELECT page_id, count(*) AS n_cols FROM ce GROUP BY page_id), it AS (SELECT page_id, n >= 4 AND n_rows >= 2 AND n_cols >= 2 AND wide >= 2 AS is_table, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols FROM tb JOIN nn USING (page_id)), gr AS (SELECT page_id, CAST(a AS INT) AS row_no, CAST(b AS INT) AS col_no FROM it, unnest(range(0, n_rows)) AS t(a), unnest(range(0, n_cols)) AS u(b) WHERE is_table), cx AS (SELECT page_id, row_no, col_no, string_agg(trim(text), ' ' ORDER BY row_pos) AS text FROM pr GROUP BY page_id, row_no, col_no), ce2 AS (SELECT gr.*, coalesce(cx.text, '') AS text FROM gr LEFT JOIN cx USING (page_id, row_no, col_no))"
query("a14_is_table", f"{_REC}, {_TABLE} SELECT * FROM it")(lambda spark, sf_dir: layout.is_table(fx.regions(spark, sf_dir)))
query("t7_table_cells", f"{_REC}, {_TABLE} SELECT * FROM ce2")(lambda spark, sf_dir: layout.table_cells(fx.regions(spark, sf_dir)))
_MONO = """cw AS (SELECT page_id, col_no, max(length(text)) AS cwid FROM ce2 GROUP BY page_id, col_no), cs AS (SELECT *, coalesce(sum(cwid + 2) OVER (PARTITION BY page_id ORDER BY col_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cw),
mc AS (SELECT ce2.*, CASE WHEN text = '' THEN '' ELSE repeat(' ', CAST(start - coalesce(max(CASE WHEN text <> '' THEN start + length(text) END) OVER (PARTITION BY page_id, row_no ORDER BY col_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT)) || text END AS piece FROM ce2 JOIN cs USING (page_id, col_no)),
ml AS (SELECT page_id, row_no, rtrim(string_agg(piece, '' ORDER BY col_no)) AS line FROM mc GROUP BY page_id, row_no), mt AS (SELECT page_id, string_agg(line, chr(10) ORDER BY row_no) AS text FROM ml GROUP BY page_id)"""
query("t8_table_text", f"{_REC}, {_TABLE}, {_MONO} SELECT * FROM mt")(lambda spark, sf_dir: layout.table_text(layout.table_cells(fx.regions(spark, sf_dir))))
query("s15_table_csv", f"{_REC}, {_TABLE}, cl2 AS (SELECT page_id, row_no, string_agg(text, ',' ORDER BY col_no) AS line FROM ce2 GROUP BY page_id, row_no) SELECT page_id, string_agg(line, chr(10) ORDER BY row_no) AS text FROM cl2 GROUP BY page_id")(lambda spark, sf_dir: layout.table_csv(layout.table_cells(fx.regions(spark, sf_dir))))
_SPACE = f"""{fx.REGIONS}, so AS (SELECT *, row_number() OVER w1 AS k, NOT coalesce(abs(y + h / 2 - lag(y) OVER w1 - lag(h) OVER w1 / 2) <= (h + lag(h) OVER w1) * 0.5 * 0.7
    OR least(y + h, lag(y) OVER w1 + lag(h) OVER w1) - greatest(y, lag(y) OVER w1) >= (h + lag(h) OVER w1) * 0.5 * 0.5, true) AS fresh FROM r WINDOW w1 AS (PARTITION BY page_id ORDER BY y, x, seq)),
sg AS (SELECT page_id, greatest(list_sort(list(w / greatest(length(text), 1)))[count(*) // 2 + 1], 2.5::DOUBLE, 1.0) AS cw, greatest(min(x), 0.0) AS lft, avg(h) AS mh FROM r GROUP BY page_id),
sl2 AS (SELECT so.*, sum(fresh::INT) OVER (PARTITION BY page_id ORDER BY k) AS line_no, CAST(least(greatest(round((x - lft) / cw), 0), 240) AS INT) AS col FROM so JOIN sg USING (page_id)),
sk AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_no ORDER BY x, y, seq) AS pos FROM sl2),
sf AS (SELECT page_id, line_no, pos, repeat(' ', col) || trim(text) AS line FROM sk WHERE pos = 1
  UNION ALL SELECT sk.page_id, sk.line_no, sk.pos, sf.line || CASE WHEN col > length(sf.line) THEN repeat(' ', CAST(col - length(sf.line) AS INT)) WHEN length(sf.line) > 0 AND NOT ends_with(sf.line, ' ') THEN ' ' ELSE '' END || trim(text)
  FROM sf JOIN sk ON sk.page_id = sf.page_id AND sk.line_no = sf.line_no AND sk.pos = sf.pos + 1),
sn AS (SELECT page_id, line_no, arg_max(line, pos) AS line FROM sf GROUP BY page_id, line_no),
sc AS (SELECT page_id, line_no, avg(y + h / 2) AS cy FROM sk GROUP BY page_id, line_no),
sd AS (SELECT *, cy - lag(cy) OVER (PARTITION BY page_id ORDER BY line_no) AS gap FROM sc),
se AS (SELECT page_id, list_sort(list(gap) FILTER (WHERE gap > 0)) AS gaps FROM sd GROUP BY page_id),
sp AS (SELECT page_id, CASE WHEN gaps IS NULL THEN greatest(mh, 300 / 80.0::DOUBLE, 1.0) ELSE greatest(gaps[(len(gaps) + 1) // 2 // 2 + 1], 1.0) END AS pitch FROM se JOIN sg USING (page_id)),
sb AS (SELECT page_id, line_no, CAST(coalesce(least(greatest(round(greatest(gap, 0) / pitch) - 1, 0), 16), 0) AS INT) AS blank FROM sd JOIN sp USING (page_id)),
st6 AS (SELECT page_id, string_agg(repeat(chr(10), blank) || rtrim(line), chr(10) ORDER BY line_no) AS text FROM sn JOIN sb USING (page_id, line_no) GROUP BY page_id)"""
query("t6_spatial_text", f"WITH RECURSIVE {_SPACE} SELECT * FROM st6")(lambda spark, sf_dir: layout.spatial_text(fx.regions(spark, sf_dir)))
_KIND = "vd AS (SELECT page_id, count(*) >= 2 AND 2 * count(*) FILTER (WHERE direction = 'Vertical') > count(*) AS vertical FROM r GROUP BY page_id), kd AS (SELECT page_id, CASE WHEN vertical THEN 'vertical' WHEN is_table THEN 'table' ELSE 'spatial' END AS layout FROM vd JOIN it USING (page_id))"
query("t11_layout_text", f"WITH RECURSIVE {_SPACE}, {_VERT}, {_TABLE.replace('ord AS', 'ord2 AS').replace('JOIN ord o', 'JOIN ord2 o').replace('FROM ord ', 'FROM ord2 ').replace('fold ', 'fold2 ').replace('JOIN fold2 USING', 'JOIN fold2 USING')}, {_MONO}, {_KIND} SELECT page_id, layout, CASE layout WHEN 'vertical' THEN vt.text WHEN 'table' THEN mt.text ELSE st6.text END AS text FROM kd LEFT JOIN vt USING (page_id) LEFT JOIN mt USING (page_id) LEFT JOIN st6 USING (page_id)")(lambda spark, sf_dir: layout.layout_text(fx.regions(spark, sf_dir)))

# pixels

_gray = lambda spark, sf_dir: pixels.to_gray(fx.pixels(spark, sf_dir))
_PX = f"WITH {fx.PIXELS}"
_M, _S = pixels.DETECTION_MEAN, pixels.DETECTION_STD
query("p1_normalize", _PX + " SELECT image_id, y, x, " + ", ".join(f"({c} / 255.0::DOUBLE - {m}) / {s} AS {c}" for c, m, s in zip("rgb", _M, _S, strict=True)) + " FROM px")(lambda spark, sf_dir: pixels.normalize_px(fx.pixels(spark, sf_dir)))
query("p1_denormalize", _PX + " SELECT image_id, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px")(lambda spark, sf_dir: pixels.denormalize_px(pixels.normalize_px(fx.pixels(spark, sf_dir))).select("image_id", "y", "x", *[F.round(c, 12).alias(c) for c in "rgb"]))
ORACLES["p1_denormalize"] = _PX + " SELECT image_id, y, x, round(r / 255.0::DOUBLE, 12) AS r, round(g / 255.0::DOUBLE, 12) AS g, round(b / 255.0::DOUBLE, 12) AS b FROM px"
query("p2_gray", f"{_PX} SELECT * FROM gray")(_gray)
query("p3_background", f"{_PX} SELECT image_id, avg(v) > 0.5 AS is_light, CAST(floor(sum(round(v * 255)) / count(*)) AS INT) AS luma FROM gray GROUP BY image_id")(lambda spark, sf_dir: pixels.background(_gray(spark, sf_dir)))
_rasters = lambda spark, sf_dir: rasters.of_images(fx.images(spark, sf_dir))
_tiles = lambda spark, sf_dir: rasters.tiles(_rasters(spark, sf_dir), 16)
query("p4_ink", f"{_PX} SELECT image_id, y, x, least(greatest(CASE WHEN avg(v) OVER (PARTITION BY image_id) > 0.5 THEN 1 - v ELSE v END, 0.0), 1.0) AS v FROM gray")(lambda spark, sf_dir: rasters.tile_pixels(_tiles(spark, sf_dir), lambda px, r: [rasters.ink(rasters.luma(px), r["mean"])], "v double"))


def _plan(spark, sf_dir):
    p = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    return p.withColumns({"src_w": F.lit(24), "src_h": F.lit(16), "dst_w": F.lit(12), "dst_h": (4 + F.col("image_id") % 9).cast("int"), "canvas_w": F.lit(14), "canvas_h": F.lit(16), "pad_x": F.lit(1), "pad_y": F.lit(2)})


_AXIS = "{n} AS (SELECT s_suppkey AS image_id, d, ({src}.0::DOUBLE / {dst} * (d + 0.5) - 0.5) AS pos FROM supplier, unnest(range(0, {dst})) AS t(d)), {n}t AS (SELECT image_id, d, CAST(least(greatest(floor(pos), 0), {src} - 1) AS INT) AS s0, least(greatest(pos - least(greatest(floor(pos), 0), {src} - 1), 0.0), 1.0) AS f FROM {n}), {n}w AS (SELECT image_id, d, s0 AS s, 1 - f AS k FROM {n}t UNION ALL SELECT image_id, d, least(s0 + 1, {src} - 1), f FROM {n}t)"
_RES = fx.PIXELS + ", " + _AXIS.format(n="ax", src=24, dst=12) + ", " + _AXIS.format(n="ay", src=16, dst="(4 + s_suppkey % 9)") + ", rx AS (SELECT g.image_id, y, d AS x, sum(v * k) AS v FROM gray g JOIN axw w ON w.image_id = g.image_id AND w.s = g.x GROUP BY g.image_id, y, d), rs AS (SELECT g.image_id, CAST(d AS INT) AS y, CAST(x AS INT) AS x, sum(v * k) AS v FROM rx g JOIN ayw w ON w.image_id = g.image_id AND w.s = g.y GROUP BY g.image_id, d, x)"
query("p5_resample", f"WITH {_RES} SELECT * FROM rs")(lambda spark, sf_dir: rasters.resample(_tiles(spark, sf_dir).withColumns({"dst_w": F.lit(12), "dst_h": (4 + F.col("image_id") % 9).cast("int")})))
query("p6_pad_canvas", f"WITH {_RES}, gr AS (SELECT s_suppkey AS image_id, CAST(a AS INT) AS y, CAST(b AS INT) AS x FROM supplier, range(16) AS t(a), range(14) AS u(b)) SELECT gr.image_id, gr.y, gr.x, coalesce(v, 1.0) AS v FROM gr LEFT JOIN rs ON rs.image_id = gr.image_id AND rs.y + 2 = gr.y AND rs.x + 1 = gr.x")(lambda spark, sf_dir: pixels.pad_canvas(pixels.resample(_gray(spark, sf_dir), _plan(spark, sf_dir)), _plan(spark, sf_dir)))


def _rects(spark, sf_dir):
    return fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") + 1000000).alias("crop_id"), (F.col("s_suppkey") % 9).cast("int").alias("x0"), F.lit(3).alias("y0"), F.lit(10).alias("w"), (F.col("s_suppkey") % 5 + 4).cast("int").alias("h"))


query("p7_crop", f"{_PX} SELECT image_id + 1000000 AS image_id, y - 3 AS y, CAST(x - image_id % 9 AS INT) AS x, r, g, b FROM px WHERE x >= image_id % 9 AND x < image_id % 9 + 10 AND y >= 3 AND y < 7 + image_id % 5")(lambda spark, sf_dir: pixels.crop_px(fx.pixels(spark, sf_dir), _rects(spark, sf_dir)))


@query("p8_crop_rotated", f"""{_PX}, o AS (SELECT s_suppkey AS image_id, oy, ox, least(greatest(8.3137::DOUBLE + (ox + 0.5) / 10 * 8 + (oy + 0.5) / 10 * -6, 0), 23)::DOUBLE AS sx, least(greatest(1.1271::DOUBLE + (ox + 0.5) / 10 * 6 + (oy + 0.5) / 10 * 8, 0), 15)::DOUBLE AS sy FROM supplier, range(10) AS t(oy), range(10) AS u(ox)),
q AS (SELECT *, floor(sx) AS a, floor(sy) AS b, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM o),
s AS (SELECT image_id, oy, ox, least(a + i, 23) AS x, least(b + j, 15) AS y, abs(1 - i - fx) * abs(1 - j - fy) AS w FROM q, range(2) AS t(i), range(2) AS u(j))
SELECT s.image_id + 1000000 AS image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(round(sum(r * w)) AS INT) AS r, CAST(round(sum(g * w)) AS INT) AS g, CAST(round(sum(b * w)) AS INT) AS b FROM s JOIN px ON px.image_id = s.image_id AND px.x = s.x AND px.y = s.y GROUP BY ALL""")
def p8(spark, sf_dir):
    q = F.array(*[g.point(F.lit(a), F.lit(b)) for a, b in ((8.3137, 1.1271), (16.3137, 7.1271), (10.3137, 15.1271), (2.3137, 9.1271))])
    d = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") + 1000000).alias("crop_id"), q.alias("quad"), F.lit(24).alias("page_w"), F.lit(16).alias("page_h"))
    return pixels.crop_rotated(fx.pixels(spark, sf_dir), d)


query("p9_rotate180", f"{_PX} SELECT image_id, 15 - y AS y, 23 - x AS x, r, g, b FROM px")(lambda spark, sf_dir: pixels.rotate180(fx.pixels(spark, sf_dir)))


@query("p10_needs_rotation", f"{_PX}, s AS (SELECT image_id, sum(CASE WHEN y < 8 THEN 1 - v ELSE 0 END) AS a, sum(CASE WHEN y >= 8 THEN 1 - v ELSE 0 END) AS b FROM gray GROUP BY image_id) SELECT image_id, abs(b - a) / (a + b) AS confidence, image_id % 3 <> 0 AND b > a AND abs(b - a) / (a + b) >= 0.05 AS rotate FROM s")
def p10(spark, sf_dir):
    d = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.when(F.col("s_suppkey") % 3 == 0, "Vertical").otherwise("Horizontal").alias("direction"))
    return pixels.needs_rotation(_gray(spark, sf_dir), d, 0.05)


@query("p11_rotation_scores", "WITH d AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 3 AS p0, abs(CAST(embedding[2] AS DOUBLE)) * 3 AS p1, CASE WHEN vec_id % 4 = 0 THEN 'Vertical' ELSE 'Horizontal' END AS direction FROM embeddings) SELECT vec_id, greatest(p0, p1) AS confidence, direction = 'Horizontal' AND p1 > p0 AND p1 >= 0.4 AS rotate FROM d")
def p11(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    d = e.select("vec_id", (F.abs(F.get("feature", F.lit(0))) * 3).alias("p0"), (F.abs(F.get("feature", F.lit(1))) * 3).alias("p1"), F.when(F.col("vec_id") % 4 == 0, "Vertical").otherwise("Horizontal").alias("direction"))
    return pixels.needs_rotation_scores(d, 0.4).select("vec_id", "confidence", "rotate")


_NB = "nb AS (SELECT *, lag(v) OVER a AS l1, lead(v) OVER a AS l2, lag(v) OVER b AS l3, lead(v) OVER b AS l4, avg(v) OVER (PARTITION BY image_id) > 0.5 AS light FROM gray WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y))"
query("p12_text_probability", f"{_PX}, {_NB} SELECT image_id, y, x, least(greatest(CASE WHEN light THEN 1 - v ELSE v END * 0.75 + (coalesce(abs(v - l1), 0) + coalesce(abs(v - l2), 0) + coalesce(abs(v - l3), 0) + coalesce(abs(v - l4), 0)) / ((l1 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT + (l3 IS NOT NULL)::INT + (l4 IS NOT NULL)::INT) * 0.25, 0.0), 1.0) AS p FROM nb")(lambda spark, sf_dir: rasters.tile_pixels(_tiles(spark, sf_dir), lambda px, r: [rasters.text_probability(rasters.luma(px), np.ones(px.shape[:2], bool), r["mean"])], "p double"))
_byte = lambda e: f"CAST(least(greatest(round({e}), 0), 255) AS INT)"
query("p13_brightness", _PX + " SELECT image_id, y, x, " + ", ".join(f"{_byte(f'{c} + (image_id % 7 - 3) / 20.0::DOUBLE * 255.0')} AS {c}" for c in "rgb") + " FROM px")(lambda spark, sf_dir: pixels.aug_brightness(fx.pixels(spark, sf_dir), (F.col("image_id") % 7 - 3) / 20.0))
query("p14_contrast", _PX + " SELECT image_id, y, x, " + ", ".join(f"{_byte(f'({c} - 128.0) * (1 + (image_id % 5 - 2) / 10.0::DOUBLE) + 128.0')} AS {c}" for c in "rgb") + " FROM px")(lambda spark, sf_dir: pixels.aug_contrast(fx.pixels(spark, sf_dir), 1 + (F.col("image_id") % 5 - 2) / 10.0))
def _noise(seed: str) -> str:
    """The noise of a pixel in SQL, by its image's seed and its place."""
    t = f"((({seed}) % 2147483647 + CAST(x AS BIGINT) * 7919 + CAST(y AS BIGINT) * 104729 + 1) % 2147483647 * 48271 + 11) % 2147483647"
    return f"((({t}) * ({t}) + ({t})) % 2147483647 % 31 - 15)"


_NO = _noise("image_id")
query("p15_noise", _PX + " SELECT image_id, y, x, " + ", ".join(f"{_byte(f'{c} + {_NO}')} AS {c}" for c in "rgb") + " FROM px")(lambda spark, sf_dir: pixels.aug_noise(fx.pixels(spark, sf_dir), 0.02))
query("p16_blur", _PX + ", s AS (SELECT a.image_id, a.y, a.x, sum(b.r) AS r, sum(b.g) AS g, sum(b.b) AS b, count(*) AS n FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.y, a.x) SELECT image_id, y, x, CAST(r // n AS INT) AS r, CAST(g // n AS INT) AS g, CAST(b // n AS INT) AS b FROM s")(lambda spark, sf_dir: rasters.tile_pixels(_tiles(spark, sf_dir), lambda px, r: list(np.moveaxis(rasters.box_blur(px.astype(np.int32), np.ones(px.shape[:2], bool), r["width"], r["height"]), 2, 0)), "r int, g int, b int"))
_CONTENT = "ct AS (SELECT image_id, CAST(sum((CAST(r AS BIGINT) * 65536 + g * 256 + b + 1) * ((CAST(x AS BIGINT) * 7919 + CAST(y AS BIGINT) * 104729 + 12345) % 1000003) % 2147483647) AS BIGINT) AS seed FROM px GROUP BY image_id)"
_U = [f"CAST(('0x' || substr(md5(seed || ':{k}'), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0" for k in range(4)]
query("p17_content_uniform", f"{_PX}, {_CONTENT} SELECT image_id, seed AS content, {_U[3]} AS u FROM ct")(lambda spark, sf_dir: pixels.content_hash(fx.pixels(spark, sf_dir)).withColumn("u", pixels.image_uniform(F.col("content"), 3)))
_each = lambda e: ", ".join(f"{_byte(e.format(c=c))} AS {c}" for c in "rgb")
_AUG = f"""{_CONTENT}, u AS (SELECT px.*, seed, {_U[0]} AS u0, {_U[1]} AS u1, {_U[2]} AS u2, {_U[3]} AS u3 FROM px JOIN ct USING (image_id)),
a1 AS (SELECT image_id, y, x, seed, u1, u2, u3, {_each('{c} + (u0 * 2.0 * 0.15::DOUBLE - 0.15::DOUBLE) * 255.0')} FROM u),
a2 AS (SELECT image_id, y, x, seed, u2, u3, {_each('({c} - 128.0) * (1.0 + (u1 * 2.0 * 0.2::DOUBLE - 0.2::DOUBLE)) + 128.0')} FROM a1),
a3 AS (SELECT image_id, y, x, u3, {_each('{c} + CASE WHEN u2 > 0.4 THEN ' + _noise("seed") + ' ELSE 0 END')} FROM a2),
bl AS (SELECT a.image_id, a.y, a.x, sum(b.r) // count(*) AS r, sum(b.g) // count(*) AS g, sum(b.b) // count(*) AS b FROM a3 a JOIN a3 b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.u3 > 0.7 GROUP BY a.image_id, a.y, a.x)"""
query("p18_augment", f"{_PX}, {_AUG} SELECT a3.image_id, a3.y, a3.x, CAST(coalesce(bl.r, a3.r) AS INT) AS r, CAST(coalesce(bl.g, a3.g) AS INT) AS g, CAST(coalesce(bl.b, a3.b) AS INT) AS b FROM a3 LEFT JOIN bl ON bl.image_id = a3.image_id AND bl.y = a3.y AND bl.x = a3.x")(lambda spark, sf_dir: pixels.augment(fx.pixels(spark, sf_dir)))
QUERIES["p19_template_feature"] = lambda spark, sf_dir: pipelines.template_features(_rasters(spark, sf_dir), 12, 12)
_CH = fx.PIXELS + ", " + _AXIS.format(n="ax", src=24, dst=12) + ", " + _AXIS.format(n="ay", src=16, dst="(4 + s_suppkey % 9)") + """, c3 AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM px),
rx3 AS (SELECT g.image_id, c, y, d AS x, sum(v * k) AS v FROM c3 g JOIN axw w ON w.image_id = g.image_id AND w.s = g.x GROUP BY g.image_id, c, y, d),
rs3 AS (SELECT g.image_id, c, d AS y, x, sum(v * k) AS v FROM rx3 g JOIN ayw w ON w.image_id = g.image_id AND w.s = g.y GROUP BY g.image_id, c, d, x),
gr3 AS (SELECT s_suppkey AS image_id, c, a AS y, b AS x FROM supplier, range(3) AS s(c), range(16) AS t(a), range(14) AS u(b))"""
query("p20_model_input", f"WITH {_CH} SELECT gr3.image_id, list(round((coalesce(v, 255.0) / 255.0 - 0.5) / 0.5, 9) ORDER BY gr3.c, gr3.y, gr3.x) AS values FROM gr3 LEFT JOIN rs3 ON rs3.image_id = gr3.image_id AND rs3.c = gr3.c AND rs3.y + 2 = gr3.y AND rs3.x + 1 = gr3.x GROUP BY gr3.image_id")(lambda spark, sf_dir: pixels.model_input(fx.pixels(spark, sf_dir), _plan(spark, sf_dir), kernel="bilinear").withColumn("values", F.transform("values", lambda v: F.round(v, 9))))

# detection

_CC = f"WITH RECURSIVE {fx.PROB}"
_prob = fx.probabilities
query("d1_binarize", f"{_CC} SELECT * FROM fg")(lambda spark, sf_dir: detection.binarize(_prob(spark, sf_dir)))
query("d2_components", f"{_CC} SELECT image_id, y, x, p, CAST(label // 100 AS INT) AS label_y, CAST(label % 100 AS INT) AS label_x FROM comp")(lambda spark, sf_dir: detection.components(detection.binarize(_prob(spark, sf_dir))).select("image_id", "y", "x", "p", F.col("label.y").alias("label_y"), F.col("label.x0").alias("label_x")))


def _stats(spark, sf_dir):
    return detection.component_stats(detection.components(detection.binarize(_prob(spark, sf_dir))))


_flat_stats = lambda d: d.select("image_id", F.col("label.y").alias("label_y"), F.col("label.x0").alias("label_x"), "x0", "y0", "x1", "y1", "n", "score")
_ST = "SELECT image_id, CAST(label // 100 AS INT) AS label_y, CAST(label % 100 AS INT) AS label_x, x0, y0, x1, y1, n, score FROM"
query("d3_component_stats", f"{_CC} {_ST} stats")(lambda spark, sf_dir: _flat_stats(_stats(spark, sf_dir)))
query("d4_filter_components", f"{_CC} {_ST} stats WHERE score >= 0.6 AND (x1 - x0) * (y1 - y0) >= 6")(lambda spark, sf_dir: _flat_stats(detection.filter_components(_stats(spark, sf_dir))))
query("d5_cap_candidates", f"{_CC} {_ST} (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS k FROM stats) WHERE k <= 3")(lambda spark, sf_dir: _flat_stats(detection.cap_candidates(_stats(spark, sf_dir), 3)))
# the least area of any angle has a side along two points of the component
_LEAST = "dr AS (SELECT DISTINCT a.image_id, a.label, b.x - a.x AS dx, b.y - a.y AS dy FROM comp a JOIN comp b ON a.image_id = b.image_id AND a.label = b.label AND (b.x > a.x OR (b.x = a.x AND b.y > a.y))), ar AS (SELECT dr.image_id, dr.label, (max(x * dx + y * dy) - min(x * dx + y * dy)) * (max(y * dx - x * dy) - min(y * dx - x * dy)) / (dx * dx + dy * dy)::DOUBLE AS area FROM dr JOIN comp c ON c.image_id = dr.image_id AND c.label = dr.label GROUP BY dr.image_id, dr.label, dx, dy), la AS (SELECT stats.*, coalesce(least_area, 0.0) AS area FROM stats LEFT JOIN (SELECT image_id, label, min(area) AS least_area FROM ar GROUP BY image_id, label) USING (image_id, label))"
query("d6_min_area_rect", f"{_CC}, {_LEAST} SELECT image_id, CAST(label // 100 AS INT) AS label_y, CAST(label % 100 AS INT) AS label_x, round(area, 6) AS area FROM la")(lambda spark, sf_dir: detection.min_area_rect(detection.label_runs(detection.binarize(_prob(spark, sf_dir)))).select("image_id", F.col("label.y").alias("label_y"), F.col("label.x0").alias("label_x"), F.round(g.quad_area(F.col("quad")), 6).alias("area")))


def _meta(spark, sf_dir):
    names = ("pad_x", "pad_y", "content_w", "content_h", "scale_x", "scale_y", "orig_w", "orig_h")
    d = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    return d.withColumns({k: F.lit(v) for k, v in zip(names, (1, 1, 22, 14, 2.0, 3.0, 44, 42), strict=True)})


_UX = "(x1 - x0) * (y1 - y0) * 1.5::DOUBLE / (2.0 * (x1 - x0 + y1 - y0))"
_BK = {c: (lambda v, m=m, s=s, o=o: f"least(greatest(least(greatest({v} - 1, 0.0), {m}.0) * {s}.0, 0.0), {o}.0)") for c, m, s, o in (("x", 22, 2, 44), ("y", 14, 3, 42))}


@query("d7_detect_regions", f"""{_CC}, k AS (SELECT *, {_UX} AS d FROM stats WHERE score >= 0.6 AND (x1 - x0) * (y1 - y0) >= 6),
b AS (SELECT image_id AS page_id, label, score AS det_conf, {_BK['x']('(x0 - d)')} AS a, {_BK['y']('(y0 - d)')} AS t, {_BK['x']('(x1 + d)')} AS c, {_BK['y']('(y1 + d)')} AS e FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY label) AS n FROM b),
l AS (SELECT *, t - lag(t) OVER w1 > (e - t + lag(e - t) OVER w1) * 0.25 AS far FROM o WINDOW w1 AS (PARTITION BY page_id ORDER BY t, a, n)),
d AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY t, a, n ROWS UNBOUNDED PRECEDING) AS band FROM l)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, a, n) AS INT) AS seq, a AS x0, t AS y0, c AS x1, e AS y1, det_conf FROM d""")
def d7(spark, sf_dir):
    d = detection.detect_regions(_prob(spark, sf_dir), _meta(spark, sf_dir))
    return d.select("page_id", "seq", g.left(F.col("quad")).alias("x0"), g.top(F.col("quad")).alias("y0"), g.right(F.col("quad")).alias("x1"), g.bottom(F.col("quad")).alias("y1"), "det_conf")


@query("d7_detect_rotated", f"{_CC}, {_LEAST}, k AS (SELECT image_id, label, score, row_number() OVER (PARTITION BY image_id ORDER BY label) AS n FROM la WHERE score >= 0.5 AND area >= 3.9) SELECT image_id AS page_id, score AS det_conf FROM k WHERE n <= 2")
def d7_rotated(spark, sf_dir):
    """Which components stay, by the area of their least box of any angle, of which two a page."""
    return detection.detect_regions(_prob(spark, sf_dir), _meta(spark, sf_dir), 0.5, 0.5, 1.7, 3.9, 2, rotated=True).select("page_id", "det_conf")


QUERIES["d8_detect_model_free"] = lambda spark, sf_dir: detection.detect_in_rasters(_rasters(spark, sf_dir), box_threshold=0.3, min_area=1.0).select("page_id", "seq", g.left(F.col("quad")).alias("x0"), g.top(F.col("quad")).alias("y0"), "det_conf")

# recognition

_LG = f"WITH {fx.LOGITS}"
query("r7_argmax_softmax", f"{_LG}, m AS (SELECT *, list_max(v) AS best FROM lg) SELECT crop_id, t, CAST(list_position(v, best) - 1 AS INT) AS idx, 1 / list_sum(list_transform(v, lambda x: exp(x - best))) AS conf FROM m")(lambda spark, sf_dir: recognition.argmax_steps(fx.logits(spark, sf_dir)))
query("r7_argmax_probability", f"{_LG} SELECT crop_id, t, CAST(list_position(v, list_max(v)) - 1 AS INT) AS idx, greatest(list_max(v), 0.0) AS conf FROM lg")(lambda spark, sf_dir: recognition.argmax_steps(fx.logits(spark, sf_dir), "probability"))
query("j5_r8_ctc_decode", f"{_LG}, s AS (SELECT crop_id, t, list_position(v, list_max(v)) - 1 AS idx, greatest(list_max(v), 0.0) AS conf FROM lg), k AS (SELECT *, idx <> 0 AND idx <> lag(idx, 1, 0) OVER (PARTITION BY crop_id ORDER BY t) AS keep FROM s) SELECT crop_id, coalesce(string_agg(substr('abc', idx, 1), '' ORDER BY t) FILTER (WHERE keep), '') AS text, coalesce(avg(conf) FILTER (WHERE keep), 0.0) AS confidence FROM k GROUP BY crop_id")(lambda spark, sf_dir: recognition.ctc_decode(recognition.argmax_steps(fx.logits(spark, sf_dir), "probability"), fx.small_dict(spark)))


@query("r9_time_major", "WITH e AS (SELECT vec_id AS crop_id, CAST(embedding AS DOUBLE[]) AS f, vec_id % 3 AS kind FROM embeddings) SELECT crop_id, CAST(t AS INT) AS t, CASE kind WHEN 0 THEN f[t * 4 + 1:t * 4 + 4] WHEN 1 THEN f[t * 16 + 1:t * 16 + 16] ELSE list_transform(range(0, 16), lambda c: f[c * 4 + t + 1]) END AS v FROM e, range(16) AS s(t) WHERE kind = 0 OR t < 4")
def r9(spark, sf_dir):
    # sixteen rows of the dictionary's four classes; four rows of sixteen; sixteen rows of four steps, where the dictionary has more
    d = fx.embeddings(spark, sf_dir).select(F.col("vec_id").alias("crop_id"), (F.col("vec_id") % 3).alias("kind"), F.col("feature").alias("flat"))
    d = d.withColumns({"n_rows": F.when(F.col("kind") == 1, 4).otherwise(16), "n_cols": F.when(F.col("kind") == 1, 16).otherwise(4)})
    return recognition.to_time_major(d.filter("kind < 2"), 4).unionByName(recognition.to_time_major(d.filter("kind = 2"), 5))


_SAM = f"WITH {fx.CHARS}, {fx.SAMPLES}"
query("s6_char_dict", f"WITH {fx.CHARS} SELECT * FROM chars")(lambda spark, sf_dir: tables.read_char_dict(spark, fx.dict_files(spark, sf_dir)).filter("idx > 0").select("ch", "idx"))
query("j4_encode_labels", f"{_SAM}, sp AS (SELECT seq, unnest(string_split(label_text, '')) AS ch, generate_subscripts(string_split(label_text, ''), 1) AS k FROM samples), en AS (SELECT seq, list(idx ORDER BY k) AS label_indices FROM sp JOIN chars USING (ch) WHERE idx % 9 <> 4 GROUP BY seq) SELECT samples.seq, CAST(len(coalesce(label_indices, [])) AS INT) AS n, CAST(coalesce(list_sum(label_indices), 0) AS BIGINT) AS total, label_indices[1] AS first, label_indices[-1] AS last FROM samples LEFT JOIN en USING (seq)")(lambda spark, sf_dir: recognition.encode_labels(fx.samples(spark, sf_dir), fx.char_dict(spark, sf_dir).filter("idx % 9 <> 4")).select("seq", F.size("label_indices").alias("n"), F.aggregate("label_indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get("label_indices", F.lit(0)).alias("first"), F.get("label_indices", F.size("label_indices") - 1).alias("last")))
query("t15_keep_known", f"{_SAM}, sp AS (SELECT seq, unnest(string_split(label_text, '')) AS ch, generate_subscripts(string_split(label_text, ''), 1) AS k FROM samples) SELECT seq AS key, string_agg(ch, '' ORDER BY k) AS label FROM sp JOIN chars USING (ch) WHERE idx % 9 <> 4 GROUP BY seq HAVING count(*) >= 5")(lambda spark, sf_dir: recognition.keep_known(fx.samples(spark, sf_dir).select(F.col("seq").alias("key"), F.col("label_text").alias("label")), fx.char_dict(spark, sf_dir).filter("idx % 9 <> 4"), 5))
_TM = "fe AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), tn AS (SELECT label, k, avg(f[k]) AS m, count(*) AS n FROM fe, range(1, 65) AS t(k) GROUP BY label, k), nr AS (SELECT label, greatest(sqrt(sum(m * m)), 1.1920929e-7) AS norm, any_value(n) AS n FROM tn GROUP BY label), tp AS (SELECT tn.label, nr.n AS sample_count, list(m / norm ORDER BY k) AS feature FROM tn JOIN nr USING (label) GROUP BY tn.label, nr.n)"


def _templates(spark, sf_dir):
    return recognition.train_templates(fx.embeddings(spark, sf_dir).withColumnRenamed("vec_id", "sample_id"))


query("a1_train_templates", f"WITH {_TM} SELECT label, sample_count, list_transform(feature, lambda x: round(x, 9)) AS feature FROM tp")(lambda spark, sf_dir: _templates(spark, sf_dir).select("label", "sample_count", F.transform("feature", lambda x: F.round(x, 9)).alias("feature")))
query("j6_j7_match_templates", f"WITH {_TM}, sc AS (SELECT vec_id, tp.label, least(greatest(list_dot_product(f, feature), 0.0), 1.0) AS s FROM fe, tp), bs AS (SELECT vec_id, arg_max(label, (s, label)) AS label, max(s) AS s FROM sc GROUP BY vec_id) SELECT vec_id AS sample_id, CASE WHEN s < 0.4 THEN '' ELSE label END AS text, round(s, 9) AS confidence FROM bs")(lambda spark, sf_dir: recognition.match_templates(fx.embeddings(spark, sf_dir).withColumnRenamed("vec_id", "sample_id"), _templates(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9)))


@query("j9_assemble_regions", f"WITH {fx.REGIONS} SELECT page_id, seq, CASE WHEN seq % 3 = 0 THEN direction ELSE 'Horizontal' END AS direction, CASE WHEN seq % 3 = 0 THEN page_id % 2 = 0 ELSE false END AS rotate, text, det_conf * rec_conf AS confidence FROM r WHERE seq % 4 <> 0")
def j9(spark, sf_dir):
    r = fx.regions(spark, sf_dir)
    turn = r.filter("seq % 3 = 0").select("page_id", "seq", "direction", (F.col("page_id") % 2 == 0).alias("rotate"))
    d = recognition.assemble_regions(r.select("page_id", "seq", "quad", "det_conf"), turn, r.filter("seq % 4 <> 0").select("page_id", "seq", "text", "rec_conf"))
    return d.select("page_id", "seq", "direction", "rotate", "text", "confidence")


# text

_CJ = f"WITH {fx.IDEOGRAPHS}"
query("t9_display_width", f"{_CJ} SELECT key, CAST(length(text) + 2 AS INT) AS width FROM cj")(lambda spark, sf_dir: fx.ideographs(spark, sf_dir).select("key", t.display_width(F.col("text")).alias("width")))
query("t14_cjk_score", f"{_CJ} SELECT key, CAST(2 * (key % 4) AS INT) AS score FROM cj")(lambda spark, sf_dir: fx.ideographs(spark, sf_dir).select("key", t.cjk_score(F.concat("name", F.repeat("good", (F.col("key") % 4).cast("int")), F.lit("é〜"))).alias("score")))


@query("t13_repair_mojibake", f"{_CJ} SELECT key, text AS repaired FROM cj")
def t13(spark, sf_dir):
    wrong = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), t.CP1252_BYTES, t.CP1252)
    return fx.ideographs(spark, sf_dir).select("key", t.repair_mojibake(F.when(F.col("key") % 4 == 0, F.col("text")).otherwise(wrong)).alias("repaired"))


# evaluation and training

_EV = f"WITH {fx.PREDS}"
query("a2_line_accuracy", f"{_EV} SELECT coalesce(avg(CAST(exact AS DOUBLE)), 0.0) AS line_accuracy FROM ev")(lambda spark, sf_dir: evaluation.line_accuracy(fx.preds(spark, sf_dir)))
query("a3_char_accuracy", f"{_EV} SELECT greatest(1 - sum(distance)::DOUBLE / sum(target_chars), 0.0) AS char_accuracy FROM ev")(lambda spark, sf_dir: evaluation.char_accuracy(fx.preds(spark, sf_dir)))
query("a4_eval_report", f"{_EV} SELECT sample_id, confidence, exact, CAST(distance AS INT) AS distance FROM ev")(lambda spark, sf_dir: evaluation.eval_report(fx.preds(spark, sf_dir)).select("sample_id", "confidence", "exact", "distance"))
query("a5_validation_accuracy", f"{_EV} SELECT avg(CAST(prediction = target AS DOUBLE)) AS accuracy FROM preds")(lambda spark, sf_dir: evaluation.validation_accuracy(fx.preds(spark, sf_dir)))


def _labels(spark, sf_dir):
    n = (F.col("vec_id") % 6).cast("int")
    label = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: (i * 7 + F.col("vec_id")).cast("int") % 3 + 1))
    return fx.embeddings(spark, sf_dir).select(F.col("vec_id").alias("crop_id"), label.alias("label_indices"))


_LB = f"{fx.LOGITS}, lb AS (SELECT vec_id AS crop_id, vec_id % 6 AS n FROM embeddings), lc AS (SELECT crop_id, n, i - 1 AS i, (i * 7 + crop_id) % 3 + 1 AS c FROM lb, unnest(range(1, n + 1)) AS t(i))"
query("a6_alignment_loss", f"WITH {_LB}, pl AS (SELECT crop_id, CAST(floor((i + 0.5::DOUBLE) / n * 16) AS INT) AS t, arg_max(c, i) AS c FROM lc GROUP BY ALL) SELECT lg.crop_id, avg(-ln(greatest(abs(v[coalesce(c, 0) + 1]), 1e-6))) AS loss FROM lg LEFT JOIN pl ON pl.crop_id = lg.crop_id AND pl.t = lg.t GROUP BY lg.crop_id")(lambda spark, sf_dir: evaluation.alignment_loss(fx.logits(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.abs(x))), _labels(spark, sf_dir)))
query("a7_simple_ctc_loss", f"WITH {_LB}, pl AS (SELECT crop_id, c, CAST(floor(i * (16::DOUBLE / n)) AS INT) AS t FROM lc), ls AS (SELECT pl.crop_id, avg(-v[c + 1]) AS loss FROM pl JOIN lg ON lg.crop_id = pl.crop_id AND lg.t = pl.t GROUP BY pl.crop_id) SELECT lb.crop_id, coalesce(loss, 0.0) AS loss FROM lb LEFT JOIN ls USING (crop_id)")(lambda spark, sf_dir: evaluation.simple_ctc_loss(fx.logits(spark, sf_dir), _labels(spark, sf_dir)))
_PG = f"WITH {fx.PROGRESS}"
query("a8_running_metrics", f"{_PG} SELECT epoch, batch, avg(loss) OVER w1 AS running_loss, sum(correct) OVER w1 / (sum(processed) OVER w1)::DOUBLE AS running_accuracy FROM progress WINDOW w1 AS (PARTITION BY run, epoch ORDER BY batch)")(lambda spark, sf_dir: evaluation.running_metrics(fx.progress(spark, sf_dir)).select("epoch", "batch", "running_loss", "running_accuracy"))
_EP = "ep AS (SELECT run, epoch, round(avg(loss), 6) AS loss, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS batches FROM progress GROUP BY run, epoch)"


def _epochs(spark, sf_dir):
    d = streams.epoch_metrics(fx.progress(spark, sf_dir).withColumn("accuracy", F.col("correct").cast("double")))
    return d.withColumn("loss", F.round("loss", 6))


query("x2_epoch_metrics", f"{_PG}, {_EP} SELECT * FROM ep")(_epochs)
def _measured(spark, sf_dir):
    """Runs and what their initial models were measured at: one that no epoch reaches, one that every epoch does."""
    return fx.table(spark, sf_dir, "region").select(F.concat(F.lit("run"), F.when(F.col("r_regionkey") == 0, "").otherwise(F.col("r_regionkey").cast("string"))).alias("run"), (F.col("r_regionkey") * 0.25).alias("accuracy"))


_RUNS = "ms AS (SELECT 'run' || CASE WHEN r_regionkey = 0 THEN '' ELSE CAST(r_regionkey AS VARCHAR) END AS run, r_regionkey * 0.25::DOUBLE AS accuracy FROM region), ex AS (SELECT ms.run, epoch, loss, ep.accuracy FROM ep, ms), cand AS (SELECT run, epoch, loss, accuracy FROM ex UNION ALL SELECT run, 0, CAST('inf' AS DOUBLE), accuracy FROM ms)"


@query("a9_best_checkpoint", f"{_PG}, {_EP}, {_RUNS} SELECT run, epoch, loss, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, loss, epoch DESC) AS k FROM cand) WHERE k = 1")
def a9(spark, sf_dir):
    """The same epochs under several runs, whose initial models differ."""
    runs = _measured(spark, sf_dir)
    epochs = _epochs(spark, sf_dir).drop("run").join(F.broadcast(runs.select("run")), F.lit(True))
    return evaluation.best_checkpoint(epochs, runs)


query("r10_split_every_fifth", f"{_SAM}, k AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k FROM samples) SELECT seq, k % 5 <> 0 AS in_train, k % 5 = 0 AS in_validation FROM k")(lambda spark, sf_dir: evaluation.split_every_fifth(fx.samples(spark, sf_dir)).select("seq", "in_train", "in_validation"))


def _widths(spark, sf_dir):
    return fx.samples(spark, sf_dir).withColumn("width", g.rec_width(F.length("label_text") * 10 + 1, F.lit(48)))


_WD = f"{_SAM}, wd AS (SELECT *, CASE WHEN c <= 48 OR c >= 2048 THEN c ELSE least((c + 31) // 32 * 32, 2048) END AS width FROM (SELECT *, CAST(least(greatest(length(label_text) * 10 + 1, 48), 2048) AS INT) AS c FROM samples))"
query("r11_batches_by_width", f"{_WD} SELECT seq, CAST(width AS INT) AS width, CAST((row_number() OVER (PARTITION BY width ORDER BY seq) - 1) // 32 AS INT) AS batch_no FROM wd")(lambda spark, sf_dir: evaluation.assign_batches(_widths(spark, sf_dir)).select("seq", "width", "batch_no"))


def _few_labels(spark, sf_dir):
    d = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("width"), F.col("p_brand").alias("part"))
    return d.withColumn("label_indices", F.transform(F.sequence(F.lit(1), (F.col("seq") % 5 + 1).cast("int")), lambda i: i))


query("r11_r12_padded_chunks", "WITH b AS (SELECT p_partkey AS seq, p_size AS width, p_brand AS part, CAST(p_partkey % 5 + 1 AS INT) AS n, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 32 AS INT) AS batch_no FROM part), m AS (SELECT *, max(n) OVER (PARTITION BY part, batch_no, width) AS most FROM b) SELECT seq, batch_no, n AS label_length, list_concat(CAST(range(1, n + 1) AS INT[]), list_transform(range(0, most - n), lambda x: 0)) AS padded FROM m")(lambda spark, sf_dir: evaluation.pad_batches(evaluation.assign_batches(_few_labels(spark, sf_dir), 32, "chunk", ["part"]), ["part", "batch_no", "width"]).select("seq", "batch_no", "label_length", "padded"))
query("r13_latest_models", "SELECT o_orderpriority || '-' || o_orderkey AS name, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders ORDER BY created_at DESC, name DESC LIMIT 10")(lambda spark, sf_dir: evaluation.latest_models(fx.table(spark, sf_dir, "orders").select(F.concat_ws("-", "o_orderpriority", "o_orderkey").alias("name"), F.unix_timestamp("o_orderdate").alias("created_at")), 10))

# sources and data sets


def _label_lines(spark, sf_dir):
    d = fx.samples(spark, sf_dir)
    value = F.when(F.col("seq") % 11 == 0, F.concat(F.lit(" \t"), "label_text")).otherwise(F.concat_ws("\t", "image_path", "label_text"))
    return d.select(F.lit("labels.txt").alias("file"), F.col("seq").alias("line"), "seq", value.alias("value"))


_TSV = f"{_SAM}, tv AS (SELECT seq, trim(CASE WHEN seq % 11 = 0 THEN ' ' || chr(9) || label_text ELSE image_path || chr(9) || label_text END, chr(9) || ' ') AS value FROM samples)"
query("s3_s4_parse_labels", f"{_TSV} SELECT seq, substr(value, 1, strpos(value, chr(9)) - 1) AS image_path, substr(value, strpos(value, chr(9)) + 1) AS label_text FROM tv WHERE strpos(value, chr(9)) > 0")(lambda spark, sf_dir: tables.parse_labels(_label_lines(spark, sf_dir))[0])
query("s3_rejects", f"{_TSV} SELECT seq AS line, value FROM tv WHERE strpos(value, chr(9)) = 0 AND value <> ''")(lambda spark, sf_dir: tables.parse_labels(_label_lines(spark, sf_dir))[1].select("line", "value"))


@query("s5_join_images", "WITH s AS (SELECT p_partkey AS seq, s_suppkey FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 200) SELECT seq, s_suppkey AS image_id FROM s WHERE s_suppkey IS NOT NULL")
def s5(spark, sf_dir):
    s = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.col("p_partkey") % 200, F.lit(".png")).alias("image_path"))
    i = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.concat(F.lit("file:/images/"), F.col("s_suppkey"), F.lit(".png")).alias("origin"))
    return tables.join_images(s, i)[0].select("seq", "image_id")


@query("s7_builtin_chars", "WITH b AS (SELECT '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,:;!?+-*/=_()[]{}<>@#%&''\" ' AS s), c AS (SELECT unnest(string_split(s, '')) AS ch FROM b), d AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, count(*) AS n FROM d WHERE ch IN (SELECT ch FROM c) GROUP BY ch")
def s7(spark, sf_dir):
    chars = fx.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.join(tables.builtin_char_dict(spark).filter("idx > 0"), "ch", "left_semi")


def _annotations(spark, sf_dir):
    """Pages of orders as JSON files, read again; every seventh text is missing at the end."""
    r = fx.regions(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "x", "y", "w", "h"))).alias("r"))
    texts = F.slice(F.transform("r", lambda v: v["text"]), F.lit(1), F.when(F.col("page_id") % 7 == 0, F.size("r") - 1).otherwise(F.size("r")))
    row = F.struct(F.struct(F.concat(F.lit("p"), "page_id").alias("src")).alias("image"), texts.alias("texts"), F.transform("r", lambda v: F.array(v["x"], v["y"], v["x"] + v["w"], v["y"] + v["h"])).alias("bboxes"))
    rows = r.select(F.floor(F.col("page_id") / 100).alias("part"), F.struct(F.col("page_id").alias("row_idx"), row.alias("row")).alias("row")).groupBy("part").agg(F.collect_list("row").alias("rows"))
    path = scratch(spark, "annotations")
    rows.select(F.to_json(F.struct("rows")).alias("json")).write.text(path)
    return tables.read_dataset_json(spark, path, multi_line=False)


query("s8_s9_annotations", f"WITH {fx.REGIONS}, m AS (SELECT *, max(seq) OVER (PARTITION BY page_id) AS n FROM r) SELECT page_id AS row_idx, seq - 1 AS region, 'p' || page_id AS src, text AS label, x AS x0, y + h AS y1 FROM m WHERE page_id % 7 <> 0 OR seq < n")(lambda spark, sf_dir: tables.explode_annotations(_annotations(spark, sf_dir))[0].select("row_idx", "region", "src", "label", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1")))
query("s9_skipped", f"WITH {fx.REGIONS} SELECT 'no text for the box' AS reason, count(DISTINCT page_id) AS n FROM r WHERE page_id % 7 = 0 HAVING count(*) > 0")(lambda spark, sf_dir: tables.explode_annotations(_annotations(spark, sf_dir))[1])
query("s10_label_lines", f"WITH {fx.REGIONS} SELECT page_id AS row_idx, seq AS region, 'train_' || page_id || '_' || seq || '.jpg' AS name, 'train_' || page_id || '_' || seq || '.jpg' || chr(9) || text AS line FROM r")(lambda spark, sf_dir: tables.label_lines(fx.regions(spark, sf_dir).select(F.col("page_id").alias("row_idx"), F.col("seq").alias("region"), F.col("text").alias("label")), "train"))


def _sizes(spark, sf_dir):
    return fx.regions(spark, sf_dir).groupBy("page_id").agg(F.lit(400).alias("w"), F.lit(100).alias("h")).select(F.concat(F.lit("p"), "page_id").alias("src"), "w", "h")


def _prepared(spark, sf_dir):
    return pipelines.prepare_dataset(_annotations(spark, sf_dir), _sizes(spark, sf_dir), fx.char_dict(spark, sf_dir), "train", 3)


_Q3 = f"WITH {fx.REGIONS}, {fx.CHARS}, m AS (SELECT *, max(seq) OVER (PARTITION BY page_id) AS n FROM r), s AS (SELECT page_id AS row_idx, seq - 1 AS region, text, x, y, w, h FROM m WHERE page_id % 7 <> 0 OR seq < n), ch AS (SELECT row_idx, region, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS k FROM s), lb AS (SELECT row_idx, region, string_agg(ch, '' ORDER BY k) AS label FROM ch JOIN chars USING (ch) GROUP BY ALL HAVING count(*) >= 3), o AS (SELECT s.row_idx, s.region, label, CASE WHEN label IS NULL THEN 'label' WHEN round(least(greatest(x + w, least(x, 399) + 1), 400) - least(x, 399)) < 2 OR round(least(greatest(y + h, least(y, 99) + 1), 100) - least(y, 99)) < 2 THEN 'box' END AS reason FROM s LEFT JOIN lb USING (row_idx, region))"
query("q3_prepare_dataset", f"{_Q3} SELECT row_idx, region, 'train_' || row_idx || '_' || region || '.jpg' AS name, label, reason FROM o")(lambda spark, sf_dir: _prepared(spark, sf_dir).select("row_idx", "region", "name", "label", "reason"))
query("s11_ingest_report", f"{_Q3} SELECT count(*) FILTER (WHERE reason IS NULL) AS written, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped FROM o")(lambda spark, sf_dir: tables.ingest_report(_prepared(spark, sf_dir)))
_Q2 = f"""{_SAM}, cd AS (SELECT seq, length(label_text) AS n, row_number() OVER (ORDER BY seq) - 1 AS k FROM samples WHERE length(label_text) > 0),
wd AS (SELECT *, CASE WHEN c <= 48 OR c >= 2048 THEN c ELSE least((c + 31) // 32 * 32, 2048) END AS width, CASE WHEN k % 5 = 0 THEN 'validation' ELSE 'train' END AS side FROM (SELECT *, least(greatest(n * 10 + 1, 48), 2048) AS c FROM cd)),
bt AS (SELECT *, (row_number() OVER (PARTITION BY side, CASE WHEN side = 'validation' THEN width END ORDER BY seq) - 1) // 32 AS batch_no FROM wd)"""


@query("q2_prepare_training", f"{_Q2} SELECT seq, side, CAST(width AS INT) AS width, CAST(batch_no AS INT) AS batch_no, CAST(n AS INT) AS label_length, CAST(max(n) OVER (PARTITION BY side, batch_no, width) AS INT) AS padded_length FROM bt")
def q2(spark, sf_dir):
    samples = fx.samples(spark, sf_dir)
    sizes = samples.select("image_path", (F.length("label_text") * 10 + 1).alias("w"), F.lit(48).alias("h"))
    return pipelines.prepare_training(samples, sizes, fx.char_dict(spark, sf_dir)).select("seq", "side", "width", "batch_no", "label_length", F.size("padded").alias("padded_length"))


_TAPS = "SELECT d, s, w / sum(w) OVER (PARTITION BY d) AS k FROM (SELECT d, s, greatest(1 - abs(s - ((d + 0.5::DOUBLE) * ({src} / {dst}.0::DOUBLE) - 0.5)), 0.0) AS w FROM range({dst}) AS t(d), range({src}) AS u(s)) WHERE w > 0"
_Q2_PX = f"""{fx.PIXELS}, {_AUG}, aug AS (SELECT a3.image_id, a3.y, a3.x, CAST(coalesce(bl.r, a3.r) AS INT) AS r, CAST(coalesce(bl.g, a3.g) AS INT) AS g, CAST(coalesce(bl.b, a3.b) AS INT) AS b FROM a3 LEFT JOIN bl ON bl.image_id = a3.image_id AND bl.y = a3.y AND bl.x = a3.x),
sm AS (SELECT s_suppkey AS image_id, length(s_name) AS n, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier),
sd AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'validation' ELSE 'train' END AS side FROM sm), bn AS (SELECT *, CAST((row_number() OVER (PARTITION BY side ORDER BY image_id) - 1) // 32 AS INT) AS batch_no FROM sd),
src AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM (SELECT px.* FROM px JOIN bn USING (image_id) WHERE side = 'validation' UNION ALL BY NAME SELECT aug.* FROM aug JOIN bn USING (image_id) WHERE side = 'train')),
tx AS ({_TAPS.format(src=24, dst=72)}), ty AS ({_TAPS.format(src=16, dst=48)}),
r1 AS (SELECT image_id, c, y, d AS x, sum(v * k) AS v FROM src JOIN tx ON tx.s = src.x GROUP BY image_id, c, y, d),
r2 AS (SELECT image_id, c, d AS y, x, sum(v * k) AS v FROM r1 JOIN ty ON ty.s = r1.y GROUP BY image_id, c, d, x),
te AS (SELECT image_id, c, y, x, CAST((v / 255.0 - 0.5) / 0.5 AS FLOAT)::DOUBLE AS v FROM r2 UNION ALL SELECT s_suppkey, c, y, x, 1.0 FROM supplier, range(3) AS a(c), range(48) AS b(y), range(72, 96) AS e(x)),
su AS (SELECT image_id, sum(v) AS total, sum(v * (c * 7 + y * 3 + x)) AS placed FROM te GROUP BY image_id)"""


@query("q2_training_tensors", f"WITH {_Q2_PX} SELECT side, batch_no, 96 AS width, CAST(count(*) AS INT) AS n, CAST(sum(n) AS BIGINT) AS label_chars, CAST(max(n) * count(*) AS BIGINT) AS padded_chars, round(sum(total), 3) AS total, round(sum(placed), 1) AS placed FROM bn JOIN su USING (image_id) GROUP BY side, batch_no")
def q2_tensors(spark, sf_dir):
    """Images of suppliers with their names as labels: sums over the tensors of each batch, plain and by place."""
    samples = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("seq"), F.concat("s_suppkey", F.lit(".bmp")).alias("image_path"), F.col("s_name").alias("label_text"))
    chars = samples.select(F.explode(F.array_distinct(F.split("label_text", ""))).alias("ch")).filter("ch <> ''").distinct().withColumn("idx", F.row_number().over(W.orderBy("ch")))
    images = _rasters(spark, sf_dir).withColumn("image_path", F.concat("image_id", F.lit(".bmp")))
    packed = pipelines.training_tensors(samples, images, chars, pack_bytes=200_000)

    def sums(batches):
        for b in batches:
            for r in rasters.rows_of(b):
                v = np.frombuffer(r["tensor"], "<f4").reshape(r["shape"]).astype(float)
                c, y, x = np.mgrid[0 : v.shape[1], 0 : v.shape[2], 0 : v.shape[3]]
                yield rasters.batch_of(kinds, [(r["side"], r["batch_no"], r["width"], len(r["seqs"]), sum(r["label_lengths"]), len(r["padded"]), float(v.sum()), float((v * (c * 7 + y * 3 + x)).sum()))])

    kinds = "side string, batch_no int, width int, n long, label_chars long, padded_chars long, total double, placed double"
    parts = packed.mapInArrow(sums, kinds).groupBy("side", "batch_no", "width")
    return parts.agg(F.sum("n").cast("int").alias("n"), F.sum("label_chars").alias("label_chars"), F.sum("padded_chars").alias("padded_chars"), F.round(F.sum("total"), 3).alias("total"), F.round(F.sum("placed"), 1).alias("placed"))


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of suppliers: found without a model, read by the nearest of templates that the pages give."""
    images = _rasters(spark, sf_dir)
    features = pipelines.template_features(images, 8, 8).select(F.col("image_id").alias("sample_id"), (F.col("image_id") % 5).cast("string").alias("label"), "feature")
    read = pipelines.raster_template_recognizer(checkpointed(recognition.train_templates(features)), 8, 8)
    return pipelines.recognize_rasters(images, read, 128, box_threshold=0.3, min_area=1.0)[1]


QUERIES["q1_recognize_pages"] = q1


def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that workers set up once: it reads upper case, and not every page."""
    def load():
        def fn(pdf):
            if (pdf["page_id"].to_numpy() % 1301 == 5).any():
                raise ValueError("unreadable")
            return {"text": [None if x is None else x.upper() for x in pdf["text"]], "confidence": pdf["rec_conf"]}

        return fn

    d = fx.regions(spark, sf_dir).select("page_id", "seq", "text", "rec_conf")
    return pipelines.apply_recognizer(d, Model("upper", "1", load))


query("u1_apply_recognizer", f"WITH {fx.REGIONS} SELECT page_id, seq, CASE WHEN page_id % 1301 <> 5 THEN upper(text) END AS text, CASE WHEN page_id % 1301 <> 5 THEN rec_conf END AS confidence, CASE WHEN page_id % 1301 = 5 THEN 'ValueError: unreadable' END AS error FROM r")(u1)
@query("u2_apply_detector", f"{_PX}, m AS (SELECT image_id, arg_max({{'x': x, 'y': y}}, r * 100000 - y * 100 - x) AS pos, max(r) AS r FROM px GROUP BY image_id) SELECT image_id AS page_id, 0 AS seq, CAST(pos.x AS DOUBLE) AS x0, CAST(pos.y + 4 AS DOUBLE) AS y1, r / 255.0::DOUBLE AS det_conf FROM m WHERE image_id % 13 <> 6")
def u2(spark, sf_dir):
    """A box at the pixel with the most red, the first of such; some images have none."""
    def load():
        def fn(px):
            if (int(px[0, 0, 0]) - int(px[0, 1, 0])) % 256 != 249:
                raise ValueError("not as drawn")
            y, x = np.unravel_index(int(px[:, :, 0].argmax()), px.shape[:2])
            return [(x, y, 5, 4, px[y, x, 0] / 255.0)]

        return fn

    images = _rasters(spark, sf_dir).filter("image_id % 13 <> 6")
    d = pipelines.apply_detector(images, Model("reddest", "1", load))[0]
    return d.select("page_id", "seq", g.left(F.col("quad")).alias("x0"), g.bottom(F.col("quad")).alias("y1"), "det_conf")



# files of the given tables' rows, written to the shared folder and read back


def _files(spark, sf_dir):
    path = scratch(spark, "images")
    fx.image_files(spark, sf_dir, path, "true")
    return tables.read_images(spark, path)


def _name():
    return F.regexp_extract("origin", r"/(i[0-9]+\.bmp)$", 1).alias("name")


query("s1_read_images", "SELECT 'i' || s_suppkey || '.bmp' AS name, 24 AS width, 16 AS height, 3 AS n_channels FROM supplier WHERE s_suppkey % 10 <> 7")(lambda spark, sf_dir: _files(spark, sf_dir)[0].select(_name(), "width", "height", "n_channels"))
query("s1_rejects", "SELECT 'i' || s_suppkey || '.bmp' AS name, 'undecodable' AS reason FROM supplier WHERE s_suppkey % 10 = 7")(lambda spark, sf_dir: _files(spark, sf_dir)[1].select(_name(), "reason"))


@query("s2_to_pixels", f"{_PX} SELECT image_id, y, x, r, g, b FROM px WHERE image_id % 10 <> 7")
def s2(spark, sf_dir):
    images = _files(spark, sf_dir)[0]
    named = images.withColumn("image_id", F.regexp_extract("origin", r"/i([0-9]+)\.bmp$", 1).cast("long"))
    return pixels.to_pixels(named)


@query("s12_templates_as_json", f"WITH {_TM} SELECT 'model ' || label AS model_id, label, sample_count, list_transform(feature, lambda x: round(x, 9)) AS feature FROM tp")
def s12(spark, sf_dir):
    path = scratch(spark, "templates")
    tables.save_templates(_templates(spark, sf_dir).withColumn("model_id", F.concat(F.lit("model "), "label")), path)
    return tables.load_templates(spark, path).withColumn("feature", F.transform("feature", lambda x: F.round(x, 9)))


def _registry(spark, sf_dir) -> str:
    """A manifest for each supplier, and one that can't be read."""
    root, key = scratch(spark, "models"), F.col("s_suppkey")
    metrics = F.struct((key % 7).cast("long").alias("train_samples"), (key % 5).cast("long").alias("validation_samples"), (key % 100 / 100.0).alias("accuracy"), (key % 9 / 10.0).alias("avg_loss"))
    models = fx.table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("!")).alias("name"), (key * 10).cast("long").alias("created_at"), F.lit("base").alias("base_model_name"), F.lit("w").alias("weights_file"), F.lit("d").alias("dict_file"), metrics.alias("metrics"))
    tables.register_model(models, root)
    spark.range(1).select(F.lit("{no json").alias("value")).write.text(f"{root}/model_dir=bad")
    return root


_DIR = "'model_dir=' || (s_suppkey * 10) || '-' || regexp_replace(s_name, '[^A-Za-z0-9_-]', '-', 'g')"
query("s13_list_models", f"SELECT {_DIR} AS model_dir, s_name || '!' AS name, CAST(s_suppkey * 10 AS BIGINT) AS created_at, 'base' AS base_model_name, CAST(s_suppkey % 7 AS BIGINT) AS train_samples, CAST(s_suppkey % 5 AS BIGINT) AS validation_samples, s_suppkey % 100 / 100.0::DOUBLE AS accuracy, s_suppkey % 9 / 10.0::DOUBLE AS avg_loss FROM supplier")(lambda spark, sf_dir: tables.list_models(spark, _registry(spark, sf_dir)))


@query("s13_template_registry", f"WITH {_TM} SELECT m.r_regionkey || '-model-' || m.r_name AS model_dir, 'model ' || m.r_name AS name, CAST(m.r_regionkey AS BIGINT) AS created_at, CAST((SELECT count(*) FROM tp) - m.r_regionkey AS INT) AS template_count, 32 AS input_width, 24 AS input_height, m.r_regionkey / 8.0::DOUBLE AS accuracy, 0.5::DOUBLE AS avg_loss FROM (SELECT r_regionkey, replace(r_name, ' ', '-') AS r_name FROM region) m")
def s13_templates(spark, sf_dir):
    """Template models of several sizes, beside recognizer manifests and a file that can't be read."""
    root = _registry(spark, sf_dir)
    ranked = _templates(spark, sf_dir).withColumn("k", F.row_number().over(W.orderBy("label")))
    models = fx.table(spark, sf_dir, "region").join(ranked, F.col("k") > F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.collect_list(F.struct("label", "sample_count", "feature")).alias("templates"))
    metrics = F.struct(F.lit(1).cast("long").alias("train_samples"), F.lit(1).cast("long").alias("validation_samples"), (F.col("r_regionkey") / 8.0).alias("accuracy"), F.lit(0.5).alias("avg_loss"))
    tables.save_template_models(models.select(F.concat(F.lit("model "), F.translate("r_name", " ", "-")).alias("name"), F.col("r_regionkey").cast("long").alias("created_at"), F.lit(32).alias("input_width"), F.lit(24).alias("input_height"), F.lit(0.4).alias("similarity_threshold"), "templates", metrics.alias("metrics")), root)
    return tables.list_template_models(spark, root)


@query("s14_register_model", f"SELECT {_DIR} AS model_dir, 1 AS manifests FROM supplier")
def s14(spark, sf_dir):
    files = tables.files_below(spark, _registry(spark, sf_dir)).select(F.element_at(F.split("path", "/"), -2).alias("model_dir"))
    return files.filter("model_dir <> 'model_dir=bad'").groupBy("model_dir").agg(F.count(F.lit(1)).cast("int").alias("manifests"))


def _intake(spark, sf_dir) -> str:
    """Half of the files are there when the stream starts; the others, and some of the first again under another name,
    come before it is started again."""
    path, out, state = (scratch(spark, kind) for kind in ("arriving", "read", "state"))
    sums = lambda px: px.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "rgb"])
    for wave in ([("id % 2 = 0", "i")], [("id % 2 = 1", "i"), ("id % 4 = 0", "again")]):
        for keep, prefix in wave:
            fx.image_files(spark, sf_dir, path, keep, prefix)
        streams.stream_pages(spark, path, out, state, sums, availableNow=True).awaitTermination()
    return out


# images are alike whose numbers differ by 256
query("x1_stream_pages", f"{_PX} SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM px WHERE image_id IN (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 10 <> 7 GROUP BY s_suppkey % 256) GROUP BY image_id")(lambda spark, sf_dir: spark.read.parquet(f"{_intake(spark, sf_dir)}/pages").select("n", "r", "g", "b"))
query("x1_quarantine", "SELECT 'i' || s_suppkey || '.bmp' AS name, 'undecodable' AS reason FROM supplier WHERE s_suppkey % 10 = 7")(lambda spark, sf_dir: spark.read.parquet(f"{_intake(spark, sf_dir)}/quarantine").select(F.element_at(F.split("origin", "/"), -1).alias("name"), "reason"))


def _progress_stream(spark, sf_dir) -> str:
    path, out, state = (scratch(spark, kind) for kind in ("progress", "metrics", "state"))
    d = fx.progress(spark, sf_dir).select("run", "epoch", "batch", F.lit(1).alias("total_batches"), "loss", F.col("correct").cast("double").alias("accuracy"))
    both = d.unionByName(d.withColumn("run", F.lit("run4")))
    both.repartition(3).write.parquet(path)
    source = spark.readStream.schema(streams.PROGRESS).option("maxFilesPerTrigger", 1).parquet(path)
    measured = _measured(spark, sf_dir).withColumn("accuracy", F.when(F.col("run") == "run4", 2.0).otherwise(F.col("accuracy")))
    for q in streams.stream_progress(source, out, state, measured, availableNow=True):
        q.awaitTermination()
    return out


@query("x2_stream_best", f"{_PG} SELECT * FROM (SELECT run, epoch, batch AS at_batch, loss, CAST(correct AS DOUBLE) AS accuracy FROM progress ORDER BY accuracy DESC, loss, epoch DESC, batch DESC LIMIT 1) UNION ALL SELECT 'run4', 0, 0, CAST('inf' AS DOUBLE), 2.0")
def x2_best(spark, sf_dir):
    """The best event of two runs; one begins with more than any event has, and stays there."""
    d = streams.latest(spark, f"{_progress_stream(spark, sf_dir)}/best", ["run"])
    return d.select("run", "epoch", "at_batch", "loss", "accuracy")


@query("x2_stream_progress", f"{_PG} SELECT run, epoch, round(sum(loss), 4) AS total_loss, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS batches FROM progress GROUP BY run, epoch")
def x2(spark, sf_dir):
    """The same metrics from a stream of files, one at a time."""
    out = _progress_stream(spark, sf_dir)
    return streams.latest(spark, f"{out}/epochs", ["run", "epoch"]).filter("run = 'run'").select("run", "epoch", F.round(F.col("loss") * F.col("batches"), 4).alias("total_loss"), "accuracy", "batches")
