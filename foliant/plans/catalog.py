"""Named queries, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry, hashing, sequence, text
from foliant.operators import detection, evaluate, export, folds, matching, pages, reading_order, recognition
from foliant.plans import fixtures as fx
from foliant.sources import session as snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GAP = 6 * 3600
DEDUP_BITS = 20
#: Fixed values of the stand-in.
CHARSET = " !\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- sampling and evaluation --------------------------------------------------------------------


@query(f"""WITH {fx.FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS idx FROM frames)
SELECT session, event_id, idx::BIGINT AS idx FROM n WHERE idx % 15 = 0""")
def sample_every_kth(spark, sf):
    idx = F.row_number().over(W.partitionBy("session").orderBy("ts", "event_id")) - 1
    numbered = fx.frames(spark, sf).select("session", "event_id", idx.cast("long").alias("idx"))
    return evaluate.every_kth(numbered, "idx", 30.0, 0.5)


@query(f"""WITH RECURSIVE {fx.FRAMES}, n AS (
  SELECT session, event_id, ts, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i FROM frames
), walk AS (
  SELECT session, event_id, ts, i, true AS taken, ts AS last FROM n WHERE i = 1
  UNION ALL
  SELECT n.session, n.event_id, n.ts, n.i, n.ts >= w.last + INTERVAL {GAP} SECOND, CASE WHEN n.ts >= w.last + INTERVAL {GAP} SECOND THEN n.ts ELSE w.last END
  FROM walk w JOIN n ON n.session = w.session AND n.i = w.i + 1
)
SELECT session, event_id, ts, row_number() OVER (PARTITION BY session ORDER BY i)::INTEGER AS ordinal FROM walk WHERE taken""")
def sample_min_gap(spark, sf):
    return folds.gap_sample(fx.frames(spark, sf), ["session"], "ts", GAP, ["event_id"], ["event_id"]).select("session", "event_id", "ts", "ordinal")


@query(f"""WITH {fx.FRAMES} SELECT session, count(*) AS total, count(*) FILTER (detected) AS found,
  round(count(*) FILTER (detected) * 100.0::DOUBLE / count(*), 6) AS rate, count(*) FILTER (detected) AS pages,
  round(avg(round_even(event_id % 97 / 4.0::DOUBLE, 1)), 6) AS mean_detect_ms, round(avg(round_even(sharpness, 1)), 6) AS mean_sharpness
FROM frames GROUP BY session""")
def detection_summary(spark, sf):
    f = fx.frames(spark, sf).withColumn("detect_ms", F.col("event_id") % 97 / F.lit(4.0))
    out = evaluate.summary(f, ["session"])
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "mean_detect_ms", "mean_sharpness")})


@query(f"""WITH {fx.FRAMES} SELECT session, event_id, detected,
  CASE WHEN detected THEN (sum(detected::INTEGER) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT END AS page,
  CASE WHEN detected THEN printf('page-%03d.jpg', (sum(detected::INTEGER) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT) END AS output
FROM frames""")
def running_page_number(spark, sf):
    out = evaluate.running_pages(fx.frames(spark, sf), ["session"], ["ts", "event_id"])
    return out.select("session", "event_id", "detected", "page", F.when(F.col("page").isNotNull(), evaluate.frame_name(F.col("page"))).alias("output"))


@query(f"""WITH {fx.FRAMES}, p AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY session) AS n FROM frames)
SELECT session, event_id, floor(i * 1.0::DOUBLE / n * 100 + 0.5)::BIGINT AS percent,
  round(0.02 + i * 1.0::DOUBLE / n * 0.73, 6) AS loading, round(0.1 + i * 1.0::DOUBLE / n * 0.3, 6) AS layout, round(0.4 + i * 1.0::DOUBLE / n * 0.4, 6) AS recognition FROM p""")
def stage_progress(spark, sf):
    by = W.partitionBy("session")
    p = fx.frames(spark, sf).select("session", "event_id", F.row_number().over(by.orderBy("ts", "event_id")).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    part = F.col("i").cast("double") / F.col("n")
    stage = lambda s: F.round(evaluate.stage_progress(F.lit(s), part, F.col("i"), F.col("n")), 6).alias(s)
    return p.select("session", "event_id", evaluate.progress(F.col("i").cast("double"), F.col("n")).alias("percent"), stage("loading"), stage("layout"), stage("recognition"))


@query(f"""WITH {fx.FRAMES}, s AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'idle' WHEN 1 THEN 'loading' WHEN 2 THEN 'scanning' WHEN 3 THEN 'done' ELSE 'error' END AS state FROM frames),
p AS (SELECT session, event_id, state, lag(state) OVER (PARTITION BY session ORDER BY ts, event_id) AS previous FROM s)
SELECT session, event_id, state, previous, previous IS NULL OR (previous || '>' || state) IN
  ('idle>loading', 'idle>scanning', 'idle>error', 'loading>scanning', 'loading>error', 'loading>idle', 'scanning>done', 'scanning>error', 'scanning>idle',
   'done>loading', 'done>scanning', 'done>idle', 'error>loading', 'error>scanning', 'error>idle') AS valid FROM p""")
def state_transitions(spark, sf):
    names = F.array(*[F.lit(s) for s in ("idle", "loading", "scanning", "done", "error")])
    f = fx.frames(spark, sf).withColumn("state", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")))
    return evaluate.transitions(f, ["session"], ["ts", "event_id"], "state").select("session", "event_id", "state", "previous", "valid")


@query(f"""WITH {fx.FRAMES}, p AS (SELECT *, lag(sharpness) OVER (PARTITION BY session ORDER BY event_id) AS b FROM frames),
s AS (SELECT *, CASE WHEN b IS NULL THEN 'unknown' WHEN abs(sharpness - b) <= 20 THEN 'stable' ELSE 'moving' END AS state FROM p),
r AS (SELECT *, sum((state <> 'stable')::INTEGER) OVER (PARTITION BY session ORDER BY event_id) AS run FROM s)
SELECT session, run::BIGINT AS run, event_id, sharpness FROM r WHERE state = 'stable'
QUALIFY row_number() OVER (PARTITION BY session, run ORDER BY sharpness DESC, event_id) = 1""")
def best_stable_frame(spark, sf):
    s = evaluate.stability(fx.frames(spark, sf), ["session"], "event_id", "sharpness", 20.0)
    return evaluate.best_stable(s, ["session"], "event_id", "sharpness")


# -- geometry -------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 400000 * 0.15 AND 400000 * 0.97
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def area_gate_largest(spark, sf):
    return matching.largest_within(fx.table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", F.lit(400000.0))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 100 AS cx, p_partkey % 70 AS cy, 10 + p_size AS w, p_retailprice / 50 AS h, radians(p_partkey % 180) AS a FROM part),
k AS (SELECT p_partkey, i, cx + cos(a) * w * (sx / 2) - sin(a) * h * (sy / 2) AS x, cy + sin(a) * w * (sx / 2) + cos(a) * h * (sy / 2) AS y
  FROM r, (VALUES (0, -1.0::DOUBLE, -1.0::DOUBLE), (1, 1.0, -1.0), (2, 1.0, 1.0), (3, -1.0, 1.0)) s(i, sx, sy))
SELECT p_partkey, corner, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM (
  SELECT p_partkey, 'tl' AS corner, x, y, row_number() OVER (PARTITION BY p_partkey ORDER BY x + y, i) AS n FROM k
  UNION ALL SELECT p_partkey, 'br', x, y, row_number() OVER (PARTITION BY p_partkey ORDER BY x + y DESC, i) FROM k
  UNION ALL SELECT p_partkey, 'tr', x, y, row_number() OVER (PARTITION BY p_partkey ORDER BY y - x, i) FROM k
  UNION ALL SELECT p_partkey, 'bl', x, y, row_number() OVER (PARTITION BY p_partkey ORDER BY y - x DESC, i) FROM k) WHERE n = 1""")
def quad_corners(spark, sf):
    p = fx.table(spark, sf, "part")
    pts = geometry.rotated_corners(F.col("p_partkey") % 100, F.col("p_partkey") % 70, F.col("p_size") + 10, F.col("p_retailprice") / 50, F.col("p_partkey") % 180)
    q = p.select("p_partkey", pts.alias("pts")).select("p_partkey", geometry.ordered_quad(F.col("pts")).alias("q"))
    rows = F.array(*[F.struct(F.lit(k).alias("corner"), F.col(f"q.{k}.x").alias("x"), F.col(f"q.{k}.y").alias("y")) for k in ("tl", "tr", "br", "bl")])
    return q.select("p_partkey", F.explode(rows).alias("c")).select("p_partkey", "c.corner", (F.round("c.x", 6) + 0.0).alias("x"), (F.round("c.y", 6) + 0.0).alias("y"))


@query("""WITH r AS (SELECT p_partkey, 10.0::DOUBLE + p_size AS w, p_retailprice / 50 AS h, radians(p_partkey % 180) AS a FROM part)
SELECT p_partkey, round(w * h, 4) AS area, w * h >= 5000 * 0.10 AS valid FROM r""")
def quad_validity(spark, sf):
    p = fx.table(spark, sf, "part")
    pts = geometry.rotated_corners(F.col("p_partkey") % 100, F.col("p_partkey") % 70, F.col("p_size") + 10, F.col("p_retailprice") / 50, F.col("p_partkey") % 180)
    q = p.select("p_partkey", pts.alias("pts"))
    return q.select("p_partkey", F.round(geometry.shoelace(F.col("pts")), 4).alias("area"), geometry.quad_valid(F.col("pts"), F.lit(5000.0)).alias("valid"))


@query("""WITH d AS (SELECT p_partkey, 100.0::DOUBLE + p_size * 7 AS w, p_retailprice - 600 AS h FROM part),
f AS (SELECT p_partkey, CASE WHEN w / h > 210.0::DOUBLE / 297 THEN 210.0::DOUBLE ELSE 297 * (w / h) END AS fw, CASE WHEN w / h > 210.0::DOUBLE / 297 THEN 210 / (w / h) ELSE 297.0::DOUBLE END AS fh FROM d)
SELECT p_partkey, round(fw, 6) AS w, round(fh, 6) AS h, round((210 - fw) / 2, 6) AS x, round((297 - fh) / 2, 6) AS y FROM f""")
def pdf_contain_fit(spark, sf):
    p = fx.table(spark, sf, "part")
    fit = geometry.contain_fit(F.col("p_size") * 7 + 100.0, F.col("p_retailprice") - 600, *export.SIZES["A4"])
    return p.select("p_partkey", fit.alias("f")).select("p_partkey", *[F.round(f"f.{k}", 6).alias(k) for k in ("w", "h", "x", "y")])


# -- hashes -----------------------------------------------------------------------------------------


@query(f"WITH {fx.HASHES} SELECT vec_id, bits FROM hashes")
def average_hash(spark, sf):
    return fx.hashes(spark, sf).select("vec_id", hashing.bit_string(F.col("bits")).alias("bits"))


@query(f"""WITH {fx.HASHES}, p AS (SELECT a.label, a.vec_id, b.vec_id AS nearest_seq, hamming(a.bits, b.bits)::INTEGER AS distance
  FROM hashes a JOIN hashes b ON a.label = b.label AND b.vec_id < a.vec_id)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest_seq) = 1""")
def nearest_hash(spark, sf):
    return matching.earlier_distances(fx.hashes(spark, sf), ["label"], "vec_id", "words")


_DEDUP = f"""WITH RECURSIVE {fx.HASHES}, n AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM hashes
), walk AS (
  SELECT label, vec_id, i, [bits] AS kept, [vec_id] AS ids, NULL::BIGINT AS nearest_id, NULL::INTEGER AS distance, false AS is_duplicate FROM n WHERE i = 1
  UNION ALL
  SELECT label, vec_id, i, CASE WHEN d <= {DEDUP_BITS} THEN kept ELSE list_append(kept, bits) END, CASE WHEN d <= {DEDUP_BITS} THEN ids ELSE list_append(ids, vec_id) END,
    ids[list_position(ds, d)], d::INTEGER, d <= {DEDUP_BITS}
  FROM (SELECT *, list_min(ds) AS d FROM (
    SELECT n.*, w.kept, w.ids, list_transform(w.kept, lambda k: hamming(k, n.bits)) AS ds FROM walk w JOIN n ON n.label = w.label AND n.i = w.i + 1))
)"""


@query(_DEDUP + " SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY i)::INTEGER AS page_no FROM walk WHERE NOT is_duplicate")
def greedy_dedup(spark, sf):
    out = folds.greedy_dedup(fx.hashes(spark, sf), ["label"], [F.col("vec_id")], "words", DEDUP_BITS, ["vec_id"])
    return out.select("label", "vec_id", F.col("ordinal").alias("page_no"))


@query(_DEDUP + " SELECT label, vec_id, nearest_id, distance, is_duplicate FROM walk")
def duplicate_decisions(spark, sf):
    return folds.nearest_kept(fx.hashes(spark, sf), ["label"], [F.col("vec_id")], "words", "vec_id", DEDUP_BITS)


# -- detection ----------------------------------------------------------------------------------------


@query(f"""WITH {fx.BOXES}, raw AS (SELECT page, rid, x * 11.0::DOUBLE AS x1, y * 17.0::DOUBLE AS y1, (x + width) * 11.0::DOUBLE AS x2, (y + height) * 17.0::DOUBLE AS y2,
    conf / 100.0::DOUBLE AS score, (rid % 8 + 1)::INTEGER AS class_id, 640 AS img_w, 900 + page % 200 AS img_h FROM boxes),
s AS (SELECT page, rid, class_id, img_w, img_h, greatest(img_w, img_h)::DOUBLE / 800 AS k, x1, y1, x2, y2, CASE WHEN class_id = 1 THEN 'block' WHEN class_id - 1 IN (1, 2, 3, 4, 5, 16) THEN 'line' END AS kind
  FROM raw WHERE NOT (score < 0.3)),
d AS (SELECT *, CASE WHEN kind = 'line' THEN (y2 * k - y1 * k) * 0.02 ELSE 0 END AS m FROM s WHERE kind IS NOT NULL),
b AS (SELECT page, rid, kind, greatest(0, floor(x1 * k + 0.5)::BIGINT) AS x, greatest(0, floor(y1 * k - m + 0.5)::BIGINT) AS y,
  least(img_w, floor(x2 * k + 0.5)::BIGINT) AS r, least(img_h, floor(y2 * k + m + 0.5)::BIGINT) AS l FROM d)
SELECT page, rid, kind, x::BIGINT AS x, y::BIGINT AS y, (r - x)::BIGINT AS box_w, (l - y)::BIGINT AS box_h FROM b WHERE r - x >= 10 AND l - y >= 10""")
def box_rescale_clip(spark, sf):
    raw = fx.boxes(spark, sf).select(
        "page", "rid", (F.col("x") * 11.0).alias("x1"), (F.col("y") * 17.0).alias("y1"), ((F.col("x") + F.col("width")) * 11.0).alias("x2"), ((F.col("y") + F.col("height")) * 17.0).alias("y2"),
        (F.col("conf") / 100.0).alias("score"), (F.col("rid") % 8 + 1).alias("class_id"), F.lit(640).alias("img_w"), (F.col("page") % 200 + 900).alias("img_h"),
    )
    return detection.boxes(raw).select("page", "rid", "kind", "x", "y", "box_w", "box_h")


@query(f"""WITH RECURSIVE {fx.BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY conf DESC, rid) AS i FROM boxes),
walk AS (
  SELECT page, rid, i, true AS keep, [{{'x': x, 'y': y, 'w': width, 'h': height}}] AS kept FROM n WHERE i = 1
  UNION ALL
  SELECT page, rid, i, keep, CASE WHEN keep THEN list_append(kept, {{'x': x, 'y': y, 'w': width, 'h': height}}) ELSE kept END FROM (
    SELECT n.page, n.rid, n.i, n.x, n.y, n.width, n.height, w.kept, len(list_filter(w.kept, lambda k:
      greatest(0, least(k.x + k.w, n.x + n.width) - greatest(k.x, n.x)) * greatest(0, least(k.y + k.h, n.y + n.height) - greatest(k.y, n.y))
      >= 0.5 * (k.w * k.h + n.width * n.height - greatest(0, least(k.x + k.w, n.x + n.width) - greatest(k.x, n.x)) * greatest(0, least(k.y + k.h, n.y + n.height) - greatest(k.y, n.y))))) = 0 AS keep
    FROM walk w JOIN n ON n.page = w.page AND n.i = w.i + 1)
)
SELECT page, rid, row_number() OVER (PARTITION BY page ORDER BY i)::INTEGER AS ordinal FROM walk WHERE keep""")
def greedy_nms(spark, sf):
    return folds.greedy_nms(fx.boxes(spark, sf), ["page"], "conf", ["rid"], 0.5, ["rid"]).select("page", "rid", "ordinal")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 4 WHEN 3 THEN 'recognition30' WHEN 2 THEN 'recognition50' ELSE 'recognition100' END AS model FROM lineitem""")
def model_cascade(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return fx.table(spark, sf, "lineitem").select(*keys, text.recogniser(F.col("l_linenumber") % 4).alias("model"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ja' ELSE lang END AS lang, doc_id % 2 = 1 AS math,
    CASE doc_id % 4 WHEN 0 THEN 'layout' WHEN 1 THEN 'recognition30' WHEN 2 THEN 'recognitionEuropean' ELSE 'mathEncoder' END AS model FROM documents),
r AS (SELECT *, CASE WHEN lang = 'ja' THEN 'ja' ELSE 'european' END AS language FROM d)
SELECT doc_id, language, CASE WHEN language <> 'ja' THEN language || ':' || model ELSE model END AS cache_key,
  CASE WHEN model = 'layout' THEN '/models/ocr/deim-s-1024x1024.onnx' WHEN model = 'recognition30' AND language = 'ja' THEN '/models/ocr/parseq-ndl-30.onnx'
    WHEN model = 'recognitionEuropean' AND language = 'european' THEN '/models/ocr/parseq-multilingual.onnx' WHEN model = 'mathEncoder' AND math THEN '/models/ocr/mfr-encoder.onnx' END AS url FROM r""")
def language_route(spark, sf):
    models = F.array(*[F.lit(m) for m in ("layout", "recognition30", "recognitionEuropean", "mathEncoder")])
    d = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "ja").otherwise(F.col("lang")).alias("lang"), F.element_at(models, (F.col("doc_id") % 4 + 1).cast("int")).alias("model"))
    d = d.withColumn("language", text.recognition_language(F.col("lang")))
    return d.select("doc_id", "language", text.cache_key(F.col("language"), F.col("model")).alias("cache_key"), text.model_url(F.col("model"), F.col("language"), F.col("doc_id") % 2 == 1).alias("url"))


# -- recognition -----------------------------------------------------------------------------------------


@query("""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS class_id,
  round(1 / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS probability FROM embeddings""")
def softmax_top1(spark, sf):
    v = fx.table(spark, sf, "embeddings")
    return v.select("vec_id", sequence.argmax(F.col("embedding")).alias("class_id"), F.round(sequence.top_probability(F.col("embedding")), 6).alias("probability"))


_VOCAB = 61


@query(f"""WITH c AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda ch: (unicode(ch) * 7) % {_VOCAB})) AS id, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
s AS (SELECT doc_id, min(i) FILTER (id = 0) AS stop FROM c GROUP BY doc_id),
e AS (SELECT c.doc_id, i, c.id - 1 AS id, 1 / (1 + c.id::DOUBLE) AS p FROM c JOIN s ON c.doc_id = s.doc_id WHERE i < coalesce(stop, 1000000000) AND c.id >= 4 AND c.id - 1 < {len(CHARSET)}),
k AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM e),
f AS (SELECT doc_id, string_agg(substr($${CHARSET}$$, id + 1, 1), '' ORDER BY i) AS t, avg(p) AS conf FROM k WHERE b IS NULL OR b <> id GROUP BY doc_id)
SELECT d.doc_id, coalesce(regexp_replace(t, '^ +| +$', '', 'g'), '') AS decoded, coalesce(round(conf, 6), 0) AS confidence FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def token_decode(spark, sf):
    ids = F.transform(F.split("text", ""), lambda ch: (F.ascii(ch) * 7 % _VOCAB).cast("int"))
    d = fx.table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    tokens = d.withColumn("p", F.transform("ids", lambda i: F.lit(1.0) / (i + F.lit(1.0))))
    d = recognition.decode(tokens, "ids", "p", CHARSET)
    return d.select("doc_id", text.unicode_trim(F.col("decoded")).alias("decoded"), F.round("confidence", 6).alias("confidence"))


# -- reading order ------------------------------------------------------------------------------------------

_ASSIGN = f"""WITH {fx.BOXES}, {fx.BLOCKS_SQL}, a AS (
  SELECT page, rid, x, y, width, height, min(block_id) AS block_id FROM boxes LEFT JOIN blocks
  ON x + width / 2.0 BETWEEN bx AND bx + bw AND y + height / 2.0 BETWEEN b_y AND b_y + bh GROUP BY ALL)"""


def _assigned(spark, sf):
    b = fx.boxes(spark, sf)
    return matching.assign_blocks(b, fx.blocks(spark, b), "page", "rid", "block_id")


@query(_ASSIGN + " SELECT page, rid, block_id FROM a")
def line_block_assign(spark, sf):
    return _assigned(spark, sf).select("page", "rid", "block_id")


@query(_ASSIGN + " SELECT page, count(block_id) AS assigned, count(*) AS total, count(block_id) < 0.7 * count(*) AS falls_back FROM a GROUP BY page")
def coverage_fallback(spark, sf):
    return matching.coverage(_assigned(spark, sf), "page", "block_id")


@query(_ASSIGN + " SELECT page, block_id, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM a WHERE block_id IS NOT NULL GROUP BY page, block_id")
def group_extent(spark, sf):
    return matching.group_extents(_assigned(spark, sf), "page", "block_id")


_GRID = f"""WITH {fx.BOXES}, e AS (SELECT *, min(x) OVER w AS mx, min(y) OVER w AS my, (max(x + width) OVER w - min(x) OVER w)::DOUBLE AS pw, (max(y + height) OVER w - min(y) OVER w)::DOUBLE AS ph FROM boxes WINDOW w AS (PARTITION BY page)),
s AS (SELECT *, CASE WHEN ph >= pw THEN 100 * (pw / ph) ELSE 100.0::DOUBLE END AS sx, CASE WHEN ph >= pw THEN 100.0::DOUBLE ELSE 100 * (ph / pw) END AS sy FROM e),
g AS (SELECT page, rid, (ceil(sx) + 1)::INTEGER AS grid_w, (ceil(sy) + 1)::INTEGER AS grid_h, greatest(0, floor((x - mx) * sx / pw))::INTEGER AS gx0, greatest(0, floor((y - my) * sy / ph))::INTEGER AS gy0,
  ceil((x + width - mx) * sx / pw)::INTEGER AS rx, ceil((y + height - my) * sy / ph)::INTEGER AS ry FROM s),
grid AS (SELECT page, rid, gx0, gy0, greatest(gx0 + 1, least(grid_w - 1, rx))::INTEGER AS gx1, greatest(gy0 + 1, least(grid_h - 1, ry))::INTEGER AS gy1, grid_w, grid_h FROM g)"""


@query(_GRID + " SELECT page, rid, gx0, gy0, gx1, gy1, grid_w, grid_h FROM grid")
def grid_normalise(spark, sf):
    return reading_order.page_grid(fx.boxes(spark, sf), "page").select("page", "rid", "gx0", "gy0", "gx1", "gy1", "grid_w", "grid_h")


_HIST = _GRID + """, cells AS (SELECT DISTINCT page, grid_w, cx, cy FROM (SELECT page, grid_w, gy0, gy1, unnest(range(gx0, gx1)) AS cx FROM grid), LATERAL (SELECT unnest(range(gy0, gy1)) AS cy)),
h AS (SELECT page, grid_w, cx, count(*) AS n FROM cells WHERE cx < grid_w GROUP BY ALL),
hist AS (SELECT p.page, p.cx, coalesce(h.n, 0)::INTEGER AS n FROM (SELECT page, unnest(range(0, grid_w)) AS cx FROM (SELECT DISTINCT page, grid_w FROM grid)) p LEFT JOIN h ON p.page = h.page AND p.cx = h.cx)"""


@query(_HIST + " SELECT page, string_agg(n::VARCHAR, ',' ORDER BY cx) AS hist FROM hist GROUP BY page")
def projection_histogram(spark, sf):
    h = reading_order.column_histogram(reading_order.page_grid(fx.boxes(spark, sf), "page"), "page")
    return h.select("page", F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist"))


@query(_HIST + """, m AS (SELECT page, min(n) AS low, max(n) AS high FROM hist GROUP BY page),
i AS (SELECT hist.page, cx, cx - row_number() OVER (PARTITION BY hist.page ORDER BY cx) AS island, low, high FROM hist JOIN m ON hist.page = m.page WHERE n = low),
r AS (SELECT page, min(cx) AS s, max(cx) + 1 AS e, any_value(low) AS low, any_value(high) AS high FROM i GROUP BY page, island)
SELECT page, s::INTEGER AS run_start, e::INTEGER AS run_end, round(CASE WHEN high > 0 THEN -low / high::DOUBLE ELSE 0 END, 6) + 0.0 AS score FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY e - s DESC, s) = 1""")
def longest_min_run(spark, sf):
    counts = reading_order.column_counts(reading_order.page_grid(fx.boxes(spark, sf), "page"), "page")
    r = reading_order.longest_minimum_run(counts, "page")
    return r.select("page", F.col("start").alias("run_start"), F.col("end").alias("run_end"), (F.round("score", 6) + 0.0).alias("score"))


@query(_GRID + """, v AS (SELECT *, count(*) OVER (PARTITION BY page) < 2 * count(*) FILTER (gx1 - gx0 < gy1 - gy0) OVER (PARTITION BY page) AS vertical FROM grid)
SELECT page, rid, vertical, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN vertical THEN -gx0 ELSE gy0 END, CASE WHEN vertical THEN gy0 ELSE gx0 END, rid)::INTEGER AS leaf_order FROM v""")
def orientation_leaf_order(spark, sf):
    g = reading_order.page_grid(fx.boxes(spark, sf), "page")
    by = W.partitionBy("page")
    g = g.withColumn("vertical", F.count(F.lit(1)).over(by) < 2 * F.count_if(F.col("gx1") - F.col("gx0") < F.col("gy1") - F.col("gy0")).over(by))
    keys = [F.when(F.col("vertical"), -F.col("gx0")).otherwise(F.col("gy0")), F.when(F.col("vertical"), F.col("gy0")).otherwise(F.col("gx0")), F.col("rid")]
    return g.select("page", "rid", "vertical", F.row_number().over(by.orderBy(*keys)).alias("leaf_order"))


@query()
def reading_order_lines(spark, sf):
    return reading_order.reading_order(fx.boxes(spark, sf), "page", "rid")


@query()
def reading_order_blocks(spark, sf):
    b = fx.boxes(spark, sf)
    return reading_order.reading_order(b, "page", "rid", fx.blocks(spark, b))


# -- pages ----------------------------------------------------------------------------------------------------


@query(f"WITH {fx.PAGES} SELECT session, string_agg(text, chr(10) ORDER BY position) AS full_text FROM plist WHERE text <> '' GROUP BY session")
def text_assembly(spark, sf):
    return pages.assemble_text(fx.pages(spark, sf), "session", "position")


@query(f"""WITH {fx.PAGES}, l AS (SELECT * FROM plist WHERE role <> 'system' AND position <> 2) SELECT session, page_id, row_number() OVER (PARTITION BY session ORDER BY position)::INTEGER AS position FROM l""")
def page_remove(spark, sf):
    p = fx.pages(spark, sf)
    return pages.remove(p, p.filter("role = 'system' OR position = 2"), "session", "page_id").select("session", "page_id", "position")


@query(f"""WITH {fx.PAGES}, k AS (SELECT *, session % 6 AS k, count(*) OVER (PARTITION BY session) AS n FROM plist)
SELECT session, page_id, CASE WHEN k > 1 AND k <= n AND position = k THEN position - 1 WHEN k > 1 AND k <= n AND position = k - 1 THEN position + 1 ELSE position END::INTEGER AS position FROM k""")
def page_swap(spark, sf):
    return pages.swap_with_previous(fx.pages(spark, sf), F.col("session") % 6).select("session", "page_id", "position")


@query(f"""WITH {fx.PAGES}, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM plist)
SELECT session, page_id, CASE WHEN session % 2 = 0 THEN n + 1 - position ELSE position END::INTEGER AS position FROM n""")
def page_reorder(spark, sf):
    p = fx.pages(spark, sf)
    ids = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("position", "page_id"))), lambda x: x["page_id"]))
    wanted = p.groupBy("session").agg(ids.alias("ids")).withColumn("ids", F.when(F.col("session") % 2 == 0, F.col("ids")).otherwise(F.slice("ids", 2, 1000)))
    return pages.reorder(p, wanted, "session", "page_id").select("session", "page_id", "position")


@query(f"""WITH {fx.PAGES} SELECT session, page_id, 0 AS single, (position - 1)::INTEGER AS split, floor((position - 1) / 3)::INTEGER AS batch FROM plist""")
def pdf_batches(spark, sf):
    key = lambda m: pages.batch_key(m, F.col("position"), 3).alias(m)
    return fx.pages(spark, sf).select("session", "page_id", key("single"), key("split"), key("batch"))


@query(f"""WITH {fx.PAGES} SELECT session, page_id, CASE WHEN position > 4 THEN 'page-limit-exceeded' END AS error FROM plist""")
def page_cap(spark, sf):
    return pages.cap(fx.pages(spark, sf), 4).select("session", "page_id", "error")


@query("""SELECT user_id AS key, ts AS updated_at, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def session_snapshot(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("updated_at"), "event_id", "value")
    return snapshots.latest(e, ["key"], ["updated_at", "event_id"])


@query("""WITH cache AS (SELECT 'european:m' || (o_custkey % 500) AS name, o_orderkey AS id, o_orderdate AS cached_at, CASE WHEN o_orderstatus = 'F' THEN 'v1' ELSE 'v2' END AS version FROM orders),
l AS (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY name ORDER BY cached_at DESC, id DESC) = 1)
SELECT c_custkey, 'european:m' || c_custkey AS name, l.id AS cached_id, l.id IS NOT NULL AS hit FROM customer LEFT JOIN l ON l.name = 'european:m' || c_custkey AND l.version = 'v2'""")
def model_cache(spark, sf):
    o = fx.table(spark, sf, "orders")
    cache = o.select(F.concat(F.lit("european:m"), F.col("o_custkey") % 500).alias("name"), F.struct("o_orderdate", "o_orderkey").alias("cached_at"), F.col("o_orderkey").alias("data"), F.when(F.col("o_orderstatus") == "F", "v1").otherwise("v2").alias("version"))
    wanted = fx.table(spark, sf, "customer").select("c_custkey", F.lit("european").alias("language"), F.concat(F.lit("m"), "c_custkey").alias("model"))
    return snapshots.cached_models(wanted, cache, "v2").select("c_custkey", "name", F.col("data").alias("cached_id"), "hit")


@query("""WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/octet-stream' END AS content_type,
  CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'x' ELSE strlen(html)::VARCHAR END AS content_length FROM pages)
SELECT page_id, coalesce(TRY_CAST(content_length AS INTEGER), 0) AS expected_length FROM r WHERE NOT coalesce(contains(lower(content_type), 'text/html'), false)""")
def html_reject(spark, sf):
    p = fx.table(spark, sf, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "application/octet-stream")
    size = F.when(F.col("page_id") % 4 == 1, "x").when(F.col("page_id") % 4 != 0, F.octet_length("html").cast("string"))
    return snapshots.fetched(p.select("page_id", kind.alias("content_type"), size.alias("content_length"))).select("page_id", "expected_length")


@query("""SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_sha256 FROM pages""")
def data_url_split(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", text.data_url(F.encode("html", "utf-8")).alias("url"))
    payload = text.data_url_payload(F.col("url"))
    return p.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"))


# -- pixels that SQL can say -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
k AS (SELECT vec_id, label, i % 8 AS x, i // 8 AS y, (i % 8 // 4 + 2 * (i // 32))::INTEGER AS corner, w FROM c WHERE w > 0.0),
a AS (SELECT vec_id, corner, sum(x * w) / sum(w) / 8 * 640 AS cx, sum(y * w) / sum(w) / 8 * 480 AS cy FROM k GROUP BY ALL)
SELECT vec_id, corner, round(cx, 6) AS cx, round(cy, 6) AS cy FROM a WHERE vec_id IN (SELECT vec_id FROM a GROUP BY vec_id HAVING count(*) = 4)""")
def heatmap_centroid(spark, sf):
    cells = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "w"))
    cells = cells.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), (F.floor(F.col("i") % 8 / 4) + 2 * F.floor(F.col("i") / 32)).cast("int").alias("corner"), F.col("w").cast("double").alias("w"))
    found = detection.mask_corners(cells, ["vec_id"], "corner", 0.0)
    return found.select("vec_id", "corner", F.round(F.col("cx") / 8 * 640, 6).alias("cx"), F.round(F.col("cy") / 8 * 480, 6).alias("cy"))


@query("""WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, v, i % 8 AS x, i // 8 AS y FROM c),
n AS (SELECT vec_id, x, y, v, dx, dy, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 7 THEN 6 ELSE x + dx END AS nx, CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 7 THEN 6 ELSE y + dy END AS ny FROM p, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dx, dy)),
l AS (SELECT n.vec_id, n.x, n.y, sum(p.v) - 4 * any_value(n.v) AS lap FROM n JOIN p ON p.vec_id = n.vec_id AND p.x = n.nx AND p.y = n.ny GROUP BY ALL)
SELECT vec_id, round(var_pop(lap), 6) AS sharpness, round(var_pop(lap), 6) >= 5 AS sharp FROM l GROUP BY vec_id""")
def laplacian_sharpness(spark, sf):
    v = fx.table(spark, sf, "embeddings").select("vec_id", F.round(evaluate.laplacian_variance(F.col("embedding"), 8, 8), 6).alias("sharpness"))
    return v.withColumn("sharp", F.col("sharpness") >= 5)


@query(f"""WITH RECURSIVE {fx.FRAMES}, {fx.HASHES}, n AS (
  SELECT session, event_id, ts, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i FROM frames
), walk AS (
  SELECT session, event_id, ts, i, true AS taken, ts AS last FROM n WHERE i = 1
  UNION ALL
  SELECT n.session, n.event_id, n.ts, n.i, n.ts >= w.last + INTERVAL {GAP} SECOND, CASE WHEN n.ts >= w.last + INTERVAL {GAP} SECOND THEN n.ts ELSE w.last END
  FROM walk w JOIN n ON n.session = w.session AND n.i = w.i + 1
), placed AS (
  SELECT bits, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS total FROM hashes
), keyed AS (
  SELECT session, event_id, bits, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i
  FROM walk JOIN placed ON place = event_id % total WHERE taken
), leaders AS (
  SELECT session, event_id, i, true AS keep, [bits] AS kept FROM keyed WHERE i = 1
  UNION ALL
  SELECT session, event_id, i, far, CASE WHEN far THEN list_append(kept, bits) ELSE kept END FROM (
    SELECT k.session, k.event_id, k.i, k.bits, l.kept, list_min(list_transform(l.kept, lambda b: hamming(b, k.bits))) > {DEDUP_BITS} AS far
    FROM leaders l JOIN keyed k ON k.session = l.session AND k.i = l.i + 1)
)
SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY i)::INTEGER AS ordinal FROM leaders WHERE keep""")
def stream_sample_dedup(spark, sf):
    """Throttled frames of each session, each with the hash of a vector, deduplicated: the batch twin of the streaming operators."""
    taken = folds.gap_sample(fx.frames(spark, sf), ["session"], "ts", GAP, ["event_id"], ["event_id"])
    h = fx.hashes(spark, sf).select("vec_id", "words")
    cell = F.floor(F.col("vec_id") / 1024)
    per = h.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    wide = F.floor(F.col("cell") / 1024)
    before = lambda over: F.coalesce(F.sum("k").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # counts run inside a wide cell of 1,024 cells, then over the wide cells: one row for about a million ids in one task
    inside = per.withColumn("wide", wide).withColumn("inside", before(W.partitionBy("wide").orderBy("cell")))
    ahead = inside.groupBy("wide").agg(F.sum("k").alias("k")).select("wide", before(W.orderBy("wide")).alias("ahead"))
    cells = inside.join(ahead, "wide").select("cell", (F.col("ahead") + F.col("inside")).alias("before"))
    placed = h.withColumn("cell", cell).withColumn("at", F.row_number().over(W.partitionBy("cell").orderBy("vec_id")) - 1)
    placed = placed.join(cells, "cell").select((F.col("before") + F.col("at")).alias("place"), "vec_id", "words")
    n = h.count()
    keyed = taken.withColumn("place", F.col("event_id") % n if n else F.lit(None).cast("long")).join(placed, "place").drop("place")
    return folds.greedy_dedup(keyed, ["session"], [F.col("ts"), F.col("event_id")], "words", DEDUP_BITS, ["event_id", "ts"]).select("session", "event_id", "ordinal")
