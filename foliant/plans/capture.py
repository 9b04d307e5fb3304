"""Named queries of the stateful, indexed and pixel operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry, pixels
from foliant.functions.hashing import bits_to_words, hash_bits
from foliant.operators import contours, hash_index, matching, page_change
from foliant.operators.evaluate import progress
from foliant.plans import fixtures as fx
from foliant.scanner import Scanner
from foliant.shipping import ship
from foliant.sources import camera, containers, files, zones
from foliant.sources.shared import shared_path, spread
from foliant.sources.snapshot_table import SnapshotTable
from foliant.streaming import events, sessions, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GAP = 6 * 3600
#: Fixed values of the stand-in: bits within which hashes count as near.
SESSION_BITS, LEADER_BITS = 4, 22
#: Fixed value of the stand-in: a text is an image of 64 grey values, the counts of these characters in its two halves.
SHADES = "abcdefghilmnoprstuvzADEST.,- \n01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- sessions over a stream ---------------------------------------------------------------------


@query(f"""WITH RECURSIVE n AS (
  SELECT user_id AS session, event_id, ts, (floor(abs(value))::BIGINT % 60)::INTEGER AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events WHERE value IS NOT NULL
), walk AS (
  SELECT session, event_id, ts, v, i, true AS taken, ts AS last FROM n WHERE i = 1
  UNION ALL
  SELECT n.session, n.event_id, n.ts, n.v, n.i, n.ts >= w.last + INTERVAL {GAP} SECOND, CASE WHEN n.ts >= w.last + INTERVAL {GAP} SECOND THEN n.ts ELSE w.last END
  FROM walk w JOIN n ON n.session = w.session AND n.i = w.i + 1
), taken AS (
  SELECT session, event_id, v, row_number() OVER (PARTITION BY session ORDER BY i) AS i FROM walk WHERE taken
), leaders AS (
  SELECT session, event_id, i, true AS keep, [v] AS kept FROM taken WHERE i = 1
  UNION ALL
  SELECT session, event_id, i, far, CASE WHEN far THEN list_append(kept, v) ELSE kept END FROM (
    SELECT t.session, t.event_id, t.i, t.v, l.kept, list_min(list_transform(l.kept, lambda k: abs(k - t.v))) > {SESSION_BITS} AS far
    FROM leaders l JOIN taken t ON t.session = l.session AND t.i = l.i + 1)
)
SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY i)::INTEGER AS ordinal FROM leaders WHERE keep""")
def stream_session_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as frames of their users' sessions, streamed from files among which they are shuffled, into pages that are final once the
    watermark has passed. A frame's hash has as many bits set as its value says, so distances are differences of values."""
    path = shared_path(spark, "session-pages")
    rows = fx.table(spark, sf_dir, "events").filter("value IS NOT NULL")
    level = (F.floor(F.abs("value")) % 60).cast("int")
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
    frames = rows.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.array(ones).alias("hash"))
    frames.repartition(4, F.xxhash64("id")).write.parquet(f"{path}/frames")
    last = frames.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast(frames.schema["session"].dataType).alias("session"), F.lit(-1).cast(frames.schema["id"].dataType).alias("id"),
        (F.coalesce("ts", F.current_timestamp()) + F.expr("INTERVAL 40000 DAYS")).alias("ts"), F.array(F.lit(0).cast("long")).alias("hash"),
    )
    last.write.mode("append").parquet(f"{path}/frames")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/frames")
    pages = sessions.session_pages(stream, GAP, SESSION_BITS, delay="36500 days")
    stateful.persist(pages, f"{path}/pages", f"{path}/checkpoint").awaitTermination()
    out = spark.read.schema(pages.schema).parquet(f"{path}/pages").filter("session <> -1 OR id <> -1")
    return out.select("session", F.col("id").alias("event_id"), "ordinal")


# -- hashes -------------------------------------------------------------------------------------


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, words: the average hash of each text's image."""
    text = F.coalesce("text", F.lit(""))
    half = (F.char_length(text) / 2).cast("int")
    docs = spread(fx.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
    count = lambda c, s: F.char_length(s) - F.char_length(F.replace(F.col(s), F.lit(c), F.lit("")))
    shades = F.array(*[count(c, s) for s in ("a", "b") for c in SHADES])
    return docs.select("doc_id", shades.alias("shades")).select("doc_id", bits_to_words(hash_bits(F.col("shades")), 64).alias("words"))


def _sql_char(c: str) -> str:
    return "chr(10)" if c == "\n" else f"'{c}'"


TEXT_HASHES = f"""halves AS (
  SELECT doc_id, substring(t, 1, length(t) // 2) AS a, substring(t, length(t) // 2 + 1) AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), shades AS (
  SELECT doc_id, [{", ".join(f"length({s}) - length(replace({s}, {_sql_char(c)}, ''))" for s in "ab" for c in SHADES)}] AS v FROM halves
), hashes AS (
  SELECT doc_id, list_aggregate(list_transform(v, lambda x: CASE WHEN x::DOUBLE > list_sum(v) / 64.0::DOUBLE THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM shades
)"""


@query(f"""WITH {TEXT_HASHES}
SELECT a.doc_id, arg_min(b.doc_id, hamming(a.bits, b.bits)::BIGINT * 1000000000000 + b.doc_id) AS nearest_id, min(hamming(a.bits, b.bits))::INTEGER AS distance
FROM hashes a JOIN hashes b ON b.doc_id < a.doc_id GROUP BY a.doc_id""")
def nearest_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier document of every document by hash, all in one group: multi-index hashing with four bands."""
    out = hash_index.nearest_earlier(text_hashes(spark, sf_dir), [], "doc_id", "words", bands=4, reach=1)
    return out.select("doc_id", F.col("nearest_seq").alias("nearest_id"), "distance")


@query(f"""WITH RECURSIVE {fx.HASHES}, n AS (
  SELECT vec_id, bits, row_number() OVER (ORDER BY vec_id) AS i FROM hashes
), walk AS (
  SELECT vec_id, i, true AS keep, [bits] AS kept FROM n WHERE i = 1
  UNION ALL
  SELECT vec_id, i, far, CASE WHEN far THEN list_append(kept, bits) ELSE kept END FROM (
    SELECT n.vec_id, n.i, n.bits, w.kept, list_min(list_transform(w.kept, lambda k: hamming(k, n.bits))) > {LEADER_BITS} AS far FROM walk w JOIN n ON n.i = w.i + 1)
)
SELECT vec_id, row_number() OVER (ORDER BY i)::INTEGER AS page_no FROM walk WHERE keep""")
def leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders of all vectors as one group, by rounds over near rows."""
    out = hash_index.leaders(fx.hashes(spark, sf_dir), [], "vec_id", "words", LEADER_BITS)
    return out.select("vec_id", F.col("ordinal").alias("page_no"))


# -- pixels -------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {fx.HASHES}, pixels AS (
  SELECT vec_id, (k % 8)::INTEGER AS x, (k // 8)::INTEGER AS y, substring(bits, k + 1, 1) = '1' AS on_ FROM hashes, range(64) r(k)
), wide AS (
  SELECT v.vec_id, (k % 10 - 1)::INTEGER AS x, (k // 10 - 1)::INTEGER AS y FROM (SELECT vec_id FROM hashes) v, range(100) r(k)
), ground AS (
  SELECT w.vec_id, w.x, w.y FROM wide w LEFT JOIN pixels p USING (vec_id, x, y) WHERE NOT coalesce(p.on_, false)
), outside AS (
  SELECT vec_id, x, y FROM ground WHERE x = -1 AND y = -1
  UNION
  SELECT g.vec_id, g.x, g.y FROM outside o JOIN ground g ON g.vec_id = o.vec_id AND abs(g.x - o.x) + abs(g.y - o.y) = 1
), filled AS (
  SELECT vec_id, x, y FROM wide ANTI JOIN outside USING (vec_id, x, y)
), reach AS (
  SELECT vec_id, x, y, y * 8 + x AS root FROM filled
  UNION
  SELECT f.vec_id, f.x, f.y, r.root FROM reach r JOIN filled f ON f.vec_id = r.vec_id AND abs(f.x - r.x) <= 1 AND abs(f.y - r.y) <= 1 WHERE r.root < f.y * 8 + f.x
), region AS (
  SELECT vec_id, x, y, min(root) AS root FROM reach GROUP BY vec_id, x, y
), corners AS (
  SELECT vec_id, root, x + dx AS cx, y + dy AS cy, count(*) AS n FROM region, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy) GROUP BY ALL
), areas AS (
  SELECT vec_id, root, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END) AS area FROM corners GROUP BY vec_id, root
)
SELECT h.vec_id, count(root) AS contours, coalesce(max(area), 0)::DOUBLE AS largest_area, max(area) FILTER (area >= 0.15 * 64 AND area <= 0.97 * 64)::DOUBLE AS gated_area
FROM hashes h LEFT JOIN areas USING (vec_id) GROUP BY h.vec_id""")
def contour_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer contours of every vector's bright pixels as an 8 x 8 image: how many, the largest area, and the largest that passes the gate."""
    masks = fx.hashes(spark, sf_dir).select("vec_id", "bits")
    return contours.contour_stats(masks, "vec_id", "bits", fx.SIDE).select("vec_id", "contours", "largest_area", "gated_area")


#: Fixed values of the stand-in: corners of the sheet in image k, and the box that is cut out of it.
_CORNERS = ((("k % 3 * 0.5", "k % 2 * 0.5"), ("7 - k % 4 * 0.25", "k % 3 * 0.5"), ("7 - k % 2 * 0.5", "7 - k % 3 * 0.25"), ("k % 5 * 0.25", "7 - k % 4 * 0.5")))
_BOX = ("k % 6 - 1", "k % 5 - 1", "5", "4")


def _sample(x: str, y: str) -> str:
    """Bilinear in SQL, from rows (vec_id, x, y) joined to the pixels p."""
    at = lambda dx, dy: f"CASE WHEN floor({x}) + {dx} BETWEEN 0 AND w - 1 AND floor({y}) + {dy} BETWEEN 0 AND h - 1 THEN px[((floor({y}) + {dy}) * w + floor({x}) + {dx})::INTEGER + 1] ELSE 0.0::DOUBLE END"
    fx, fy = f"({x} - floor({x}))", f"({y} - floor({y}))"
    return f"(({at(0, 0)} * (1 - {fx}) + {at(1, 0)} * {fx}) * (1 - {fy}) + ({at(0, 1)} * (1 - {fx}) + {at(1, 1)} * {fx}) * {fy})"


@query(f"""WITH src AS (
  SELECT vec_id, vec_id AS k, list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 997.0::DOUBLE) % 256) AS px, 8 AS w, 8 AS h FROM embeddings
), quads AS (
  SELECT *, {", ".join(f"({c})::DOUBLE AS {n}{i}" for i, xy in enumerate(_CORNERS) for n, c in zip("xy", xy))} FROM src
), sides AS (
  SELECT *, x1 - x2 AS ux, x3 - x2 AS vx, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS uy, y3 - y2 AS vy, y0 - y1 + y2 - y3 AS sy FROM quads
), maps AS (
  SELECT *, (sx * vy - vx * sy) / (ux * vy - vx * uy) AS g, (ux * sy - sx * uy) / (ux * vy - vx * uy) AS hh FROM sides
), warped AS (
  SELECT vec_id, i, px, w, h, (i % 8) / 8.0::DOUBLE AS u, (i // 8) / 8.0::DOUBLE AS v, g, hh, x1 - x0 + g * x1 AS a, x3 - x0 + hh * x3 AS b, x0 AS c, y1 - y0 + g * y1 AS d, y3 - y0 + hh * y3 AS e, y0 AS f FROM maps, range(64) r(i)
), places AS (
  SELECT vec_id, i, px, w, h, (a * u + b * v + c) / (g * u + hh * v + 1) AS x, (d * u + e * v + f) / (g * u + hh * v + 1) AS y FROM warped
), levels AS (
  SELECT vec_id, string_agg(least(greatest(round_even({_sample("x", "y")}, 0), 0), 255)::INTEGER::VARCHAR, ' ' ORDER BY i) AS warped FROM places GROUP BY vec_id
), boxes AS (
  SELECT vec_id, px, greatest({_BOX[0]}, 0) AS bx, greatest({_BOX[1]}, 0) AS b_y, least({_BOX[0]} + {_BOX[2]}, 8) - greatest({_BOX[0]}, 0) AS cw, least({_BOX[1]} + {_BOX[3]}, 8) - greatest({_BOX[1]}, 0) AS ch FROM src
), cut AS (
  SELECT vec_id, cw AS w, ch AS h, list_transform(range(cw * ch), lambda j: px[(b_y + j // cw) * 8 + bx + j % cw + 1]) AS px FROM boxes
), scaled AS (
  SELECT *, greatest(round_even(w * (8.0::DOUBLE / greatest(w, h)), 0), 1) AS nw, greatest(round_even(h * (8.0::DOUBLE / greatest(w, h)), 0), 1) AS nh FROM cut
), grid AS (
  SELECT vec_id, i, px, w, h, i % 8 < nw AND i // 8 < nh AS inside, least(greatest((i % 8 + 0.5::DOUBLE) * w / nw - 0.5::DOUBLE, 0), w - 1)::DOUBLE AS x, least(greatest((i // 8 + 0.5::DOUBLE) * h / nh - 0.5::DOUBLE, 0), h - 1)::DOUBLE AS y FROM scaled, range(64) r(i)
), boxed AS (
  SELECT vec_id, string_agg(CASE WHEN inside THEN least(greatest(round_even({_sample("x", "y")}, 0), 0), 255) ELSE 0 END::INTEGER::VARCHAR, ' ' ORDER BY i) AS boxed FROM grid GROUP BY vec_id
)
SELECT vec_id, warped, boxed FROM levels JOIN boxed USING (vec_id)""")
def pixel_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as an 8 x 8 image: the sheet in it rectified, and a part of it cut out and letterboxed, as levels."""
    v = spread(fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", F.col("vec_id").alias("k"), F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 997.0) % 256).alias("px"))
    img = v.select("vec_id", "k", pixels.image(F.col("px"), fx.SIDE, fx.SIDE).alias("img"))
    quad = [(F.expr(x).cast("double"), F.expr(y).cast("double")) for x, y in _CORNERS]
    img = img.withColumn("m", pixels.square_to_quad(quad)).withColumn("cut", pixels.crop(F.col("img"), *[F.expr(b).cast("int") for b in _BOX]))
    levels = lambda i: F.array_join(F.transform(i["pixels"], lambda p: pixels.level(p).cast("int").cast("string")), " ")
    return img.select("vec_id", levels(pixels.warp(F.col("img"), F.col("m"), 8, 8)).alias("warped"), levels(pixels.letterbox(F.col("cut"), 8)).alias("boxed"))


# -- files --------------------------------------------------------------------------------------

#: Fixed value of the stand-in: events by number in one recording, so that a recording's size is bounded.
RECORDING = 1 << 16
#: Users and recordings of each, by number, in one folder, so that a folder's files are bounded.
FOLDER = 256, 16


def recordings(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Every user's events as media containers, in folders by users and numbers: an event is a frame of its number's digits."""
    ship(spark)
    rows = fx.table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_type") == "error").alias("k"))
    frame = F.struct("ms", "event_id", F.coalesce("k", F.lit(False)).alias("k"))
    held = rows.groupBy("user_id", F.floor(F.col("event_id") / RECORDING).alias("part")).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    joined = lambda *c: F.concat_ws("-", *[F.lpad(x.cast("string"), 20, "0") for x in c])
    user, part = F.col("user_id"), F.col("part")
    name = F.concat(joined(F.floor(user / FOLDER[0]), F.floor(part / FOLDER[1])), F.lit("/"), joined(user, part), F.lit(".mp4"))
    held = held.select(name.alias("file"), F.col("f")["ms"].alias("ms"), F.col("f")["event_id"].alias("ids"), F.col("f")["k"].alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, ms, ids, k = (batch.column(c)[i].as_py() for c in range(4))
                shown = [b - a for a, b in zip(ms, [*ms[1:], ms[-1] + 40])]
                keys = [j for j, own in enumerate(k) if own or not j]
                data = containers.container([b"%d" % e for e in ids], shown, keys=keys)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([0]), pa.array([data], pa.binary())], ["file", "part", "content"])

    files.write_files(held.mapInArrow(run, "file string, part long, content binary"), path)


def _recording(path: Column) -> list[Column]:
    return [F.regexp_extract(F.substring_index(path, "/", -1), r"0*(\d+)-0*(\d+)\.mp4$", k).cast("long").alias(n) for k, n in ((1, "session"), (2, "part"))]


@query(f"""WITH f AS (
  SELECT user_id, event_id // {RECORDING} AS part, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS k, row_number() OVER w AS i, lead(epoch_us(ts) // 1000) OVER w AS later
  FROM events WINDOW w AS (PARTITION BY user_id, event_id // {RECORDING} ORDER BY epoch_us(ts) // 1000, event_id)
), v AS (
  SELECT user_id AS session, part, count(*) AS frames, sum(coalesce(later - ms, 40))::BIGINT AS ticks, count(*) FILTER (k OR i = 1) AS key_frames FROM f GROUP BY ALL
)
SELECT session, part, frames, ticks::DOUBLE / 1000 AS duration, (frames * 1000)::DOUBLE / ticks AS fps, key_frames FROM v""")
def video_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of every user's events, written as media containers by the file sink, and what the container source reads from their tables."""
    path = shared_path(spark, "recordings")
    recordings(spark, sf_dir, path)
    got = containers.video_info(spark, path, ["path", "frames", "duration", "fps", "key_frames"])
    return got.select(*_recording(F.col("path")), "frames", "duration", "fps", "key_frames")


@query(f"""SELECT user_id AS session, event_id // {RECORDING} AS part, count(*) AS frames, sum(length(event_id::VARCHAR))::BIGINT AS bytes, max(event_id) AS last_id
FROM events GROUP BY ALL""")
def camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same recordings streamed frame by frame, as a camera's segments, and what each brought."""
    path = shared_path(spark, "segments")
    recordings(spark, sf_dir, f"{path}/in")
    frames = camera.camera(spark, f"{path}/in", f"{path}/progress", 50_000, nested=True)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/out/batch={k}")
    query = frames.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    event = F.col("payload").cast("string").cast("long")
    out = spark.read.schema(frames.schema).parquet(f"{path}/out")
    return out.groupBy(*_recording(F.col("path"))).agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"), F.max(event).alias("last_id"))


@query("""SELECT conv_id::VARCHAR || '.zip' AS file, count(*) AS entries, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes,
  min('page-' || lpad((turn + 1)::VARCHAR, 4, '0') || '.txt') AS first_entry FROM conversations GROUP BY conv_id""")
def page_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip of each session's page texts, written by the file sink page by page, and its entries read back."""
    path = shared_path(spark, "archives")
    pages = fx.table(spark, sf_dir, "conversations")
    entry = F.concat(F.lit("page-"), F.lpad((F.col("turn") + 1).cast("string"), 4, "0"), F.lit(".txt"))
    rows = pages.select(F.concat(F.col("conv_id").cast("string"), F.lit(".zip")).alias("file"), F.col("turn").cast("long").alias("part"), entry.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    files.write_files(rows, path, "zip")
    return files.zip_entries(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), F.min("name").alias("first_entry"))


@query("""WITH p AS (SELECT conv_id AS session, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations), v AS (
  SELECT 0 AS version, session, size FROM p WHERE turn = 0
  UNION ALL SELECT 1, session, size FROM p WHERE turn <= 1
  UNION ALL SELECT 2, session, size FROM p WHERE turn <= 1 OR turn % 2 = 0
)
SELECT version::INTEGER AS version, session, count(*) AS pages, sum(size)::BIGINT AS bytes FROM v GROUP BY version, session""")
def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lists as a table of snapshots: two appends and a replacement, and every version read back."""
    table = SnapshotTable(spark, shared_path(spark, "session-versions"))
    pages = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    table.append(pages.filter("turn = 0"))
    table.append(pages.filter("turn = 1"))
    table.replace(pages.filter("turn <= 1 OR turn % 2 = 0"))
    held = reduce(DataFrame.unionByName, [table.load(v).withColumn("version", F.lit(v)) for v in table.versions()])
    return held.groupBy("version", "session").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("bytes"))


@query("""WITH f AS (SELECT event_id % 4 AS part, event_type <> 'error' AS detected FROM events), b AS (
  SELECT part, count(*) AS frames, count(*) FILTER (detected) AS detected FROM f GROUP BY part
)
SELECT part, frames, detected, sum(frames) OVER (ORDER BY part)::BIGINT AS done,
  floor(sum(frames) OVER (ORDER BY part)::DOUBLE / sum(frames) OVER () * 100 + 0.5)::BIGINT AS percent FROM b""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as four streams, one after the other: what the listener was told of each, and the progress so far. Nothing is counted but by the streams."""
    path = shared_path(spark, "progress")
    frames = fx.table(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(4)).alias("part"), "event_id", (F.col("event_type") != "error").alias("detected"))
    frames.write.partitionBy("part").parquet(f"{path}/frames")
    label = path[-32:]
    for k in range(4):
        frames.limit(0).drop("part").write.mode("append").parquet(f"{path}/frames/part={k}")  # so that every folder is there
        bus = events.EventBus(spark, name=f"{label}-{k}", path=f"{path}/reports").start()
        try:
            stream = spark.readStream.schema("event_id long, detected boolean").option("pathGlobFilter", "*.parquet").parquet(f"{path}/frames/part={k}")
            query = events.observed(stream, F.col("detected")).writeStream.format("noop").queryName(bus.only).option("checkpointLocation", f"{path}/checkpoint-{k}").trigger(availableNow=True).start()
            query.awaitTermination()
            bus.wait(str(query.runId))
        finally:
            bus.stop()
    part = F.substring_index("query", "-", -1).cast("long")
    told = spark.read.schema(events.REPORT).json(f"{path}/reports").groupBy(part.alias("part")).agg(F.sum("frames").alias("frames"), F.sum("detected").alias("detected")).filter("frames > 0")
    done, total = F.sum("frames").over(W.orderBy("part")), F.sum("frames").over(W.partitionBy())  # of four rows
    return told.select("part", "frames", "detected", done.alias("done"), progress(done, total).alias("percent"))


@query("""SELECT user_id AS session, count(*) AS results, min(event_id) AS first_id, max(event_id) AS last_id FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00' GROUP BY user_id""")
def results_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events laid out by time, and those of two days and a half, found through the zone map."""
    path = shared_path(spark, "results")
    zones.write_zoned(fx.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("created_at")), path, "created_at")
    start, end = (F.to_timestamp(F.lit(t)) for t in ("2024-01-10 00:00:00", "2024-01-12 12:00:00"))
    found = zones.read_zoned(spark, path, "created_at", start, end)
    return found.groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("results"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# -- frames against the one before ------------------------------------------------------------------

#: Fixed value of the stand-in: mean difference of grey levels up to which a frame is stable.
STILL = 70.0
CHANGES = f"""WITH q AS (
  SELECT label, vec_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(v::DOUBLE * 512 + 128)))) AS px FROM embeddings
), n AS (
  SELECT label, vec_id, px, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM q)
SELECT label, vec_id, CASE WHEN before IS NULL THEN 'unknown'
  WHEN list_sum(list_transform(list_zip(px, before), lambda z: abs(z[1] - z[2]))) / 64 <= {STILL} THEN 'stable' ELSE 'moving' END AS state FROM n"""


def _grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vec_id, levels: vectors as 8 x 8 images of whole grey levels."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 512 + 128))).cast("int")
    return fx.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", level).alias("levels"))


@query(CHANGES)
def page_change_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged-in detector over each label's frames in order."""
    raw = F.unhex(F.array_join(F.transform("levels", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    frames = _grey(spark, sf_dir).select("label", "vec_id", raw.alias("pixels"), *[F.lit(n).alias(c) for c, n in (("width", 8), ("height", 8), ("channels", 1))])
    return page_change.page_changes(frames, lambda: page_change.FrameDifference(STILL), ["label"], ["vec_id"])


@query(CHANGES)
def page_change_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states as columns, sessions of any size split by ranges."""
    return page_change.frame_changes(_grey(spark, sf_dir), ["label"], ["vec_id"], "levels", STILL)


# -- quadrilaterals of every shape, positions and fallbacks --------------------------------------------


@query("""WITH q AS (
  SELECT p_partkey, p_partkey % 4 AS shape, 10.0::DOUBLE + p_size AS w, 5.0::DOUBLE + p_partkey % 37 AS h FROM part
), c AS (
  SELECT p_partkey, CASE shape
    WHEN 0 THEN [[0, 0], [w, 0], [w, h], [0, h]]
    WHEN 1 THEN [[0, 0], [w, h], [w, 0], [0, h * 2]]
    WHEN 2 THEN [[0, 0], [w, 0], [w / 4, h / 4], [0, h]]
    ELSE [[0, 0], [w, 0], [w + 3, h], [w, h + p_partkey % 3 - 1]] END AS p FROM q
), s AS (
  SELECT p_partkey, sign((p[2][1] - p[1][1]) * (p[3][2] - p[2][2]) - (p[2][2] - p[1][2]) * (p[3][1] - p[2][1])) AS t1,
    sign((p[3][1] - p[2][1]) * (p[4][2] - p[3][2]) - (p[3][2] - p[2][2]) * (p[4][1] - p[3][1])) AS t2,
    sign((p[4][1] - p[3][1]) * (p[1][2] - p[4][2]) - (p[4][2] - p[3][2]) * (p[1][1] - p[4][1])) AS t3,
    sign((p[1][1] - p[4][1]) * (p[2][2] - p[1][2]) - (p[1][2] - p[4][2]) * (p[2][1] - p[1][1])) AS t4,
    abs((p[1][1] * p[2][2] - p[2][1] * p[1][2]) + (p[2][1] * p[3][2] - p[3][1] * p[2][2]) + (p[3][1] * p[4][2] - p[4][1] * p[3][2]) + (p[4][1] * p[1][2] - p[1][1] * p[4][2])) / 2 AS area FROM c)
SELECT p_partkey, round(area, 4) AS area, t1 = t2 AND t2 = t3 AND t3 = t4 AND t1 <> 0 AS convex, t1 = t2 AND t2 = t3 AND t3 = t4 AND t1 <> 0 AND area >= 500 AS valid FROM s""")
def quad_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, crossed, dented and slanted quadrilaterals: only simple convex ones of a tenth of the frame are valid."""
    p = fx.table(spark, sf_dir, "part").withColumns({"w": F.col("p_size") + 10.0, "h": F.col("p_partkey") % 37 + 5.0})
    w, h, o = F.col("w"), F.col("h"), F.lit(0.0)
    quad = lambda *ps: F.array(*[geometry.point(x, y) for x, y in ps])
    shape = F.col("p_partkey") % 4
    pts = F.when(shape == 0, quad((o, o), (w, o), (w, h), (o, h))).when(shape == 1, quad((o, o), (w, h), (w, o), (o, h * 2)))
    pts = pts.when(shape == 2, quad((o, o), (w, o), (w / 4, h / 4), (o, h))).otherwise(quad((o, o), (w, o), (w + 3, h), (w, h + F.col("p_partkey") % 3 - 1)))
    q = p.select("p_partkey", pts.alias("pts"))
    valid = lambda area: geometry.quad_valid(F.col("pts"), F.lit(area))
    return q.select("p_partkey", F.round(geometry.shoelace(F.col("pts")), 4).alias("area"), valid(0.0).alias("convex"), valid(5000.0).alias("valid"))


@query(f"""WITH {fx.BOXES}, l AS (
  SELECT page, rid, x, y, row_number() OVER (PARTITION BY page ORDER BY rid)::INTEGER AS pos FROM boxes
), r AS (
  SELECT page, conf, row_number() OVER (PARTITION BY page ORDER BY rid)::INTEGER AS pos FROM boxes WHERE conf >= 20)
SELECT page, pos, rid, x, y, conf FROM l JOIN r USING (page, pos)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and recognised lines of a page put together by position; the longer side's rest has no partner."""
    b = fx.boxes(spark, sf_dir)
    at = F.row_number().over(W.partitionBy("page").orderBy("rid")).alias("pos")
    return matching.zip_positions(b.select("page", "rid", "x", "y", at), b.filter("conf >= 20").select("page", "conf", at), "page", "pos")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' AND value >= 50 THEN 'first' WHEN value IS NOT NULL AND event_id % 3 > 0 THEN 'second' WHEN event_id % 2 = 0 THEN 'last' END AS found
FROM events""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three detectors that found something; null if none did."""
    first = F.when((F.col("event_type") != "error") & (F.col("value") >= 50), "first")
    second = F.when(F.col("value").isNotNull() & (F.col("event_id") % 3 > 0), "second")
    last = F.when(F.col("event_id") % 2 == 0, "last")
    return fx.table(spark, sf_dir, "events").select("event_id", matching.first_known(first, second, last).alias("found"))


# -- a whole scan -----------------------------------------------------------------------------------

#: Fixed values of the stand-in: bits of 64 up to which pages are duplicates, and a session's most pages.
SCAN_BITS, SCAN_PAGES = 26, 200


class WholeFrame:
    """An edge detector for frames that hold nothing but the page."""

    def detect(self, image):
        h, w = image.shape[:2]
        return [(0, 0), (w, 0), (w, h), (0, h)]


@query(f"""WITH RECURSIVE q AS (
  SELECT label AS session, vec_id AS frame_idx, list_transform(embedding, lambda v, i: 2 * greatest(0, least(127, floor(v::DOUBLE * 256 + 64)))::INTEGER + CASE WHEN i = 1 THEN 1 ELSE 0 END) AS px FROM embeddings
), h AS (
  SELECT session, frame_idx, px, list_aggregate(list_transform(px, lambda v: CASE WHEN v > list_sum(px)::DOUBLE / 64 THEN '1' ELSE '0' END), 'string_agg', '') AS bits,
    row_number() OVER (PARTITION BY session ORDER BY frame_idx) AS i FROM q
), leaders AS (
  SELECT session, frame_idx, i, true AS keep, [bits] AS kept FROM h WHERE i = 1
  UNION ALL
  SELECT session, frame_idx, i, far, CASE WHEN far THEN list_append(kept, bits) ELSE kept END FROM (
    SELECT h.session, h.frame_idx, h.i, h.bits, l.kept, list_min(list_transform(l.kept, lambda b: hamming(b, h.bits))) > {SCAN_BITS} AS far
    FROM leaders l JOIN h ON h.session = l.session AND h.i = l.i + 1)
), pages AS (
  SELECT session, frame_idx, row_number() OVER (PARTITION BY session ORDER BY i)::INTEGER AS position FROM leaders WHERE keep)
SELECT session, frame_idx, position, 16 AS width, 16 AS height, sha256(list_aggregate(list_transform(range(256), lambda k: repeat(printf('%02X', px[(k // 32 * 8 + k % 16 // 2 + 1)::INTEGER]), 3)), 'string_agg', '')) AS pixels_sha256
FROM pages JOIN q USING (session, frame_idx) WHERE position <= {SCAN_PAGES}""")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector a frame of 16 x 16 pixels, every label a session: the pages of each with their rectified images."""
    level = lambda v, i: F.greatest(F.lit(0), F.least(F.lit(127), F.floor(v.cast("double") * 256 + 64))) * 2 + F.when(i == 0, 1).otherwise(0)
    twice = F.transform("embedding", lambda v, i: F.repeat(F.lpad(F.hex(level(v, i)), 2, "0"), 2))
    raw = F.unhex(F.regexp_replace(F.array_join(twice, ""), "(.{32})", "$1$1"))  # each row of pixels twice
    e = fx.table(spark, sf_dir, "embeddings")
    sizes = [F.lit(n).alias(c) for c, n in (("ready_state", 4), ("width", 16), ("height", 16), ("channels", 1))]
    frames = e.select(F.col("label").cast("string").alias("session"), F.col("vec_id").alias("frame_idx"), F.col("vec_id").cast("double").alias("ts"), *sizes, raw.alias("pixels"))
    scan = Scanner(width=16, height=16, threshold=4 * SCAN_BITS, most_pages=SCAN_PAGES, edges=WholeFrame).scan(frames)
    kind = e.schema["label"].dataType
    return scan.select(F.col("session").cast(kind).alias("session"), "frame_idx", "position", "width", "height", F.sha2(F.hex("pixels"), 256).alias("pixels_sha256"))
