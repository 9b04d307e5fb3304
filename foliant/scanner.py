"""One object over the stages: frames to kept pages, layouts to ordered text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.hashing import bits_to_words, hash_bits
from foliant.operators import backends, detection, folds, images, pages, reading_order, recognition
from foliant.sources.shared import staged

SIDE = 16


@dataclass
class Scanner:
    """Options with the capture page's defaults. Backends are functions that make one in a worker; without an edge detector the built-in one is used."""

    gap: float = 0.5
    threshold: int = 60
    most_pages: int = 200
    width: int = 1200
    height: int = 1600
    edges: Callable | None = None
    classifier: Callable | None = None
    layout: Callable | None = None
    recogniser: Callable | None = None

    def pages(self, frames: DataFrame) -> DataFrame:
        """session, frame_idx, position, error: the pages of frames(session, frame_idx, ts, ready_state, width, height, channels, pixels).

        Gates that read no pixels come first; greedy steps see order keys and hashes only.
        """
        ready = images.readable(frames)
        taken = folds.gap_sample(ready.select("session", "frame_idx", "ts"), ["session"], "ts", self.gap, ["frame_idx"], ["frame_idx"])
        found = self._quads(ready.join(taken.select("session", "frame_idx"), ["session", "frame_idx"], "left_semi"))
        if self.classifier:
            flat = images.rectify(found, self.width, self.height)
            small = images.thumbnails(recognition.classified(backends.classify(flat, self.classifier)).filter("accepted"), SIDE)
        else:
            small = images.rectified_thumbnails(found, self.width, self.height, SIDE)
        hashed = small.select("session", "frame_idx", "ts", bits_to_words(hash_bits(F.col("luma")), SIDE * SIDE).alias("words"))
        kept = folds.greedy_dedup(hashed, ["session"], [F.col("ts"), F.col("frame_idx")], "words", self.threshold, ["frame_idx"])
        return pages.cap(kept.select("session", "frame_idx", F.col("ordinal").alias("position")), self.most_pages)

    def _quads(self, frames: DataFrame) -> DataFrame:
        found = backends.detect_edges(frames, self.edges) if self.edges else images.detect(frames)
        return found.filter("quad IS NOT NULL")

    def scan(self, frames: DataFrame) -> DataFrame:
        """session, frame_idx, position and the rectified image (pixels, width, height, channels) of every page up to ``most_pages``.

        The pages are settled first, by thumbnails; then the frames of those alone are rectified again, so that no rectified image is shuffled,
        sorted or staged. frames as for ``pages``, with one row for each session and frame_idx.
        """
        kept = staged(self.pages(frames).filter("error IS NULL").select("session", "frame_idx", "position"), "scanned-pages")
        wanted = images.readable(frames).join(kept, ["session", "frame_idx"])
        flat = images.rectify(self._quads(wanted), self.width, self.height)
        return flat.select("session", "frame_idx", "position", "pixels", "width", "height", "channels")

    def text(self, images_of_pages: DataFrame, crop: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """page, full_text of pages (page, pixels, width, height, channels): layout, recognition, reading order, assembly.

        ``crop(pages, lines)`` cuts the lines' pixels out, with page, line and box.
        """
        if not (self.layout and self.recogniser):
            raise ValueError("text needs a layout detector and a recogniser")
        raw = backends.detect_layout(images_of_pages, self.layout)
        lines, blocks = detection.postprocess(raw, "page", "box")
        read = recognition.confident(backends.recognise(crop(images_of_pages, lines), self.recogniser))
        named = blocks.withColumnRenamed("box", "block_id")
        boxes = lines.drop("score").join(read.select("page", "box", "text", "confidence"), ["page", "box"])
        order = reading_order.reading_order(boxes, "page", "box", named)
        return pages.assemble_text(boxes.join(order, ["page", "box"]), "page", "reading_order")
