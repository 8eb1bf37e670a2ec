"""Pixels as rows of bytes: colours of boxes in RGB frames, descriptors of grey frames. Frames come decoded, in any number of
horizontal strips; decoding is left to the reader that made them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Colour of a box that shows nothing.
DEFAULT = (110, 112, 115)
#: Grey frames: width and height, rows of the upper part that counts, size of a descriptor.
GREY_W, GREY_H, UPPER, DESC_W, DESC_H = 128, 72, 44, 32, 16


def inner_crops(frames: DataFrame, boxes: DataFrame, or_whole: bool = True) -> DataFrame:
    """(box, frame, left, top, right, bottom) in whole pixels: boxes(box, frame, x1, y1, x2, y2) cut at the edges of frames(frame, width,
    height) and reduced to the middle 60 % of their width and 50 % of their height; where that is nothing, the whole box if or_whole."""
    b = boxes.join(frames, "frame")
    edge = lambda low, high, size: (F.greatest(F.col(low), F.lit(0.0)).cast("int"), F.least(F.greatest(F.col(high).cast("int"), F.lit(0)), F.col(size)))
    (left, right), (top, bottom) = edge("x1", "x2", "width"), edge("y1", "y2", "height")
    b = b.select("box", "frame", left.alias("l"), top.alias("t"), F.greatest(right - left, F.lit(0)).alias("w"), F.greatest(bottom - top, F.lit(0)).alias("h"))
    part = lambda c, share: (F.col(c) * F.lit(share)).cast("int")
    some = (part("w", 0.8) > part("w", 0.2)) & (part("h", 0.75) > part("h", 0.25))
    pick = lambda at, c, share, whole: F.col(at) + (F.when(some, part(c, share)).otherwise(whole) if or_whole else part(c, share))
    return b.select("box", "frame", pick("l", "w", 0.2, F.lit(0)).alias("left"), pick("t", "h", 0.25, F.lit(0)).alias("top"), pick("l", "w", 0.8, F.col("w")).alias("right"), pick("t", "h", 0.75, F.col("h")).alias("bottom"))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        box, channel, value, n = [], [], [], []
        for start, width, content, crops in zip(*(batch.column(c).to_pylist() for c in ("start", "width", "content", "crops"))):
            pixels = np.frombuffer(content, np.uint8)
            pixels = pixels[: len(pixels) // (3 * width) * 3 * width].reshape(-1, width, 3)
            for c in crops:
                part = pixels[max(c["top"] - start, 0) : max(c["bottom"] - start, 0), c["left"] : c["right"]].reshape(-1, 3)
                for k in range(3) if len(part) else ():
                    counts = np.bincount(part[:, k], minlength=256)
                    some = np.flatnonzero(counts)
                    box += [c["box"]] * len(some)
                    channel += [k] * len(some)
                    value += some.tolist()
                    n += counts[some].tolist()
        yield pa.record_batch([pa.array(box, pa.int64()), pa.array(channel, pa.int32()), pa.array(value, pa.int32()), pa.array(n, pa.int64())], ["box", "channel", "value", "n"])


def dominant_rgb(strips: DataFrame, boxes: DataFrame, or_whole: bool = True) -> DataFrame:
    """(box, r, g, b): the median of each channel over the inner part of every box, halves cut off.

    strips(frame, start, width, height, content): rows of a frame from ``start`` on, 3 bytes a pixel, height that of the frame; a
    frame may be one strip or many. boxes(box as long, frame, x1, y1, x2, y2). Medians are read off histograms of 256 values,
    which add up over strips, so no task needs a whole frame. A box outside its frame, or of a frame that is not there, has the
    default colour; so has one too thin for an inner part, unless or_whole counts all of it.
    """
    frames = strips.groupBy("frame").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    crops = inner_crops(frames, boxes, or_whole).groupBy("frame").agg(F.collect_list(F.struct("box", "left", "top", "right", "bottom")).alias("crops"))
    bins = strips.join(crops, "frame").select("start", "width", "content", "crops").mapInArrow(_histograms, "box long, channel int, value int, n long")
    whole = bins.groupBy("box", "channel", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("box", "channel")
    upto, total = F.sum("n").over(w.orderBy("value")), F.sum("n").over(w)
    ranked = whole.withColumns({"upto": upto, "total": total})
    low = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("value")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("value")))
    medians = ranked.groupBy("box", "channel").agg(F.floor((low + high) / 2).cast("int").alias("m"))
    colours = medians.groupBy("box").agg(*(F.max(F.when(F.col("channel") == k, F.col("m"))).alias(c) for k, c in enumerate("rgb")))
    return boxes.select("box").join(colours, "box", "left").select("box", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in zip("rgb", DEFAULT)))


def read_grey(spark: SparkSession, path: str, size: int = GREY_W * GREY_H) -> DataFrame:
    """(t, content) of raw frames of ``size`` bytes each, numbered within a file of the path (a file, a folder or a pattern).

    Files are split between frames, so one long recording is read by many tasks. A file that ends inside a frame cannot be
    split (one task reads it, 2 GB at most); what is left of its last frame is left out.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f for found in fs.globStatus(at) for f in (fs.listStatus(found.getPath()) if found.isDirectory() else [found]) if f.getLen() >= size]
    even, cut = ([f.getPath().toString() for f in files if (f.getLen() % size == 0) is whole] for whole in (True, False))
    kind = "t long, content binary"
    out = spark.createDataFrame([], kind)
    if even:
        conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size)}
        raw = spark.sparkContext.newAPIHadoopFile(",".join(even), "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        out = out.union(spark.createDataFrame(raw.map(lambda kv: (kv[0], bytearray(kv[1]))), kind))
    if cut:
        rows = spark.read.format("binaryFile").load(cut).select("content", F.explode(F.sequence(F.lit(0), (F.length("content") / size).cast("int") - 1)).alias("t"))
        out = out.union(rows.select(F.col("t").cast("long"), F.substring("content", F.col("t") * size + 1, F.lit(size))))
    return out


def _weights(source: int, target: int) -> np.ndarray:
    """Linear interpolation of ``target`` evenly spread samples from ``source`` ones, held at the ends."""
    at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((target, source))
    out[np.arange(target), low] = 1 - (at - low)
    out[np.arange(target), np.minimum(low + 1, source - 1)] += at - low
    return out


ROWS, COLS = _weights(UPPER, DESC_H), _weights(GREY_W, DESC_W).T


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            frames = np.stack([np.frombuffer(c, np.uint8)[: UPPER * GREY_W] for c in part.column(1).to_pylist()]).reshape(-1, UPPER, GREY_W)
            d = np.rint(ROWS @ frames @ COLS).reshape(len(frames), -1)
            d -= d.mean(axis=1, keepdims=True)
            d /= np.sqrt((d * d).sum(axis=1, keepdims=True)) + 1e-6
            vec = pa.ListArray.from_arrays(pa.array(DESC_W * DESC_H * np.arange(len(d) + 1), pa.int32()), pa.array(d.ravel()))
            yield pa.record_batch([part.column(0), vec], ["t", "vec"])


def descriptors(frames: DataFrame) -> DataFrame:
    """(t, vec) of frames(t as long, content of 128 x 72 grey bytes): the upper 62 %, buildings and sky, resampled to 32 x 16, centred and
    brought to length 1; a frame of one grey has zeros. Frames of another size are left out."""
    whole = frames.where(F.length("content") == GREY_W * GREY_H).select("t", "content")
    return whole.mapInArrow(_describe, "t long, vec array<double>")
