"""Camera motion from tracked points: a robust similarity of each frame pair, and what follows from it.

Points are found and followed on pixels by the user's tracker (``sources.files.detect`` runs it); from here on they are rows
(frame, point, x, y, x2, y2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import ordered, robust

#: Residuals that are held at a time: trials times points.
CELLS = 1 << 21
#: Least points of a fit, reach of an inlier in pixels, share of residuals below the motion of a frame.
LEAST_POINTS, REACH_PX, MOTION_SHARE = 21, 2.0, 80
#: Inliers of a verified revisit and of a doubtful one, least matches, reach of an inlier in pixels.
REVISIT, MAYBE, LEAST_MATCHES, MATCH_REACH_PX = 40, 22, 15, 5.0


def _draws(trials: int, picks: int, n: int, seed: int) -> np.ndarray:
    """Indices below n, ``picks`` different ones a trial: a counter hashed with the seed, so reruns draw the same."""
    with np.errstate(over="ignore"):
        h = (np.arange(trials * picks, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = ((h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)
    h = h.reshape(trials, picks)
    out = np.empty((trials, picks), np.int64)
    for k in range(picks):  # the k-th of the indices that are left
        out[:, k] = h[:, k] % np.uint64(n - k)
        for j in range(k):
            taken = np.sort(out[:, :k], axis=1)[:, j]
            out[:, k] += out[:, k] >= taken
    return out


def _similarity(z: np.ndarray, w: np.ndarray, weight: np.ndarray | None = None) -> tuple[complex, complex]:
    """w = a z + b by least squares over complex numbers: a holds scale and turn, b the shift."""
    if weight is not None:
        z, w = z[weight], w[weight]
    zc, wc = z - z.mean(), w - w.mean()
    size = (np.abs(zc) ** 2).sum()
    a = (np.conj(zc) * wc).sum() / size if size > 0 else complex(1)
    return a, w.mean() - a * z.mean()


def similarity(z: np.ndarray, w: np.ndarray, reach: float = REACH_PX, trials: int = 256, seed: int = 7) -> tuple[complex, complex, np.ndarray] | None:
    """(a, b, inliers) of the similarity that most points follow within ``reach``, the earliest trial of equals, fitted
    again over its inliers until they stay the same; None where no two points differ."""
    i, j = _draws(trials, 2, len(z), seed).T
    apart = z[i] != z[j]
    i, j = i[apart], j[apart]
    if not len(i):
        return None
    a = (w[i] - w[j]) / (z[i] - z[j])
    b = w[i] - a * z[i]
    hits = np.zeros(len(a), np.int64)
    step = max(1, CELLS // len(a))
    for at in range(0, len(z), step):
        part = slice(at, at + step)
        hits += (np.abs(w[part] - a[:, None] * z[part] - b[:, None]) < reach).sum(axis=1)
    best = int(hits.argmax())
    a, b = a[best], b[best]
    inside = np.abs(w - a * z - b) < reach
    for _ in range(20):
        a, b = _similarity(z, w, inside)
        now = np.abs(w - a * z - b) < reach
        if now.sum() < 2 or (now == inside).all():
            break
        inside = now
    return a, b, inside


def homography_inliers(p: np.ndarray, q: np.ndarray, reach: float = MATCH_REACH_PX, trials: int = 512, seed: int = 7) -> int:
    """Most points (n, 2) that one projective map of four of them brings within ``reach`` of q, over all trials at once."""
    pick = _draws(trials, 4, len(p), seed)
    # coordinates around 0 and about 1 keep the systems well conditioned
    size = max(float(np.abs(p).max()), float(np.abs(q).max()), 1.0)
    a, b = p[pick] / size, q[pick] / size
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y], axis=2), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y], axis=2)], axis=1)
    sound = np.abs(np.linalg.det(rows)) > 1e-12
    if not sound.any():
        return 0
    h = np.linalg.solve(rows[sound], np.concatenate([u, v], axis=1)[sound][..., None])[..., 0]
    h = np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3)
    hits = np.zeros(len(h), np.int64)
    step = max(1, CELLS // len(h))
    for at in range(0, len(p), step):
        line = np.concatenate([p[at : at + step] / size, np.ones((len(p[at : at + step]), 1))], axis=1)
        m = h @ line.T
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.hypot(m[:, 0] / m[:, 2] - q[at : at + step, 0] / size, m[:, 1] / m[:, 2] - q[at : at + step, 1] / size)
        hits += (off < reach / size).sum(axis=1)
    return int(hits.max())


def _groups(points: DataFrame, key: str) -> DataFrame:
    """A row per key with its points in one order, whatever order they came in."""
    point = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "x2", "y2")))
    whole = points.where("x is not null and y is not null and x2 is not null and y2 is not null")
    return whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("point").alias("point"), point.alias("at")))).alias("p")).select(key, F.col("p.at").alias("at"))


def _points(column: pa.Array, row: int) -> np.ndarray:
    values = column[row].values
    return np.stack([values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "x2", "y2")], axis=1)


def similarity_fit(points: DataFrame, key: str = "frame", least: int = LEAST_POINTS, reach: float = REACH_PX, trials: int = 256, seed: int = 7) -> DataFrame:
    """(key, scale, rotation_deg, dx, dy, n_points, n_inlier, residual_p80) of each frame pair's points.

    points(key, point, x, y, x2, y2): where each point was and where it is. Frames of fewer than ``least`` points, or whose points all
    coincide, have no fit: nulls and a residual of 0. The residual is the 80th percentile (interpolated) over all points,
    so what moves against the camera counts. Rows without a coordinate are left out; ``point`` only orders rows. A task
    holds one frame's points, of which a tracker gives some hundreds.
    """
    kind = points.schema[key].dataType
    names = ["scale", "rotation_deg", "dx", "dy", "n_points", "n_inlier", "residual_p80"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for row in range(batch.num_rows):
                p = _points(batch.column(1), row)
                z, w = p[:, 0] + 1j * p[:, 1], p[:, 2] + 1j * p[:, 3]
                fit = similarity(z, w, reach, trials, seed) if len(z) >= least else None
                if fit is None:
                    out.append((None, None, None, None, len(z), 0, 0.0))
                    continue
                a, b, inside = fit
                off = np.percentile(np.abs(w - a * z - b), MOTION_SHARE)
                out.append((abs(a), float(np.degrees(np.angle(a))), b.real, b.imag, len(z), int(inside.sum()), float(off)))
            types = [pa.float64()] * 4 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], [key, *names])

    return _groups(points, key).mapInArrow(run, f"{key} {kind.simpleString()}, scale double, rotation_deg double, dx double, dy double, n_points long, n_inlier long, residual_p80 double")


def scene_motion(fits: DataFrame, video: str, frame: str) -> DataFrame:
    """fits(video, frame, residual_p80) with ``along``: the running sum, before each frame, of the residual smoothed over
    five frames (zeros beyond the ends); the first frame of a video is at 0."""
    smooth = fits.withColumn("_v", ordered.moving_average("residual_p80", video, frame, 5))
    return smooth.withColumn("along", ordered.prefix("_v", video, frame)).drop("_v")


def odometry(points: DataFrame, fits: DataFrame, horizon: float, key: str = "frame") -> DataFrame:
    """(key, yaw_px, flow, n_ground): the fitted sideways shift, which forward motion leaves alone, and the slope of the
    square law that road points follow: dy = flow (y - horizon)^2, over points over 20 px below the horizon that move down by
    more than 0.02 px (robust.ground_fit). Frames without a fit have neither; frames with too few road points no flow."""
    road = points.where((F.col("y") > horizon + 20) & (F.col("y2") - F.col("y") > 0.02))
    ground = robust.ground_fit(road.select(key, ((F.col("y") - horizon) * (F.col("y") - horizon)).alias("x"), (F.col("y2") - F.col("y")).alias("dy")), key)
    out = fits.select(key, F.col("dx").alias("yaw_px")).join(ground, key, "left")
    moved = F.col("yaw_px").isNotNull()
    return out.select(key, "yaw_px", F.when(moved, F.col("c")).alias("flow"), F.when(moved, F.coalesce("n_inlier", F.lit(0))).otherwise(0).cast("long").alias("n_ground"))


def verify_revisits(matches: DataFrame, key: str = "pair", trials: int = 512, seed: int = 7) -> DataFrame:
    """(key, inliers, verdict) of each candidate pair's point matches (key, point, x, y, x2, y2).

    Inliers are the most matches that one projective map carries over within 5 px; fewer than 15 matches have none.
    From 40 on it is a revisit, from 22 a maybe, else no.
    """
    kind = matches.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [homography_inliers(p[:, :2], p[:, 2:], trials=trials, seed=seed) if len(p := _points(batch.column(1), row)) >= LEAST_MATCHES else 0 for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [key, "inliers"])

    out = _groups(matches, key).mapInArrow(run, f"{key} {kind.simpleString()}, inliers long")
    return out.withColumn("verdict", F.when(F.col("inliers") >= REVISIT, "revisit").when(F.col("inliers") >= MAYBE, "maybe").otherwise("no"))


def good_matches(candidates: DataFrame, key: str = "pair", ratio: float = 0.75) -> DataFrame:
    """Rows of candidates(key, point, other, distance, ...) whose distance is below ``ratio`` times that to the point's next
    best other; a point with one candidate has no next best and is left out. The smaller ``other`` of equals."""
    w = Window.partitionBy(key, "point").orderBy("distance", "other")
    ranked = candidates.withColumns({"_k": F.row_number().over(w), "_next": F.lead("distance").over(w)})
    return ranked.where((F.col("_k") == 1) & (F.col("distance") < F.col("_next") * ratio)).drop("_k", "_next")
