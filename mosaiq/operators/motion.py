"""Motion features: joint angles, their velocities, and histograms of both by record."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import density, quantize, series

# Fixed values of the features: the marker that each joint turns from, and the marker that it turns to.
JOINTS = (
    ("left_shoulder", "left_elbow"),
    ("left_elbow", "left_hand"),
    ("torso", "left_hip"),
    ("left_hip", "left_knee"),
    ("left_knee", "left_foot"),
    ("right_shoulder", "right_elbow"),
    ("right_elbow", "right_hand"),
    ("torso", "right_hip"),
    ("right_hip", "right_knee"),
    ("right_knee", "right_foot"),
)


def joint_angles(motion: DataFrame, joints: tuple[tuple[str, str], ...] = JOINTS) -> DataFrame:
    """``record_id, t, dof, angle`` of ``motion(record_id, t, marker, qx, qy, qz, qw)``: three angles a joint.

    A frame's markers meet in one map, one shuffle for all joints; a joint without one of its markers
    has null angles.
    """
    q = V.quaternion(*(F.col(f"q{c}") for c in "xyzw"))
    frames = motion.groupBy("record_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("marker", q))).alias("at"))
    pairs = F.array(*(F.struct(F.lit(3 * k).alias("dof"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(joints)))
    turns = frames.select("record_id", "t", "at", F.explode(pairs).alias("p"))
    turns = turns.select("record_id", "t", "p.dof", F.element_at("at", F.col("p.a")).alias("a"), F.element_at("at", F.col("p.b")).alias("b"))
    turns = turns.select("record_id", "t", "dof", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), V.turn_angles(F.col("a"), F.col("b"))).alias("e"))
    each = F.array(*(F.struct((F.col("dof") + k).alias("dof"), F.col(f"e.{c}").alias("angle")) for k, c in enumerate(("ax", "ay", "az"))))
    return turns.select("record_id", "t", F.inline(each))


def with_velocities(angles: DataFrame, delay: int = 1) -> DataFrame:
    """Adds ``velocity``: an angle minus the one ``delay`` frames before, which counts as 0 where there is none."""
    v = angles.withColumn("__key", F.struct("record_id", "dof"))
    return v.withColumn("velocity", series.delayed_velocities("angle", delay, "__key", "t")).drop("__key")


def _bounded(df: DataFrame, column: str, bounds: tuple[float, float] | None) -> tuple[DataFrame, tuple[float, float]]:
    if bounds is None:
        r = df.agg(F.min(column), F.max(column)).first()
        return df, (float(r[0] or 0.0), float(r[1] or 0.0))
    return df.withColumn(column, V.clip(F.col(column), *map(float, bounds))), bounds


def binned_histograms(motion: DataFrame, bins: int = 16, bounds: tuple[float, float] | None = None, vel_bounds: tuple[float, float] | None = None, width: float = 0.3, joints: tuple[tuple[str, str], ...] = JOINTS) -> DataFrame:
    """``record_id, dof, bin_x, bin_y, density``: each record's density over angle and velocity, by joint angle.

    The grid has the square root of ``bins`` steps a side; the kernel is ``width`` times the range wide.
    Values beyond given bounds count at the bounds; else the bounds are those of all records.
    """
    df, (a0, a1) = _bounded(with_velocities(joint_angles(motion, joints)), "angle", bounds)
    df, (v0, v1) = _bounded(df, "velocity", vel_bounds)
    side = math.isqrt(bins)
    a1, v1 = a1 if a1 > a0 else a0 + 1, v1 if v1 > v0 else v0 + 1
    cells = density.bins2d(df, "angle", "velocity", (a0, a1, v0, v1), side, ("record_id", "dof"))
    weights = {"bin_x": density.kernel((a1 - a0) / side, width * (a1 - a0)), "bin_y": density.kernel((v1 - v0) / side, width * (v1 - v0))}
    return density.smooth(cells, ["bin_x", "bin_y"], weights, side, groups=("record_id", "dof"))


def quantized_histograms(motion: DataFrame, codes: int = 16, soft: float | None = None, seed: int = 0, joints: tuple[tuple[str, str], ...] = JOINTS, starts: int = 20) -> DataFrame:
    """``record_id, dof, code, share``: how a record's angles and velocities fall to the codes of each joint angle's codebook.

    Both are divided by their deviation over all records; the shares of a record sum to 1 over all joint
    angles. The codebooks are the best of ``starts`` k-means each, of all joint angles in the same readings of the
    points. ``soft`` weighs codes by distance instead of counting the nearest.
    """
    df = with_velocities(joint_angles(motion, joints)).filter("angle IS NOT NULL")
    scaled = [(F.col(c) / F.coalesce(F.nullif(d, F.lit(0.0)), F.lit(1.0))) for c, d in ((c, F.col(f"__{c}")) for c in ("angle", "velocity"))]
    deviations = df.groupBy("dof").agg(*(F.stddev_pop(c).alias(f"__{c}") for c in ("angle", "velocity")))
    points = df.join(deviations, "dof").select("record_id", "dof", F.array(*scaled).alias("v")).checkpoint()
    books, _ = quantize.keyed_kmeans(points, "dof", codes, starts, seed=seed)
    got = quantize.keyed_assign(points, "dof", books, soft).groupBy("record_id", "dof", "code").agg(F.sum("weight").alias("weight"))
    return got.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("record_id"))).select("record_id", "dof", "code", "share")
