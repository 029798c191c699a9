"""Joint and axis geometry on coordinates held in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteval.constants import JOINTS, KEYPOINTS, MIRROR
from siteval.runtime import bound


def _dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _median3(v: Column) -> Column:
    """Median of a short sorted array (at most three entries)."""
    n = F.size(v)
    return F.when(n == 3, v[1]).when(n == 2, (v[0] + v[1]) / 2).when(n == 1, v[0])


def torso_length(sites: Column) -> Column:
    """Distance from mid-shoulder to mid-hip. ``sites``: map site -> map joint -> struct(x, y, ...)."""
    def mid(a, b, joint, axis):
        return (sites[a][joint][axis] + sites[b][joint][axis]) / 2

    return _dist(mid("LUE", "RUE", "shoulder", "x"), mid("LUE", "RUE", "shoulder", "y"),
                 mid("LLE", "RLE", "hip", "x"), mid("LLE", "RLE", "hip", "y"))


def kp_error(xy: Column, score: Column, joints: Column, site: str, min_score: float = 0.3) -> Column:
    """Keypoint error of one site: struct(err_torso, n_joints, side_swap); NULL when it cannot be measured. Inputs, errors and torso are each
    worked out once per row."""
    def errors(xy, score, joints):
        own, opposite = [], []
        for idx, joint in zip(KEYPOINTS[site], JOINTS[site[1:]]):
            a, b = joints[site][joint], joints[MIRROR[site]][joint]
            use = a.isNotNull() & a["visible"] & (score[idx] >= min_score)
            own.append(F.when(use, _dist(xy[idx][0], xy[idx][1], a["x"], a["y"])))
            far = F.when(b.isNotNull(), _dist(xy[idx][0], xy[idx][1], b["x"], b["y"])).otherwise(F.lit(float("inf")))
            opposite.append(F.when(use, far))
        return F.struct(F.array_sort(F.array_compact(F.array(*own))).alias("own"), F.array_sort(F.array_compact(F.array(*opposite))).alias("opposite"), torso_length(joints).alias("torso"))

    def judged(e):
        err = _median3(e["own"]) / F.greatest(e["torso"], F.lit(1.0))
        return F.when(e["torso"].isNotNull() & (F.size(e["own"]) > 0), F.struct(
            err.alias("err_torso"), F.size(e["own"]).alias("n_joints"), (_median3(e["opposite"]) < _median3(e["own"])).alias("side_swap")))

    return bound(F.struct(xy.alias("xy"), score.alias("score"), joints.alias("joints")), lambda v: bound(errors(v["xy"], v["score"], v["joints"]), judged))


def joint_state(exists: Column, in_frame: Column, visible: Column) -> Column:
    return (F.when(~exists, "absent").when(~in_frame, "out_of_frame").when(visible, "visible").otherwise("occluded"))


def laterality_swap(pred: Column, own: Column, opposite: Column, min_conf: float = 0.3, ratio: float = 0.6) -> Column:
    """True when the detected joints lie clearly closer to the joints of the other side. Arrays of structs in joint order."""
    near = far = F.lit(0.0)
    n = F.lit(0)
    for i in range(3):
        use = pred[i]["conf"] >= min_conf
        near = near + F.when(use, _dist(pred[i]["x"], pred[i]["y"], own[i]["x"], own[i]["y"])).otherwise(0.0)
        far = far + F.when(use, _dist(pred[i]["x"], pred[i]["y"], opposite[i]["x"], opposite[i]["y"])).otherwise(0.0)
        n = n + use.cast("int")
    return F.coalesce((n > 0) & (far < near * ratio), F.lit(False))


def axis_error(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle in degrees between two unit vectors."""
    dot = ax * bx + ay * by
    return F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))
