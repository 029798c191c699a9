"""Hand-written decision rules over one site's measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteval.constants import AMPUTATION, NO_INJURY, NOT_TESTABLE, WOUND
from siteval.runtime import case, total

# Fixed values. Thresholds of the rules.
MIN_VIS_PX = 30
MIN_WOUND_PX = 20
BG_AMPUTATED = 0.60
LENGTH_AMPUTATED = 0.75
LENGTH_VISIBLE = 0.10
MIN_STUMP_PX = 30


def hand_rule(vis_px: Column, p_end: Column, p_wound: Column, wound_px: Column) -> Column:
    return case([
        ((vis_px < MIN_VIS_PX) | p_end.isNull(), NOT_TESTABLE),
        (p_end[1] > 0.5, AMPUTATION),
        (F.coalesce(p_wound[1] > 0.5, F.lit(False)) | (wound_px >= MIN_WOUND_PX), WOUND),
    ], F.lit(NO_INJURY))


def rule_area(vis_px: Column, bg_frac: Column, length: Column) -> Column:
    """Visible area, background share past the end, and relative limb length."""
    return case([
        (vis_px < MIN_VIS_PX, NOT_TESTABLE),
        ((bg_frac >= BG_AMPUTATED) & (length < LENGTH_AMPUTATED), AMPUTATION),
        (length >= LENGTH_VISIBLE, NO_INJURY),
    ], F.lit(NOT_TESTABLE))


def rule_presence(vis_px: Column, bg_frac: Column, length: Column, present: Column) -> Column:
    """As rule_area, but a detected extremity rules an amputation out."""
    return case([
        (vis_px < MIN_VIS_PX, NOT_TESTABLE),
        (~present & (bg_frac >= BG_AMPUTATED), AMPUTATION),
        (length >= LENGTH_VISIBLE, NO_INJURY),
    ], F.lit(NOT_TESTABLE))


def rule_stump_override(vis_px: Column, bg_frac: Column, length: Column, present: Column, stump_px: Column,
                        min_stump: int = MIN_STUMP_PX) -> Column:
    """A visible stump decides; otherwise rule_presence."""
    return F.when((vis_px >= MIN_VIS_PX) & (stump_px >= min_stump), F.lit(AMPUTATION)).otherwise(
        rule_presence(vis_px, bg_frac, length, present))


def rule_absence(vis_px: Column, length: Column, absent: Column) -> Column:
    """A classifier's 'extremity absent' decides."""
    return case([
        (vis_px < MIN_VIS_PX, NOT_TESTABLE),
        (absent, AMPUTATION),
        (length >= LENGTH_VISIBLE, NO_INJURY),
    ], F.lit(NOT_TESTABLE))


def rule_keypoints(joints: Column, t_det: float, t_amp: float, width: int, height: int) -> Column:
    """``joints``: four (x, y, conf) structs, proximal to extremity."""
    def inside(j):
        return (j["x"] >= 0) & (j["x"] < width) & (j["y"] >= 0) & (j["y"] < height)

    found = [(joints[i]["conf"] >= t_det) & inside(joints[i]) for i in range(4)]
    any_found = found[0] | found[1] | found[2] | found[3]
    tip = joints[3]
    return case([
        (~any_found, NOT_TESTABLE),
        (found[0] & inside(tip) & (tip["conf"] < t_amp), AMPUTATION),
    ], F.lit(NO_INJURY))


def front_share_facing(front_px: Column, torso_px: Column) -> tuple[Column, Column]:
    """Facing and confidence from front and total torso pixel counts; NULL counts mean no body frame."""
    share = front_px / F.greatest(torso_px, F.lit(1))
    facing = F.when(share.isNotNull(), F.when(share > 0.5, "front").otherwise("back"))
    return facing, F.greatest(share, 1 - share)


def confuser_conditions(tourniquet: Column, wound_true: Column, amp_true: Column, y: Column, sleeve: Column,
                        boots: Column, at_end: Column, vf: Column, stump_px: Column, occluder: Column) -> Column:
    """Names of every condition a row meets (a row may meet many); occluder values add one name each."""
    unhurt = y == NO_INJURY
    named = [
        ("all", F.lit(True)),
        ("tourniquet_on_limb", tourniquet),
        ("tourniquet_and_hidden_wound", tourniquet & wound_true & unhurt),
        ("hidden_wound_no_tq", ~tourniquet & wound_true & unhurt),
        ("no_tq_no_wound_true", ~tourniquet & ~wound_true & ~amp_true),
        ("sleeve_or_trouser_long", sleeve == "long"),
        ("bare_limb", sleeve == "none"),
        ("boots", boots),
        ("occluder_aimed_at_limb_end", at_end),
        ("foreshortened_vf<0.5_no_stump", (vf < 0.5) & (stump_px == 0)),
    ]
    names = [F.when(c, F.lit(n)) for n, c in named] + [F.concat(F.lit("occluder="), occluder)]
    return F.array_compact(F.array(*names))


def lying_score(boxes: Column, width: Column, height: Column) -> Column:
    """Score of every detected person; largest wins. ``boxes``: array of structs x1,y1,x2,y2, shoulder/hip/ankle
    mid-points (sx,sy,hx,hy,ax,ay) and mean keypoint confidence. Terms: size, centrality, leg extension, confidence,
    minus uprightness."""
    # Fixed values. Term weights and scales.
    w_centre, w_extent, w_conf, w_upright = 0.7, 0.8, 0.3, 0.3
    corner, extent_full = 0.7071, 1.5

    def area(b):
        return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])

    biggest = F.array_max(F.transform(boxes, area))

    def clip01(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    def score(b):
        cx = (b["x1"] + b["x2"]) / 2 / width - 0.5
        cy = (b["y1"] + b["y2"]) / 2 / height - 0.5
        centre = 1 - clip01(F.sqrt(cx * cx + cy * cy) / corner)
        torso = F.sqrt((b["sx"] - b["hx"]) * (b["sx"] - b["hx"]) + (b["sy"] - b["hy"]) * (b["sy"] - b["hy"])) + 1e-6
        legs = F.sqrt((b["ax"] - b["hx"]) * (b["ax"] - b["hx"]) + (b["ay"] - b["hy"]) * (b["ay"] - b["hy"]))
        extent = clip01(legs / torso / extent_full)
        upright = clip01(-(b["sy"] - b["hy"]) / torso)
        return total([area(b) / F.greatest(biggest, F.lit(1e-6)), centre * w_centre, extent * w_extent,
                      b["conf"] * w_conf, upright * -w_upright])

    return F.transform(boxes, score)
