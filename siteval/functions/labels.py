"""Label rules: from measured truth to one of four classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteval.constants import (AMPUTATION, CLASSES, LABEL_RULES, MIRROR, NO_INJURY, NOT_TESTABLE, STUMP_MIN_PX,
                               VISIBILITY_BANDS, WOUND, WOUND_MIN_PX)
from siteval.runtime import case, lookup


def rule_class(vf: Column, amputated: Column, stump_px: Column, cause: Column, wound_present: Column, wound_px: Column,
               cut: Column, wound_rule: Column, amp_rule: Column) -> Column:
    """Class index of one site under a rule given as columns, so that one pass can score many rules."""
    visible = F.when(cut == 0, vf > 0).otherwise(vf >= cut)
    observable = (amp_rule == "any") | (stump_px >= STUMP_MIN_PX) | F.coalesce(cause == "amputated_visible", F.lit(False))
    wound = wound_present & ((wound_rule == "present") | (wound_px >= WOUND_MIN_PX))
    return case([
        (~F.coalesce(visible, F.lit(False)), NOT_TESTABLE),
        (amputated & observable, AMPUTATION),
        (amputated, NOT_TESTABLE),
        (wound, WOUND),
    ], F.lit(NO_INJURY))


def threshold_class(vf: Column, amputated: Column, wound_present: Column, wound_px: Column, cut: Column,
                    wound_if_present: bool = False) -> Column:
    """The rule without the observability test, with an optional wound-if-present variant."""
    visible = F.when(cut == 0, vf > 0).otherwise(vf >= cut)
    wound = wound_present if wound_if_present else wound_present & (wound_px >= WOUND_MIN_PX)
    return case([
        (~F.coalesce(visible, F.lit(False)), NOT_TESTABLE),
        (amputated, AMPUTATION),
        (wound, WOUND),
    ], F.lit(NO_INJURY))


def rules_array(rules: dict = LABEL_RULES) -> Column:
    """The rule registry as one literal array of structs: explode it to score every rule in one pass."""
    return F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(float(c)).alias("cut"), F.lit(w).alias("wound_rule"),
                              F.lit(a).alias("amp_rule")) for n, (c, w, a) in rules.items()])


def mirror_site(site: Column) -> Column:
    """The site on the other side of the body."""
    return lookup(site, MIRROR)


def swap_sites(values: Column) -> Column:
    """Exchange left and right in an array held in site order."""
    return F.array(values[1], values[0], values[3], values[2])


def class_index(name: Column) -> Column:
    """Class name to index; NULL for anything that is not a class."""
    return lookup(name, {c: i for i, c in enumerate(CLASSES)})


def class_name(index: Column) -> Column:
    return lookup(index, dict(enumerate(CLASSES)))


def reading(label: Column, visible: Column, mode: str = "as_labeled") -> Column:
    """A reader's class under a reading mode; 'threshold' turns 'under 10%' visibility into not_testable."""
    known = F.when(label.isin(*CLASSES), label)
    if mode == "as_labeled":
        return known
    if mode != "threshold":
        raise ValueError(f"unknown reading {mode!r}")
    return F.when(known.isNotNull() & (visible == "under 10%"), F.lit("not_testable")).otherwise(known)


def visibility_band(vf: Column, bands=VISIBILITY_BANDS, top: str = ">=0.50") -> Column:
    return case([(vf < edge, name) for edge, name in bands], F.lit(top))


def clothed(top: Column, bottom: Column) -> Column:
    """True when the garment of either half is present; missing garments count as none."""
    return (F.coalesce(top, F.lit("none")) != "none") | (F.coalesce(bottom, F.lit("none")) != "none")


def is_upper(site: Column) -> Column:
    return site.endswith("UE")
