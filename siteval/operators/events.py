"""Predictions as an append-only event log, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import AMPUTATION, NO_INJURY, NOT_TESTABLE, VIEW_OF, WOUND
from siteval.functions import probs as P
from siteval.functions.labels import class_name
from siteval.functions.text import encounter_id
from siteval.operators.documents import body_of
from siteval.runtime import bound, case, lookup


def view_of(facing: Column) -> Column:
    return F.coalesce(lookup(facing, VIEW_OF), F.lit("unknown"))


def _unit(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 4)


def site_events(rows: DataFrame, key: str = "image_id", p: str = "p") -> DataFrame:
    """Events of every site: one visibility event, and one injury event where the site is visible.

    Rows whose probabilities are not a distribution are refused by ``rejected_probs`` before this point."""
    prob, k = F.col(p), P.argmax(F.col(p))
    visible = k != NOT_TESTABLE
    region, side = body_of(F.col("site"))
    low = F.lower("site")
    null = F.lit(None).cast("string")
    vis = F.struct(F.concat(F.lit("vis-"), low).alias("event_id"), F.lit("site_visibility").alias("type"), F.lit("present").alias("assertion"),
                   visible.alias("visible"), null.alias("injury_class"), null.alias("source_label"),
                   _unit(F.when(visible, 1 - prob[NOT_TESTABLE]).otherwise(prob[NOT_TESTABLE])).alias("confidence"))
    injury = F.struct(F.concat(F.lit("inj-"), low).alias("event_id"), F.lit("injury").alias("type"), F.when(k == NO_INJURY, "absent").otherwise("present").alias("assertion"),
                      F.lit(None).cast("boolean").alias("visible"), case([(k == AMPUTATION, "amputation"), (k == WOUND, "other")], F.lit("none")).alias("injury_class"),
                      F.when(k == WOUND, "wound").alias("source_label"), _unit(F.greatest(*[prob[i] for i in range(4)])).alias("confidence"))
    ev = F.explode(F.when(visible, F.array(vis, injury)).otherwise(F.array(vis)))
    flat = rows.select(key, "site", region.alias("body_region"), side.alias("laterality"), ev.alias("_e"))
    return flat.select(encounter_id(F.col(key).cast("string")).alias("encounter"), F.col(key).cast("string").alias("source"), "site", "body_region", "laterality", "_e.*")


def state_events(images: DataFrame, key: str = "image_id", facing: str = "facing", conf: str = "facing_conf", orientation: str | None = None) -> DataFrame:
    """One casualty-state event per image: view and orientation, unknown when neither is known."""
    view = view_of(F.col(facing))
    orient = F.coalesce(F.col(orientation), F.lit("unknown")) if orientation else F.lit("unknown")
    known = (view != "unknown") | (orient != "unknown")
    return images.select(
        encounter_id(F.col(key).cast("string")).alias("encounter"), F.lit("cs").alias("event_id"), F.lit("casualty_state").alias("type"),
        F.when(known, "present").otherwise("unknown").alias("assertion"), view.alias("view_of"), orient.alias("orientation"),
        F.when(known & F.col(conf).isNotNull(), _unit(F.col(conf))).otherwise(0.0).alias("confidence"))


def rejected_probs(rows: DataFrame, key: str = "image_id", p: str = "p") -> DataFrame:
    """Sites whose probabilities are not a four-class distribution."""
    return rows.filter(~P.check_probs(F.col(p))).select(key, "site")


def live_events(log: DataFrame, keys=("encounter",)) -> DataFrame:
    """Events that no later event supersedes or retracts, retractions themselves left out.

    log: keys, event_id, type, seq, supersedes, retracts. The killing references are gathered to one distinct set and
    anti-joined once."""
    killed = log.select(*keys, F.explode(F.array_compact(F.array("supersedes", "retracts"))).alias("event_id")).distinct()
    return log.filter("type <> 'retraction'").join(killed, [*keys, "event_id"], "left_anti")


def events_to_classes(log: DataFrame, keys=("encounter", "site"), scope=("encounter",)) -> DataFrame:
    """Class of every site from its live events: latest visibility 'false' means not_testable, else the latest live injury
    decides, else a visible site has no injury.

    Latest is a max_by over integers: hash aggregation with partial results, whatever the length of a log."""
    live = live_events(log, scope)
    code = lookup(F.col("injury_class"), {"none": NO_INJURY, "other": WOUND, "amputation": AMPUTATION}, F.lit(NO_INJURY))
    is_vis, is_injury = F.col("type") == "site_visibility", F.col("type") == "injury"
    per = live.groupBy(*keys).agg(
        F.max_by(F.when(is_vis, F.col("visible").cast("int")), F.when(is_vis, F.col("seq"))).alias("_v"),
        F.max_by(F.when(is_injury, code), F.when(is_injury, F.col("seq"))).alias("_i"))
    cls = F.when(F.coalesce(F.col("_v"), F.lit(0)) == 0, F.lit(NOT_TESTABLE)).otherwise(F.coalesce(F.col("_i"), F.lit(NO_INJURY)))
    return per.select(*keys, cls.alias("y"), class_name(cls).alias("class"))


def as_log(events: DataFrame) -> DataFrame:
    """Freshly written site events in log form (no corrections yet)."""
    return events.select("encounter", "site", "event_id", "type", F.lit(0).cast("long").alias("seq"), "visible", "injury_class",
                         F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("retracts"))


def break_ties(p: Column, pred: Column, bump: float = 1e-6) -> Column:
    """Nudge the predicted class up where it ties for the maximum, then renormalise.

    Vector, maximum, tie, moved vector and total are each bound to a name: written out inside the functions over the elements they
    would be worked out anew for every element, and the next step for every element of that."""
    def tied(p, top):
        return (F.aggregate(F.filter(p, lambda v: v == top), F.lit(0), lambda a, _: a + 1) > 1) & (F.element_at(p, pred + 1) == top)

    def moved(p, tie):
        return F.transform(p, lambda v, i: F.when(tie & (i == pred), v + bump).otherwise(v))

    def shares(moved):
        return bound(F.aggregate(moved, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(moved, lambda v: v / total))

    return bound(p, lambda p: bound(F.greatest(*[p[i] for i in range(4)]), lambda top: bound(tied(p, top), lambda tie: bound(moved(p, tie), shares))))


def round_trip_check(rows: DataFrame, key: str = "scene") -> DataFrame:
    """Ledger rows (key, site, p rounded, pred) through events and back: sites, mismatches."""
    fixed = rows.withColumn("p", break_ties(F.col("p"), F.col("pred"))).withColumn("image_id", F.concat(F.col(key).cast("string"), F.lit(".jpg")))
    back = events_to_classes(as_log(site_events(fixed))).select("encounter", "site", F.col("y").alias("_y"))
    want = fixed.select(encounter_id(F.col("image_id")).alias("encounter"), "site", "pred")
    j = want.join(back, ["encounter", "site"], "left")
    wrong = ~F.coalesce(F.col("_y") == F.col("pred"), F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("sites"), F.count_if(wrong).alias("mismatches"))


def event_counts(log: DataFrame, column: str = "type") -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
