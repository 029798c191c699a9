"""Parameter tables of synthetic scenes: exact quotas, cycles, hashed draws, pairs and conditional overlays.

Draws are hashes of (seed, name, id), so a scene's parameters do not depend on how the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.constants import SITES
from siteval.functions.hashing import key_text, uniform
from siteval.operators.metrics import share_if
from siteval.operators.ordering import hash_rank
from siteval.runtime import case

# Fixed values. Parameter vocabularies.
POSITIONS = ("supine", "prone", "left_lateral", "right_lateral", "semi_seated")
LIMB_POSES = ("neutral", "abducted", "arm_across", "knee_bent", "arm_overhead")
AZIMUTHS = (0, 45, 90, 135, 180, 225, 270, 315)
ELEVATIONS = (85, 60, 45, 30, 15)
LEVELS = ("disarticulation", "above_joint", "below_joint", "distal")
AMPUTATION_MIX = (("none", 0.4), ("single", 0.4), ("double", 0.2))
OCCLUDER_MIX = (("none", 0.4), ("blanket", 0.15), ("gear_bag", 0.15), ("strap", 0.15), ("medic_arm", 0.15))
FRAMING_MIX = (("full", 0.6), ("upper_crop", 0.134), ("lower_crop", 0.133), ("off_center", 0.133))
WOUND_COUNTS = ((0, 0.35), (1, 0.45), (2, 0.20))
TOP_MIX = (("none", 0.25), ("short", 0.25), ("long", 0.5))
BOTTOM_MIX = (("none", 0.15), ("shorts", 0.25), ("long", 0.6))
BYSTANDERS = ((0, 0.2), (1, 0.45), (2, 0.35))
LOOKS = ("AgX - Punchy", "AgX - High Contrast", "AgX - Medium High Contrast")
CONFUSERS = ("treatment_cue_without_visible_injury", "tq_no_wound", "hidden_wound", "occluded_end", "crossing_limbs")
CHECK_AMPUTATIONS = (("none", 8), ("single", 8), ("double", 4))
CHECK_FRAMINGS = (("full", 12), ("upper_crop", 3), ("lower_crop", 3), ("off_center", 2))
CHECK_OCCLUDERS = (("none", 8), ("blanket", 3), ("gear_bag", 3), ("strap", 3), ("medic_arm", 3))
CHECK_ELEVATIONS = (85, 45, 45, 15)

# Fixed values. Paired scenes: id, factor, and the overrides shared by both members, of member a and of member b.
PAIR_BASE = {"body_position": "supine", "limb_pose": "abducted", "occluder": "none", "occ_target": None, "occ_site": None,
             "framing": "full", "elevation": "60", "amputation": None, "wound": None, "wound_surface": None, "tourniquet": None}
PAIRS = (
    ("P01", "amputation_supine", {}, {}, {"amputation": "RLE:below_joint"}),
    ("P02", "amputation_prone", {"body_position": "prone"}, {}, {"amputation": "LUE:below_joint"}),
    ("P03", "occluder_intact_limb_end", {"limb_pose": "neutral"}, {"occluder": "medic_arm", "occ_target": "limb_end", "occ_site": "LUE"}, {}),
    ("P04", "occluder_amputated_limb_end", {"amputation": "RUE:below_joint", "limb_pose": "neutral"}, {"occluder": "gear_bag", "occ_target": "limb_end", "occ_site": "RUE"}, {}),
    ("P05", "wound_visible_vs_hidden", {"wound": "LUE:laceration"}, {"wound_surface": "LUE:front"}, {"wound_surface": "LUE:back"}),
    ("P06", "tourniquet_wound_visible_vs_hidden", {"wound": "LLE:laceration", "tourniquet": "LLE"}, {"wound_surface": "LLE:front"}, {"wound_surface": "LLE:back"}),
    ("P07", "treatment_cue_without_visible_injury", {}, {"tourniquet": "RUE"}, {}),
    ("P08", "lateral_views", {"limb_pose": "knee_bent"}, {"body_position": "left_lateral"}, {"body_position": "right_lateral"}),
    ("P09", "mirror_laterality", {"limb_pose": "neutral"}, {"amputation": "LUE:below_joint", "wound": "LLE:burn"}, {"amputation": "RUE:below_joint", "wound": "RLE:burn"}),
    ("P10", "out_of_frame", {"amputation": "LLE:above_joint"}, {"framing": "full"}, {"framing": "upper_crop"}),
)


def quota_mix(df: DataFrame, key: str, spec, out: str, seed=0, exact_counts: bool = False) -> DataFrame:
    """Assign values in exact rounded quotas, in hashed order; rows left over by rounding get the first value."""
    ranked = hash_rank(df, F.md5(key_text(seed, out, F.col(key))), "_r")
    n = df.agg(F.count(F.lit(1))).scalar()
    ranked = ranked.withColumn("_n", n)
    upper, arms = F.lit(0), []
    for value, share in spec:
        upper = upper + (F.lit(int(share)) if exact_counts else F.bround(F.col("_n") * F.lit(float(share))))
        arms.append((F.col("_r") <= upper, value))
    return ranked.withColumn(out, case(arms, F.lit(spec[0][0]))).drop("_r", "_n")


def cycle(index: Column, values) -> Column:
    """Values in turn: index modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def categorical(spec, *key) -> Column:
    """Weighted draw from (value, probability) pairs."""
    u, upper, arms = uniform(*key), 0.0, []
    for value, p in spec[:-1]:
        upper += p
        arms.append((u < upper, value))
    return case(arms, F.lit(spec[-1][0]))


def choose(values, *key) -> Column:
    """Uniform draw from a list."""
    k = (F.floor(uniform(*key) * len(values)) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), k)


def choose_k(values: Column, k: Column, *key) -> Column:
    """k distinct entries of an array, in hashed order."""
    tagged = F.array_sort(F.transform(values, lambda v: F.struct(F.md5(F.concat_ws("|", key_text(*key), v)).alias("h"), v.alias("v"))))
    return F.transform(F.slice(tagged, F.lit(1), F.least(k, F.size(values))), lambda s: s["v"])


def base_params(ids: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """Body, camera, occluder and amputation parameters for every id (0-based integers)."""
    k = F.col(key)
    d = quota_mix(ids.select(key), key, AMPUTATION_MIX, "amputation_kind", seed)
    d = quota_mix(d, key, OCCLUDER_MIX, "occluder", seed)
    d = quota_mix(d, key, FRAMING_MIX, "framing", seed)
    n_amp = case([(F.col("amputation_kind") == "single", 1), (F.col("amputation_kind") == "double", 2)], F.lit(0))
    sites = F.array(*[F.lit(s) for s in SITES])
    d = d.withColumn("amputated", choose_k(sites, n_amp, seed, "amp", k))
    d = d.withColumn("amputations", F.map_from_arrays("amputated", F.transform("amputated", lambda s, i: cycle(k + i, LEVELS))))
    return d.select(key, (F.lit(seed * 10) + k).alias("seed"), cycle(k, POSITIONS).alias("body_position"), choose(LIMB_POSES, seed, "pose", k).alias("limb_pose"),
                    F.floor(uniform(seed, "yaw", k) * 360).cast("int").alias("body_yaw"), "amputations", "occluder", "framing", cycle(k, AZIMUTHS).alias("azimuth"), cycle(k, ELEVATIONS).alias("elevation"))


def wound_params(d: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """Wounds on free sites, garments, and tourniquets on injured sites; needs amputations and occluder."""
    k = F.col(key)
    free = F.filter(F.array(*[F.lit(s) for s in SITES]), lambda s: ~F.map_contains_key("amputations", s))
    d = d.withColumn("wounded", choose_k(free, categorical(WOUND_COUNTS, seed, "nw", k), seed, "wound", k))
    kinds = ("laceration", "penetrating", "burn", "open_fracture")
    d = d.withColumn("wounds", F.map_from_arrays("wounded", F.transform("wounded", lambda s: choose(kinds, seed, "kind", k, s))))
    bottom = categorical(BOTTOM_MIX, seed, "bottom", k)
    d = d.withColumn("bottom", bottom).withColumn("garments", F.struct(
        categorical(TOP_MIX, seed, "top", k).alias("top"), F.col("bottom"), (uniform(seed, "boots", k) < F.when(F.col("bottom") == "long", 0.5).otherwise(0.25)).alias("boots")))
    injured = F.concat(F.map_keys("amputations"), F.col("wounded"))
    d = d.withColumn("tourniquets", F.slice(F.filter(injured, lambda s: uniform(seed, "tq", k, s) < 0.5), 1, 2))
    aimed = F.col("occluder").isin("gear_bag", "medic_arm") & (uniform(seed, "aim", k) < 0.5)
    return d.withColumn("occ_target", F.when(aimed, "limb_end")).drop("wounded", "bottom")


def closeup_mix(d: DataFrame, key: str = "id", seed: int = 0, share: float = 1 / 3, smear: float = 0.08) -> DataFrame:
    """A share of scenes framed on one limb (an injured one half the time), and blood smears on intact limbs."""
    k = F.col(key)
    sites = F.array(*[F.lit(s) for s in SITES])
    injured = F.array_union(F.map_keys("amputations"), F.map_keys("wounds"))
    close = uniform(seed, "close", k) < share
    focus = F.when((F.size(injured) > 0) & (uniform(seed, "inj", k) < 0.5), choose_k(injured, F.lit(1), seed, "fi", k)[0]).otherwise(choose_k(sites, F.lit(1), seed, "fa", k)[0])
    clean = F.filter(sites, lambda s: ~F.array_contains(injured, s) & ~F.array_contains("tourniquets", s))
    dropped = close & (F.col("occluder") != "none") & (uniform(seed, "drop", k) < 0.75)
    d = d.withColumn("closeup_site", F.when(close, focus)).withColumn("closeup_dist", F.when(close, F.round(0.25 + uniform(seed, "dist", k) * 0.25, 3)))
    d = d.withColumn("framing", F.when(close, "limb_closeup").otherwise(F.col("framing"))).withColumn("_drop", dropped)
    d = d.withColumn("occluder", F.when(F.col("_drop"), "none").otherwise(F.col("occluder"))).withColumn("occ_target", F.when(~F.col("_drop"), F.col("occ_target"))).drop("_drop")
    return d.withColumn("blood_smear", F.when((F.size(clean) > 0) & (uniform(seed, "smear", k) < smear), choose_k(clean, F.lit(1), seed, "sm", k)[0])).withColumn("wound_style", F.lit("v2"))


def scene_mix(d: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """The fuller mix: fewer close-ups, mostly supine, contrast looks, bystanders and blood pools."""
    k = F.col(key)
    d = closeup_mix(d, key, seed, share=0.2)
    injured = F.array_union(F.map_keys("amputations"), F.map_keys("wounds"))
    agx = uniform(seed, "view", k) < 0.5
    extra = F.when(uniform(seed, "pool+", k) < 0.1, F.array(choose(SITES, seed, "poolsite", k))).otherwise(F.array().cast("array<string>"))
    pools = F.array_sort(F.array_distinct(F.concat(F.filter(injured, lambda s: uniform(seed, "pool", k, s) < 0.5), extra)))
    return d.select(
        *[c for c in d.columns if c not in ("body_position", "wound_style")],
        F.when(uniform(seed, "supine", k) < 0.7, "supine").otherwise(F.col("body_position")).alias("body_position"), F.lit("v3").alias("wound_style"), F.lit("v3").alias("gen"),
        F.when(agx, "AgX").otherwise("Standard").alias("view"), F.when(agx, choose(LOOKS, seed, "look", k)).alias("look"), F.round(uniform(seed, "boost", k) * 2 + 1.5, 3).alias("light_boost"),
        categorical(BYSTANDERS, seed, "nb", k).alias("bystanders"), pools.alias("blood_pool"), (uniform(seed, "camo", k) < 0.5).alias("camo"), (uniform(seed, "soak", k) < 0.5).alias("soak"))


def challenge_mix(d: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """One confuser per scene, in turn, applied to a free limb."""
    k = F.col(key)
    flag = cycle(k, CONFUSERS)
    free = F.filter(F.array(*[F.lit(s) for s in SITES]), lambda s: ~F.map_contains_key("amputations", s))
    site = choose_k(free, F.lit(1), seed, "confuse", k)[0]
    others = F.map_filter("wounds", lambda s, _: s != F.col("_site"))
    hidden = F.col("_flag").isin("treatment_cue_without_visible_injury", "hidden_wound")
    d = d.withColumn("_flag", flag).withColumn("_site", site)
    wounds = F.when(hidden, F.map_concat(others, F.create_map(F.col("_site"), F.lit("penetrating")))).when(F.col("_flag") == "tq_no_wound", others).otherwise(F.col("wounds"))
    tq = (F.when(F.col("_flag").isin("treatment_cue_without_visible_injury", "tq_no_wound"), F.array("_site"))
          .when(F.col("_flag") == "hidden_wound", F.filter("tourniquets", lambda t: t != F.col("_site"))).otherwise(F.col("tourniquets")))
    ends = F.col("_flag") == "occluded_end"
    return (d.withColumn("wounds", wounds).withColumn("tourniquets", tq).withColumn("wound_surface", F.when(hidden, F.create_map("_site", F.lit("back"))))
            .withColumn("occluder", F.when(ends, choose(("medic_arm", "gear_bag"), seed, "occ", k)).otherwise(F.col("occluder")))
            .withColumn("occ_target", F.when(ends, "limb_end").otherwise(F.col("occ_target"))).withColumn("limb_pose", F.when(F.col("_flag") == "crossing_limbs", "arm_across").otherwise(F.col("limb_pose")))
            .withColumn("confuser_site", F.when(F.col("_flag") != "crossing_limbs", F.col("_site"))).withColumnRenamed("_flag", "confuser").drop("_site"))


def paired_scenarios(ids: DataFrame, key: str = "id", seed: int = 4242) -> DataFrame:
    """Both members of a pair for every id; the pair is taken in turn. Both members share the seed."""
    def value(field):
        out = None
        for i, (_, _, shared, a, b) in enumerate(PAIRS):
            for m, own in (("a", a), ("b", b)):
                v = own.get(field, shared.get(field, PAIR_BASE[field]))
                cond = (F.col("_p") == i) & (F.col("member") == m)
                out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
        return out.cast("string").alias(field)

    d = ids.select(key, F.pmod(F.col(key), F.lit(len(PAIRS))).alias("_p"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("member"))
    pair = case([(F.col("_p") == i, p[0]) for i, p in enumerate(PAIRS)])
    return d.select(key, pair.alias("pair"), "member", (F.lit(seed) + F.col(key)).alias("seed"), *[value(f) for f in PAIR_BASE])


def stratified_set(ids: DataFrame, key: str = "id", seed: int = 20) -> DataFrame:
    """Blocks of 20 scenes in which every level of every factor appears: cycled factors and exact pattern quotas per block."""
    k = F.col(key)
    block, i = F.floor(k / 20), F.pmod(k, F.lit(20))
    d = ids.select(key, block.alias("_b"), i.alias("_i"))
    for name, spec in (("amputation_kind", CHECK_AMPUTATIONS), ("framing", CHECK_FRAMINGS), ("occluder", CHECK_OCCLUDERS)):
        h = F.md5(key_text(seed, name, k))
        d = d.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(h)))
        upper, arms = 0, []
        for value, count in spec:
            upper += count
            arms.append((F.col("_r") <= upper, value))
        d = d.withColumn(name, case(arms)).drop("_r")
    return d.select(key, F.col("_b").alias("block"), cycle(F.col("_i"), POSITIONS).alias("body_position"), cycle(F.floor(F.col("_i") / 5) + F.col("_i"), LIMB_POSES).alias("limb_pose"),
                    cycle(F.col("_i"), AZIMUTHS).alias("azimuth"), cycle(F.col("_i"), CHECK_ELEVATIONS).alias("elevation"), "amputation_kind", "framing", "occluder")


def mix_shape(d: DataFrame) -> DataFrame:
    """Observed shares of a scene mix with their allowed bounds: (name, share, ok)."""
    injured = F.array_union(F.map_keys("amputations"), F.map_keys("wounds"))
    stray = F.size(F.array_except("blood_pool", injured)) > 0
    one = d.agg(share_if(F.col("body_position") == "supine").alias("supine"), share_if(F.col("bystanders") == 0).alias("alone"), F.max("bystanders").alias("most"),
                share_if(F.col("view").isin("AgX", "Standard")).alias("known_view"), share_if(F.col("framing") == "limb_closeup").alias("closeup"), share_if(stray).alias("stray_pool"))
    # Fixed values. Bounds a mix must meet.
    bounds = [("supine", 0.65, 1.0), ("alone", 0.1, 0.3), ("known_view", 1.0, 1.0), ("closeup", 0.1, 0.3), ("stray_pool", 0.0, 0.2)]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("share"), F.col(n).between(lo, hi).alias("ok")) for n, lo, hi in bounds])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def scene_ids(spark: SparkSession, n: int) -> DataFrame:
    """Ids 0..n-1."""
    return spark.range(n)
