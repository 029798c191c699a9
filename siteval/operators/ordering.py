"""Ranks, running sums and picks that need an order, without sorting a whole table into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.operators.quantiles import exact_quantiles

_BUCKETS = 256


def range_buckets(df: DataFrame, column: str, out: str = "_bucket", buckets: int = _BUCKETS) -> DataFrame:
    """An order-preserving bucket number for a numeric column. The edges are an approximate-quantile sketch: a bounded list
    of constants, so every later use of the buckets agrees."""
    probs = [i / buckets for i in range(1, buckets)]
    inner = sorted(set(df.select(F.col(column).cast("double").alias(column)).approxQuantile(column, probs, 1 / (4 * buckets))))
    edges = [-float("inf"), *inner, float("inf")]
    if len(edges) < 3:
        return df.withColumn(out, F.lit(0.0))
    with_double = df.withColumn("_d", F.col(column).cast("double"))
    return Bucketizer(splits=edges, inputCol="_d", outputCol=out, handleInvalid="keep").transform(with_double).drop("_d")


def _offsets(df: DataFrame, bucket: str, amounts: dict[str, Column], by=()) -> DataFrame:
    """Per bucket, the totals of all earlier buckets: a window over the few bucket rows only."""
    per = df.groupBy(*by, bucket).agg(*[F.sum(v).alias(n) for n, v in amounts.items()])
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return per.select(*by, bucket, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in amounts])


def _with_offsets(df: DataFrame, bucket: str, amounts: dict[str, Column], by=()) -> DataFrame:
    return df.join(_offsets(df, bucket, amounts, by), [*by, bucket])


def running_total(df: DataFrame, order: str, amounts: dict[str, str], by=(), inclusive: bool = True) -> DataFrame:
    """Running sums along a numeric order (unique per ``by``): bucket offsets plus sums inside each bucket."""
    b = range_buckets(df, order)
    j = _with_offsets(b, "_bucket", {n: F.col(c) for n, c in amounts.items()}, by)
    inside = W.partitionBy(*by, "_bucket").orderBy(order)
    inside = inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    sums = [(F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in amounts.items()]
    return j.select(*df.columns, *sums)


def row_index(df: DataFrame, order: str, out: str = "idx", by=()) -> DataFrame:
    """0-based position along a numeric key (unique per ``by``)."""
    r = running_total(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}, by, inclusive=False)
    return r.drop("_one")


def hash_rank(df: DataFrame, hashed: Column, out: str = "rank", by=(), digits: int = 4) -> DataFrame:
    """1-based rank in the order of a hex hash: offsets per hash prefix (65,536 of them) plus ranks inside a prefix."""
    h = df.withColumn("_h", hashed).withColumn("_bucket", F.substring("_h", 1, digits))
    j = _with_offsets(h, "_bucket", {"_cnt": F.lit(1).cast("long")}, by)
    inside = W.partitionBy(*by, "_bucket").orderBy("_h")
    return j.select(*df.columns, (F.col("_before__cnt") + F.row_number().over(inside)).alias(out))


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The last row per key in the given order: an aggregate, so a hot key never gathers in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_per_group(df: DataFrame, by, order, n: int) -> DataFrame:
    """The first n rows per group. Spark trims every partition to n rows per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def id_window_groups(df: DataFrame, key: str, gap: int = 100, min_groups: int = 20) -> DataFrame:
    """Link consecutive ids at most ``gap`` apart; when that leaves fewer than ``min_groups`` groups, drop the rule and
    leave every id alone. Output: key, grp (smallest id of the group), dropped.

    Ids are cut at their own quantiles into ranges of like size, however sparse they are; each range needs only the largest id
    before it from the small range table."""
    ids = range_buckets(df.select(key).distinct(), key)
    ends = ids.groupBy("_bucket").agg(F.max(key).alias("_last"))
    ends = ends.select("_bucket", F.lag("_last").over(W.orderBy("_bucket")).alias("_prev_end"))
    inside = W.partitionBy("_bucket").orderBy(key)
    previous = F.coalesce(F.lag(key).over(inside), F.col("_prev_end"))
    marked = ids.join(ends, "_bucket").withColumn("_start", F.when(previous.isNull() | (F.col(key) - previous > gap), F.col(key)))
    carry = marked.groupBy("_bucket").agg(F.max("_start").alias("_s"))
    carry = carry.select("_bucket", F.max("_s").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    grouped = marked.join(carry, "_bucket").select(key, F.coalesce(F.max("_start").over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_carried")).alias("_g"), "_start")
    few = marked.agg(F.count("_start") < min_groups).scalar()
    return grouped.select(key, few.alias("dropped"), "_g").select(key, F.when(F.col("dropped"), F.col(key)).otherwise(F.col("_g")).alias("grp"), "dropped")


def quantile_bins(df: DataFrame, value: Column, bins: int = 4) -> DataFrame:
    """Rows with the quantile bin(s) they fall in; both ends are inclusive, so rows on an inner edge count twice."""
    qs = [i / bins for i in range(bins + 1)]
    names = [f"e{i}" for i in range(bins + 1)]
    edges = exact_quantiles(df, value, qs, (), names).select(F.struct(*names)).scalar()
    rows = df.withColumn("_v", value.cast("double")).withColumn("_e", edges)
    hit = [F.when((F.col("_v") >= F.col("_e")[f"e{i}"]) & (F.col("_v") <= F.col("_e")[f"e{i + 1}"]), F.lit(i)) for i in range(bins)]
    return rows.select(*df.columns, "_v", F.explode(F.array_compact(F.array(*hit))).alias("bin"))


def auc(df: DataFrame, positive: Column, score: Column, by=()) -> DataFrame:
    """Rank AUC with tied scores counted half. Rows fold to distinct scores first; running counts come from bucket offsets."""
    per = df.select(*by, score.cast("double").alias("_s"), positive.cast("long").alias("_y")).groupBy(*by, "_s").agg(
        F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    run = running_total(per, "_s", {"_below": "_neg"}, by, inclusive=False)
    won = F.sum(F.col("_pos") * (2 * F.col("_below") + F.col("_neg")))
    out = run.groupBy(*by).agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), won.alias("_won"))
    area = F.try_divide(F.col("_won").cast("double"), (2 * F.col("positives") * F.col("negatives")).cast("double"))
    return out.select(*by, "positives", "negatives", area.alias("auc"))


def ovr_auc(df: DataFrame, y: str, p: str, k: int = 4) -> DataFrame:
    """One-versus-rest AUC per class."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col(y) == c).cast("int").alias("pos"), F.col(p)[c].alias("s")) for c in range(k)])).alias("_r")).select("_r.*")
    return auc(rows, F.col("pos"), F.col("s"), ("class",))


def every_nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n evenly spaced rows of a table in key order: every (total // n)-th, at most n."""
    total = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n))).scalar()
    return row_index(df, key, "_i").withColumn("_step", total).filter((F.col("_i") % F.col("_step") == 0) & (F.col("_i") < F.col("_step") * n)).select(*df.columns)


def shard(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """Rows k, k+n, k+2n… of the table in key order."""
    return row_index(df, key, "_i").filter(F.col("_i") % n == k).select(*df.columns)


def pick_best(candidates: DataFrame, name: str, score: str, incumbent: str, by=(), min_gain: float = 0.0, digits: int = 4) -> DataFrame:
    """Best candidate by rounded score, the incumbent winning ties and whenever the gain is too small."""
    is_inc = F.col(name) == incumbent
    agg = candidates.groupBy(*by).agg(
        F.max_by(name, F.struct(F.bround(score, digits), is_inc, F.col(name))).alias("_best"),
        F.max_by(score, F.struct(F.bround(score, digits), is_inc, F.col(name))).alias("_score"), F.max(F.when(is_inc, F.col(score))).alias("_inc"))
    keep = (F.col("_best") != incumbent) & (F.col("_score") - F.col("_inc") < min_gain)
    return agg.select(*by, F.when(keep, F.lit(incumbent)).otherwise(F.col("_best")).alias("best"), F.when(keep, F.col("_inc")).otherwise(F.col("_score")).alias("score"))


def feature_deltas(df: DataFrame, pred: str, true: str, names, sd, n: int = 3) -> DataFrame:
    """The n features whose predicted value lies furthest from the true one, in units of ``sd`` (a scalar array column)."""
    d = df.withColumn("_sd", sd)
    z = F.array(*[F.struct((-F.abs((F.col(pred)[i] - F.col(true)[i]) / F.col("_sd")[i])).alias("o"), F.lit(i).alias("i"), F.lit(f).alias("feature"),
                           ((F.col(pred)[i] - F.col(true)[i]) / F.col("_sd")[i]).alias("z")) for i, f in enumerate(names)])
    top = F.transform(F.slice(F.array_sort(z), 1, n), lambda s: F.struct(s["feature"].alias("feature"), s["z"].alias("z")))
    return d.withColumn("feature_delta_top3", F.when(F.col(true).isNotNull(), top)).drop("_sd")
