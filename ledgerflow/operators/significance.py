"""Support of motif types, filtering, and a null model of shuffled steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MOTIFS, MotifConfig
from ..functions.tables import numbered, passing, settled
from .counting import count_motifs, countable
from .motifs import run_all


def count_support(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return found.groupBy(*keys, "motif_type").agg(F.count("*").alias("support"))


def filter_motifs(found: DataFrame, cfg: MotifConfig = MotifConfig(), zscores: DataFrame | None = None) -> DataFrame:
    """Instances of types with enough support and, if zscores (motif_type, zscore) are given, a z of z_min or more (a type
    without one has 0).  found is written before, as it is read twice."""
    found = settled(found)
    least = F.create_map(*(F.lit(x) for kv in cfg.least_support().items() for x in kv))
    good = count_support(found).where(F.col("support") >= least[F.col("motif_type")])
    if zscores is not None:
        good = good.join(zscores.select("motif_type", "zscore"), "motif_type", "left").where(F.coalesce("zscore", F.lit(0.0)) >= cfg.z_min)
    few = F.broadcast(good.select("motif_type"))  # a row a type, so instances aren't dealt by type
    return found.join(few, "motif_type", "left_semi").select(*found.columns)


#: Rows of permuted events that are searched in one job: so many permutations at a time, one at least.
BATCH = 4_000_000


def shuffle_steps(df: DataFrame, n_permutations: int, seed: int = 42, sample_frac: float = 1.0, first: int = 0) -> DataFrame:
    """perm_id (from `first`) and df with the steps of each source dealt anew, by the order of md5(seed-perm-event_id): the
    same in every engine, the same again at a retry.  sample_frac under 1 takes a share of the events into each permutation."""
    perms = df.withColumn("perm_id", F.explode(F.sequence(F.lit(first), F.lit(first + n_permutations - 1))))
    if sample_frac < 1:
        perms = perms.where(F.pmod(F.xxhash64("perm_id", "event_id", F.lit(seed)), F.lit(1_000_000)) < int(sample_frac * 1_000_000))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col("event_id").cast("string")))
    # sources lie one after the other in both orders, so the k-th event in time and the k-th of the shuffled order of a
    # source have one number in both; numbers come from ranges of a sort, so a source with very many events is many ranges
    # bytes of the digest have the order of its text in half the space; what only gives the order isn't written
    dealt = perms.select("perm_id", "src_node", F.unhex(key).alias("__key"), "event_id", F.col("step").alias("__step"))
    dealt = numbered(dealt, ("perm_id", "src_node", "__key", "event_id"), "__n", keep=("perm_id", "__step"))
    rest = [c for c in df.columns if c != "step"]
    if sample_frac < 1:
        own = numbered(perms, ("perm_id", "src_node", "step", "event_id"), "__n", keep=("perm_id", *rest))
        return own.join(dealt.select("__n", "__step"), "__n").select("perm_id", *rest, F.col("__step").alias("step"))
    # all events are in every permutation, so their order in time is the same in each and is numbered once
    own = numbered(df, ("src_node", "step", "event_id"), "__n", keep=tuple(rest))
    place = F.col("__n") - (F.col("perm_id") - first) * df.count()
    return own.join(dealt.select("perm_id", place.alias("__n"), "__step"), "__n").select("perm_id", *rest, F.col("__step").alias("step"))


def null_zscore(observed: DataFrame, df: DataFrame, cfg: MotifConfig = MotifConfig(), seed: int = 42, n_permutations: int | None = None, sample_frac: float = 1.0, null_cap: int | None = None, observed_only: bool = False) -> DataFrame:
    """motif_type, observed, null_mean, null_std, zscore: observed support against shuffled steps, BATCH rows at a time,
    whose tables go before the next ones are made; a row a type and permutation is kept.  Instances of permutations are
    counted, and made only where countable() says that they must be.

    A permutation without instances of a type counts 0; the deviation is that of the population.  Cost controls of the
    caller, off by default: sample_frac takes that share of events into each permutation (by a hash of permutation and
    event; counts stay as they are), null_cap is the most that a type can count in a permutation, and observed_only
    leaves out types without instances (no instances at all: no rows).
    """
    n = n_permutations or cfg.n_permutations
    spark = df.sparkSession
    df, rows = settled(df), []
    many, plain = max(1, BATCH // max(1, df.count())), countable(df, cfg)
    for first in range(0, n, many):
        with passing(spark):
            shuffled = shuffle_steps(df, min(many, n - first), seed, sample_frac, first)
            support = count_motifs(shuffled, cfg, "perm_id") if plain else count_support(run_all(shuffled, cfg, ("perm_id",)), ("perm_id",))
            rows += [tuple(r) for r in support.collect()]
    found = spark.createDataFrame(rows, "perm_id int, motif_type string, support long")
    if null_cap:
        found = found.withColumn("support", F.least("support", F.lit(null_cap)))
    types = df.sparkSession.createDataFrame([(t,) for t in MOTIFS if t in cfg.enabled], "motif_type string")
    grid = types.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counts = grid.join(found, ["perm_id", "motif_type"], "left").select("motif_type", F.coalesce("support", F.lit(0)).alias("support"))
    null = counts.groupBy("motif_type").agg(F.avg("support").alias("m"), F.stddev_pop("support").alias("s"))
    seen = types.join(count_support(observed), "motif_type", "inner" if observed_only else "left").select("motif_type", F.coalesce("support", F.lit(0)).cast("bigint").alias("observed"))
    return seen.join(null, "motif_type").select(
        "motif_type", "observed", F.round("m", 2).alias("null_mean"), F.round("s", 2).alias("null_std"), F.round((F.col("observed") - F.col("m")) / (F.col("s") + 1e-9), 3).alias("zscore")
    )
