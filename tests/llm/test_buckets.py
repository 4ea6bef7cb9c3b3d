import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import common, minhash_dedup


def _signed(rows, rng):
    """Signatures of which some differ from the one before in a few places only."""
    places = rng.integers(0, 1 << minhash_dedup.BITS, (rows, minhash_dedup.CHUNKS * minhash_dedup.LANES))
    for i in range(1, rows):
        keep = rng.random(places.shape[1]) > 0.3 * rng.random()
        places[i, keep] = places[i - 1, keep]
    shift = np.arange(minhash_dedup.LANES) * minhash_dedup.BITS
    return [[int(x) for x in (row.reshape(-1, minhash_dedup.LANES) << shift).sum(1)] for row in places]


def test_a_pair_is_compared_in_one_of_its_buckets(spark):
    """Two signatures of 80 % met in about thirty buckets, and each of these made a row of their pair."""
    parts = minhash_dedup._PARTS[: minhash_dedup.CHUNKS]
    sigs = spark.createDataFrame([(i, 10, *s) for i, s in enumerate(_signed(60, np.random.default_rng(3)))], f"id long, n long, {', '.join(f'{p} long' for p in parts)}")
    odd = minhash_dedup._PARTS[minhash_dedup.CHUNKS :]
    ready, meet = minhash_dedup._once(80)
    told = sigs.select("id", F.struct("n", *parts, *(F.lit(0).cast("long").alias(x) for x in odd)).alias("fact"), F.explode(minhash_dedup._keys()).alias("key")).withColumn("fact", ready)
    met = told.select("key", F.col("id").alias("a"), "fact").join(told.select("key", F.col("id").alias("b"), F.col("fact").alias("its")), "key").where("a < b")
    near = met.select("a", "b")
    once = met.where(meet(F.col("fact"), F.col("its"))).select("a", "b")
    assert near.count() > 10 * once.count() > 500
    assert once.count() == once.distinct().count() and not once.exceptAll(near.distinct()).count() and not near.distinct().exceptAll(once).count()


def test_comparing_signatures_is_code_that_the_jvm_compiles(spark):
    """The join's method had 10,216 bytes; the JVM interprets methods of more than 8,000."""
    ready, meet = minhash_dedup._once(80)
    facts = spark.range(50).select((F.col("id") % 5).alias("key"), "id", F.struct(F.lit(9).alias("n"), *(F.xxhash64("id").alias(p) for p in minhash_dedup._PARTS)).alias("fact")).withColumn("fact", ready)
    one = facts.select("key", F.col("id").alias("a"), "fact").repartition(3, "key")
    pairs = one.join(facts.select("key", F.col("id").alias("b"), F.col("fact").alias("its")).hint("merge"), "key").where(meet(F.col("fact"), F.col("its")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    done = pairs._jdf.queryExecution().debug().codegenToSeq().iterator()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = []
    while done.hasNext():
        sizes.append(done.next()._3().maxMethodCodeSize())
    assert max(sizes) < 8000


def test_members_of_a_buckets_largest_component_are_not_repeated(spark, monkeypatch):
    """They meet all others of the bucket, and none of their own."""
    monkeypatch.setattr(common, "TILE", 100)
    told = spark.range(1050).select(F.lit(1).alias("key"), "id", (F.col("id") < 1000).alias("most"), F.lit(10).cast("long").alias("main_tiles"), F.lit(0).alias("fact"))
    most, few = common.beside(told.where("most"), told.where("not most"))
    assert (most.count(), few.count()) == (1000, 500)
    assert most.join(few, ["key", "tile"]).select("a", "b").distinct().count() == 1000 * 50 == most.join(few, ["key", "tile"]).count()
