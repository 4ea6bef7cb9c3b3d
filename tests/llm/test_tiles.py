from pyspark.sql import functions as F

from veilframe.llm import common


def test_members_of_one_tile_are_not_repeated(spark, monkeypatch):
    """2,000 members that are all apart took 16,000 rows; several tiles meet two by two, once."""
    told = lambda: spark.range(2000).select(F.lit(1).alias("key"), "id", F.col("id").alias("comp"), F.ceil(F.lit(2000) / common.TILE).alias("tiles"), F.lit(0).alias("fact"))
    assert common.tiled(told())[1].count() == 2000
    monkeypatch.setattr(common, "TILE", 100)
    one, other = common.tiled(told())
    assert 2000 * 9 < other.count() < 2000 * 12
    met = one.join(other, ["key", "tile"]).where("own > tile or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    assert met.where("a < b").count() == met.distinct().count() == 2000 * 1999 // 2
