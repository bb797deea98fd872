"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Words are dealt out in equal blocks.  Sources get blocks by highest quotients
``target / (2 k + 1)``; the blocks of a source go to its shards in the same way.  A shard
is a line of documents in seeded order, cut into blocks of equal size; as many blocks as
its quota says are taken from the front of the line, all of them first if the quota is larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.ranking import rank_in_groups
from ..session import cut_lineage
from .common import pick

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block, and of a shard on average.
BLOCK, SHARD = 16, 2**18
SOURCE = ["bare", "name"]  # a source as non-null columns: is it null, and its name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int, block: int) -> DataFrame:
    """Adds ``house``, the blocks of all sources, and ``target``: the level that fills all sources by weight, up to ``most`` times their size.

    Each round fixes the sources that reached their limit and levels the rest; it brings
    three sums to the driver.  The level only rises, so the rounds end.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    level, fixed = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        got = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("size"),
                          F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if got.n == fixed or not got.weight:
            break
        fixed, level = got.n, (total - most * (got.size or 0)) / got.weight
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level))
    return sources.withColumns({"target": target.cast("double"), "house": F.lit(int(total / block + 0.5)).cast("long")})


def apportion(parties: DataFrame, groups: list[str], weight: str, house: str, ids: list[str]) -> DataFrame:
    """Adds ``seats``: in each group, ``house`` seats by highest quotients ``weight / (2 k + 1)``.

    Ties go to the least ids.  Every party first gets what it is sure of: rounding errs by half a seat
    per party in all, and a party's part in that is about its share.  Only quotients near the
    price of the last seat are ranked, a few per party.
    """
    sums = parties.groupBy(*groups).agg(F.sum(weight).alias("whole"), F.count("*").alias("parties"))
    share = F.when(F.col("whole") > 0, F.col(weight) / F.col("whole")).otherwise(0.0)
    slack = 1.5 * F.col("share") * F.col("parties")
    sure = F.greatest(F.lit(0), F.floor(F.col("share") * F.col(house) - slack - 1))
    sure = cut_lineage(parties.join(sums, groups).withColumn("share", share).withColumn("sure", sure))
    left = sure.groupBy(*groups).agg((F.max(house) - F.sum("sure")).alias("left"))
    near = F.sequence("sure", F.col("sure") + F.ceil(2 * slack) + 4)
    each = sure.filter(F.col(weight) > 0).join(left, groups).select(
        *dict.fromkeys([*groups, *ids]), "left", F.explode(near).alias("k"), F.col(weight).alias("w"))
    each = each.withColumn("low", -(F.col("w") / (2 * F.col("k") + 1)))
    ranked = rank_in_groups(each, groups, [F.col("low"), *[F.col(i) for i in ids]], "place", groups)
    won = ranked.filter(F.col("place") <= F.col("left")).groupBy(*ids).agg(F.count("*").alias("won"))
    return sure.join(won, ids, "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0))).select(
        *parties.columns, "seats")


def lines(df: DataFrame, doc_id: str, text: str, source: str, seed: object) -> DataFrame:
    """Size, source and draws of every row, without the texts; stored once."""
    rows = pick(df, doc_id=doc_id, text=text, source=source)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return cut_lineage(rows.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.col("source").isNull().alias("bare"), F.coalesce("source", F.lit("")).alias("name"),
        draw(key, f"{seed}/shard").alias("lot"), draw(key, f"{seed}/order").alias("turn")))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: object = 1) -> DataFrame:
    """One row per document: ``(doc_id, size, source_size, target, taken, source, copies)``.

    ``taken`` counts words, repeats included; ``copies`` is the number of whole documents that
    comes nearest, for use where documents are not cut.  Null sources are one source, last
    in order; null and empty texts have no words and are taken 0 times; repeated rows are dealt
    with one by one.  The same table and seed give the same mix.

    A source of any share is spread over shards of bounded size; only sums per source and
    shard, and the narrow rows of a shard, are shuffled.
    """
    rows = lines(df, doc_id, text, source, seed)
    sums = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    ranked = rank_in_groups(sums, [], [F.col("bare"), F.col("name")], "place", [])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select(*SOURCE, "source_size", weight.alias("weight"), F.lit(0).alias("all"))
    sources = apportion(targets(cut_lineage(ranked), most, block), ["all"], "target", "house", SOURCE)
    sources = cut_lineage(sources.select(*SOURCE, "source_size", "target", F.col("seats").alias("blocks"),
                                         F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).alias("shards")))

    # every row to its shard; a source's figures reach its rows by a join that can be split
    placed = rows.join(sources, SOURCE).withColumn("shard", F.pmod("lot", F.col("shards")))
    shards = placed.groupBy(*SOURCE, "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    parts = F.greatest(F.lit(1), F.round(F.col("words") / block).cast("long"))
    quotas = apportion(cut_lineage(shards), SOURCE, "words", "blocks", [*SOURCE, "shard"]).withColumn("parts", parts)
    quotas = quotas.withColumn("seats", F.least(F.col("seats"), F.col("parts") * most))
    quotas = cut_lineage(quotas.select(*SOURCE, "shard", (F.expr("seats div parts")).alias("rounds"),
                                       F.expr("(seats % parts) * words div parts").alias("front")))

    before = Window.partitionBy(*SOURCE, "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # rows without words take no place in a line, so any number of them needs no window
    line = placed.filter("size > 0").withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    line = line.unionByName(placed.filter("size = 0").withColumn("start", F.lit(0).cast("long")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("front") - F.col("start")))
    copies = F.when(F.col("size") > 0, F.col("rounds") + (2 * part >= F.col("size")).cast("long")).otherwise(0)
    return line.join(quotas, [*SOURCE, "shard"]).select(
        "doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
        "source", copies.cast("long").alias("copies"))


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, all columns, each as many times as its document is taken as a whole.

    Rows that share an id are taken together, as often as the one taken most.
    """
    found = mix(df, doc_id, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    own = [f"c{i}" for i in range(len(df.columns))]  # no name of the caller's can clash
    named = df.select(*[df[c].alias(o) for c, o in zip(df.columns, own, strict=True)])
    same = F.col(own[df.columns.index(doc_id)]).eqNullSafe(F.col("__id"))
    joined = named.join(found.filter("__copies > 0"), same)
    repeated = joined.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*own).toDF(*df.columns)
