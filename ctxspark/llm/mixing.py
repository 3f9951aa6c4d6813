"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

Size of a document is its number of words (maximal runs of ``[^\\x20\\x09-\\x0D]``; null: 0). Sources in code point order, null last, weigh
``weights`` in turn and share ``share`` times all words; no target exceeds ``cap`` times its source, and what a source can't take is
reshared by weight among the others: target = min(cap * size, level * weight) for the one level at which the targets add up.

Every source is cut into shards by a seeded hash, at most about ``SHARD_ROWS`` documents each. In seeded order a shard's documents form one run of words, cut
into blocks of equally many words (to a word): ``BLOCK_WORDS``, finer in a source of few words, so that a block is at
most 1/256 of it. Then quotas are integers by highest quotients votes / (k + 1/2): first the blocks of all sources by their targets, then each
source's blocks over its shards. In a shard of n blocks with quota q, block i is taken floor(((i + 1) q + phase) / n) - floor((i q + phase) / n)
times, with a seeded phase: exactly q block readings, none more than ``cap`` times, spread over the seeded order.

Highest quotients without a loop over seats: two divisors bound the last quotient chosen, so that at most two seats per party are
open; these are ranked by a range sort. The level is found by Newton steps, each one aggregate over the source table. Only sums over all
sources reach the driver; source and shard tables stay in Spark, and Spark broadcasts them only up to its byte limit.

Rows: an empty table gives no rows; a source without words has target 0; documents without words take nothing; a null source is a source of
its own, apart from ``''``; rows that repeat a doc_id are rows of their own (equal rows are interchangeable); rows with a null doc_id are
ordered by their text; extra columns are ignored, except those named in ``carry``. Reruns and any number of partitions give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import stored
from ctxspark.operators.folds import dense_index

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
FINEST = 256
SHARD_ROWS = 4096


def number(hexadecimal: Column) -> Column:
    """The first eight digits of a hexadecimal hash as a long."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")


def level(sources: DataFrame, share: Fraction, cap: int) -> float:
    """The level at which the targets min(cap * size, level * weight) add up to ``share`` of all words.

    Newton steps from below: the sources whose cap lies under the level keep their cap, the others share the rest.
    """
    at, capped = 0.0, -1
    while True:
        full = F.col("source_size") * cap <= F.lit(at) * F.col("weight")
        r = sources.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)).alias("kept"),
                        F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n"), F.sum("source_size").alias("total")).first()
        if not r["total"] or not r["open"] or r["n"] == capped:
            return at
        capped = r["n"]
        at = (share.numerator * r["total"] - share.denominator * r["kept"]) / (share.denominator * r["open"])


def highest_quotients(parties: DataFrame, group: str, party: str) -> DataFrame:
    """(group, party, quota): the ``seats`` of each group dealt to its parties by the highest of votes / (k + 1/2), equal ones to the smaller party.

    ``parties`` has (group, party, votes, seats), one row a party, the same seats in all rows of a group. With V votes and P parties of any, dividing by
    V / (seats + P/2) gives at least all seats and by V / (seats - P/2) at most all (nobody gets a seat for sure where seats are fewer), so at most
    2 P quotients lie between.
    """
    live = parties.where("votes > 0 AND seats > 0")
    sums = live.groupBy(group).agg(F.sum("votes").alias("all_votes"), F.count(F.lit(1)).alias("n_parties"))
    d = live.join(sums, group)
    low, high = F.col("seats") + F.col("n_parties") / 2, F.col("seats") - F.col("n_parties") / 2
    ideal = F.col("votes") / F.col("all_votes")
    sure = F.when(high > 0, F.floor(ideal * high * (1 - 1e-9) + 0.5)).otherwise(F.lit(0)).cast("long")
    most = F.floor(ideal * low * (1 + 1e-9) + 0.5).cast("long")
    d = stored(d.select(group, party, "votes", "seats", sure.alias("sure"), most.alias("most")), "mix-bounds")
    open_seats = (d.where("most > sure").withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)))
                  .select(group, party, (F.col("votes") / (F.col("k") + 0.5)).alias("quotient")))
    placed = dense_index(open_seats, [F.col(group), F.desc("quotient"), F.col(party)], "at")
    rest = d.groupBy(group).agg((F.first("seats") - F.sum("sure")).alias("rest"))
    first = placed.groupBy(group).agg(F.min("at").alias("first"))
    won = (placed.join(rest.join(first, group), group).where(F.col("at") - F.col("first") < F.col("rest")).groupBy(group, party)
           .agg(F.count(F.lit(1)).alias("won")))
    quota = (F.coalesce("sure", F.lit(0)) + F.coalesce("won", F.lit(0))).alias("quota")
    return (parties.select(group, party).join(d.select(group, party, "sure"), [group, party], "left")
            .join(won, [group, party], "left").select(group, party, quota))


def plan(rows: DataFrame, weights: Sequence[int], share: Fraction, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, shards) of ``rows`` (source, size, key): targets of the sources, blocks and quotas of the shards."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    coded = dense_index(per, [F.asc_nulls_last("source")], "code")
    weight = F.get(F.lit(list(weights)), F.pmod(F.col("code"), F.lit(len(weights))).cast("int")).cast("long")
    coded = stored(coded.withColumn("weight", weight), "mix-sources")
    at = level(coded, share, cap)
    target = F.least((F.col("source_size") * cap).cast("double"), F.lit(at) * F.col("weight"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / FINEST)))
    sources = coded.select("source", "code", "source_size", target.alias("target"), block.cast("long").alias("block"),
                                  F.ceil(F.col("n_docs") / SHARD_ROWS).cast("long").alias("n_shards"))
    words = (with_shard(rows, sources).groupBy("code", "shard").agg(F.sum("size").alias("words"), F.max("block").alias("block")))
    n_blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / F.col("block")))).otherwise(F.lit(0)).cast("long")
    shards = stored(words.select("code", "shard", "words", n_blocks.alias("blocks")), "mix-shards")

    blocks = shards.groupBy("code").agg(F.sum("blocks").alias("blocks"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    parties = stored(sources.join(blocks, "code").select(F.lit(0).alias("house"), "code", "blocks", votes.alias("votes")), "mix-votes")
    house = parties.agg(F.sum(F.round("votes", 6).cast("decimal(30,6)"))).first()[0] or 0       # exact, whatever the order
    house = math.floor(Fraction(house) + Fraction(1, 2))
    quotas = highest_quotients(parties.withColumn("seats", F.lit(house).cast("long")), "house", "code")
    quotas = quotas.join(parties, "code").select("code", F.least("quota", F.col("blocks") * cap).alias("seats"))
    parties = stored(shards.join(quotas, "code").select("code", "shard", F.col("blocks").cast("double").alias("votes"), "seats"), "mix-parties")
    quotas = highest_quotients(parties, "code", "shard")
    phase = F.when(F.col("blocks") > 0, F.pmod(number(F.md5(F.concat_ws(":", F.lit(seed), F.lit("phase"), "code", "shard"))), F.col("blocks")))
    shards = shards.join(quotas, ["code", "shard"]).select(
        "code", "shard", "words", "blocks", F.least("quota", F.col("blocks") * cap).alias("quota"), phase.alias("phase"))
    return sources, stored(shards, "mix-quotas")


def with_shard(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns and their shard."""
    s = sources.withColumnRenamed("source", "of")
    return (rows.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("shard", F.pmod(number(F.col("key")), F.col("n_shards"))))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 11,
        carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, spans, carry...) of every document: ``spans`` are the word ranges (start, end, times) that the
    mix takes, from 0, end exclusive."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text))))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.substring(key, 1, 16).alias("key"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = stored(rows, "mix-rows")
    sources, shards = plan(rows.select("source", "size", "key"), weights, share, cap, seed)
    run = Window.partitionBy("code", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_shard(rows, sources.drop("block")).withColumn("b", F.sum("size").over(run)).withColumn("a", F.col("b") - F.col("size"))
    placed = placed.join(shards, ["code", "shard"])
    return placed.select("doc_id", "source", "size", "source_size", "target", spans().alias("spans"),
                         *[F.col(f"carry_{c}").alias(c) for c in carry])


def spans() -> Column:
    """The taken word ranges of a document at words a to b of its shard, from the shard's words, blocks, quota and phase.

    Block i is words i * words div blocks to (i + 1) * words div blocks; the block of word x is the last that starts at x or before.
    """
    return F.expr("""
        CASE WHEN size > 0 AND quota > 0 THEN filter(transform(
            sequence(((a + 1) * blocks - 1) div words, (b * blocks - 1) div words),
            i -> struct(greatest(a, i * words div blocks) - a AS start, least(b, (i + 1) * words div blocks) - a AS `end`,
                        ((i + 1) * quota + phase) div blocks - (i * quota + phase) div blocks AS times)), x -> x.times > 0)
        ELSE CAST(array() AS array<struct<start: bigint, `end`: bigint, times: bigint>>) END""")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, start, times, text): the pieces that the mix takes, their words joined by blanks, to be written ``times`` times."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    pieces = mix(docs, carry=["text"], **options).select("doc_id", "source", words.alias("words"), F.explode("spans").alias("s"))
    cut = F.slice("words", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int"))
    return pieces.select("doc_id", "source", "s.start", "s.times", F.concat_ws(" ", cut).alias("text"))


def mixture_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words that the mix takes of every document, repeats counted."""
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]) * s["times"])
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
