"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, at most three times its own size. Complete
epochs of a source come first; the rest of its target is filled with documents in the order of
exponential keys, -ln(u) / quality, where u is a hash of the document and a seed. The prefix sums run
over buckets of the key first; only the bucket in which the target ends is sorted by rows.

Defined results: a null text counts 0 words; null is a source of its own and comes last. A document
that the target's end cuts is taken if at least half of it fits. Ties of keys are ordered by the
document id and then by the hash of the text; rows equal in both are taken or left together. An empty
table gives an empty result. Columns of the input are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import n_words, packed, stored, unpacked

# Weights of the sources in their order, repeating, and the cap on a target.
WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3


def quality(text: Column) -> Column:
    """Share of a text that is not symbols, between 0.05 and 1: the sampling weight of a document."""
    odd = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - odd / F.greatest(F.length(text), F.lit(1))), F.lit(0.05))


def key(doc_id: Column, text: Column, seed: str) -> Column:
    """Exponential key; the smaller, the earlier a document is taken. Equal ids and texts get equal keys."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.ln(u) / quality(text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> and target. One row a source.

    A source is capped exactly if the water level over the sources of a smaller cap a weight still
    reaches its cap; so one pass in that order replaces resharing again and again.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("*", w.cast("double").alias("w"), (F.col("source_size") * most).alias("cap"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
    )
    water = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    capped = water * F.col("w") >= F.col("cap")
    # the level of the first source below its cap holds for all that follow
    final = level.select("*", F.min(F.when(~capped, F.struct("cap_before", water.alias("water")))).over(every)["water"].alias("final"))
    target = F.when(capped | F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w"))
    return final.select("source", "source_size", target.alias("target"))


def _named(doc_id: str, text: str, source: str, seed: str) -> tuple[Column, ...]:
    """id, source, size, sampling rank of a packed document: (key, id, hash of the text)."""
    d, t, s = (F.col("row").getField(c) for c in (doc_id, text, source))
    rank = F.struct(key(d, t, seed).alias("key"), d.cast("string").alias("id"), F.xxhash64(t).alias("h"))
    return d.alias("doc_id"), s.alias("source"), n_words(t).alias("size"), rank.alias("rank")


def _bucket(rank: Column, per_octave: int) -> Column:
    """Grows with the key. Octaves of the key are cut evenly, so that any scale of quality spreads."""
    return F.floor(F.log2(rank["key"]) * per_octave).cast("int")


def goals(named: DataFrame, per_octave: int = 512) -> DataFrame:
    """One row a source: source, source_size, target, epochs, and how far its fractional epoch reaches.

    Buckets before ``cut`` are taken whole; of bucket ``cut``, the documents up to ``last`` in rank.
    """
    rows = named.select("source", "size", "rank", _bucket(F.col("rank"), per_octave).alias("b"))
    per_bucket = rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
    aims = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS)))
    aims = aims.select("*", F.coalesce(whole, F.lit(0)).cast("long").alias("epochs"))
    aims = aims.select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "b", "words", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("start"))
    # the first bucket that goes beyond the target: one a source at most
    ends = starts.alias("s").join(aims.alias("a"), F.expr("s.source <=> a.source AND s.start <= a.rest AND s.start + s.words > a.rest"))
    ends = ends.selectExpr("s.source AS e_source", "s.b AS cut", "s.start AS start", "a.rest AS rest")
    inside = rows.join(ends, F.expr("source <=> e_source AND b = cut"))
    order = Window.partitionBy("e_source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = inside.select("e_source", "cut", F.when(at + F.col("size") / 2 <= F.col("rest"), F.col("rank")).alias("rank"))
    last = taken.groupBy("e_source").agg(F.max("cut").alias("cut"), F.max("rank").alias("last"))
    out = aims.join(last, F.expr("source <=> e_source"), "left")
    return out.select("source", "source_size", "target", "epochs", (F.col("rest") > 0).alias("partly"), "cut", "last")


def _copies(rank: Column, goal: Column, per_octave: int) -> Column:
    """Epochs, and one more for what the fractional one reaches; with no cut it reaches all."""
    b = _bucket(rank, per_octave)
    in_cut = (b == goal["cut"]) & F.coalesce(rank <= goal["last"], F.lit(False))
    reached = F.when(goal["cut"].isNull(), True).otherwise((b < goal["cut"]) | in_cut)
    return goal["epochs"] + (goal["partly"] & reached).cast("long")


def allot(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", per_octave: int = 512
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document, without its text.

    Sizes and ranks are written once as a narrow table; the sums and the result come from it.
    """
    named = stored(packed(docs).select(*_named(doc_id, text, source, seed)))
    # written, so that its size is known before the join is planned: a small one is broadcast
    aims = stored(goals(named, per_octave))
    aims = aims.select(F.struct(*aims.columns).alias("goal"))
    goal = F.col("goal")
    out = named.join(aims, F.col("source").eqNullSafe(goal["source"])).withColumn("copies", _copies(F.col("rank"), goal, per_octave))
    return out.select(
        "doc_id", "size", goal["source_size"].alias("source_size"), goal["target"].alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", per_octave: int = 512
) -> DataFrame:
    """``docs`` as mixed: every row as often as it is taken.

    Only one row a source is joined; it is written first, so that the planner knows its size and
    broadcasts it while it is small. Texts are shuffled only if there are too many sources for that.
    """
    rows, parts = packed(docs), _named(doc_id, text, source, seed)
    aims = stored(goals(stored(rows.select(*parts)), per_octave))
    aims = aims.select(F.struct(*aims.columns).alias("goal"))
    joined = rows.select("row", parts[3]).join(aims, F.col("row").getField(source).eqNullSafe(F.col("goal")["source"]))
    copies = _copies(F.col("rank"), F.col("goal"), per_octave)
    return unpacked(joined.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))), docs.columns)
