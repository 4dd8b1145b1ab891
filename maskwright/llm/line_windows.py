"""Line dedup: overlapping windows of three consecutive lines, repeated anywhere in the corpus.

Every window has a 128-bit key made of its lines' hashes. The first occurrence of a key, by document
and then position, stays; the lines that any later occurrence covers are removed. Windows overlap,
so a long repeated passage is removed from its first to its last line.

Defined results: lines are separated by a line feed; a text of fewer than three lines, an empty or a
null text has no window and stays as it is. Windows of which no line has a word never count, so blank
stretches stay. Rows with equal order values (null first) are ordered by the hash of their text; rows
equal in both are one document here and are cut alike. Other columns are kept as they are, but for one
of the name of the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import column, computed_once, packed, unpacked

# Fixed value: lines in a window.
LINES = 3


def _hashed(line: Column) -> Column:
    """Two independent hashes of a line, and whether it has a word."""
    return F.struct(
        F.xxhash64(line).alias("a"),
        F.xxhash64(F.lit("line"), line, F.octet_length(line)).alias("b"),
        line.rlike(r"[^\x20\x09-\x0D]").alias("w"),
    )


def windows(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(o, h, at, k1, k2): a row for each window; o and h (hash of the text) name the document."""
    base = docs.select(column(docs, order).alias("o"), column(docs, text).alias("t")).where("contains(t, '\n')")
    lines = computed_once(base, "lines", F.split("t", "\n", -1)).where(F.size("lines") >= LINES).select("o", F.xxhash64("t").alias("h"), "lines")
    hashed = computed_once(lines, "x", F.transform("lines", _hashed)).select("o", "h", "x")
    keys = F.transform(
        F.slice("x", 1, F.size("x") - (LINES - 1)),
        lambda a, i: F.when(
            a["w"] | F.get("x", i + 1)["w"] | F.get("x", i + 2)["w"],
            F.struct(
                F.xxhash64(a["a"], F.get("x", i + 1)["a"], F.get("x", i + 2)["a"]).alias("k1"),
                F.xxhash64(a["b"], F.get("x", i + 1)["b"], F.get("x", i + 2)["b"]).alias("k2"),
            ),
        ),
    )
    return hashed.select("o", "h", F.posexplode(keys).alias("at", "k")).where("k IS NOT NULL").select("o", "h", "at", "k.k1", "k.k2")


def later_windows(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(o, h, at): every occurrence of a window but its first."""
    flat = windows(docs, order, text)
    # counted on the map side too, so that a key of very many windows shuffles few rows; the join
    # that follows is one that AQE can split
    first = flat.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "h", "at")).alias("f")).where("n > 1").drop("n")
    is_first = F.col("o").eqNullSafe(F.col("f.o")) & (F.col("h") == F.col("f.h")) & (F.col("at") == F.col("f.at"))
    return flat.join(first, ["k1", "k2"]).where(~is_first).select("o", "h", "at")


def remove_repeats(docs: DataFrame, order: str = "doc_id", text: str = "text", into: str = "line_windows") -> DataFrame:
    """``docs`` and a struct column ``into``: n_lines, n_removed, and the text that is left."""
    covered = later_windows(docs, order, text).groupBy("o", "h").agg(F.array_sort(F.collect_set("at")).alias("at"))
    covered = covered.select(F.struct("o", "h").alias("cut_key"), F.col("at").alias("cut_at"))
    t, row = F.col("text_"), F.col("row")
    named = packed(docs).select("row", row.getField(order).alias("o"), F.xxhash64(row.getField(text)).alias("h"), row.getField(text).alias("text_"))
    same = (F.col("h") == F.col("cut_key")["h"]) & F.col("o").eqNullSafe(F.col("cut_key")["o"])
    joined = named.join(covered, same, "left")
    at, lines = F.col("cut_at"), F.col("cut_lines")
    cut = computed_once(joined, "cut_lines", F.split(t, "\n", -1))
    # between the starts of two windows, the lines behind the first window stay
    behind = F.transform(
        at, lambda p, i: F.slice(lines, p + LINES + 1, F.greatest(F.coalesce(F.get(at, i + 1), F.size(lines)) - p - LINES, F.lit(0)))
    )
    kept = F.flatten(F.concat(F.array(F.slice(lines, F.lit(1), F.get(at, F.lit(0)))), behind))
    out = computed_once(cut, "cut_kept", F.when(at.isNull(), lines).otherwise(kept))
    n_lines = F.when(t.isNull(), 0).otherwise(F.size(lines))
    left = F.when(at.isNull(), t).otherwise(F.array_join("cut_kept", "\n"))
    result = F.struct(
        n_lines.cast("long").alias("n_lines"),
        F.when(at.isNull(), 0).otherwise(F.size(lines) - F.size("cut_kept")).cast("long").alias("n_removed"),
        left.alias("text"),
    )
    return unpacked(out, docs.columns, **{into: result})
