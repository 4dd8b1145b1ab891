"""Secret scans with corpus-wide ownership frequency.

Candidates come from patterns: assignments to names of secrets, access keys, long hex runs, and further
tokens of mixed letters and digits. The hash of every candidate's value is counted by the distinct
repositories and owners that hold it. A value that several owners share, or that one owner has spread over
many repositories, is a copied example; one that a single owner holds in few of them looks live. Tokens of
the last kind become spans only where they look live.

Defined results: a null or empty text has no spans. A null owner or repository counts as one more of
its kind; a repository belongs to its owner, so one name under two owners counts twice. Rows are told apart
by a number of their own, so repeated rows give repeated results (and count as one repository). Texts are
searched whole, whatever their length; an empty table gives an empty result; other columns, also of the
names used here, are not read. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import column, stored

# Kinds in the order in which they are listed, their patterns, and the group that is the
# secret itself. Case is spelt out, so that no engine folds other letters than ASCII's.
KINDS = ["assign", "access", "hex", "owned"]
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api")).replace(
    "[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]"
)
PATTERNS = {
    "assign": rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "owned": r"[A-Za-z0-9+/_-]{20,}",
}
LEAST_ASSIGNED = 6
# owners, or repositories of one owner, from which on a value is taken as copied
SHARED_BY = 2
SPREAD_OVER = 16


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind and the lengths of the gaps before them; patterns run in texts that have a match only."""
    p = F.lit(PATTERNS[kind])
    none = F.array().cast("array<struct<m:string,g:int>>")
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    both = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.when(F.regexp_like(text, p), both).otherwise(none)


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str) -> DataFrame:
    """One narrow row a document, written once: row, doc_id, owner, repository, matches by kind. No texts."""
    t = column(docs, text)
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), _found(t, k).alias("found")) for i, k in enumerate(KINDS)))
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            column(docs, doc_id).alias("doc_id"),
            column(docs, owner).alias("owner"),
            column(docs, repository).alias("repository"),
            F.filter(kinds, lambda k: F.size(k["found"]) > 0).alias("kinds"),
        )
    )


def spans(rows: DataFrame) -> DataFrame:
    """(row, owner, repository, kind, start, end, hash): a row for each candidate."""
    flat = rows.select("row", "owner", "repository", F.explode("kinds").alias("k"))
    flat = flat.select("row", "owner", "repository", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("i", "f"))
    # matches and gaps alternate, so their lengths add up to offsets
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("f.g") + F.length(F.coalesce("f.m", F.lit("")))).over(run).cast("int")
    placed = flat.select("row", "owner", "repository", "kind", F.col("f.m").alias("m"), end.alias("end")).where("m IS NOT NULL")
    assigned = F.regexp_extract("m", PATTERNS["assign"], 2)
    value = F.when(F.col("kind") == 0, assigned).otherwise(F.col("m"))
    mixed = F.col("m").rlike("[a-z]") & F.col("m").rlike("[A-Z]") & F.col("m").rlike("[0-9]")
    valid = F.when(F.col("kind") == 0, F.length(assigned) >= LEAST_ASSIGNED).when(F.col("kind") == 3, mixed).otherwise(True)
    return placed.where(valid).select(
        "row", "owner", "repository", "kind", (F.col("end") - F.length("m")).alias("start"), "end", F.sha2(value, 256).alias("hash")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories): counted in steps, each of them combined before its shuffle."""
    distinct = found.select("hash", "owner", "repository").distinct()
    by_owner = distinct.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    shared_by: int = SHARED_BY,
    spread_over: int = SPREAD_OVER,
) -> DataFrame:
    """(doc_id, spans, n_live, n_copied): sorted spans (start, kind, end, n_owners, n_repositories, live) of every document.

    A value is copied if at least ``shared_by`` owners or ``spread_over`` repositories hold it, else live.
    """
    rows = candidates(docs, doc_id, text, owner, repository)
    found = stored(spans(rows))
    # counts are one row a value; the join that follows is one that AQE can split
    live = (F.col("n_owners") < shared_by) & (F.col("n_repositories") < spread_over)
    known = found.join(ownership(found).withColumn("live", live), "hash").where("kind < 3 OR live")
    span = F.struct("start", "kind", "end", "n_owners", "n_repositories", "live")
    grouped = known.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(dict(grouped.dtypes)["spans"])
    out = rows.select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    return out.select("*", count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    part = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans; the most owners and repositories that hold one of a document's values."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    most = [F.coalesce(F.array_max(F.col("spans")[c]), F.lit(0)).cast("long").alias(f"most_{c[2:]}") for c in ("n_owners", "n_repositories")]
    digests = [F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")]
    return scanned.select("doc_id", *counts, *digests, "n_live", "n_copied", *most)
