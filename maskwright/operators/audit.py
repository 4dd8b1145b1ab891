"""Audit report: one ordered set of CSV lines per tenant, and the event export lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import logs as L
from maskwright.operators import reports as R

# Report lines (section, part, text) and evidence locations.
FIXED_LINES = [
    (0, 0, "Compliance Audit Report"),
    (0, 4, ""),
    (1, 0, "SECTION 1 — TEAM AI LITERACY"),
    (1, 1, "EU AI Act Art. 4 | ISO 27001 A.6.3 (Awareness & Training) | SOC 2 CC1.4 (Competence)"),
    (1, 2, "Email,Role,Extension Installed,Policy Acknowledged,Acknowledged At,Blocks,Warnings,Last Active"),
    (1, 5, ""),
    (2, 0, "SECTION 2 — AI INTERACTION LOG"),
    (
        2,
        1,
        "EU AI Act Art. 12 | ISO 27001 A.8.16 (Monitoring) + A.8.22 (Filtering) | SOC 2 CC7.2 (System Monitoring) + CC6.7 (Data Transmission Controls)",
    ),
    (2, 2, "Timestamp,User,AI Platform,Data Types Detected,Action,Reviewed,Reviewed At,Note"),
    (2, 7, ""),
    (3, 0, "SECTION 3 — AI TOOL INVENTORY"),
    (3, 1, "EU AI Act Art. 10 | ISO 27001 A.5.10 (Acceptable Use) + A.5.9 (Asset Inventory) | SOC 2 CC6.3 (Access to Data)"),
    (3, 2, "AI Platform,Users,Sessions,Status,Risk Level,Last Seen,Notes"),
    (3, 4, ""),
    (4, 0, "SECTION 4 — CONTROL FRAMEWORK MAPPING"),
    (4, 1, "Framework,Control ID,Control Name,Implementation,Evidence Location"),
    (4, 3, ""),
    (5, 0, "This report was generated automatically."),
    (
        5,
        1,
        "It documents active technical controls for EU AI Act compliance and maps to ISO 27001:2022 Annex A and SOC 2 Trust Service Criteria.",
    ),
]
SECTION_EVIDENCE = {1: "Section 1 of this report", 2: "Section 2 of this report", 3: "Section 3 of this report", 0: "Policy tab"}
EVIDENCE = {("A.5.1", 0): "Compliance tab", ("CC6.1", 0): "Team tab"}
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

_q = R.csv_quote


def _csv(*cells: Column) -> Column:
    """Cells joined by commas; NULL numbers count as empty."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def _ts(c: str) -> Column:
    return F.date_format(c, TS_FORMAT)


def _yes(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def event_csv_line() -> Column:
    """Nine columns, types comma-joined inside quotes."""
    types = F.array_join(L.types_array(F.col("data_types")), ",")
    quoted = F.concat(F.lit('"'), types, F.lit('"'))
    return _csv(
        F.col("id"), _ts("timestamp"), F.col("user_id"), F.col("user_email"), F.col("ai_domain"), F.col("rule_id"), quoted, F.col("action"), F.col("extension_version")
    )


def client_csv_line() -> Column:
    """Seven columns, types joined by semicolons."""
    types = F.array_join(L.types_array(F.col("data_types")), ";")
    seen = F.when(F.col("acknowledged"), "yes").otherwise("no")
    return _csv(_ts("timestamp"), F.col("user_email"), F.col("ai_domain"), F.col("action"), types, seen, _ts("acknowledged_at"))


SORT = ["down", "s1", "s2"]


def _lines(df: DataFrame, section: int, part: int, line: Column, *sort: Column, down: Column | None = None) -> DataFrame:
    """Lines of one part; ``down`` (descending), then ``s1``/``s2`` order them inside the part."""
    keys = [F.lit(None) if down is None else down, *sort, F.lit(None), F.lit(None)]
    in_order = [k.cast("string").alias(name) for k, name in zip(keys, SORT)]
    return df.select("org_id", F.lit(section).alias("section"), F.lit(part).alias("part"), *in_order, line.alias("line"))


def report(
    spark: SparkSession,
    orgs: DataFrame,
    users: DataFrame,
    events: DataFrame,
    visits: DataFrame,
    tools: DataFrame,
    start: str,
    end: str,
) -> DataFrame:
    """Header, four sections and footer of every tenant's report.

    Sections are independent narrow or pre-aggregated frames united by name; order is carried by
    (section, part, down, s1, s2), so writing is one range-partitioned sort and no tenant's log has to
    fit in one task.
    """
    o = orgs.withColumnRenamed("id", "org_id")
    fixed = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(p).alias("part"), F.lit(x).alias("line")) for s, p, x in FIXED_LINES])
    none = F.lit(None).cast("string")
    parts = [o.select("org_id", F.inline(fixed)).select("org_id", "section", "part", *(none.alias(k) for k in SORT), "line")]

    parts.append(_lines(o, 0, 1, _csv(F.lit("Organisation"), _q(F.coalesce("name", "domain")))))
    parts.append(_lines(o, 0, 2, _csv(F.lit("Generated"), _q(F.lit(end)))))
    parts.append(_lines(o, 0, 3, _csv(F.lit("Period"), F.concat(_q(F.lit(start)), F.lit(" to "), _q(F.lit(end))))))

    counters = R.user_counters(events).select(F.col("user_id").alias("id"), "block_count", "warn_count")
    member = users.join(counters, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = _csv(
        _q(F.coalesce("email", F.lit("anonymous"))),
        _q(F.col("role")),
        _yes(F.col("extension_installed")),
        _yes(F.col("policy_acknowledged_at").isNotNull()),
        _q(_ts("policy_acknowledged_at")),
        zero("block_count"),
        zero("warn_count"),
        _q(_ts("last_seen_at")),
    )
    parts.append(_lines(member, 1, 3, row, F.coalesce("email", F.lit("")), down=F.col("role")))

    totals = o.join(R.report_totals(users, events, start, end), "org_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    trained = F.concat(F.lit("Total,"), n("members"), F.lit(" members,"), n("trained"), F.lit(" trained ("), n("pct_trained"), F.lit("%)"))
    counts = [(2, 4, "Total events in period", "events"), (2, 5, "Blocks", "blocks"), (2, 6, "Blocks reviewed", "blocks_reviewed")]
    line = lambda section, part, text: F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), text.alias("line"))
    four = F.array(line(1, 4, trained), *(line(s, p, _csv(F.lit(label), n(col))) for s, p, label, col in counts))
    parts.append(totals.select("org_id", F.inline(four)).select("org_id", "section", "part", *(none.alias(k) for k in SORT), "line"))

    inside = R.with_user_email(events.filter(F.col("timestamp").between(L.at(start), L.at(end))), users)
    shown = F.coalesce(F.array_join(F.from_json("data_types", "array<string>"), "; "), F.col("data_types"))
    row = _csv(
        _q(_ts("timestamp")),
        _q(F.coalesce("user_email", F.lit("anonymous"))),
        _q(F.col("ai_domain")),
        _q(shown),
        _q(F.col("action")),
        _yes(F.col("acknowledged")),
        _q(_ts("acknowledged_at")),
        _q(F.col("acknowledged_note")),
    )
    newest_first = F.lpad((F.lit(10**17) - F.unix_micros(F.col("timestamp").cast("timestamp"))).cast("string"), 18, "0")
    parts.append(_lines(inside, 2, 3, row, newest_first, F.lpad(F.col("id").cast("string"), 20, "0")))

    inv = R.report_inventory(visits, tools, start, end)
    row = _csv(
        _q(F.col("domain")), F.col("users"), F.col("visits"), _q(F.col("status")), _q(F.col("risk_level")), _q(_ts("last_seen")), _q(F.col("notes"))
    )
    parts.append(_lines(inv, 3, 3, row, F.lpad((F.lit(10**15) - F.col("visits")).cast("string"), 16, "0"), F.col("domain")))

    rows = [
        (i, f, c, name, impl, EVIDENCE.get((c, s), SECTION_EVIDENCE[s])) for i, (f, c, name, impl, s) in enumerate(R.CONTROLS)
    ]
    controls = F.array(*[F.struct(F.lit(f"{i:02d}").alias("i"), _csv(*[_q(F.lit(v)) for v in r]).alias("line")) for i, *r in rows])
    parts.append(
        o.select("org_id", F.inline(controls)).select(
            "org_id", F.lit(4).alias("section"), F.lit(2).alias("part"), none.alias("down"), F.col("i").alias("s1"), none.alias("s2"), "line"
        )
    )
    return reduce(DataFrame.unionByName, parts)


def write_report(lines: DataFrame, path: str) -> None:
    """Text files per tenant, in report order across the files of a tenant."""
    ordered = lines.orderBy("org_id", "section", "part", F.desc("down"), "s1", "s2")
    ordered.select("org_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("org_id").text(path)
