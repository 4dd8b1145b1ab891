"""SQL surface: detection, decision, redaction and validators as temporary SQL functions.

They are SQL functions with expression bodies, not Python UDFs, so Catalyst inlines them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskwright.functions import spans
from maskwright.functions.patterns import DEFAULT_RULES
from maskwright.functions.redaction import redact_sql
from maskwright.functions.validators import CHECKS_SQL

_NAMES = {
    "iban": "iban_valid",
    "card": "card_valid",
    "bsn": "bsn_valid",
    "cpr": "cpr_valid",
    "personnummer": "personnummer_valid",
    "cnp": "cnp_valid",
    "phone": "phone_digits_valid",
    "email_format": "email_format_valid",
}


def definitions() -> dict[str, str]:
    """Function name -> CREATE statement."""
    out = {}

    def define(name: str, args: str, returns: str, body: str) -> None:
        out[name] = f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}"

    for check, name in _NAMES.items():
        define(name, "v STRING", "BOOLEAN", CHECKS_SQL[check]("v"))
    span = spans.SPAN_TYPE.replace("start:int", "start INT").replace("ord:int", "ord INT").replace("end:int", "end INT")
    span = span.replace("type:string", "type STRING").replace("value:string", "value STRING").replace("country:string", "country STRING")
    one_pass = "aggregate(array({raw}), {none}, (a, raw) -> {resolved})"
    body = one_pass.format(raw=spans.raw_sql("txt"), none=spans.NO_SPANS, resolved=spans.resolve_sql("raw"))
    define("detect", "txt STRING", span, body)
    define("detected_types", f"m {span}", "ARRAY<STRING>", "array_distinct(transform(m, x -> x.type))")
    rules = ", ".join(f"'{t}', '{a}'" for t, a in DEFAULT_RULES.items())
    verdicts = f"transform(types, t -> try_element_at(map({rules}), t))"
    action = f"CASE WHEN array_contains({verdicts}, 'BLOCK') THEN 'BLOCK' WHEN array_contains({verdicts}, 'WARN') THEN 'WARN' ELSE 'ALLOW' END"
    define("action_of", "types ARRAY<STRING>", "STRING", action)
    for mode in ("tag", "blank", "hash"):
        define(f"redact_{mode}", f"txt STRING, found {span}", "STRING", redact_sql("txt", "found", mode))
    out["explode_matches"] = (
        f"CREATE OR REPLACE TEMPORARY FUNCTION explode_matches(found {span}) "
        "RETURNS TABLE (type STRING, start INT, end INT, value STRING) "
        "RETURN SELECT x.type, x.start, x.end, x.value FROM explode(found) AS e(x)"
    )
    return out


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; returns their names."""
    made = definitions()
    for statement in made.values():
        spark.sql(statement)
    return list(made)
