"""Match spans as array columns: extraction, overlap resolution, whole-pack detection.

A span is ``struct(start, ord, end, type, value, country)``; the field order makes the natural
struct ordering equal to "by start, then detector order", so plain ``array_sort`` needs no
comparator. Everything is row-local: scanning a corpus adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.automaton import find_terms
from maskwright.functions.patterns import CUSTOM_ORD, CUSTOM_TERM, DIGIT_CONTEXT, PACKS, Detector
from maskwright.functions.validators import CHECKS_SQL

SPAN_TYPE = "array<struct<start:int,ord:int,end:int,type:string,value:string,country:string>>"

# gate name -> condition on the text {t}, its lower-cased form {l} or its digit contexts {c}; the
# cheapest and rarest test comes first, and flags shared by several gates are {flag} columns
_FLAGS = {
    "us": "contains({t}, '_')",
    "digit": "length({c}) > 0",
    "d6": "{c} RLIKE '[0-9]{{6}}'",
    # two digits behind a letter; written digit first, because digits are rarer than letters
    "letdig": "{c} RLIKE '[0-9]{{2}}' AND {t} RLIKE '[0-9](?<=[A-Za-z][0-9])[0-9]'",
}
_GATES = {
    "letdig": "{letdig}",
    "capdig": "{letdig} AND {t} RLIKE '[0-9](?<=[A-Z][0-9])[0-9]'",
    "@": "contains({t}, '@')",
    "+": "{digit} AND contains({t}, '+')",
    "(": "{digit} AND contains({t}, '(')",
    "pass": "(contains({l}, 'passw') OR contains({l}, 'pwd'))",
    "api": "contains({l}, 'api')",
    "secret": "(contains({l}, 'secret') OR contains({l}, 'token'))",
    "otp": "{d6} AND (contains({l}, 'otp') OR contains({l}, '2fa') OR contains({l}, 'mfa'))",
    "live": "(contains({t}, 'sk-live') OR ({us} AND contains({t}, 'sk_live')))",
    "test": "(contains({t}, 'sk-test') OR ({us} AND contains({t}, 'sk_test')))",
    "AKIA": "contains({t}, 'AKIA')",
    "ghp_": "{us} AND contains({t}, 'ghp_')",
    "gho_": "{us} AND contains({t}, 'gho_')",
    "ghs_": "{us} AND contains({t}, 'ghs_')",
    "glpat-": "contains({t}, 'glpat-')",
    "xox": "{digit} AND contains({t}, 'xox')",
    "Bearer": "contains({t}, 'Bearer')",
    "birth": "{digit} AND (contains({l}, 'dob') OR contains({l}, 'born') OR contains({l}, 'birth'))",
}


def sql_text(value: str) -> str:
    """String literal for Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gate_sql(d: Detector, names: dict[str, str]) -> str | None:
    """Cheap necessary condition for a detector to match; saves its regex pass on most texts.

    ``names`` maps t, l, c and the flags to columns or expressions.
    """
    if d.shape is not None:
        return f"{names['c']} RLIKE {sql_text(d.shape)}"
    return _GATES[d.gate].format(**names) if d.gate else None


NO_SPANS = f"CAST(array() AS {SPAN_TYPE})"


def _span_sql(start: str, size: str, ord_: str, type_: str, value: str, country: str | None) -> str:
    land = f"'{country}'" if country else "CAST(NULL AS STRING)"
    return (
        f"named_struct('start', {start}, 'ord', {ord_}, 'end', {start} + {size}, "
        f"'type', '{type_}', 'value', {value}, 'country', {land})"
    )


BLOCK = 256


def let_sql(name: str, value: str, body: str, zero: str) -> str:
    """``let name = value in body`` inside an expression; ``zero`` is any value of the result type."""
    return f"aggregate(array({value}), {zero}, (_zero, {name}) -> {body})"


def fold_sql(items: str, state: str, start: str, step: str) -> str:
    """Fold of the array ``items`` (a name) into spans: ``step`` maps (acc, x) to the next acc.

    acc is ``struct(<state>, out)``. Appending to an array copies it, so the fold runs in blocks:
    appends copy within a block, and whole blocks are appended to the result. A text with very
    many matches then costs far less than the square of their number.
    """
    inner = (
        f"aggregate(slice({items}, b * {BLOCK} + 1, {BLOCK}), named_struct('{state}', st.{state}, 'out', {NO_SPANS}), "
        f"(acc, x) -> {step}, r -> named_struct('{state}', r.{state}, 'out', concat(st.out, r.out)))"
    )
    return (
        f"aggregate(sequence(0, CAST((size({items}) - 1) div {BLOCK} AS INT)), "
        f"named_struct('{state}', {start}, 'out', {NO_SPANS}), (st, b) -> {inner}, st -> st.out)"
    )


def detector_sql(text: str, d: Detector, on: str | None = None) -> str:
    """All valid matches of one detector in column ``text``, as a Spark SQL expression.

    Matches and the gaps between them alternate, so adding up their lengths gives exact offsets.
    Validation comes after placing, because the offsets need every raw match.
    """
    pattern = sql_text(d.jvm)
    values = f"regexp_extract_all({text}, {pattern}, 0)"
    if on:
        values = f"IF({on}, {values}, CAST(array() AS ARRAY<STRING>))"
    hit = _span_sql("acc.pos + x.g", "length(x.v)", str(d.ord), d.type, "x.v", d.country)
    gaps = f"split({text}, {pattern}, -1)"
    step = f"IF(x.v IS NULL, acc, named_struct('pos', acc.pos + x.g + length(x.v), 'out', concat(acc.out, array({hit}))))"
    pairs = f"zip_with(found, {gaps}, (v, g) -> named_struct('v', v, 'g', length(g)))"
    placed = let_sql("pairs", pairs, fold_sql("pairs", "pos", "0", step), NO_SPANS)
    # a one-element fold names the matches, so that the pattern runs once to find them
    spans = let_sql("found", values, f"IF(size(found) = 0, {NO_SPANS}, {placed})", NO_SPANS)
    return f"filter({spans}, m -> {CHECKS_SQL[d.check]('m.value')})" if d.check else spans


def _chosen(pack: str, types: Sequence[str] | None) -> list[Detector]:
    return [d for d in PACKS[pack] if types is None or d.type in types]


def enabled_types(pack: str, switches: dict[str, bool] | None) -> list[str] | None:
    """Only an explicit False turns a type off; a missing key leaves it on."""
    if switches is None:
        return None
    return [t for t in dict.fromkeys(d.type for d in PACKS[pack]) if switches.get(t) is not False]


def raw_sql(text: str, types: Sequence[str] | None = None, pack: str = "server") -> str:
    """Concatenated spans of the chosen types, before overlap resolution."""
    parts = [detector_sql(f"coalesce({text}, '')", d) for d in _chosen(pack, types)]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def resolve_sql(spans: str) -> str:
    """Sort by start (detector order on ties) and keep a span only if it starts at or after the
    end of the last kept one."""
    step = "IF(x.start >= acc.last, named_struct('last', x.end, 'out', concat(acc.out, array(x))), acc)"
    kept = let_sql("ordered", f"array_sort({spans})", fold_sql("ordered", "last", "-1", step), NO_SPANS)
    return f"IF(size({spans}) < 2, {spans}, {kept})"


def terms_sql(text: str, terms: str, lowered: str | None = None) -> str:
    """Case-insensitive, per term non-overlapping occurrences of the tenant's own terms.

    ``terms`` is an ``array<string>`` column; empty and NULL terms are skipped.
    """
    t = f"coalesce({text}, '')"
    low = lowered or f"lower({t})"
    quoted = "concat('\\\\Q', replace(lower(term), '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    at = "acc.pos + length(x)"
    hit = _span_sql(at, "length(term)", f"{CUSTOM_ORD} + i", CUSTOM_TERM, "CAST(NULL AS STRING)", None)
    step = f"named_struct('pos', {at} + length(term), 'out', concat(acc.out, array({hit})))"
    # the text behind the last gap is not a match
    gaps = f"split({low}, {quoted}, -1)"
    placed = let_sql("gaps", gaps, let_sql("hits", "slice(gaps, 1, size(gaps) - 1)", fold_sql("hits", "pos", "0", step), NO_SPANS), NO_SPANS)
    return f"""flatten(transform(coalesce({terms}, CAST(array() AS ARRAY<STRING>)), (term, i) ->
        IF(coalesce(term, '') = '' OR NOT contains({low}, lower(term)), {NO_SPANS}, {values_sql(t, placed)})))"""


# lists up to this size are tried term by term
SHORT_LIST = 64


def many_terms_sql(text: str, terms: str, hits: str) -> str:
    """Spans of the places that ``hits`` (term, start) lists; term by term where it is NULL."""
    hit = _span_sql("h.start", f"length({terms}[h.i])", f"{CUSTOM_ORD} + h.i", CUSTOM_TERM, "CAST(NULL AS STRING)", None)
    found = values_sql(f"coalesce({text}, '')", f"array_sort(transform({hits}, h -> {hit}))")
    return f"IF({hits} IS NULL, {terms_sql(text, terms)}, {found})"


def with_term_hits(df: DataFrame, text: str, terms: str, name: str) -> DataFrame:
    """``df`` plus the places of the terms of long lists, found in one pass; NULL where the list is short.

    A list travels with its row, as one string; a worker builds its automaton once. A term that holds a
    NUL, which parts terms, leaves its list to be tried term by term.
    """
    long = f"coalesce(size({terms}), 0) > {SHORT_LIST} AND NOT exists({terms}, t -> contains(coalesce(t, ''), '\\0'))"
    listed = F.expr(f"IF({long}, array_join(transform({terms}, t -> lower(coalesce(t, ''))), '\\0'), CAST(NULL AS STRING))")
    return df.withColumn(name, find_terms(F.expr(f"IF({long}, lower(coalesce({text}, '')), CAST(NULL AS STRING))"), listed))


def values_sql(text: str, placed: str) -> str:
    """Fill in the values of spans that are in order of their starts; the text is cut once per block of spans."""
    block = f"slice(bare, b * {BLOCK} + 1, {BLOCK})"
    offset = f"bare[b * {BLOCK}].start"
    cut = f"substr({text}, {offset} + 1, array_max(transform({block}, m -> m.end)) - {offset})"
    filled = (
        "named_struct('start', m.start, 'ord', m.ord, 'end', m.end, 'type', m.type, "
        f"'value', substr(cut, m.start - {offset} + 1, m.end - m.start), 'country', m.country)"
    )
    per_block = let_sql("cut", cut, f"transform({block}, m -> {filled})", NO_SPANS)
    blocks = f"flatten(transform(sequence(0, CAST((size(bare) - 1) div {BLOCK} AS INT)), b -> {per_block}))"
    return let_sql("bare", placed, f"IF(size(bare) = 0, {NO_SPANS}, {blocks})", NO_SPANS)


def detect(
    text: str,
    types: Sequence[str] | None = None,
    pack: str = "server",
    terms: str | None = None,
) -> Column:
    """Resolved built-in matches of column ``text``, plus term matches merged in by start (not
    re-resolved), as one column expression. For whole corpora prefer :func:`with_matches`."""
    raw = raw_sql(text, types, pack)
    built_in = let_sql("raw", raw, resolve_sql("raw"), NO_SPANS)
    return F.expr(built_in if terms is None else merge_sql(built_in, terms_sql(text, terms)))


def merge_sql(built_in: str, custom: str) -> str:
    return f"array_sort(concat({built_in}, {custom}))"


def _once(expr: str) -> str:
    """Evaluate ``expr`` exactly once per row.

    The optimizer merges projections and pushes filters through them by copying expressions; it
    does neither across a generator. OUTER keeps it from adding a filter on the generator's input.
    """
    return f"explode_outer(array({expr}))"


def with_raw_and_matches(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] | None = None,
    pack: str = "server",
    gated: bool = True,
    switches: str | None = None,
) -> DataFrame:
    """``df`` plus ``raw`` (all valid spans) and ``matches`` (overlaps resolved).

    ``switches`` names a map column from type to boolean: a type that a row's map sets to false is off
    in that row, before overlaps are resolved; a missing key, value or map leaves it on.

    Gates are a projection of their own; raw spans and resolved matches come out of one-element
    generators, so neither later columns nor pushed-down filters can evaluate them again.
    """
    chosen = _chosen(pack, types)
    names = {"t": "_txt", "l": "_low", "c": "_ctx", **{f: f"_f_{f}" for f in _FLAGS}}
    tests = list(dict.fromkeys(gate_sql(d, names) for d in chosen)) if gated else []
    on = lambda d: f"_gates.g{tests.index(gate_sql(d, names))}" if gated else None
    parts = [detector_sql("_txt", d, on(d)) for d in chosen]
    raw = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    flags = ", ".join(f"{c} AS g{i}" for i, c in enumerate(tests)) or "true AS g0"
    if tests:  # most texts pass no gate at all
        raw = f"IF({' OR '.join(f'_gates.g{i}' for i in range(len(tests)))}, {raw}, {NO_SPANS})"
    contexts = f"array_join(regexp_extract_all(_txt, {sql_text(DIGIT_CONTEXT)}, 0), '|')"
    staged = (
        df.selectExpr("*", f"coalesce({text}, '') AS _txt")
        .selectExpr("*", "lower(_txt) AS _low", f"{contexts} AS _ctx")
        .selectExpr("*", *[f"{c.format(**names)} AS _f_{f}" for f, c in _FLAGS.items()])
        .selectExpr("*", f"struct({flags}) AS _gates")
        .selectExpr("*", f"{_once(raw if switches is None else switched_sql(raw, switches))} AS raw")
        .selectExpr("*", f"{_once(resolve_sql('raw'))} AS matches")
    )
    return staged.select(*df.columns, "raw", "matches")


def switched_sql(spans: str, switches: str) -> str:
    return f"filter({spans}, m -> coalesce(try_element_at({switches}, m.type), true))"


def with_matches(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] | None = None,
    pack: str = "server",
    terms: str | None = None,
    switches: str | None = None,
    many_terms: bool = False,
) -> DataFrame:
    """Staged form of :func:`detect` for corpora: ``df`` plus ``matches``.

    ``many_terms``: lists may be long, as stored ones of tenants; they are then looked for in one pass.
    """
    staged = with_raw_and_matches(df, text, types, pack, switches=switches).drop("raw")
    if terms is None:
        return staged
    if many_terms:
        staged = with_term_hits(staged, text, terms, "_hits")
    custom = many_terms_sql(text, terms, "_hits") if many_terms else terms_sql(text, terms)
    return staged.selectExpr(*df.columns, f"{_once(merge_sql('matches', custom))} AS matches")


def types_of(matches: Column) -> Column:
    """Distinct types, in order of first occurrence."""
    return F.array_distinct(F.transform(matches, lambda m: m["type"]))


def positions(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))


def explode_matches(df: DataFrame, keys: Sequence[str], matches: str = "matches") -> DataFrame:
    """Long ``matches`` table: one row per span."""
    long = df.select(*keys, F.explode_outer(matches).alias("m")).filter("m IS NOT NULL")
    return long.select(*keys, "m.type", "m.start", "m.end", "m.value", "m.country", "m.ord")
