"""Replacing spans: by placeholder, by a blank block, or by a short hash."""

from __future__ import annotations

from maskwright.functions.patterns import BLANK, PLACEHOLDER_OTHER, PLACEHOLDERS
from maskwright.functions.spans import BLOCK, let_sql


def placeholder_sql(type_: str) -> str:
    pairs = ", ".join(f"'{t}', '{p}'" for t, p in PLACEHOLDERS.items())
    return f"coalesce(try_element_at(map({pairs}), {type_}), '{PLACEHOLDER_OTHER}')"


def _replacement(mode: str) -> str:
    if mode == "tag":
        return placeholder_sql("m.type")
    if mode == "blank":
        return f"'{BLANK}'"
    if mode == "hash":
        return "concat('[', m.type, ':', substr(sha2(m.value, 256), 1, 8), ']')"
    raise ValueError(f"unknown redaction mode {mode!r}")


def redact_sql(text: str, spans: str, mode: str = "tag") -> str:
    """Disjoint, sorted ``spans`` of ``text`` replaced.

    Each span contributes the text since the previous one plus its replacement. Finding a position
    in UTF-8 means walking to it, so the text is cut once per block of spans and the pieces are
    taken from that cut; everything is joined once at the end.
    """
    t = f"coalesce({text}, '')"
    block = f"slice({spans}, b * {BLOCK} + 1, {BLOCK})"
    offset = f"IF(b = 0, 0, {spans}[b * {BLOCK} - 1].end)"
    cut = f"substr({t}, {offset} + 1, element_at({block}, -1).end - {offset})"
    before = "IF(i = 0, c.offset, c.block[i - 1].end)"
    piece = f"concat(substr(c.cut, {before} - c.offset + 1, m.start - {before}), {_replacement(mode)})"
    named = f"named_struct('block', {block}, 'offset', {offset}, 'cut', {cut})"
    joined = let_sql("c", named, f"array_join(transform(c.block, (m, i) -> {piece}), '')", "''")
    body = f"array_join(transform(sequence(0, CAST((size({spans}) - 1) div {BLOCK} AS INT)), b -> {joined}), '')"
    tail = f"substr({t}, element_at({spans}, -1).end + 1)"
    return f"IF(size({spans}) = 0, {t}, concat({body}, {tail}))"
