"""Getting text out of files and chat request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File types and size limits.
FILE_EXTENSIONS = [".txt", ".md", ".csv", ".pdf", ".docx", ".xlsx"]
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".md": "text/markdown",
}
MIME_DEFAULT = "text/plain"
MAX_CHARS = 500_000
MAX_BYTES = 20 * 1024 * 1024
CHARS_PER_PAGE = 2000
CHARS_PER_TOKEN = 4


def extension_of(path: Column) -> Column:
    """Lower-cased extension with its dot; '' without one (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def mime_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension_of(path)), F.lit(MIME_DEFAULT))


def extract_text(content: Column, mime: Column) -> Column:
    """UTF-8 text for textual types; otherwise UTF-8 with everything unprintable blanked.

    Malformed bytes become U+FFFD; spreadsheets, which have no fallback, become empty.
    """
    m = F.lower(F.coalesce(mime, F.lit(MIME_DEFAULT)))
    text = F.make_valid_utf8(content.cast("string"))
    textual = m.startswith("text/") | m.isin("application/json", "application/csv")
    return (
        F.when(textual, text)
        .when(m == MIME_TYPES[".xlsx"], F.lit(""))
        .otherwise(F.regexp_replace(text, r"[^\x20-\x7E\n\r\t]", " "))
    )


def size_error(text: Column, n_bytes: Column | None = None, max_chars: int = MAX_CHARS) -> Column:
    """Error code of a record that is too large, else NULL."""
    out = F.when(F.length(text) > max_chars, "TEXT_TOO_LARGE")
    return out if n_bytes is None else out.when(n_bytes > MAX_BYTES, "FILE_TOO_LARGE")


def split_by_size(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry ``error_code``."""
    checked = df.withColumn("error_code", size_error(F.col(text)))
    return checked.filter("error_code IS NULL").drop("error_code"), checked.filter("error_code IS NOT NULL")


def page_estimate(n_chars: Column) -> Column:
    return F.ceil(n_chars / F.lit(CHARS_PER_PAGE))


def token_estimate(n_chars: Column) -> Column:
    return F.ceil(n_chars / F.lit(CHARS_PER_TOKEN))


# --- chat bodies -----------------------------------------------------------------------
# A JSON value is looked at as text first, because the same field may hold a string, an array of
# strings or an array of blocks. get_json_object on a string drops the quotes, so the type is read
# from a one-field VARIANT.

_NO_TEXT = "CAST(array() AS ARRAY<STRING>)"


def _is(kind: str, v: str) -> str:
    return f"schema_of_variant({v}) {'= ' + repr('STRING') if kind == 'string' else 'LIKE ' + repr('ARRAY<%')}"


def _string(v: str) -> str:
    return f"IF({_is('string', v)}, array(CAST({v} AS STRING)), {_NO_TEXT})"


def _strings(v: str) -> str:
    """The string elements of an array (or the string itself)."""
    items = f"filter(CAST({v} AS ARRAY<VARIANT>), p -> {_is('string', 'p')})"
    return f"CASE WHEN {_is('string', v)} THEN array(CAST({v} AS STRING)) WHEN {_is('array', v)} THEN transform({items}, p -> CAST(p AS STRING)) ELSE {_NO_TEXT} END"


def _blocks(v: str) -> str:
    """A string, or the text of the blocks of type 'text'."""
    items = f"filter(CAST({v} AS ARRAY<VARIANT>), b -> try_variant_get(b, '$.type', 'string') = 'text' AND try_variant_get(b, '$.text', 'string') IS NOT NULL)"
    return f"CASE WHEN {_is('string', v)} THEN array(CAST({v} AS STRING)) WHEN {_is('array', v)} THEN transform({items}, b -> variant_get(b, '$.text', 'string')) ELSE {_NO_TEXT} END"


def _messages(body: str, each) -> str:
    msgs = f"variant_get({body}, '$.messages')"
    content = "variant_get(m, '$.content')"
    return f"IF({_is('array', msgs)}, flatten(transform(CAST({msgs} AS ARRAY<VARIANT>), m -> {each(content)})), {_NO_TEXT})"


def _joined(body: str, *parts) -> Column:
    """Text parts joined by newline; a body that is not JSON has none."""
    full = ", ".join(f"coalesce({p}, {_NO_TEXT})" for p in parts)
    return F.expr(f"array_join(flatten(transform(array(try_parse_json({body})), b -> concat({full}))), '\\n')")


def chat_text_openai(body: str) -> Column:
    """messages[].content (string or text blocks), then prompt, then input."""
    return _joined(body, _messages("b", _blocks), _strings("variant_get(b, '$.prompt')"), _strings("variant_get(b, '$.input')"))


def chat_text_anthropic(body: str) -> Column:
    """system (string or text blocks), then messages[].content."""
    return _joined(body, _blocks("variant_get(b, '$.system')"), _messages("b", _blocks))


def chat_text_sdk(body: str) -> Column:
    """Reduced form: string contents, string prompt, string input."""
    return _joined(body, _messages("b", _string), _string("variant_get(b, '$.prompt')"), _string("variant_get(b, '$.input')"))


def conversation_text(turns: DataFrame, part_chars: int = MAX_CHARS, slot: int = 1000) -> DataFrame:
    """Turns of each conversation, in order, joined by newline: ``(conv_id, part, n_turns, n_chars, text)``.

    A conversation longer than ``part_chars`` comes out in numbered parts; a turn belongs to the part in
    which it starts, and no text is left out. Where a turn starts is a running sum: slots of turn
    numbers are summed first (map-side combined), and only these sums are put in order per
    conversation, so a very long one is spread over its slots.
    """
    size = F.length("text") + F.when(F.col("text").isNull(), 0).otherwise(1)
    rows = turns.select("conv_id", "turn", "text", F.floor(F.col("turn") / slot).alias("slot"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("conv_id", "slot").agg(F.sum("size").alias("size"))
    base = F.coalesce(F.sum("size").over(earlier("conv_id").orderBy("slot")), F.lit(0))
    slots = slots.select(F.col("conv_id").alias("c"), F.col("slot").alias("s"), base.alias("base"))
    inside = F.coalesce(F.sum("size").over(earlier("conv_id", "slot").orderBy("turn", "text")), F.lit(0))
    placed = rows.withColumn("inside", inside).join(slots, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("slot").eqNullSafe(F.col("s")))
    part = F.floor((F.col("base") + F.col("inside")) / part_chars).alias("part")
    parts = placed.select("conv_id", part, "turn", "text").groupBy("conv_id", "part")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    out = parts.agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(ordered, "\n").alias("text"))
    return out.select("conv_id", "part", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")
