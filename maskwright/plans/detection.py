"""Detection over a corpus: one query per detector, whole packs, and the validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import spans, validators
from maskwright.functions.candidates import SHAPES, candidates
from maskwright.plans import detect_sql as D
from maskwright.plans.registry import query
from maskwright.sources.files import spread
from maskwright.sources.golden import seeded

SPAN_COLUMNS = "count(*) AS n_matches, string_agg(s || '-' || e, ',' ORDER BY s, ord) AS spans"


def _listed(df, key, extra=()):
    """One row per text with matches: how many, and where."""
    hits = df.filter(F.size("matches") > 0)
    return hits.select(
        key,
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(spans.positions(F.col("matches")), ",").alias("spans"),
        *extra,
    )


def _typed():
    return F.array_join(F.transform("matches", lambda m: m["type"]), ",").alias("types")


def _one_type(name, type_, pack="server"):
    ctes = D.raw_cte(D.SEEDED, "doc_id", [type_], pack)
    ctes.update(D.fold("kept", "sp", "doc_id"))

    @query(name, f"SELECT doc_id, {SPAN_COLUMNS} FROM kept GROUP BY doc_id", ctes)
    def job(t):
        docs = seeded(t.documents).select("doc_id", "text")
        return _listed(spans.with_matches(docs, types=[type_], pack=pack), "doc_id")


_one_type("det_email", "EMAIL")
_one_type("det_phone", "PHONE")
_one_type("det_iban", "IBAN")
_one_type("det_card", "CREDIT_CARD")
_one_type("det_address", "ADDRESS")
_one_type("det_address_client", "ADDRESS", "client")
_one_type("det_secret", "PASSWORD")
_one_type("det_vat", "VAT")
_one_type("det_ip", "IP_ADDRESS")
_one_type("det_dob", "DATE_OF_BIRTH")

_ids = D.raw_cte(D.SEEDED, "doc_id", ["NATIONAL_ID"])
_ids.update(D.fold("kept", "sp", "doc_id"))


@query(
    "det_national_id",
    f"""SELECT k.doc_id, n_matches, spans, countries FROM (SELECT doc_id, {SPAN_COLUMNS} FROM kept GROUP BY doc_id) k
    JOIN (SELECT doc_id, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM sp GROUP BY doc_id) c ON c.doc_id = k.doc_id""",
    _ids,
)
def det_national_id(t):
    """Resolved spans, and the set of countries whose pattern and checksum match anywhere."""
    docs = seeded(t.documents).select("doc_id", "text")
    raw = spans.with_raw_and_matches(docs, types=["NATIONAL_ID"])
    countries = F.array_join(F.array_sort(F.array_distinct(F.transform("raw", lambda m: m["country"]))), ",")
    return _listed(raw, "doc_id", [countries.alias("countries")])


TERMS = ["widget", "The", "", "main st"]


@query(
    "det_custom_terms",
    f"SELECT doc_id, {SPAN_COLUMNS} FROM cu GROUP BY doc_id",
    {"corpus": D.SEEDED, **D.term_cte("doc_id", "['widget', 'The', '', 'main st']")},
)
def det_custom_terms(t):
    docs = seeded(t.documents).select("doc_id", "text").withColumn("terms", F.array(*[F.lit(x) for x in TERMS]))
    df = docs.withColumn("matches", F.array_sort(F.expr(spans.terms_sql("text", "terms"))))
    return _listed(df, "doc_id")


def _pack(name, pack):
    ctes = D.raw_cte(D.SEEDED, "doc_id", None, pack)
    ctes.update(D.fold("kept", "sp", "doc_id"))
    ctes.update(D.term_cte("doc_id", "['widget', 'main st']"))
    ctes["allm"] = "SELECT doc_id, s, e, ord, type FROM kept UNION ALL SELECT doc_id, s, e, ord, type FROM cu"

    @query(
        name,
        f"SELECT doc_id, {SPAN_COLUMNS}, string_agg(type, ',' ORDER BY s, ord) AS types FROM allm GROUP BY doc_id",
        ctes,
    )
    def job(t):
        docs = seeded(t.documents).select("doc_id", "text").withColumn("terms", F.array(F.lit("widget"), F.lit("main st")))
        return _listed(spans.with_matches(docs, pack=pack, terms="terms"), "doc_id", [_typed()])


_pack("det_all_server", "server")
_pack("det_all_client", "client")

_all = D.raw_cte(D.SEEDED, "doc_id")
_all.update(D.fold("kept", "sp", "doc_id"))


@query(
    "det_types",
    """SELECT c.doc_id, coalesce(x.types, '') AS types FROM corpus c LEFT JOIN (
         SELECT doc_id, string_agg(type, ',' ORDER BY s) AS types FROM (SELECT doc_id, type, min(s) AS s FROM kept GROUP BY doc_id, type) GROUP BY doc_id
       ) x ON x.doc_id = c.doc_id""",
    _all,
)
def det_types(t):
    df = spans.with_matches(seeded(t.documents).select("doc_id", "text"))
    return df.select("doc_id", F.array_join(spans.types_of(F.col("matches")), ",").alias("types"))


_pages = D.raw_cte("SELECT page_id, coalesce(html, '') AS text FROM pages", "page_id")
_pages.update(D.fold("kept", "sp", "page_id"))


@query(
    "det_pages",
    f"SELECT page_id, {SPAN_COLUMNS}, string_agg(type, ',' ORDER BY s, ord) AS types FROM kept GROUP BY page_id",
    _pages,
)
def det_pages(t):
    """HTML is text: decoded, tags left in."""
    df = spans.with_matches(spread(t.pages).select("page_id", F.col("html").alias("text")))
    return _listed(df, "page_id", [_typed()])


@query("u_matches", "SELECT doc_id, type, s AS start_at, e AS end_at, ord, coalesce(country, '') AS country FROM sp", _all)
def u_matches(t):
    """Long union of the matches of every pattern, before resolution."""
    df = spans.with_raw_and_matches(seeded(t.documents).select("doc_id", "text"))
    m = spans.explode_matches(df, ["doc_id"], "raw")
    return m.select(
        "doc_id",
        "type",
        F.col("start").cast("long").alias("start_at"),
        F.col("end").cast("long").alias("end_at"),
        "ord",
        F.coalesce("country", F.lit("")).alias("country"),
    )


@query("u_types", "SELECT DISTINCT source, type FROM kept JOIN corpus USING (doc_id)", _all)
def u_types(t):
    df = spans.with_matches(seeded(t.documents).select("doc_id", "source", "text"))
    return df.select("source", F.explode_outer(spans.types_of(F.col("matches"))).alias("type")).filter("type IS NOT NULL").distinct()


# --- validators over the candidates of their kind in the corpus -------------------------------

def _candidate_sql(shape):
    """Any stretch of whole pieces of letters and digits, and what stands between them, that fits the shape from end to end."""
    group, first = ("[A-Za-z0-9]+", "[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]*") if shape.account else ("[0-9]+", "[0-9]+")
    return {
        "corpus": D.SEEDED,
        "pieces": "SELECT row_number() OVER () AS r, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM corpus",
        "begins": f"SELECT r, p, i FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM pieces) WHERE regexp_full_match(p[i], '{first}')",
        "stretches": f"SELECT array_to_string(p[i:j], '') AS value FROM (SELECT p, i, unnest(range(i, least(i + {2 * shape.most}, len(p) + 1), 2)) AS j FROM begins)",
        "cand": f"SELECT DISTINCT value FROM stretches WHERE regexp_full_match(value, '{first}({shape.parts}{group})*') "
        f"AND length(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) BETWEEN {shape.least} AND {shape.most}",
    }


for _name, _check, _sql in [
    ("iban_valid", "iban", D.iban),
    ("card_valid", "card", D.card),
    ("bsn_valid", "bsn", D.bsn),
    ("cpr_valid", "cpr", D.cpr),
    ("personnummer_valid", "personnummer", D.personnummer),
    ("cnp_valid", "cnp", D.cnp),
    ("phone_digits_valid", "phone", D.phone),
]:

    @query(_name, f"SELECT value, {_sql('value')} AS valid FROM cand", _candidate_sql(SHAPES[_check]))
    def _job(t, check=_check):
        """Each different candidate of the kind in the corpus, and whether it is valid."""
        found = seeded(t.documents).select(F.explode(candidates(check, F.col("text"))).alias("value")).distinct()
        return found.select("value", validators.column(check, "value").alias("valid"))


@query(
    "email_format_valid",
    r"""SELECT id, regexp_matches(coalesce(email, 'no mail'), '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS valid FROM users""",
)
def email_format_valid(t):
    return t.users.select("id", validators.column("email_format", "coalesce(email, 'no mail')").alias("valid"))
