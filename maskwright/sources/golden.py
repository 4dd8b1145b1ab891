"""Seeded corpus: every document with one golden text appended.

The test documents hold few identifiers besides e-mails, phones, cards and tokens; the golden
texts together hit every pattern. Token-shaped strings are spelled as expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.sources.files import spread

# Test texts, in case order.
GOLDEN = [
    "mail john@test.com now",
    "call +45 12 34 56 78",
    "call (555) 123-4567",
    "ring 020 7946 0958",
    "IBAN: DE89 3704 0044 0532 0130 00",
    "bad DE00370400440532013000",
    "card: 4111 1111 1111 1111",
    "card: 4111 1111 1111 1112",
    "at 123 Main St",
    "office at SW1A 1AA London",
    "bor i 2200 København",
    "Adresse: 10115 Berlin",
    "postcode 1011 AB Amsterdam",
    "config: password=SuperSecret123!",
    "api_key=abc",
    "auth_token: abc",
    "otp 123456",
    "sk_" + "live_" + "a" * 24,
    "sk-" + "test-" + "b" * 24,
    "key is AKIA" + "IOSFODNN7EXAMPLE",
    "ghp_" + "A" * 36,
    "gho_" + "A" * 36,
    "ghs_" + "A" * 36,
    "glpat-" + "abcdefghijklmnopqrstu",
    "xoxb-" + "123456789012-abcdef",
    "xoxp-" + "123456789012-abcdef",
    "Bearer " + "eyJhbGciOiJIUzI1NiJ9.abc",
    "cpr 311280-0008",
    "cpr 321280-0008",
    "pnr 850101-1236",
    "hetu 131052A308T",
    "no 120112345678",
    "dni 12345678Z",
    "bsn 123456782",
    "insee 1 85 05 78 006 084 36",
    "cf RSSMRA85T10A562S",
    "pesel 44051401359",
    "cnp 1800101221128",
    "nif 501442600",
    "niss 85.07.30-033.28",
    "svnr 1237 010180",
    "vat DE123456789",
    "host 152.143.123.131",
    "host 127.0.0.1",
    "dob: 01/02/1990",
    "born on 1990-02-01",
    "Hello, how are you today?",
    "é12345678Z",
    "Order number: 12345678",
    "a@b.com and c@d.com",
    "IBAN DE89370400440532013000, card 4111-1111-1111-1111, mail a@b.com",
    "my number is +1-555-123-4567",
    "ring +4512345678",
    "Ref +1234",
    "Invoice ID: 20230915001",
    "address: 123 Main St, Springfield 62704",
    "postnummer 111 22 Stockholm",
    "adresse: 0150 Oslo",
]


def seeded(documents: DataFrame) -> DataFrame:
    """``documents`` with the golden text number ``doc_id % 58`` appended to ``text``."""
    documents = spread(documents)
    texts = F.array(*[F.lit(g) for g in GOLDEN])
    extra = F.get(texts, (F.col("doc_id") % len(GOLDEN)).cast("int"))
    return documents.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), extra))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CORPUS_SQL = (
    "SELECT doc_id, lang, source, n_chars, coalesce(text, '') || ' ' || g.golden AS text FROM documents JOIN (VALUES "
    + ", ".join(f"({i}, {_quoted(g)})" for i, g in enumerate(GOLDEN))
    + f") g(i, golden) ON g.i = doc_id % {len(GOLDEN)}"
)
