"""PII surrogates: every detected entity gets a keyed replacement of the same type and format.

A surrogate is a function of a secret key, the entity's kind, its normal form and an attempt number, so
an entity has the same surrogate wherever it stands (coreference). Surrogates are then checked over
the corpus: where two entities of a kind meet in one surrogate, or a surrogate is an entity that
occurs, all but one go on to their next attempt, until none meet (distinctness).

Formats stay: digits, letters, their case and script, and separators. Given names keep their gender
and script, cards their first digit and check digit, accounts their country and check digits, phone
numbers their country prefix; e-mail addresses end in example.com, and addresses of hosts are private.

A name is the run of words behind a form of address or a given name of the lexicon, with initials,
apostrophes, hyphens, particles and any white space but an empty line. Its words are entities of their
own, and every later or earlier mention of one of them in the same document is replaced alike; there,
words of FUNCTION are left, since they begin sentences. Words in capitals are the same entities, and
their surrogates are in capitals. A later attempt for an initial takes two letters, as in "Th."; initials that
occur may be surrogates of others, as given names may. Of a run of more than nine forms of address the last nine count, and a given name of the lexicon has at most eight hyphens.

Accounts are found in capitals or lower case; in lower case only the group of the bank may be letters.
National ids, VAT numbers, dates of birth, addresses, more phone numbers and secrets are found by the
patterns of the detector catalogue, whether or not their check digits are right. Surrogates of national
ids have right ones and plausible dates; those of VAT numbers keep country and length only. Later attempts
for dates of birth draw from more years, and from 28 days where a number over twelve tells the day from the month.

Where a format has too few values, entities that still meet after LAST_OF_FORMAT attempts get a surrogate
with a tail of ten hex digits; a secret without letters and digits gets one at once.

Defined results: a null or empty text, and one without entities, stays as it is. Very long texts are
searched whole; no alternative recurses or tries a run twice. Repeated rows are treated alike, as are rows
without an id. Other columns are kept as they are, but for one of the name of the result. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import validators
from maskwright.functions.patterns import NATIONAL_ID, PACKS
from maskwright.llm.common import computed_once, packed, stored, unpacked

# Given names by script and gender, and forms of address.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Clara Marie Elena Sofia Martha Helen Lucia Carmen Ingrid Paula",
    ("latin", "m"): "John Peter Paul Thomas Martin David Jean Carlos Hans Karl Robert Simon Oscar Felix Hugo Anton",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Юлия Дарья Вера Нина Софья Полина Алла Лидия",
    ("cyrillic", "m"): "Иван Пётр Павел Сергей Андрей Дмитрий Алексей Николай Михаил Юрий Олег Игорь Борис Антон Роман Фёдор",
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα Δήμητρα Βασιλική Ειρήνη Γεωργία Χριστίνα Αθηνά Ζωή Φωτεινή Λυδία Ρέα",
    ("greek", "m"): "Γιώργος Γιάννης Νίκος Κώστας Δημήτρης Παναγιώτης Βασίλης Χρήστος Ανδρέας Μιχάλης Πέτρος Παύλος Στέφανος Αλέξης Φίλιππος Λεωνίδας",
}
ADDRESS = "Mr Mrs Ms Dr Herr Frau Mme Mlle Monsieur Madame Señor Señora Sr Sra г-н г-жа Κος Κα".split()
# Letters that stand for the sixteen hex digits, by script, vowels and consonants apart.
LETTERS = {
    "latin": ("aeiouaeiouaeioua", "bcdfghklmnprstvz", "aeiouyáàâäãåéèêëíìîïóòôöõúùûüæœøý"),
    "cyrillic": ("аеиоуаеиоуаеиоуа", "бвгдзклмнпрстфхш", "аеёиоуыэюяіїєў"),
    "greek": ("αεηιουωαεηιουωαε", "βγδζθκλμνξπρστφχ", "αεηιουωάέήίόύώϊϋΐΰ"),
}
BLOCKS = {"latin": "A-Za-zÀ-ÖØ-öø-ɏ", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽἀ-῿"}
HEX = "0123456789abcdef"

_NAMES = [n for names in GIVEN.values() for n in names.split()]
# Words that are no mention of a name where they stand alone, and particles inside names.
FUNCTION = (
    "A An The This That These Those And Or But If In On At Of To For From With By As It He She We They You I His Her Their Our My Is Are Was Were "
    "Has Had Have Not No So Then When While After Before Later Now Der Die Das Den Dem Des Ein Eine Und Oder Aber In Im Am Zu Von Mit Für Auf Er Sie "
    "Es Wir Ist War Nicht Le La Les Un Une Et Ou Mais Dans En Au Aux Il Elle Nous Vous Ils Est El Los Las Una Y O Pero No Se Que Con Por Para Lo "
    "В На И С По За От До Он Она Они Мы Вы Это Но Как Не Что Ο Η Το Οι Τα Και Στο Στη Με Για Από Σε Να Δεν"
).split()
PARTICLES = "van von der den dem de del della di da dos du la las le los al bin ibn ben ter ten zu af St Ste".split()
_GAP = r"(?=[\p{Z}\s])[\p{Z}\t\x0B\f]*+(?:(?:\r\n?|\n)[\p{Z}\t\x0B\f]*+)?+"
# letters with inner apostrophes, but without a possessive s
_LETTERS = r"[\p{L}\p{M}]*+(?:['’](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
_PART = rf"\p{{L}}{_LETTERS}"
_WHOLE = rf"(?=\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’]\p{{L}})|d['’]\p{{Lu}}){_PART}(?:[-‐‑]{_PART})*+"
_PARTICLE = rf"(?:(?:van|von)(?:{_GAP}(?:der|den|dem|de))?|de(?:{_GAP}(?:la|las|los))?|del|della|di|da|dos|du|la|le|al|bin|ibn|ben|ter|ten|zu|af|Ste?\.){_GAP}"
_WORD = rf"{_GAP}(?:{_PARTICLE})?(?:(?:\p{{Lu}}\.-?)++(?:{_WHOLE})?+|\p{{Lu}}(?={_GAP}\p{{Lu}})|{_WHOLE})"
_TITLE = rf"(?:{'|'.join(ADDRESS)})\.?"
_LEAD = rf"^(?:{_TITLE}{_GAP})++"
_TOKEN = rf"(?<!\p{{L}})\p{{Lu}}\.|{_PART}|[^\p{{L}}]++"
MENTION = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}])\p{{Lu}}{_LETTERS}"
SPACED = ["card", "phone", "account", "national-FR", "national-AT"]
LAST_OF_FORMAT = 15
# what is not replaced
KEPT = "kept"
_KEYWORD = r"(?i:password|passwd|pwd|api[_-]?key|apikey|secret|access_token|auth_token|token)\s*[:=]\s*|(?i:2fa|totp|otp|mfa)\s*[:=]?\s*(?=[0-9]{6,8}$)"
_SECRET = rf"^(?:{_KEYWORD}|sk[-_](?:live|test)[-_](?=[a-zA-Z0-9]{{24}})|AKIA(?=[A-Z0-9]{{16}}$)|gh[pos]_(?=[a-zA-Z0-9]{{36}}$)|glpat-(?=[a-zA-Z0-9_-]{{20}})|xox[bp]-(?=[0-9]+-)|Bearer\s+(?=[a-zA-Z0-9._-]{{20}}))(?=\S+$)"
_BIRTH = r"^(?i:dob|date of birth|born on|born:?|birthday)\s*[:=]?\s*(?=[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$)"


def catalogue(type_: str, starts: str, *orders: int, guard: str = "") -> str:
    """Patterns of a type by their places in its list (or all), as an alternative without groups behind a look-ahead for the first character."""
    found = [d for d in PACKS["server"] if d.type == type_]
    bodies = [re.sub(r"(?<!\\)\((?!\?)", "(?:", found[i].jvm) for i in orders or range(len(found))]
    return f"(?={starts}){guard}(?:{'|'.join(f'(?i:{b[4:]})' if b.startswith('(?i)') else b for b in bodies)})"


_ID = {country: i for i, country in enumerate(NATIONAL_ID)}
_TO_NAME = rf"(?![0-9]+\s+(?:{'|'.join(ADDRESS + _NAMES)})(?!\p{{L}}))"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def by_first_letter(words: list[str]) -> str:
    """One of the words, as an alternative of first letters."""
    letters = dict.fromkeys(w[0] for w in words)
    return "|".join(f"{c}(?:{'|'.join(re.escape(w[1:]) for w in words if w[0] == c)})" for c in letters)


# What may start at a letter, a digit or a sign, in order of preference. Nothing starts behind an ASCII
# letter and at a letter, or inside a number: most places of a text fail on their first characters.
AT_LETTER = [
    _EMAIL,
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # in lower case, letters only stand for the bank: words of prose are no groups
    r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}(?:\x20?[a-z]{4}(?:\x20?[0-9]{4}){2,6}|(?:\x20?[0-9]{4}){3,7})(?:\x20?[0-9]{1,3})?(?![A-Za-z0-9])",
    catalogue("PASSWORD", "[Pp][AaWw]|[Aa][PpCcUu]|AKIA|[Ss][EeKk]|[Tt][Oo]|[Oo][Tt]|[Mm][Ff]|g[hl]|xo|Be"),
    catalogue("DATE_OF_BIRTH", "[BbDd][AaIiOo]"),
    catalogue("VAT", "[A-Z]{2}U?[0-9]"),
    catalogue("NATIONAL_ID", "[A-Z]{6}[0-9]", _ID["IT"]),
    catalogue("ADDRESS", "[A-Za-z]{1,2}[0-9]", 1),
    rf"(?<!\p{{L}})(?=[{''.join(dict.fromkeys(a[0] for a in ADDRESS))}]){_TITLE}(?:{_GAP}{_TITLE}(?!\p{{L}})){{0,8}}+(?!{_GAP}{_TITLE}(?!\p{{L}}))(?:{_WORD})++",
    rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{by_first_letter(_NAMES)})(?:[-‐‑]{_PART}){{0,8}}+(?:{_WORD})++",
]
AT_DIGIT = [
    _EMAIL,
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    catalogue("PASSWORD", "2", 3),
    catalogue("NATIONAL_ID", "[0-9]", *(_ID[c] for c in ("DK", "SE", "FI", "BE", "FR"))),
    r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    catalogue("NATIONAL_ID", "[0-9]", *(i for c, i in _ID.items() if c != "IT")),
    r"(?<![0-9-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9-])",
    catalogue("PHONE", "0", 2),
    catalogue("ADDRESS", "[0-9]", 0, 2, 3, 4, guard=_TO_NAME),
]
AT_SIGN = [
    _EMAIL,
    r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}",
    r"\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    catalogue("PHONE", "[+(]", 0, 1),
]


def alternatives(*left_out: str) -> str:
    of = lambda several: "|".join(a for a in several if a not in left_out)
    return rf"(?=\p{{L}})(?<![A-Za-z])(?:{of(AT_LETTER)})|(?=[0-9])(?<![0-9])(?:{of(AT_DIGIT)})|(?=[+(._%-])(?:{of(AT_SIGN)})"


PATTERN = alternatives()
_WITHOUT_EMAIL = alternatives(_EMAIL)


def searched(text: Column, search: Callable[[str], Column]) -> Column:
    """``search`` by the pattern. Texts without @ are spared the search for addresses, which reads every word."""
    return F.when(text.contains("@"), search(PATTERN)).otherwise(search(_WITHOUT_EMAIL))


def words_of(value: Column) -> Column:
    """(word, form) of a value. The words of a name and what is between them are apart, and what stands before them or before a secret or date."""
    form = F.when(value.rlike(_SECRET), "secret").when(value.rlike(_BIRTH), "birth")
    form = form.when(value.rlike(r"^\p{L}") & ~value.rlike(r"[@0-9]"), "name").otherwise("")
    lead = F.when(form == "secret", F.regexp_extract(value, _SECRET, 0)).when(form == "birth", F.regexp_extract(value, _BIRTH, 0))
    lead = lead.when(form == "name", F.regexp_extract(value, _LEAD, 0)).otherwise("")
    rest = F.substr(value, F.length(lead) + 1)
    words = F.when(form == "name", F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0))).otherwise(F.array(rest))
    words = F.when(form == "", words).otherwise(F.concat(F.array(lead), words))
    return F.transform(words, lambda w: F.struct(w.alias("word"), form.alias("form")))


def _country(value: Column) -> Column:
    """Country of a national id by its form, and by check digits where forms are alike; null for other values."""
    valid = lambda check: F.expr(validators.CHECKS_SQL[check]("word"))
    like = lambda country: value.rlike(f"^(?:{NATIONAL_ID[country][2:-2]})$")
    nine = F.when(valid("bsn"), "NL").when(like("PT") & (_nif(value) == F.substring(value, 9, 1)), "PT")
    nine = nine.when(_afm(value) == F.substring(value, 9, 1), "GR").otherwise("NL")
    return (
        F.when(like("SE"), F.when(valid("personnummer") | value.contains("+"), "SE").otherwise("DK"))
        .when(like("NL"), nine)
        .when(like("RO") & (valid("cnp") | ~valid("card")), "RO")
        .when(like("NO"), "NO").when(like("FI"), "FI").when(like("ES"), "ES").when(like("FR"), "FR").when(like("IT"), "IT")
        .when(like("PL"), "PL").when(like("BE"), "BE").when(like("AT"), "AT")
    )


def _capitals(word: Column) -> Column:
    """Whether a word of two letters or more is in capitals."""
    return word.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")


def _cased(word: Column) -> Column:
    """A word of a name with one capital, where it is in capitals."""
    return F.when(_capitals(word), F.initcap(F.lower(word))).otherwise(word)


def kind_of(value: Column, form: Column, place: Column) -> Column:
    """Kind of a word by its form and its place in a name."""
    named = form == "name"
    given = F.when(F.lit(False), "")
    for (script, gender), names in GIVEN.items():
        given = given.when(_cased(value).isin(names.split()), f"given-{script}-{gender}")
    return (
        F.when((form != "") & (place == 0), KEPT)
        .when(form.isin("secret", "birth"), form)
        .when(named & (~value.rlike(r"\p{L}") | value.isin(PARTICLES)), KEPT)
        .when(named & value.rlike(r"^\p{Lu}\.?$"), "initial")
        .when(named, F.coalesce(given, F.lit("surname")))
        .when(value.contains("@"), "email")
        .when(value.rlike(r"^[A-Z]{2}U?[0-9]{2,12}$"), "vat")
        .when(value.rlike(r"(?i)^[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}$"), "place")
        .when(value.rlike(r"^[A-Za-z]{2}[0-9]{2}"), "account")
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "host")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national")
        .when(_country(value).isNotNull(), F.concat(F.lit("national-"), _country(value)))
        .when(value.rlike(r"^[0-9]([\x20-]?[0-9]){12,18}$"), "card")
        .when(value.rlike(r"^[0-9]+\s*\p{L}"), "place")
        .otherwise("phone")
    )


def normal(value: Column, kind: Column) -> Column:
    """Spelling does not tell entities apart: case of addresses and accounts, capitals of names, separators of numbers, forms of the apostrophe."""
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin(SPACED), F.regexp_replace(F.upper(value), r"[^0-9A-Z+]", ""))
        .when(kind.rlike("^(given|surname)"), _cased(F.translate(value, "’", "'")))
        .otherwise(F.translate(value, "’", "'"))
    )


def _digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 hex digits, keyed."""
    base = F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(F.lit("2"), base), 256))


def _like(value: Column, digest: Column) -> Column:
    """Every digit and letter of ``value`` is replaced by one of its class from the digest; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        drawn = F.substr(digest, (i % 128 + 1).cast("int"), F.lit(1))
        out = F.when(c.rlike("[0-9]"), F.translate(drawn, HEX, "0123456789012345"))
        for script, (vowels, consonants, known) in LETTERS.items():
            letter = F.when(F.lower(c).isin(list(known)), F.translate(drawn, HEX, vowels)).otherwise(F.translate(drawn, HEX, consonants))
            out = out.when(c.rlike(f"[{BLOCKS[script]}]"), F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter))
        return out.when(c.rlike(r"\p{L}"), F.translate(drawn, HEX, LETTERS["latin"][1])).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _number(digest: Column, at: int, digits: int = 6) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("int")


def _luhn(body: Column) -> Column:
    """Check digit of a string of digits."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int")))
    return ((10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _check97(country: Column, body: Column) -> Column:
    """Two check digits of an account number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _weighted(body: Column, weights: list[int]) -> Column:
    return sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def _nif(body: Column) -> Column:
    """Check digit behind eight digits (Portugal)."""
    r = _weighted(body, [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return F.when(r < 2, "0").otherwise((11 - r).cast("string"))


def _afm(body: Column) -> Column:
    """Check digit behind eight digits (Greece)."""
    return (_weighted(body, [256, 128, 64, 32, 16, 8, 4, 2]) % 11 % 10).cast("string")


def _next(body: Column, at: int) -> Column:
    """``body`` with another digit at one place."""
    digit = (F.substring(body, at, 1).cast("int") + 1) % 10
    return F.concat(F.substring(body, 1, at - 1), digit.cast("string"), F.substr(body, F.lit(at + 1)))


def _national(country: str, norm: Column, like: Column, d: Column) -> Column:
    """A national id of the country: a plausible date, the digits of ``like``, right check digits."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    month, day = two(_number(d, 20) % 12 + 1), two(_number(d, 30) % 28 + 1)
    first, part = F.substring(norm, 1, 1), lambda at, n: F.substring(like, at, n)
    old = lambda at: F.substring(norm, at, 1)
    mod = lambda body, n: body.cast("long") % n
    eight = F.concat(first, part(2, 7))
    if country == "DK":
        return F.concat(day, month, part(5, 2), old(7), part(8, 4))
    if country == "SE":
        return F.concat(part(1, 2), month, day, old(7), part(8, 3), _luhn(F.concat(part(1, 2), month, day, part(8, 3))))
    if country == "FI":
        rest = mod(F.concat(day, month, part(5, 2), part(8, 3)), 31).cast("int")
        return F.concat(day, month, part(5, 2), old(7), part(8, 3), F.substr(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), rest + 1, F.lit(1)))
    if country == "NO":
        return F.concat(day, month, part(5, 8))
    if country == "ES":
        return F.concat(part(1, 8), F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), mod(part(1, 8), 23).cast("int") + 1, F.lit(1)))
    if country == "NL":
        weights = [9, 8, 7, 6, 5, 4, 3, 2]
        body = F.when(_weighted(eight, weights) % 11 == 10, _next(eight, 8)).otherwise(eight)
        return F.concat(body, (_weighted(body, weights) % 11).cast("string"))
    if country == "PT":
        return F.concat(eight, _nif(eight))
    if country == "GR":
        return F.concat(eight, _afm(eight))
    if country == "FR":
        body = F.concat(first, part(2, 2), month, part(6, 8))
        return F.concat(body, two(97 - mod(body, 97)))
    if country == "IT":
        known = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21] * 2 + [2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
        even = [*range(10), *range(26)]
        at = lambda c: F.instr(F.lit(known), c)
        each = F.transform(F.split(part(1, 15), ""), lambda c, i: F.element_at(F.when(i % 2 == 0, F.array(*map(F.lit, odd))).otherwise(F.array(*map(F.lit, even))), at(c)))
        total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
        return F.concat(part(1, 15), F.substr(F.lit(known), total % 26 + 11, F.lit(1)))
    if country == "PL":
        body = F.concat(part(1, 2), month, day, part(7, 4))
        return F.concat(body, ((10 - _weighted(body, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10).cast("string"))
    if country == "RO":
        body = F.concat(first, part(2, 2), month, day, part(8, 5))
        rest = _weighted(body, validators.CNP_WEIGHTS) % 11
        return F.concat(body, F.when(rest == 10, 1).otherwise(rest).cast("string"))
    if country == "BE":
        digits = F.concat(part(1, 2), month, day, part(10, 3))
        return F.concat(part(1, 2), old(3), month, old(6), day, old(9), part(10, 3), old(13), two(97 - mod(digits, 97)))
    weights = [3, 7, 9, 5, 8, 4, 2, 1, 6]
    body = F.concat(first, part(2, 2), day, month, part(9, 2))
    body = F.when(_weighted(body, weights) % 11 == 10, _next(body, 3)).otherwise(body)
    return F.concat(F.substring(body, 1, 3), (_weighted(body, weights) % 11).cast("string"), F.substr(body, F.lit(4)))


def _birth(norm: Column, attempt: Column, d: Column) -> Column:
    """A date in the form of ``norm``; days go up to twelve, so that they may stand for months. Later attempts draw
    from more years, and from 28 days where a number over twelve tells the day from the month."""
    parts, marks = F.split(norm, "[/.-]"), F.regexp_extract_all(norm, F.lit("[/.-]"), F.lit(0))
    more = attempt > 3

    def one(i: int) -> Column:
        n, size = _number(d, 10 + 8 * i), F.length(parts[i])
        few = F.when(size == 4, n % 70 + 1940).when(size == 2, n % 60 + 40).otherwise(n % 900 + 100)
        many = F.when(size == 4, n % 130 + 1900).when(size == 2, n % 100).otherwise(n % 900 + 100)
        is_year = (size > 2) | (F.lit(i == 2) & (F.length(parts[0]) < 3))
        days = F.when(more & (parts[i].cast("int") > 12), 28).otherwise(12)
        return F.when(is_year, F.when(more, many).otherwise(few)).when(size == 1, n % 9 + 1).otherwise(n % days + 1).cast("string")

    padded = [F.lpad(one(i), F.length(parts[i]), F.lit("0")) for i in range(3)]
    return F.concat(padded[0], marks[0], padded[1], marks[1], padded[2])


def _place(norm: Column, like: Column) -> Column:
    """An address: its first digit and the kind of its street stay."""
    street = F.regexp_extract(norm, r"(?i)\s(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl)$", 0)
    first = F.when(norm.rlike("^[0-9]"), F.substring(norm, 1, 1)).otherwise(F.substring(like, 1, 1))
    return F.concat(first, F.substr(like, F.lit(2), F.length(norm) - F.length(street) - 1), street)


def _initial(norm: Column, attempt: Column, d: Column) -> Column:
    """Another letter of the same script, or a Latin one for other scripts, with the full stop if there is one. The
    first attempt prefers a consonant, later ones take any letter, those after the fourth a second letter, too."""

    def of(vowels: str, consonants: str) -> Column:
        drawn = F.array(F.translate(F.substring(d, 1, 1), HEX, consonants), F.translate(F.substring(d, 2, 1), HEX, vowels))
        other = F.filter(F.transform(drawn, F.upper), lambda x: x != F.substring(norm, 1, 1))[0]
        letters = "".join(dict.fromkeys(consonants + vowels))
        letter = lambda at: F.substr(F.lit(letters), _number(d, at) % len(letters) + 1, F.lit(1))
        two = F.concat(F.upper(letter(10)), F.when(attempt > 3, letter(20)).otherwise(""))
        return F.concat(F.when(attempt == 0, other).otherwise(two), F.substr(norm, F.lit(2)))

    out = of(*LETTERS["latin"][:2])
    for script in ("cyrillic", "greek"):
        out = F.when(norm.rlike(f"^[{BLOCKS[script]}]"), of(*LETTERS[script][:2])).otherwise(out)
    return out


def surrogate(kinds: list[str], kind: Column, norm: Column, attempt: Column, d: Column, like: Column) -> Column:
    """Replacement of a normal form from its digest ``d`` and its letters and digits drawn anew, ``like``.

    Only the kinds listed are in the expression. Later attempts draw from larger domains where the first is
    small; beyond LAST_OF_FORMAT a tail of the digest follows, so that formats of few values do not run out.
    """

    def email() -> Column:
        local = F.concat(_like(F.substring_index(norm, "@", 1), d), F.when(attempt > 3, F.substring(d, 1, 6)).otherwise(""))
        labels = F.size(F.split(norm, r"\."))
        return F.lower(F.concat(local, F.lit("@"), F.when(labels > 2, F.concat(F.lit("h"), F.substring(d, 9, 4), F.lit("."))).otherwise(""), F.lit("example.com")))

    def host() -> Column:
        octet = lambda i: (_number(d, 1 + 6 * i) % 256).cast("string")
        first = F.when(attempt > 3, (_number(d, 30) % 223 + 1).cast("string")).otherwise("10")
        return F.concat_ws(".", first, octet(0), octet(1), octet(2))

    def card() -> Column:
        body = F.concat(F.substring(norm, 1, 1), F.substr(like, F.lit(2), F.length(norm) - 2))
        return F.concat(body, _luhn(body))

    def phone() -> Column:
        return F.when(norm.startswith("+"), F.concat(F.substring(norm, 1, 2), F.substr(like, F.lit(3)))).otherwise(like)

    def account() -> Column:
        country, inner = F.substring(norm, 1, 2), F.substr(like, F.lit(5))
        return F.concat(country, _check97(country, inner), inner)

    def given(names: list[str]) -> Column:
        pool = F.array(*(F.lit(n) for n in names))
        pick = F.element_at(pool, _number(d, 1) % len(names) + 1)
        # the lexicon is small: later attempts take a compound of two of its names
        second = F.element_at(pool, _number(d, 9) % len(names) + 1)
        return F.when(attempt > 3, F.concat(pick, F.lit("-"), second)).otherwise(pick)

    forms: dict[str, Callable[[], Column]] = {
        "email": email,
        "host": host,
        "national": lambda: F.concat(F.lit("9"), F.substring(like, 2, 100)),
        "card": card,
        "phone": phone,
        "account": account,
        "surname": lambda: F.concat(like, F.when(attempt > 3, F.translate(F.substring(d, 40, 3), HEX, LETTERS["latin"][0])).otherwise("")),
        "initial": lambda: _initial(norm, attempt, d),
        "secret": lambda: like,
        "birth": lambda: _birth(norm, attempt, d),
        "place": lambda: _place(norm, like),
        "vat": lambda: F.concat(F.regexp_extract(norm, "^[A-Z]+", 0), F.regexp_extract(like, "[0-9]+$", 0)),
    }
    forms |= {f"national-{country}": lambda c=country: _national(c, norm, like, d) for country in NATIONAL_ID}
    forms |= {f"given-{script}-{gender}": lambda n=names.split(): given(n) for (script, gender), names in GIVEN.items()}
    out = F.when(F.lit(False), F.lit(""))
    for name in kinds:
        out = out.when(kind == name, forms[name]())
    stays = (kind == "secret") & ~norm.rlike(r"[\p{L}0-9]")
    return F.when((attempt > LAST_OF_FORMAT) | stays, F.concat(out, F.substring(d, 100, 10))).otherwise(out)


def _spelt(value: Column, kind: Column, replaced: Column) -> Column:
    """The surrogate of a normal form in the spelling of one of its values: separators and case where they were."""
    if_number = kind.isin(SPACED)
    at = lambda a, c: F.substr(replaced, a["at"], F.lit(1))
    drawn = lambda a, c: F.when(c.rlike("[a-z]"), F.lower(at(a, c))).otherwise(at(a, c))
    kept = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, c: F.when(
            c.rlike("[0-9A-Za-z+]"), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], drawn(a, c)).alias("out"))
        ).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out"))),
        lambda a: F.concat(a["out"], F.substr(replaced, a["at"])),
    )
    capitals = kind.rlike("^(given|surname)") & _capitals(value)
    return F.when(if_number, kept).when(capitals, F.upper(replaced)).otherwise(replaced)


def _kinds(entities: DataFrame) -> list[str]:
    """The kinds that occur; there are some forty in all."""
    return sorted(r.kind for r in entities.select("kind").distinct().collect())


def _tried(pending: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """``pending`` (kind, norm, attempt) with the surrogates of these attempts."""
    replaced = surrogate(kinds, *(F.col(c) for c in ("kind", "norm", "attempt", "digest", "like")))
    drawn = computed_once(pending, "digest", _digest(key, F.col("kind"), F.col("norm"), F.col("attempt")))
    drawn = computed_once(drawn, "like", _like(F.col("norm"), F.col("digest")))
    return drawn.withColumn("surrogate", replaced).drop("digest", "like")


def assign(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities (kind, norm): no two of a kind alike, none an entity itself."""
    entities = stored(entities)
    pending = entities.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    for _ in range(most_rounds):
        kinds = _kinds(pending)
        if not kinds:
            return settled if settled is not None else entities.select("kind", "norm", F.col("norm").alias("surrogate"))
        tried = stored(_tried(pending, key, kinds))
        # of those that meet, the one of the least normal form may stay
        winner = tried.groupBy("kind", "surrogate").agg(F.min("norm").alias("first"))
        taken = entities.select("kind", F.col("norm").alias("surrogate"), F.lit(False).alias("used"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate", F.lit(True).alias("used")))
        taken = taken.groupBy("kind", "surrogate").agg(F.max("used").alias("used"))
        marked = tried.join(winner, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        # given names come from the lexicon and initials from the alphabet, which may occur: there, only others' surrogates are taken
        free = F.when(F.col("kind").startswith("given") | (F.col("kind") == "initial"), ~F.coalesce("used", F.lit(False))).otherwise(F.col("used").isNull())
        good = (F.col("norm") == F.col("first")) & free & (F.col("norm") != F.col("surrogate"))
        marked = stored(marked.select("kind", "norm", "surrogate", "attempt", good.alias("good")))
        now = marked.where("good").select("kind", "norm", "surrogate")
        settled = now if settled is None else settled.unionByName(now)
        pending = marked.where("NOT good").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
    raise ValueError(f"no distinct surrogates in {most_rounds} attempts: the formats leave too few values")


def replace(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", into: str = "surrogates") -> DataFrame:
    """``docs`` and a struct column ``into``: n_entities and the text with surrogates.

    Only texts with entities are shuffled.
    """
    columns, docs = docs.columns, packed(docs)
    t = F.col("row").getField(text)
    has = F.coalesce(searched(t, lambda p: F.regexp_like(t, F.lit(p))), F.lit(False))
    place = F.struct(F.col("row").getField(doc_id).alias("o"), F.xxhash64(t).alias("h"))
    values = searched(t, lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    found = computed_once(docs.where(t.isNotNull()), "v", values).where(F.size("v") > 0).select(place.alias("p"), "v")
    each = stored(found.select("p.o", "p.h", F.posexplode("v").alias("i", "value")).distinct())
    words = each.select("value").distinct().select("value", F.posexplode(words_of(F.col("value"))).alias("j", "w")).select("value", "j", "w.*")
    words = words.withColumn("kind", kind_of(F.col("word"), F.col("form"), F.col("j")))
    words = stored(words.withColumn("norm", normal(F.col("word"), F.col("kind"))))
    distinct = words.where(F.col("kind") != KEPT).select("kind", "norm").distinct()
    known = assign(distinct, key)
    new = F.coalesce(_spelt(F.col("word"), F.col("kind"), F.col("surrogate")), F.col("word"))
    mentioned = F.col("kind").rlike("^(given|surname)") & F.col("norm").rlike(r"^\p{Lu}") & ~F.lower("norm").isin([w.lower() for w in FUNCTION])
    spelt = words.join(known, ["kind", "norm"], "left").select("value", F.struct("j", new.alias("new"), "norm", mentioned.alias("m"), F.col("surrogate").alias("plain")).alias("part"))
    spelt = spelt.groupBy("value").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    names = F.transform(F.filter("parts", lambda p: p["m"]), lambda p: F.struct(p["norm"].alias("name"), p["plain"].alias("new")))
    spelt = spelt.select("value", F.array_join(F.transform("parts", lambda p: p["new"]), "").alias("new"), names.alias("names"))
    by_text = each.join(spelt, "value").groupBy("o", "h")
    ordered = by_text.agg(F.array_sort(F.collect_list(F.struct("i", "new"))).alias("new"), F.flatten(F.collect_set("names")).alias("names"))
    names = F.map_from_entries(F.array_distinct("names"))
    ordered = ordered.select(F.struct("o", "h").alias("pii_key"), F.col("new").alias("pii_new"), names.alias("pii_names"))
    changed = docs.where(has).select("row", place.alias("place"))
    same = (F.col("place")["h"] == F.col("pii_key")["h"]) & F.col("place")["o"].eqNullSafe(F.col("pii_key")["o"])
    changed = changed.join(ordered, same)
    # the text between entities: mentions of the names found in the same text
    known_as = lambda w: F.try_element_at("pii_names", F.translate(w, "’", "'"))
    in_capitals = lambda w: F.when(_capitals(w), F.upper(known_as(_cased(w))))
    named = lambda w: F.coalesce(known_as(w), in_capitals(w))
    in_gap = lambda g: F.struct(g.alias("gap"), F.transform(F.regexp_extract_all(g, F.lit(MENTION), F.lit(0)), lambda w: F.struct(w.alias("w"), named(w).alias("new"))).alias("at"))
    plain = lambda g: F.struct(g.alias("gap"), F.array().cast("array<struct<w:string,new:string>>").alias("at"))
    gaps = searched(t, lambda p: F.split(t, p, -1))
    changed = computed_once(changed, "pii_gaps", F.when(F.size("pii_names") > 0, F.transform(gaps, in_gap)).otherwise(F.transform(gaps, plain)))
    again = lambda g: F.exists(g["at"], lambda a: a["new"].isNotNull())
    put = lambda g: F.array_join(F.zip_with(F.split(g["gap"], MENTION, -1), g["at"], lambda x, a: F.concat(x, F.coalesce(a["new"], a["w"], F.lit("")))), "")
    pieces = F.zip_with("pii_gaps", F.col("pii_new"), lambda g, s: F.concat(F.when(again(g), put(g)).otherwise(g["gap"]), F.coalesce(s["new"], F.lit(""))))
    n_again = F.aggregate("pii_gaps", F.lit(0), lambda n, g: n + F.size(F.filter(g["at"], lambda a: a["new"].isNotNull())))
    result = F.struct((F.size("pii_new") + n_again).cast("long").alias("n_entities"), F.array_join(pieces, "").alias("text"))
    changed = changed.select("row", result.alias("done"))
    clean = docs.where(~has).select("row", F.struct(F.lit(0).cast("long").alias("n_entities"), t.alias("text")).alias("done"))
    return unpacked(clean.unionByName(changed), columns, **{into: F.col("done")})
