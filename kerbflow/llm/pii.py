"""PII by surrogate generation: every detected entity gets a keyed replacement of its own type, format, script and
(for given names) gender; equal entities get equal ones everywhere, different ones different ones. DataFrame functions only.

A surrogate is a pure function of key, type, normal form and attempt number, so it needs no table: only entities whose
surrogate collides (with another's, or with a real entity of the corpus) are stored, with their next attempt.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import Workspace

#: Titles and common given names by gender, as alternatives.
TITLES = {"she": "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Госпожа|Κυρία", "he": "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "name": "Dr|Prof|Doctor|Professor"}
GIVEN = {
    "she": "Alice|Amanda|Angela|Anna|Anne|Barbara|Carol|Carmen|Catherine|Charlotte|Christine|Claudia|Deborah|Elena|Elizabeth|Emily|Emma|Eva|Hannah|Helen|Ingrid|Isabel|Jane|Jennifer|Jessica|Julia|Karen|Katharina|Laura|Linda|Lisa|Margaret|Maria|Marie|Mary|Michelle|Monika|Nancy|Nicole|Olivia|Patricia|Petra|Rachel|Rosa|Sabine|Sandra|Sarah|Sophie|Stephanie|Susan|Ursula",
    "he": "Alexander|Andrew|Anthony|Antonio|Carlos|Charles|Christian|Christopher|Daniel|David|Diego|Edward|Fernando|François|Frank|George|Hans|Heinrich|Henry|Jack|James|Javier|Jean|John|Jorge|Joseph|Juan|Jürgen|Klaus|Luis|Manuel|Matthew|Michael|Miguel|Nicolas|Oliver|Patrick|Paul|Pedro|Peter|Philippe|Pierre|Richard|Robert|Samuel|Stefan|Steven|Thomas|William|Wolfgang",
}
#: Particles between given and family name.
PARTICLES = "van|von|vom|de|da|del|della|di|du|la|le|den|der|ter|ten|zu|zum|zur|bin|ibn|al|el|dos|das|do"
#: A name in small or capital letters, with its own hyphens and apostrophes; O', D', Mc and Mac may stand before it.
NAME = r"(?:[OD]['’]|Ma?c)?\p{Lu}(?:\p{Ll}{1,20}|\p{Lu}{1,20})(?:['’-]\p{Lu}(?:\p{Ll}{1,20}|\p{Lu}{1,20}))*(?!\p{L})"
PERSON = ("she", "he", "name")
HEX = r"[0-9A-Fa-f]{1,4}"


def _words(*groups: str) -> str:
    """Alternatives grouped by their first letter, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for word in sorted({w for g in groups for w in g.split("|")}, key=lambda w: (-len(w), w)):
        by.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + ")"


ANY_TITLE = _words(*TITLES.values())
#: Given names as they are and in capitals.
_BOTH = {k: _words(v, v.upper()) for k, v in GIVEN.items()}
ANY_GIVEN = _words(*GIVEN.values(), *(v.upper() for v in GIVEN.values()))
#: Another name of the same person: with particles before it, or an initial.
_MORE = rf"(?: (?:(?:{PARTICLES}) ){{0,3}}{NAME}| \p{{Lu}}\.(?= ))"
#: What stands between the names of a list.
_LIST = "(?:,|,? (?:and|und|et|y|or|oder|&))"


def _person(kind: str) -> str:
    """Titles and one to three names; a given name, any further ones and initials, and one or two other names; or a given name
    that is listed beside another. Particles belong to the name behind them."""
    titled = rf"{_words(TITLES[kind])}\.? (?:{ANY_TITLE}\.? ){{0,3}}(?:\p{{Lu}}\. )?(?:(?:{PARTICLES}) ){{0,3}}{NAME}{_MORE}{{0,2}}"
    if kind not in GIVEN:
        return rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{titled})"
    full = rf"{_BOTH[kind]}(?!\p{{L}})(?:(?: {ANY_GIVEN}(?!\p{{L}})| \p{{Lu}}\.(?= ))*+{_MORE}{{1,2}}|(?: {ANY_GIVEN}(?!\p{{L}}))++)"
    own = rf"{_BOTH[kind]}(?![\p{{L}}-])"
    listed = rf"(?<=(?<!\p{{L}}){ANY_GIVEN}{_LIST} ){own}|{own}(?={_LIST} {ANY_GIVEN}(?!\p{{L}}))"
    return rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{titled}|{full}|{listed})"


#: Type and pattern, the first that matches at a place wins. Patterns have no capturing groups.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": rf"(?={HEX}:)(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{2,6}}(?::{HEX}){{1,5}}|{HEX}:(?::{HEX}){{2,6}}|[0-9A-Fa-f]{{4}}::{HEX})(?![\p{{L}}\p{{N}}:]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64})(?![\p{L}\p{N}])",
    "iban": r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?=\d)(?<![\d.+-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![\d]|[.-]\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[\d+(])(?:(?<![\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)|(?<![\p{N}+-])0\d{1,4}[ .-]\d{3,4}[ .-]\d{3,4}(?![\d]|[.-]\d)|(?<![\p{N}+])\+\d{8,15}(?!\d)|(?<![\p{N}+])\+(?=(?:[ .()-]?\d){8,15}(?![ .-]?\d))\d{1,3}(?:[ .-]\(?\d{2,8}\)?){1,5}(?!\d))",
} | {kind: _person(kind) for kind in PERSON}
#: Needed by any pattern above; texts without it are passed over.
HINT = rf"[0-9@]|(?=\p{{Lu}})(?<!\p{{L}})(?:{ANY_TITLE}|{ANY_GIVEN})"
#: Syllables of made-up names by script: starts, then endings by gender.
SYLLABLES = {
    "latin": (("ba", "de", "fi", "go", "ha", "ju", "ka", "le", "mi", "no", "pa", "ra", "se", "ti", "vo", "wi"), {"she": ("na", "la", "ra", "sa"), "he": ("n", "r", "s", "l"), "name": ("ko", "mo", "do", "bo")}),
    "cyrillic": (("ба", "де", "фи", "го", "ха", "ку", "ка", "ле", "ми", "но", "па", "ра", "се", "ти", "во", "ви"), {"she": ("на", "ла", "ра", "са"), "he": ("н", "р", "с", "л"), "name": ("ко", "мо", "до", "бо")}),
    "greek": (("βα", "δε", "φι", "γο", "χα", "κυ", "κα", "λε", "μι", "νο", "πα", "ρα", "σε", "τι", "θο", "ζι"), {"she": ("να", "λα", "ρα", "σα"), "he": ("ν", "ρ", "ς", "λ"), "name": ("κο", "μο", "δο", "βο")}),
}
LETTERS = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
#: Country codes by length; what is dialled first, a code or a trunk zero, stays.
DIALLED = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|0)"
MOST_ATTEMPTS = 64
#: After every so many attempts the surrogates of names and mail addresses grow: a syllable a word up to MORE_SYLLABLES, a
#: letter before the address up to MORE_LETTERS, both within what the patterns match. So redrawing ends.
PATIENCE = 4
MORE_SYLLABLES, MORE_LETTERS = 6, 8
#: Surrogates drawn again are joined by the digest of the texts that hold them; up to this many such texts broadcast.
BROADCAST_TEXTS = 20_000


def _alone(patterns: dict[str, str]) -> dict[str, str]:
    """Patterns for an entity by itself, where a given name of a list has no list around it."""
    return {k: rf"{p}|{_BOTH[k]}" if k in _BOTH and p == PATTERNS[k] else p for k, p in patterns.items()}


def kind_of(entity: Column, patterns: dict[str, str]) -> Column:
    """Type of a detected entity. Look-arounds see only the entity here, which every pattern allows."""
    return F.coalesce(*(F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in patterns.items()), F.lit("other"))


def checked(entity: Column, kind: Column) -> Column:
    """The type, null for a number whose check digits are wrong."""
    valid = F.when(kind == "card", _luhn(F.regexp_replace(entity, r"[^0-9]", ""))).when(kind == "iban", _mod97(F.regexp_replace(entity, " ", "")) == 1)
    return F.when(F.coalesce(valid, F.lit(True)), kind)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(iban: Column) -> Column:
    """Remainder of a bank account number's digits, country and check digits moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    step = lambda m, c: F.when(c.rlike("^[0-9]$"), m * 10 + F.ascii(c) - 48).otherwise(m * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def normal(entity: Column, kind: Column) -> Column:
    """Form under which mentions are one entity: digits of numbers, lower case of mail, addresses and names."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("family", *PERSON), F.lower(bare(entity)))
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .otherwise(entity)
    )


TITLE = rf"^(?:{ANY_TITLE}\.? )+"
LEADING = rf"^(?:(?:{PARTICLES}) )+"
INITIAL = r"^\p{Lu}\.$"
#: Where a mention is parted into names: at spaces, but for those behind a particle.
_PARTED = rf"(?<!(?<!\p{{L}})(?:{PARTICLES})) "


def bare(name: Column) -> Column:
    """A name without particles."""
    return F.regexp_replace(name, LEADING, "")


def _names(mention: Column, kind: Column) -> Column:
    """Names of a person mention, in order, each with its kind: given names and initials of the mention's gender, then a family
    name. A title with one name has a family name, one name without a title is a given one."""
    words = F.split(F.regexp_replace(mention, TITLE, ""), _PARTED)
    family = (F.size(words) > 1) | mention.rlike(TITLE)
    return F.transform(words, lambda w, i: F.struct(w.alias("e"), F.when((i == F.size(words) - 1) & family, F.lit("family")).otherwise(kind).alias("kind")))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 in hex."""
    k = key.encode()
    k = (hashlib.sha512(k).digest() if len(k) > 128 else k).ljust(128, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in k))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 512))), 512)


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits from key and entity."""
    return _hmac(key, F.concat_ws("|", kind, norm, attempt.cast("string")))


def _nibble(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i % 128 + 1, F.lit(1)), 16, 10).cast("int")


def _digit(stream: Column, i: Column) -> Column:
    """Decimal digit from two hex digits, nearly even."""
    return (F.conv(F.substring(stream, (2 * i) % 127 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).when(text.rlike(r"^\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _by_script(script: Column, made) -> Column:
    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def _chars(norm: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of their script and case, all else as it is."""

    def one(c: Column, i: Column) -> Column:
        letter = _by_script(_script(c), lambda s: F.substring(F.lit(LETTERS[s]), _nibble(stream, i) + 1, F.lit(1)))
        return F.when(c.rlike(r"^\d$"), _digit(stream, i)).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(norm, ""), lambda c: c != ""), one), "")


def _hex(norm: Column, stream: Column) -> Column:
    """A hexadecimal secret stays hexadecimal."""
    return F.substring(F.concat(stream, F.reverse(stream)), F.lit(1), F.length(norm))


def _octets(stream: Column) -> Column:
    return F.concat_ws(".", *(F.conv(F.substring(stream, 2 * k + 1, 2), 16, 10) for k in range(4)))


def _name(norm: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    def word(script: str) -> Column:
        starts, ends = SYLLABLES[script]
        pick = lambda table, k: F.element_at(F.array(*map(F.lit, table)), (_nibble(stream, F.lit(k)) % len(table) + 1).cast("int"))
        end = F.when(kind == "she", pick(ends["she"], 3)).when(kind == "he", pick(ends["he"], 3)).otherwise(pick(ends["name"], 3))
        more = [F.when(attempt >= PATIENCE * (j + 1), pick(starts, 16 + j)).otherwise("") for j in range(MORE_SYLLABLES)]
        return F.concat(pick(starts, 0), pick(starts, 1), pick(starts, 2), *more, end)

    return _by_script(_script(norm), word)


def _card(digits: Column) -> Column:
    """The number with its last digit set so that it passes the check."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, F.filter(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: _luhn(F.concat(body, d)))[0])


def _iban(norm: Column, stream: Column) -> Column:
    country, body = F.substring(norm, 1, 2), _chars(F.substring(norm, 5, 64), stream)
    return F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)


def _hexed(norm: Column, stream: Column) -> Column:
    """Hexadecimal digits for those of the form, all else as it is."""
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.substring(stream, i % 128 + 1, F.lit(1))).otherwise(c)), "")


def core(kind: Column, norm: Column, attempt: Column, s: Column) -> Column:
    """Surrogate of a normal form by its stream s, itself a normal form of the same type and shape, with right check digits."""
    letters = F.translate(F.substring(s, 97, MORE_LETTERS), "0123456789abcdef", LETTERS["latin"])
    room = F.instr(norm, "@") + MORE_LETTERS <= 64
    more = F.when(room, F.substring(letters, F.lit(1), F.least(F.floor(attempt / PATIENCE).cast("int"), F.lit(MORE_LETTERS)))).otherwise("")
    domain = F.concat(more, _chars(F.regexp_extract(norm, r"^(.*)\.", 1), s), F.lit("."), F.regexp_extract(norm, r"([^.]*)$", 1))
    return (
        F.when(kind == "ip", _octets(s))
        .when(kind == "email", domain)
        .when(kind.isin("family", *PERSON), _name(norm, kind, s, attempt))
        .when(kind == "card", _card(_chars(norm, s)))
        .when(kind == "phone", F.concat(F.regexp_extract(norm, DIALLED, 0), _chars(F.regexp_replace(norm, DIALLED, ""), s)))
        .when(kind == "iban", _iban(norm, s))
        .when(kind == "ipv6", _hexed(norm, s))
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), _hex(norm, s))
        .when(kind == "secret", F.concat(F.regexp_extract(norm, r"^(AKIA|ASIA|gh[pousr]_|sk-|)", 1), _chars(F.regexp_replace(norm, r"^(AKIA|ASIA|gh[pousr]_|sk-)", ""), s)))
        .otherwise(_chars(norm, s))
    )


def dress(entity: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the mention's own format: its separators, title and capitals."""

    def fill(digits: Column) -> Column:
        chars = F.filter(F.split(entity, ""), lambda c: c != "")
        start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))
        step = lambda a, c: F.when(c.rlike(r"^[0-9A-Z]$"), F.struct((a.k + 1).alias("k"), F.concat(a.s, F.substring(digits, a.k + 1, F.lit(1))).alias("s"))).otherwise(F.struct(a.k.alias("k"), F.concat(a.s, c).alias("s")))
        return F.aggregate(chars, start, step, lambda a: a.s)

    first = F.upper(F.substring(made, 1, 1))
    cased = lambda e: F.when(e == F.upper(e), F.upper(made)).when(e.rlike(r"^\p{Lu}"), F.concat(first, F.substring(made, 2, 400))).otherwise(made)
    named = F.when(entity.rlike(INITIAL), F.concat(first, F.lit("."))).otherwise(F.concat(F.regexp_extract(entity, LEADING, 0), cased(bare(entity))))
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), fill(F.regexp_replace(made, "[+]", "")))
        .when(kind.isin("family", *PERSON), named)
        .when(kind.isin("email", "ipv6"), cased(entity))
        .otherwise(made)
    )


def _either(patterns: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


def _detected(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """docs with pii_pattern (null: that of all texts) and pii_typed: an array of (e, parts), parts being the (e, kind, norm) that get surrogates.

    Where a text names persons, their names are looked for again in all of it, alone as well. A mention of a person has a
    part for each name, so the family keeps one surrogate beside any given name or title.
    """
    every = F.lit(_either(patterns))
    hinted = F.col(text).rlike(HINT) if patterns is PATTERNS else F.lit(True)
    d = docs.withColumn("pii_first", F.when(hinted, F.regexp_extract_all(F.col(text), every, F.lit(0))))
    kinds, patterns = [k for k in PERSON if k in patterns], _alone(patterns)
    named = lambda e: reduce(lambda rest, k: F.when(e.rlike(f"^(?:{patterns[k]})$"), F.lit(k)).otherwise(rest), reversed(kinds), F.lit(None).cast("string"))
    # each step of a mention is a field that the next one reads, so that nothing is worked out twice
    people = F.filter(F.transform("pii_first", lambda e: F.struct(e.alias("e"), named(e).alias("kind"))), lambda x: x.kind.isNotNull())
    d = d.withColumn("pii_names", F.flatten(F.transform(people, lambda x: F.transform(F.filter(_names(x.e, x.kind), lambda n: ~n.e.rlike(INITIAL)), lambda n: F.struct(bare(n.e).alias("e"), n.kind.alias("kind"))))) if kinds else F.lit(None).cast("array<struct<e: string, kind: string>>"))
    some = F.size("pii_names") > 0
    alone = F.concat(every, F.lit(r"|(?<!\p{L})(?:"), F.array_join(F.array_distinct(F.transform("pii_names", lambda n: n.e)), "|"), F.lit(r")(?!\p{L})"))
    d = d.withColumn("pii_pattern", F.when(some, alone))
    d = d.withColumn("pii_found", F.when(some, F.regexp_extract_all(F.col(text), F.col("pii_pattern"), F.lit(0))).otherwise(F.col("pii_first")))

    def parts(x: Column) -> Column:
        bare = F.when(x.kind == "other", F.filter("pii_names", lambda n: n.e == x.e)[0]["kind"])
        one = F.array(F.struct(x.e.alias("e"), F.coalesce(bare, x.kind).alias("kind")))
        raw = F.when(x.kind.isin(*PERSON), _names(x.e, x.kind)).otherwise(one) if kinds else one
        known = F.filter(raw, lambda y: y.kind.isNotNull())
        return F.transform(known, lambda y: F.struct(y.e.alias("e"), y.kind.alias("kind"), normal(y.e, y.kind).alias("norm")))

    kinded = F.transform("pii_found", lambda e: F.struct(e.alias("e"), kind_of(e, patterns).alias("kind")))
    kinded = F.transform(kinded, lambda x: F.struct(x.e.alias("e"), checked(x.e, x.kind).alias("kind")))
    typed = F.when(F.size("pii_found") > 0, F.transform(kinded, lambda x: F.struct(x.e.alias("e"), x.kind.isin(*PERSON).alias("person"), parts(x).alias("parts"))))
    return d.withColumn("pii_typed", typed).drop("pii_first", "pii_names", "pii_found")


def collisions(entities: DataFrame, work: Workspace, key: str) -> DataFrame:
    """entities(kind, norm), distinct -> (kind, norm, attempt) of those whose first surrogate may not stand.

    A surrogate may not equal that of another entity (the smallest normal form keeps it) nor any real entity of its type.
    """
    again = work.table(entities.withColumn("attempt", F.lit(0)).where("1 = 0"), "again-0")
    for step in range(1, MOST_ATTEMPTS + 1):
        made = entities.join(again, ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        made = made.withColumn("s", _stream(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        made = made.withColumn("made", core(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("s"))).drop("s")
        first = made.groupBy("kind", "made").agg(F.min("norm").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("kind", "made", "keeper")
        real = entities.select("kind", F.col("norm").alias("made"), F.lit(True).alias("real"))
        judged = made.join(first, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        bad = judged.where("real or norm <> keeper").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        bad = work.table(bad, f"bad-{step}")
        if bad.isEmpty():
            return again
        kept = again.join(bad, ["kind", "norm"], "left_anti")
        again = work.table(kept.unionByName(bad), f"again-{step}")
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts: too few of their shape")


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """docs with surrogates in text_col, and pii_count (mentions replaced) and pii_types (their distinct types, sorted).

    Surrogates follow from the secret ``key`` by HMAC. One entity has one surrogate in the whole corpus, whatever its format;
    two have two. Names are entities by themselves: in "Mrs Jane Smith met Jane; Mrs Smith left" both names keep theirs. A
    name that a text gives to a person is replaced everywhere in that text, even where it is an ordinary word. Null texts
    stay null and texts without an entity stay as they are, with count 0; numbers with wrong check digits are no entities.
    Repeated rows get the same text. Other columns pass through; columns named pii_count and pii_types are replaced, and
    working columns stand beside any others, whatever their names.
    """
    work = Workspace(docs.sparkSession, "pii")
    cols = [c for c in docs.columns if c not in ("pii_count", "pii_types")]
    # other columns ride in a struct, so that their names cannot clash
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in cols if c != text_col)).alias("pii_row")
    d = _detected(docs.select(rest, F.col(f"`{text_col}`").cast("string").alias("pii_text")), "pii_text", patterns)
    # texts are searched once, what was found is written with them
    d = work.table(d, "detected")
    mentions = d.where("size(pii_typed) > 0").select("pii_text", F.explode(F.flatten(F.transform("pii_typed", lambda x: x.parts))).alias("x"))
    entities = work.table(mentions.select("x.kind", "x.norm").distinct(), "entities")
    again = collisions(entities, work, key)
    if not again.isEmpty():
        held = mentions.select(F.sha1("pii_text").alias("pii_digest"), "x.kind", "x.norm").join(again, ["kind", "norm"])
        held = held.select("pii_digest", F.concat_ws("|", "kind", "norm").alias("k"), "attempt").distinct()
        redrawn = work.table(held.groupBy("pii_digest").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("pii_again")), "redrawn")
        small = redrawn.count() <= BROADCAST_TEXTS
        d = d.withColumn("pii_digest", F.sha1("pii_text")).join(F.broadcast(redrawn) if small else redrawn, "pii_digest", "left").drop("pii_digest")
    else:
        d = d.withColumn("pii_again", F.lit(None).cast("map<string,int>"))
    attempt = lambda x: F.coalesce(F.try_element_at("pii_again", F.concat_ws("|", x.kind, x.norm)), F.lit(0))
    keyed = lambda y: F.struct(y.e.alias("e"), y.kind.alias("kind"), y.norm.alias("norm"), attempt(y).alias("attempt"))
    streamed = lambda y: F.struct(y.e.alias("e"), y.kind.alias("kind"), y.norm.alias("norm"), y.attempt.alias("attempt"), _stream(key, y.kind, y.norm, y.attempt).alias("s"))
    cored = lambda y: F.struct(y.e.alias("e"), y.kind.alias("kind"), core(y.kind, y.norm, y.attempt, y.s).alias("made"))
    made = lambda parts: F.transform(F.transform(F.transform(F.transform(parts, keyed), streamed), cored), lambda y: dress(y.e, y.kind, y.made))
    # a person mention is its title and its names; any other has one part, or none where it stays
    title = lambda x: F.when(x.person, F.regexp_extract(x.e, TITLE, 0)).otherwise("")
    new = F.transform("pii_typed", lambda x: F.when(F.size(x.parts) == 0, x.e).otherwise(F.concat(title(x), F.array_join(made(x.parts), " "))))
    d = d.withColumn("pii_new", new)
    between = F.split(F.col("pii_text"), F.coalesce("pii_pattern", F.lit(_either(patterns))), F.lit(-1))
    built = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get("pii_new", i), F.lit("")))), "")
    real = F.filter("pii_typed", lambda x: F.size(x.parts) > 0)
    d = d.withColumn("pii_built", F.when(F.size(real) > 0, built).otherwise(F.col("pii_text")))
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(real, lambda x: F.transform(x.parts, lambda y: y.kind))))), ",")
    out = [F.col("pii_built").alias(c) if c == text_col else F.col(f"pii_row.`{c}`").alias(c) for c in cols]
    return d.select(*out, F.greatest(F.coalesce(F.size(real), F.lit(0)), F.lit(0)).cast("long").alias("pii_count"), F.coalesce(types, F.lit("")).alias("pii_types"))


KEY = "spark.kerbflow.surrogateKey"


def surrogate_key(spark: SparkSession) -> str:
    """The session's secret, spark.kerbflow.surrogateKey. A session that sets none gets a random one, which it keeps: its
    surrogates agree with each other, and nobody can work them out again, nor compare them with another session's."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key=surrogate_key(spark)).where("pii_count > 0")
