"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases in the words of a text; a
shunting-yard parser evaluates the and/or/with expression behind a tag."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed by the contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of well-known licences, as words, with the label they give.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0 1 0": "cc0",
}
TAG = "spdx license identifier"
#: Licences whose terms allow reuse in training by policy; an expression is allowed as its parts are.
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib", "bsl-1.0"})
#: Families of licence identifiers, with a version or variant behind a hyphen, and identifiers that have none.
FAMILIES = (
    "0bsd afl agpl apache apsl artistic blueoak boehm bsd bsl bzip2 cc cc0 cddl cdla cecill cnri cpal cpl curl eclipse ecl efl epl etalab eupl "
    "ftl gfdl gpl hpnd icu ijg imagemagick intel ipl isc jasper json latex lgpl libpng libtiff lppl miros mit mpich2 mpl ms mulanpsl ncsa "
    "netcdf nist nlod npl odbl odc-by ofl ogl oldap openssl osl pddl php postgresql psf python ql qpl ruby sgi sleepycat sspl tcl unicode "
    "unlicense upl vim w3c wtfpl x11 xfree86 xnet zlib zpl licenseref documentref"
).split()
ALONE = "0bsd afl beerware curl dsdp fair ftl glide hpnd icu ijg imagemagick intel isc json latex2e libpng libtiff miros mit motosoto mpich2 mup naumen ncsa netcdf newsletr ngpl nokia openssl plexus postgresql qhull ruby saxpath sendmail sleepycat snia unlicense upl vim vostrom w3c wtfpl x11 xerox xnet xpp zed zlib".split()
_KNOWN = re.compile(r"(?:" + "|".join(sorted(FAMILIES, key=len, reverse=True)) + r")-[0-9a-z.+\-]*[0-9a-z]\+?|(?:" + "|".join(ALONE) + r")\+?")
_OPERAND = re.compile(rf"\(|{_KNOWN.pattern}")
_EXCEPTION = re.compile(r"[0-9a-z.+]+(?:-[0-9a-z.+]+)+")
WEIGHT = {"base": 0.6, "notice": 0.5, "tag": 0.9, "bad": 0.2}
RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9](?:[a-z0-9.+\-]*[a-z0-9+])?", re.ASCII)
#: The words of TAG with any marks between them, as the automaton sees them, and the marks up to an expression.
_TAG = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])spdx[\x00-/:-`{-\x7f]+license[\x00-/:-`{-\x7f]+identifier(?![0-9a-z\x80-\U0010ffff])[ \t]*:?[ \t]*")
_LINE_END = re.compile(r"[\n\r]|\Z")
#: Bytes of words stay, A-Z folds, all others part words.
WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class BadExpression(ValueError):
    pass


def parse(text: str, among_prose: bool = False) -> tuple[list[str], int]:
    """Shunting-yard: the postfix form of the longest expression at the start of ``text``, and its token count.

    Among prose, and outside brackets, an expression goes on behind an operator only with a bracket or an identifier of a known form, and behind "with"
    only with a name that holds a hyphen, as exceptions' names do; else it ends before the operator.
    """
    out: list[str] = []
    ops: list[str] = []
    operand, used, end = True, 0, -1
    tokens = _TOKEN.finditer(text)
    ahead = next(tokens, None)
    while ahead:
        t, at, ahead = ahead[0], ahead, next(tokens, None)
        if end >= 0 and at.start() > end and text[end : at.start()].strip(" \t"):
            break  # other marks end an expression
        end = at.end()
        if operand:
            if t == "(":
                ops.append(t)
            elif t == ")" or t in RANK:
                raise BadExpression(t)
            else:
                out.append(t)
                operand = False
        elif t in RANK:
            if among_prose and "(" not in ops and not (ahead and (_EXCEPTION if t == "with" else _OPERAND).fullmatch(ahead[0])):
                break
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = True
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        else:
            break  # prose after the expression
        used += 1
    if operand or "(" in ops:
        raise BadExpression(text[:40])
    return out + ops[::-1], used


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[bool, list[str]]:
    """Whether the policy allows the expression, and its licences in order; an exception (with) keeps its licence's verdict."""
    stack: list[bool] = []
    names: list[str] = []
    for t in postfix:
        if t not in RANK:
            names.append(t)
            stack.append(t.removesuffix("+") in allowed)
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(a or b if t == "or" else a and b if t == "and" else a)
        if t == "with":
            names.pop()
    return stack[0], names


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, found) -> dict:
    """All fields of one text; spans are (label, first word, words)."""
    norm = text.encode().translate(WORDS)
    words = norm.split()
    line = " " + b" ".join(words).decode() + " "
    spans, tags, at, before = [], 0, 0, 0
    for end, phrase in found.iter(line):
        start = end - len(phrase) - 1
        # words before the match: counted once over the whole text, a few steps back where matches overlap
        before += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        tags += phrase == TAG
        spans.append((phrase, before))
    base = [(BASE[p], w) for p, w in spans if p in BASE]
    labels = {x for x, _ in base} | {NOTICES[p] for p, _ in spans if p in NOTICES}
    sure = [WEIGHT["base"]] * len({x for x, _ in base}) + [WEIGHT["notice"]] * len({NOTICES[p] for p, _ in spans if p in NOTICES})
    expressions, allowed = [], None
    if tags:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        places = list(_TAG.finditer(folded))
        for m, after in zip(places, [p.start() for p in places[1:]] + [len(folded)]):
            # an expression ends at the next tag or with its line; parse() reads no further than its own tokens
            line_end = _LINE_END.search(folded, m.end(), after)
            rest = folded[m.end() : line_end.start() if line_end else after]
            try:
                postfix, used = parse(rest)
                if next(islice(_TOKEN.finditer(rest), used, None), None):  # more words stand on the line
                    postfix, used = parse(rest, among_prose=True)
                ok, names = evaluate(postfix)
            except BadExpression:
                labels.add("spdx-invalid")
                sure.append(WEIGHT["bad"])
                continue
            last = next(islice(_TOKEN.finditer(rest), used - 1, None))
            expressions.append(rest[: last.end()].strip())
            labels |= {f"spdx:{x}" if _KNOWN.fullmatch(x) else "spdx-unknown" for x in names}
            sure.append(WEIGHT["tag"] if any(map(_KNOWN.fullmatch, names)) else WEIGHT["bad"])
            allowed = ok if allowed is None else allowed and ok
    left = 1.0
    for w in sure:
        left *= 1 - w
    starts = [w for _, w in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x for x, _ in base})), "labels": ",".join(sorted(labels)), "score": round(1 - left, 6),
        "places": [{"label": BASE.get(p) or NOTICES.get(p) or "spdx-tag", "word": w} for p, w in spans], "expressions": expressions, "allowed": allowed,
    }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, word: long>>, expressions array<string>, allowed boolean"


def _scan(text_col: str, kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            got = [scan(t or "", found) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            made = [pa.array([g[n] for g in got], kind.field(f"lic_{n}").type) for n in (x.removeprefix("lic_") for x in kind.names)]
            keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text_col]
            yield pa.record_batch([c for _, c in keep] + made, [n for n, _ in keep] + kind.names)

    return run


def scan_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without their text, with fields prefixed lic_: counts, labels, all places found, expressions, policy verdict.

    Null texts are empty: no words, no labels (empty strings), score 0, places null. A text may hold several tags; it
    is allowed only if every expression is; an expression that cannot be parsed gives the label spdx-invalid, a name of no
    known family (such as prose behind a tag) spdx-unknown, which is never allowed. Repeated rows are scanned alike; an
    empty table gives none; other columns pass through, and one named lic_... stays beside the field of that name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    made = StructType([StructField(f"lic_{f.name}", f.dataType) for f in StructType.fromDDL(FIELDS).fields])
    kind = StructType([f for f in docs.schema.fields if f.name != text_col] + made.fields)
    return docs.mapInArrow(_scan(text_col, to_arrow_schema(made)), kind)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_licenses(docs)
    return out.select("doc_id", *(F.col(f"lic_{x}").alias(x) for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "allowed")))
