"""Mixing, surrogates, decontamination, archives, context trees and the pipeline."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kerbflow.llm import ctw, decontam, mixing, pii, warc
from kerbflow.scratch import Workspace

ODD = [None, "", "  ", "one two"]


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over


def test_mix_targets_and_copies(docs):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 40))), s) for i, s in enumerate(rng.choices(["a", "b", "é", None, "zz", "tiny"], [50, 9, 9, 9, 9, 1], k=600))]
    d = docs(rows + [(900, None, "a"), (901, "", "empty")])
    plan = mixing.plan_mix(d).collect()
    sizes = {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
    want = brute_targets(sizes)
    for r in plan:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(want[r.source]) and r.mix_copies <= 3
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate + 1e-9) <= r.mix_copies + (rate == math.floor(rate)) and r.mix_copies <= math.ceil(rate)
    assert sum(r.mix_target for r in {r.source: r for r in plan}.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.mix_sources(d).count() == sum(r.mix_copies for r in plan)
    assert sorted(map(repr, mixing.plan_mix(d).collect())) == sorted(map(repr, plan))
    assert mixing.mix_sources(docs([])).count() == 0 and mixing.mix_sources(docs([(1, None)])).count() == 0


def test_surrogates_keep_type_format_and_identity(docs):
    text = "Mail Anna.9@mail2.example.com or ANNA.9@MAIL2.EXAMPLE.COM, call +1 (017) 555-7713 or +10175557713 from 97.51.17.173; card 4068516892505468, token f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda. Mrs Jane Smith met Herr Boris and Mrs Jane Smith."
    rows = [text, *ODD, "nothing here 12 2024-01-02 3.14", "97.51.17.173"]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(rows), key="k").collect()}
    new = got[0].text
    for secret in ("Anna.9", "555-7713", "97.51.17.173", "4068516892505468", "f3ef4d6b", "Jane", "Boris", "5557713"):
        assert secret.lower() not in new.lower()
    assert re.fullmatch(r"Mail [A-Z]\w+\.\d@\w+\d\.\w+\.com or [A-Z]+\.\d@[A-Z]+\d\.[A-Z]+\.COM, call \+\d \(\d{3}\) \d{3}-\d{4} or \+\d{11} from [\d.]+; card \d{16}, token [0-9a-f]{40}\. Mrs [A-Z]\w+a [A-Z]\w+o met Herr [A-Z]\w+o and Mrs [A-Z]\w+a [A-Z]\w+o\.", new), new
    mails = re.findall(r"\S+@[\w.]+\w", new)
    assert mails[0].lower() == mails[1].lower()
    one, two = re.search(r"call (.*?) or (\S+) from", new).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert got[6].text in new and got[0].pii_count == 10 and got[0].pii_types == "card,email,family,ip,phone,secret,she"
    assert [got[i].text for i in range(1, 6)] == rows[1:6] and [got[i].pii_count for i in range(1, 6)] == [0] * 5
    assert pii.pseudonymise(docs([]), key="k").count() == 0


def luhn(digits):
    d = [int(c) for c in re.sub(r"\D", "", digits)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_persons_keep_their_names_apart_and_together(docs):
    rows = ["Mrs Jane Smith met Jane. Later Mrs Smith left; SMITH came, Janet and Smithers did not.", "Dr. Adams saw John Miller and Mr SMITH. Miller left.", "Mr Smith-Jones, Herr Smith", "Jane alone and a smith stay."]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(rows), key="k").collect()}
    m = re.fullmatch(r"Mrs (\w+) (\w+) met (\w+)\. Later Mrs (\w+) left; SMITH came, Janet and Smithers did not\.", got[0].text)
    assert m and m[1] == m[3] and m[2] == m[4] and m[1] != "Jane" and m[2] != "Smith"
    n = re.fullmatch(r"Dr\. (\w+) saw (\w+) (\w+) and Mr (\w+)\. (\w+) left\.", got[1].text)
    assert n and n[4] == m[2].upper() and n[3] == n[5] and len({n[1], n[2], n[3], m[2]}) == 4
    o = re.fullmatch(r"Mr (\w+), Herr (\w+)", got[2].text)
    assert o and o[2] == m[2] and o[1] != m[2] and got[3].text == rows[3] and got[3].pii_count == 0
    assert got[0].pii_types == "family,she" and got[1].pii_types == "family,he"
    other = pii.pseudonymise(docs(rows), key="another").where("doc_id = 0").first().text
    assert other != got[0].text


def test_numbers_with_check_digits_and_addresses(docs):
    rows = ["a 1700000000123 b 4845168114407328 c 4068516892505468 d 4068 5168 9250 5468", "DE89 3704 0044 0532 0130 00 and DE88370400440532013000", "+44 20 7946 0958 or +49 30 123456 at 12:30:45, 2001:db8:0:0:1:0:0:1 and fe80::1ff:fe23:4567:890a; std::string a::b", "x" * 70_000 + " call +1 (017) 555-7713"]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(rows), key="k").collect()}
    cards = re.fullmatch(r"a 1700000000123 b 4845168114407328 c (\d{16}) d (\d{4} \d{4} \d{4} \d{4})", got[0].text)
    assert cards and luhn(cards[1]) and cards[1] == cards[2].replace(" ", "") != "4068516892505468" and got[0].pii_count == 2
    iban = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and DE88370400440532013000", got[1].text)
    assert iban and mod97(iban[1]) == 1 and "0532" not in iban[1]
    net = re.fullmatch(r"\+\d\d \d\d \d{4} \d{4} or \+\d\d \d\d \d{6} at 12:30:45, ([0-9a-f:]+) and ([0-9a-f:]+); std::string a::b", got[2].text)
    assert net and net[1].count(":") == 7 and got[2].pii_types == "ipv6,phone" and "7946" not in got[2].text and "123456" not in got[2].text
    assert len(got[3].text) == len(rows[3]) and "555-7713" not in got[3].text


def test_surrogate_columns_do_not_clash(spark):
    d = spark.createDataFrame([("to a@b.com", 1, "t", "n", 5)], "text string, pii_count int, pii_text string, pii_row string, `odd.name` int")
    r = pii.pseudonymise(d, key="k").first()
    assert (r.pii_count, r.pii_text, r.pii_row, r["odd.name"]) == (1, "t", "n", 5) and "a@b.com" not in r.text


def test_hmac_equals_the_library(spark):
    import hashlib
    import hmac

    for key in ("k", "x" * 200, "schlüssel"):
        got = spark.range(1).select(pii._hmac(key, F.lit("card|1|0")).alias("h")).first().h
        assert got == hmac.new(key.encode(), b"card|1|0", hashlib.sha512).hexdigest()


def test_surrogates_stay_distinct_where_few_are_left(docs):
    pin = {"pin": r"(?<![\w#])#\d{2}(?!\w)"}
    rows = [f"pin #{i:02d} and #{(i * 7) % 40:02d}" for i in range(40)]
    got = pii.pseudonymise(docs(rows), key="k", patterns=pin).collect()
    to = {}
    for r in got:
        for a, b in zip(re.findall(r"#\d\d", rows[r.doc_id]), re.findall(r"#\d\d", r.text)):
            assert to.setdefault(a, b) == b
    assert len(set(to.values())) == len(to) == 40 and not set(to) & set(to.values())


def test_surrogates_grow_where_a_shape_has_too_few(spark, docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [f"to {a}@{b}.com now" for a in letters[:20] for b in letters[:20]]
    got = [r.text for r in pii.pseudonymise(docs(rows), key="k").collect()]
    made = {re.fullmatch(r"to ([a-z]+@[a-z]\.com) now", t)[1] for t in got}
    assert len(made) == len(rows) and not made & {r.split()[1] for r in rows}
    names = spark.range(30_000).select(F.concat(F.lit("n"), "id").alias("norm"), F.explode(F.array(F.lit("she"), F.lit("he"))).alias("kind"))
    drawn = names.select("kind", pii.core(F.col("kind"), F.col("norm"), F.lit(24), pii._stream("k", F.col("kind"), F.col("norm"), F.lit(24))).alias("made"))
    assert drawn.distinct().count() == 60_000 and drawn.where("not made rlike '^[a-z]{2,21}$'").isEmpty()


def test_leaks_tolerate_substitutions_in_both_join_forms(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (30, 20, 14, 12, 9, 5)]
    test = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(8, None, 0)], "item_id long, text string, n int")
    rows, want = [], set()
    for i, t in enumerate(items):
        w = t.split()
        for gap in (0, 7):  # substitutions seven words apart
            x = [word() + "q" if gap and k % gap == 3 else v for k, v in enumerate(w)]
            rows.append(" ".join([word() for _ in range(20)] + x + [word() for _ in range(20)]).title())
            if len(w) >= 9:  # of nine tokens, eight are enough
                want.add((len(rows) - 1, i))
    rows += [" ".join(word() for _ in range(60)) for _ in range(20)] + ODD
    for limit in (10**7, 0):
        got = decontam.find_leaks(docs(rows), test, broadcast_bytes=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    left = {r.doc_id for r in decontam.decontaminate(docs(rows), test).collect()}
    assert left == set(range(len(rows))) - {d for d, _ in want}
    assert decontam.find_leaks(docs([]), test).count() == 0 and decontam.find_leaks(docs(rows), test.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(6)
    for k in range(1, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        tree = warc.LoserTree([iter([{"v": v} for v in r]) for r in runs], lambda e: (e["v"],))
        assert [e["v"] for e in tree] == sorted(v for r in runs for v in r)


@pytest.mark.parametrize("url, key", [("http://www.Example.com:80/a?b#c", "com,example)/a?b"), ("https://u@h.org:8443", "org,h:8443)/"), (None, ")/"), ("http://a.b?x", "b,a)/?x")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_archives_round_trip(spark):
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", t) for i, t in enumerate(["<p>é</p>", "", None, "\r\n\r\nx", "<p>é</p>"] * 40)] + [(None, None, "<p>é</p>"), (199, "http://z", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    work = Workspace(spark, "warc-test")
    blocks = work.table(warc.write_archives(pages.repartition(11), work.path + "/a", block_entries=8), "blocks")
    assert blocks.select("run").distinct().count() > 9
    history = work.table(warc.merge_index(blocks, work.path + "/a", range_entries=40), "history")
    order = [(r.urlkey, r.ts, r.record) for r in history.orderBy("history_range", "history_seq").collect()]
    assert order == sorted(order) and len(order) == len(rows) and history.select("history_range").distinct().count() > 1
    got = warc.read_archives(history, work.path + "/a").collect()
    # many lanes: passes of fan-in 3, in pieces, give the same histories
    for pass_entries in (25, 10**6):
        again = work.table(warc.merge_index(blocks, work.path + "/a", range_entries=40, fan_in=3, pass_entries=pass_entries, block_entries=8), f"again-{pass_entries}")
        rows_of = lambda h: [(r.urlkey, r.ts, r.record, r.file, r.offset) for r in h.orderBy("history_range", "history_seq").collect()]
        assert sorted(rows_of(again)) == sorted(rows_of(history)) and [r[:3] for r in rows_of(again)] == order
    import base64
    import hashlib

    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(last.get(t or "", -1), i)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        again = i is not None and i < last[t or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[t or ""] if again else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    none = warc.write_archives(pages.limit(0), work.path + "/b")
    assert warc.read_archives(warc.merge_index(work.table(none, "none"), work.path + "/b"), work.path + "/b").count() == 0


def ctw_bits(train, text, depth):
    """Log2 probability by the recursive definition, the counts of training frozen: P_w(train with one bit) / P_w(train)."""

    def seq(t):
        s = b" ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()) + b"\n"
        return [(bytes([10] * depth + list(s))[i : i + depth], s[i]) for i in range(len(s))]

    counts = {}
    for t in train:
        for c, b in seq(t):
            for j in range(8):
                for d in range(depth + 1):
                    n = counts.setdefault((c[depth - d :], j, b >> (8 - j)), [0, 0])
                    n[(b >> (7 - j)) & 1] += 1
    children = {}
    for c, j, p in counts:
        if c:
            children.setdefault((c[1:], j, p), set()).add((c, j, p))

    def lw(node, extra, path):
        a, b = counts.get(node, (0, 0))
        if extra is not None and node[0] == path[len(path) - len(node[0]) :]:
            a, b = a + (extra == 0), b + (extra == 1)
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
        if len(node[0]) == depth:
            return kt
        kids = set(children.get(node, ()))
        if extra is not None and node[0] == path[len(path) - len(node[0]) :]:
            kids.add((path[depth - len(node[0]) - 1 :], *node[1:]))
        s = sum(lw(k, extra, path) for k in kids)
        return math.log(0.5) + kt + math.log1p(math.exp(s - kt)) if s <= kt else math.log(0.5) + s + math.log1p(math.exp(kt - s))

    total = 0.0
    for c, b in seq(text):
        for j in range(8):
            root = (b"", j, b >> (8 - j))
            total += lw(root, (b >> (7 - j)) & 1, c) - lw(root, None, c)
    return total / math.log(2)


@pytest.mark.parametrize("depth", [2, 4])
def test_context_trees_equal_the_definition(docs, depth):
    rows = ["abab abba Ab", "ba ab", "abc é", None, "", "the cab", "zz ab ab ab"]
    held = F.col("doc_id") % 3 == 2
    got = {r.doc_id: r for r in ctw.ctw_scores(docs(rows), held, depth=depth, block_bytes=16).collect()}
    train = [t for i, t in enumerate(rows) if i % 3 != 2]
    counts = {}
    for t in train:
        for w in [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(rows):
        r = got[i]
        assert -r.score / math.log10(2) == pytest.approx(-ctw_bits(train, t, depth), rel=1e-9)
        toks = [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in toks))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(toks), sum(w in counts for w in toks), n, i % 3 == 2)


def test_context_trees_without_training_or_rows(docs):
    assert ctw.ctw_scores(docs([]), F.lit(False)).count() == 0
    r = ctw.ctw_scores(docs(["ab", None]), F.lit(True)).where("doc_id = 1").first()
    assert r.score == pytest.approx(8 * math.log10(0.5)) and r.train_tokens == 0


def test_training_helps_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 1
    mean = lambda h: ctw.ctw_scores(d, h).where("doc_id % 5 = 1").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(held) > mean(held | (F.col("doc_id") % 5 > 2)) > mean(F.lit(True)) / 2


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work, kept = Workspace(spark, "pipeline-test"), docs
    for name, stage in P.STAGES[:-1]:
        after = work.table(stage(spark, kept, sf), name)
        assert sorted(after.columns) == sorted(docs.columns)
        ids, was = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= was and (ids < was or name == "personal_data")
        kept = after
    text = "\n".join(r.text for r in kept.collect())
    assert "@mail" not in text and not re.search(r"\(\d{3}\) 555-", text)
    out = P.run(spark, sf)
    assert out.count() == P.STAGES[-1][1](spark, kept, sf).count() > 0 and "mix_copy" in out.columns


#: Text, and the parts of it that must go.
LEAKS = [
    ("Anna Maria Schmidt lives", "Anna Maria Schmidt"), ("Prof Dr Adams asked", "Adams"), ("Dr. O'Brien said", "O'Brien Brien"), ("Mr. van der Berg came, Berg left", "Berg"), ("ask JANE SMITH", "JANE SMITH"),
    ("John, Mary and Peter went", "John Mary Peter"), ("at fe80::1 now", "fe80::1"), ("call 020 7946 0958", "7946 0958"), ("John F. Kennedy and F. stayed", "John Kennedy"), ("Mrs Dr Ingrid von Hohen-Stein", "Ingrid Hohen Stein"), ("SARAH O'NEIL", "SARAH NEIL"), ("Maria de la Cruz", "Maria Cruz"), ("Anne, David or Eva?", "Anne David Eva"),
]


def test_names_and_numbers_do_not_leak(docs):
    got = {r.doc_id: r for r in pii.pseudonymise(docs([t for t, _ in LEAKS]), key="k").collect()}
    for i, (text, gone) in enumerate(LEAKS):
        assert got[i].pii_count and not any(re.search(rf"(?<!\w){re.escape(g)}(?!\w)", got[i].text) for g in gone.split()), got[i].text
    assert got[1].text.startswith("Prof Dr ") and got[3].text.startswith("Mr. van der ") and got[4].text[4:].isupper() and re.fullmatch(r"call 0\d\d \d{4} \d{4}", got[7].text) and got[11].text.split()[1:3] == ["de", "la"]
    words = got[3].text.replace(",", "").split()
    assert words[3] == words[5]


def test_clean_words_and_country_codes_stay(docs):
    rows = ["Christian values, a Frank word, Annabel and std::map a::b1 at 12::30", "call +44 20 7946 0958 or +1 202 555 0143"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs(rows), key="k").collect()}
    assert got[0] == rows[0] and re.fullmatch(r"call \+44 \d\d \d{4} \d{4} or \+1 \d{3} \d{3} \d{4}", got[1]) and "7946" not in got[1]


def test_a_session_without_a_key_gets_a_secret_one(spark):
    before = spark.conf.get(pii.KEY, None)
    spark.conf.unset(pii.KEY)
    try:
        assert len(pii.surrogate_key(spark)) == 64 and pii.surrogate_key(spark) == pii.surrogate_key(spark)
    finally:
        spark.conf.unset(pii.KEY)
        if before:
            spark.conf.set(pii.KEY, before)
