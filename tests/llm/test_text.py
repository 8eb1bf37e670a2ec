"""Text kernels, links, passages, quality, licences and token counts against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kerbflow.llm import chunks, licenses, quality, skew, textkernel as K, tokencount
from kerbflow.llm.jaccard import jaccard_components

ODD = [None, "", "   \n", "one", "one two", "É ñ 漢字 😀 x\x0by\x1fz"]


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉ \n\t漢", max_size=30)), max_size=6), st.integers(1, 4))
def test_shingles_equal_brute_force(texts, k):
    data, offsets = K.texts(pa.array(texts, pa.string()))
    h, at = K.shingle_sets(*K.word_hashes(data, offsets), k)
    seen = {}
    for i, t in enumerate(texts):
        w = split(fold(t))
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        got = h[at[i] : at[i + 1]]
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(want), got.tolist()) == got.tolist()


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = split(fold(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_components_equal_brute_force(docs, k, num, den):
    rng = random.Random(k)
    word = lambda: rng.choice(["of", "the", "a"] + [f"w{i}" for i in range(60)])
    base = [" ".join(word() for _ in range(n)) for n in (40, 60, 90, 30, 200)]
    texts = ODD + base * 2
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(rng.choice((1, 1, 2, 3))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), k=k, num=num, den=den).collect()}
    assert got == brute_components(rows, k, num, den)


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_appended_and_truncated_copies_at_the_threshold(docs, k, num, den):
    rng = random.Random(10 * k)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for i in range(150):
        n = rng.randint(12, 80)
        base = [word() for _ in range(n + k - 1)]
        more = n * (den - num) // num + (i % 5 == 0)
        long = base + [word() for _ in range(more)]
        texts += [" ".join(long), " ".join(base if i % 2 else long[more:])]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), k=k, num=num, den=den).collect()}
    assert got == brute_components(rows, k, num, den)


@pytest.mark.parametrize("k, num, den, edits", [(3, 9, 10, (1, 2, 3, 4)), (5, 4, 5, (2, 3, 4, 5))])
def test_near_misses_and_dense_groups_at_the_threshold(docs, k, num, den, edits):
    """A group whose members mostly lie just under the threshold of each other, and a group without its centre in which all do."""
    rng = random.Random(k)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(110)]
    texts = [" ".join(base)]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(len(w)), edits[i % len(edits)]):
            w[at] = word() if rng.random() < 0.7 else rng.choice(base)
        texts.append(" ".join(w))
    other = [word() for _ in range(60)]
    for i in range(60):
        texts.append(" ".join(other[:i] + [f"x{i % 7}"] + other[i + 1 :]))
    rows = [(5000 - i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), k=k, num=num, den=den).collect()}
    want = brute_components(rows, k, num, den)
    assert got == want and len({c for _, c in want.values()}) > 20


@pytest.mark.parametrize("large, part", [(4, 8), (300, 8)])
def test_parts_of_large_buckets_lose_no_link(docs, monkeypatch, large, part):
    from kerbflow.llm import jaccard

    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(110)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in rng.sample(range(len(w)), (1, 2, 3, 4)[i % 4]):
            w[at] = word()
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), k=3, num=9, den=10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_components_of_nothing_and_null_ids(docs):
    assert jaccard_components(docs([])).count() == 0
    got = jaccard_components(docs([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {4}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=5), st.integers(1, 4))
def test_cuts_follow_the_rolling_hash(texts, bits):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, row = chunks.cuts(data, offsets, bits, 50)
    got = [(int(r), int(s - offsets[r]), int(e - offsets[r])) for s, e, r in zip(starts, ends, row)]
    want = []
    for r, t in enumerate(texts):
        h, start = 0, 0
        for i, b in enumerate(t):
            h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
            if h >> (32 - bits) == 0 or i == len(t) - 1:
                want += [(r, a, min(a + 50, i + 1)) for a in range(start, i + 1, 50)]
                start = i + 1
    assert got == want


def test_repeated_passages(docs):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared = [text(70) for _ in range(8)]
    rows = [f"{text(40)} {shared[i % 8]} {text(30)}" for i in range(16)] + [text(150) for _ in range(20)] + ODD
    got = {r.doc_id for r in chunks.repeated_passages(docs(rows)).collect()}
    assert got == set(range(16))
    assert chunks.repeated_passages(docs([])).count() == 0


def test_every_repeat_of_over_50_words_has_a_row(docs):
    rng = random.Random(4)
    text = lambda n, most=9: " ".join("".join(rng.choice("aeioumnrst") for _ in range(rng.randint(1, most))) for _ in range(n))
    shared = [text(51, rng.choice((1, 3, 6))) for _ in range(60)] + ["a " * 50 + "a"]
    rows = [f"{text(rng.randint(0, 40))} {shared[i % len(shared)]} {text(rng.randint(0, 40))}" for i in range(2 * len(shared))] + [text(150) for _ in range(20)] + ODD
    got = {}
    for r in chunks.repeated_passages(docs(rows)).collect():
        got[r.doc_id] = got.get(r.doc_id, []) + [(r.start, r.n_bytes, r.first_doc)]
    assert set(got) == set(range(2 * len(shared)))
    for i, runs in got.items():
        at = rows[i].index(shared[i % len(shared)])
        assert any(f == i % len(shared) and s < at + len(shared[i % len(shared)]) and at < s + n for s, n, f in runs)


def test_deduplicated_texts_keep_one_copy(docs):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("aeioumnrsté") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared, own = text(80), [text(60) for _ in range(6)]
    rows = [(9, f"{own[0]} {shared} {own[1]}"), (3, f"{own[2]} {shared}"), (5, f"{own[3]} {shared} {own[4]} {shared}"), (None, f"{own[5]} {shared}"), (7, None), (8, ""), (1, "short"), (4, shared), (4, shared)]
    got = [(r.doc_id, r.text) for r in chunks.deduplicate(docs(rows)).collect()]
    assert len(got) == len(rows) and sorted((d, t) for d, t in got if d in (1, 3, 7, 8) and t is not None) == sorted((d, t) for d, t in rows if d in (1, 3, 8))
    short = {d: t for d, t in got}
    middle = shared[150:-150]
    for d, mine in ((9, own[:2]), (5, own[3:5]), (None, own[5:])):
        assert middle not in short[d] and all(o[:-40] in short[d] or o[40:] in short[d] for o in mine)
    assert len(short[4]) < 150 and chunks.deduplicate(docs([])).count() == 0


def test_very_long_runs(docs):
    """Texts of two million characters without a break, for the operators that encode, cut or scan them."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [c * 2_000_000 for c in (" ", "\n", "a", "é", "\t ")] + ["x" + " " * 1_200_000 + "y z"]
    got = {r.doc_id: r.tok_tokens for r in tokencount.count_tokens(docs(rows), P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(rows)}
    kept = {r.doc_id: (r.q_n_words, r.q_kept) for r in quality.quality_rules(docs(rows), P.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "q_n_words", "q_kept").collect()}
    assert kept == {i: (len(t.split()), False) for i, t in enumerate(rows)}
    assert {r.lic_n_words for r in licenses.scan_licenses(docs(rows)).collect()} == {0, 1, 3}
    assert {r.doc_id for r in chunks.repeated_passages(docs(rows)).collect()} == {0, 5}  # both hold over a million spaces
    assert sorted(r.n_shingles for r in jaccard_components(docs(rows)).collect()) == [0, 0, 0, 1, 1, 1]


def test_columns_of_clashing_names_stay(spark):
    import public_tokenizers as P

    d = spark.createDataFrame([(1, "one two", "a", "b", 5)], "doc_id long, text string, digest string, row string, n_tokens int")
    r = tokencount.count_tokens(d, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken")).first()
    assert (r.digest, r.row, r.n_tokens, r.tok_bytes) == ("a", "b", 5, 7)
    assert chunks.deduplicate(d).first().asDict() == d.first().asDict()


def test_license_tags_with_any_marks_and_unknown_names():
    found = licenses.automaton()
    for mark in "-_. /":
        got = licenses.scan(f"SPDX{mark}License{mark}Identifier: MIT", found)
        assert got["labels"] == "spdx:mit" and got["allowed"] is True
    got = licenses.scan("SPDX-License-Identifier: see the file", found)
    assert got["labels"] == "spdx-unknown" and got["allowed"] is False and got["score"] < 0.5
    assert licenses.scan("SPDX-License-Identifier:\tGPL-2.0-or-later WITH Classpath-exception-2.0", found)["labels"] == "spdx:gpl-2.0-or-later"
    assert licenses.scan("xspdx-license-identifier: mit", found)["labels"] == ""


def test_repeated_words_equal_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 3, 5, 9, 30, 60)] + ["a b c d e a b c d e", "A b c d e a b c d e"]
    data, offsets = K.texts(pa.array(texts))
    n, r = quality.repeated_words(data, offsets)
    for i, t in enumerate(texts):
        w = t.split()
        c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        assert n[i] == len(w) and r[i] == len({p for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)})


def test_quality_rules(docs):
    import public_tokenizers as P

    good = "The quick brown fox jumps over the lazy dog while many other animals watch it with some interest today."
    rows = [good, "a b c", None, "", " ".join(["spam ham eggs and more"] * 9), "x#*$\n\nx#*$\n \n", "\n".join([good, good]), "\x00\x7f" * 400]
    got = {r.doc_id: r for r in quality.quality_rules(docs(rows), P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert got[0].q_kept and not got[1].q_kept and not got[2].q_kept and not got[3].q_kept and not got[4].q_kept
    assert (got[5].q_n_symbols, got[5].q_n_dup_lines, got[5].q_word_chars) == (6, 1, 8) and got[6].q_n_dup_lines == 1
    assert got[2].q_n_words == 0 and got[2].q_base_failed and got[0].text == good and got[0].n == 1
    assert quality.quality_rules(docs([]), P.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_quality_bands_reject_junk_that_the_base_rule_keeps(docs):
    import public_tokenizers as P

    junk = "Ofthstrent### thoner$$$ to%%% ththwh$$$ oueand$$$ anthth$$$ the&&& onor*** rend*** to%%% tionwhing*** ingatin%%% and&&& thha,###"
    clean = "Haanth. Reoush hewh and onon hahehe. Ing that of. Ontiontion as thatndou the antiing thin and stndea in ndheha inst as o"
    short = "We had such a good time at the lake again 😀"
    got = {r.doc_id: r for r in quality.quality_rules(docs([junk, " ".join([junk, clean, junk[::-1]]), clean, short]), P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert not any(r.q_base_failed for r in got.values())
    assert [got[i].q_kept for i in range(4)] == [False, False, True, True]


@pytest.mark.parametrize("text, ok, names", [("mit", True, ["mit"]), ("mit or gpl-3.0 and x", True, ["mit", "gpl-3.0", "x"]), ("(mit or gpl-3.0) and x", False, ["mit", "gpl-3.0", "x"]), ("apache-2.0 with llvm-exception and mit", True, ["apache-2.0", "mit"]), ("mit some prose", True, ["mit"])])
def test_license_expressions(text, ok, names):
    assert licenses.evaluate(licenses.parse(text)[0]) == (ok, names)


@pytest.mark.parametrize("text", ["", "and mit", "mit or", "(mit", "mit or )"])
def test_bad_license_expressions(text):
    with pytest.raises(licenses.BadExpression):
        licenses.parse(text)


def test_license_scan(docs):
    text = "x CC-BY 4.0. GNU General Public License; all rights  reserved\nSPDX-License-Identifier: MIT OR (Apache-2.0 AND x)\ncc by"
    rows = [text, None, "", "clean text", "SPDX-License-Identifier: AND"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(rows)).collect()}
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text)) if x]
    assert (got[0].lic_n_words, got[0].lic_n_base, got[0].lic_first_word, got[0].lic_last_word) == (len(w), 4, 1, len(w) - 2)
    assert got[0].lic_base_labels == "cc-by,gpl,reserved" and "spdx:mit" in got[0].lic_labels and got[0].lic_allowed
    assert (got[1].lic_n_words, got[1].lic_labels, got[1].lic_score, got[1].lic_first_word) == (0, "", 0.0, None)
    assert got[4].lic_labels == "spdx-invalid" and got[3].lic_labels == ""


def test_every_license_tag_of_a_line_is_read():
    found = licenses.automaton()
    got = licenses.scan("/* SPDX-License-Identifier: MIT */ f(); /* SPDX-License-Identifier: GPL-3.0 */ g()", found)
    assert got["labels"] == "spdx:gpl-3.0,spdx:mit" and got["allowed"] is False and got["expressions"] == ["mit", "gpl-3.0"]
    got = licenses.scan("SPDX-License-Identifier: " + "mit or " * 400 + "x and\nSPDX-License-Identifier: isc", found)
    assert got["labels"] == "spdx-invalid,spdx:isc"
    got = licenses.scan("SPDX-License-Identifier: " + "mit and " * 400 + "gpl-3.0", found)
    assert got["allowed"] is False and "spdx:gpl-3.0" in got["labels"]


def test_license_places_equal_brute_force():
    rng = random.Random(3)
    found = licenses.automaton()
    for _ in range(200):
        w = [rng.choice("cc by general public license all rights reserved sa gnu lesser".split()) for _ in range(40)]
        want = sorted(i for p in licenses.BASE for i in range(40) if w[i : i + len(p.split())] == p.split())
        got = licenses.scan(" ".join(w), found)
        assert got["n_base"] == len(want) and [got["first_word"], got["last_word"]] == ([want[0], want[-1]] if want else [None, None])


def test_token_counts_equal_the_library(docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = ODD + ["a <|endoftext|> b", "<|endoftext|", "it's  12½ don't\t\r\n x" * 9, "\x00\x85  ǅ ٣ 中文 ßüñ", "plain words here", "plain words here"]
    cache = str(tmp_path / "cache")
    for _ in range(2):  # cold, then from the cache
        got = tokencount.count_tokens(docs(rows), P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), cache=cache).collect()
        assert {r.doc_id: (r.tok_bytes, r.tok_tokens) for r in got} == {i: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(rows)}
    more = tokencount.count_tokens(docs(rows + ["new"]), P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), cache=cache)
    assert more.count() == len(rows) + 1
    pieces = tokencount.count_tokens(docs(rows), P.path("piece_bpe_32k.model")).where("doc_id = 3").first()
    assert pieces.tok_tokens == 1


def test_split_join_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 2 = 0 then 'hot' else 'k' || id % 1500 end key")
    values = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    hot = skew.hot_keys(values, "key")
    assert "hot" in {r.key for r in hot.collect()} and hot.count() < skew.HOT
    got = skew.split_join(rows, values.where("key <> 'k1'"), "key", hot, ["id"], "left")
    want = rows.join(values.where("key <> 'k1'"), "key", "left").select("key", "id", "least", "n")
    assert sorted(map(tuple, got.select("key", "id", "least", "n").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert skew.hot_keys(values.where("false"), "key").count() == 0


def test_hot_text_has_all_its_counts_and_no_text_is_shuffled(docs):
    import public_tokenizers as P

    rows = [(i, "one text that many rows hold" if i % 3 else f"text {i}") for i in range(300)] + [(7, None), (None, "")]
    found = tokencount.count_tokens(docs(rows), P.path("byte_bpe_50k.json"))
    got = sorted((str(r.doc_id), r.text or "", r.tok_tokens) for r in found.collect())
    count = tokencount.Counter(P.path("byte_bpe_50k.json"))
    assert got == sorted((str(i), t or "", count(t or "")) for i, t in rows)
    plan = found.select("doc_id", "tok_tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _c1" not in plan  # column 1 is the text


def test_hot_passage_is_found_in_all_documents(docs):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{i} start {i * 7} {passage} end {i * 13} {i}") for i in range(400)] + [(1000 + i, f"clean {i} " + " ".join(f"x{i}y{k}" for k in range(40))) for i in range(100)]
    found = chunks.repeated_passages(docs(rows)).collect()
    assert {r.doc_id for r in found} == set(range(400)) and {r.first_doc for r in found} == {0}


def test_prose_behind_a_tag_ends_the_expression():
    found = licenses.automaton()
    cases = {
        "Apache-2.0 and we also accept": ("apache-2.0", "spdx:apache-2.0", True), "MIT or see below": ("mit", "spdx:mit", True), "MIT with much love": ("mit", "spdx:mit", True),
        "(MIT or x) and BSD-3-Clause. Thanks": ("(mit or x) and bsd-3-clause", "spdx-unknown,spdx:bsd-3-clause,spdx:mit", True), "python": ("python", "spdx-unknown", False),
        "GPL-2.0-only WITH Classpath-exception-2.0": ("gpl-2.0-only with classpath-exception-2.0", "spdx:gpl-2.0-only", False), "mit/apache-2.0": ("mit", "spdx:mit", True),
    }
    for text, want in cases.items():
        got = licenses.scan(f"SPDX-License-Identifier: {text}", found)
        assert (got["expressions"][0], got["labels"], got["allowed"]) == want, text


def test_white_space_takes_no_square_of_its_length():
    import time

    import public_tokenizers as P

    from kerbflow.llm import quality, tokencount

    fertility = quality.Fertility(P.path("byte_bpe_multi_50k.tiktoken"))
    count = tokencount.Counter(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    start = time.time()
    for n in (60_000, 65_535, 300_000):
        assert len(fertility.tokens(("a" + " " * n) * 5)) > 5 and count(("a" + " " * n) * 5) > 5
    assert time.time() - start < 10
    for gap in (" " * 255, " " * 256, "\n" * 300, " \t" * 200, " " * 260, "\x1c" * 300, "\xa0" * 256 + " "):
        for text in (f"a{gap}b", f"a{gap}", f"{gap}b", f"{gap}!{gap}7{gap}", gap, f"a {gap}\n b"):
            assert fertility.tokens(text).tolist() == fertility.encoding.encode_ordinary(text), repr(text)
