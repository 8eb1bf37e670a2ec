"""The pipeline stage by stage against plain Python, on rows with nulls, empty, very long and repeated texts."""

import base64
import random
import re
from collections import Counter
from math import log2

import duckdb
import regex

import corpus_pipeline as P
from kerbflow.llm import decontam, mixing, quality
from kerbflow.scratch import Workspace
from test_text import brute_components

WHITE = re.compile("[ \t-\r]+")


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["the", "re", "in", "on", "and", "st", "er", "ha"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(1, " ".join(word() for _ in range(30))), (2, " ".join(word() for _ in range(14))), (3, "too short"), (4, None)]
    rows = [(k, prose(rng.randint(20, 120)), "en", f"s{k % 4}") for k in range(40)]
    near = rows[3][1].split() if len(rows[3][1].split()) >= 60 else prose(90).split()
    rows.append((50, " ".join(near), "en", "s0"))
    for k in range(51, 57):
        w = list(near)
        w[rng.randrange(len(w))] = word() + "x"
        rows.append((k, " ".join(w), "de", "s1"))
    rows += [(60, f"{prose(25)} {items[0][1]} {prose(20)}", "en", "s2"), (61, f"{prose(25)} {items[1][1].upper()} {prose(20)}", "en", None), (62, f"{prose(30)} {' '.join(w + 'q' if i % 7 == 3 else w for i, w in enumerate(items[0][1].split()))} {prose(9)}", "fr", "s3")]
    rows += [(70, None, "en", "s0"), (71, "", None, "s0"), (72, " \n\t ", "en", "s1"), (73, "few words", "en", "s1"), (74, "again and again so it goes " * 12, "en", "s1"), (75, "#*$ %&| <> ## $$ ** && || << >> " * 9, "en", "s2")]
    rows += [(80, prose(40) + " Call Anna Schmidt at 202-555-0143 or mail anna.s@mail.example.", "en", "s2"), (81, prose(15_000), "es", "s3"), (None, prose(44), "en", "s0"), (82, "日本語 の 文章 " * 3 + prose(30), "ja", "s3")]
    rows += [rows[5]] * 3 + [(90, rows[6][1], "en", "s9"), (91, rows[7][1].upper(), "en", "s2")]
    return rows, items


def kept_by_quality(rows, ranks):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    script = {"latin": r"[A-Za-zÀ-ʿ]", "cjk": r"[　-\udfff]"}
    out = []
    for r in rows:
        text = r[1] or ""
        words = [w for w in WHITE.split(text) if w]
        wide = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + j for i in range(len(words) - 4) if wide[tuple(words[i : i + 5])] > 1 for j in range(5)}
        if len(words) < 10 or 100 * len(inside) > 20 * len(words):
            continue
        ids = code.encode_ordinary(text)
        n = len(ids)
        partial = sum(1 for i in ids if not _whole(code, i))
        entropy = -sum(c / n * log2(c / n) for c in Counter(ids).values()) / log2(n) if n > 1 else 1.0
        counts = {k: len(re.findall(p, text)) for k, p in script.items()}
        low, high, most, least = quality.BANDS.get(r[2] or "") or quality.BANDS[max(counts, key=counts.get) if any(counts.values()) else "any"]
        if low <= len(text) / n <= high and partial <= most * n + quality.ODD and entropy >= least:
            out.append(r)
    return out


def _whole(code, token):
    try:
        code.decode_single_token_bytes(token).decode()
        return True
    except UnicodeDecodeError:
        return False


def one_of_each(rows):
    comp = brute_components([(i if r[0] is None else r[0], r[1]) for i, r in enumerate(rows, 10_000)], 5, 4, 5)
    seen, out = set(), []
    for i, r in enumerate(rows, 10_000):
        own = i if r[0] is None else r[0]
        if comp[own][1] == own and (own, r[1]) not in seen:
            seen.add((own, r[1]))
            out.append(r)
    return out


def leaks(text, item):
    w, b = (regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for t in (text, item))
    size = min(decontam.WINDOW, len(b))
    for mask in decontam.MASKS:
        at = {}
        for p in range(len(b) - decontam.SPAN + 1):
            at.setdefault(tuple(b[p + o] for o in mask), []).append(p)
        for p in range(len(w) - decontam.SPAN + 1):
            for q in at.get(tuple(w[p + o] for o in mask), []):
                for back in range(decontam.WINDOW - decontam.SPAN + 1):
                    i, j = p - back, q - back
                    if i >= 0 and j >= 0 and i + size <= len(w) and j + size <= len(b):
                        if sum(x == y for x, y in zip(w[i : i + size], b[j : j + size])) * decontam.WINDOW >= decontam.LEAST * size:
                            return True
    return False


def test_stages_equal_plain_python(spark, tmp_path):
    import public_tokenizers

    rows, items = corpus()
    full = [(d, t, lang, s, len(t) if t else None) for d, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, work = spark.read.parquet(str(tmp_path / "documents.parquet")), Workspace(spark, "stages")
    stages = dict(P.STAGES)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    want = kept_by_quality(full, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    now = work.table(stages["quality"](spark, docs, str(tmp_path)), "quality")
    assert pairs(now) == sorted(((r[0], r[1]) for r in want), key=repr) and 10 < len(want) < len(full)
    want = one_of_each(want)
    now = work.table(stages["near_duplicates"](spark, now, str(tmp_path)), "near")
    assert pairs(now) == sorted(((r[0], r[1]) for r in want), key=repr) and {r[0] for r in want}.isdisjoint(range(51, 57))
    want = [r for r in want if not any(leaks(r[1], t) for _, t in items)]
    now = work.table(stages["decontamination"](spark, now, str(tmp_path)), "clean")
    assert pairs(now) == sorted(((r[0], r[1]) for r in want), key=repr) and {r[0] for r in want}.isdisjoint({60, 61, 62})
    now = work.table(stages["personal_data"](spark, now, str(tmp_path)), "private")
    after = {r.doc_id: r for r in now.collect()}
    for r in want:
        assert (after[r[0]].text == r[1]) == (r[0] != 80) and after[r[0]].n_chars == len(after[r[0]].text)
    assert not re.search("Anna|Schmidt|0143|anna", after[80].text) and len(after) == len(want)
    copies = Counter(r.doc_id for r in stages["mixture"](spark, now, str(tmp_path)).collect())
    c = duckdb.connect()
    c.register("documents", now.select("doc_id", "text", "source").toArrow())
    plan = c.sql(mixing.OP1_SQL).fetchall()
    assert {d: size * copies.get(d, 0) for d, size, *_ in plan} == {d: taken for d, _, _, _, taken in plan} and max(copies.values()) <= 3 and len(plan) == len(want)
    assert Counter(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == copies


def test_an_empty_corpus_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
