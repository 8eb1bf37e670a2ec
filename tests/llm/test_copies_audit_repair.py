"""SimHash copies, filter audit and conversation repair against plain Python."""

import hashlib
import re
import zlib
from itertools import permutations, product

import duckdb
import numpy as np
import pytest
import xxhash

from kerbflow.llm import audit, repair, simhash

SF = "/root/testdata/sf0.001"
SPACES = "[ \\t-\\r]+"


# --- op11
def plain_fingerprint(text):
    words = [w for w in re.split(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(rows):
    """Smallest id reachable, per (id, fp), by comparing all with all."""
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def plain_simhash(rows):
    rows = [(d, plain_fingerprint(t)) for d, t in rows]
    return sorted(((d, fp, c) for (d, fp), c in zip(rows, plain_components(rows))), key=repr)


def spark_simhash(df):
    return sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.simhash_components(df).collect()), key=repr)


def test_simhash_cases(spark, docs):
    line = "one two three four five six seven eight nine ten " * 30
    rows = [(5, None), (3, ""), (9, " \n\t"), (1, "Short TEXT"), (2, "short text"), (7, line), (4, line + "eleven"), (4, line + "eleven"), (None, line), (None, "alone here"), (8, "Ünïcödé wörds\x0bhere and there"), (6, "x" * 300_000 + " " + line * 50)]
    assert spark_simhash(docs(rows)) == plain_simhash(rows)
    assert simhash.simhash_components(docs([])).collect() == []


def test_simhash_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op11_simhash(spark, SF).collect()), key=repr)
    assert got == plain_simhash(rows)


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = ("ab  c\td " * 500 + "e" * 900 + " f").encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    monkeypatch.setattr(simhash, "HASHES", 3)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text.decode())


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist()) | {0, (1 << 64) - 1, 1, 1 << 63}
    for seed in list(fps)[:6]:  # groups whose members are near some others, not all
        for _ in range(25):
            for bit in rng.integers(0, 64, 3):
                seed ^= 1 << int(bit)
            fps.add(seed)
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    links = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.close_links(df).collect()]
    assert all((u ^ v).bit_count() > 0 for u, v in links)
    comp = {f: f for _, f in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for u, v in links:
        comp[find(u)] = find(v)
    want = plain_components(rows)
    groups = {}
    for (i, f), c in zip(rows, want):
        groups.setdefault(c, set()).add(find(f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_dense_group_leaves_a_task_as_a_forest(spark):
    fps = [1 << i for i in range(63)]  # each two differ in two bits
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert simhash.close_links(df).count() == len(fps) - 1


# --- op12
def plain_audit(rows, labels):
    """rows of (id, text, source)."""
    low, marks = {}, {}
    for d, t, _ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    for d, q, x in labels:
        marks.setdefault(d, []).append((q == 1, x == 1))
    out = {}
    for d, t, part in rows:
        t = t or ""
        words = [w for w in re.split(SPACES, t) if w]
        bad = dict(zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > low[t])))
        good, toxic = (any(m[i] for m in marks.get(d, [])) if d is not None else False for i in (0, 1))
        for order in map("".join, permutations("ABCDE")):
            first = next((i for i, c in enumerate(order) if bad[c]), 9)
            for i, c in enumerate(order):
                cell = out.setdefault((part or "", order, i + 1), [0] * 6)
                for k, v in enumerate((first > i, first == i, bad[c] and first < i, bad[c] and sum(bad.values()) == 1, first == i and good, first == i and toxic)):
                    cell[k] += v
    total = {}
    for (part, order, step), cell in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + cell[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in audit.replay(audit.document_flags(df, labels)).collect()}


def test_audit_cases(spark, docs):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(1, many, "a"), (2, many, "a"), (2, many, "a"), (None, many, "a"), (3, None, None), (4, "", ""), (5, many.upper(), "b"), (6, "a b " * 40, "b"), (7, many + " #", "b"), (8, many + "\x0b" + "x" * 200_000, None), (None, None, "b")]
    rows += [(100 + i, "the same", "hot") for i in range(40)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (5, 1, 1), (101, 1, None), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(docs(rows), table) == plain_audit(rows, labels)
    assert audited(docs([]), table) == {}
    assert audited(docs(rows), table.where("false")) == plain_audit(rows, [])


def test_audit_query_equals_sql(spark):
    got = {tuple(r) for r in audit.op12_filter_audit(spark, SF).collect()}
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == set(c.sql(audit.OP12_SQL).fetchall()) and len(got) % 600 == 0


# --- op13
FORM = re.compile("(s?(ua)+)?")


def faults(said):
    seen, out = set(), []
    for role, text in said:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(said):
    """Cheapest (cost, audit, rows) over all edits with up to two insertions at a place."""
    found = faults(said)
    best = None
    inserts = [[("I", r, "", 5) for r in rs] for n in range(3) for rs in product(("user", "assistant"), repeat=n)]
    places = [inserts] * (len(said) + 1)
    choices = []
    for (role, text), f in zip(said, found):
        extra = 5 * (f == "truncated")
        some = [("D", None, None, 2)]
        if f not in ("blank", "duplicate"):
            some += [("K", role, text, extra)] + [("R", r, text, 1 + extra) for r in ("user", "assistant")]
        choices.append(some)
    for gaps in product(*places):
        spent = sum(5 * len(g) for g in gaps)
        if best and spent > best[0]:
            continue
        for turns in product(*choices):
            edits = [*gaps[0]]
            for t, g in zip(turns, gaps[1:]):
                edits += [t, *g]
            rows = [(r, x) for e, r, x, _ in edits if e != "D"]
            if FORM.fullmatch("".join(r[:1] or "?" for r, _ in rows)):
                key = (sum(e[3] for e in edits), "".join(e[0] for e in edits), rows)
                if best is None or key[:2] < best[:2]:
                    best = key
    return best


def by_recursion(said):
    """The same by the first letter and the rest, for longer conversations."""
    found = faults(said)
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    put = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {}
    for t in range(len(said), -1, -1):
        for _ in range(3):
            for q in (3, 2, 1, 0):
                some = [best[t, q]] if (t, q) in best else []
                if t == len(said):
                    some += [(0, "")] if q in (0, 3) else []
                else:
                    extra, role = 5 * (found[t] == "truncated"), said[t][0]
                    moves = [("D", 2, q)]
                    if found[t] not in ("blank", "duplicate"):
                        moves.append(("R", 1 + extra, put[q]))
                        if (q, role[:1]) in kept:
                            moves.append(("K", extra, kept[q, role[:1]]))
                    some += [(best[t + 1, to][0] + c, e + best[t + 1, to][1]) for e, c, to in moves if (t + 1, to) in best]
                if (t, put[q]) in best:
                    some.append((best[t, put[q]][0] + 5, "I" + best[t, put[q]][1]))
                if some:
                    best[t, q] = min(some)
    cost, edits = best[0, 0]
    rows, q, t = [], 0, 0
    for e in edits:
        if e == "D":
            t += 1
            continue
        role = said[t][0] if e == "K" else {2: "user", 3: "assistant"}[put[q]]
        rows.append((role, "" if e == "I" else said[t][1]))
        q, t = kept[q, role[:1]], t + (e != "I")
    return cost, edits, rows


def plain_repair(rows, solve=by_recursion):
    """conv_id -> result, from damaged (conv, turn, role, text) rows; None as turn comes first."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv and r[2] is not None]
        tie = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
        half = lambda x: int.from_bytes(bytes.fromhex(x), "big", signed=True)
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], half(tie(r)[:16]), half(tie(r)[16:])))
        said = [(r[2], r[3]) for r in mine]
        found, turns = faults(said), {r[1] for r in mine if r[1] is not None}
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, edits, left = solve(said)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)
    return out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            out.append((conv, turn, None, None))
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def spark_repair(turns):
    found = turns.sparkSession.createDataFrame(repair.audits(turns).collect(), repair.audits(turns).schema)
    sums = {r.conv_id: r.repaired_sha256 for r in repair.digests(repair.repaired(turns, found)).collect()}
    return {r.conv_id: (*(r[c] for c in RESULT[:-1]), sums.get(r.conv_id, hashlib.sha256().hexdigest())) for r in found.collect()}


def test_recursion_equals_all_edits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(12):
            said = [(["system", "user", "assistant", "tool", " "][rng.integers(5)], ["a.", "b", " ", "c!", "a."][rng.integers(5)]) for _ in range(n)]
            assert by_recursion(said) == every_repair(said)[:3], said


def test_repair_of_random_conversations(spark):
    rng = np.random.default_rng(2)
    rows = []
    for conv in range(60):
        for k in range(int(rng.integers(1, 40))):
            turn = None if rng.random() < 0.05 else int(rng.integers(-3, 60))
            rows.append((conv, turn, ["system", "user", "assistant", "user", "assistant", "tool", ""][rng.integers(7)], ["yes.", "no", "\n ", "what?\t", "x ", "é.", "a" * 3, "."][rng.integers(8)]))
    rows += [(None, 1, "user", "q?"), (None, 2, "assistant", "a."), (500, None, " ", " "), (501, 7, "user", "long " * 100_000 + "."), (501, 8, "assistant", "ok.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, code int")
    assert spark_repair(repair.turns_of(df)) == plain_repair(rows)
    assert repair.audits(repair.turns_of(df.where("false"))).collect() == []


def test_long_and_common_conversations(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k % 50}" + "." * (k % 3 > 0)) for k in range(900)]
    rows += [(c, k, r, t) for c in range(2, 400) for k, (r, t) in enumerate([("user", "hello."), ("user", "again"), ("assistant", "hi.")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert spark_repair(repair.turns_of(df)) == plain_repair(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "So?"), (1, 2, "user", "More."), (1, 3, "assistant", "Fine.")]
    turns = repair.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(r)[1:] for r in repair.repaired(turns, repair.audits(turns)).orderBy("position").collect()]
    assert got == [(0, 0, "user", "Hello.", "R"), (1, 1, "assistant", "So?", "R"), (2, 2, "user", "More.", "K"), (3, 3, "assistant", "Fine.", "K")]


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in RESULT) for r in repair.op13_repair_conversations(spark, SF).collect()}
    assert got == plain_repair(plain_damage(rows))


def test_damage_cases(spark):
    rows = [(None if c == 90 else c, None if t == 9 else t, None if t % 4 == 0 else "user", None if t % 5 == 0 else "One. Two! Three?") for c in range(100) for t in range(10)]
    damaged = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(((r.conv_id, r.turn, r.role if r.there else None, r.text if r.there else None) for r in damaged.collect()), key=repr)
    assert got == sorted(plain_damage(rows), key=repr)
