"""Conversation structure repair: the cheapest edits that turn each conversation's roles into ``(s?(ua)+)?``.

Turns become one small code each; conversations are bucketed by length and a bucket is one time-major tensor. A step of the
dynamic programme updates the four states' costs of all its conversations at once, from the last turn to the first; the
stored costs then give all edits in one pass over the turns, again for all conversations at once. Texts never enter the
tensor: they are streamed once more, in order, past their conversation's edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import Workspace

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn is put in, and after a turn that is kept, by its initial s, u, a or another.
PUT = np.array([USER, USER, ASSISTANT, USER])
NONE = -1
KEPT = np.array([[SYSTEM, USER, NONE, NONE], [NONE, USER, NONE, NONE], [NONE, NONE, ASSISTANT, NONE], [NONE, USER, NONE, NONE]])
FAR = 1 << 40
#: Codes of a turn: the initial's number, plus flags; ABSENT fills up a bucket.
MUST, TRUNCATED, ABSENT = 4, 8, 16
#: Turns that a tensor holds, padding included.
CELLS = 1 << 18


def cheapest(codes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and edits (D, I, K, R in order, the ASCII-least of equal cost) of each column of codes(turn, conversation)."""
    turns, n = codes.shape
    initial, gone, must = codes & 3, codes & ABSENT > 0, codes & MUST > 0
    delete = np.where(gone, 0, DELETE)
    stay = np.where(gone | must, FAR, np.where(codes & TRUNCATED > 0, CUT, 0)).astype(np.int64)
    cost = np.empty((turns + 1, 4, n), np.int64)
    cost[turns] = np.array([0, FAR, FAR, 0])[:, None]

    def put_in(now: np.ndarray) -> None:
        for _ in range(2):  # a third put-in turn never pays
            np.minimum(now, now[PUT] + INSERT, out=now)

    def keep(after: np.ndarray, t: int, state: int | np.ndarray, at=slice(None)) -> np.ndarray:
        to = KEPT[state, initial[t][at]]
        return np.where(to == NONE, FAR, after[to, np.arange(n)[at]] + stay[t][at])

    put_in(cost[turns])
    for t in range(turns - 1, -1, -1):
        after, now = cost[t + 1], cost[t]
        for state in range(4):
            now[state] = np.minimum(np.minimum(after[state] + delete[t], after[PUT[state]] + REROLE + stay[t]), keep(after, t, state))
        put_in(now)

    letters = np.zeros((turns + 1, 3, n), np.uint8)
    state, every = np.full(n, START), np.arange(n)
    for t in range(turns + 1):
        left = every if t < turns else every[cost[t][state, every] > 0]
        for slot in range(3):
            if not len(left):
                break
            q = state[left]
            here = cost[t][q, left]
            insert = cost[t][PUT[q], left] + INSERT == here
            if t < turns:
                after = cost[t + 1]
                drop = after[q, left] + delete[t][left] == here
                hold = keep(after, t, q, left) == here
                letter = np.where(drop, ord("D"), np.where(insert, ord("I"), np.where(hold, ord("K"), ord("R"))))
                state[left] = np.where(drop, q, np.where(insert | ~hold, PUT[q], KEPT[q, initial[t][left]]))
                letters[t, slot, left] = np.where(gone[t][left] & drop, 0, letter)
                left = left[~drop & insert]
            else:
                letters[t, slot, left] = ord("I")
                state[left] = PUT[q]
                left = left[cost[t][PUT[q], left] > 0]
    flat = letters.reshape(-1, n).T
    ends = np.cumsum((flat > 0).sum(axis=1)).tolist()
    text = flat[flat > 0].tobytes()
    return cost[0, START], [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Bucket:
    """Conversations of about equal length until they fill a tensor."""

    def __init__(self, length: int):
        self.length, self.codes, self.facts = length, [], []

    def add(self, codes: np.ndarray, facts: list) -> bool:
        self.codes.append(codes)
        self.facts.append(facts)
        return len(self.codes) * self.length >= CELLS

    def solve(self) -> list[list]:
        tensor = np.full((max(map(len, self.codes)), len(self.codes)), ABSENT, np.uint8)
        for k, codes in enumerate(self.codes):
            tensor[: len(codes), k] = codes
        cost, edits = cheapest(tensor)
        return [[*facts, c, e.decode()] for facts, c, e in zip(self.facts, cost.tolist(), edits)]


def _facts(group: np.ndarray, turn: np.ndarray, known: np.ndarray, code: np.ndarray, digest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the turns of n conversations, each one's gaps, blank, duplicate, truncated and illegal counts, and its
    range of codes. Rows are in order of conversation and turn; those that are not there have a negative code."""
    there = code >= 0
    group, turn, known, code, digest = group[there], turn[there], known[there], code[there], digest[there]
    order = np.lexsort((np.arange(len(group)), digest[:, 1], digest[:, 0], group))
    key = np.column_stack([group, digest])[order]
    again = np.zeros(len(group), bool)
    again[order[1:]] = (key[1:] == key[:-1]).all(axis=1)
    blank = code & MUST > 0
    again &= ~blank
    cut = (code & TRUNCATED > 0) & ~blank & ~again
    initial, next_to = code & 3, group[1:] == group[:-1]
    legal = ((initial[1:] == 1) & ((initial[:-1] == 0) | (initial[:-1] == 2))) | ((initial[1:] == 2) & (initial[:-1] == 1))
    of, times = group[known], turn[known]
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, of, times)
    np.maximum.at(high, of, times)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (times[1:] != times[:-1])
    distinct = np.bincount(of[new], minlength=n)
    gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)
    counts = [np.bincount(group[x], minlength=n) for x in (blank, again, cut)]
    counts.append(np.bincount(group[1:][next_to & ~legal], minlength=n))
    codes = initial | np.where(blank | again, MUST, 0) | np.where(cut, TRUNCATED, 0)
    return codes.astype(np.uint8), np.stack([gaps, *counts], axis=1), np.searchsorted(group, np.arange(n + 1))


AUDIT = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(schema: pa.Schema):
    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, Bucket] = {}

        def add(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Whole conversations, one behind the other."""
            rows = pa.Table.from_batches(parts).combine_chunks()
            ids, turn = rows["conv_id"], rows["turn"]
            new = np.concatenate([[True], _changes(ids.combine_chunks())])
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            code, low, high = (rows[c].to_numpy() for c in ("code", "low", "high"))
            codes, facts, at = _facts(group, turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(), code, np.stack([low, high], axis=1), len(first))
            at = at.tolist()
            for conv, a, b, fact in zip(ids.take(pa.array(first)).to_pylist(), at[:-1], at[1:], facts.tolist()):
                length = 1 << max(b - a - 1, 0).bit_length()
                bucket = buckets.setdefault(length, Bucket(length))
                if bucket.add(codes[a:b], [conv, *fact]):
                    yield table(buckets.pop(length).solve())

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = np.flatnonzero(_changes(batch.column(0)))
            start = int(last[-1]) + 1 if len(last) else 0
            if not start and len(held) > 1 and not _changes(pa.concat_arrays([held[-2].column(0)[-1:], batch.column(0)[:1]])).any():
                continue  # one conversation so far
            ready, held = [*held[:-1], batch.slice(0, start)], [batch.slice(start)]
            if sum(p.num_rows for p in ready):
                yield from add(ready)
        if held:
            yield from add(held)
        for bucket in buckets.values():
            yield table(bucket.solve())

    return run


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, there, code, low, high) of a conversation table: the columns that ``audits`` and
    ``repaired`` take. Null roles and texts are one space. Rows for which ``there`` does not hold only name their
    conversation. low and high are a 128-bit digest of role and text."""
    said = rows.select(conv, turn, *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in (role, text)), (F.lit(True) if there is None else there).alias("there"))
    said = said.toDF("conv_id", "turn", "role", "text", "there").withColumn("turn", F.col("turn").cast("long"))
    ends = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(ends == "", MUST).when(F.right(ends, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return said.select("*", F.when(F.col("there"), code).otherwise(-1).cast("int").alias("code"), half(1).alias("low"), half(17).alias("high"))


#: Order of a conversation's turns; nulls come first.
ORDER = ["turn", "role", "low", "high"]


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns_of's table: gaps, counts of first faults, illegal neighbours, cost and edits.

    Turns are taken in order of turn (nulls first), equal turns by role, then by a digest of role and text. A blank turn
    holds only white space, a duplicate one repeats role and text of an earlier turn, a truncated one does not end with
    ``.``, ``!`` or ``?``; a turn counts for the first of these. A null conv_id is a conversation. A conversation all of
    whose rows are not there, or an empty one, has zeros and no edits. A task holds codes and costs (33 bytes a turn) of
    the conversations it buckets, CELLS turns a bucket; only a conversation longer than that makes a larger tensor.
    """
    key = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(key)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    coded = turns.select("conv_id", "turn", "role", "code", "low", "high").repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return coded.drop("role").mapInArrow(_audits(schema), AUDIT.format(key=key.simpleString()))


REPAIRED = "conv_id {key}, position long, turn long, role string, text string, edit string"


def _repaired(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, at, state, position = None, "", 0, START, 0
        out: list[list] = [[] for _ in schema]

        def put(turn, role: str, text: str, edit: str) -> None:
            nonlocal state, position
            for values, v in zip(out, (conv, position, turn, role, text, edit)):
                values.append(v)
            position += 1
            state = int(KEPT[state, "sua".find(role[0])])

        def put_in() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                put(None, ROLE[int(PUT[state])], "", "I")
                at += 1

        for batch in batches:
            for conv_id, audit, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text"))):
                if audit is not None:
                    put_in()
                    conv, edits, at, state, position = conv_id, audit, 0, START, 0
                    continue
                put_in()
                edit, at = edits[at], at + 1
                if edit != "D":
                    put(turn, role if edit == "K" else ROLE[int(PUT[state])], text, edit)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
            out = [[] for _ in schema]
        put_in()
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return run


ROLE = {USER: "user", ASSISTANT: "assistant"}


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations (conv_id, position, turn, role, text, edit), in order within each task; put-in turns have
    no turn and an empty text. ``found`` is audits(turns). A task streams its rows and holds the edits of one conversation."""
    key = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(key)), ("position", pa.int64()), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "text", "edit"))])
    rows = turns.where("there").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "low", "high", F.lit(1).alias("part"))
    heads = found.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("low", "long"), ("high", "long"))), F.lit(0).alias("part"))
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    return both.select("conv_id", "audit", "turn", "role", "text").mapInArrow(_repaired(schema), REPAIRED.format(key=key.simpleString()))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired()'s rows as they stream by: ``role:text`` of the turns, newline-joined."""
    key = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(key)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, done = None, None, []
        for batch in batches:
            for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = conv_id, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema[0].type), pa.array([sha.hexdigest()])], schema=schema)

    return rows.mapInArrow(run, f"conv_id {key.simpleString()}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with planted faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row
    (there is false), 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    said = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("kind"))
    said = said.withColumn("copy", F.explode(F.expr("if(kind = 3, array(1, 2), array(1))")))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return said.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("kind") != 0).alias("there"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of the damaged conversations and the digest of each repaired one; that of an empty one is of no bytes."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = turns_of(rows, there=F.col("there"))
    found = Workspace(spark, "repair").table(audits(turns), "audits")
    sums = digests(repaired(turns, found)).withColumnRenamed("conv_id", "of")
    out = found.join(sums, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
