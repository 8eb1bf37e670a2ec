"""N-gram Jaccard join by prefix filtering under several global token orders.

A pair above the threshold shares a prefix token under *every* total order of the tokens. Order 1 makes
the candidates (a shuffle by token); orders 2 and 3 are intersected with them before any set is compared.
All orders put tokens that are frequent anywhere last, so common phrases leave the prefixes.

Links are wanted as components, so copies are never paired with each other: equal sets collapse into one
class, and each token's bucket is compared with one class only, that in the middle of its group, so a group of near
copies becomes one component by as many links as it has members. Buckets that still span several components are
compared pair by pair inside the join, by bounds and sketches: small ones at once, large ones after further rounds with
other picks and then part by part, in as many tasks as they have pairs of parts. No link between different components is
ever skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import textkernel as K
from ..operators.graph import components
from ..scratch import Workspace

_U = np.uint64
BLOCK = 1 << 21
#: A token in a thousandth of the documents of a block is frequent; this only moves tokens in the orders.
FREQUENT = 1000
#: Frequent tokens in the order table: at most this many, the most frequent first. Others count as rare; results stay.
TABLE = 1 << 18
BITS = 1024
FOLDED = 512
#: A scan leaves out texts that no candidate needs: by a broadcast of up to WANTED hashed ids (16 MB), then by a filter of up
#: to MARKS bits (16 MB); beyond it texts are joined by id.
WANTED = 1_000_000
MARKS = 1 << 27
#: Classes of a bucket that is compared pair by pair at once. Larger ones are compared with one member a round, in at most
#: ROUNDS rounds and while these leave a quarter less to compare.
LARGE = 32
ROUNDS = 4
#: Members of a bucket that are compared with so many others in one place (some 16 million comparisons, a second or two): a larger bucket
#: is dealt to parts, and each two of its parts meet under a key of their own. Smaller parts cost more copies of rows.
PART = 4096


def _frequent(k: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(4, docs / FREQUENT)
            return pa.record_batch([pa.array(K.signed(h[keep]), pa.int64()), pa.array(n[keep], pa.int64())], ["token", "n"])

        for _, data, offsets in K.rows(batches, column):
            h, at = K.shingle_sets(*K.word_hashes(data, offsets), k)
            held.append(h)
            size, docs = size + len(h), docs + len(at) - 1
            if size >= BLOCK:
                yield flush()
                held, size, docs = [], 0, 0
        if held:
            yield flush()

    return run


def frequent_tokens(docs: DataFrame, k: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and a level by powers of two of the corpus's frequent tokens; at most TABLE of them."""
    found = docs.select(column).mapInArrow(_frequent(k, column), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = found.orderBy(F.desc("n"), "token").limit(TABLE).toArrow()
    token, n = table["token"].to_numpy().view(_U), table["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.clip(np.log2(np.maximum(n[order], 1)).astype(np.int64) + 1, 1, 62)


def _ranks(h: np.ndarray, token: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Position of each token in global order number ``order``: by level, then by a seeded hash."""
    key = K.mix(h ^ K.mix(np.array([order + 1], _U))[0]) >> _U(6)
    if len(token):
        at = np.searchsorted(token, h)
        at[at == len(token)] = 0
        key |= np.where(token[at] == h, level[at], 0).astype(_U) << _U(58)
    return key


def _sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1,024 parity bits a set: each token flips one bit, so two sets' sketches differ in no more bits than the sets do
    in tokens."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (K.mix(h ^ K.STEP[50]) & _U(BITS - 1)).astype(np.int64)
    odd = np.bincount(row * BITS + bit, minlength=BITS * (len(at) - 1)) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def _differing(a: str, b: str, bits: int = BITS) -> str:
    """SQL for the number of sketch bits in which two sets differ."""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(bits // 64))


def _unlike(a: str, b: str, na: str, nb: str, num: int, den: int, bits: int = BITS) -> str:
    """SQL: two sets of na and nb tokens differ in more sketch bits than sets as alike as num/den can."""
    return f"{_differing(a, b, bits)} > {na} + {nb} - 2 * (({num} * ({na} + {nb}) + {num + den - 1}) div {num + den})"


def _reachable(a: str, b: str, num: int, den: int) -> str:
    """SQL: two sets that meet at a token, the first they share, may still be as alike as num/den.

    The set whose prefix ends first has its common tokens among its shared prefix tokens and its suffix (m). The other's
    prefix may reach into that suffix, so all its tokens from the meeting on may be common (u).
    """
    most = f"if({a}.last <= {b}.last, least({a}.m, {b}.u), least({a}.u, {b}.m))"
    return f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) and {num + den} * {most} >= {num} * ({a}.n + {b}.n)"


def _profiles(k: int, num: int, den: int, column: str, key: str, token: np.ndarray, level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.rows(batches, column):
            h, at = K.shingle_sets(*K.word_hashes(data, offsets), k)
            n = np.diff(at)
            size = n - -(-n * num // den) + (n > 0)
            out = np.concatenate([[0], np.cumsum(size)])
            prefix, last = [], np.zeros(len(n), _U)
            for order in range(3):
                rank, chosen = _ranks(h, token, level, order), np.empty(int(out[-1]), _U)
                for d, (a, b, p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), out[:-1].tolist(), out[1:].tolist())):
                    if q > p:
                        s = h[a:b]
                        r = rank[a:b]
                        some = np.argpartition(r, q - p - 1)[: q - p] if q - p < b - a else np.arange(b - a)
                        chosen[p:q] = s[some[np.argsort(r[some])]] if order == 0 else s[some]
                        if order == 0:
                            last[d] = r[some].max()
                prefix.append(chosen)
            yield pa.record_batch(
                [
                    batch.column(batch.schema.get_field_index(key)),
                    pa.array(n, pa.int64()),
                    pa.array(K.signed(K.set_sums(h, at, 1)), pa.int64()),
                    K.lists(K.signed(_sketches(h, at)), BITS // 64 * np.arange(len(n) + 1), pa.int64()),
                    pa.array(K.signed(last ^ _U(1 << 63)), pa.int64()),
                    K.lists(K.signed(prefix[0]), out, pa.int64()),
                    *(K.lists((p >> _U(32)).astype(np.uint32).view(np.int32), out, pa.int32()) for p in prefix[1:]),
                ],
                ["doc", "n", "cls", "sketch", "last", "p1", "p2", "p3"],
            )

    return run


def _marks(ids: DataFrame, n: int) -> np.ndarray | None:
    """Bits at two hashed places for each of n ids, 16 bits an id; None where that takes more than MARKS bits."""
    bits = max(1 << 16, 1 << (16 * n - 1).bit_length())
    if bits > MARKS:
        return None
    places = ids.select(F.explode(F.expr(f"array(h & {bits - 1}, shiftrightunsigned(h, 32) & {bits - 1})")).alias("p"))
    found = places.groupBy((F.shiftright("p", 6)).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, _U)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return out


def _marked(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    most = _U(64 * len(marks) - 1)
    for batch in batches:
        h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False).view(_U)
        hit = np.ones(len(h), bool)
        for p in (h & most, h >> _U(32) & most):
            hit &= (marks[(p >> _U(6)).astype(np.int64)] >> (p & _U(63)) & _U(1)).astype(bool)
        yield batch.filter(pa.array(hit))


def _sets(k: int, column: str, marks: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offsets in K.rows(batches if marks is None else _marked(batches, marks), column):
            h, at = K.shingle_sets(*K.word_hashes(data, offsets), k)
            cls = K.signed(K.set_sums(h, at, 1))
            new = [not (c in seen or seen.add(c)) for c in cls.tolist()]
            yield pa.record_batch([pa.array(cls, pa.int64()), K.lists(K.signed(h), at, pa.int64())], ["cls", "tokens"]).filter(pa.array(new, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Documents linked when Jaccard of their distinct k-word shingles is at least num/den, as components.

    Returns one row per input row: (id_col, n_shingles, cls, component, is_first). ``cls`` is equal for equal
    sets; ``component`` is equal for documents joined by links; ``component_id`` is the smallest id in it.
    Text is lower-cased over A-Z and split on ASCII white space; a text of fewer than k words has its whole
    sequence as its one shingle; null, empty or blank texts have none, link with nothing and are components of
    their own (component null). Repeated rows stay separate rows of one class. Null ids never become a
    component_id unless a component has no other. Columns other than id and text are ignored. Sets are held as
    64-bit hashes, so two different sets meet only by a hash collision.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    token, level = frequent_tokens(docs, k, "text")
    kind = "doc long, n long, cls long, sketch array<long>, last long, p1 array<long>, p2 array<int>, p3 array<int>"
    full = work.table(docs.mapInArrow(_profiles(k, num, den, "text", "doc", token, level), kind), "full")
    profile = work.table(full.select("doc", "n", "cls"), "profile")
    # equal sets have equal rows, so copies meet on the map side
    first = full.where("n > 0").groupBy("cls").agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("n", "sketch", "last", "p1", "p2", "p3")))
    first = work.table(first, "classes")
    work.drop("full")
    work.settle()
    join = _Join(docs, first, k, num, den, work)
    places = work.table(join.places(), "places")
    places = work.table(join.with_partners(places), "places-0")
    work.drop("places")
    work.settle()
    join.links_of(join.with_picks(places, 0), "picks-0")
    before = None
    for step in range(1, ROUNDS + 1):
        bucket = join.placed(places).groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        # a bucket's pick has met its members, so two classes need no more
        bucket = work.table(bucket.where("low < high and c > 2").withColumn("large", F.col("c") > LARGE), f"bucket-{step}")
        members, large, left = bucket.agg(F.count("*"), F.count_if("large"), F.sum(F.expr("if(large, c * (c - 1) div 2, 0)"))).first()
        if not members:
            break
        places = work.table(places.join(bucket.select("token", "large", "c"), "token"), f"places-{step}")
        work.drop(f"places-{step - 1}")
        if not large or step == ROUNDS or (before and 4 * left > 3 * before):
            join.links_of(join.all_pairs(places.drop("large")), "rest")
            break
        before = left
        some, places = places.where("not large").drop("large"), places.where("large").drop("large", "c")
        join.links_of(join.all_pairs(some).union(join.with_picks(places, step)).distinct(), f"picks-{step}")
    comp = join.comp
    # the least id of a component from its classes, so that rows are joined once, by class
    if comp is None:
        found = first.select("cls", F.col("cls").alias("component"), F.col("doc").alias("least"))
    else:
        of = first.select("cls", "doc").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc", F.coalesce("comp", "cls").alias("component"))
        of = work.table(of, "class-components")
        least = of.groupBy("component").agg(F.min("doc").alias("least"))
        found = of.join(least, "component").select("cls", "component", "least")
    out = profile.join(found, "cls", "left")
    some = F.col("n") > 0
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(some, F.col("cls")).alias("cls"), F.when(some, F.col("component")).alias("component"), F.when(some, F.col("least")).otherwise(F.col("doc")).alias("component_id"))


class _Join:
    """The classes of equal sets, their places in buckets, and the links and components found so far."""

    def __init__(self, docs: DataFrame, first: DataFrame, k: int, num: int, den: int, work: Workspace):
        self.docs, self.first, self.k, self.num, self.den, self.work = docs, first, k, num, den, work
        self.links = self.comp = self.tested = self.loaded = None

    def places(self) -> DataFrame:
        """A row per class and prefix token (order 1) that another class has in its prefix too.

        ``far`` is small for a class whose prefix tokens are common: it lies in the middle of a group of near copies.
        """
        num, den = self.num, self.den
        tokens = self.first.select(F.posexplode("p1").alias("i", "token"), "cls", "n", "last")
        shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        # the first common token of a pair bounds its overlap: no token before it is common (u = tokens from it on), and of
        # the set whose prefix ends first, no prefix token that no other prefix holds (m leaves these out as well)
        mine = Window.partitionBy("cls", "n")
        size = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")
        held = F.count("*").over(mine)
        bound = F.col("n") - size + held - F.row_number().over(mine.orderBy("i")) + 1
        far = -(F.sum(F.floor(F.log2("c")) * 16).over(mine) / size).cast("int")
        return tokens.join(shared, "token").withColumns({"m": bound, "far": far}).select("token", "cls", "n", "m", (F.col("n") - F.col("i")).alias("u"), "last", "far")

    def with_partners(self, places: DataFrame) -> DataFrame:
        """Without places whose m is too small for any partner and whose bucket holds none that could reach them."""
        enough = f"{self.den} * m >= {self.num} * n"
        soonest = places.where(enough).groupBy("token").agg(F.min("last").alias("soonest"))
        return places.join(soonest, "token").where(f"{enough} or soonest < last").drop("soonest")

    def placed(self, places: DataFrame) -> DataFrame:
        if self.comp is None:
            return places.withColumn("comp", F.col("cls"))
        return places.join(self.comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def with_picks(self, places: DataFrame, step: int) -> DataFrame:
        """Pairs of each bucket's members with its pick: at first the class that lies nearest to the middle of a group, in
        later rounds that of a component dealt by a hash."""
        placed = self.placed(places)
        order = ([F.xxhash64("comp", F.lit(step)).alias("o")] if step else []) + ["far", F.xxhash64("cls").alias("h")]
        pick = F.min(F.struct(*order, "cls", "comp", "n", "m", "u", "last")).alias("pick")
        picks = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), pick).where("low < high").select("token", "pick.*")
        pairs = placed.alias("x").join(picks.alias("y"), "token")
        return self._ordered(pairs.where(f"x.cls <> y.cls and x.comp <> y.comp and {_reachable('x', 'y', self.num, self.den)}"))

    def all_pairs(self, places: DataFrame) -> DataFrame:
        """Pairs of each bucket's members in different components; what the sketches tell apart never becomes a row.

        places also have c, the size of their bucket. A bucket of over PART members is no key of the join: its parts are,
        two by two, so its comparisons spread over tasks.
        """
        num, den = self.num, self.den
        # the sketch folded in half is a sketch too, and half the bytes of a row; links_of looks at all of it
        folded = F.expr("array(" + ", ".join(f"sketch[{i}] ^ sketch[{i + FOLDED // 64}]" for i in range(FOLDED // 64)) + ")")
        mine = self.placed(places).join(self.first.select("cls", folded.alias("sketch")), "cls")
        could = f"x.own = x.part and y.own = y.other and (x.part < x.other or x.cls < y.cls) and x.comp <> y.comp and {_reachable('x', 'y', num, den)} and not {_unlike('x.sketch', 'y.sketch', 'x.n', 'y.n', num, den, FOLDED)}"
        parts = F.ceil(F.col("c") / PART).cast("int")
        own = F.pmod(F.xxhash64("cls", F.lit(5)), parts).cast("int")
        # both sides are one table, shuffled once: a row goes to every two parts that its own is one of
        met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("part"), F.greatest("own", k).alias("other")))
        mine = mine.select("token", "cls", "n", "m", "u", "last", "comp", "sketch", own.alias("own"), parts.alias("parts")).select("*", F.inline(met)).drop("parts")
        return self._ordered(mine.alias("x").join(mine.alias("y"), F.expr(f"x.token = y.token and x.part = y.part and x.other = y.other and {could}")))

    def _ordered(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(*(F.col(f"{t}.{c}").alias(n) for t, c, n in (("x", "cls", "a"), ("y", "cls", "b"), ("x", "n", "na"), ("y", "n", "nb"))))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb")).distinct()
        return pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(cls, tokens) of the classes in ids(cls), distinct: their texts are read again, those of others passed over."""
        wanted = self.first.select("cls", "doc").join(ids, "cls")
        if self.loaded is not None:
            wanted = wanted.join(self.loaded.select("cls"), "cls", "left_anti")
        wanted = self.work.table(wanted.withColumn("h", F.xxhash64("doc")), f"wanted-{name}")
        n = wanted.count()
        if n or self.loaded is None:
            texts, some, marks = self.docs.withColumn("h", F.xxhash64("doc")), wanted.select("h").distinct(), None
            if n <= WANTED:
                texts = texts.join(F.broadcast(some), "h", "left_semi")
            elif (marks := _marks(wanted, n)) is None:
                texts = texts.join(some, "h", "left_semi")
            read = self.work.table(texts.select("text", "h").mapInArrow(_sets(self.k, "text", marks), "cls long, tokens array<long>"), f"sets-{name}")
            # a hash or an id may bring in texts of other classes, and several texts of one
            read = read.join(wanted.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))
            self.loaded = self.work.table(read if self.loaded is None else read.union(self.loaded), f"loaded-{name}")
            self.work.drop(f"sets-{name}")
        return self.loaded.join(ids, "cls", "left_semi")

    def links_of(self, pairs: DataFrame, name: str) -> None:
        """Verifies pairs(a, b, na, nb): orders 2 and 3, before any set is read, then the sets."""
        num, den, work, first = self.num, self.den, self.work, self.first
        side = lambda x: first.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("sketch", "p2", "p3")))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"not {_unlike('sketcha', 'sketchb', 'na', 'nb', num, den)} and arrays_overlap(p2a, p2b) and arrays_overlap(p3a, p3b)").select("a", "b", "na", "nb")
        near = work.table(near, f"near-{name}")
        work.settle()
        sets = self.sets(near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).distinct(), name)
        both = near.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
        found = both.where(f"{num + den} * size(array_intersect(ta, tb)) >= {num} * (na + nb)")
        self._add(found.select(F.col("a").alias("u"), F.col("b").alias("v")), name)
        self.tested = work.table(near.select("a", "b") if self.tested is None else near.select("a", "b").union(self.tested), f"tested-{name}")
        work.settle()

    def _add(self, links: DataFrame, name: str) -> None:
        # earlier links count as one from each class to its component
        links = links if self.comp is None else links.union(self.comp.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")))
        self.links = self.work.table(links.distinct(), f"links-{name}")
        self.comp = self.work.table(components(self.links, self.work, f"stars-{name}"), f"comp-{name}")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end)) g from d),
n as (select d.doc_id, count(s.g)::bigint n from d left join s on s.doc_id = d.doc_id group by d.doc_id),
c as (select a.doc_id u, b.doc_id v, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
p as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 90 * (x.n + y.n - k)),
r as (select doc_id, doc_id comp from d union select r.doc_id, p.v from r join p on p.u = r.comp)
select n.doc_id, n.n n_shingles, min(r.comp) component_id from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n
"""
