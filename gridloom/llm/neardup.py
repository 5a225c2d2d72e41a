"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Its sketch keeps, for
each of ``registers`` buckets of the hash space, the leading-zero count and
the mantissa bits of the smallest hash there. Runs of ``rows`` registers are
hashed to band keys. Documents that share a band key are candidates; a
collision-corrected Jaccard estimate from the registers drops those that
cannot reach the threshold, and the rest are verified on the full sets.

No group is expanded into all its pairs: equal sets are one class from the
start; first each class meets one centre of each of its bands, and its best
candidate is verified. From then on a pair matters only if it would join two
components: the classes' other candidates, and band by band the class with the
fewest elements of its own, which has the most links in a group of edited
copies, with the classes of other components. At last the sets' rarest
elements decide what else can link: two sets at the threshold share one of
these, and few enough of the rarer elements stand before it. This is exact,
and leaves little to verify where most copies differ from all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import arrow_map, cut, join_counted, join_hot

MANTISSA = 10
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Params:
    """Link when percent * union <= 100 * intersection. ``registers`` is a power of two; a band has
    ``rows`` registers. With 128 and 4 a pair just at 0.8 shares no band once in 20 million
    (sets of 4 and 5 elements: once in a million). ``margin``: standard errors below the threshold at
    which an estimate rules a pair out. Components take about as many rounds as their diameter has digits in
    base two; if they have not settled after ``last_rounds``, that is an error, not a result."""

    shingle: int = 5
    percent: int = 80
    registers: int = 128
    rows: int = 4
    margin: float = 6.0
    salts: int = 16
    last_rounds: int = 60


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, words between ASCII
    white space. Fewer than k words: the whole sequence as one; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    span = min(k, len(h))
    out = np.full(len(h) - span + 1, np.uint64(0x9E3779B97F4A7C15 + span))
    for j in range(span):
        out = _mix(out ^ h[j : len(h) - span + 1 + j]) * np.uint64(0x2545F4914F6CDD1D)
    return np.unique(_mix(out))


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """(leading zeros + 1) and mantissa of the smallest hash in each bucket; 0 for an empty one."""
    bits = m.bit_length() - 1
    out = np.zeros(m, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # hashes are sorted: the first is the least
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(16)  # 48 bits
    exponent = np.frexp(rest.astype(np.float64))[1]  # 0 for 0
    zeros = 48 - exponent
    tail = np.where(rest > 0, (rest << np.clip(zeros + 1, 0, 63).astype(np.uint64)) & np.uint64(0xFFFFFFFFFFFF), 0).astype(np.uint64)
    out[bucket[first]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | (tail >> np.uint64(48 - MANTISSA)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray, rows: int) -> list[int]:
    """One key for each band with a register in use."""
    with np.errstate(over="ignore"):
        bands = regs.reshape(-1, rows)
        keys = np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            keys = _mix(keys ^ bands[:, j].astype(np.uint64)) * np.uint64(0x2545F4914F6CDD1D)
        return keys[bands.any(axis=1)].view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketches a[i], b[i], corrected for registers that agree by accident, and
    the number of buckets in use. Two different minima agree in leading zeros about four times in
    ten, and in the mantissa once in 2 ** MANTISSA."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    by_chance = 0.4 / 2**MANTISSA
    return np.clip((same / np.maximum(used, 1) - by_chance) / (1 - by_chance), 0, 1), used


def may_link(a: np.ndarray, b: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    j, used = estimate(a, b)
    t = p.percent / 100
    return j, j >= t - p.margin * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1e-9


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and len(b) > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), digest of the set, registers."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("regs", T.BinaryType())])

    def rows():
        def step(cols):
            sets = [shingles(t, p.shingle) for t in cols[1]]
            return [cols[0], [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [registers(s, p.registers).tobytes() for s in sets]]

        return step

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), schema, rows)


def _bands(classes: DataFrame, p: Params) -> DataFrame:
    """key, rep, n for each band of each class."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType())])

    def rows():
        def step(cols):
            out: list[list] = [[], [], []]
            for rep, n, regs in zip(*cols):
                keys = band_keys(np.frombuffer(regs, np.uint16), p.rows)
                out[0] += keys
                out[1] += [rep] * len(keys)
                out[2] += [n] * len(keys)
            return out

        return step

    return arrow_map(classes.select("rep", "n", "regs"), schema, rows)


def _size_fits(a: str, b: str, p: Params):
    """The sizes alone allow the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * p.percent


def _overlap_fits(most, p: Params):
    """An intersection of at most ``most`` allows the threshold for sets of n_a and n_b elements."""
    return most * (100 + p.percent) >= (F.col("n_a") + F.col("n_b")) * p.percent


def _rarest(classes: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """rep, n, own (elements that no other of the classes has) and rare: the prefix of the others, rarest first,
    that a set at the threshold must share."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h", T.LongType())])

    def rows():
        def step(cols):
            sets = [shingles(t, p.shingle) for t in cols[1]]
            sizes = [len(s) for s in sets]
            return [np.repeat(np.array(cols[0], np.int64), sizes), np.repeat(np.array(sizes, np.int64), sizes), np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)]

        return step

    held = cut(arrow_map(texts.join(classes.select(F.col("rep").alias("id")), "id").select("id", "text"), schema, rows))
    often = cut(held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    shared = join_counted(held, often, ["h"], "c", held.count()).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("list"))
    own = F.col("n") - F.size("list")
    length = F.greatest(F.lit(0), F.floor((F.col("n") * (100 - p.percent)) / 100).cast("int") + 1 - own.cast("int"))
    return shared.select("rep", "n", own.alias("own"), F.transform(F.slice("list", F.lit(1), length), lambda x: x["h"]).alias("rare"))


def _estimated(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) that the sketches do not rule out, with the estimate."""
    regs = classes.select("rep", "regs")
    both = pairs.join(regs.toDF("a", "ra"), "a").join(regs.toDF("b", "rb"), "b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("est", T.DoubleType())])

    def rows():
        def step(cols):
            if not cols[0]:
                return [[], [], []]
            j, ok = may_link(*(np.frombuffer(b"".join(c), np.uint16).reshape(-1, p.registers) for c in cols[2:]), p)
            at = np.flatnonzero(ok)
            return [[cols[0][i] for i in at], [cols[1][i] for i in at], j[at].tolist()]

        return step

    return arrow_map(both.select("a", "b", "ra", "rb"), schema, rows)


def _verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) whose full sets link. Members b stream past their centre a; a centre with many
    members is dealt to several tasks."""
    salt = F.pmod(F.xxhash64("b"), F.lit(p.salts)).cast("int")
    members = pairs.select("a", salt.alias("salt"), F.col("b").alias("id"), F.lit(1).alias("kind"))
    centres = members.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("kind"))
    rows = members.union(centres).join(texts, "id").select("a", "salt", "kind", "id", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "id").select("a", "salt", "kind", "id", "text")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []  # a centre has several texts only if rows share its id
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, s, kind, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, s) != key:
                    key, centre = (a, s), []
                own = shingles(text, p.shingle)
                if kind == 0:
                    centre.append(own)
                elif any(linked(c, own, p.percent) for c in centre):
                    out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, schema).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): each node's smallest reachable node.

    Large-star and small-star steps, in turn, until every node but the smallest has one edge, to the
    smallest; every step is an aggregation and a join, and is written to the shared folder.
    """

    def state(e: DataFrame) -> tuple[int, int, int]:
        """How many nodes are unsettled, the most edges at a node, and the number of edges."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        row = ends.agg(F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)")), F.max(F.expr("up + down")), F.sum("up")).first()
        return row[0], row[1] or 0, row[2] or 0

    def with_least(rows: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
        """rows with m of u. Where a node may be in very many of them, its rows are joined apart."""
        if not hubs:
            return rows.join(least, "u")
        rows = cut(rows)
        return join_counted(rows, cut(least), ["u"], "c", rows.count())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        left, degree, n = state(e)
        if not left:
            break
        hubs = degree * 1000 > n and degree > 1000
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = with_least(both, least, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        joined = with_least(large, least, hubs)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
    else:
        raise RuntimeError(f"components do not settle in {most_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def near_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Empty texts, null texts and rows with a null id are linked with nothing
    (a null id has a null component and is kept). Rows that share an id are one
    document, linked through any of their texts. Ids are whole numbers of a long:
    they are cast, so a fraction is cut off and other text is an error. Long texts count whole; other
    columns are not read; an empty table gives an empty table.
    """
    marked = cut(sketch(docs, p, id_col, text_col))
    rows = marked.count()
    has_set = F.col("id").isNotNull() & (F.col("n") > 0)
    real = marked.where(has_set)
    # a class: the documents with one set, under the smallest id
    kept = cut(real.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"), F.count(F.lit(1)).alias("c")))

    # round 1: each class and one centre of each of its bands, the centre chosen by the band's own order
    bands = cut(_bands(kept, p))
    mask = F.col("key").bitwiseAND(F.lit((1 << 62) - 1))
    centres = bands.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(mask)).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    centres = cut(centres.select("key", F.col("m").bitwiseXOR(mask).alias("a"), "size"))
    met = cut(join_counted(bands, centres, ["key"], "size", bands.count()).drop("size"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = cut(texts.join(met.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    first = met.where("rep <> a").groupBy("a", F.col("rep").alias("b")).agg(F.first("n").alias("n"))
    sizes = kept.select(F.col("rep").alias("a"), F.col("n").alias("na"))
    first = first.join(sizes, "a").where(_size_fits("n", "na", p)).select("a", "b")
    likely = cut(_estimated(first, kept, p))
    packed = F.floor(F.col("est") * 1_000_000).cast("long")
    top = likely.groupBy("b").agg(F.max(packed).alias("top"))
    chosen = likely.join(top, "b").where(packed == F.col("top")).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    shared = real.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    same = real.join(shared, "id").select("id", "digest", "n").join(kept, ["digest", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = cut(_verified(chosen, texts, p).union(same))
    found = cut(components(links, p.last_rounds))

    # round 2: where they would join two components, the other candidates; and in bands that hold several
    # components the class with the fewest elements of its own with the others
    def crossing(pairs: DataFrame, found: DataFrame) -> DataFrame:
        named = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
        both = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
        return both.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        return cut(components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more), p.last_rounds))

    def mixed(table: DataFrame, key: str, found: DataFrame) -> DataFrame:
        """The rows of keys that hold several components, with comp."""
        near = cut(table.join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component"))
        keys = near.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select(key, "c")
        return join_counted(near, cut(keys), [key], "c", near.count()).drop("c")

    others = crossing(likely.select("a", "b").join(chosen, ["a", "b"], "left_anti"), found)
    near = cut(mixed(met.select("key", "rep"), "key", found))
    rare = cut(_rarest(near.select("rep").distinct(), texts, p))
    near = cut(near.join(rare.select("rep", "n", "own"), "rep"))
    fewest = near.groupBy("key").agg(F.min(F.struct("own", "rep", "n", "comp")).alias("c"), F.count(F.lit(1)).alias("size"))
    fewest = cut(fewest.select("key", "size", F.col("c.rep").alias("a"), F.col("c.n").alias("n_a"), F.col("c.own").alias("own_a"), F.col("c.comp").alias("comp_a")))
    star = join_counted(near.withColumnsRenamed({"n": "n_b", "own": "own_b"}), fewest, ["key"], "size", near.count()).where((F.col("comp") != F.col("comp_a")) & _size_fits("n_a", "n_b", p))
    star = star.where(_overlap_fits(F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b")), p))
    star = _estimated(star.select("a", F.col("rep").alias("b")).distinct(), kept, p).select("a", "b").join(likely.select("a", "b"), ["a", "b"], "left_anti")
    tried = cut(others.union(star))
    found = joined(found, cut(_verified(tried, texts, p)))

    # round 3: all that could still join two components
    near = rare.select("rep", "n", "own", F.posexplode("rare").alias("pos", "h")).select("rep", "n", "h", (F.col("n") - F.col("own") - F.col("pos")).alias("left"))
    weight = found.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("w"))
    near = cut(mixed(near, "h", found).join(weight, "comp", "left").withColumn("w", F.coalesce("w", F.lit(1))))
    # of each element: its heaviest component, whose sets need not be compared with each other, and its smallest set
    most = near.groupBy("h").agg(F.max(F.struct("w", "comp")).alias("top"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size"))
    most = cut(most.select("h", F.col("top.comp").alias("top"), "least", "size"))
    # what even the smallest admissible partner would not link goes before the join
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * p.percent / 100))
    n, hot = near.count(), most.where(F.col("size") > 1000)
    hot = [r[0] for r in hot.where(F.col("size") * 1000 > n).select(F.xxhash64("h")).collect()]  # fewer than a thousand
    near = join_counted(near, most, ["h"], "size", n).where(F.col("left") * (100 + p.percent) >= (F.col("n") + partner) * p.percent)
    near = near.drop("least", "size")
    a = near.where("comp <> top").select("h", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "left", "comp", "w")))
    b = near.select("h", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "left", "comp", "w")))
    lighter = (F.col("w_a") < F.col("w_b")) | ((F.col("w_a") == F.col("w_b")) & (F.col("comp_a") < F.col("comp_b")))
    rest = join_hot(a, b, ["h"], hot=(hot, hot)).where(lighter & _size_fits("n_a", "n_b", p) & _overlap_fits(F.least("left_a", "left_b"), p))
    rest = _estimated(rest.select(F.col("rep_b").alias("a"), F.col("rep_a").alias("b")).distinct(), kept, p).select("a", "b")
    rest = cut(rest.join(likely.select("a", "b").union(tried), ["a", "b"], "left_anti"))
    found = joined(found, cut(_verified(rest, texts, p)))

    named = kept.select("digest", "n", "rep", "c").join(found, F.col("rep") == F.col("node"), "left").select("digest", "n", "c", F.coalesce("component", "rep").alias("component_id"))
    linked_rows = join_counted(real.select("id", "digest", "n"), cut(named), ["digest", "n"], "c", rows).select("id", "n", "component_id")
    out = linked_rows.union(marked.where(~has_set).select("id", "n", F.col("id").alias("component_id")))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
