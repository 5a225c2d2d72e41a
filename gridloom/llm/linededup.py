"""Line deduplication with an edit bound, in DataFrame operations alone.

Lines are compared by their words (what single spaces separate, after
trimming blanks). A line is dropped when an earlier line, by (document id,
place), is equal or, if both have ``min_words`` words, differs by one word
added, removed or replaced. Blank lines always stay. The bound counts words: a
word in which one character differs is another word.

The deletion neighbourhood: a line within the bound of another shares with it
a variant, the line with one word deleted (or the shorter line itself).
Variants are hashed as the exclusive-or of hash(word, place), joined where
equal, and the edit distance is verified on the words. Groups of equal
variants are reduced to their earliest line before they are joined, so no
group is expanded into pairs. Only lines that can have a neighbour emit
variants: of two lines within the bound, one half (its words counted from the
start or from the end) is the same in both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_counted, join_hot

BLANKS = " \t\r"
PLACES = 1 << 31


@dataclass(frozen=True)
class Params:
    """Lines of fewer than ``min_words`` words are dropped only for an equal one: one word of five is a fifth of
    the line, and list items, headings and captions that differ in a word are not repetitions. With 1 the bound
    holds for lines of every length, exactly."""

    min_words: int = 6


def _place(doc: Column, pos: Column) -> Column:
    """(document, line number) as one number that sorts alike; null ids come first."""
    return (F.coalesce(doc.cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(PLACES).cast("decimal(11,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once: inside a lambda it would be evaluated for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _half(line: Column, side: int, q: Column) -> Column:
    return F.xxhash64(F.lit(side), q, F.call_function("substring_index", line, F.lit(" "), q if side == 0 else -q))


def _lines(docs: DataFrame, p: Params) -> DataFrame:
    """doc, mark, pos, at, h1, h2 and the four half keys of each line that is not blank."""
    split = docs.select("doc", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    line = F.btrim(F.col("raw"), F.lit(BLANKS))
    words = split.select("doc", "mark", "pos", line.alias("line")).where("line <> ''")
    words = words.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    long = F.col("n") >= p.min_words
    even = long & (F.col("n") % 2 == 0)
    q, r = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    line = F.col("line")
    keys = [F.when(long, _half(line, 0, q)), F.when(long, _half(line, 1, q)), F.when(even, _half(line, 0, r)), F.when(even, _half(line, 1, r))]
    return words.select("doc", "mark", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))


def _hashed(lines: DataFrame) -> DataFrame:
    """lines with n, and v: the hash of the whole line, the exclusive-or of hash(word, place)."""
    xor = lambda x, y: x.bitwiseXOR(y)
    zero = F.lit(0).cast("long")
    each = F.transform("words", lambda w, k: F.xxhash64(w, k))
    return lines.select("h1", "h2", "f", "words", F.size("words").alias("n"), each.alias("a"), F.aggregate(each, zero, xor).alias("v"))


def _variants(hashed: DataFrame) -> DataFrame:
    """h1, h2, f and (v, m, i): the hash of the line without word i, its number of words m."""
    xor = lambda x, y: x.bitwiseXOR(y)
    zero = F.lit(0).cast("long")
    table = hashed.withColumn("b", F.transform("words", lambda w, k: F.xxhash64(w, k - 1)))
    table = table.withColumn("all_b", F.aggregate("b", zero, xor))
    # a variant: the words before i at their places, those after i one place earlier
    start = F.struct(zero.alias("x"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, ab: F.struct(s["x"].bitwiseXOR(ab["a"]).bitwiseXOR(ab["b"]).alias("x"), F.array_append(s["out"], s["x"].bitwiseXOR(ab["b"])).alias("out"))
    ran = F.aggregate(F.zip_with("a", "b", lambda x, y: F.struct(x.alias("a"), y.alias("b"))), start, step, lambda s: s["out"])
    table = table.select("h1", "h2", "f", (F.col("n") - 1).alias("m"), "all_b", F.posexplode(ran).alias("i", "x"))
    return table.select("h1", "h2", "f", F.col("x").bitwiseXOR(F.col("all_b")).alias("v"), "m", "i")


def _within_one(a: Column, b: Column, i: Column) -> Column:
    """a and b differ by at most one word: replaced, or word i of the longer one deleted."""
    without = lambda x: F.concat(F.slice(x, F.lit(1), i), F.slice(x, i + 2, F.size(x)))
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.size(a) > F.size(b), without(a) == b).otherwise(without(b) == a)


def _earlier_neighbours(lines: DataFrame) -> DataFrame:
    """h1, h2, e: for each line with an earlier one within the bound, the earliest.
    lines: h1, h2, f (its first place), words."""
    hashed = _hashed(lines)
    variants = _variants(hashed)
    whole = hashed.select("v", F.col("n").alias("m"), F.col("f").alias("whole"))
    groups = variants.groupBy("v", "m", "i").agg(F.min("f").alias("e"), F.count(F.lit(1)).alias("c"))
    groups = cut(groups.join(whole, ["v", "m"], "left").where("c > 1 OR whole IS NOT NULL"))
    # neighbours: of a line the earliest with another word i, the line without word i, and of that the longer ones
    total = hashed.agg(F.sum("n")).first()[0] or 0  # variants
    near = join_counted(variants, groups, ["v", "m", "i"], "c", total).select("h1", "h2", "f", F.explode(F.array("e", "whole")).alias("e"), F.col("i").alias("gone"))
    longer = groups.where("whole IS NOT NULL").groupBy("v", "m").agg(F.min("e").alias("e"))
    longer = groups.join(longer, ["v", "m", "e"]).groupBy("v", "m", "e").agg(F.min("i").alias("gone"))
    longer = hashed.withColumnRenamed("n", "m").join(longer, ["v", "m"]).select("h1", "h2", "f", "e", "gone")
    pairs = cut(near.union(longer).where("e < f").distinct())
    mine = lines.select("f", F.col("words").alias("a"))
    other = lines.select(F.col("f").alias("e"), F.col("words").alias("b"))
    checked = join_hot(pairs, other, ["e"]).join(mine, "f").where(_within_one(F.col("a"), F.col("b"), F.col("gone")))
    return checked.groupBy("h1", "h2").agg(F.min("e").alias("e"))


def dedup_lines(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with its text column cut down to the lines that stay, and the ``counts`` of its lines and of those dropped (longs).

    Null texts stay null (0 lines); an empty text is one blank line. A null id
    counts as the smallest. Rows that share an id share its places: of lines
    at one place neither is earlier. Ids are whole numbers. Long texts are read whole. Other columns
    pass through, except those named like the counts, which are replaced; an
    empty table gives an empty table.
    """
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    lines = cut(_lines(keyed.where("text IS NOT NULL"), p))
    at = _place(F.col("doc"), F.col("pos"))
    firsts = lines.groupBy("h1", "h2").agg(F.min(at).alias("f"), F.min_by("doc", at).alias("doc"), F.min_by("pos", at).alias("pos"), F.min_by("mark", at).alias("mark"), F.count(F.lit(1)).alias("c"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
    firsts = cut(firsts)

    halves = firsts.select("h1", "f", "doc", "mark", "pos", F.explode(F.array(*(f"k{i}" for i in range(4)))).alias("k")).where("k IS NOT NULL")
    shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    close = halves.join(shared, "k", "left_semi").groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "h1", "f")).alias("spots"))
    line = lambda x: F.btrim(x, F.lit(BLANKS))
    spot = lambda all_: lambda s: F.struct(F.xxhash64(line(F.get(all_, s["pos"]))).alias("own"), s["h1"].alias("h1"), F.hash(line(F.get(all_, s["pos"]))).alias("h2"), s["f"].alias("f"), F.split(line(F.get(all_, s["pos"])), " ", -1).alias("words"))
    close = close.withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    texts = keyed.join(close, (keyed["mark"] == F.col("_mark")) & keyed["doc"].eqNullSafe(F.col("_doc")))
    chosen = texts.select(F.inline(_let(F.split("text", "\n", -1), lambda all_: F.transform("spots", spot(all_)))))
    # one of equal rows
    chosen = cut(chosen.where("own = h1").select("h1", "h2", "f", "words").dropDuplicates(["h1", "h2"]))

    early = _earlier_neighbours(chosen)
    limits = firsts.select("h1", "h2", "f", "c").join(early, ["h1", "h2"], "left").where("c > 1 OR e IS NOT NULL")
    limits = cut(limits.select("h1", "h2", "c", F.least("f", "e").alias("first")))
    places = lines.select("doc", "mark", "pos", "h1", "h2")
    dropped = join_counted(places, limits, ["h1", "h2"], "c", lines.count()).where(at > F.col("first"))
    dropped = dropped.groupBy(F.col("doc").alias("_dedup_doc"), F.col("mark").alias("_dedup_gone_mark")).agg(F.collect_set("pos").alias("_dedup_gone"))

    names = [c for c in docs.columns if c not in counts]
    marked = docs.select(*names, F.xxhash64(text_col).alias("_dedup_mark"))
    joined = marked.join(dropped, marked[id_col].eqNullSafe(dropped["_dedup_doc"]) & (marked["_dedup_mark"] == dropped["_dedup_gone_mark"]), "left")
    places = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_dedup_gone"))
    stay = _let(F.split(text_col, "\n", -1), lambda all_: F.array_join(F.transform(places(all_), lambda i: F.get(all_, i)), "\n"))
    return joined.select(
        *(F.when(F.col("_dedup_gone").isNull(), F.col(c)).otherwise(stay).alias(c) if c == text_col else F.col(c) for c in names),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(counts[0]),
        F.when(F.col("_dedup_gone").isNull(), 0).otherwise(F.size("_dedup_gone")).cast("long").alias(counts[1]),
    )
