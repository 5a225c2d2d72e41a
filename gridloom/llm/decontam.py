"""Benchmark decontamination by templates.

Texts become sequences of canonical words: numbers, names (runs of capitalised
words) and units (after a number) turn into typed placeholders, everything else
into its lower-case letters. Windows of
canonical words are hashed; windows of documents are joined with windows of
benchmark items. Matches of one document and item that lie on one diagonal,
or on neighbouring ones (words were put in or left out), are one alignment.
Its slots must be consistent: a value of the item always stands for the same
value of the document; or the windows whose values are the item's own must do
alone. So a question with other numbers or names is found, and a text that
only shares its layout is not. Short items have shorter windows besides, and
items without any window are looked for word for word, values included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import arrow_map, cut, join_hot

#: Units of measure, which are units right after a number alone.
UNITS = """% mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards g kg mg lb lbs oz gram grams kilogram kilograms
pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years mph kmh hz khz mhz ghz w kw mw v kv a kwh j kj cal kcal usd eur gbp dollar dollars cent cents euro euros $ € £ kb mb gb tb °c °f""".split()
NUMBER_UNIT = re.compile(r"([$€£]?)([+-]?\d+(?:[.,:/]\d+)*)([^\W\d]{0,4}|%|°[cCfF])")
WORD, NUM, NAME, UNIT = 0, 1, 2, 3
#: Words of the exact comparison: characters of scripts without spaces one by one, numbers, other words, signs of arithmetic and units.
UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
EXACT = re.compile(rf"[{UNSPACED}]|\d+(?:[.,]\d+)*|(?:(?![{UNSPACED}\d])\w)+|[-+*/=<>^%×÷±≤≥≠√∑$€£°]")
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w%$€£]+$")


@dataclass(frozen=True)
class Params:
    """A document is contaminated by an item if an alignment covers ``cover`` of the item's windows of
    ``window`` words (an item that is shorter is one window, if it has ``least_words`` words). A window
    needs ``least_plain`` words that are no placeholders. An item without a window is compared whole and
    exactly. Diagonals up to ``drift`` apart are one alignment. An item of ``window`` to 2.5 * ``window`` - 1
    words also has windows of ``short`` of its words, which must cover as many of its words as one changed
    word leaves at worst, with the item's own values or on ``window`` words at least. ``map_bits``: size of
    the bit map that leaves out windows which no item has; it never loses one."""

    window: int = 8
    least_words: int = 5
    least_plain: int = 4
    cover: float = 0.3
    map_bits: int = 24
    drift: int = 4
    short: float = 0.4

    def short_size(self, words: int) -> int:
        """The size of an item's shorter windows; 0: it has none."""
        size = int(words * self.short)
        return size if words >= self.window and 2 < size < self.window else 0

    def plain_of(self, size: int) -> int:
        """How many plain words a shorter window needs: half of it."""
        return min(self.least_plain, (size + 1) // 2)


def core_of(token: str) -> str:
    """The token without the punctuation round it."""
    if token.isalpha():
        return token
    return token[:-1] if token[:-1].isalpha() and token[-1] in ".,;:!?" else EDGE.sub("", token)


def classify(token: str, after_number: bool = False) -> tuple[str, int, str]:
    """(canonical word, kind, value) of a token, by its shape. Capitalised words are names wherever they stand, so
    the first word of a sentence is one; its value then has to be consistent like that of any other name."""
    core = core_of(token)
    if not core:
        return "", WORD, ""
    low = core.lower()
    if after_number and low in _UNITS:
        return "<unit>", UNIT, low
    m = None if core.isalpha() else NUMBER_UNIT.fullmatch(core)
    if m:
        return "<num>", NUM, f"{m[1]}{m[2]}{m[3].lower()}"
    if core[:1].isupper() and core[1:].islower() and core.isalpha():
        return "<name>", NAME, core
    return low, WORD, ""


_UNITS = frozenset(UNITS)
MULT = np.uint64(0x9E3779B97F4A7C15)


def _digest(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


UNIT_HASH = np.uint64(_digest("<unit>"))


@dataclass
class Text:
    """The canonical words of a text: hashes, kinds, and the the tokens of word i, tokens[at[i]:at[i + 1]]."""

    h: np.ndarray
    k: np.ndarray
    at: np.ndarray
    tokens: list[str]
    codes: np.ndarray

    def value(self, i: int) -> str:
        """Kind and value of the slot at word i."""
        kind, tokens = int(self.k[i]), self.tokens[self.at[i] : self.at[i + 1]]
        said = " ".join(filter(None, map(core_of, tokens))) if kind == NAME else classify(tokens[0], kind == UNIT)[2]
        return f"{kind}={said}"

    def slots(self, at: int, size: int) -> list[str]:
        """The slots of a window, in order."""
        return [self.value(i) for i in range(at, at + size) if self.k[i] != WORD]


class Canon:
    """Canonical words of tokens, numbered as they come; at most ``most`` tokens are remembered."""

    def __init__(self, most: int = 600_000, exactly: bool = False):
        self.exactly = exactly
        # by code: the exact word's hash (0: none), whether the token holds several
        self.whole, self.several = np.zeros(most if exactly else 0, np.uint64), np.zeros(most if exactly else 0, bool)
        self.codes: dict[str, int] = {}
        self.most = most
        # by code: hash and kind (-1: no word), whether it is a unit after a number, whether a phrase goes on after it
        self.hash, self.kind = np.zeros(most, np.uint64), np.zeros(most, np.int8)
        self.unit, self.open = np.zeros(most, bool), np.zeros(most, bool)

    def add(self, token: str) -> int:
        code = len(self.codes)
        word, kind, _ = classify(token)
        self.hash[code], self.kind[code] = (_digest(word), kind) if word else (0, -1)
        self.unit[code] = classify(token, True)[1] == UNIT
        self.open[code] = token[-1].isalnum()
        if self.exactly:
            found = exact_words(token)
            self.whole[code], self.several[code] = found[0] if found else 0, len(found) > 1
        self.codes[token] = code
        return code

    def exact(self, text: Text) -> np.ndarray:
        """Hashes of the exact words of a text."""
        if not len(self.whole) or len(text.tokens) > self.most or self.several[text.codes].any():
            return np.array([x for t in text.tokens for x in exact_words(t)], np.uint64)
        out = self.whole[text.codes]
        return out[out != 0]

    def of(self, text: str | None) -> Text:
        tokens = (text or "").split()
        if not tokens:
            return Text(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(1, np.int64), [], np.zeros(0, np.int64))
        if len(self.codes) + len(tokens) > self.most:
            self.codes.clear()
        if len(tokens) > self.most:  # one text with more tokens than are remembered
            return Canon(len(tokens), self.exactly).of(text)
        get, add = self.codes.get, self.add
        codes = np.array([c if (c := get(t)) is not None else add(t) for t in tokens], np.int64)
        k = self.kind[codes]
        at = np.flatnonzero(k >= 0)
        mine, k = codes[at], k[at]
        h, go = self.hash[mine], self.open[mine[:-1]]
        unit = self.unit[mine[1:]] & (k[:-1] == NUM) & ~self._ends(tokens, at, k)
        if unit.any():
            spot = np.flatnonzero(unit) + 1
            h[spot], k[spot] = UNIT_HASH, UNIT
        run = np.flatnonzero((k[1:] == NAME) & (k[:-1] == NAME) & go) + 1  # the later words of a name
        if len(run):
            h, k, at = (np.delete(x, run) for x in (h, k, at))
        return Text(h, k, np.append(at, len(tokens)), tokens, codes)

    @staticmethod
    def _ends(tokens: list[str], at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which of the numbers (but the last word) end a sentence."""
        out = np.zeros(max(0, len(at) - 1), bool)
        for i in np.flatnonzero(k[:-1] == NUM).tolist():
            out[i] = tokens[at[i]][-1] in ".!?:;,"
        return out


def windows(h: np.ndarray, k: np.ndarray, size: int, least_plain: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, and which of them have enough plain words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, np.uint64(size))
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ h[j : j + n]) * MULT
            out ^= out >> np.uint64(29)
    plain = np.concatenate([[0], np.cumsum(k == WORD)])
    return out, plain[size:] - plain[:n] >= min(least_plain, size)


def exact_words(token: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) | 1 for w in EXACT.findall(token.lower())]


def exact_windows(e: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` exact words, from sums of powers: the time does not depend on the size."""
    n = len(e) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(e) - 1, MULT)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(MULT), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(e * up, dtype=np.uint64)])
        out = (sums[size:] - sums[:n]) * down
        out = (out ^ (out >> np.uint64(32)) ^ np.uint64(size)) * MULT
        return out ^ (out >> np.uint64(29))


WINDOW = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("short", T.BooleanType()), T.StructField("size", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType()))])


def _windows_of(table: DataFrame, sizes: tuple[int, ...], p: Params, only: bytes | None) -> DataFrame:
    """The windows of (id, text) rows; only: the bit map, else items' windows (the whole item if it is short).
    n: how many windows of its kind an item of so many ``words`` has. Sizes of exact windows are negative."""
    box = table.sparkSession.sparkContext.broadcast(only)  # 2 ** map_bits bits at most
    lengths = [-size for size in sizes if size < 0]

    def rows():
        canon = Canon(exactly=only is None or bool(lengths))
        bits = np.frombuffer(box.value, np.uint8) if only is not None else None

        def known(w: np.ndarray) -> np.ndarray:
            spot = w & np.uint64((1 << p.map_bits) - 1)
            return ((bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

        def of_document(text):
            said = canon.of(text)
            for size in sizes:
                if size > 0:
                    w, ok = windows(said.h, said.k, size, p.plain_of(size))
                    for i in np.flatnonzero(ok & known(w)).tolist():
                        yield 0, 0, False, size, i, w[i], said.slots(i, size)
            e = canon.exact(said) if lengths else None
            for size in lengths:
                w = exact_windows(e, size)
                at = np.flatnonzero(known(w))
                for i in at[np.unique(w[at], return_index=True)[1]].tolist():  # once is enough
                    yield 0, 0, False, -size, i, w[i], []

        def of_item(text):
            said = canon.of(text)
            n, found, views, e = len(said.h), False, [said], canon.exact(said)
            if n and said.k[0] == NAME:  # a document may quote the item inside a sentence
                first = said.tokens[0]
                views.append(canon.of(" ".join([first.lower(), *said.tokens[1 : 2 * p.window + 1]])))
            for short, size in ((False, p.window if n >= p.window else n if n >= p.least_words else 0), (True, p.short_size(n))):
                if not size:
                    continue
                out, total = [], 0
                for v, view in enumerate(views):
                    w, ok = windows(view.h, view.k, size, p.plain_of(size) if short else p.least_plain)
                    hits = [i for i in np.flatnonzero(ok).tolist() if not v or i < 2]  # the other view: windows with the first word
                    total = max(total, len(hits))
                    out += [(size, i, w[i], view.slots(i, size)) for i in hits]
                found = found or bool(out and not short)
                for x in out:
                    yield total, n, short, *x
            if len(e) and not found:
                yield 1, len(e), False, -len(e), 0, exact_windows(e, len(e))[0], []

        def step(cols):
            out: list[list] = [[] for _ in WINDOW]
            for ident, text in zip(*cols):
                for n, words, short, size, i, w, values in (of_item if only is None else of_document)(text):
                    for col, v in zip(out, (ident, n, words, short, size, i, int(w.view(np.int64)), values)):
                        col.append(v)
            return out

        return step

    return arrow_map(table, WINDOW, rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item with an alignment that covers enough of the item:
    doc_id, item_id, matched, item_windows, coverage, changed (slots whose value differs).

    Null texts and texts without words match nothing; rows with a null id take no part. Items that are
    compared exactly have one window.
    Ids are whole numbers of a long: they are cast. Rows that share an id are one document (or item), whose best alignment
    counts. Long texts are read whole; other columns are not read; an empty
    table on either side gives an empty table.
    """
    items = cut(_windows_of(benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL"), (), p, None))
    sizes = tuple(sorted(r[0] for r in items.select("size").distinct().collect()))  # at most window numbers and the lengths of items without a window
    spot = F.col("hash").bitwiseAND(F.lit((1 << p.map_bits) - 1))
    words = items.select(F.shiftright(spot, 5).alias("w"), F.expr("shiftleft(1L, int(hash & 31))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    bits = np.zeros(1 << (p.map_bits - 5), np.uint32)
    found = words.toPandas()  # as many rows as the map has words, at most
    bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).astype(np.uint32)
    there = cut(_windows_of(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL"), sizes, p, bits.tobytes()))
    a = there.select(F.col("id").alias("doc_id"), F.col("pos").alias("dp"), "hash", "size", F.col("slots").alias("ds"))
    b = items.select(F.col("id").alias("item_id"), F.col("pos").alias("ip"), F.col("n").alias("item_windows"), "words", "short", "hash", "size", F.col("slots").alias("bs"))
    met = join_hot(a, b, ["hash", "size"]).where(F.size("ds") == F.size("bs"))
    pair = ["doc_id", "item_id", "short"]
    met = met.select(*pair, (F.col("dp") - F.col("ip")).alias("diagonal"), "ip", "item_windows", "words", "size", (F.col("bs") == F.col("ds")).alias("own"), F.zip_with("bs", "ds", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("pairs"))
    met = cut(met)
    # neighbouring diagonals: a second alignment, besides those of the diagonals alone
    along = Window.partitionBy(*pair).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > p.drift).cast("int"), F.lit(0))
    near = met.select(*pair, "diagonal").distinct().withColumn("_apart", apart).withColumn("run", F.sum("_apart").over(along))
    near = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*pair, "run"))).where(F.col("_n") > 1).select(*pair, "diagonal", "run")
    met = met.withColumn("run", F.lit(None).cast("long")).unionByName(met.join(near, [*pair, "diagonal"]).withColumn("diagonal", F.lit(0)))
    met = met.withColumn("run", F.coalesce("run", F.lit(-1)))
    on = [*pair, "run", "diagonal"]
    spots = F.when(F.col("short"), F.sequence(F.col("ip"), F.col("ip") + F.col("size") - 1))
    count = lambda x: F.size(F.collect_set(x))
    words = lambda x: F.size(F.array_distinct(F.flatten(F.collect_set(x))))
    runs = met.groupBy(*on).agg(
        count(F.col("ip")).alias("all"), count(F.when(F.col("own"), F.col("ip"))).alias("same"), words(spots).alias("all_words"), words(F.when(F.col("own"), spots)).alias("same_words"),
        F.max("item_windows").alias("item_windows"), F.max("words").alias("words"), F.max("size").alias("size"),
    )
    pairs = met.select(*on, F.explode("pairs").alias("p")).select(*on, "p.x", "p.y").distinct()
    slots = pairs.groupBy(*on, "x").agg(F.count(F.lit(1)).alias("c"), F.max((F.col("x") != F.col("y")).cast("int")).alias("d"))
    slots = slots.groupBy(*on).agg(F.max("c").alias("c"), F.sum("d").cast("long").alias("changed"))
    left = F.col("words") - F.col("size")  # as many words as one changed word leaves at worst
    enough = lambda n, ws, least: F.when(F.col("short"), (F.col(ws) >= left) & (F.col(ws) >= least)).otherwise(F.col(n) >= F.col("item_windows") * p.cover)
    fits = (F.coalesce("c", F.lit(1)) == 1) & enough("all", "all_words", p.window)
    good = runs.join(slots, on, "left").withColumn("fits", fits).where(F.col("fits") | enough("same", "same_words", 0))
    good = good.withColumn("matched", F.when(F.col("fits"), F.col("all")).otherwise(F.col("same"))).withColumn("changed", F.coalesce("changed", F.lit(0)))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct((~F.col("short")).alias("long"), "matched", (-F.col("changed")).alias("unchanged"), "item_windows")).alias("m"))
    return best.select(
        "doc_id", "item_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.item_windows").cast("long").alias("item_windows"),
        (F.col("m.matched") / F.col("m.item_windows")).alias("coverage"), (-F.col("m.unchanged")).alias("changed"),
    )
