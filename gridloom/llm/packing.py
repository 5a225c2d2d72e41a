"""Packing token sequences by exact complements, then best fit.

Documents are tokenized once; what remains of them is a table of pieces. The
number of pieces of each length (at most ``capacity`` numbers) is all the
driver sees. It plans on those counts: the sums of one, two and three lengths
are indexed in a hash from sum to combinations; the longest piece leaves a gap,
the index names what fills it exactly, and a combination is used up as often as
its lengths are available. What has no such complement is placed by best fit,
longest first. The plan says which ranks of a length go where, and each piece
looks its rank up.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import arrow_map, cut, struct_of


@dataclass(frozen=True)
class Params:
    """tokenizer: a file of the tokenizers library. ``memory``: how many distinct words a Python worker
    remembers the ids of; it only saves time."""

    capacity: int = 2048
    end_id: int = 0
    tokenizer: str | None = None
    memory: int = 600_000


def public_params(capacity: int = 2048) -> Params:
    import public_tokenizers

    return Params(capacity, 0, public_tokenizers.path("byte_bpe_50k.json"))


#: The characters up to here are told apart alike by all versions of Unicode's tables.
LAST = 0x24F
SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}


def _characters(wanted: Callable[[int], bool]) -> str:
    return "".join(re.escape(chr(c)) for c in range(LAST + 1) if wanted(c))


@lru_cache(1)
def _words() -> re.Pattern:
    """How a byte-level tokenizer splits a text of Latin letters before the merges; words are merged one by one."""
    letters, digits = (_characters(lambda c, k=k: unicodedata.category(chr(c))[0] == k) for k in "LN")
    spaces = _characters(SPACES.__contains__)
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Words(dict):
    """Little-endian 32-bit ids of words, from the tokenizer's own merges."""

    def __init__(self, tokenizer, most: int):
        self.merge, self.most = tokenizer.model.tokenize, most
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: "".join(x for x, _ in split(chr(c))) for c in range(LAST + 1)}

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.merge(word.translate(self.bytes_of))], "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(2)
def encoder(params: Params) -> Callable[[str], bytes]:
    """The little-endian 32-bit ids of a text, as the tokenizer's ``encode(text, add_special_tokens=False)`` gives them.

    Texts that a byte-level tokenizer splits into words alike in every version of Unicode, and that hold no added
    token, are split here and their distinct words merged once; all others are encoded whole.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(params.tokenizer)
    with open(params.tokenizer, encoding="utf-8") as f:
        said = json.load(f)
    before = said.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not (plain and said.get("normalizer") is None and said["model"].get("type") == "BPE"):
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    other = re.compile("|".join([rf"[^\x00-{chr(LAST)}]", *(re.escape(x["content"]) for x in said.get("added_tokens", []))]))
    ids, split = Words(whole, params.memory).__getitem__, _words().findall

    def encode(text: str) -> bytes:
        if other.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(ids, split(text)))

    return encode


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only longer ones are cut, the first piece may be shorter."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def pieces_of(docs: DataFrame, params: Params, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, piece, start, length and ids_crc32 of each piece of each row.

    A null or empty text is one piece, the end id alone; long texts are encoded whole; repeated rows are cut alike;
    other columns are not read; an empty table stays empty.
    """
    schema = T.StructType([*struct_of(docs, *keep), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def rows():
        encode, end = encoder(params), np.array([params.end_id], "<u4").tobytes()

        def step(cols):
            out: list[list] = [[] for _ in schema]
            kept = list(zip(*cols[:-1]))
            for i, text in enumerate(cols[-1]):
                raw = encode(text or "") + end
                start = 0
                for piece, n in enumerate(cut_lengths(len(raw) // 4, params.capacity)):
                    for col, v in zip(out, (*kept[i], piece, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]))):
                        col.append(v)
                    start += n
            return out

        return step

    return arrow_map(docs.select(*keep, F.col(text_col).alias("_text")), schema, rows)


class Sums:
    """An index of the sums of one, two and three of the available lengths.

    ``pairs`` and ``triples`` lead from a sum to the longest member of each combination, longest first; the
    rest of a combination is the smaller sum that the index holds for what is left. Lengths are only ever
    used up, so a combination that is no longer available is left behind for good: ``at`` says how far.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        most = len(counts)
        there = np.flatnonzero(counts > 0)
        pair = np.zeros((most, most), bool)  # [sum, its longest member]
        for a in there:
            low = there[(there <= a) & (there + a < most)]
            pair[low + a, a] = True
        triple = np.zeros((most, most), bool)
        sums = np.flatnonzero(pair.any(1))
        shortest_lead = np.where(pair.any(1), pair.argmax(1), most)  # the longest member of a sum's most even pair
        for a in there:
            rest = sums[(sums + a < most) & (shortest_lead[sums] <= a)]
            triple[rest + a, a] = True
        self.pairs = {int(s): np.flatnonzero(pair[s])[::-1].tolist() for s in sums}
        self.triples = {int(s): np.flatnonzero(triple[s])[::-1].tolist() for s in np.flatnonzero(triple.any(1))}
        self.at = {2: dict.fromkeys(self.pairs, 0), 3: dict.fromkeys(self.triples, 0)}

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if 0 < total < len(self.counts) and self.counts[total] > 0 else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The most unequal pair: it uses up a long piece."""
        leads, at = self.pairs.get(total, ()), self.at[2].get(total, 0)
        while at < len(leads):
            a, b = leads[at], total - leads[at]
            if self.counts[a] > 0 and self.counts[b] > (a == b):
                break
            at += 1
        if leads:
            self.at[2][total] = at
        return (leads[at], total - leads[at]) if at < len(leads) else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        leads, at = self.triples.get(total, ()), self.at[3].get(total, 0)
        found = None
        while at < len(leads) and found is None:
            a = leads[at]
            if self.counts[a] > 0:
                found = self._with(a, total - a)
            at += found is None
        if leads:
            self.at[3][total] = at
        return found

    def _with(self, a: int, rest: int) -> tuple[int, ...] | None:
        """a and a pair of sum ``rest`` that is available beside it."""
        for b in self.pairs.get(rest, ())[self.at[2].get(rest, 0) :]:
            c = rest - b
            if self.counts[b] > (b == a) + (b == c) and self.counts[c] > (c == a) + (b == c):
                return a, b, c
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to the gap."""
        return () if gap <= 0 else self.single(gap) or self.pair(gap) or self.triple(gap)

    def take(self, longest: int) -> tuple[tuple[int, ...], int] | None:
        """A combination with ``longest`` that fills a sequence exactly, and how often it is available; it is
        used up. A length that has none never has one later: what could be beside it is only used up."""
        self.counts[longest] -= 1
        rest = self.fill(len(self.counts) - 1 - longest)
        self.counts[longest] += 1
        if rest is None:
            return None
        pattern = (longest, *rest)
        times = min(int(self.counts[n]) // pattern.count(n) for n in set(pattern))
        for n in set(pattern):
            self.counts[n] -= times * pattern.count(n)
        return pattern, times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), for all pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    index = Sums(left)
    for longest in range(capacity, 0, -1):
        while left[longest] > 0 and (found := index.take(longest)):
            out.append(found)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            gap = next((g for g in range(n, capacity) if open_.get(g)), None)
            if gap is None:
                each = capacity // n
                if todo >= each:
                    pattern, times = (n,) * each, todo // each
                else:
                    pattern, times = (n,) * todo, 1
                todo -= len(pattern) * times
                open_.setdefault(capacity - n * len(pattern), []).append((pattern, times))
                continue
            pattern, times = open_[gap].pop()
            used = min(times, todo)
            if times > used:
                open_[gap].append((pattern, times - used))
            open_.setdefault(gap - n, []).append(((*pattern, n), used))
            todo -= used
    return out + [x for held in open_.values() for x in held]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, from which rank on pieces go to which sequences, at which offset."""
    given: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            at = given.get(n, 0)
            rows.append((n, at, first, offset))
            given[n] = at + times
            offset += n
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, params: Params, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each piece of each row: ``keep`` columns, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows are packed one by one, so
    repeated rows (and null ids) are packed as often as they stand there.
    Long texts are cut into pieces, nothing is dropped; other columns are not
    read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, params, text_col, keep))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    box = spark.sparkContext.broadcast(slots(plan(counts, params.capacity)))
    # ranks within a length, which may hold a third of all rows: counted by salt, numbered within it
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*keep, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    each = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "salt").orderBy(*keep, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(inner) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select(*keep, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))
    schema = T.StructType([*[f for f in ranked.schema if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def rows():
        held = box.value

        def step(cols):
            length, rank = np.array(cols[len(keep) + 2], np.int64), np.array(cols[-1], np.int64)
            i = np.searchsorted(held["key"], (length << 44) + rank, side="right") - 1
            return [*cols[:-1], (held["sequence"][i] + rank - held["rank"][i]).tolist(), held["offset"][i].tolist()]

        return step

    return arrow_map(ranked, schema, rows)

