"""Secret scanning through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain. Texts are indexed in segments (one Arrow batch
each): the index keeps a posting set for every trigram that some rule asks
for, the queries intersect and unite postings, and only the candidates are
matched with the expression. A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as P

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import arrow_map, struct_of

#: A query: None (all texts), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))

    def __reduce__(self):
        return Rule, (self.kind, self.pattern, self.group, self.least)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches; those that are too short are dropped afterwards."""
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The three rules of the contract, in its order. The least lengths of the last two
#: stand in their expressions too: runs that are too short then need not be looked at one by one.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"(?<![a-z0-9+.-])(?=[0-9+.-]*[a-z])[a-z0-9+.-]*+://[^\s:/@]*:[^\s:/@]+@"),
)


def _join(kind: str, parts: list) -> Query:
    if kind == "or" and (not parts or any(p is None for p in parts)):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


MOST = 64  # of the strings a part of an expression can stand for


def _strings(tokens) -> list[str] | None:
    """All (lower-case) strings that the tokens can match, if they are few."""
    out = [""]
    for op, arg in tokens:
        if op is C.LITERAL:
            more = [chr(arg).lower()]
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            more = sorted({chr(v).lower() for _, v in arg})
        elif op is C.SUBPATTERN:
            more = _strings(arg[3])
        elif op is C.BRANCH:
            found = [_strings(b) for b in arg[1]]
            more = None if any(f is None for f in found) else sorted({s for f in found for s in f})
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
            base = _strings(arg[2])
            powers = [] if base is None else [_powers(base, n) for n in range(arg[0], arg[1] + 1)]
            more = None if base is None or None in powers else sorted(set().union(*powers))
        else:
            more = None
        if more is None or len(out) * len(more) > MOST:
            return None
        out = [a + b for a in out for b in more]
    return out


def _powers(base: list[str], n: int) -> set[str] | None:
    """All strings of n parts, if they are few."""
    out = {""}
    for _ in range(n):
        out = {x + b for x in out for b in base}
        if len(out) > MOST:
            return None
    return out


def _of_strings(strings: list[str]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that each text with a match satisfies; None if there is none.
    Trigrams are lower-case: the index folds case, which only adds candidates."""

    def of(tokens) -> Query:
        parts, run = [], []

        def flush():
            if run:
                strings = _strings(run)
                if strings is not None:
                    parts.append(_of_strings(strings))
                run.clear()

        for token in tokens:
            op, arg = token
            if _strings([*run, token]) is not None:
                run.append(token)
                continue
            flush()
            if _strings([token]) is not None:
                run.append(token)
            elif op is C.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is C.BRANCH:
                parts.append(_join("or", [of(b) for b in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                parts.append(of(arg[2]))
        flush()
        return _join("and", parts)

    return of(list(P.parse(pattern, re.ASCII)))


def trigrams_in(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_in(q) for q in query[1]))


class Segment:
    """Postings of one batch of texts, for the wanted trigrams alone."""

    def __init__(self, texts: list[str], wanted: set[str]):
        self.everything = set(range(len(texts)))
        self.postings: dict[str, set[int]] = {t: set() for t in wanted}
        for i, text in enumerate(texts):
            low = text.lower()
            for t, held in self.postings.items():
                if t in low:
                    held.add(i)

    def candidates(self, query: Query) -> set[int]:
        if query is None:
            return self.everything
        if isinstance(query, str):
            return self.postings[query]
        found = [self.candidates(q) for q in query[1]]
        return set.intersection(*found) if query[0] == "and" else set().union(*found)


def digest(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = set().union(*(trigrams_in(q) for q in self.queries))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule number, end) of all secrets."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        segment = Segment(texts, self.wanted)
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in segment.candidates(query):
                out[i].extend((a, k, b) for a, b in rule.spans(texts[i]))
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``keep`` columns and ``found``: its spans (kind, start, end; code points, end exclusive), by start and rule.

    Null texts count as empty; long texts are scanned whole; repeated rows are
    answered alike; other columns are not read; an empty table stays empty.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*struct_of(docs, *keep), T.StructField("found", T.ArrayType(span))])

    def rows():
        scanner = Scanner(rules)

        def step(cols):
            found = scanner.scan([t or "" for t in cols[0]])
            return [[[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]]

        return step

    return arrow_map(docs.select(*keep, F.col(text_col).alias("_text")), schema, rows, len(keep))


def with_digests(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and digests of the spans that find_secrets gives: a text without any has counts of 0 and the digest of
    the empty string. Rows are answered one by one; an empty table stays empty."""
    word = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    own = F.filter("found", lambda x: x["kind"].isin([r.kind for r in base]))
    of_kind = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select(
        *[c for c in found.columns if c != "found"],
        *counts,
        F.sha2(F.concat_ws(",", F.transform(own, word)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", word)).alias("spans"),
    )
