"""Language identification: known words first, shorter and shorter character n-grams for the rest.

A word the model knows adds its log frequency in every language. An unseen
word is framed as ``^word$`` and looked up by its character 5-grams; if none
is known by its 4-grams, and so on down to single characters. A document's
languages are ranked by the sum over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import arrow_map, struct_of

UNDETERMINED = "und"
ORDERS = (5, 4, 3, 2, 1)
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Params:
    """``per_lang_docs`` bounds the labelled sample the model is fitted on (chosen
    by a hash of the id). ``word_share`` and ``gram_share`` bound the model: an
    entry must hold that share of its language's words or n-grams, so a table
    has at most 1 / share entries a language and order. ``least_count``: what the sample holds less often is
    chance, whatever its share; 1 keeps all."""

    per_lang_docs: int = 2000
    word_share: float = 2e-5
    gram_share: float = 1e-4
    least_count: int = 2
    smoothing: float = 0.5
    backoff: float = 0.6
    evidence_words: int = 20
    unseen_cache: int = 200_000


@dataclass
class Model:
    langs: list[str]
    tables: dict[int, dict[str, np.ndarray]] = field(default_factory=dict)  # 0: words, n: n-grams
    params: Params = Params()


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    out = []
    for token in TOKEN.findall(text.lower()):
        if token.isalpha():
            out.append(token)
        else:  # numbers that are no decimal digits, such as superscripts
            out.extend("".join(c if c.isalpha() else " " for c in token).split())
    return out


def _grams(word: str, n: int) -> list[str]:
    framed = f"^{word}$"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def fit(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows with a text and a language. Rows without either teach nothing; an
    empty table gives a model that answers ``und`` to everything."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], {}, params)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, params.per_lang_docs / n)))])
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(spot < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])

    def counter():
        def step(cols):
            words: Counter = Counter()
            for lang, text in zip(*cols):
                for w, c in Counter(words_of(text)).items():
                    words[lang, w] += c
            found: Counter = Counter()
            for (lang, w), c in words.items():
                found[lang, 0, w] += c
                for n in ORDERS:
                    for g in _grams(w, n):
                        found[lang, n, g] += c
            return [list(x) for x in zip(*((a, n, g, c) for (a, n, g), c in found.items()))] or [[], [], [], []]

        return step

    counts = arrow_map(sample, out, counter).groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    needed = F.when(F.col("n") == 0, params.word_share).otherwise(params.gram_share) * F.col("total")
    kept = counts.join(F.broadcast(totals), ["lang", "n"]).where((F.col("c") >= needed) & (F.col("c") >= params.least_count))
    rows = kept.collect()  # bounded by the shares: Params
    langs = sorted(sizes)
    at = {x: i for i, x in enumerate(langs)}
    raw: dict[int, dict[str, np.ndarray]] = {n: {} for n in (0, *ORDERS)}
    total = {n: np.ones(len(langs)) for n in raw}
    for r in rows:
        raw[r["n"]].setdefault(r["gram"], np.zeros(len(langs)))[at[r["lang"]]] = r["c"]
        total[r["n"]][at[r["lang"]]] = r["total"]
    tables = {n: {g: np.log((c + params.smoothing) / (total[n] + params.smoothing * (len(table) + 1))) for g, c in table.items()} for n, table in raw.items()}
    return Model(langs, tables, params)


class Scorer:
    """Scores words with a model; vectors of unseen words are kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.words = model, model.tables.get(0, {})
        self.cache: dict[str, np.ndarray | None] = {}

    def unseen(self, word: str) -> np.ndarray | None:
        if word in self.cache:
            return self.cache[word]
        found = None
        for n in ORDERS:
            table = self.model.tables[n]
            hits = [v for g in _grams(word, n) if (v := table.get(g)) is not None]
            if hits:
                found = (sum(hits) / len(hits)) * self.model.params.backoff ** (ORDERS[0] - n + 1)
                break
        if len(self.cache) >= self.model.params.unseen_cache:
            self.cache.clear()
        self.cache[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        vectors, weights = [], []
        for w, c in Counter(words).items():
            v = self.words.get(w)
            if v is None:
                v = self.unseen(w)
            if v is not None:
                vectors.append(v)
                weights.append(c)
        if not vectors:  # letters of a script that no sample held
            return self.model.langs[0], 1.0 / len(self.model.langs)
        n = float(sum(weights))
        total = np.asarray(weights, float) @ np.asarray(vectors)
        total = total / n * min(n, self.model.params.evidence_words)
        p = np.exp(total - total.max())
        best = int(np.argmax(total))  # ties: the first language by name
        return self.model.langs[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every row's ``keep`` columns, lang_pred and score (or other ``names``).

    Null, empty or letterless texts: ``und`` with score 0. Long texts are read
    whole. Repeated rows are answered alike, ties go to the first language by
    name, an empty table gives an empty table; other columns are not read.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Params
    schema = T.StructType([*struct_of(docs, *keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def rows():
        scorer = Scorer(box.value)

        def step(cols):
            said = [scorer.predict(t) for t in cols[0]]
            return [[x for x, _ in said], [s for _, s in said]]

        return step

    return arrow_map(docs.select(*keep, F.col(text_col).alias("_text")), schema, rows, len(keep))
