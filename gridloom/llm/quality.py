"""Quality by compression: which of two zstandard dictionaries makes a text smaller?

Dictionaries are made from good and from bad labelled texts, in two views: the
text's bytes, and its shape (letters, capitals and digits each folded to one
byte). The difference of the two compressed sizes in each view, normalised by
the sizes, by the text's length and by its root, goes through a logistic
calibration fitted on labelled texts that no dictionary holds. Nothing else
about a text is used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import arrow_map, struct_of

SHAPE = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else 48 if 48 <= c < 58 else c for c in range(256))


@dataclass(frozen=True)
class Params:
    """The labelled sample: at most about ``per_label`` texts of each label, chosen by a hash
    of the id, none over ``longest_example`` characters, so the driver holds at most twice their product.
    Scored texts are not limited.
    A shape dictionary of ``shape_dict_bytes`` takes texts in the order of a hash of the id until it is full,
    of each at most ``shape_example_bytes``, in ``shape_pieces`` pieces spread over the text."""

    per_label: int = 3000
    longest_example: int = 20_000
    text_dict_bytes: int = 112_640
    shape_dict_bytes: int = 131_072
    shape_example_bytes: int = 2000
    shape_pieces: int = 4
    level: int = 3
    ridge: float = 0.5


@dataclass
class Model:
    text: tuple[bytes, bytes]  # trained dictionaries of good and bad texts
    shape: tuple[bytes, bytes]  # raw content of good and bad shapes
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    level: int = 3


def _raw(samples: list[bytes], size: int, most: int, pieces: int) -> bytes:
    out, n = [], 0
    for x in samples:
        if len(x) > most:
            each = most // pieces
            x = b"".join(x[at : at + each] for at in (i * (len(x) - each) // max(1, pieces - 1) for i in range(pieces)))
        x = x[: size - n]
        out.append(x)
        n += len(x)
        if n >= size:
            break
    return b"\n".join(out)


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b""


class Sizer:
    """Compressed sizes under the dictionaries, as the features of a text."""

    def __init__(self, text: tuple[bytes, bytes], shape: tuple[bytes, bytes], level: int):
        self.text = [self._with(d, zstandard.DICT_TYPE_FULLDICT, level) for d in text]
        self.shape = [self._with(d, zstandard.DICT_TYPE_RAWCONTENT, level) for d in shape]

    @staticmethod
    def _with(content: bytes, kind: int, level: int) -> zstandard.ZstdCompressor:
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=level, write_content_size=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=kind)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False)

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "replace")
        n, out = len(raw) + 1, []
        for view, sizes in ((raw, self.text), (raw.translate(SHAPE), self.shape)):
            good, bad = (len(c.compress(view)) for c in sizes)
            out += [(bad - good) / (bad + good), (bad - good) / n, (bad - good) / n**0.5]
        return out


def _design(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = (x - mean) / std
    pairs = [z[:, i : i + 1] * z[:, j : j + 1] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
    return np.clip(np.hstack([np.ones((len(z), 1)), z, *pairs]), -10, 10)


def _probability(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x, model.mean, model.std) @ model.weights, -30, 30)))


def fit_rows(rows: list[tuple[str, int]], prior: float, params: Params = Params()) -> Model:
    """Fit on (text, label) rows; even ones make the dictionaries, odd ones calibrate.
    prior: the share of label 1 among all labelled rows."""
    parts = {y: [t.encode("utf-8", "replace") for t, q in rows if q == y] for y in (1, 0)}
    make = {y: x[0::2] for y, x in parts.items()}
    text = tuple(_trained(make[y], params.text_dict_bytes) for y in (1, 0))
    shape = tuple(_raw([x.translate(SHAPE) for x in make[y]], params.shape_dict_bytes, params.shape_example_bytes, params.shape_pieces) for y in (1, 0))
    sizer = Sizer(text, shape, params.level)
    held = [(x, y) for y, xs in parts.items() for x in xs[1::2]]
    if not held:
        x = np.array([sizer.features("")])
        return Model(text, shape, x[0], np.ones(x.shape[1]), np.zeros(_design(x, x[0], np.ones(x.shape[1])).shape[1]), params.level)
    x = np.array([sizer.features(t.decode("utf-8", "replace")) for t, _ in held])
    y = np.array([float(q) for _, q in held])
    mean, std = x.mean(0), x.std(0) + 1e-9
    e, w = _design(x, mean, std), None
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))  # the sample is balanced, the corpus is not
    w = np.zeros(e.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
        slope = e.T @ (weight * (y - p)) - params.ridge * w
        bend = (e * (weight * p * (1 - p))[:, None]).T @ e + params.ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return Model(text, shape, mean, std, w, params.level)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of the labelled documents. Labels other than 0 and 1, null ids, null texts
    and documents labelled both ways teach nothing; of texts that share an id the smallest counts. Without
    any label every text scores 0.5."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    sizes = {r[0]: r[1] for r in marked.groupBy("_y").count().collect()}
    spot = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("quality")), F.lit(1_000_000)) / 1_000_000
    chosen = [marked.where((F.col("_y") == y) & (spot < min(1.0, params.per_label / n))) for y, n in sizes.items()]
    rows: list[tuple[str, int]] = []
    if chosen:
        few = chosen[0] if len(chosen) == 1 else chosen[0].union(chosen[1])
        few = few.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_x")).where("_x = _y").drop("_x")
        texts = docs.where(F.length(text_col) <= params.longest_example).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        # the sample is bounded by per_label, so it can be broadcast
        held = texts.join(F.broadcast(few), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).where("_text IS NOT NULL")
        rows = [(r["_text"], r["_y"]) for r in sorted(held.collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r["_id"])), r["_id"], r["_text"]))]
    total = sum(sizes.values())
    return fit_rows(rows, min(max(sizes.get(1, 0) / total, 0.01), 0.99) if total else 0.5, params)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``keep`` columns, score (0 to 1) and predicted.

    Null texts count as empty; empty texts get the score of an empty text.
    Long texts are compressed whole. Repeated rows score alike; other columns
    are not read; an empty table gives an empty table.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB
    schema = T.StructType([*struct_of(docs, *keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def rows():
        m = box.value
        sizer = Sizer(m.text, m.shape, m.level)

        def step(cols):
            p = _probability(m, np.array([sizer.features(t) for t in cols[0]]))
            return [[float(v) for v in p], [int(v >= 0.5) for v in p]]

        return step

    return arrow_map(docs.select(*keep, F.col(text_col).alias("_text")), schema, rows, len(keep))
