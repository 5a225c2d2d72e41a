"""Column statistics, deciles, categories, and the report made of them."""

from __future__ import annotations

import html
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.expressions import missing, present


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMBERS or t.startswith("decimal")]


#: percentile_approx errs by 1 / ACCURACY of the ranks at most; brackets are MARGIN wide on each side.
ACCURACY, MARGIN = 10_000, 3 / 10_000
#: So many values are sorted in one task.
NARROW = 100_000
#: A column's values between (or at) two bounds.
Bracket = tuple[float, float]


def _approximate(v: Column, at: float, margin: float) -> Column:
    """Bounds round the quantile ``at``."""
    return F.percentile_approx(v, [max(0.0, at - margin), min(1.0, at + margin)], ACCURACY)


def _ranked(df: DataFrame, values: dict[str, Column], wanted: dict[tuple[str, int], Bracket], margin: float = MARGIN) -> dict[tuple[str, int], float]:
    """The k-th smallest value (from 0) of each wanted (name, k), which its bracket is believed to hold.

    No task holds more than NARROW values of a column: what is between a bracket's bounds is sorted if it
    is so few, else bracketed anew by an approximation. Bounds that hold the wanted rank are the answer, and
    others are left out next time, so every round makes progress whatever values repeat.
    """
    found: dict[tuple[str, int], float] = {}
    while wanted:
        made = []
        for n, (name, k) in enumerate(wanted):
            v, (low, high) = values[name], wanted[name, k]
            made += [F.count_if(v < low).alias(f"below{n}"), F.count_if(v == low).alias(f"low{n}"), F.count_if((v > low) & (v < high)).alias(f"mid{n}"), F.count_if((v == high) & (high > low)).alias(f"high{n}")]
        row = df.agg(*made).first()
        lists, brackets, lost = {}, {}, {}
        for n, (name, k) in enumerate(wanted):
            low, high = wanted[name, k]
            spot, mid = k - row[f"below{n}"], row[f"mid{n}"]
            if 0 <= spot < row[f"low{n}"]:
                found[name, k] = low
            elif row[f"low{n}"] + mid <= spot < row[f"low{n}"] + mid + row[f"high{n}"]:
                found[name, k] = high
            elif row[f"low{n}"] <= spot < row[f"low{n}"] + mid:
                within = F.when((values[name] > low) & (values[name] < high), values[name])
                if mid <= NARROW:
                    lists[name, k] = (name, low, high), within, spot - row[f"low{n}"]
                else:
                    brackets[name, k] = _approximate(within, (spot - row[f"low{n}"]) / (mid - 1), margin)
            else:
                lost[name, k] = (-float("inf"), float("inf"))
        wanted = {}
        if lists or brackets:
            sorted_ = {one: within for one, within, _ in lists.values()}  # ranks of one bracket share its list
            place = {one: f"s{n}" for n, one in enumerate(sorted_)}
            made = [F.sort_array(F.collect_list(w)).alias(place[one]) for one, w in sorted_.items()] + [x.alias(f"b{n}") for n, x in enumerate(brackets.values())]
            picks = [F.get(place[one], F.lit(at)).alias(f"p{n}") for n, (one, _, at) in enumerate(lists.values())]
            row = df.agg(*made).select(*picks, *(f"b{n}" for n in range(len(brackets)))).first()
            found |= {key: row[f"p{n}"] for n, key in enumerate(lists)}
            wanted = {key: tuple(row[f"b{n}"]) for n, key in enumerate(brackets)}
        if lost:  # not in its bracket, against the approximation's promise
            found |= _ranked(df, values, lost, 2 * margin)
    return found


def quantiles(df: DataFrame, values: dict[str, Column], at: list[float], held: dict[str, tuple[int, list[Bracket]]] | None = None) -> dict[str, list[float] | None]:
    """Exact, linearly interpolated quantiles of the columns ``values``, by name; None where there is no value.
    held: how many values there are and brackets of the quantiles, where an earlier aggregation has them."""
    if held is None:
        row = df.agg(*(x for n, v in enumerate(values.values()) for x in counted(v, at, str(n)))).first()
        held = {name: counted_in(row, at, str(n)) for n, name in enumerate(values)}
    spots = {name: [a * (n - 1) for a in at] for name, (n, _) in held.items() if n}
    wanted = {}
    for name, spot in spots.items():
        n, brackets = held[name]
        for x, bracket in zip(spot, brackets):
            for k in (int(x), min(int(x) + 1, n - 1)):
                wanted[name, k] = (-float("inf"), float("inf")) if n <= NARROW else bracket
    found = _ranked(df, values, wanted)
    out: dict[str, list[float] | None] = dict.fromkeys(values)
    for name, spot in spots.items():
        ends = [(found[name, int(x)], found[name, min(int(x) + 1, held[name][0] - 1)], x - int(x)) for x in spot]
        out[name] = [a if a == b or not part else a + (b - a) * part for a, b, part in ends]
    return out


def counted(v: Column, at: list[float], n: str) -> list[Column]:
    ends = [x for a in at for x in (max(0.0, a - MARGIN), min(1.0, a + MARGIN))]
    return [F.count(v).alias(f"n{n}"), F.percentile_approx(v, ends, ACCURACY).alias(f"b{n}")]


def counted_in(row, at: list[float], n: str) -> tuple[int, list[Bracket]]:
    flat = row[f"b{n}"] or []
    return row[f"n{n}"], list(zip(flat[::2], flat[1::2]))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each number column: rows, missing, distinct, zeros, min, max, mean, std, quartiles (exact). All
    columns in one aggregation, and a few for the quartiles; the result is made of the numbers found."""
    columns = columns or numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], PROFILE)
    at = [0.25, 0.5, 0.75]
    value = {c: missing(F.col(c).cast("double")) for c in columns}
    made: list[Column] = []
    for n, (c, v) in enumerate(value.items()):
        parts = {"rows": F.count(F.lit(1)), "missing": F.count_if(v.isNull()), "distinct": F.count_distinct(v), "zeros": F.count_if(v == 0), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v)}
        made += [F.struct(F.lit(c).alias("column"), *(x.alias(k) for k, x in parts.items())).alias(f"s{n}"), *counted(v, at, str(n))]
    row = df.agg(*made).first()
    found = quantiles(df, value, at, {c: counted_in(row, at, str(n)) for n, c in enumerate(columns)})
    return df.sparkSession.createDataFrame([(*row[f"s{n}"], *(found[c] or [None] * 3)) for n, c in enumerate(columns)], PROFILE)


PROFILE = "column string, rows long, missing long, distinct long, zeros long, min double, max double, mean double, std double, q25 double, q50 double, q75 double"


def categorical_profile(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """The most frequent values of each column, ties by value: column, value, n, share (of all rows)."""
    melted = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s"))
    counted = melted.groupBy("s.column", "s.value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.join(F.broadcast(total)).select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of each pair of columns, over rows that have both."""
    pairs = [(a, b) for n, a in enumerate(columns) for b in columns[n + 1 :]]
    value = {c: missing(F.col(c).cast("double")) for c in columns}
    row = df.agg(*(F.corr(value[a], value[b]).alias(f"r{n}") for n, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{n}").alias("r")) for n, (a, b) in enumerate(pairs)))))


def _finite(column: str) -> Column:
    v = F.col(column).cast("double")
    return F.when(present(v) & (F.abs(v) != float("inf")), v)


def deciles_of(df: DataFrame, column: str) -> list[float] | None:
    """The 10th to 90th percentiles of the finite values; None if there is none."""
    return quantiles(df, {column: _finite(column)}, [n / 10 for n in range(1, 10)])[column]


def decile_edges(df: DataFrame, column: str) -> DataFrame:
    """One row, edges: the 10th to 90th percentiles of the finite values."""
    return df.sparkSession.createDataFrame([(deciles_of(df, column),)], "edges array<double>")


def bin_to_deciles(df: DataFrame, column: str, out: str = "decile") -> DataFrame:
    """df with the number of decile edges at or below the value, 0 to 9; missing stays missing."""
    v, edges = F.col(column).cast("double"), deciles_of(df, column)
    bin_ = F.lit(0)
    for e in edges or []:
        bin_ = bin_ + (v >= F.lit(e)).cast("int")
    return df.withColumn(out, F.when(present(v), bin_))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """category and code: the sorted labels numbered from 0. Labels are few: one window over them is small."""
    labels = df.select(F.col(column).alias("category")).where("category IS NOT NULL").distinct()
    return labels.withColumn("code", F.dense_rank().over(Window.orderBy("category")) - 1)


# memory budgets of reports


UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def parse_memory_budget(text: str | int) -> int:
    """Bytes of "256MB", "2GiB" or a number."""
    if isinstance(text, int) and not isinstance(text, bool):
        n = text
    else:
        m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*", str(text))
        if not m or m[2].upper() not in UNITS:
            raise ValueError(f"no memory size: {text!r}")
        n = int(float(m[1]) * UNITS[m[2].upper()])
    if n <= 0:
        raise ValueError("a memory budget is positive")
    return n


def column_sizes(path: str, columns: list[str] | None = None) -> dict[str, int]:
    """Uncompressed bytes of each column by the footers of a Parquet file or folder."""
    from gridloom.sources.store import column_chunks

    out: dict[str, int] = {}
    for name, _, size in column_chunks(SparkSession.active(), path):
        out[name] = out.get(name, 0) + size
    return out if columns is None else {c: out[c] for c in columns}


def columns_per_batch(columns: list[str], sizes: dict[str, int], budget: int) -> int:
    """The most columns such that any so many neighbours fit the budget; 1 at least."""
    for n in range(len(columns), 1, -1):
        if max(sum(sizes[c] for c in columns[a : a + n]) for a in range(len(columns) - n + 1)) <= budget:
            return n
    return 1


def report_html(df: DataFrame, title: str, descriptions: dict[str, str] | None = None, columns: list[str] | None = None, batch: int = 10) -> str:
    """The profile as an HTML page; number columns are profiled ``batch`` at a time."""
    columns = columns or df.columns
    numbers = [c for c in columns if c in numeric_columns(df)]
    texts = [c for c in columns if c not in numbers]
    rows = [r for a in range(0, len(numbers), batch) for r in numeric_profile(df, numbers[a : a + batch]).collect()]

    def table(names, values):
        cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
        return f"<table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>{''.join('<tr>' + ''.join(map(cell, v)) + '</tr>' for v in values)}</table>"

    parts = [f"<h1>{html.escape(title)}</h1>"]
    if descriptions:
        parts.append(table(["column", "description"], sorted(descriptions.items())))
    if rows:
        parts.append(table(rows[0].__fields__, rows))
    if texts:
        parts.append(table(["column", "value", "n", "share"], categorical_profile(df, texts).orderBy("column", F.desc("n"), "value").collect()))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(parts)}</body></html>"


def save_report(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf-8")
