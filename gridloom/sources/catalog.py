"""Models in folders named key=value: found, listed, selected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.model import BlockModel, ModelError
from gridloom.sources.store import SIDE_FILE, SUFFIX, load


class AssetError(LookupError):
    pass


@dataclass(frozen=True)
class Catalog:
    """One row for each model: path, name, and a column for each key."""

    df: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def discover(cls, spark: SparkSession, root: str) -> Catalog:
        """All models below root: single files, and folders with a side file. The listing is metadata alone."""
        root = root.rstrip("/")
        found: set[str] = set()
        for pattern in (f"*{SUFFIX}", SIDE_FILE):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
            found |= {r[0] if pattern != SIDE_FILE else r[0].rsplit("/", 1)[0] for r in files.collect()}
        # Spark's listing passes over names that begin with an underscore: folders are found by their parts
        parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select(F.regexp_replace("path", "/[^/]*$", "").alias("p")).distinct()
        found |= {r[0] for r in parts.collect() if r[0].endswith(SUFFIX)}
        keys: list[str] = []
        rows = []
        for path in sorted(found):
            below = path.split(root.removeprefix("file:"), 1)[-1].strip("/").split("/")
            levels = dict(x.split("=", 1) for x in below[:-1] if "=" in x)
            keys += [k for k in levels if k not in keys]
            rows.append((path, below[-1].removesuffix(SUFFIX), levels))
        table = spark.createDataFrame(rows, "path string, name string, levels map<string,string>")
        return cls(table.select("path", "name", *(F.col("levels")[k].alias(k) for k in keys)), tuple(keys))

    def where(self, **selections: str) -> DataFrame:
        df = self.df
        for k, v in selections.items():
            if k not in (*self.keys, "name"):
                raise AssetError(f"no such level: {k}")
            df = df.where(F.col(k) == v)
        return df

    def options(self, key: str, **selections: str) -> DataFrame:
        """The sorted values of a level, given selections of earlier levels (later ones are not used)."""
        order = (*self.keys, "name")
        if key not in order:
            raise AssetError(f"no such level: {key}")
        earlier = {k: v for k, v in selections.items() if k in order[: order.index(key)]}
        return self.where(**earlier).select(F.col(key).alias("option")).where("option IS NOT NULL").distinct().orderBy("option")

    def select(self, **selections: str) -> str:
        """The path of the one model that fits; none or several are an error."""
        rows = self.where(**selections).limit(2).collect()
        if len(rows) != 1:
            raise AssetError(f"{'no model' if not rows else 'several models'} for {selections}")
        return rows[0]["path"]

    def open(self, **selections: str) -> BlockModel:
        try:
            return load(self.df.sparkSession, self.select(**selections))
        except ModelError as e:
            raise AssetError(str(e)) from e
