"""Pipeline stages over documents without ids."""

import pytest
from pyspark.sql import functions as F

COPY = "a fairly plain sentence that is long enough to have a good number of shingles of five words in it"


@pytest.mark.parametrize("ids", [(1, 2), (2**63 - 1, 5), (None, None)])
def test_documents_without_ids_are_deduplicated_and_decontaminated(spark, sf, ids):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    own = "another text that nobody else has written in this small table of ours"
    rows = [(ids[0], COPY), (ids[1], own), (None, COPY), (None, COPY), (None, own + " before now"), (None, "So it says: " + item), (None, "quite alone here with these few words")]
    few = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema).repartition(3)
    left = [(r["doc_id"], r["text"]) for r in c.near(spark, few, sf).collect()]
    assert sorted(t for _, t in left if t == COPY) == [COPY]
    assert (ids[0], COPY) in left or ids[0] == 2**63 - 1  # numbers then go below all ids
    assert len(left) == 4
    clean = c.benchmark(spark, few, sf)
    assert clean.schema == few.schema
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for _, t in rows if item not in t)
