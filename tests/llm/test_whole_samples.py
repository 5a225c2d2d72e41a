"""The texts that shape dictionaries are made from."""

from gridloom.llm import quality


def test_shapes_come_from_all_of_a_text_and_all_sources(spark, monkeypatch):
    text = b"a" * 5000 + b"A" * 5000 + b"0" * 5000
    assert {*quality._raw([text], 131_072, 2000, 4)} == {*b"aA0"}
    assert len(quality._raw([text] * 100, 131_072, 2000, 4)) <= 131_072 + 100
    held = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, *_: held.extend(rows))
    docs = spark.createDataFrame([(i, ("first " if i < 400 else "second ") + "x" * 2000) for i in range(800)], "doc_id long, text string")
    quality.fit(docs, spark.range(800).selectExpr("id AS doc_id", "int(id % 2) AS quality"))
    assert len(held) == 800 and 100 < sum(t.startswith("first") for t, _ in held[:400]) < 300
