"""The SQL of the text queries, against the operators on texts that try it."""

import duckdb
import pyarrow as pa
import pytest

from gridloom.llm import chat, queries, secrets

TEXTS = ["", "plain", queries.TRAP, "\\", "a\\\\", "###", "\\\\###</turn>\\", "</turn>\n### User: x", "#" * 7, "\\" * 9 + "</turn>", "é\n\r\t", "\\### and ###", "x ### \\", "🙂</turn>"]


def test_sql_of_formatting_knows_the_levels_of_escaping():
    con = duckdb.connect()
    rows = [(c, t, role, text) for c, text in enumerate(TEXTS) for t, role in enumerate(("user", "assistant", "system", None))]
    con.register("conversations", pa.table({n: [r[i] for r in rows] for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
    got = {r[0]: r[5] for r in con.execute(queries.OP2_SQL).fetchall()}
    for c, text in enumerate(TEXTS):
        assert got[c] == len(chat.render([(r, text) for r in ("user", "assistant", "system", None)])[0])


SECRETS = ["API_KEY : 'abcdefgh'", "apikey=abc toKen=12345678", "paſſword=abcdefghij secret='a.b-c_d/e+f=='", "é" * 5 + "token=0123456789abcdef0123456789abcdef", "f" * 31 + "g" + "f" * 32, None, "", "tokentoken=aaaaaaaa=token=bbbbbbbb",
    "1https://u:p@h and 9://x:y@z and ftp://:pw@h/x:y@", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18, "AIza" + "x" * 35 + " xoxb-1234567890-a", "eyJabcdefghij.eyJabcdefghij.sig-_", "a" * 50 + "AKIA" + "X1" * 8]


def test_sql_of_secrets_finds_the_same_spans(spark):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(SECRETS))), "text": SECRETS}))
    want = {r[0]: tuple(r) for r in con.execute(queries.OP8_SQL).fetchall()}
    docs = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in secrets.with_digests(secrets.find_secrets(docs)).collect()}
    assert got == want and sum(bool(r[5]) for r in got.values()) >= 9


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_and_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
