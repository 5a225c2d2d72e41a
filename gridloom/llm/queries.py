"""The queries op1 to op10 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, decontam, html, langid, linededup, neardup, packing, quality, secrets, topk
from gridloom.llm.common import crc_remainder, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


#: Fixed by the contract: a conversation that holds control strings and a backslash before one.
TRAP = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.union(trap)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~held))
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), neardup.Params(shingle=4, percent=80))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.with_digests(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, lambda v: v % 20 == 0, topk.Params(least_tasks=spark.sparkContext.defaultParallelism))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), packing.public_params())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_quality, op4_near_duplicates, op5_line_dedup, op6_main_text, op7_decontaminate, op8_secrets, op9_top_k, op10_packing)}


#: A turn is "### Role: " text "</turn>" and a line's end; texts are escaped at the least of three levels that comes back.
OP2_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'
), said AS (
  SELECT *, 14 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 END + length(CASE
    WHEN NOT regexp_matches(text, '###|</turn>') AND NOT ends_with(text, '\') THEN text
    WHEN NOT regexp_matches(text, '\\(###|</turn>)') AND NOT ends_with(text, '\') THEN regexp_replace(text, '(###|</turn>)', '\\\1', 'g')
    ELSE regexp_replace(regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') END) AS chars FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS i FROM words WHERE w IS NOT NULL)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP5_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS raw FROM raw WHERE ls IS NOT NULL
), normal AS (
  SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines
), firsts AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS f FROM normal WHERE line <> '' GROUP BY line
), words AS (
  SELECT line, f, string_split(line, ' ') AS w FROM firsts WHERE len(string_split(line, ' ')) >= 6
), variants AS (
  SELECT line, f, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) AS v, len(w) - 1 AS m
  FROM (SELECT line, f, w, unnest(generate_series(1, len(w))) AS i FROM words)
), replaced AS (
  SELECT v, m, i, min(f) AS e FROM variants GROUP BY v, m, i HAVING count(*) > 1
), pairs AS (
  SELECT line, e FROM variants JOIN replaced USING (v, m, i)
  UNION ALL
  SELECT a.line, b.f FROM variants a JOIN words b ON a.v = md5(b.line) AND a.m = len(b.w)
  UNION ALL
  SELECT b.line, a.f FROM variants a JOIN words b ON a.v = md5(b.line) AND a.m = len(b.w)
), earliest AS (
  SELECT line, min(e) AS e FROM (SELECT line, f AS e FROM firsts UNION ALL SELECT line, e FROM pairs) GROUP BY line
), judged AS (
  SELECT n.doc_id, n.pos, n.raw, coalesce({'d': n.doc_id, 'p': n.pos} > x.e, false) AS gone
  FROM normal n LEFT JOIN earliest x ON n.line = x.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The rules again, in the words of an engine without look-behind; a run of a scheme's characters begins where it begins.
OP8_RULES = (
    ("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("url_login", r"[a-z0-9+.-]*[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D:/@]*:[^\x20\x09-\x0D:/@]+@", 0, 0),
)
#: Matches in order, and the texts between them, give the places.
OP8_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS part, string_split_regex(text, '{pattern}') AS between FROM docs"
    for n, (kind, pattern, group, least) in enumerate(OP8_RULES)
)
OP8_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  {OP8_FOUND}
), each AS (
  SELECT *, unnest(generate_series(1, len(whole))) AS i FROM found
), placed AS (
  SELECT doc_id, k, kind, length(whole[i]) AS n, CAST(list_sum(list_transform(between[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM each WHERE length(part[i]) >= least
), said AS (
  SELECT doc_id, k, kind, a, kind || ':' || a || ':' || (a + n) AS span FROM placed
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM said GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = """
WITH flat AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS t FROM embeddings WHERE embedding IS NOT NULL
), bad AS (
  SELECT DISTINCT vec_id FROM flat WHERE x IS NULL OR isnan(x) OR isinf(x)
), q AS (
  SELECT vec_id, t, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM flat WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.w * b.w) AS BIGINT) AS score
  FROM q a JOIN q b ON a.t = b.t AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_secrets": OP8_SQL, "op9_top_k": OP9_SQL}
