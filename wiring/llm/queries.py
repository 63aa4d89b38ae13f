"""Thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiring.llm import annulus, bpe, chat, cws, dac, decontam, exact, html, langid, lines, neardup, periodic, pii
from wiring.llm.common import table


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat.digests(chat.conversations(rows.unionByName(extra)))


#: The same from the rows alone: what is read back must be what was put in; markers add 15, 5 or 18 characters.
OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|ROLE:|/ROLE\])', '\1\\\2\3', 'g') AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 18 ELSE length(role) + 16 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


#: Windows by their whole content, each against the first place of it; \x0b is white space in Spark's pattern, not in RE2's.
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
every AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM docs),
bare AS (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM every),
counted AS (SELECT doc_id, pos, line, len(regexp_split_to_array(line, '[ \t\n\x0b\f\r]+')) AS words FROM bare WHERE line <> ''),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS through, sum(words) OVER (PARTITION BY doc_id) AS total FROM counted),
placed AS (SELECT *, through - words AS before FROM summed),
around AS (SELECT *,
  list(line) OVER ahead AS ahead, max(pos) OVER ahead AS last, list(line) OVER behind AS behind, min(pos) OVER behind AS start, min(before) OVER behind AS start_before,
  lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next_pos FROM placed
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), behind AS (PARTITION BY doc_id ORDER BY through RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
windows AS (
  SELECT doc_id, line AS key, pos AS first, pos AS last FROM around WHERE words >= 50
  UNION ALL SELECT doc_id, line || chr(10) || next, pos, next_pos FROM around WHERE words >= 50 AND next IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ahead, chr(10)), pos, last FROM around WHERE words < 50 AND total - before >= 50
  UNION ALL SELECT doc_id, array_to_string(behind, chr(10)), start, pos FROM around WHERE words < 50 AND through >= 50),
firsts AS (SELECT key, min((doc_id, first)) AS place FROM windows GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM windows JOIN firsts USING (key) WHERE (doc_id, first) <> place),
left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (gone.pos IS NULL) AS text, count(*) AS n_lines, count(gone.pos) AS n_removed FROM every LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n_removed > 0 THEN coalesce(l.text, '') ELSE d.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM docs d LEFT JOIN left_over l USING (doc_id)
"""


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("text_hash")


#: All pairs of sets that share a shingle, and what their links reach.
OP8_SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM cut),
firsts AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT doc_id, n, unnest(s) AS item FROM firsts),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM firsts UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
named AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN firsts f ON d.s = f.s AND len(d.s) > 0 LEFT JOIN named n ON n.a = f.doc_id
"""


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), round_trip=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = dac.write(table(spark, sf_dir, "documents"), dac.new_store(spark))
    return dac.digests(spark, path)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.find(table(spark, sf_dir, "documents"), change=periodic.planted))


#: Pairs of equal words of a document, gaps and islands along each lag; crc32 by its bits over the digits of the id.
OP12_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w,
  xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM documents),
numbered AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS plant FROM split),
placed AS (SELECT *, CASE WHEN plant THEN g % n ELSE n END AS a FROM numbered),
measured AS (SELECT *, CASE WHEN plant THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM placed),
words AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM measured)),
same AS (SELECT x.doc_id, y.i - x.i AS lag, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, lag, min(i) AS start, count(*) + lag AS length FROM islands GROUP BY doc_id, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(lag) AS period FROM stretches GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, min((-length, start, period)) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, 1000 * -best[1] // best[3] AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.report(table(spark, sf_dir, "embeddings"))


def _centroid_sql(k: int, rounds: int, dim: int, scale: int) -> str:
    """Every vector against every centroid, round by round."""
    def nearest(r: int) -> str:
        away = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""near{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, number)) AS best FROM
  (SELECT x.row, x.vec_id, x.v, c.number, CAST({away} AS BIGINT) AS d FROM x CROSS JOIN c{r} c) GROUP BY row)"""

    parts = [f"""x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS number, v FROM x ORDER BY number LIMIT {k})"]
    for r in range(rounds):
        parts.append(nearest(r))
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
  (SELECT number, list(q ORDER BY pos) AS v FROM (SELECT number, pos, (sum(s) - ((sum(s) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM
    (SELECT best[2] AS number, unnest(v) AS s, generate_subscripts(v, 1) AS pos FROM near{r}) GROUP BY number, pos) GROUP BY number) m USING (number))""")
    parts.append(nearest(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT n.vec_id, CAST(n.best[2] AS INTEGER) AS cluster, n.best[1] AS distance, CAST(sum(n.best[1]) OVER (PARTITION BY n.best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(n.best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM near{rounds} n JOIN c{rounds} c ON c.number = n.best[2]
"""


OP13_SQL = _centroid_sql(annulus.K, annulus.ROUNDS, annulus.DIM, annulus.SCALE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_store": op2_token_store,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_line_dedup": op5_line_dedup,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_personal_data": op7_personal_data,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_main_text": op9_main_text,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
