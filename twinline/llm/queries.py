"""Queries over the operators of this subpackage, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinline.llm import alignment, duckbpe, imatch, langid, linediff, mtree, multiindex, packing, quality, simhash, subvectors, suffixes, toolcalls
from twinline.llm.common import table


def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


#: Tools that the turns of `conversations` call, their closed schemas, and how many words make a question long.
TOOLS = [("configure", False, [("text", "string", True)]),
         ("lookup", True, [("limit", "integer", True), ("query", "string", True), ("turn", "integer", False)]),
         ("search", True, [("exact", "boolean", True), ("limit", "integer", True), ("query", "string", True), ("turn", "integer", False)])]
LONG_QUESTION = 25


def op2_tool_calls(spark, sf_dir):
    """Every turn of `conversations` becomes part of a tool log, as the table holds no calls of its own.

    A system or user turn is a call, an assistant turn the result of the call one turn
    before. A call follows the one two turns before. Short questions are lookups, others
    searches; the number of sentences is their limit, left out where there is none, and
    the only fault of a question without a full stop is then that it is missing.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    ident = lambda t: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), t)
    stops = F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    words = F.size(F.split("text", " "))
    name = F.when(F.col("role") == "system", "configure").when(words < LONG_QUESTION, "lookup").otherwise("search")
    arguments = (F.when(F.col("role") == "system", F.to_json(F.struct("text")))
                 .otherwise(F.to_json(F.struct(F.col("turn"), F.col("text").alias("query"), F.when(stops > 0, stops).alias("limit"),
                                               F.when(words >= LONG_QUESTION, F.col("text").contains(",")).alias("exact")))))
    calls = turns.where("role <> 'assistant'").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"),
                                                      F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, closed boolean, fields array<struct<name:string,type:string,required:boolean>>")
    return toolcalls.link_log(calls, results, schemas)


OP2_SQL = """
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, role, text, length(text) - length(replace(text, '.', '')) AS stops, len(string_split(text, ' ')) AS words FROM turns WHERE role <> 'assistant'),
named AS (SELECT *, CASE WHEN role = 'system' THEN 'configure' WHEN words < 25 THEN 'lookup' ELSE 'search' END AS name FROM calls),
chain AS (SELECT c.conv_id, c.turn, 0::BIGINT AS depth FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
          UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM chain JOIN calls c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 2),
answers AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM turns WHERE role = 'assistant')
SELECT coalesce(n.conv_id, a.conv_id) AS conv_id, coalesce(n.call_id, a.call_id) AS call_id, depth, coalesce(n.turn, a.turn) AS turn, name,
  CASE WHEN n.call_id IS NULL THEN 'orphan' WHEN name <> 'configure' AND stops = 0 THEN 'invalid' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN n.call_id IS NOT NULL THEN CASE WHEN name <> 'configure' AND stops = 0 THEN 'missing:limit' ELSE '' END END AS faults,
  (n.call_id IS NOT NULL)::BIGINT AS repeats,
  '{"arguments":' || CASE WHEN n.call_id IS NULL THEN 'null' WHEN name = 'configure' THEN '{"text":' || to_json(n.text)::VARCHAR || '}'
     ELSE '{' || CASE WHEN name = 'search' THEN '"exact":' || contains(n.text, ',')::VARCHAR || ',' ELSE '' END || CASE WHEN stops > 0 THEN '"limit":' || stops || ',' ELSE '' END
          || '"query":' || to_json(n.text)::VARCHAR || ',"turn":' || n.turn || '}' END
  || ',"id":' || to_json(coalesce(n.call_id, a.call_id))::VARCHAR || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS json
FROM named n FULL JOIN answers a ON a.call_id = n.call_id AND a.conv_id = n.conv_id LEFT JOIN chain c ON c.conv_id = n.conv_id AND c.turn = n.turn
"""


def op3_imatch(spark, sf_dir):
    return imatch.imatch(table(spark, sf_dir, "documents"))


def op4_retrieval_packing(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_suffix_repeats(spark, sf_dir):
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers
    return duckbpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_multi_index(spark, sf_dir):
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_line_alignment(spark, sf_dir):
    docs = linediff.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return docs.select("doc_id", "removed", lines.alias("kept_lines"), F.sha2("text", 256).alias("text_sha256"))


def op11_subvectors(spark, sf_dir):
    return subvectors.cluster(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers
    return alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                  public_tokenizers.path("piece_bpe_32k.model"))


def op13_mtree(spark, sf_dir):
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def _sublexicons(name: str, digests: str) -> str:
    """The array of sublexicon hashes of a list of digests."""
    held = [f"array_to_string(list_filter({digests}, lambda d: substr(d, {at}, {digits}) < '{values:0{digits}x}'), ',')" for at, digits, values in imatch.SUBLEXICONS]
    return f"list_transform([{', '.join(held)}], lambda h: CASE WHEN h = '' THEN '' ELSE substr(md5(h), 1, 16) END) AS {name}"


def _likeness(a: str, b: str) -> str:
    used = f"list_filter(range(1, {len(imatch.SUBLEXICONS) + 1}), lambda i: {a}[i] <> '' OR {b}[i] <> '')"
    return f"CASE WHEN len({used}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({used}, lambda i: {a}[i] = {b}[i]))::DOUBLE / len({used}) END"


_TERMS = (f"list_distinct(list_filter(string_split_regex(translate({{}}, '{imatch.UPPER}', '{imatch.LOWER}'), "
          r"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> ''))")
_CHOSEN = f"""list_transform(list_sort(CASE WHEN len(list_filter({{0}}, lambda t: list_contains(words, t))) >= {imatch.FEW}
  THEN list_filter({{0}}, lambda t: list_contains(words, t)) ELSE {{0}} END), lambda t: md5(t))"""
OP3_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id, text) AS place, count(*) OVER () AS n FROM documents),
lexicon AS (SELECT coalesce(list(term), []) AS words FROM (SELECT term FROM (SELECT unnest({_TERMS.format('text')}) AS term FROM docs) GROUP BY term
  HAVING count(*) >= greatest(1, {imatch.LEAST_SHARE} * (SELECT count(*) FROM docs)) AND count(*) <= {imatch.MOST_SHARE} * (SELECT count(*) FROM docs))),
joined AS (SELECT a.*, b.text AS next_text, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM docs a JOIN docs b ON b.place = a.place % a.n + 1),
listed AS (SELECT *, {_TERMS.format('text')} AS t, {_TERMS.format('edited')} AS u, {_TERMS.format('next_text')} AS v FROM joined, lexicon),
digests AS (SELECT * EXCLUDE (t, u, v), {_CHOSEN.format('t')} AS t, {_CHOSEN.format('u')} AS u, {_CHOSEN.format('v')} AS v FROM listed),
prints AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_sublexicons('f', 't')}, {_sublexicons('e', 'u')}, {_sublexicons('x', 'v')} FROM digests)
SELECT doc_id, n_chars, edited_sha256, array_to_string(f, '-') AS fingerprint, array_to_string(e, '-') AS edited_fingerprint,
  {_likeness('f', 'e')} AS near_edited, {_likeness('f', 'x')} AS near_next FROM prints
"""

OP5_SQL = r"""
WITH docs AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS g,
  regexp_matches(text, '^[\x20\x09-\x0D]') AS led FROM documents),
words AS MATERIALIZED (SELECT doc_id, led, len(w) AS n, unnest(w) AS word, unnest(list_resize(g, len(w), '')) AS gap, unnest(range(len(w))) AS i FROM docs WHERE len(w) > 0),
places AS MATERIALIZED (SELECT doc_id, i, sum(strlen(word) + strlen(coalesce(gap, ''))) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN led THEN 0 ELSE strlen(coalesce(gap, '')) END AS end_byte, strlen(word) AS size FROM words),
-- the hash of 50 words from those of 32, 16 and 2, each made of two of half its length
h1 AS (SELECT doc_id, n, i, hash(word) AS a FROM words WHERE n >= 50),
h2 AS (SELECT *, hash(a, lead(a) OVER (PARTITION BY doc_id ORDER BY i)) AS b FROM h1),
h4 AS (SELECT *, hash(b, lead(b, 2) OVER (PARTITION BY doc_id ORDER BY i)) AS c FROM h2),
h8 AS (SELECT *, hash(c, lead(c, 4) OVER (PARTITION BY doc_id ORDER BY i)) AS d FROM h4),
h16 AS (SELECT *, hash(d, lead(d, 8) OVER (PARTITION BY doc_id ORDER BY i)) AS e FROM h8),
h32 AS (SELECT *, hash(e, lead(e, 16) OVER (PARTITION BY doc_id ORDER BY i)) AS f FROM h16),
h50 AS (SELECT doc_id, n, i, hash(f, lead(e, 32) OVER (PARTITION BY doc_id ORDER BY i), lead(b, 48) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h32),
passages AS MATERIALIZED (SELECT doc_id, i AS p, h FROM h50 WHERE i + 50 <= n),
firsts AS (SELECT h, min(doc_id) AS first FROM passages GROUP BY h),
later AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM passages JOIN firsts USING (h) WHERE first < doc_id),
spans AS (SELECT doc_id, min(p) AS first_word, max(p) + 50 - min(p) AS n_words FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM later) GROUP BY doc_id, island)
SELECT s.doc_id, first_word, n_words, CAST(a.end_byte - a.size AS BIGINT) AS first_byte, CAST(b.end_byte AS BIGINT) AS end_byte
FROM spans s JOIN places a ON a.doc_id = s.doc_id AND a.i = first_word JOIN places b ON b.doc_id = s.doc_id AND b.i = first_word + n_words - 1
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach AS (SELECT DISTINCT a AS n, a AS m FROM links UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.m),
lowest AS (SELECT n, min(m) AS m FROM reach GROUP BY n), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(counts.n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN lowest ON lowest.n = vec_id
"""

_SOUND = "embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_ROUND = """nearest{i} AS MATERIALIZED (SELECT row, arg_min(c, list_dot_product(list_transform(list_zip(v, m), lambda z: (z[1] - z[2])::DOUBLE), list_transform(list_zip(v, m), lambda z: (z[1] - z[2])::DOUBLE)) * 16 + c) AS c
  FROM kept, centroids{i} GROUP BY row),
centroids{n} AS MATERIALIZED (SELECT o.c, coalesce(w.m, o.m) AS m FROM centroids{i} o LEFT JOIN (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS m
  FROM (SELECT c, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM nearest{i} JOIN kept USING (row), range(1, 65) r(i) GROUP BY c, i) GROUP BY c) w ON w.c = o.c)"""
#: Doubles hold all sums of the given tables exactly, so the floor of a quotient is exact, too.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)::BIGINT) AS v FROM embeddings WHERE {_SOUND} AND len(embedding) = 64),
centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
{", ".join(_ROUND.format(i=i, n=i + 1) for i in range(3))},
far AS MATERIALIZED (SELECT row, vec_id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, centroids3),
last AS MATERIALIZED (SELECT row, vec_id, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM far GROUP BY row, vec_id)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN centroids3 USING (c)
"""

OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings WHERE {_SOUND}),
pairs AS (SELECT q.row AS q, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_tool_calls, op3_imatch, op4_retrieval_packing, op5_suffix_repeats,
                                      op6_quality, op7_byte_bpe, op8_multi_index, op9_simhash, op10_line_alignment, op11_subvectors, op12_token_alignment,
                                      op13_mtree)}
ORACLES: dict[str, str] = {"op2_tool_calls": OP2_SQL, "op3_imatch": OP3_SQL, "op5_suffix_repeats": OP5_SQL, "op8_multi_index": OP8_SQL,
                           "op11_subvectors": OP11_SQL, "op13_mtree": OP13_SQL}
