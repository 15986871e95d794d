"""Queries of the operators over the given tables, with SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from auditweave.llm import chat, edits, jaccard, language, mixing, negatives, neighbours, packing, quality, repeats, simhash, toxicity, trie
from auditweave.llm.base import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS varchar), '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
  r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
  w AS (SELECT *, ([5.0, 2.0, 1.0])[k % 3 + 1]::double AS weight, ([-0.5, 0.0, 0.5])[k % 3 + 1]::double AS slope,
    (2 * source_size)::double AS cap FROM r),
  p AS (SELECT *, (sum(source_size) OVER ()) * 1.5::double - coalesce(sum(cap) OVER before, 0) AS lft,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS rest FROM w
    WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l AS (SELECT *, first_value(CASE WHEN lft / rest * weight < cap THEN lft / rest END IGNORE NULLS)
    OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM p),
  t AS (SELECT source, source_size, slope, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l),
  c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS bigint) AS quota,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)) AS bigint) AS taken,
  round(CASE WHEN size > 0 AND start < quota THEN 2 * (start / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) END, 9) AS first_position
FROM c"""


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = toxicity.fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return toxicity.scored(docs, model).drop("text")


@query("op2_edits")
def op2_edits(spark, sf_dir):
    return edits.edit_report(table(spark, sf_dir, "documents"))


@query("op3_mixing", MIXING_SQL)
def op3_mixing(spark, sf_dir):
    """Words that the mix takes of every document, in the order in which training first reads it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    first = F.round(F.get("epochs", F.lit(0))["position"], 9)
    rows = mixing.mix(docs, F.col("words")).select("row.doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return mixing.range_sorted(rows, F.col("first_position"), F.xxhash64("doc_id"))


@query("op5_neighbours")
def op5_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


PERSPECTIVES_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
  c AS (SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'),
  p AS (SELECT t.*, c.assistant, CASE WHEN speaker = assistant THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
      ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
    FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
  r AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece,
    row_number() OVER w - 1 AS place,
    CAST(coalesce(sum(length(head) + length(text) + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start
    FROM p WINDOW w AS (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, assistant, place, turn, speaker, piece, start, length(piece) AS length, start + length(head) AS mask_start,
  CAST(CASE WHEN speaker = assistant THEN length(text) + 8 ELSE 0 END AS bigint) AS mask_length FROM r"""


@query("op6_perspectives", PERSPECTIVES_SQL)
def op6_perspectives(spark, sf_dir):
    """Every conversation from each participant's perspective, a row per turn."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    """Quality of every document; its source is the host, and the language the path within it."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return quality.judged(docs, model, F.col("source"), F.col("lang"))


@query("op9_language")
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = language.fit(docs.where("NOT held_out"))
    return language.identified(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query("op4_repeats")
def op4_repeats(spark, sf_dir):
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


TRIE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS varchar), ''),
      lambda x: [CAST(ascii(x) AS bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM t GROUP BY conv_id),
  l AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
  r AS (SELECT l.conv_id, t.place + 1 AS depth, role, text FROM l JOIN t ON t.conv_id = l.base AND t.place < l.h
    UNION ALL SELECT l.conv_id, l.head + t.place - l.h + 1, role, text FROM l JOIN t ON t.conv_id = l.conv_id AND t.place >= l.h),
  p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM l),
  g AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node),
  e AS (SELECT DISTINCT a.node, b.node AS parent FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
  k AS (SELECT parent, count(*) AS n_children FROM e GROUP BY parent),
  s AS (SELECT a.node, sum((x.n_convs - 1) * x.words) AS saved, count(*) FILTER (k.parent IS NULL) AS leaves
    FROM g x JOIN p a ON a.conv_id = x.conv_id AND a.depth <= x.depth LEFT JOIN k ON k.parent = x.node GROUP BY a.node),
  f AS (SELECT p.node, string_agg(CAST(p.conv_id AS varchar), ',' ORDER BY p.conv_id) AS ids
    FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) m ON m.conv_id = p.conv_id AND m.depth = p.depth GROUP BY p.node)
SELECT g.conv_id, CAST(g.depth AS bigint) AS depth, o.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS bigint) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM g JOIN s ON s.node = g.node LEFT JOIN k ON k.parent = g.node LEFT JOIN f ON f.node = g.node
  LEFT JOIN e ON e.node = g.node LEFT JOIN g o ON o.node = e.parent"""


@query("op11_trie", TRIE_SQL)
def op11_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS bigint) AS score
    FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS integer) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op12_negatives", NEGATIVES_SQL)
def op12_negatives(spark, sf_dir):
    """The three hardest negatives of each anchor and positive."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4
    THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
  n AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(list_sort(shingles), chr(10))) AS node, shingles FROM s),
  c AS (SELECT node, any_value(n) AS n, min(doc_id) AS least, any_value(shingles) AS shingles FROM n WHERE n > 0 GROUP BY node),
  e AS (SELECT least, n, unnest(shingles) AS shingle FROM c),
  l AS (SELECT x.least AS a, y.least AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.least <> y.least AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY x.least, y.least, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
  r AS (SELECT least AS doc, least AS other FROM c UNION SELECT r.doc, l.b FROM r JOIN l ON l.a = r.other)
SELECT n.doc_id, CAST(n.n AS bigint) AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE g.component_id END AS component_id
FROM n LEFT JOIN c ON c.node = n.node AND n.n > 0 LEFT JOIN (SELECT doc, min(other) AS component_id FROM r GROUP BY doc) g ON g.doc = c.least"""


@query("op13_jaccard", JACCARD_SQL)
def op13_jaccard(spark, sf_dir):
    """Components of documents whose sets of four-word shingles are 85 % alike."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
