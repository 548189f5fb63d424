"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_chars_left", (F.col("n_removed") > 0).alias("has_repeats"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), word_bpe(), digests=True)


@query
def op9_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_languages

    return predict_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words of a text as the decontamination takes them, in DuckDB.
WORDS_SQL = r"regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')"

ORACLES["op6_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, CAST(count(*) AS INT) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, CAST(count(*) AS INT) AS n_shared
FROM bs JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""


@query
def op1_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_template_lines

    docs = table(spark, sf_dir, "documents")
    out = drop_template_lines(docs)
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars_left"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines_left"), F.sha2("text", 256).alias("text_sha256"))


def lines_oracle() -> str:
    """The template tree in DuckDB, with the operator's default parameters."""
    return r"""
WITH base AS (SELECT doc_id, text, sha256(text) AS v, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, v, i - 1 AS ln, list_transform(list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks
      FROM (SELECT doc_id, v, ls, unnest(range(1, len(ls) + 1)) AS i FROM base)),
k AS (SELECT doc_id, v, ln, toks, len(toks) AS size, toks[1:3] AS lead FROM l WHERE len(toks) >= 4),
b AS (SELECT size, lead, toks, count(DISTINCT v) AS n FROM k GROUP BY ALL),
p AS (SELECT size, lead, toks, n, j AS place, toks[j] AS token FROM (SELECT *, unnest(range(1, size + 1)) AS j FROM b)),
t AS (SELECT size, lead, sum(n) AS total FROM b GROUP BY ALL),
s AS (SELECT size, lead, place, token, sum(n) AS m FROM p WHERE token <> '<*>' GROUP BY ALL),
c AS (SELECT 'plain' AS kind, size, lead, place, token FROM s WHERE m >= 10 UNION ALL SELECT 'share', size, lead, place, token FROM s JOIN t USING (size, lead) WHERE m >= 2 AND 100 * m >= 20 * total),
f AS (SELECT kind, size, lead, toks, list((place, token) ORDER BY place) AS constants FROM p JOIN c USING (size, lead, place, token) GROUP BY ALL HAVING 100 * count(*) >= 60 * size
      UNION ALL SELECT 'whole', size, lead, toks, list((place, token) ORDER BY place) FROM p WHERE size >= 20 GROUP BY ALL HAVING 100 * count(*) FILTER (token <> '<*>') >= 60 * size),
m AS (SELECT k.doc_id, k.v, k.ln, f.kind, k.size, k.lead, f.constants FROM k JOIN f USING (size, lead, toks)),
o AS (SELECT kind, size, lead, constants, min((doc_id, ln)) AS first FROM m GROUP BY ALL HAVING count(DISTINCT v) >= CASE WHEN size >= 20 THEN 2 ELSE 10 END),
g AS (SELECT doc_id, list(DISTINCT ln) AS gone FROM m JOIN o USING (kind, size, lead, constants) WHERE (doc_id, ln) <> first GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text FROM base LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_left, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines_left, sha256(text) AS text_sha256 FROM r
"""


ORACLES["op1_template_line_dedup"] = lines_oracle()


@query
def op2_crf_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_labels import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("labels")


@query
def op4_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_re_pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import round_trip

    return round_trip(table(spark, sf_dir, "documents"), word_bpe())


@query
def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_repair import repair_roles

    return repair_roles(table(spark, sf_dir, "conversations"))


@query
def op12_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLES["op12_slot_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor, other AS pos, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, pos AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, pos ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
QUALIFY row_number() OVER (PARTITION BY p.anchor, pos ORDER BY score DESC, other) <= 3
"""


@query
def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompression import remove_repeated_words

    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS v(k))),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k > 1 AND a >= 10),
h AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT h.lang, h.phrase, h.a, j, x.a AS l, y.a AS r, (1000000 * h.a * h.a) // (x.a * y.a) AS score FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.tail),
b AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a AS longer FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3),
gone AS (SELECT DISTINCT lang, phrase FROM longer JOIN c USING (lang, phrase) WHERE 100 * longer >= 50 * c.a),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN gone USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
