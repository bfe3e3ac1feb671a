"""The registered queries of this package, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, gif, html, jaccard, packing, quality, ranked, sharding, spm, suffix, tokencount, toxicity, vptree

#: Bytes of a shard and of a packed sequence; where the tokenizer is; segmentations of a text.
SHARD_LIMIT, SEQUENCE = 1 << 20, 8192
SAMPLES = 2
#: Tokens beyond which a text is over its limit.
TOKENS = 4096


def tokenizer_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored_texts(_table(spark, sf_dir, "documents"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.extendible_shards(docs, "doc_id", "n_bytes", SHARD_LIMIT)


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op6_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.packed_apart(docs, F.octet_length("text"), SEQUENCE)


def op8_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.sampled_segmentations(_table(spark, sf_dir, "documents"), spm.Vocabulary.load(tokenizer_path()), SAMPLES)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_report(_table(spark, sf_dir, "documents"))


def op10_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), TOKENS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_gif, op2_attention_quality, op3_extendible_sharding, op4_grouped_prefix_join, op5_text_density, op6_vantage_point_search, op7_best_fit_packing, op8_gumbel_segmentations, op9_suffix_array_dedup, op10_factorization_toxicity, op11_ranked_search, op12_phrase_collocations, op13_token_counts)}

_OP3 = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
    FROM documents),
depths AS (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS d),
nodes AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b FROM docs, depths GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, h, min(d) AS d FROM docs JOIN nodes ON h >> (60 - d) = p WHERE b <= {SHARD_LIMIT} GROUP BY ALL)
SELECT doc_id, n_bytes,
    CASE WHEN leaf.d = 0 THEN '' ELSE lpad(bin(h >> (60 - leaf.d)), leaf.d, '0') END AS shard,
    leaf.d AS local_depth, CAST(b AS BIGINT) AS shard_bytes, CAST(0 AS BIGINT) AS page
FROM leaf JOIN nodes ON leaf.d = nodes.d AND h >> (60 - leaf.d) = p
"""
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
docs AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
item AS (SELECT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark)),
scored AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
    FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (r), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 20
"""
_OP12 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM listed, sizes WHERE len(w) >= k)),
counts AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.k, c.p, c.f AS a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM counts WHERE k > 1) c
    JOIN counts x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, cut)
    JOIN counts y ON y.lang = c.lang AND y.p = list_slice(c.p, cut + 1, c.k)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
longer AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS most FROM (SELECT lang, k, p, f, m, unnest(generate_series(1, k - m + 1)) AS i FROM counts, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank, array_to_string(b.p, ' ') AS phrase, a, l, r, score
    FROM lowest b LEFT JOIN longer USING (lang, p) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
ORACLES: dict[str, str] = {"op3_extendible_sharding": _OP3, "op11_ranked_search": _OP11, "op12_phrase_collocations": _OP12}
