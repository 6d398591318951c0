"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .centroids import centroids
from .chat_format import digests, format_conversations
from .decontaminate import matches
from .html_text import main_texts
from .jaccard_join import jaccard_join
from .common import modest
from . import pii, quality
from .language_id import languages
from .neighbours import nearest
from .packing import pack
from .repeats import repeats
from .simhash import near_copies


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids (comma-joined, ascending), similarity, first_word."""
    found = matches(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.array_join("item_ids", ",").alias("item_ids"), "similarity", "first_word")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_read(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(_read(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_read(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows, tokenizer_file("byte_bpe_50k.json")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_read(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(_read(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_neighbours": op2_neighbours,
    "op3_html_text": op3_html_text,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_repeats": op5_repeats,
    "op6_decontamination": op6_decontamination,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "op11_simhash": op11_simhash,
    "op12_centroids": op12_centroids,
    "op13_alignment": op13_alignment,
}

def _centroids_sql(rounds: int = 5) -> str:
    """The rounds written out: c<n> are the centroids of a round, a<n> each vector's nearest."""
    near = "SELECT n, v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT n, v, c, (list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m))::BIGINT AS d FROM v, {}) GROUP BY n, v"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL) QUALIFY c < 40)",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(f'c{r}')})",
            f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS k FROM (SELECT c, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL)",
            f"f{r} AS (SELECT c, list(((s - ((s % k) + k) % k) // k)::DOUBLE ORDER BY i) AS m FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f.m, o.m) AS m FROM c{r} o LEFT JOIN f{r} f USING (c))",
        ]
    return f"""WITH {', '.join(parts)}, a AS MATERIALIZED ({near.format(f"c{rounds}")})
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a JOIN v USING (n) JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op12_centroids": _centroids_sql(),
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN g x ON x.doc_id = p.a JOIN g y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (len(x.s) + len(y.s) - p.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM g UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, m.component_id FROM g JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1) m USING (doc_id)
""",
}
