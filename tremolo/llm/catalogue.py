"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .language_id import identify
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .periodic_runs import periodic_runs, repeat_tails, run_digest
from .pii import find_pii, pii_digest
from .quality_ranker import THRESHOLD, rank_quality
from .source_divergence import source_divergence
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .topk_search import top_k

ORACLES: dict[str, str] = {}
LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts, the winner and the size of each group; history is the half of the ids with an even crc32."""
    return exact_dedup(_read(spark, sf_dir, "documents")).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


ORACLES["op5_exact_dedup"] = f"""
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
  FROM (SELECT doc_id, {LOWER_AZ} AS t FROM documents))
"""

def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150% of all words takes from each document."""
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLES["op7_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS r FROM s),
k AS (SELECT r, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(cap) FROM c x WHERE x.r <= y.r), 0)) / (SELECT sum(w) FROM c x WHERE x.r > y.r) AS level, (SELECT min(r) FROM c x WHERE x.r > y.r) AS next
  FROM (SELECT -1.0::DOUBLE AS r UNION SELECT r FROM c) y),
l AS (SELECT level FROM k WHERE next > level ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap <= coalesce((SELECT level FROM l), 1e300) * w THEN cap ELSE (SELECT level FROM l) * w END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, floor(target)::BIGINT - whole * source_size AS rest FROM p),
o AS (SELECT d.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS run, sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS tie FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
  (whole * size + CASE WHEN run <= rest THEN size WHEN run - tie <= rest THEN floor((rest - run + tie) * size / greatest(tie, 1)) ELSE 0 END)::BIGINT AS taken
FROM o
"""


def tokenizer_spec(path: str | None = None) -> str:
    """The JSON of the byte-level BPE tokenizer; ``path`` is a parameter, its default the installed public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 ids, in the sources' own proportions."""
    return pack(_read(spark, sf_dir, "documents"), tokenizer_spec())


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the ids whose crc32 mod 5 isn't 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return identify(_read(spark, sf_dir, "documents")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles are 85% alike."""
    return near_dedup(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLES["op10_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({LOWER_AZ}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON c.d = doc_id LEFT JOIN n USING (doc_id)
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document when 13-word passages of smaller ids go."""
    return substring_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM f WHERE m < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, n: NOT list_contains(coalesce(gone, []), n)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer inner products of every hundredth vector against all others."""
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


ORACLES["op2_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that alignment with earlier documents removes, and a digest of what stays."""
    return line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans and those that learned contexts add."""
    return pii_digest(find_pii(_read(spark, sf_dir, "documents")))


def unigram_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model; ``path`` is a parameter, its default the installed public file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every whole text."""
    return token_counts(_read(spark, sf_dir, "documents"), unigram_vocabulary())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each of them off."""
    return source_divergence(_read(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e QUALIFY part = 'pair' OR rank <= 10
"""


def op12_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from the labels of ids whose crc32 mod 4 isn't 2."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    scored = rank_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), learn)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text, and what stays when each run keeps its first period."""
    return run_digest(periodic_runs(repeat_tails(_read(spark, sf_dir, "documents"))))


# The checksum goes through the bytes of the id: -1 stands for a shift, any other item for a byte.
ORACLES["op13_periodic_runs"] = r"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x = -1 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END, 4294967295::BIGINT)) AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM h),
p AS (SELECT *, 1 + (n - a) // k AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
t AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM d),
e AS (SELECT a.r, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e),
s AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT r, s, l, min(q) AS q FROM s GROUP BY 1, 2, 3),
b AS (SELECT r, count(*) AS n_runs, arg_min([s, l, q], [-l, s, q]) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM u GROUP BY 1),
z AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS j FROM u),
y AS (SELECT t.r, string_agg(x, ' ' ORDER BY i) AS kept FROM t ANTI JOIN z ON z.r = t.r AND z.j = t.i GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN y USING (r)
"""


_ALL = (
    op1_language_id, op2_topk_search, op3_line_dedup, op4_pii, op5_exact_dedup, op6_substring_dedup,
    op7_mixing, op8_packing, op9_token_counts, op10_near_dedup, op11_source_divergence,
    op12_quality_ranking, op13_periodic_runs,
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
