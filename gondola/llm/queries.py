"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import align, bpe, embed_dedup, fim, iblt, lines, minhash, mixing, quality, shared, sharding, token_files, url_filter, warc

#: Folder of the public tokenizers' files, where another than the installed package's is wanted.
TOKENIZERS = os.environ.get("GONDOLA_TOKENIZERS")


def tokenizer(name: str) -> str:
    """A vocabulary file: below TOKENIZERS where that is set, else of the installed package."""
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = warc.WarcParams(least_bytes=0)
    index = warc.write_archives(table(spark, sf_dir, "pages"), shared.work_path(spark, "warc"), params)
    return warc.page_report(warc.read_records(index, params))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), embed_dedup.EmbedParams(threshold=0.98))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = token_files.TokenFileParams(end_id=1)
    index = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), shared.work_path(spark, "tokens"), params)
    return token_files.with_starts(index, token_files.read_tokens(index, params)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashParams(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = table(spark, sf_dir, "documents"), quality.QualityParams()
    model = quality.train(docs, table(spark, sf_dir, "labels"), params)
    return docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.scored(model, F.col("text"), params).alias("score")).select(
        "*", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "position")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.encoded(tokenizer("byte_bpe_50k.tiktoken"), F.col("text")).alias("x")).select("doc_id", "x.*")


#: The rules that the query applies.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.bounded_batches(spark)
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", url_filter.verdicts(spark, F.col("url"), URL_RULES).alias("x")).select("page_id", "x.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = fim.FimParams(unit="line", rate=100, spm_rate=50, seed=7)
    found = fim.transformed(table(spark, sf_dir, "documents"), params)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fim.restored(F.col("output"), F.col("form"), params), 256).alias("restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduped(table(spark, sf_dir, "documents"), lines.LineParams(least_chars=20, least_docs=3))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("doc.text", 256).alias("kept_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.aligned(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    counts = align.pair_counts(rows, shared.work_path(spark, "pair-counts"))
    return align.with_counts(rows, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_embedding_dedup, op3_token_files, op4_minhash, op5_sharding, op6_quality, op7_mixing,
           op8_fingerprints, op9_byte_bpe, op10_url_filter, op11_fill_in_middle, op12_line_dedup, op13_alignment, pipeline)
    return {f.__name__: f for f in own}


_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)


def _crc_table() -> list[int]:
    """crc32 of each byte, from its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


#: SQL of the unsigned crc32 of a text's bytes, as 8 bits at a time.
_CRC_SQL = f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

#: SQL of the words of a text, A-Z in lower case.
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> (15 - 5 * j)) & 31), 1), '' ORDER BY g, j) AS payload_digest
  FROM (SELECT h, g, j, ('0x' || substr(h, 1 + 5 * g, 5))::INTEGER AS v FROM (SELECT DISTINCT h FROM d), range(8) a(g), range(4) c(j))
  GROUP BY h),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN b USING (h) JOIN f USING (h)""",
    "op10_url_filter": rf"""
WITH r(v, h, p) AS (VALUES {_RULES_SQL}),
s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM s),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p) * 10000 + length(h)) AS rule, arg_max(v, length(h || p) * 10000 + length(h)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, low AS component_id, vec_id = low AS kept FROM v JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x""",
    "op4_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS k FROM w),
g AS (SELECT doc_id, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS g FROM t WHERE n >= 3 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z zx ON x = zx.doc_id JOIN z zy ON y = zy.doc_id WHERE 100 * c >= 85 * (zx.n + zy.n - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept FROM documents d JOIN c ON d.doc_id = c.x LEFT JOIN z ON d.doc_id = z.doc_id""",
    "op5_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, md5(t) AS h, {_CRC_SQL} AS crc FROM d),
o AS (SELECT *, row_number() OVER w - 1 AS rank, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM r WINDOW w AS (ORDER BY h, doc_id)),
e AS (SELECT *, min(a) OVER (PARTITION BY h) AS g0, max(a + size) OVER (PARTITION BY h) AS g1, sum(size) OVER ()::BIGINT AS total FROM o),
c AS (SELECT CASE WHEN g1 - g0 <= total // 8 THEN CASE WHEN 2 * target < g0 + g1 THEN g0 ELSE g1 END WHEN 2 * target < 2 * a + size THEN a ELSE a + size END AS cut
  FROM (SELECT *, total * k // 8 AS target FROM e, range(1, 8) x(k)) WHERE a <= target AND target < a + size),
s AS (SELECT *, (SELECT count(*) FROM c WHERE cut <= a)::INT AS shard FROM e)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s""",
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[k % 3 + 1] AS w, ([0.5, 0.0, -0.5]::DOUBLE[])[k % 3 + 1] AS tilt, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM z),
b AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS cap0, coalesce(sum(w) OVER before, 0) AS w0, sum(w) OVER () AS w1 FROM w
  WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(cap <= (wanted - cap0) / nullif(w1 - w0, 0) * w, true) AS full_ FROM b),
t AS (SELECT source, source_size, tilt AS a, CASE WHEN full_ THEN cap ELSE (wanted - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT full_ THEN w END) OVER () END AS target FROM f),
r AS (SELECT doc_id, d.source, size, source_size, target, a, floor(target)::BIGINT AS want,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, coalesce(want // nullif(source_size, 0), 0) AS rounds FROM r),
p AS (SELECT *, greatest(0, least(size, want - rounds * source_size - gone)) AS part, least(1.0::DOUBLE, gone::DOUBLE / want) AS u FROM q)
SELECT doc_id, source, size, source_size, target, (rounds * size + part)::BIGINT AS taken,
  CASE WHEN rounds > 0 OR part > 0 THEN CASE WHEN a = 0 THEN u ELSE ((1 + a) - sqrt(greatest(0.0::DOUBLE, (1 + a) * (1 + a) - 4 * a * u))) / (2 * a) + 0.0::DOUBLE END END AS position FROM p""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, list_transform(range(4), lambda k: ('0x' || substr(h, 1 + 8 * k::INT, 8))::BIGINT) AS h FROM d),
n AS (SELECT *, len(l) AS n, h[1] % (len(l) + 1) AS a, h[2] % (len(l) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s FROM n)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c""",
    "op12_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM d),
y AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS last FROM y WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
z AS (SELECT y.*, coalesce(doc_id <> last, false) AS gone FROM y LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM z GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
