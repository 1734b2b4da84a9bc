"""Texts: pages and documents, their chunks, claims, phrases and age, and retrieval by vectors.

Stand-ins for retrieval: vectors are the chunks, and the document of the same number is a chunk's text; English
ones are internal, the others external; a label is a document of chunks; vector 7 is the question.
"""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.exprs import ENTITIES, NUMERIC_CLAIM, html_text, looked_up, numeric_claim
from gondola.operators.chunks import SubwordTokenizer, chunks
from gondola.operators.grounding import INJECTION, MARKER, TIER_DAYS, guarded, injections, stale
from gondola.operators.joins import top_k_cosine
from gondola.operators.vectors import nearest
from gondola.plans.core import sql_lookup
from gondola.plans.registry import query, r, view
from gondola.sources.tables import table

_PHRASE = " OR ".join(f"contains(lower(text), '{p}')" for p in INJECTION)


def chunk_key(doc_id: Column, chunk_no: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), chunk_no.cast("string")), 256)


@query(f"SELECT doc_id, regexp_matches(text, '{NUMERIC_CLAIM}') AS claim, sha256(doc_id || ':0') AS chunk_id, sha256(text) AS content_hash, {_PHRASE} AS flagged FROM documents")
def document_flags(spark, sf):
    """Claim and injection phrases of whole documents, their hash, and the id of their first chunk; `chunk_docs` has all chunks."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", numeric_claim(text).alias("claim"), chunk_key(F.col("doc_id"), F.lit(0)).alias("chunk_id"), F.sha2(text, 256).alias("content_hash"),
        F.when(text.isNotNull(), F.size(injections(text)) > 0).alias("flagged"))


@query(None)
def chunk_docs(spark, sf):
    """All chunks of all documents, each with its own id, claim and injection phrases."""
    text = F.col("chunk")
    return chunks(table(spark, sf, "documents"), "doc_id", "text").select(
        "doc_id", "chunk_no", chunk_key(F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"), "heading", "tokens", "chunk", numeric_claim(text).alias("claim"), injections(text).alias("phrases")).withColumn(
        "flagged", F.size("phrases") > 0)


#: The vocabulary of `chunk_docs_subword`: a file below this folder, else of the installed package.
VOCABULARY = "byte_bpe_50k.json"


@query(None)
def chunk_docs_subword(spark, sf):
    """Chunks by tokens of a byte-level vocabulary instead of words: the limits of a model that reads such tokens."""
    import public_tokenizers

    folder = os.environ.get("GONDOLA_TOKENIZERS")
    path = os.path.join(folder, VOCABULARY) if folder else str(public_tokenizers.path(VOCABULARY))
    found = chunks(table(spark, sf, "documents"), "doc_id", "text", partial(SubwordTokenizer, path))
    return found.select("doc_id", "chunk_no", chunk_key(F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"), "heading", "tokens", "chunk")


def _entities_sql(x: str) -> str:
    for entity, char in ENTITIES.items():
        x = f"replace({x}, '{entity}', {chr(39) + char.replace(chr(39), chr(39) * 2) + chr(39)})"
    return x


def _html_sql(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "header", "footer"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', chr(10), 'g')"
    out = _entities_sql(out)
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\r\\f]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


view("v_page_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")


@query("SELECT page_id, text, CASE WHEN length(text) >= 500 THEN text END AS accepted FROM v_page_text")
def html_to_text(spark, sf):
    """The visible lines of pages; accepted are those with 500 characters at least."""
    html = F.col("html")
    text = html_text(html)
    return table(spark, sf, "pages").select("page_id", text.alias("text")).withColumn("accepted", F.when(F.char_length("text") >= 500, F.col("text")))


@query("SELECT page_id, left(url, 20) AS title FROM pages WHERE url LIKE '%example.com/%' ORDER BY page_id")
def url_like(spark, sf):
    """A LIKE lookup, and titles cut to a length."""
    return table(spark, sf, "pages").where(F.col("url").like("%example.com/%")).select("page_id", F.left("url", F.lit(20)).alias("title")).orderBy("page_id")


#: Characters of a title that are kept.
TITLE = 40
_TITLE_SQL = f"""nullif(trim({_entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '')"""


@query(f"SELECT page_id, left(t, {TITLE}) AS title, length(t) > {TITLE} AS was_cut, t LIKE '%***%' AS starred, url LIKE 'https://%.example.org/%' AS of_site FROM (SELECT page_id, url, {_TITLE_SQL} AS t FROM pages)")
def page_titles(spark, sf):
    """Titles out of pages, cut to a length, and what LIKE says of them and of the address; null without a title."""
    t = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    x = table(spark, sf, "pages").select("page_id", "url", F.nullif(F.trim(t), F.lit("")).alias("t"))
    return x.select("page_id", F.left("t", F.lit(TITLE)).alias("title"), (F.char_length("t") > TITLE).alias("was_cut"), F.col("t").like("%***%").alias("starred"), F.col("url").like("https://%.example.org/%").alias("of_site"))


#: Stand-ins: what kind of document an order's priority is.
TIERS = {"1-URGENT": "earnings_call", "2-HIGH": "sec_filing", "3-MEDIUM": "industry_research", "4-NOT SPECIFIED": "gov_methodology", "5-LOW": "internal_doc"}
_AGE = "date_diff('day', day, today)"
_LATE = " ".join(f"WHEN '{t}' THEN {'false' if d is None else f'{_AGE} > {d}'}" for t, d in TIER_DAYS.items())


@query(f"SELECT o_orderkey AS document, tier, {_AGE}::BIGINT AS days, CASE tier {_LATE} END AS stale FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {sql_lookup('o_orderpriority', TIERS, 'NULL')} AS tier FROM orders), (SELECT CAST(max(ts) AS DATE) AS today FROM events)")
def staleness_flag(spark, sf):
    """Are documents older than their tier allows, at the day of the latest event?  Orders stand in for documents, with their dates."""
    today = F.broadcast(table(spark, sf, "events").agg(F.to_date(F.max("ts")).alias("today")))  # one row
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document"), looked_up(F.col("o_orderpriority"), TIERS, None).alias("tier"), F.to_date("o_orderdate").alias("day")).crossJoin(today)
    return x.select("document", "tier", F.date_diff("today", "day").cast("long").alias("days"), stale(F.col("tier"), F.col("day"), F.col("today")).alias("stale"))


# --- retrieval ------------------------------------------------------------------------------------

view("v_chunk", "SELECT vec_id, label, embedding::DOUBLE[] AS e, text, lang = 'en' AS internal FROM embeddings JOIN documents ON doc_id = vec_id")
_FAR = r("1 - list_cosine_similarity(e, (SELECT e FROM v_chunk WHERE vec_id = 7))", 6)


def corpus(spark, sf) -> DataFrame:
    """Vectors and what scopes are made of; no text."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").alias("internal"))
    return e.join(d, e.vec_id == d.doc_id).select("vec_id", "label", "embedding", "internal")


def searched(base: DataFrame, texts: DataFrame, question: DataFrame, scope: Column, k: int = 5, untrusted: Column | None = None) -> DataFrame:
    """The k nearest chunks within a scope, which is filtered before distances are taken; then the texts (doc_id, text) of these k; untrusted ones are scanned and marked."""
    near = F.broadcast(top_k_cosine(base.where(scope), question, k, "vec_id", "embedding").select("vec_id", "distance"))  # k rows
    text, flagged = guarded(F.col("text"), untrusted if untrusted is not None else F.lit(False))
    return texts.join(near, F.col("doc_id") == F.col("vec_id")).select("vec_id", "distance", text.alias("text"), flagged.alias("flagged")).orderBy("distance", "vec_id")


@query(f"SELECT vec_id, {r('1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))', 6)} AS distance FROM embeddings WHERE vec_id <> 7 ORDER BY distance, vec_id LIMIT 5")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return top_k_cosine(e.where("vec_id <> 7"), e.where("vec_id = 7"), 5, "vec_id", "embedding").select("vec_id", "distance")


def _search_sql(scope: str, text: str = "text", flagged: str = "false") -> str:
    return f"SELECT vec_id, {_FAR} AS distance, {text} AS text, {flagged} AS flagged FROM v_chunk WHERE {scope} ORDER BY distance, vec_id LIMIT 5"


def _question(base: DataFrame) -> DataFrame:
    return base.where("vec_id = 7")


@query(_search_sql("internal"))
def lookup_methodology(spark, sf):
    x = corpus(spark, sf)
    return searched(x, table(spark, sf, "documents"), _question(x), F.col("internal"))


@query(_search_sql("label = 3"))
def threshold_rationale(spark, sf):
    """One document alone: what is the record for a threshold is found by scope, not by rank."""
    x = corpus(spark, sf)
    return searched(x, table(spark, sf, "documents"), _question(x), F.col("label") == 3)


@query(_search_sql("NOT internal", f"CASE WHEN {_PHRASE} THEN '{MARKER}' || text ELSE text END", _PHRASE))
def search_external_context(spark, sf):
    x = corpus(spark, sf)
    return searched(x, table(spark, sf, "documents"), _question(x), ~F.col("internal"), untrusted=F.lit(True))


_PAIR = r("1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 6)


@query(f"SELECT question, id, distance, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, id) AS k FROM (SELECT a.vec_id AS question, b.vec_id AS id, {_PAIR} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE k <= 5")
def related_vectors(spark, sf):
    """The five vectors nearest to every fiftieth one, among all others: many questions at once."""
    e = table(spark, sf, "embeddings")
    found = nearest(e, e.where(F.col("vec_id") % 50 == 0), 6, "vec_id", "embedding").where("id <> question")
    k = F.row_number().over(Window.partitionBy("question").orderBy("distance", "id"))
    return found.withColumn("rank", k.cast("long")).where("rank <= 5").select("question", "id", "distance", "rank")


view("v_turns", "SELECT conv_id, role, count(*) AS turns, sum(length(text)) AS chars, max(turn) AS last_turn FROM conversations GROUP BY ALL")


@query("SELECT conv_id, role, turns, chars::BIGINT AS chars, last_turn FROM v_turns")
def conversation_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"), F.max("turn").alias("last_turn"))


