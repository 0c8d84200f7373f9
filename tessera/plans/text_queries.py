"""Queries over text: cleaning, tokens, hashes, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as t
from tessera.operators.chunking import chunk
from tessera.plans.common import table

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CLEAN = STRIP.format("regexp_replace(regexp_replace(replace({}, chr(0), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
MATCH = STRIP.format("regexp_replace(replace(replace(lower({}), chr(173), ''), chr(8208), '-'), '[\\s\\-–—]+', ' ', 'g')")
NORMAL = STRIP.format("regexp_replace(replace(lower({}), 'ё', 'е'), '\\s+', ' ', 'g')")


def per_document(name: str, column, sql: str, out: str = "text") -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", column(t.text("text")).alias(out))

    query(name, f"SELECT doc_id, {sql.format('coalesce(text, $$$$)')} AS {out} FROM documents".replace("$$$$", "''"))(run)


per_document("clean_text", t.clean, CLEAN)
per_document("normalize_match", t.matchable, MATCH)
per_document("normalize_text", t.normal, NORMAL)
per_document(
    "strip_urls",
    t.without_urls,
    STRIP.format(
        "regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace({}, '\\[([^\\]]+)\\]\\(https?://[^)]+\\)', '\\1', 'g'),"
        " '(?i)(https?://|www\\.)[^\\s<>]+|localhost(:[0-9]+)?[^\\s<>]*', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)),"
        " '[\\t\\f\\x0b ]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    ),
)
per_document(
    "truncate_text",
    lambda c: t.truncated(c, 2500),
    "CASE WHEN length({0}) <= 2500 THEN {0} ELSE regexp_replace(left({0}, 2499), '\\s+$', '') || '…' END",
)
per_document("collapse_lines", t.one_line_breaks, STRIP.format("regexp_replace(regexp_replace({}, '[\\t\\r\\f\\x0b ]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g')"))
per_document("content_hash", lambda c: F.sha2(c.cast("binary"), 256), "sha256({})", "sha256")
per_document("safe_name", lambda c: t.safe_name(c), "left(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_.\\-]', '_', 'g'), 80)", "name")
per_document(
    "embed_text_head_tail",
    lambda c: t.embed_text(F.col("source"), F.lit(1), t.strip(c), 480),
    "(SELECT CASE WHEN b = '' THEN '[' || source || '] стр. 1' WHEN length(h) + length(b) <= 480 OR length(b) <= room THEN h || b ELSE h || left(b, front) || chr(10) || '...' || chr(10) || right(b, back) END"
    " FROM (SELECT h, b, room, front, greatest(80, room - front - 5) AS back FROM (SELECT h, b, room, greatest(140, (room * 2) // 3) AS front FROM"
    " (SELECT h, b, greatest(220, 480 - length(h) - 8) AS room FROM (SELECT '[' || source || '] стр. 1' || chr(10) AS h, " + STRIP + " AS b) a) c) d) e)",
)


@query(
    "html_to_plain",
    "SELECT page_id, " + CLEAN.format(
        "replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),"
        " '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),"
        " '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&')"
    ) + " AS text FROM pages",
)
def html_to_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.plain(t.text("html")).alias("text"))


#: One window of text per chunk start, with the rule for its end.
CHUNK_SQL = """
WITH w AS (SELECT doc_id AS file_id, unnest(range(0, length(text), 1000)) AS start, text, length(text) AS n FROM documents WHERE length(text) > 0),
v AS (SELECT file_id, start, n, substr(text, start + 1, 1200) AS w FROM w),
c AS (SELECT file_id, start, n, w,
 CASE WHEN instr(w, chr(10) || chr(10)) > 0 THEN length(w) - instr(reverse(w), chr(10) || chr(10)) - 1 ELSE -1 END AS para,
 CASE WHEN instr(w, chr(10) || '•') > 0 THEN length(w) - instr(reverse(w), '•' || chr(10)) - 1 ELSE -1 END AS dot,
 CASE WHEN instr(w, chr(10) || '- ') > 0 THEN length(w) - instr(reverse(w), ' -' || chr(10)) - 2 ELSE -1 END AS dash,
 CASE WHEN instr(w, chr(10) || '— ') > 0 THEN length(w) - instr(reverse(w), ' —' || chr(10)) - 2 ELSE -1 END AS long_dash,
 CASE WHEN regexp_matches(w, '\\n\\d+[.)]\\s') THEN length(regexp_extract(w, '(?s)^(.*)\\n\\d+[.)]\\s', 1)) ELSE -1 END AS item,
 CASE WHEN instr(w, chr(10)) > 0 THEN length(w) - instr(reverse(w), chr(10)) ELSE -1 END AS nl FROM v),
e AS (SELECT file_id, start, left(w, CASE WHEN n - start <= 1200 THEN length(w) WHEN para >= 600 THEN para + 2 WHEN dot >= 600 THEN dot + 2 WHEN dash >= 600 THEN dash + 3
 WHEN long_dash >= 600 THEN long_dash + 3 WHEN item >= 600 THEN item WHEN nl >= 600 THEN nl + 1 ELSE length(w) END) AS raw FROM c),
k AS (SELECT file_id, start, """ + STRIP.format("raw") + """ AS text FROM e),
chunks AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start) - 1 AS INT) AS chunk_index, start, text FROM k WHERE text <> '')
"""


def document_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunk(docs.select(F.col("doc_id").alias("file_id"), F.lit(1).alias("page"), "text"))


@query("chunk_text", CHUNK_SQL + "SELECT file_id, chunk_index, start, text FROM chunks")
def chunk_text(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("file_id", "chunk_index", F.col("start").cast("long").alias("start"), "text")


@query("chunk_stats", CHUNK_SQL + "SELECT file_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(max(start // 2400 + 1) AS BIGINT) AS n_pages FROM chunks GROUP BY file_id")
def chunk_stats(spark, sf_dir):
    pages = F.max(F.floor(F.col("start") / t.PAGE_CHARS) + 1).cast("long")
    return document_chunks(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars"), pages.alias("n_pages"))


@query("chunk_starts", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_starts, CAST(max(s) AS BIGINT) AS last_start FROM (SELECT doc_id, unnest(range(0, length(text), 1000)) AS s FROM documents) GROUP BY doc_id")
def chunk_starts(spark, sf_dir):
    n = F.floor((F.length("text") - 1) / 1000)
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", (n + 1).cast("long").alias("n_starts"), (n * 1000).cast("long").alias("last_start"))


@query("form_feed_pages", "SELECT doc_id, CAST(i AS INT) AS page, string_split(replace(text, chr(10), chr(12)), chr(12))[i] AS text FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(replace(text, chr(10), chr(12)), chr(12))) + 1)) AS i) u")
def form_feed_pages(spark, sf_dir):
    """Lines stand in for pages: the data has no form feeds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit("\f")), "\f", -1).alias("p"))
    return d.select("doc_id", F.posexplode("p").alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")


@query("page_concat", "SELECT conv_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, " + STRIP.format("text") + " AS b FROM conversations) WHERE b <> '' GROUP BY conv_id")
def page_concat(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.strip(F.col("text")).alias("b")).where("b <> ''")
    return d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "b"))).alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("text"))


@query("char_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def char_offsets(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("char_start"))


@query("duplicate_docs", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(
    "upload_gate",
    "SELECT page_id, CASE WHEN NOT regexp_matches(lower(url), '/[0-9]+$') THEN 'extension' WHEN strlen(html) = 0 THEN 'empty' WHEN strlen(html) > 6000 THEN 'size'"
    " WHEN left(html, 9) <> '<!DOCTYPE' THEN 'magic' ELSE 'ok' END AS verdict FROM pages",
)
def upload_gate(spark, sf_dir):
    """Reject reasons in order: what the name allows, empty, too large, wrong first bytes."""
    size = F.octet_length("html")
    verdict = (
        F.when(~F.lower("url").rlike("/[0-9]+$"), "extension").when(size == 0, "empty").when(size > 6000, "size")
        .when(F.left("html", F.lit(9)) != "<!DOCTYPE", "magic").otherwise("ok")
    )
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query("tokenize_stats", "SELECT doc_id, CAST(len(k) AS INT) AS n_tokens, CAST(len(list_distinct(k)) AS INT) AS n_distinct, list_aggregate(list_transform(k, lambda x: length(x)), 'max') AS longest FROM (SELECT doc_id, " + TOKENS.format("text") + " AS k FROM documents)")
def tokenize_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").alias("n_tokens"), F.size(F.array_distinct("k")).alias("n_distinct"), F.array_max(F.transform("k", F.length)).cast("long").alias("longest"))


STEM = "CASE WHEN length({0}) >= 10 THEN left({0}, 9) WHEN length({0}) >= 7 THEN left({0}, 7) WHEN length({0}) >= 5 THEN left({0}, 5) ELSE {0} END"


@query("word_stems", "SELECT " + STEM.format("w") + " AS stem, count(*) AS n, count(DISTINCT item_id) AS n_items FROM (SELECT item_id, unnest(" + TOKENS.format("text") + ") AS w FROM benchmark) GROUP BY 1")
def word_stems(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", F.explode(t.tokens(F.col("text"))).alias("w"))
    return d.groupBy(t.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))


@query("stem_terms", "SELECT item_id, string_agg(DISTINCT s, ' ' ORDER BY s) AS terms FROM (SELECT item_id, " + STEM.format("w") + " AS s FROM (SELECT item_id, unnest(" + TOKENS.format("text") + ") AS w FROM benchmark)) WHERE length(s) >= 6 GROUP BY item_id")
def stem_terms(spark, sf_dir):
    stems = F.filter(F.transform(t.tokens(F.col("text")), t.stem), lambda s: F.length(s) >= 6)
    d = table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(F.array_distinct(stems)).alias("s")).where(F.size("s") > 0)
    return d.select("item_id", F.array_join("s", " ").alias("terms"))


@query("min_core_required", "SELECT item_id, CAST(CASE WHEN n <= 1 THEN n WHEN n <= 3 THEN 2 ELSE greatest(2, (n * 2 + 2) // 3) END AS INT) AS need FROM (SELECT item_id, CAST(len(list_distinct(" + TOKENS.format("text") + ")) AS INT) AS n FROM benchmark)")
def min_core_required(spark, sf_dir):
    n = F.col("n")
    need = F.when(n <= 1, n).when(n <= 3, 2).otherwise(F.greatest(F.lit(2), F.floor((n * 2 + 2) / 3)))
    d = table(spark, sf_dir, "benchmark").select("item_id", F.size(F.array_distinct(t.tokens(F.col("text")))).alias("n"))
    return d.select("item_id", need.cast("int").alias("need"))


@query("needle_counts", "SELECT source, count(*) FILTER (WHERE contains(lower(text), 'the')) AS with_the, count(*) FILTER (WHERE contains(lower(text), '@')) AS with_at, count(*) FILTER (WHERE contains(lower(text), 'copyright')) AS with_copyright FROM documents GROUP BY source")
def needle_counts(spark, sf_dir):
    has = lambda s: F.count_if(F.contains(F.lower("text"), F.lit(s)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(has("the").alias("with_the"), has("@").alias("with_at"), has("copyright").alias("with_copyright"))


@query("page_range_export", "SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 1 AND 3 AND (contains(lower(text), 'the') OR contains(lower(text), 'der'))")
def page_range_export(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").where(F.col("turn").between(1, 3) & (F.contains(low, F.lit("the")) | F.contains(low, F.lit("der")))).select("conv_id", "turn", "text")
