"""One query for each operation, with production parameters, over its whole table; and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import bm25, chat, mixing, near, packing, quality, substrings, tokenfiles, toxicity, warc
from cachelens.llm._store import shared_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.in_training("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bm25.search(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))
    return found.withColumn("score", F.round("score", 6))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_rules(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records for the pages table: a full response of every page, and a not-modified revisit of every third, later
    or (every ninth) earlier than it, some with another validator and some with none."""
    tag = F.substring(F.md5("html"), 1, 16)
    n = F.col("page_id")
    first = pages.select(
        (2 * n).alias("record_id"), "url", n.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.concat(F.lit("t"), n).alias("last_modified"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("t"), n)).alias("headers"),
    )
    later = pages.where("page_id % 3 = 0").select(
        (2 * n + 1).alias("record_id"), "url", F.when(n % 9 == 0, n - 1000).otherwise(n + 1000).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(n % 5 == 0, F.lit("other")).when(n % 5 != 1, tag).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("date"), F.concat(F.lit("r"), n), F.lit("set-cookie"), F.lit("x")).alias("headers"),
    )
    return first.unionByName(later)


def _resolved(records: DataFrame) -> DataFrame:
    found = warc.resolve_revisits(records)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "url_key", "ts", "status", "source_id", shown.alias("headers"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(captures(table(spark, sf_dir, "pages")))


def recaptures(pages: DataFrame) -> DataFrame:
    """WARC records for the pages table: three full responses of every page with validators of their own, 500 apart, and a
    revisit of every page, later than all, between the last two (every fourth of the rest) or earlier than all (every ninth),
    with the newest validator, the oldest, another or none; and for every page a response and a revisit of its host's root."""
    tag, n = F.substring(F.md5("html"), 1, 16), F.col("page_id")
    root = F.concat(F.lit("https://"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("/"))
    none = F.lit(None).cast("string")

    def response(k: int, url: Column, ts: Column, etag: Column) -> DataFrame:
        headers = F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("t"), ts))
        return pages.select((8 * n + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"), none.alias("last_modified"), headers.alias("headers"))

    def revisit(k: int, url: Column, ts: Column, etag: Column) -> DataFrame:
        headers = F.create_map(F.lit("date"), F.concat(F.lit("r"), n), F.lit("set-cookie"), F.lit("x"))
        return pages.select((8 * n + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), etag.alias("etag"), none.alias("last_modified"), headers.alias("headers"))

    def version(v: int) -> Column:
        return F.concat(tag, F.lit(f"-{v}"))

    between = (n % 9 != 0) & (n % 4 == 1)
    asked = F.when(n % 5 == 0, F.lit("other")).when(n % 5 == 2, version(0)).when(n % 5 != 1, F.when(between, version(1)).otherwise(version(2)))
    epoch = F.concat(F.lit("h"), F.floor(n / 50))
    rows = revisit(3, F.col("url"), F.when(n % 9 == 0, n - 1000).when(between, n + 700).otherwise(n + 2000), asked)
    for v in range(3):
        rows = rows.unionByName(response(v, F.col("url"), n + 500 * v, version(v)))
    return rows.unionByName(response(4, root, n, epoch)).unionByName(revisit(5, root, n, epoch))


def op8_recrawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(recaptures(table(spark, sf_dir, "pages")))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return tokenfiles.documents(spark, path)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pack, op2_perspectives, op3_toxicity, op4_mix, op5_search, op6_substrings, op7_quality, op8_revisits, op8_recrawls, op9_tokens, op10_near_duplicates, pipeline)}
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWERED = _WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
SQL: dict[str, str] = {
    "op5_search": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
        n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM d),
        t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, n GROUP BY term, n.n),
        s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.tf * idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(w) / average))), 9) AS score
            FROM t q JOIN f USING (term) JOIN t ON t.term = q.term JOIN d ON d.doc_id = t.doc_id, n WHERE q.doc_id % 100 = 0 GROUP BY ALL)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score
        FROM s QUALIFY rank <= 10""",
    "op6_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        f AS (SELECT h, min(doc_id) AS first_id FROM x WHERE h IS NOT NULL GROUP BY h),
        r AS (SELECT x.*, max(CASE WHEN first_id < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last_hit FROM x LEFT JOIN f USING (h)),
        k AS (SELECT doc_id, count(*) FILTER (WHERE i - last_hit < 50) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_hit IS NULL OR i - last_hit >= 50) AS kept
            FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op7_quality": f"""
        WITH d AS (SELECT doc_id, source, text, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AND i + 2 <= len(w) AS twice
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        c AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS covered FROM g),
        r AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY doc_id),
        l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
        m AS (SELECT *, regexp_replace(regexp_replace(lower(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '))), ' +', ' ', 'g'), '[0-9]', '0', 'g') AS plain,
            trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '' AS full_ FROM l),
        o AS (SELECT source, plain FROM m WHERE full_ GROUP BY ALL HAVING count(DISTINCT doc_id) > 20),
        e AS (SELECT m.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT full_ OR o.plain IS NULL) AS rest,
            count(*) FILTER (WHERE full_) - count(DISTINCT CASE WHEN full_ THEN line END) AS n_dup_lines
            FROM m LEFT JOIN o ON m.plain = o.plain AND m.source IS NOT DISTINCT FROM o.source GROUP BY m.doc_id),
        s AS (SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS text, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id)),
        z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len({_WORDS}) AS left_ FROM s)
        SELECT doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_ >= 50 AND left_ >= 0.5 * n_words AS kept, n_words - left_ AS removed_words FROM z""",
    "op10_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w) + 1, 2)))) AS i FROM d)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
        t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
        f AS (SELECT a, min(b) AS first_id FROM t GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(first_id, d.doc_id)) AS component_id, d.doc_id <= coalesce(first_id, d.doc_id) AS kept
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f ON f.a = d.doc_id""",
    "op2_perspectives": """
        WITH t AS (SELECT conv_id, turn // 256 AS page, turn, role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
        p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
        j AS (SELECT t.*, participant, role = participant AS own,
            '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || replace(role, '<|im_', '< |im_') END || chr(10) AS head
            FROM t JOIN p USING (conv_id)),
        k AS (SELECT *, CAST(length(head) + coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, participant, page
            ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM j)
        SELECT conv_id, participant, page, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_target_turns,
            string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text,
            coalesce(string_agg(at_ || '-' || (at_ + length(text)), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask
        FROM k GROUP BY conv_id, participant, page""",
    "op8_revisits": r"""
        WITH u AS (SELECT page_id AS n, substr(md5(html), 1, 16) AS tag, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages),
        c AS (SELECT n, tag, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '/$', '') AS url_key FROM u),
        r AS (SELECT 2 * n AS record_id, url_key, n AS ts, tag AS etag, n, true AS full_ FROM c UNION ALL
            SELECT 2 * n + 1, url_key, CASE WHEN n % 9 = 0 THEN n - 1000 ELSE n + 1000 END, CASE n % 5 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE tag END, n, false FROM c WHERE n % 3 = 0),
        s AS (SELECT *, last_value(CASE WHEN full_ THEN record_id END IGNORE NULLS) OVER w AS source_id, last_value(CASE WHEN full_ THEN etag END IGNORE NULLS) OVER w AS source_tag FROM r
            WINDOW w AS (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, CASE WHEN source_id IS NULL THEN 'unresolved' WHEN etag <> source_tag THEN 'mismatch' WHEN etag = source_tag THEN 'resolved' ELSE 'unchecked' END AS status FROM s WHERE NOT full_)
        SELECT record_id, url_key, ts, status, source_id,
            CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=r' || n || ';etag=' || source_tag ELSE 'date=r' || n || ';set-cookie=x' END AS headers FROM f""",
    "op8_recrawls": r"""
        WITH p AS (SELECT page_id AS n, url, substr(md5(html), 1, 16) AS tag, 'https://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || '/' AS root FROM pages),
        a AS (SELECT 8 * n + v AS record_id, url, n + 500 * v AS ts, tag || '-' || v AS etag, n, true AS full_ FROM p, (VALUES (0), (1), (2)) x(v)
            UNION ALL SELECT 8 * n + 3, url, CASE WHEN n % 9 = 0 THEN n - 1000 WHEN n % 4 = 1 THEN n + 700 ELSE n + 2000 END,
                CASE n % 5 WHEN 0 THEN 'other' WHEN 1 THEN NULL WHEN 2 THEN tag || '-0' ELSE tag || CASE WHEN n % 9 <> 0 AND n % 4 = 1 THEN '-1' ELSE '-2' END END, n, false FROM p
            UNION ALL SELECT 8 * n + 4, root, n, 'h' || (n // 50), n, true FROM p
            UNION ALL SELECT 8 * n + 5, root, n, 'h' || (n // 50), n, false FROM p),
        b AS (SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM a),
        r AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '/$', '') AS url_key FROM b),
        s AS (SELECT *, last_value(CASE WHEN full_ THEN record_id END IGNORE NULLS) OVER w AS source_id, last_value(CASE WHEN full_ THEN etag END IGNORE NULLS) OVER w AS source_tag FROM r
            WINDOW w AS (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, CASE WHEN source_id IS NULL THEN 'unresolved' WHEN etag <> source_tag THEN 'mismatch' WHEN etag = source_tag THEN 'resolved' ELSE 'unchecked' END AS status FROM s WHERE NOT full_)
        SELECT record_id, url_key, ts, status, source_id,
            CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=r' || n || ';etag=' || source_tag ELSE 'date=r' || n || ';set-cookie=x' END AS headers FROM f""",
}
