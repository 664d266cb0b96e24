"""Quality rules: text statistics, and cross-document line frequency by host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm._store import written

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """\\n-separated lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK, "") != "")


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows found twice or more: windows sorted by hash, those equal to a neighbour, their union.

    Texts whose windows all differ are not sorted.
    """

    def flagged(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)

    def grams(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.size(h) - 2)

    def union(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))  # array_sort would interpret a comparator
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(placed, lambda s: _let(flagged(s), covered)))

    found = _let(hashes, lambda h: F.when(F.size(h) < 4, F.lit(0)).otherwise(_let(grams(h), union)))
    return found.cast("long")


def statistics(text: Column, tokens: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words; all 0 for null and empty texts."""
    full = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.char_length(F.translate(full, BLANK, "")).cast("long"),
        "n_symbols": (F.char_length(full) - F.char_length(F.translate(full, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines(full), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.transform(tokens, lambda w: F.xxhash64(w))),
    }


def _normal(line: Column) -> Column:
    """Lower case, digits as 0, blanks as one space."""
    plain = F.lower(F.trim(F.translate(line, "\t\r\x0b\x0c123456789", "    000000000")))
    return _let(plain, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))


def _line_hash(line: Column, host: Column) -> Column:
    """Hash of a normalised line on its host."""
    return F.xxhash64(host, _normal(line))


def _without(text: Column, host: Column, gone: Column) -> Column:
    """text without the lines whose hashes are in gone; the other lines, blank ones too, stay as they are."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (F.translate(x, BLANK, "") == "") | ~F.array_contains(gone, _line_hash(x, host))), "\n")


def line_rules(docs: DataFrame, host: str = "source", limit: int = 20, keep_share: float = 0.5, least_words: int = 50, salts: int = 16) -> DataFrame:
    """Each text without the lines common on its host, with statistics of the document and whether it is kept then.

    docs: doc_id long, text string and the host column; others are ignored. Lines are normalised (case, blanks, digits)
    and hashed; for each host the documents with a line are counted, and lines in more than `limit` documents of a host
    are removed from all texts there, kept or not. Other lines stay as they are and in order. n_words to n_repeat_words
    and base_failed are of the text before: fewer than `least_words` words, or more than half of them in repeated 3-word
    windows. removed_words are those that the returned text lacks. A document is kept if its base passes and at least
    `least_words` words and `keep_share` of its words are left.

    Counting is pre-aggregated before each shuffle; the lines above the limit are joined back with `salts` copies, so a
    line that every document has is not one task's work. Null and empty texts have no words and fail the base; a null
    text stays null; a null host is a host; repeated rows count as one document and get a row each; a null id is an id; an empty
    table gives no rows. Returns doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, removed_words.
    """
    same_text = F.xxhash64(F.col(host), F.col("text")).alias("_t")
    cut = docs.select("doc_id", same_text, F.col(host).alias("_h"), "text", words(F.coalesce("text", F.lit(""))).alias("_w"))  # once for all that reads words
    stats = cut.select("doc_id", "_t", "_h", "text", *[c.alias(n) for n, c in statistics(F.col("text"), F.col("_w")).items()])
    hashes = F.array_distinct(F.transform(lines(F.coalesce("text", F.lit(""))), lambda x: _line_hash(x, F.col(host))))
    rows = written(docs.select("doc_id", same_text, F.explode(hashes).alias("line")), "quality-lines")
    common = rows.groupBy("line").agg(F.count_distinct(F.struct("doc_id")).alias("docs")).where(F.col("docs") > limit)
    common = common.select(F.col("line").alias("_cl"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_cs"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_t"), F.lit(salts)).cast("int"))
    hit = salted.join(common.hint("merge"), (F.col("line") == F.col("_cl")) & (F.col("_salt") == F.col("_cs")))
    gone = hit.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_rt")).agg(F.collect_set("line").alias("_gone"))  # bounded by one text's lines
    out = stats.join(gone, stats["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_rt")), "left")
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_h"), F.col("_gone"))))
    left = F.when(F.col("_gone").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("text"))).cast("long"))
    out = out.withColumn("removed_words", F.col("n_words") - left)
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (left >= least_words) & (left >= keep_share * F.col("n_words"))
    return out.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "removed_words")
