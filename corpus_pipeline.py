"""Documents to packed training sequences: toxicity, near duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents, extra ones included, whatever their names; the last returns pieces of sequences. Every stage gives no rows
for an empty table; what each does with nulls, empty and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import mixing, near, packing, substrings, toxicity
from cachelens.llm._store import dropped, prefix, written
from cachelens.llm.queries import WORD_BPE, table

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below THRESHOLD. The model is fitted on the labelled part of docs that is not held out.

    A null or empty text has no matches, so it stays; repeated rows score alike and go or stay together; a row without id
    is scored too; texts are scored whole, however long; without labels nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names, own = docs.columns, f"{prefix(docs)}score"
    scored = toxicity.score(docs.withColumnsRenamed({c: own for c in names if c.lower() == "score"}), model, with_text=True)
    kept = scored.where(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(own if c.lower() == "score" else c).alias(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the smallest id; five words and a similarity of 0.8, as for any stage.

    Of rows with one id and text one stays; rows with one id and different texts are judged each by its own text. Null and
    empty texts, and rows without id, are in no group and stay (once for each id and text).
    """
    return near.unique(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has; untouched texts stay as they are.

    Every row stays, if with an empty text; rows with one id don't remove each other's passages, and each keeps what is left
    of its own text; a null id is earlier than all others; a null text stays null. n_chars follows the text.
    """
    left = substrings.cleaned(docs)
    return left.select(*[F.coalesce(F.char_length("text").cast("long"), c).alias(c) if c == "n_chars" else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to twice.

    Null and empty texts weigh nothing and may go; a null source is a source, a null id an id; repeated rows (same source,
    id and size) are taken together.
    """
    return mixing.taken(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, of every row: a null or empty text is its end token, repeated rows are
    packed each, a long text is cut, a null id stays null."""
    pieces = packing.pack(docs, WORD_BPE, remember=300_000)  # workers serve other stages too
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substrings", drop_repeats), ("mix", mix_sources), ("pack", pack_sequences)]
#: No stage but the counts of the mix could be said in SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread by the next; what a later stage needs no more is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
