"""The pipeline against a brute-force version: which rows stay, their texts, how often they are taken, and their ids in sequences."""

import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cachelens.llm import mixing
from cachelens.llm.queries import WORD_BPE
from tests.llm.test_operators import repeats, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _key long, text_hash long"


def rows_of_corpus():
    rnd = random.Random(11)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(4, 8))) for _ in range(n))

    texts = [(i, prose(rnd.randrange(20, 90))) for i in range(160)]
    toxic = {i for i, _ in texts if i % 4 == 1}
    texts = [(i, t.replace(" ", " dunce oafish ", 4) if i in toxic else t) for i, t in texts]
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(200, passage + " " + prose(30)), (201, prose(25) + " " + passage), (201, prose(70)), (202, passage), (203, None), (204, ""), (204, ""), (None, prose(40)), (None, passage), (205, "one two")]
    base = prose(100).split()
    for k in range(6):  # near copies, one word apart each
        more.append((210 + k, " ".join([*base[: 10 * k], f"x{k}", *base[10 * k + 1 :]])))
    more += [(220, texts[2][1]), (220, prose(50)), texts[3], texts[3]]
    rows = [(i, t, "en", ["a", "b", None][(i or 0) % 3], None if t is None else len(t), "own", n, n) for n, (i, t) in enumerate(texts + more)]
    return rows, toxic


def near(rows):
    """The first row of each component by (id, place); rows without id or words, once for each id and text."""
    sets = []
    for r in rows:
        w = words((r[1] or "").lower())
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    best, seen = {}, set()
    for i, r in enumerate(rows):
        alone = r[0] is None or not sets[i]
        key = ("alone", r[0], r[1]) if alone else top(i)
        if key not in best or (not alone and r[0] < rows[best[key]][0]):
            best[key] = i
        seen.add(i)
    return [rows[i] for i in sorted(best.values())]


def short(rows):
    """Without the place columns, which equal rows differ in."""
    return collections.Counter(tuple(r)[:6] for r in rows)


@pytest.fixture
def tables(spark, tmp_path):
    rows, toxic = rows_of_corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] in toxic)) for r in rows if r[0] is not None and r[0] < 160] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}", rows, toxic


def test_stages_against_brute_force(spark, tables):
    sf, rows, toxic = tables
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r for r in rows if r[0] not in toxic]
    one = stages["toxicity"](spark, docs, sf)
    assert one.columns == docs.columns and short(one.collect()) == short(want)
    two = stages["near_duplicates"](spark, spark.createDataFrame(want, SCHEMA).repartition(3), sf)
    want = near(want)
    assert two.columns == docs.columns and short(two.collect()) == short(want)
    assert not {r[0] for r in want} & {211, 212, 213, 214, 215} and {210, 220} <= {r[0] for r in want}
    three = stages["substrings"](spark, spark.createDataFrame(want, SCHEMA).repartition(3), sf)
    left = list(repeats([r[:2] for r in want], 50))
    want = [(r[0], t if gone else r[1], r[2], r[3], len(t) if gone else r[4], *r[5:]) for r, (_, _, gone, t) in zip(want, left, strict=True)]
    assert sum(gone > 0 for _, _, gone, _ in left) == 3  # the passage is first in a row without id
    assert three.columns == docs.columns and short(three.collect()) == short(want)
    df = spark.createDataFrame(want, SCHEMA)
    often = {(r.doc_id, r.text): r.copies for r in mixing.mix(df).select("doc_id", "text", "copies").collect()}
    four = stages["mix"](spark, df.repartition(3), sf)
    want = [r for r in want for _ in range(often[r[0], r[1]])]
    assert four.columns == docs.columns and short(four.collect()) == short(want)


def test_run_packs_what_the_stages_leave(spark, tables):
    sf, _, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    library = Tokenizer.from_file(WORD_BPE)
    ids = [(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")) for r in docs.collect()]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces) == collections.Counter((i, 0, len(x), zlib.crc32(x.tobytes())) for i, x in ids)


def test_empty_tables(spark, tables):
    sf, _, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
