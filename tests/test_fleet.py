"""Behaviour that the queries over the benchmark tables do not reach."""

from collections import OrderedDict
from datetime import datetime

import pytest

from cachelens.operators import requests as req
from cachelens.operators import ring
from cachelens.plans.oracles import SQL
from cachelens.plans.queries import QUERIES
from cachelens.sources import objects
from tests.conftest import DATA


def weights(spark, *rows):
    return spark.createDataFrame([(i, p, w) for i, (p, w) in enumerate(rows)], "ord long, peer string, weight long")


def edit(spark, peer, n=None):
    return spark.createDataFrame([(0, peer, n)], "ord long, peer string, vnodes long")


def peers(table):
    return [r.peer for r in ring.build(table).orderBy("slot").collect()]


def test_repeated_peers_join_where_they_came_first(spark):
    assert peers(weights(spark, ("a", 1), ("b", 1), ("a", 1), ("c", 0), ("c", 1))) == ["a", "a", "b", "c"]


def test_a_sequence_of_edits(spark):
    """Slots grow, shrink to nothing at most, are set, and leave with their peers."""
    def settled(df):
        return spark.createDataFrame(df.collect(), df.schema)

    w = weights(spark)
    for peer, n, now in (("x", 2, "xx"), ("y", 3, "xxyyy"), ("x", 1, "xxxyyy"), ("z", 2, "xxxyyyzz")):
        w = settled(ring.add(w, edit(spark, peer, n)))
        assert "".join(peers(w)) == now
    for change, peer, n, now in ((ring.sub, "y", 1, "xxxyyzz"), (ring.sub, "x", 50, "yyzz"), (ring.insert, "y", 4, "yyyyzz"), (ring.update, "z", 1, "yyyyz"), (ring.insert, "x", 2, "yyyyzxx")):
        w = settled(change(w, edit(spark, peer, n)))
        assert "".join(peers(w)) == now
    w = settled(ring.remove(w, edit(spark, "y")))
    built = ring.build(w)
    assert "".join(peers(w)) == "zxx" and ring.nodes(built).first().n == 2 and ring.vnodes(built).first().n == 3
    assert {r.peer: r.n for r in ring.vnodes_by(built, spark.createDataFrame([("x",), ("y",)], "peer string")).collect()} == {"x": 2, "y": 0}


def test_outcomes_of_null_and_warm_keys(spark):
    rows = [(i, k) for i, k in enumerate(["a", None, "a", None, "b", "b"])]
    df = spark.createDataFrame(rows, "req_id long, key string")
    assert [r.outcome for r in req.outcomes(df, ["key"], ["req_id"]).orderBy("req_id").collect()] == ["fetched", "fetched", "cached", "cached", "fetched", "cached"]
    warm = spark.createDataFrame([("b",), ("b",), (None,)], "key string")
    assert [r.outcome for r in req.outcomes(df, ["key"], ["req_id"], warm=warm).orderBy("req_id").collect()] == ["fetched", "cached", "cached", "cached", "cached", "cached"]


def test_ranges_of_objects(spark, tmp_path):
    root = f"file://{tmp_path}/a.(x)"
    objects.write(spark, root, "k", b"0123456789")
    assert [r.path for r in objects.listed(spark, root).collect()] == ["k"]
    for start, stop, want in ((0, 3, b"012"), (7, 50, b"789"), (10, 12, b""), (40, 50, b"")):
        assert [bytes(r.content) for r in objects.read_range(spark, root, "k", start, stop).collect()] == [want]
    assert objects.read_range(spark, root, "none", 0, 3).count() == 0


def test_bounded_cache_against_a_replay(spark):
    rows = [(f"p{i % 3}", i, i // 2, f"k{(i * i) % 7}", 1 + (i * i) % 7) for i in range(300)] + [("p0", 900, 500, "big", 99)]
    got = {(r.peer, r.req_id): r.outcome for r in req.bounded_outcomes(spark.createDataFrame(rows, "peer string, req_id long, ts long, key string, weight long"), 10).collect()}
    for peer in ("p0", "p1", "p2"):
        held: OrderedDict = OrderedDict()
        for _, i, _, key, weight in sorted((r for r in rows if r[0] == peer), key=lambda r: (r[2], r[1])):
            assert got[peer, i] == ("cached" if key in held else "fetched")
            if key in held or weight <= 10:
                held[key] = weight
                held.move_to_end(key)
            while sum(held.values()) > 10:
                held.popitem(last=False)
    assert len(got) == len(rows)


def test_hashes_of_texts(spark):
    """Against the xxhash library: strings with 0xFF behind them, byte buffers with their length before them."""
    import xxhash

    def signed(b):
        h = xxhash.xxh64_intdigest(b)
        return h - 2**64 if h >= 2**63 else h

    sf = str(DATA / "sf0.001")
    url = {r.page_id: r.url.encode() for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    for r in QUERIES["hash_text_keys"](spark, sf).collect():
        b = url[r.page_id]
        assert (r.as_string, r.as_bytes) == (signed(b + b"\xff"), signed(len(b).to_bytes(8, "little") + b))


@pytest.mark.parametrize(
    "users",
    [
        [2, 3, 2, 8],  # user 2 is asked and answers
        [9, 2, 9, 4],  # user 9 is asked and does not answer
        [2, 2],  # the answer is the same member, seen later
        [2],  # the answer is empty
        [9],  # no answer, and nothing to be answered
        [None, 3, 2, 5],  # a member without a name is not asked before others
        [],
    ],
)
def test_observer_turn_of_few_users(spark, same, tmp_path, users):
    """Against the SQL: whom the agent asks, and what it keeps or takes over. Events take turns between the two views."""
    rows = [(i, datetime(2024, 1, 1, i), u, 1.5 + i) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    same(QUERIES["observer_turn"], SQL["observer_turn"], str(tmp_path))


def test_observer_turn_does_not_pair_two_views(spark):
    plan = QUERIES["observer_turn"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
