"""Small and many sources get their targets, however large the table is."""

import pytest

from concord.llm import mixing


def taken_of(sizes):
    p = mixing.plan([(f"s{i:05}", n) for i, n in enumerate(sizes)], (5, 2, 1), 3, 16_384, 16, 8)
    out = [0] * len(sizes)
    for i, b, passes, _, got, *_ in p["blocks"]:
        if b == 0:
            out[i] += passes * sizes[i]
        out[i] += got
    return p, out


@pytest.mark.parametrize("sizes", [
    [100, 300, 26_000_000, 54_000_000, 1],
    [1, 40_000, 5_000_000_000, 7],
    [80_000_000 // 20_000] * 20_000,
    [0, 3, 0],
    [10**6] * 5 + [1] * 5000,
])
def test_every_source_gives_its_target(sizes):
    p, taken = taken_of(sizes)
    assert all(abs(a - t) <= 1 and (a > 0) == (t >= 1) for a, t in zip(taken, p["targets"], strict=True) if t >= 1 or not t)
    assert all(a <= 3 * n for a, n in zip(taken, sizes, strict=True)) and sum(taken) == round(sum(p["targets"]))
    assert len(p["blocks"]) <= 16_384 + 3 * len(sizes)


def test_small_source_beside_a_large_one(spark):
    rows = [(i, "word " * 2000, "big") for i in range(100)] + [(1000, "a b c", "small"), (1001, "d", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(df, max_blocks=20)
    got = {r["source"]: (r["t"], r["n"]) for r in m.groupBy("source").agg({"target": "max", "taken": "sum"}).toDF("source", "t", "n").collect()}
    assert all(abs(t - n) <= 1 for t, n in got.values()) and got["small"][1] == 9 and got["tiny"][1] == 3
    kept = mixing.mixed_documents(df, m)
    assert kept.where("source = 'tiny'").count() == 3 and kept.where("source = 'small'").count() == 3


@pytest.mark.parametrize("sizes", [[1000, 300, 5000], [10, 10, 10], [0, 7, 0], [90, 1, 1, 1, 50]])
def test_shard_quotas_decide_the_blocks(sizes):
    """Quotas of all shards sum to a source's quota, shards are even, and each shard has exactly its quota of every source's blocks."""
    shards = 6
    p = mixing.plan([(f"s{i}", n) for i, n in enumerate(sizes)], (5, 2, 1), 3, 40, shards, 8)
    per = [sum(q) for q in p["by_shard"]]
    assert [sum(q[i] for q in p["by_shard"]) for i in range(len(sizes))] == p["quota"]
    assert max(per) <= -(-sum(per) // shards)
    got = [[0] * len(sizes) for _ in range(shards)]
    words = [0] * len(sizes)
    for i, b, passes, _, part, whole, s, _ in p["blocks"]:
        length = max(0, min(p["block"], sizes[i] - b * p["block"]))
        assert (s >= 0) == (part > 0) and 0 <= part <= length and len(whole) == passes
        words[i] += part + passes * length
        for shard in [x for x in [*whole, s] if x >= 0]:
            got[shard][i] += 1
    assert got == p["by_shard"] and words == p["give"]


def test_rows_equal_in_id_and_text_take_what_is_theirs(spark):
    """Forty takes, forty words out: copies of one row don't all get the largest take."""
    rows = [(1, "a b c d e f g h", "x", k) for k in range(9)] + [(2, "k l m n", "y", 0), (None, "p q r", "x", 1), (None, "p q r", "x", 2), (1, "a b c d e f g h", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    m = mixing.mix(df, max_blocks=7)
    assert all(len(r["shards"]) == -(-r["taken"] // r["size"]) for r in m.collect() if r["size"])
    out = mixing.mixed_documents(df, m)
    assert out.columns == df.columns
    count = lambda d: {r["source"]: r["n"] for r in d.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").sum("n").toDF("source", "n").collect()}
    assert count(out) == {r["source"]: r["n"] for r in m.groupBy("source").sum("taken").toDF("source", "n").collect()}
