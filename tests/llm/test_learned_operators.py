"""Sharding, language identification, LM scoring, HTML text and both vector searches."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import ann, attention_lm, ball_tree, html_text, language_id, queries, sharding
from concord.llm.common import training_part

MODEL = queries.tokenizer_path()


def even(rows, shards, largest):
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert set(size) <= set(range(shards))
    mean = sum(size.values()) / shards
    for s in range(shards):
        assert abs(size[s] - mean) <= max(largest, mean * 0.02)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(which, shards, request, spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "docs" else request.getfixturevalue(which)
    rows = sharding.shard_documents(df, shards=shards).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in df.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    even(rows, shards, max(r["size"] for r in rows))


def test_sharding_keeps_copies_together_but_for_capacity(spark):
    """A third of all rows are one text: it must fill shards one after another; small groups stay whole."""
    rows = [(i, "same text " * 20) for i in range(600)] + [(1000 + i, f"pair {i // 2} " * 20) for i in range(400)] + [(5000 + i, f"alone {i} " * 20) for i in range(800)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    even(got, 10, 400)
    place = defaultdict(set)
    for r in got:
        place[r["group"]].add(r["shard"])
    text = Counter(r["group"] for r in got)
    pairs = [g for g, n in text.items() if n == 2]
    assert sum(len(place[g]) > 1 for g in pairs) <= 4
    assert len(place[text.most_common(1)[0][0]]) <= 6
    again = sharding.shard_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string"), shards=10).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def by_hand(groups, capacity, shards, rounds, seed_cells):
    """Label propagation one group at a time, in plain Python."""
    cells = Counter(seed_cells)
    for _ in range(rounds):
        load = Counter()
        for (g, s), n in cells.items():
            load[s] += n * groups[g]
        room = {s: capacity - load[s] for s in range(shards)}
        hub = {}
        for (g, s), n in cells.items():
            if room[s] >= groups[g] and n:
                hub[g] = max(hub.get(g, (0, -1)), (n, s))
        asks = sorted(((n + hub[g][0], g, s) for (g, s), n in cells.items() if n and g in hub and s != hub[g][1] and n <= hub[g][0]), key=lambda x: (-x[0], x[1], x[2]))
        after, used = Counter(cells), Counter()
        for _, g, s in asks:
            to, n = hub[g][1], cells[g, s]
            go = max(0, min(n, (room[to] - used[to]) // groups[g]))
            used[to] += n * groups[g]
            after[g, s] -= go
            after[g, to] += go
        after = Counter({k: n for k, n in after.items() if n})
        if after == cells:
            break
        cells = after
    return cells


def cut_edges(copies):
    """Links between equal texts that end in different shards, of a group's copies by shard."""
    n = sum(copies)
    return (n * n - sum(c * c for c in copies)) // 2


@pytest.mark.parametrize("buckets", [1, 90])
def test_propagation_keeps_as_many_links_as_a_plain_one(spark, buckets):
    """Cut edges and split groups of the joins, however many buckets the movers are dealt to, against one loop over all groups."""
    rng = np.random.default_rng(2)
    size = {f"g{i:04}": int(rng.integers(20, 400)) for i in range(400)}
    start = Counter({("hot", s): 60 for s in range(10)})
    size["hot"] = 100
    for g in list(size)[:-1]:
        for s in rng.integers(0, 10, int(rng.integers(2, 6))):
            start[g, int(s)] += 1
    capacity = -(-sum(size[g] * n for (g, _), n in start.items()) // 10)
    rows = spark.createDataFrame([(g, size[g], s, n) for (g, s), n in start.items()], "grp string, size long, shard int, n long")
    got = sharding.propagate(rows, capacity, 10, 20, buckets).collect()
    want = by_hand(size, capacity, 10, 20, start)
    cut = {}
    for name, cells in (("joins", {(r["grp"], r["shard"]): r["n"] for r in got}), ("plain", want)):
        assert sum(cells.values()) == sum(start.values())
        by = defaultdict(list)
        for (g, _), n in cells.items():
            by[g].append(n)
        cut[name] = (sum(cut_edges(v) for g, v in by.items() if g != "hot"), len(by["hot"]), cut_edges(by["hot"]))
    assert cut["joins"][0] <= 1.05 * cut["plain"][0] + 20 and cut["joins"][1] <= cut["plain"][1] + 1 and cut["joins"][2] <= 1.05 * cut["plain"][2] + 20


def test_sharding_does_not_depend_on_the_number_of_buckets(spark):
    rows = [(i, "same text " * 20) for i in range(600)] + [(1000 + i, f"pair {i // 2} " * 20) for i in range(400)] + [(5000 + i, f"alone {i} " * 20) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({(r["doc_id"], r["shard"]) for r in sharding.shard_documents(df, shards=10, bucket_rows=n).collect()} for n in (20_000, 20))
    assert one == many


def test_sharding_rounds_shuffle_sums_alone(spark, monkeypatch):
    """No round shuffles the state, and copies are neither lost nor made where shards are full."""
    plans, write = [], sharding.written

    def noted(df, name):
        if name == "cells":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(sharding, "written", noted)
    start = [("hot", 50, s, 90) for s in range(10)] + [(f"g{i}", 40 + i, s, 1 + s % 2) for i in range(60) for s in range(i % 7, 10, 3)]
    rows = spark.createDataFrame(start, "grp string, size long, shard int, n long").repartition(4).persist()
    capacity = -(-sum(z * n for _, z, _, n in start) // 10)
    got = sharding.propagate(rows, capacity, 10, 20, 5).collect()
    plans = plans[1:]  # the first one groups the rows that were given
    assert plans and not any("Exchange" in p for p in plans)
    for g in {x[0] for x in start}:
        assert sum(r["n"] for r in got if r["grp"] == g) == sum(x[3] for x in start if x[0] == g)
    assert all(r["n"] > 0 for r in got) and len(got) == len({(r["grp"], r["shard"]) for r in got}) < len(start)


def test_language_held_out_accuracy(spark, sf_dir):
    df = queries.op2_language_id(spark, sf_dir.replace("0.001", "0.01")).join(spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = df.collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and np.mean([r["rejected"] for r in rows]) < 0.01


def test_language_odd_rows(odd_docs):
    model = language_id.fit(odd_docs, F.lit(True))
    rows = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.predict(odd_docs, model).collect()}
    assert {(4, "und", True), (5, "und", True), (6, "und", True), (None, "und", True)} <= rows
    assert any(r[0] == 1 and r[1] in ("en", "fr", "de", "es") for r in rows)
    out = language_id.accepted(odd_docs, model)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}
    assert language_id.predict(odd_docs.where("false"), language_id.fit(odd_docs.where("false"), F.lit(True))).count() == 0


def test_language_rejects_noise():
    rng = np.random.default_rng(1)
    a, b = [["alpha", "beta", "gamma"], ["unu", "du", "tri"]]
    texts = [" ".join(rng.choice(x, 30)).encode() for _ in range(60) for x in (a, b)]
    model = language_id.train(texts, ["a", "b"] * 60, language_id.Settings(epochs=3))
    table = language_id.WordScores(model)
    s = table.rows([b"alpha", b"unu", b"alpha"])
    assert np.array_equal(s[0], s[2]) and s[0, :-1].argmax() != s[1, :-1].argmax()
    assert 0.1 <= model.temperature <= 4.0


def word_counts(rows, modulus=5, held=1):
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    train = [p for i, p in texts if zlib.crc32(("" if i is None else str(i)).encode()) % modulus != held]
    c = Counter(w for p in train for w in p)
    return texts, c, len(train)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("broadcast", [200_000, 20])
def test_lm_base_equals_brute_force(which, broadcast, request, spark, sf_dir):
    """With 20 frequent words, all other counts come from the join."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "docs" else request.getfixturevalue(which)
    settings = attention_lm.Settings(warm_windows=50, least_words=500, epochs=1, broadcast_words=broadcast, count_words=50, table_words=100)
    got = attention_lm.score(df, training_part("doc_id", 5) != 1, MODEL, settings).collect()
    texts, c, ends = word_counts(df.select("doc_id", "text").collect())
    n, v = sum(c.values()) + ends, len(c) + 1
    whole = np.log10(n + 0.5 * (v + 1))
    want = sorted((str(i), len(p) + 1, sum(c[w] > 0 for w in p) + 1, n, round(sum(np.log10(c[w] + 0.5) for w in p) + np.log10(ends + 0.5) - (len(p) + 1) * whole, 4)) for i, p in texts)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lm_windows_score_each_token_once_and_sum_to_one():
    rng = np.random.default_rng(0)
    s = attention_lm.Settings(dim=4, block=4, head=5, bands=1)
    a = attention_lm.Attention(20, 7, s, rng)
    a.tables()
    seq = rng.integers(3, 20, 23).astype(np.int32)
    ids, after, units = a.windows([seq, seq[:1], seq[:4]], 1)
    assert units.tolist() == [6, 1, 1] and after[after >= 0].tolist() == [*seq, *seq[:1], *seq[:4]]
    total = sum(np.exp(a.log_probabilities(ids, np.where(after < 0, -1, k))) for k in range(7))
    assert np.allclose(total[after >= 0], 1, atol=1e-5)
    changed = seq.copy()
    changed[10:] = 3  # causal: earlier scores don't see later tokens
    ids2, after2, _ = a.windows([changed], 1)
    one, two = a.log_probabilities(ids[:6], after[:6] % 7), a.log_probabilities(ids2, after[:6] % 7)
    assert np.allclose(one.ravel()[:11], two.ravel()[:11], atol=1e-6) and not np.allclose(one.ravel()[12:20], two.ravel()[12:20], atol=1e-6)


def test_lm_gradients_equal_differences():
    rng = np.random.default_rng(0)
    s = attention_lm.Settings(dim=3, block=3)
    a = attention_lm.Attention(9, 5, s, rng)
    for n in a.NAMES:
        setattr(a, n, getattr(a, n).astype(np.float64))
    ids, after, _ = a.windows([rng.integers(0, 9, 8).astype(np.int32)], 1)
    target = np.where(after < 0, -1, after % 5)
    _, g = a.gradients(ids, target)
    for n in a.NAMES:
        x = getattr(a, n)
        if n == "emb":
            full = np.zeros_like(x)
            full[g[n][0]] = g[n][1]
            g[n] = full
        for at in [tuple(rng.integers(0, k) for k in x.shape) for _ in range(4)]:
            old = x[at]
            x[at] = old + 1e-5
            up = a.gradients(ids, target)[0]
            x[at] = old - 1e-5
            down = a.gradients(ids, target)[0]
            x[at] = old
            assert g[n][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def captured():
    """Runs ``score`` and keeps the scorer that it made."""
    kept = []

    def run(*args, **kwargs):
        real = attention_lm.fit_weights

        def spy(known, counts, scorer, *rest):
            real(known, counts, scorer, *rest)
            kept.append(scorer)

        attention_lm.fit_weights = spy
        try:
            return attention_lm.score(*args, **kwargs), kept[-1]
        finally:
            attention_lm.fit_weights = real

    return run


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_lm_score_equals_brute_force(which, request, spark, sf_dir, captured):
    """Word by word from the full counts, whether 20 or all words are sent to the tasks."""
    import sentencepiece

    df = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "docs" else request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts, c, ends = word_counts(df.select("doc_id", "text").collect())
    for broadcast in (200_000, 20):
        out, scorer = captured(df, training_part("doc_id", 5) != 1, MODEL, attention_lm.Settings(warm_windows=50, least_words=2000, epochs=1, broadcast_words=broadcast))
        got = sorted((str(r["doc_id"]), round(r["score"], 3)) for r in out.collect())
        (a, b), want = scorer.weights, []
        for i, words in texts:
            pieces = [sp.encode(w.decode("utf-8", "replace")) for w in words] + [[scorer.end]]
            sequence = np.array([x for p in pieces for x in p], np.int32)
            sub = np.exp(scorer.parts([sequence], np.array([len(p) for p in pieces])))
            total, before = 0.0, Counter()
            for k, w in enumerate([*words, None]):
                n = ends if w is None else c[w]
                trust = k / (k + 20)
                total += np.log10(a * (n + 0.5) / scorer.whole + b * trust * before[w] / max(1, k) + (1 - a - b * trust) * sub[k])
                before[w] += 1
            want.append((str(i), round(total, 3)))
        for (i, x), (j, y) in zip(got, sorted(want), strict=True):
            assert i == j and x == pytest.approx(y, rel=1e-4, abs=2e-3)


def test_lm_mixture_is_a_distribution():
    """Shares of the corpus with one unseen class, of the text before and of subword strings sum to one under their weights."""
    rng = np.random.default_rng(0)
    counts, before = rng.integers(1, 9, 12), rng.integers(0, 4, 12)
    whole = counts.sum() + 0.5 * 13
    share = np.append(counts + 0.5, 0.5) / whole
    trust = before.sum() / (before.sum() + 20)
    for a, b in attention_lm.GRID:
        assert share.sum() == pytest.approx(1) and a + b < 1
        assert a * share.sum() + b * trust * (before / before.sum()).sum() + (1 - a - b * trust) == pytest.approx(1)


def test_lm_beats_the_base_on_held_out_rows(spark, sf_dir):
    for sf in ("0.01", "0.1"):
        df = spark.read.parquet(sf_dir.replace("0.001", sf) + "/documents.parquet")
        out = attention_lm.score(df, training_part("doc_id", 5) != 1, MODEL).where("held_out")
        r = out.agg(F.sum("score"), F.sum("base_score"), F.avg(F.expr("cast(score > base_score as int)"))).first()
        print(sf, tuple(r))
        assert r[0] > r[1] and r[2] > 0.5


def test_lm_learns(spark, sf_dir, captured):
    """The tasks' passes over their shares make subwords of held-out texts more probable than the start on the driver, and that more than no training."""
    df, train = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet"), training_part("doc_id", 5) != 1
    texts = [(r["text"] or "").encode().lower().split() for r in df.where(~train).limit(60).collect()]
    with open(MODEL, "rb") as f:
        model = f.read()
    loss = []
    for settings in ({"warm_windows": 0, "share": 0, "least_words": 0}, {"warm_windows": 2000, "share": 0, "least_words": 0}, {"warm_windows": 2000}):
        _, scorer = captured(df.repartition(4, "doc_id"), train, MODEL, attention_lm.Settings(**settings))
        w = attention_lm.read_words(texts, attention_lm.WordTable(model, {}, 10**6), scorer)
        loss.append(-scorer.parts(w.sequences, w.pieces).mean())
    assert loss[2] < loss[1] - 0.02 and loss[1] < loss[0] - 0.2


def test_lm_learns_from_every_training_row(spark, captured):
    """Each row holds a subword that no other has: all of them have moved, those of rows held out have not."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = [i for i in range(2000, 30_000) if sp.id_to_piece(i)[:1] == "▁" and sp.id_to_piece(i)[1:].isalpha() and sp.encode(sp.id_to_piece(i)[1:].lower()) == [i]][:900]
    rows = [(k, f"the {sp.id_to_piece(i)[1:].lower()} of the") for k, i in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    settings = attention_lm.Settings(warm_windows=10, least_words=20, epochs=1)
    _, scorer = captured(df, F.col("doc_id") % 5 != 1, MODEL, settings)
    begun = np.random.default_rng(settings.seed).normal(0, 0.3, scorer.attention.emb.shape).astype(np.float32)
    moved = (scorer.attention.emb != begun).any(axis=1)[own]
    assert len(own) == 900 and moved.tolist() == [k % 5 != 1 for k in range(900)]


def test_lm_mixture_hears_every_word_the_tasks_learn(spark, monkeypatch):
    """Words of all training text, frequent (sums) or not (rows), are evidence for the mixture's weights."""
    df = spark.createDataFrame([(k, f"some w{k} words w{k} of text") for k in range(400)], "doc_id long, text string").repartition(3, "doc_id")
    found = []

    def spy(known, counts, scorer, rare, sums):
        found.append((sum(r["n"] for x in rare for r in x.select(F.size("sub").alias("n")).collect()), sums))

    monkeypatch.setattr(attention_lm, "fit_weights", spy)
    monkeypatch.setattr(attention_lm, "GRID", [(1.0, 0.0)])  # the corpus share alone
    monkeypatch.setattr(attention_lm, "GRID_WEIGHTS", np.array([[1.0], [0.0], [0.0]], np.float32))
    attention_lm.score(df, F.lit(True), MODEL, attention_lm.Settings(warm_windows=0, least_words=20, epochs=1, broadcast_words=4))
    whole = 400 * 7 + 0.5 * (405 + 1)
    assert found[0][0] == 800 and found[0][1][0] == pytest.approx(400 * 5 * np.log(399.5 / whole), rel=1e-4)


def test_lm_tables_never_segment_frequent_words():
    """Their subwords come with the table and outlast its being emptied; the others are the same whether kept or segmented again."""
    import sentencepiece

    with open(MODEL, "rb") as f:
        model = f.read()
    sp, asked = sentencepiece.SentencePieceProcessor(model_proto=model), []
    frequent = {b"the": 9, b"reading": 5, "größe".encode(): 2}

    class Spy:
        def encode(self, words, **kwargs):
            asked.extend(words)
            return sp.encode(words, **kwargs)

    table = attention_lm.WordTable(model, frequent, 3, attention_lm.segmented(sp, list(frequent)))
    table.sp = Spy()
    for k in range(4):
        words = [b"the", b"reading", b"the", "größe".encode(), *(f"word{i}x".encode() for i in range(k, k + 3)), b"odd"]
        at = table.rows(words)
        assert table.count[at].tolist() == [frequent.get(w, 0) for w in words]
        assert [table.pool[table.first[i] : table.first[i] + table.size[i]].tolist() for i in at] == [sp.encode(w.decode()) for w in words]
    assert not {w.decode() for w in frequent} & set(asked)
    assert asked.count("odd") == 4  # again each time the table was emptied


def test_lm_steps_outlast_large_scores():
    """Rows are lowered by their largest value where scores are large: no overflow, and the loss that float64 gives."""
    rng = np.random.default_rng(0)
    a = attention_lm.Attention(9, 5, attention_lm.Settings(dim=3, block=3), rng)
    a.emb *= 40
    ids, after, _ = a.windows([rng.integers(0, 9, 8).astype(np.int32)], 1)
    target = np.where(after < 0, -1, after % 5)
    loss, g = a.gradients(ids, target)
    for n in a.NAMES:
        setattr(a, n, getattr(a, n).astype(np.float64))
    assert loss == pytest.approx(a.gradients(ids, target)[0], rel=1e-4)
    assert all(np.isfinite(x).all() for x in (*[v for n, v in g.items() if n != "emb"], g["emb"][1]))


def test_lm_mixture_joins_counts_once(spark, monkeypatch):
    """The counts of words that aren't frequent meet those of all training parts in one join."""
    df = spark.createDataFrame([(k, f"some w{k} words w{k} of text") for k in range(400)], "doc_id long, text string").repartition(3, "doc_id")
    joins, real = [], type(df).join

    def spy(self, other, *args, **kwargs):
        joins.append(self.columns)
        return real(self, other, *args, **kwargs)

    monkeypatch.setattr(type(df), "join", spy)
    attention_lm.score(df, F.lit(True), MODEL, attention_lm.Settings(warm_windows=0, least_words=20, epochs=1, broadcast_words=4))
    assert sum("sub" in columns for columns in joins) == 1


def test_lm_runs_from_another_folder(tmp_path):
    """Workers that don't find the repository get all code by value."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from concord.llm import attention_lm
df = spark.createDataFrame([(i, f"some words of text {{i % 7}} stand here") for i in range(40)], "doc_id long, text string")
out = attention_lm.score(df, F.col("doc_id") % 5 != 1, {MODEL!r}, attention_lm.Settings(epochs=1))
assert out.where("score < 0").count() == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


PAGES = [
    ("<html><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy now.</div>"
     "<article><h1>Ti&amp;tle</h1><p>One  two\n three.<p>Four <b>five</b> six.<br>Seven.</p><ul><li>Item one here.</li></ul></article>"
     "<aside><p>Related words here.</p></aside><div id='comments'><p>Great post, I liked it.</p></div><form><p>Sign up</p></form>"
     "<script>var a='<p>no</p>';</script><footer>&copy; 2024</footer></body></html>", "Ti&tle\nOne two three.\nFour five six. Seven.\nItem one here."),
    ("<article><p>A &lt;b&gt; &#233;&nbsp;x.</p>", "A <b> é x."),
    ("", ""), (None, ""), ("<p", ""), ("<html><head><title>t</title><style>p{}</style></head><body></body></html>", ""),
]


def test_html_pages(spark):
    rows = [(i, f"u{i}", h, "x", "y") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = html_text.extract(df).collect()
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
    for i, (_, want) in enumerate(PAGES):
        if i != 4:  # a lone broken tag: any text, no failure
            assert by[i] == want, i
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows)
    assert html_text.extract(df.where("false")).count() == 0


def test_html_long_and_deep():
    model = html_text.train()
    deep = "<div>" * 3000 + "<article><p>Deep words stand here, all alone.</p></article>" + "</div>" * 3000
    long = "<article>" + "<p>Some words of a long page that goes on.</p>" * 20_000 + "</article>"
    out = html_text.extract_texts([deep, long], model)
    assert out[1].count("\n") == 19_999


def test_html_sum_product_equals_enumeration():
    page = html_text.Page("<div><p>a b c.</p><nav><ul><li>x</li></ul></nav></div>")
    forest = html_text.Forest([page])
    rng = np.random.default_rng(0)
    w, pair = rng.normal(size=(len(html_text.FEATURES), 3)), rng.normal(size=(3, 3))
    u = forest.unary(w)
    p, edges = html_text.sum_product(forest, u, pair)
    want, want_edges, z = np.zeros_like(p), np.zeros((3, 3)), 0.0
    n = len(u)
    for k in range(3**n):
        y = [k // 3**i % 3 for i in range(n)]
        e = np.exp(sum(u[i, y[i]] for i in range(n)) + sum(pair[y[forest.parent[i]], y[i]] for i in range(1, n)))
        z += e
        for i in range(n):
            want[i, y[i]] += e
            if i:
                want_edges[y[forest.parent[i]], y[i]] += e
    assert np.allclose(p, want / z) and np.allclose(edges, want_edges / z)


BEFORE, AFTER = "<p>Some words of a page that goes on for a while. And another sentence.</p>", "<p>The paragraph after it stands here, and it is read. It has two sentences.</p>"


@pytest.mark.parametrize("odd", [
    "<video-player src='x'></video-player>", "<title-card>x</title-card>", "<svg class='i'/>", "<select><option>a", "<button>go", "<button>go<p>Between them.</p><button>x</button>", "<svg><path/>", "<noscript><p>Please enable it.</p></noscript>",
    "<svg><svg><text>x</text></svg></svg>", "<video controls><p>Your player is old.</p></video>", "<template><article><p>Not shown at all.</p></article></template>", "<select><option>one<option>two</select>", "<iframe src='x'/>", "<math>x</math>", "<script>if (a < b) { '<p>no</p>' }</script>",
])
def test_html_skipped_elements_take_nothing_with_them(odd):
    got = html_text.extract_texts([f"<html><body><article>{BEFORE}{odd}{AFTER}</article></body></html>"], html_text.train())[0]
    assert got.startswith("Some words") and got.endswith("It has two sentences.") and "enable" not in got and "old." not in got and "Not shown" not in got


@pytest.mark.parametrize("names", ["menu-item-page story", "entry with-sidebar has-share", "qwerty", "no-comments l-main", "page-header-less", "share-story u-12"])
def test_html_names_that_mislead(names):
    page = f"<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><div class='{names}'><h1>A title of it</h1>{BEFORE}{AFTER}{AFTER}</div><footer>&copy; 2020</footer></body>"
    got = html_text.extract_texts([page], html_text.train())[0]
    assert got.count("paragraph after") == 2 and "Some words" in got and "Home" not in got and "2020" not in got


def test_html_held_out_names():
    """Pages all of whose class and id words are unknown: tags, length, links and structure must do."""
    import re

    model = html_text.train()
    wrong = nodes = 0
    for source, labels in html_text.training_pages(150, 321):
        source = re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="q{zlib.crc32(m[2].encode()) % 9999}x"', source)
        page = html_text.Page(source)
        p, _ = html_text.sum_product(f := html_text.Forest([page]), f.unary(model[0]), model[1])
        own = np.array(page.length) > 0
        wrong += int(((p[:, 1] > 0.5) != (np.array([0, *labels]) == 1))[own].sum())
        nodes += int(own.sum())
    print("wrong", wrong / nodes)
    assert wrong / nodes < 0.15


def test_html_held_out_pages():
    model = html_text.train()
    wrong = nodes = 0
    for source, labels in html_text.training_pages(150, 123):
        page = html_text.Page(source)
        p, _ = html_text.sum_product(f := html_text.Forest([page]), f.unary(model[0]), model[1])
        own = np.array(page.length) > 0
        wrong += int(((p[:, 1] > 0.5) != (np.array([0, *labels]) == 1))[own].sum())
        nodes += int(own.sum())
    assert wrong / nodes < 0.01


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i % 150]], 1) for i in range(400)]  # copies: ties
    rows += [(500 + i, [float(v) for v in x[0]], 1) for i in range(60)]
    rows += [(40, rows[40][1], 1), (None, rows[1][1], None), (1000, None, 1), (1020, [None] + [1.0] * 7, 1), (1040, [float("nan")] * 8, 1), (1060, [float("inf")] * 8, 1), (1080, [0.0] * 8, 1), (1100, [1.0], 1), (1120, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute_search(df, f, zero):
    rows = {}
    for r in df.select("vec_id", "embedding").collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            rows[r["vec_id"]] = f(np.array(v, np.float64))
    out = {}
    for q in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float((rows[q] * v).sum()), i) for i, v in rows.items() if i != q))[:20]
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 50])
def test_ball_tree_equals_brute_force(odd_vectors, shard_rows):
    got = defaultdict(list)
    for r in ball_tree.top_k(odd_vectors, shard_rows=shard_rows, leaf=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_search(odd_vectors, lambda v: np.floor(v * 64), True)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == {q: [(i, -int(s)) for s, i in v] for q, v in want.items()}


def test_ann_recall_scores_and_ties(odd_vectors):
    settings = ann.Settings(rows_per_partition=60, want_recall=1.0, block_rows=40)
    got = defaultdict(list)
    for r in ann.search(odd_vectors, settings=settings).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_search(odd_vectors, lambda v: v, False)
    assert set(got) == set(want)
    hits = [len({i for _, i, _ in got[q]} & {i for _, i in v}) / 20 for q, v in want.items()]
    assert np.mean(hits) > 0.9
    for q, v in got.items():
        v = sorted(v)
        assert [r for r, _, _ in v] == list(range(1, len(v) + 1)) and [(-s, i) for _, i, s in v] == sorted((-s, i) for _, i, s in v)
        known = {i: -s for s, i in want[q]}
        assert all(known[i] == pytest.approx(s, abs=1e-12) for _, i, s in v if i in known)


@pytest.mark.parametrize("per_partition", [None, 60])
def test_ann_recall_on_table(per_partition, spark, sf_dir):
    """Recall against brute force with production settings, and with as many partitions as a far larger table has."""
    df = spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/embeddings.parquet")
    settings = ann.Settings(**({"rows_per_partition": per_partition} if per_partition else {}))
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    fitted = ann.fit(x, settings, len(x))
    assert fitted.parts == (2000 // per_partition if per_partition else 8) and fitted.probes < fitted.parts
    load = np.bincount(fitted.home.ranking(x, 1)[:, 0], minlength=fitted.parts)
    assert load.max() <= 1.6 * load.mean() and load.min() >= 0.4 * load.mean()
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(df, settings=settings).collect()}
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += sum((ids[k], b) in found for b in best)
        total += 20
    assert hit / total >= 0.9


def test_ann_asks_few_partitions_of_clustered_vectors(spark):
    """Where neighbours do lie together, less than half of the partitions are asked."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    settings = ann.Settings(rows_per_partition=150)
    fitted = ann.fit(x, settings, len(x))
    assert fitted.parts == 20 and fitted.probes <= 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(df, settings=settings).collect()}
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([(20 * q, int(i)) in found for q, row in enumerate(best) for i in row]) >= 0.9


def test_ann_partitions_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    label = ann.balanced_partition(x, ann.neighbour_graph(x, 10), 7, rng)
    assert np.bincount(label, minlength=7).max() <= 1.1 * 600 / 7 + 1


def test_empty_tables(spark, sf_dir, odd_docs, odd_vectors):
    assert sharding.shard_documents(odd_docs.where("false")).count() == 0
    assert ball_tree.top_k(odd_vectors.where("false")).count() == 0
    assert ann.search(odd_vectors.where("false")).count() == 0
    assert attention_lm.score(odd_docs.where("false"), F.lit(True), MODEL).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = corpus_pipeline.written(out, name)
        counts.append(docs.count())
    assert counts[1] >= 0.98 * counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[4]
