"""SentencePiece, SimHash, mixing and substring dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from concord.llm import mixing, queries, sentencepiece_codec, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_sentencepiece_equals_library(which, request):
    df = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in rows_of(df):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out = sp.decode(ids)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    got = [tuple(r) for r in sentencepiece_codec.encode(df, MODEL, with_output=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = sentencepiece_codec.encode(df, MODEL).where("ids is not null").collect()
    assert all(sp.decode(r["ids"]) == r["decoded"] and r["n_tokens"] == len(r["ids"]) for r in full)


def test_sentencepiece_odd_spacing_and_small_table():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = sentencepiece_codec.ChunkTable(sentencepiece_codec.read_model(MODEL), max_entries=3, max_chunk=4)
    for t in [" ", "  ", " a", "  a  b   ", "▁", "a▁b", "a ▁", "\n a\n\n", "<s> </s> <unk>", "\t", "a" * 2000, "👍🏽 é", " ▁ ", "0x0A <0x0A>"]:
        ids, out = table.encode(t)
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert out == sp.decode(want), repr(t)


def brute_fingerprint(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, budget):
    ids = sorted(set(fps))
    root = {f: f for f in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(a ^ b).count("1") <= budget:
                root[find(b)] = find(a)
    return {f: find(f) for f in ids}


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_simhash_equals_brute_force(which, request):
    df = request.getfixturevalue(which)
    rows = [(i, brute_fingerprint(t)) for i, t in rows_of(df)]
    root = brute_components([f for _, f in rows], 2)
    least = defaultdict(lambda: None)
    for i, f in rows:
        if i is not None:
            least[root[f]] = i if least[root[f]] is None else min(i, least[root[f]])
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(i, f"{f:016x}", least[root[f]]) for i, f in rows], key=str)


@pytest.mark.parametrize("limit", [4, 64, 4096])
def test_trie_join_finds_every_link(spark, limit):
    """Dense groups and chains, with group limits that force the split of groups."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) << 1
        fps.add(x)
        for _ in range(25):  # a chain of single and double flips
            x ^= sum(1 << int(b) for b in rng.integers(0, 64, 2))
            fps.add(x)
    low = int(rng.integers(0, 1 << 40)) << 20
    fps |= {low ^ int(v) for v in rng.integers(0, 1 << 12, 300)}  # shares all high blocks
    fps |= {int(v) for v in rng.integers(0, 1 << 63, 200)} | {0, (1 << 64) - 1, 1, 3}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_components(fps, 2)
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(df, 2, limit)).collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[got.get(f, f)].add(f)
    true = defaultdict(set)
    for f, r in want.items():
        true[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, true.values()))


def test_simhash_keeps_one_of_each_group(spark, odd_docs):
    kept = simhash.one_of_each(odd_docs, simhash.near_duplicates(odd_docs)).collect()
    ids = [r["doc_id"] for r in kept]
    assert 1 in ids and 2 not in ids and 14 not in ids and ids.count(12) == 1 and None not in ids
    assert len([i for i in ids if i in (4, 5, 6)]) == 1
    classes = simhash.near_duplicates(odd_docs)
    assert len(ids) == classes.select("root").distinct().count()


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0], [1, 2, 0]])
def test_simhash_loses_no_text_whose_id_repeats(spark, order):
    """Whatever the order of the rows, text b has no copy and stays, and a stays once."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b)]
    df = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(df, simhash.near_duplicates(df)).collect()) == [(1, a), (5, b)]


def brute_dedup(rows, window):
    seen = {}
    texts = [(i, [w.encode() for w in WORD.findall(t or "")]) for i, t in rows]
    for i, w in texts:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                seen[k] = min(i, seen.get(k, i))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup_equals_brute_force(which, window, request):
    df = request.getfixturevalue(which)
    got = sorted(map(tuple, substring_dedup.dedup(df, window, with_text=False).collect()), key=str)
    assert got == brute_dedup(rows_of(df), window)


def test_substring_dedup_over_many_partitions_and_small_chunks(spark):
    """A passage in every document, met across partitions and across the reducer's chunks."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} " * (i % 5) + passage + f" c{i}" * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = brute_dedup(rows, 50)
    assert sorted(map(tuple, substring_dedup.dedup(df, with_text=False).collect()), key=str) == want
    runs = df.selectExpr("doc_id", "xxhash64(text) as text_key", "text").mapInArrow(substring_dedup._window_runs(50), substring_dedup.RUN)
    found = runs.coalesce(1).sortWithinPartitions("anchor", "doc_id").mapInArrow(substring_dedup._judge(40), "doc_id long, text_key long, begin int, end int").collect()
    removed = defaultdict(set)
    for r in found:
        removed[r["doc_id"]].update(range(r["begin"], r["end"] + 50))
    assert {i: len(removed[i]) for i, _ in rows} == {i: n for i, _, n, _ in want}


def test_windows_around_a_short_common_phrase_are_spread(spark, monkeypatch):
    """A phrase of 45 words in every document: its windows all differ and would meet under a few anchors."""
    phrase = " ".join(f"p{i}" for i in range(45))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(20)) + f" {phrase} " + " ".join(f"b{i // 2}x{k}" for k in range(40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = brute_dedup(rows, 50)
    assert sum(n for _, _, n, _ in want) > 0
    monkeypatch.setattr(substring_dedup, "SAMPLED", 4)
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", 50)
    assert sorted(map(tuple, substring_dedup.dedup(df, with_text=False).collect()), key=str) == want
    keyed = df.selectExpr("doc_id", "xxhash64(text) as text_key", "text")
    hot = substring_dedup.hot_anchors(keyed, 50, 4, 50)

    def largest(hot):
        runs = keyed.mapInArrow(substring_dedup._window_runs(50, hot), substring_dedup.RUN)
        return runs.groupBy("anchor").agg({"hashes": "count"}).selectExpr("max(`count(hashes)`)").first()[0]

    assert len(hot) and largest(hot) * 10 < largest(substring_dedup.NONE)


def test_deduplicated_keeps_columns(odd_docs):
    out = substring_dedup.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    by = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert 2 not in by and by[3] is not None and by[4] == "" and by[1]


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_mixing_meets_targets(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["text_key"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == df.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order], (5, 2, 1), 3))
    slack = 1 + sum(sizes.values()) / 16_384
    for s in order:
        assert abs(taken[s] - target[s]) <= slack
    size_of = sorted((str(i), len(WORD.findall(t or ""))) for i, t in rows_of(df))
    assert size_of == sorted((str(r["doc_id"]), r["size"]) for r in got)


def test_mixing_targets_and_quotas():
    assert mixing.targets([100, 100, 100], (5, 2, 1), 3) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 500, 90], (5, 2, 1), 3) == pytest.approx([30, 380, 190])
    assert mixing.targets([0, 10], (5, 2, 1), 3) == [0, 10] and mixing.targets([], (5,), 3) == []
    quota, order = mixing.apportion([53.0, 24.0, 23.0], 10, [10, 10, 10])  # highest quotients, worked by hand
    assert quota == [6, 2, 2] and order == [0, 1, 2, 0, 0, 1, 2, 0, 0, 0]
    assert mixing.apportion([9.0, 1.0], 5, [2, 9])[0] == [2, 3]


def test_mixed_documents(spark, odd_docs):
    assert mixing.mixed_documents(odd_docs, mixing.mix(odd_docs)).columns == odd_docs.columns
    once = odd_docs.dropDuplicates(["doc_id", "text"])
    m = mixing.mix(once)
    out = mixing.mixed_documents(once, m)
    whole = dict(rows_of(once))
    for i, t in rows_of(out):
        assert i is None or i == 13 or " ".join(WORD.findall(t)) in " ".join(WORD.findall(whole[i]))
    assert sum(len(WORD.findall(t or "")) for _, t in rows_of(out)) == sum(r["taken"] for r in m.collect())


def test_empty_tables(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert simhash.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none, mixing.mix(none)).count() == 0
    assert substring_dedup.deduplicated(none).count() == 0
    assert sentencepiece_codec.encode(none, MODEL).count() == 0


def test_registered():
    assert {"op3_simhash", "op5_sentencepiece", "op8_mixing", "op10_substring_dedup"} <= set(queries.QUERIES)


def test_window_runs_hold_little_memory():
    """Of 6 MB of short texts only a few are spread into arrays at a time."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 400).tolist())) for _ in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2200), pa.int64()), pa.array(range(2200), pa.int64()), pa.array(texts)], ["doc_id", "text_key", "text"])
    tracemalloc.start()
    windows = 0
    for out in substring_dedup._window_runs(50)([batch]):
        windows += sum(len(h) // 6 for h in out.column("hashes").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == 2200 * 351 and peak < 100e6
