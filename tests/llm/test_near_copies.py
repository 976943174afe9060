"""Near copies of the pipeline against exact Jaccard similarity of five-word shingles."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa

from concord.llm import near_copies


def brute_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_roots(rows):
    sets = [brute_shingles(t) for _, t in rows]
    holds = defaultdict(set)
    for k, s in enumerate(sets):
        for g in s:
            holds[g].add(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holds[g]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                root[find(k)] = find(j)
    return [find(k) for k in range(len(rows))]


def test_stage_keeps_one_of_each_group_of_near_copies(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").where("text rlike '\\\\S'")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    least = {}
    for (i, _), r in zip(rows, brute_roots(rows), strict=True):
        least[r] = min(i, least.get(r, i))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == sorted(least.values())


def test_large_group_of_near_copies_and_common_passage(spark):
    """600 edits of one text are one group; 300 texts that share a passage stay apart."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(600):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}-{k}" for k in range(60)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, *range(1000, 1300)]


def test_repeated_and_null_ids_keep_every_text_once(spark):
    """Two texts under one id both stay; copies without an id give one row."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, b)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c)], key=str)


def test_large_buckets_lose_no_link(spark):
    """Short texts that differ in a few words: many share a bucket, which is split over tasks, and links run across its parts."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            words[int(at)] = f"x{int(rng.integers(0, 3))}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in near_copies.near_copies(df, pairwise=4, hot_rows=16).collect()}
    want = dict(zip(range(500), brute_roots(rows), strict=True))
    by = lambda roots: sorted(sorted(i for i in roots if roots[i] == r) for r in set(roots.values()))
    assert by(got) == by(want) and len(by(want)) > 3


def test_trie_self_join_finds_what_bands_miss(spark):
    """With one band of 400 minima, texts within two bits of SimHash meet by the trie all the same; those further apart in sets stay apart."""
    rng = np.random.default_rng(5)
    rows, bits = [], {}
    for i in range(40):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 1500)]
        edited = [*words[:700], f"x{i}", *words[701:]]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        a, b = (near_copies.majority(near_copies.shingles(t.encode())) for _, t in rows[-2:])
        bits[i] = (a ^ b).bit_count()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in near_copies.near_copies(df, bands=1, rows=400).collect()}
    near = [i for i in bits if bits[i] <= 2]
    assert len(near) > 20 and all(got[2 * i] == got[2 * i + 1] for i in near)
    assert len(set(got.values())) >= 40


def bucket(n, bits):
    """A batch of one bucket of n nodes whose fingerprints differ in a few bits."""
    rng = np.random.default_rng(n)
    fp = np.zeros(n, np.uint64)
    for _ in range(bits):
        fp ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    cols = {"val": np.zeros(n, np.int64), "salt": np.zeros(n, np.int64), "large": np.zeros(n, bool), "node": rng.permutation(n).astype(np.int64), "size": np.full(n, 100), "fp": fp.view(np.int64)}
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], list(cols))


def test_large_bucket_gives_two_rows_a_node_and_connects_it():
    for n in (200, 400, 1500):
        got = pa.Table.from_batches(near_copies._candidates(32)(iter([bucket(n, 6)]))).to_pylist()
        pairs = [(r["u"], r["v"]) for r in got if r["val"] is None]
        assert len(got) - len(pairs) == n and len(pairs) < n and all(u < v for u, v in pairs)
        root = list(range(n))
        for _ in range(n):
            for u, v in pairs:
                root[u] = root[v] = min(root[u], root[v])
            if not any(root):
                break
        assert not any(root)
    small = pa.Table.from_batches(near_copies._candidates(32)(iter([bucket(32, 6)])))
    assert small.num_rows == 32 * 31 // 2


def test_blocks_across_components_give_a_forest():
    """Sixty components of one node each that are all near: 59 links, not 1,770."""
    n = 60
    found = [np.arange(200, dtype=np.int64)] * n
    kinds = np.repeat([0, 1], n)
    node = np.tile(np.arange(n), 2)
    cols = {"val": np.zeros(2 * n, np.int64), "block": np.zeros(2 * n, np.int32), "kind": kinds.astype(np.int32), "node": node, "size": np.full(2 * n, 200), "fp": np.zeros(2 * n, np.int64), "root": node, "minor": node > 0}
    arrays = [pa.array(c) for c in cols.values()] + [pa.array([bytes(120)] * 2 * n, pa.binary()), pa.array(found * 2, pa.list_(pa.int64()))]
    got = pa.Table.from_batches(near_copies._across(iter([pa.RecordBatch.from_arrays(arrays, [*cols, "signs", "found"])])))
    root = list(range(n))
    for u, v in sorted(zip(*(got.column(c).to_pylist() for c in "uv"), strict=True)) * n:
        root[u] = root[v] = min(root[u], root[v])
    assert got.num_rows == n - 1 and not any(root)


def test_odd_and_empty_rows(spark, odd_docs):
    none = odd_docs.where("false")
    assert near_copies.near_copies(none).count() == 0 and near_copies.one_of_each(none, near_copies.near_copies(none)).count() == 0
    kept = near_copies.one_of_each(odd_docs, near_copies.near_copies(odd_docs))
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(12) == 1 and len([i for i in ids if i in (4, 5, 6)]) == 1
