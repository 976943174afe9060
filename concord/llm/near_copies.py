"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash first: the fingerprints of all shingle sets go through the binary
trie self-join of ``simhash``, and each class of fingerprints that links of at most ``budget``
bits connect is a bucket. SimHash alone can't find the rest: at 0.8 two fingerprints of 64 bits
differ in about 10 bits, and with budgets that wide neither the trie nor blocks of bits prune
anything. So MinHash adds further buckets beside it: ``bands`` bands of ``rows`` minima each; two
texts meet if one band agrees. At similarity 0.8 a pair meets with probability
1 - (1 - 0.8**5)**24, 0.99993, by the bands alone. A pair whose SimHash fingerprints differ in more
than ``APART`` bits is left out (texts of 50 shingles or more; at 0.8 that many differ with
probability below 1e-6). Each remaining pair is verified on the exact sets (64-bit hashes of
shingles), and verified pairs are links of components. Texts with equal sets are one node from
the start.

In a bucket of at most ``pairwise`` nodes all pairs are candidates. A larger one is first dealt
by node into chunks of ``TREE`` times that size; the pairs nearest by SimHash that
connect a chunk are candidates, less than one a node, and the chunks' smallest nodes are dealt
again. A bucket of more than ``hot_rows`` nodes is split over tasks, each node meeting the
bucket's smallest. Where a large bucket's nodes then lie in several components, all pairs of
nodes in different components are compared too, sets beside them, in blocks over many tasks
that give a forest of the links, so no two components stay apart that a link joins.

A null text is the empty one. A text of fewer than five words is one shingle; texts without
words are one node. Rows with a null id take part. Repeated rows repeat in the result; an
empty table gives an empty one. Whole texts are read, however long. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import row_key, ship, texts_of, written
from concord.llm.simhash import components, links, majority
from concord.llm.simhash import one_of_each as one_of_each  # the same for these classes

ship(__name__)

SEED = 43
APART, LONG = 26, 50
AGREE = 0.62
#: A large bucket's chunks are so many times larger than the buckets of which all pairs are compared.
TREE = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) word shingles."""
    import xxhash

    words = text.lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return h
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
    return np.unique(_mix(total + np.uint64(n)))


def node_of(found: np.ndarray) -> int:
    """One hash for the whole set."""
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def minima(found: np.ndarray, count: int) -> np.ndarray:
    """The set's minima under ``count`` seeded functions."""
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 64, count, np.uint64) for _ in range(2))
    a |= np.uint64(1)
    least = np.full(count, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(found), 2048):
        np.minimum(least, (found[lo : lo + 2048, None] * a + b).min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band of ``rows`` minima."""
    total = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + least[k::rows])
    return total


def sketches(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, node, size (shingles), fp (SimHash), a byte of each minimum and band hashes of every row."""

    def run(batches):
        for batch in batches:
            found = [shingles(t) for t in texts_of(batch.column("text"))]
            nodes = np.fromiter(map(node_of, found), np.uint64, len(found)).view(np.int64)
            size = np.fromiter(map(len, found), np.int64, len(found))
            fps = np.fromiter(map(majority, found), np.uint64, len(found)).view(np.int64)
            least = [minima(f, bands * rows) for f in found]
            own = np.concatenate([band_hashes(x, bands, rows) for x in least] or [np.zeros(0, np.uint64)]).view(np.int64)
            signs = pa.array([(_mix(x) >> np.uint64(56)).astype(np.uint8).tobytes() for x in least], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands), pa.array(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(nodes), pa.array(size), pa.array(fps), signs, lists], ["doc_id", "text_key", "node", "size", "fp", "signs", "bands"])

    text = F.col(text_col).cast("string").alias("text")
    return docs.select(*row_key(id_col, text_col), text).mapInArrow(run, "doc_id long, text_key long, node long, size long, fp long, signs binary, bands array<long>")


def plausible(sa: np.ndarray, fa: np.ndarray, sb: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Whether sizes and fingerprints allow a similarity of 0.8."""
    small = np.minimum(sa, sb)
    return (5 * small >= 4 * np.maximum(sa, sb)) & ((small < LONG) | (np.bitwise_count(fa ^ fb) <= APART))


def nearest_tree(size: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of indices: a spanning forest of the plausible pairs with the fewest differing bits of SimHash."""
    far = np.where(plausible(size[:, None], fp[:, None], size, fp), np.bitwise_count(fp[:, None] ^ fp).astype(np.int64), 255)
    least, at, free, out = far[0].copy(), np.zeros(len(fp), np.int64), np.ones(len(fp), bool), []
    free[0] = False
    for _ in range(len(fp) - 1):
        j = int(np.argmin(np.where(free, least, 256)))
        if least[j] < 255:
            out.append((min(j, int(at[j])), max(j, int(at[j]))))
        free[j] = False
        closer = far[j] < least
        least[closer], at[closer] = far[j][closer], j
    return out


def bucket_pairs(node: np.ndarray, size: np.ndarray, fp: np.ndarray, pairwise: int, large: bool = False) -> list[tuple[int, int]]:
    """Candidate pairs (smaller node first) of one bucket: all of a small one, trees of a large one's chunks."""
    large |= len(node) > pairwise
    chunk = pairwise * TREE if large else pairwise
    order = np.argsort(node)
    todo, out = [(node[order], size[order], fp[order])], []
    while todo:
        n, s, f = todo.pop()
        if len(n) > chunk:
            part = _mix(n.view(np.uint64)) % np.uint64(-(-len(n) // chunk))
            heads = np.zeros(len(n), bool)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                heads[at[::chunk]] = True
                todo += [(n[x], s[x], f[x]) for x in (at[lo : lo + chunk] for lo in range(0, len(at), chunk))]
            if heads.sum() < len(n):
                todo.append((n[heads], s[heads], f[heads]))
            continue
        if large:
            out += [(int(n[i]), int(n[j])) for i, j in nearest_tree(s, f)]
            continue
        i, j = np.triu_indices(len(n), 1)
        near = plausible(s[i], f[i], s[j], f[j])
        out += zip(n[i[near]].tolist(), n[j[near]].tolist(), strict=True)
    return out


PAIRS = "u long, v long, val long, size long, fp long"


def _candidates(pairwise: int):
    """Reads rows (val, salt, large, node, size, fp) sorted by val and salt; gives each bucket's candidate pairs (u, v), and the members (u, val, size, fp) of large ones."""

    def solve(cols):
        val, salt, large, node, size, fp = cols
        first = np.flatnonzero(np.concatenate([[True], (val[1:] != val[:-1]) | (salt[1:] != salt[:-1])]))
        end = np.append(first[1:], len(val))
        found = {p for k in np.flatnonzero(end - first > 1) for p in bucket_pairs(node[first[k] : end[k]], size[first[k] : end[k]], fp[first[k] : end[k]], pairwise, bool(large[first[k]]))}
        u, v = zip(*found, strict=True) if found else ((), ())
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none, none, none], ["u", "v", "val", "size", "fp"])
        big = (np.repeat(end - first, end - first) > pairwise) | large
        if big.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[big]), pa.nulls(int(big.sum()), pa.int64()), pa.array(val[big]), pa.array(size[big]), pa.array(fp[big].view(np.int64))], ["u", "v", "val", "size", "fp"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("val", "salt", "large", "node", "size", "fp")}
            cols["fp"] = cols["fp"].view(np.uint64)
            held.append(tuple(cols.values()))
            count += batch.num_rows
            if count >= 200_000:
                cols = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                open_ = int(np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0])  # the last bucket may go on
                if open_:
                    yield from solve(tuple(c[:open_] for c in cols))
                held, count = [tuple(c[open_:] for c in cols)], len(cols[0]) - open_
        if count:
            yield from solve(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _across(batches):
    """Reads rows (val, block, kind, node, size, fp, root, minor, signs, found) sorted by the first three; gives links of kind 1 rows to kind 0 rows of their block in other components, each only if it joins two that the block's links before it leave apart.

    Two sets agree in a minimum with a probability of their similarity, so a pair that agrees in
    less than AGREE of 120 reaches 0.8 with a probability of 2e-6 at most; of the others the sets decide.
    """
    key, held, joined = None, [], {}

    def top(root: int) -> int:
        while (up := joined.get(root, root)) != root:
            joined[root] = joined.get(up, up)
            root = up
        return root

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in ("val", "block", "kind")], axis=1)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "fp", "root", "minor")]
        cols[2] = cols[2].view(np.uint64)
        cols.append(np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint8).reshape(len(k), -1))
        cols.append(batch.column("found").to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if key is None or (k[lo, :2] != key).any():
                key, held, joined = k[lo, :2].copy(), [], {}
            if k[lo, 2] == 0:
                held.append([c[lo:hi] for c in cols])
                continue
            if len(held) > 1:
                held = [[np.concatenate(x) for x in zip(*held, strict=True)]]
            for at in range(lo, hi, 64) if held else ():
                (n, s, f, r, _, g, sets), (hn, hs, hf, hr, hm, hg, own) = [c[at : min(hi, at + 64)] for c in cols], held[0]
                i, j = np.nonzero((r[:, None] != hr) & (~hm | (n[:, None] < hn)) & plausible(s[:, None], f[:, None], hs, hf))
                near = (g[i] == hg[j]).mean(axis=1) >= AGREE if len(i) else np.zeros(0, bool)
                hits = []
                for x, y in zip(i[near], j[near], strict=True):
                    one, other = top(int(r[x])), top(int(hr[y]))
                    if one != other and 9 * len(np.intersect1d(sets[x], own[y], assume_unique=True)) >= 4 * (s[x] + hs[y]):
                        joined[max(one, other)] = min(one, other)
                        hits.append((n[x], hn[y]))
                if hits:
                    u, v = np.array(hits, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def across(members: DataFrame, found: DataFrame, nodes: DataFrame, sets_of, block_rows: int = 512) -> DataFrame:
    """Links (u, v) of large buckets' ``members`` that lie in different components of ``found``: of each bucket all but its largest component against all."""
    rooted = members.join(found, F.col("u") == F.col("node"), "left").select("val", F.col("u").alias("node"), "size", "fp", F.coalesce("root", "u").alias("root"))
    by = rooted.groupBy("val", "root").agg(F.count("*").alias("c")).groupBy("val").agg(F.max(F.struct("c", "root"))["root"].alias("major"), F.sum("c").alias("n"), F.count("*").alias("roots"))
    open_ = by.where("roots > 1").select(F.col("val").alias("_v"), "major", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    rows = rooted.join(open_, F.col("val") == F.col("_v")).withColumn("minor", F.col("root") != F.col("major"))
    rows = rows.join(nodes.select("node", "signs"), "node").join(sets_of(rows.select("node").distinct()), "node")
    cols = ["node", "size", "fp", "root", "minor", "signs", "found"]
    held = rows.select("val", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), *cols)
    asked = rows.where("minor").select("val", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), *cols)
    return held.union(asked).repartition("val", "block").sortWithinPartitions("val", "block", "kind").mapInArrow(_across, "u long, v long")


def _sets(batches):
    for batch in batches:
        found = [shingles(t).view(np.int64) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])


def exact_sets(asked: DataFrame, all_: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and its set of shingles of the nodes ``asked``, each from one text."""
    least = F.min(F.struct("doc_id", "text_key")).alias("m")
    one = all_.groupBy("node").agg(least).join(asked, "node").select("node", F.col("m.doc_id").alias("_id"), F.col("m.text_key").alias("_key"))
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    texts = keyed.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return written(texts.select("node", "text").mapInArrow(_sets, "node long, found array<long>").dropDuplicates(["node"]), "sets")


def trie_classes(nodes: DataFrame, budget: int) -> DataFrame:
    """Buckets (val, node, size, fp): classes of fingerprints that the trie self-join connects over at most ``budget`` bits."""
    found = components(links(written(nodes.select("fp").distinct(), "fingerprints"), budget)).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    val = F.xxhash64(F.lit("trie"), F.coalesce("_root", "fp"))
    return nodes.join(found, F.col("fp") == F.col("_fp"), "left").select(val.alias("val"), "node", "size", "fp")


def near_copies(docs: DataFrame, bands: int = 24, rows: int = 5, pairwise: int = 32, hot_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """doc_id, text_key and root of every row; rows of one root are near copies, directly or over others."""
    all_ = written(sketches(docs, bands, rows, id_col, text_col), "sketches")
    nodes = written(all_.dropDuplicates(["node"]).select("node", "size", "fp", "signs", "bands"), "nodes")
    buckets = nodes.select(F.explode("bands").alias("val"), "node", "size", "fp").union(written(trie_classes(nodes, budget), "trie"))
    counts = buckets.groupBy("val").agg(F.count("*").alias("n"), F.min("node").alias("rep"))
    hot = counts.where(F.col("n") > hot_rows).select(F.col("val").alias("_v"), "n", "rep")
    dealt = buckets.join(hot, F.col("val") == F.col("_v"), "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("n") / hot_rows), F.lit(1))))
    told = dealt.select("val", "salt", F.col("n").isNotNull().alias("large"), "node", "size", "fp").repartition("val", "salt").sortWithinPartitions("val", "salt").mapInArrow(_candidates(pairwise), PAIRS)
    stars = dealt.where("node <> rep").select(F.least("node", "rep").alias("u"), F.greatest("node", "rep").alias("v"))
    told = written(told, "buckets")
    pairs = written(told.where("val IS NULL").select("u", "v").union(stars).distinct(), "candidates")
    sets_of = lambda asked: exact_sets(asked, all_, docs, id_col, text_col)
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    a, b = (sets.select(F.col("node").alias(n), F.col("found").alias(f)) for n, f in (("u", "fu"), ("v", "fv")))
    same = F.size(F.array_intersect("fu", "fv")) * 9 >= (F.size("fu") + F.size("fv")) * 4
    near = written(pairs.join(a, "u").join(b, "v").where(same).select("u", "v"), "near-links")
    found = components(near)
    members = told.where("val IS NOT NULL").drop("v")
    if not members.isEmpty():
        more = written(across(members, found, nodes, sets_of), "near-links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))  # stars already: few rounds join them
    found = found.withColumnRenamed("node", "_node")
    return all_.join(found, F.col("node") == F.col("_node"), "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
