"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join.

Fingerprints are equal for equal texts, so the join runs over distinct fingerprints. It is
spread by the pigeonhole rule: two fingerprints that differ in at most ``budget`` bits
agree on one of ``budget + 1`` blocks, so each is sent to one group a block. A group larger
than ``group_limit`` is split by the same rule over its remaining bits, twice at most, after
which about 18 bits of 64 are free and a group can't hold more than 2**19 fingerprints.
Inside a group the trie of the sorted fingerprints is joined with itself: node pairs go
down together, differing bits add up, and a pair that exceeds the budget is dropped. Each
group gives only a spanning forest of its links, so dense groups cost a row a member.
Components follow from alternating large-star and small-star steps over those links.

A null or empty text has no words and the fingerprint zero, which links like any other.
Rows with a null id take part; a component of such rows alone has the id null. Repeated
rows repeat in the result. An empty table gives an empty result. Whole texts are read, one
at a time, however long. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import row_key, ship, texts_of, written

ship(__name__)

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles; a bit is 1 if set in over half of them."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        part = h[lo : lo + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint as a signed long) of every row; one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if np.array_equal(up, i):
            return i
        parent[i] = parent[up]
        i = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b; roots are the smallest members."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_forest(fps: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int, frontier: int = 500_000) -> np.ndarray:
    """Smallest index linked to each of ``fps`` (uint64), which are sorted within each range.

    Every range [start, end) is the root of a binary trie over the bits from the highest; a
    node is a range. At most about ``frontier`` node pairs are open at a time at each level.
    """
    parent = np.arange(len(fps))
    a0, a1 = start.astype(np.int64), end.astype(np.int64)
    work = [(63, a0, a1, a0, a1, np.zeros(len(a0), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while work:
        bit, a0, a1, b0, b1, diff = work.pop()
        if len(a0) > frontier:
            for lo in range(0, len(a0), frontier):
                s = slice(lo, lo + frontier)
                work.append((bit, a0[s], a1[s], b0[s], b1[s], diff[s]))
            continue
        pairs = (a1 - a0) * (b1 - b0)
        small = pairs <= 16 if bit >= 0 else pairs > 0
        if small.any():  # few leaves below both nodes: compare them at once
            s0, n1, t0, n2 = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            count = n1 * n2
            of = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            i, j = s0[of] + k // n2[of], t0[of] + k % n2[of]
            near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            _union(parent, i[near], j[near])
            go = ~small
            a0, a1, b0, b1, diff = a0[go], a1[go], b0[go], b1[go], diff[go]
        if not len(a0):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        left, right, cross, back = (a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am, a1, b0, bm)
        kids = []
        for (x0, x1, y0, y1), more, keep in ((left, 0, None), (right, 0, None), (cross, 1, None), (back, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (diff + more <= budget)
            if keep is not None:
                ok &= keep
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], (diff[ok] + more).astype(np.int8)))
        work.append((bit - 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))
    return _find(parent, np.arange(len(fps)))


def block_masks(bits: list[int], parts: int) -> list[tuple[int, list[int]]]:
    """Split bit positions in even blocks; each block's mask and the positions that stay free."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [(sum(1 << b for b in bits[lo:hi]), bits[:lo] + bits[hi:]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _group_links(budget: int, chunk: int = 200_000):
    """Reads rows (mask, val, fp) sorted by group; gives the links of each group's forest."""

    def solve(mask, val, fp):
        order = np.lexsort((fp, val, mask))
        mask, val, fp = mask[order], val[order], fp[order]
        first = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])]))
        root = trie_forest(fp, first, np.append(first[1:], len(fp)), budget)
        linked = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["u", "v"])

    def run(batches):
        held: list[tuple] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.asarray(batch.column(c)).view(np.uint64) if c == "fp" else np.asarray(batch.column(c)) for c in ("mask", "val", "fp")))
            count += batch.num_rows
            if count >= chunk:
                mask, val, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                open_ = int(np.flatnonzero((mask == mask[-1]) & (val == val[-1]))[0])  # the last group may go on
                if open_:
                    yield solve(mask[:open_], val[:open_], fp[:open_])
                held, count = [(mask[open_:], val[open_:], fp[open_:])], len(fp) - open_
        if count:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, budget: int = 2, group_limit: int = 4096, levels: int = 3) -> DataFrame:
    """Links (u, v) that connect the fingerprints ``fp`` within ``budget`` bits of each other."""
    found = None
    split = [(0, list(range(63, -1, -1)))]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(levels):
        children = {m: [(m | k, free) for k, free in block_masks(bits, budget + 1)] for m, bits in split}
        arrays = F.array(*[F.lit(_signed(k)) for kids in children.values() for k, _ in kids]) if level == 0 else None
        if level:
            arrays = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
            for m, kids in children.items():
                arrays = arrays.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(k)).cast("long") for k, _ in kids]))
        rows = rows.select("fp", F.explode(arrays).alias("mask")).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        counts = rows.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n > 1")
        keyed = rows.join(counts, ["mask", "val"])
        last = level == levels - 1
        ready = keyed if last else keyed.where(F.col("n") <= group_limit)
        part = ready.select("mask", "val", "fp").repartition("mask", "val").sortWithinPartitions("mask", "val").mapInArrow(_group_links(budget), "u long, v long")
        found = part if found is None else found.unionByName(part)
        split = [x for kids in children.values() for x in kids]
        if last or counts.where(F.col("n") > group_limit).isEmpty():
            break
        rows = keyed.where(F.col("n") > group_limit).select("fp", "mask")
    return found


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links (u, v)."""

    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now = written(small.where("u <> v").distinct(), "links")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, group_limit: int = 4096) -> DataFrame:
    """doc_id, text_key, fp, fingerprint (16 hex digits), root (a fingerprint of the component) and component_id, the smallest doc_id reachable over links of at most ``budget`` bits."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, budget, group_limit))
    root = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = root.groupBy("root").agg(F.min("least").alias("component_id"))
    label = root.join(best, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return fps.join(label, F.col("fp") == F.col("_fp")).select("doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``classes`` (doc_id, text_key, root): that of the smallest doc_id (null last), then of the smallest text_key.

    Texts that share an id are told apart by their text; of rows equal in both the one with the smallest hash of all columns stays.
    """
    from pyspark.sql import Window

    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("m")
    keep = classes.groupBy("root").agg(first).select(F.col("m.doc_id").alias("_id"), F.col("m.text_key").alias("_key"))
    own = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in docs.columns])))
    rows = docs.select(*docs.columns, own.alias("_own")).join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_key")))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_own"))).where("_n = 1")
    return once.select(*docs.columns)
