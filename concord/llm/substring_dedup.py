"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, judged in Spark.

A word's hash is its XXH64; a window's is the polynomial over its words' hashes modulo
2**64, computed for all windows of a slice from one prefix sum. Equal windows hold equal
half-windows, so the smallest half-window hash in a window (its anchor) is the same
wherever the window stands. Windows are shuffled by anchor, a run of neighbours with one
anchor in one row, six bytes a window: with the anchor 112 bits tell windows apart. What a
map task sees twice it settles itself, so a passage that a third of all documents share
reaches its reducer once a slice. The reducer orders an anchor's rows by document and
gives, for each run of windows that stand in a smaller document too, one removal interval.

A phrase shorter than a window that very many documents share makes one anchor of windows that
all differ, which no map task can settle. Such anchors are found beforehand from one row in
``SAMPLED`` by a hash (those of ``HOT_WINDOWS`` windows or more there, the ``HOT_MOST`` largest), and their windows travel by anchor and window hash, each alone. Equal
windows meet either way: the sample decides where windows are judged, never the result.

A null text has no words. Texts of fewer words than a window lose nothing. Rows with a
null id neither remove nor lose words, as no id is smaller or larger. Rows that repeat an id
don't remove from each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import row_key, ship, slices, texts_of

ship(__name__)

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SAMPLED, HOT_WINDOWS, HOT_MOST = 32, 256, 65_536
#: Bytes of text whose windows a map task holds at a time; their arrays take some fifty times that.
WINDOW_BYTES = 2 << 20
RUN = "anchor long, doc_id long, text_key long, first int, hashes binary, settled int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k below n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` values (none if there are fewer)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h))
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
        x = (s[width:] - s[:-width]) * up[: len(h) - width + 1]
    return rolling_spread(x)


def rolling_spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of bits: low bits of a polynomial depend on low bits only."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def dealt(anchor: np.ndarray, full: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Anchors to shuffle by; hot ones are told apart by the 16 bits of the window hash that don't travel."""
    if not len(hot):
        return anchor
    salted = rolling_spread(anchor ^ ((full & np.uint64(0xFFFF)) + np.uint64(1)) * BASE)
    return np.where(hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor, salted, anchor)


NONE = np.zeros(0, np.uint64)


def _window_runs(window: int, hot: np.ndarray = NONE):
    """``hot``: sorted anchors whose windows travel each alone."""
    half = window // 2

    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids, keys = np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key"))
            for lo, hi in slices(texts, WINDOW_BYTES):
                words = []
                doc, length = [], []
                for i in range(lo, hi):
                    h = texts[i].split()
                    if len(h) >= window:
                        words.append(np.fromiter(map(digest, h), np.uint64, len(h)))
                        doc.append(i)
                        length.append(len(h))
                if not doc:
                    continue
                doc, length = np.array(doc), np.array(length)
                flat = np.concatenate(words)
                full = rolling(flat, window)
                anchor = sliding_min(rolling(flat, half), window - half + 1)
                at = np.repeat(np.cumsum(length) - length, length)  # where the document of each word begins
                start = np.arange(len(flat)) - at
                own = np.repeat(np.arange(len(doc)), length)
                good = np.flatnonzero((start + window <= length[own])[: len(full)])
                w, d, s = full[good], own[good], start[good]
                a = dealt(anchor[good], w, hot)
                order = np.argsort(w, kind="stable")
                ws, ids_of = w[order], ids[doc[d]]
                head = np.concatenate([[True], ws[1:] != ws[:-1]])
                group = np.cumsum(head) - 1
                least = np.minimum.reduceat(ids_of[order], np.flatnonzero(head))
                settled = np.zeros(len(w), bool)
                settled[order] = ids_of[order] > least[group]
                cut = np.concatenate([[True], (d[1:] != d[:-1]) | (settled[1:] != settled[:-1]) | (~settled[1:] & (a[1:] != a[:-1]))])
                first = np.flatnonzero(cut)
                count = np.diff(np.append(first, len(w)))
                done = settled[first]
                size = np.where(done, 0, count * 6)
                blob = np.ascontiguousarray((w[~settled] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[first].view(np.int64)), pa.array(ids[doc[d[first]]]), pa.array(keys[doc[d[first]]]), pa.array(s[first].astype(np.int32)), hashes, pa.array(np.where(done, count, 0).astype(np.int32))],
                    ["anchor", "doc_id", "text_key", "first", "hashes", "settled"],
                )

    return run


def _judge(chunk: int = 1_000_000):
    """Reads runs sorted by anchor and document; gives intervals [begin, end] of window starts to remove."""
    names = ["doc_id", "text_key", "begin", "end"]

    def solve(anchor, doc, key, first, n, w, carry):
        """carry: anchor, window hashes and smallest documents of an anchor begun before."""
        row = np.repeat(np.arange(len(n)), n)
        start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        group = (np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1)[row]
        ids = doc[row]
        more = len(carry[1]) if carry and carry[0] == anchor[0] else 0
        if more:
            w, ids, group = np.concatenate([carry[1], w]), np.concatenate([carry[2], ids]), np.concatenate([np.zeros(more, np.int64), group])
        order = np.lexsort((w, group))
        ws, gs = w[order], group[order]
        head = np.concatenate([[True], (ws[1:] != ws[:-1]) | (gs[1:] != gs[:-1])])
        least = np.minimum.reduceat(ids[order], np.flatnonzero(head))
        remove = np.zeros(len(w), bool)
        remove[order] = ids[order] > least[np.cumsum(head) - 1]
        last = gs[head] == group[-1]
        carry = (anchor[-1], ws[head][last], least[last])
        hit = np.flatnonzero(remove[more:])
        row, start = row[hit], start[hit]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(hit) else np.zeros(0, int)
        end = start[np.append(new[1:], len(hit)) - 1] if len(hit) else start
        return pa.RecordBatch.from_arrays([pa.array(doc[row[new]]), pa.array(key[row[new]]), pa.array(start[new].astype(np.int32)), pa.array(end.astype(np.int32))], names), carry

    def run(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("anchor", "doc_id", "text_key", "first")]
            hashes = batch.column("hashes")
            lengths = np.diff(np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset : hashes.offset + len(hashes) + 1]) // 6
            data = np.frombuffer(hashes.buffers()[2] or b"", np.uint8)
            from_ = np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset]
            raw = data[from_ : from_ + int(lengths.sum()) * 6].reshape(-1, 6)
            w = np.zeros((len(raw), 8), np.uint8)
            w[:, :6] = raw
            w = w.view("<u8").ravel()
            settled = np.asarray(batch.column("settled"))
            if (done := settled > 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][done]), pa.array(cols[2][done]), pa.array(cols[3][done]), pa.array(cols[3][done] + settled[done] - 1)], names)
            keep = np.flatnonzero(~done)
            total = np.concatenate([[0], np.cumsum(lengths[keep])])
            lo = 0
            while lo < len(keep):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + chunk, "right")) - 1)
                rows = keep[lo:hi]
                out, carry = solve(*(c[rows] for c in cols), lengths[rows], w[total[lo] : total[hi]], carry)
                if out.num_rows:
                    yield out
                lo = hi

    return run


def hot_anchors(rows: DataFrame, window: int, sampled: int, least: int) -> np.ndarray:
    """Sorted anchors of many unsettled windows, from one row in ``sampled``."""
    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id", "text_key"), F.lit(sampled)) == 0)
    runs = some.mapInArrow(_window_runs(window), RUN)
    counts = runs.where("settled = 0").groupBy("anchor").agg((F.sum(F.octet_length("hashes")) / 6).cast("long").alias("n"))
    many = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(HOT_MOST).collect()
    return np.sort(np.array([r["anchor"] for r in many], np.int64).view(np.uint64))


def removals(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and spans, an array of (begin, end) of the first words of windows to remove."""
    rows = docs.where(F.col(id_col).isNotNull()).select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    runs = rows.mapInArrow(_window_runs(window, hot_anchors(rows, window, SAMPLED, HOT_WINDOWS)), RUN)
    found = runs.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_judge(), "doc_id long, text_key long, begin int, end int")
    return found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def kept_mask(n: int, begins: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which of n words no removed window covers."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, begins, 1)
    np.add.at(delta, np.minimum(ends + window, n), -1)
    return np.cumsum(delta)[:n] == 0


def dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept (the words left, joined by a space) and carried columns.

    Columns of ``docs`` other than the id and the text are carried along in ``with_text``.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)] if with_text else []
    spans = removals(docs, window, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(c) for c in others]).alias("others")] if others else []))
    rows = rows.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").drop("_id", "_key", "text_key")

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            spans, lists = batch.column("spans"), batch.column("spans").flatten()
            begins, ends = (np.asarray(lists.field(i)) for i in (0, 1)) if len(lists) else (np.zeros(0, int), np.zeros(0, int))
            counts = np.asarray(spans.value_lengths().fill_null(0))
            at = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in slices(texts):
                n_words, n_removed, digests, kept = [], [], [], []
                for i in range(lo, hi):
                    words = texts[i].split()
                    removed = 0
                    n_words.append(len(words))
                    if counts[i]:
                        mask = kept_mask(len(words), begins[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], window)
                        removed = len(words) - int(mask.sum())
                        words = [words[k] for k in np.flatnonzero(mask)]
                    n_removed.append(removed)
                    out = b" ".join(words)
                    digests.append(hashlib.sha256(out).hexdigest())
                    if with_text:
                        kept.append(out if removed else texts[i])
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("kept")
                if others:
                    cols.append(batch.column("others").slice(lo, hi - lo))
                    names.append("others")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    if others:
        from pyspark.sql import types as T

        full = T._parse_datatype_string(schema)
        return rows.mapInArrow(run, full.add("others", rows.schema["others"].dataType))
    return rows.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the texts; documents of which nothing is left go, unless they were empty before."""
    out = dedup(docs, window, id_col, text_col).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cols = []
    for f in docs.schema.fields:
        if f.name == id_col:
            cols.append(F.col("doc_id").cast(f.dataType).alias(id_col))
        elif f.name == text_col:
            cols.append(F.col("kept").alias(text_col))
        elif f.name == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("others.n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col("others")[f.name].alias(f.name))
    return out.select(*cols)
