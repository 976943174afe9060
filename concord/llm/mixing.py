"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order (null last) get the repeating weights and share all words; a
source's target stops at ``max_repeat`` times its size and the excess is shared again by
weight among the rest. A source gives its target to the word. Every source's documents stand
in a seeded order as one sequence of words cut into blocks of equal length (the last one is
shorter). Blocks are allotted to sources by highest quotient target / (2 n + 1) until each has
those its words need; consecutive runs of that allotment are the shards' integer quotas. Shard
after shard draws its quota of each source from that source's blocks in seeded order, all
blocks once for each whole pass, then as many as are left to take, the last cut to size. What a
document takes is the overlap of its words with those blocks; ``shards`` says where each pass
over it goes: to the shard of the block in which its first word taken stands.

A null or empty text has no words and takes none; its row stays. A null source is a source
of its own. Rows that repeat an id are told apart by their text and source; rows equal in all
three are interchangeable, and each has a take of its own. A document longer than a block
overlaps several. An empty table gives an empty result. Columns of other names are ignored,
also where they clash with those of the result. Results depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import numbered, ship, written

ship(__name__)

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...], max_repeat: int) -> list[float]:
    """Words that each source should give; sums to all words unless the caps forbid it."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = float(sum(sizes))
    while open_:
        per = left / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * per > max_repeat * sizes[i]]
        if not full:
            for i in open_:
                out[i] = w[i] * per
            break
        for i in full:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(want: list[float], blocks: int, cap: list[int]) -> tuple[list[int], list[int]]:
    """Quota of each source, and the source of each allotted block in order of quotient."""
    quota, order = [0] * len(want), []
    heap = [(-x, i) for i, x in enumerate(want) if x > 0 and cap[i] > 0]
    heapq.heapify(heap)
    while heap and len(order) < blocks:
        _, i = heapq.heappop(heap)
        quota[i] += 1
        order.append(i)
        if quota[i] < cap[i]:
            heapq.heappush(heap, (-want[i] / (2 * quota[i] + 1), i))
    return quota, order


def word_quotas(want: list[float], cap: list[int]) -> list[int]:
    """Words that each source gives: within one of its target, and together the rounded sum of all targets.

    Every source gets its whole words, then the words left go one each by highest quotient.
    """
    take = [min(int(x), c) for x, c in zip(want, cap, strict=True)]
    left = round(sum(want)) - sum(take)
    for i in sorted((i for i in range(len(want)) if take[i] < min(want[i], cap[i])), key=lambda i: (-want[i] / (2 * take[i] + 1), i))[: max(0, left)]:
        take[i] += 1
    return take


def plan(sizes: list[tuple[str | None, int]], weights, max_repeat: int, max_blocks: int, shards: int, seed: int) -> dict:
    """Targets, quotas and the blocks taken, from the words of each source (sorted, null last).

    ``blocks``: source, block, whole passes, words of the last pass before it and in it, the
    shards of the whole passes over it, that of its part in the last pass, and that of the
    next block with one (-1: none).
    """
    import xxhash

    words = [n for _, n in sizes]
    total = sum(words)
    block = max(1, -(-total // max_blocks))
    want = targets(words, weights, max_repeat)
    give = word_quotas(want, [max_repeat * n for n in words])
    drawn: list[list[tuple[int, int, int]]] = []  # of each source: pass, block, words, in the order in which shards draw
    for i, (source, n) in enumerate(sizes):
        passes, rest = divmod(give[i], n) if n else (0, 0)
        own = []
        for k in range(passes + (rest > 0)):
            left = rest if k == passes else n
            for b in sorted(range(-(-n // block)), key=lambda b: (xxhash.xxh64_intdigest(f"{source!r}:{k}:{b}", seed), b)):
                if not left:
                    break
                got = min(left, block, n - b * block)
                own.append((k, b, got))
                left -= got
        drawn.append(own)
    quota, order = apportion(want, sum(map(len, drawn)), list(map(len, drawn)))
    run = -(-len(order) // shards) if order else 1
    by_shard = [[0] * len(words) for _ in range(shards)]
    for k, i in enumerate(order):
        by_shard[k // run][i] += 1
    blocks = []
    for i, (_, n) in enumerate(sizes):
        if not n:
            continue
        passes, count = give[i] // n, -(-n // block)
        goes = [s for s in range(shards) for _ in range(by_shard[s][i])]
        whole, got, part = [[-1] * passes for _ in range(count + 1)], [0] * (count + 1), [-1] * (count + 1)
        for (k, b, taken), s in zip(drawn[i], goes, strict=True):
            if k < passes:
                whole[b][k] = s
            else:
                got[b], part[b] = taken, s
        after = [-1] * (count + 1)
        for b in range(count - 1, -1, -1):
            after[b] = part[b + 1] if part[b + 1] >= 0 else after[b + 1]
        before = 0
        for b in range(count + 1):
            blocks.append((i, b, passes, before, got[b], whole[b], part[b], after[b]))
            before += got[b]
    return {"block": block, "targets": want, "give": give, "quota": quota, "by_shard": by_shard, "blocks": blocks}


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, max_blocks: int = 16_384, shards: int = 16, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, head (words that stand before those of the last, partial take) and shards (a shard for each take).

    The words of each source are gathered by the driver (one row a source); the table of
    blocks has at most ``max_blocks`` rows and two more a source.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sizes = sorted(((r["source"], r["n"]) for r in totals), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    p = plan(sizes, weights, max_repeat, max_blocks, shards, seed)
    facts = spark.createDataFrame([(s, i, n, float(t)) for i, ((s, n), t) in enumerate(zip(sizes, p["targets"], strict=True))], "_source string, _i int, source_size long, target double")
    ranges = spark.createDataFrame(p["blocks"], "_bi int, _bb long, passes long, before long, got long, whole array<int>, part int, after int")
    block = p["block"]
    rows = sized.join(F.broadcast(facts) if len(sizes) <= 65_536 else facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = numbered(rows, ["_i"], ["doc_id", "text_key"], "size", seed)
    side = F.broadcast if len(p["blocks"]) <= 2 * max_blocks + 131_072 else (lambda x: x)
    for n, x in (("0", F.col("start")), ("1", F.col("start") + F.col("size"))):
        at = side(ranges.toDF(*[f"{c}{n}" for c in ranges.columns]))
        rows = rows.withColumn(f"x{n}", x).withColumn(f"_k{n}", F.floor(F.col(f"x{n}") / F.lit(block)).cast("long"))
        rows = rows.join(at, (F.col("_i") == F.col(f"_bi{n}")) & (F.col(f"_k{n}") == F.col(f"_bb{n}")), "left")
        rows = rows.withColumn(f"f{n}", F.col(f"before{n}") + F.least(F.col(f"got{n}"), F.col(f"x{n}") - F.col(f"_k{n}") * block))
    part = F.coalesce(F.col("f1") - F.col("f0"), F.lit(0))
    first_left = F.greatest(F.lit(0), F.col("got0") - (F.col("x0") - F.col("_k0") * block))
    last = F.when(first_left > 0, F.col("part0")).otherwise(F.col("after0"))
    goes = F.concat("whole0", F.when(part > 0, F.array(last)).otherwise(F.array().cast("array<int>")))
    return rows.select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce(F.col("passes0"), F.lit(0)) * F.col("size") + part).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.when((part > 0) & (first_left <= 0), F.col("size") - part).otherwise(F.lit(0)).cast("long").alias("head"),
        F.when(F.col("size") > 0, goes).otherwise(F.array().cast("array<int>")).alias("shards"),
    )


def mixed_documents(docs: DataFrame, mixture: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each whole pass over a document, and one with the span of words that a last, partial pass takes.

    Rows equal in id, text and source are numbered, and the n-th gets the n-th of their takes, of which few differ.
    """
    key = lambda i, k, s: F.struct(i.cast("long").alias("i"), k.alias("k"), s.cast("string").alias("s"))
    same = mixture.groupBy(key(F.col("doc_id"), F.col("text_key"), F.col("source")).alias("_key"), "taken", "size", "head").agg(F.count("*").alias("n"))
    need = same.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("taken", "size", "head", "n"))).alias("_takes")).where(F.exists("_takes", lambda t: t["taken"] > 0))
    upto = F.aggregate("_takes", F.array().cast("array<bigint>"), lambda acc, t: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + t["n"])))
    need = need.withColumn("_upto", upto)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(source_col)).alias("_key")).join(need, "_key")
    number = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(F.to_json("_row")))) - 1
    rows = rows.withColumn("_n", number).withColumn("_take", F.get("_takes", F.size(F.filter("_upto", lambda x: x <= F.col("_n"))))).where("_take.taken > 0")
    taken, size, head = (F.col(f"_take.{c}") for c in ("taken", "size", "head"))
    whole, rest = F.floor(taken / size).cast("int"), taken % size
    copies = F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), F.when(rest > 0, 1).otherwise(0)))
    rows = rows.select("_row", F.explode(copies).alias("_part"), rest.alias("_rest"), head.alias("_head"))
    words = F.regexp_extract_all(F.col(f"_row.{text_col}"), F.lit(f"({WORD})"), F.lit(1))
    span = F.array_join(F.slice(words, (F.col("_head") + 1).cast("int"), F.col("_rest").cast("int")), " ")
    text = F.when(F.col("_part"), span).otherwise(F.col(f"_row.{text_col}"))
    out = rows.select("_row", text.alias("_text"))
    columns = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
