"""Sharding by balanced label propagation.

Documents with equal texts are linked. As all copies of a text have one size, a group's
state is how many of its copies stand in each shard: a row a group, never the pairs. Copies
start in hashed shards. In each round every group takes the shard where most of its copies
stand; its copies elsewhere ask to move there, and each shard admits movers, those that save
most edges first, up to its capacity quota of bytes. Bytes are summed by edges saved, and by
hashed bucket where a shard's room ends, before movers are ordered inside one bucket, so no
task ranks all movers and the result is that of one global order, whatever the number of
rows. A group larger than a shard fills one after another. When rounds no longer move
anything, what exceeds a shard's capacity is given up, the largest loose documents are placed
by size on the emptiest shards and the rest fills what is free, so sizes are near equal.

A null text counts as the empty text for size and checksum. Null ids and repeated rows are
ordinary rows; equal texts tie by id, then by hash. With fewer documents than shards some
shards stay empty; an empty table gives an empty result. Texts are only measured and
hashed, so a very long one is a large size. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import hash_range, numbered, ship, written

ship(__name__)


CUT = "struct<saves: bigint, h: bigint, grp: string, shard: int, go: bigint>"


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard."""
    each = state.select("size", F.explode("cells").alias("c"))
    sums = each.agg(*[F.sum(F.when(F.col("c.shard") == s, F.col("c.n") * F.col("size"))) for s in range(shards)]).first()
    return [x or 0 for x in sums]


def _of(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), shard.cast("int") + 1)


def _cuts(asks: DataFrame, room: list[int], buckets: int) -> tuple[list[tuple | None], bool]:
    """For each shard the first of its movers ``asks`` (grp, size, shard, n, to, saves) for which not all copies have room, with how many have, when those that save most come first (ties by hash); None if all have room. And whether there are movers.

    Bytes are summed by edges saved, then by hashed bucket where the room ends; only that bucket is ordered.
    """
    rows = asks.withColumns({"h": F.xxhash64("grp", "shard"), "bytes": F.col("n") * F.col("size")})
    left, level = [max(0, r) for r in room], {}
    sums = sorted(((r["to"], -r["saves"], r["s"]) for r in rows.groupBy("to", "saves").agg(F.sum("bytes").alias("s")).collect()))  # about the root of the rows, as edges saved are copies of a text
    for to, saves, s in sums:
        if to not in level:
            if s > left[to]:
                level[to] = -saves
            else:
                left[to] -= s
    cuts: list[tuple | None] = [None] * len(room)
    if not level:
        return cuts, bool(sums)
    none = F.lit(None).cast("long")
    at = lambda found: F.get(F.array(*[F.lit(found[t]).cast("long") if t in found else none for t in range(len(room))]), F.col("to"))
    dealt = rows.where(F.col("saves") == at(level)).withColumn("_b", hash_range("h", buckets))
    bucket: dict[int, int] = {}
    for to, b, s in sorted((r["to"], r["_b"], r["s"]) for r in dealt.groupBy("to", "_b").agg(F.sum("bytes").alias("s")).collect()):
        if to not in bucket:
            if s > left[to]:
                bucket[to] = b
            else:
                left[to] -= s
    order = Window.partitionBy("to").orderBy("h", "grp", "shard").rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.where(F.col("_b") == at(bucket)).withColumn("before", F.sum("bytes").over(order) - F.col("bytes")).withColumn("left", _of(left, F.col("to")) - F.col("before"))
    for r in last.where((F.col("left") >= 0) & (F.col("left") < F.col("bytes"))).collect():
        cuts[r["to"]] = (-r["saves"], r["h"], r["grp"], r["shard"], r["left"] // r["size"])
    return cuts, True


def _go(cuts: list[tuple | None], to: Column, saves: Column, shard: Column, n: Column) -> Column:
    """How many of n copies in ``shard`` that ask for ``to`` have room there."""
    one = lambda c: F.struct(*[F.lit(x) for x in c]).cast(CUT) if c else F.lit(None).cast(CUT)
    cut = F.get(F.array(*[one(c) for c in cuts]), to)
    key = F.struct((-saves).alias("saves"), F.xxhash64(F.col("grp"), shard).alias("h"), F.col("grp").alias("grp"), shard.alias("shard"))
    end = F.struct(*[cut[x].alias(x) for x in ("saves", "h", "grp", "shard")])
    return F.when(cut.isNull() | (key < end), n).when(key == end, cut["go"]).otherwise(F.lit(0)).cast("long")


def propagate(rows: DataFrame, capacity: int, shards: int, rounds: int, buckets: int = 1) -> DataFrame:
    """``settled`` for copies given as rows (grp, size, shard, n)."""
    cells = F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells")
    state = rows.where("n > 0").groupBy("grp", "size").agg(F.sum("n").alias("copies"), cells)
    return settled(state, capacity, shards, rounds, buckets).select("grp", "size", F.explode("cells").alias("c")).select("grp", "size", "c.shard", "c.n")


def settled(state: DataFrame, capacity: int, shards: int, rounds: int, buckets: int = 1) -> DataFrame:
    """Move copies of ``state`` (grp, size, copies, cells: array of shard and n) to shards with room where more of their group stand.

    A group's cells stay in its row, so a round shuffles sums and one bucket a shard, never the state.
    """
    for _ in range(rounds):
        room = [capacity - x for x in _loads(state, shards)]
        fits = F.filter("cells", lambda c: _of(room, c["shard"]) >= F.col("size"))
        ranked = F.transform(fits, lambda c: F.struct(c["n"].alias("n"), F.xxhash64(F.col("grp"), c["shard"]).alias("h"), c["shard"].alias("shard")))
        hubs = state.withColumn("hub", F.array_max(ranked))
        asks = lambda c: F.col("hub").isNotNull() & (c["shard"] != F.col("hub.shard")) & (c["n"] <= F.col("hub.n"))
        asked = hubs.select("grp", "size", F.col("hub.shard").alias("to"), F.col("hub.n").alias("most"), F.explode(F.filter("cells", asks)).alias("c"))
        cuts, any_ = _cuts(asked.select("grp", "size", "c.shard", "c.n", "to", (F.col("c.n") + F.col("most")).alias("saves")), room, buckets)
        if not any_:
            break
        go = lambda c: F.when(asks(c), _go(cuts, F.col("hub.shard"), c["n"] + F.col("hub.n"), c["shard"], c["n"])).otherwise(F.lit(0)).cast("long")  # noqa: E731, B023
        told = hubs.withColumn("told", F.transform("cells", lambda c: F.struct(c["shard"].alias("shard"), c["n"].alias("n"), go(c).alias("go"))))
        came = F.aggregate("told", F.lit(0).cast("long"), lambda acc, c: acc + c["go"])
        after = F.transform("told", lambda c: F.struct(c["shard"].alias("shard"), (c["n"] - c["go"] + F.when(c["shard"] == F.col("hub.shard"), F.col("came")).otherwise(F.lit(0))).alias("n")))
        told = told.withColumn("came", came)
        state = written(told.select("grp", "size", "copies", F.filter(after, lambda c: c["n"] > 0).alias("cells")), "cells")
    return state


def _place_large(loose: DataFrame, loads: list[int], large: int) -> list[tuple]:
    """Largest first, each on the emptiest shard; updates ``loads``. Bounded by the bytes above ``large``."""
    heap = [(x, s) for s, x in enumerate(loads)]
    heapq.heapify(heap)
    placed: dict[tuple, int] = {}
    for r in loose.where(F.col("size") > large).orderBy(F.desc("size"), "grp").toLocalIterator():
        for _ in range(r["n"]):
            load, s = heapq.heappop(heap)
            key = (r["grp"], r["size"], s)
            placed[key] = placed.get(key, 0) + 1
            heapq.heappush(heap, (load + r["size"], s))
    for x, s in heap:
        loads[s] = x
    return [(*k, n) for k, n in placed.items()]


def _fill(small: DataFrame, loads: list[int], capacity: int, seed: int) -> DataFrame:
    """Deal small loose copies to what is free in each shard: copy j of a text begins at start + j * size of one sequence, cut into ranges in proportion to the room."""
    sized = small.withColumn("bytes", F.col("n") * F.col("size"))
    rest = sized.agg(F.sum("bytes")).first()[0] or 0
    room = [max(0, capacity - x) for x in loads]
    room = room if sum(room) else [1] * len(loads)
    ends, run = [], 0
    for x in room:
        run += x
        ends.append(rest * run // sum(room))
    spread = numbered(sized, [], ["grp"], "bytes", seed)
    upto = F.transform(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((e - F.col("start")) / F.col("size")))).cast("long"))
    cut = F.transform(F.col("upto"), lambda x, i: F.struct(i.alias("shard"), (x - F.when(i > 0, F.get("upto", i - 1)).otherwise(0)).alias("n")))
    full = spread.withColumn("upto", upto).select("grp", "size", F.explode(F.filter(cut, lambda c: c["n"] > 0)).alias("c"))
    return full.select("grp", "size", F.col("c.shard").cast("int").alias("shard"), F.col("c.n").cast("long").alias("n"))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 20, fine: int = 400, seed: int = 1, bucket_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), group (digest of the text).

    ``fine``: loose documents above a shard's capacity divided by it are placed one by one
    by the driver; there can be at most shards * fine of these, at any size of the table. They
    are what decides how even the shards can be: dealt like the small ones, each may end a
    shard's share beyond its capacity by its whole size. ``bucket_rows``: rows that are ranked
    in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("grp"))
    base = written(base, "shard-documents")
    total, count = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    capacity, buckets = -(-total // shards), max(1, count // bucket_rows)
    groups = written(base.groupBy("grp", "size").agg(F.count("*").alias("copies")), "groups")
    k = F.sequence(F.lit(0), F.least(F.col("copies"), F.lit(shards)).cast("int") - 1)
    shard = lambda k: F.pmod(F.xxhash64(F.col("grp"), F.lit(seed)) + k, F.lit(shards)).cast("int").alias("shard")
    n = lambda k: (F.floor((F.col("copies") - 1 - k) / shards) + 1).cast("long").alias("n")
    start = groups.where("copies > 1").select("grp", "size", "copies", F.transform(k, lambda k: F.struct(shard(k), n(k))).alias("cells"))
    state = settled(written(start, "cells"), capacity, shards, rounds, buckets)
    loads = _loads(state, shards)
    if max(loads) > capacity:
        each = state.select("grp", "size", F.explode("cells").alias("c")).select("grp", "size", "c.shard", "c.n", F.col("c.shard").alias("to"), F.col("c.n").alias("saves"))
        cuts, _ = _cuts(each, [capacity] * shards, buckets)
        kept = F.transform("cells", lambda c: F.struct(c["shard"].alias("shard"), _go(cuts, c["shard"], c["n"], c["shard"], c["n"]).alias("n")))
        state = written(state.select("grp", "size", "copies", F.filter(kept, lambda c: c["n"] > 0).alias("cells")), "cells")
        loads = _loads(state, shards)
    held = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    loose = groups.where("copies = 1").select("grp", "size", F.col("copies").alias("n")).union(state.select("grp", "size", (F.col("copies") - held).alias("n")).where("n > 0"))
    loose = written(loose, "loose")
    large = capacity // fine
    by_hand = spark.createDataFrame(_place_large(loose, loads, large), "grp string, size long, shard int, n long")
    filled = _fill(loose.where(F.col("size") <= large), loads, capacity, seed)
    cells = state.select("grp", "size", F.explode("cells").alias("c")).select("grp", "size", "c.shard", "c.n").union(by_hand).union(filled)
    # a group's k-th document goes to the cell whose range of ranks holds k; where all stand in one cell no rank is needed
    ranges = cells.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    upto = F.aggregate("cells", F.array().cast("array<bigint>"), lambda acc, c: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + c["n"])))
    ranges = written(ranges.select(F.col("grp").alias("_grp"), "cells", upto.alias("upto")), "ranges")  # so that the join below reads two plain shuffles, which Spark splits where a group is hot
    split = written(base.join(ranges, F.col("grp") == F.col("_grp")).select("doc_id", "size", "text_crc32", "grp", "cells", "upto"), "split")
    whole = split.where(F.size("cells") == 1).select("doc_id", "size", "text_crc32", "grp", F.get("cells", F.lit(0))["shard"].alias("shard"))
    ranked = numbered(split.where(F.size("cells") > 1), ["grp"], ["doc_id"], None, seed).withColumnRenamed("rank", "copy")
    at = F.size(F.filter("upto", lambda x: x <= F.col("copy")))
    placed = whole.union(ranked.select("doc_id", "size", "text_crc32", "grp", F.get("cells", at)["shard"].alias("shard")))
    out = numbered(placed, ["shard"], ["doc_id", "grp"], None, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("grp").alias("group"))
