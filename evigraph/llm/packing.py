"""Filling containers of fixed capacity with texts (p8) by length-histogram planning.

The histogram of sizes has at most ``capacity`` bars, whatever the corpus, so it is the one thing the driver plans on:
best fit over counts, longest first, where all containers with the same room left are one entry with a count. The plan
is a list of runs "ranks a to b of length n go into containers c, c+1, ... , k to each". Documents get a rank within
their length and take their slot by a join on length. Ranks come from a salted count: documents are spread over salts
by a hash, numbered within (length, salt), and shifted by the prefix sum of the counts, so a length holding a third of
all rows is numbered by many tasks.

A text larger than the capacity is split: whole containers first, the rest is packed as an item. Texts of size 0 (null
or empty) need no room and take no container (container_id null). Ties are broken by the hash and the key.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import cut

#: Documents are spread over one salt for so many rows, MIN_SALTS at least; a salt numbers its documents of each length.
ROWS_PER_SALT, MIN_SALTS = 200_000, 8


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over counts. Runs (length, first_rank, last_rank, first_container, per_container), and the containers used.

    ``histogram`` maps sizes of 1 to ``capacity`` to counts. Items of one length are ranked from 0; rank r of a run lies in
    container first_container + (r - first_rank) // per_container. Time and size of the plan depend on the number of distinct
    sizes alone.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of containers (first, count)
    order: list[int] = []  # keys of room, ascending
    used = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                bisect.insort(order, left)
            room[left].append((first, count))

    for length in sorted((n for n, c in histogram.items() if c > 0 and 0 < n <= capacity), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                left = order[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    order.pop(at)
            else:
                left, first, count = capacity, used, -(-todo // (capacity // length))
                used += count
            each = left // length
            full, over = divmod(min(todo, each * count), each)
            if full:
                runs.append((length, rank, rank + full * each - 1, first, each))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if over:
                runs.append((length, rank, rank + over - 1, first + full, over))
                put(left - over * length, first + full, 1)
                rank, todo = rank + over, todo - over
            spare = count - full - (1 if over else 0)
            put(left, first + full + (1 if over else 0), spare)
    return runs, used


def fill_containers(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """key, piece_no (from 1), piece_tokens, container_id (bigint from 0, null for size 0): each item's place.

    ``sizes`` is read four times; hand in a written table. Rows repeating a key are items of their own. Null sizes count as 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    base = sizes.select(F.col(key).alias("key"), n.alias("n"))
    rest = F.when(F.col("n") <= capacity, F.col("n")).otherwise(F.pmod("n", F.lit(capacity)))
    base = base.select("key", "n", F.floor(F.when(F.col("n") > capacity, F.col("n") / capacity).otherwise(0)).cast("long").alias("whole"), rest.alias("rest"))
    salts = max(MIN_SALTS, -(-sizes.count() // ROWS_PER_SALT))
    base = base.select("*", F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"))
    counts = cut(base.groupBy("rest", "salt").agg(F.count("*").alias("c")), "counts")
    histogram = {r["rest"]: r["c"] for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # at most capacity + 1 rows
    runs, used = plan_containers(histogram, capacity)
    earlier = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a salt
    shift = counts.select("rest", "salt", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("shift"))
    by_length: dict[int, list] = {}
    for length, first, last, container, each in runs:
        by_length.setdefault(length, []).append((first, last, container, each))
    plan = spark.createDataFrame([(k, v) for k, v in by_length.items()], "rest long, runs array<struct<a:long,b:long,c:long,k:long>>")
    local = F.row_number().over(Window.partitionBy("rest", "salt").orderBy(F.xxhash64("key", F.lit(1)), "key")) - 1
    ranked = base.select("*", local.alias("local")).join(shift, ["rest", "salt"]).select("key", "n", "whole", "rest", (F.col("local") + F.col("shift")).alias("rank"))
    placed = ranked.join(F.broadcast(plan), "rest", "left")  # the plan is bounded by the capacity, not by the corpus
    run = F.expr("filter(runs, x -> rank BETWEEN x.a AND x.b)[0]")
    placed = placed.select("key", "n", "whole", "rest", "rank", run.alias("r")).select(
        "*", F.when(F.col("rest") > 0, F.col("r.c") + F.floor((F.col("rank") - F.col("r.a")) / F.col("r.k")).cast("long")).alias("container_id")
    )
    last = placed.where("rest > 0 OR whole = 0").select("key", (F.col("whole") + 1).cast("int").alias("piece_no"), F.col("rest").cast("int").alias("piece_tokens"), "container_id")
    # whole pieces of oversized texts: containers of their own, numbered behind the planned ones by the text's key range
    big = base.where("whole > 0")
    heads = big.groupBy("salt").agg(F.sum("whole").alias("w")).collect()  # one row a salt
    starts, at = [], used
    for r in sorted(heads, key=lambda r: r["salt"]):
        starts.append((r["salt"], at))
        at += r["w"]
    start = spark.createDataFrame(starts, "salt long, start long")
    before = F.coalesce(F.sum("whole").over(Window.partitionBy("salt").orderBy(F.xxhash64("key", F.lit(1)), "key", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = big.select("key", "whole", "salt", before.alias("before")).join(F.broadcast(start), "salt").select("key", "before", "start", F.explode(F.expr("sequence(1, CAST(whole AS INT))")).alias("piece_no"))
    full = pieces.select("key", "piece_no", F.lit(capacity).alias("piece_tokens"), (F.col("start") + F.col("before") + F.col("piece_no") - 1).alias("container_id"))
    return last.unionByName(full).withColumnRenamed("key", key)


def container_use(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, tokens, capacity_tokens and the share of room used."""
    used = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.count("*").alias("items"), F.sum("piece_tokens").alias("tokens"), )
    totals = used.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("fullest"))
    return totals.select("items", "containers", "tokens", "fullest", F.lit(capacity).alias("capacity_tokens"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used_share"))


def fill_by_specs(docs: DataFrame, specs: DataFrame, size_of, key: str = "doc_id") -> DataFrame:
    """Placements for every row of ``specs`` (spec_id, tokenizer, capacity_tokens): spec_id, key, piece_no, piece_tokens, container_id.

    ``size_of(docs, tokenizer)`` gives key and n_tokens; each tokenizer runs once. ``specs`` is a table of settings: one row
    per container kind.
    """
    out, sizes = None, {}
    for s in sorted(specs.select("spec_id", "tokenizer", "capacity_tokens").collect(), key=lambda r: r["spec_id"]):
        if s["tokenizer"] not in sizes:
            sizes[s["tokenizer"]] = cut(size_of(docs, s["tokenizer"]), "sizes")
        one = fill_containers(sizes[s["tokenizer"]], s["capacity_tokens"], key).select(F.lit(s["spec_id"]).alias("spec_id"), key, "piece_no", "piece_tokens", "container_id")
        out = one if out is None else out.unionByName(one)
    if out is None:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"spec_id int, {key} {kind}, piece_no int, piece_tokens int, container_id long")
    return out


def checked(placed: DataFrame, specs: DataFrame, key: str = "doc_id") -> DataFrame:
    """What placements (of fill_by_specs) say of themselves, per row of ``specs``: spec_id, capacity_tokens, documents, over_capacity
    (containers), split_though_fitting (documents), well_filled (95 % of the room of all containers is used)."""
    each = placed.groupBy("spec_id", key).agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("tokens"))
    kinds = F.broadcast(specs.select("spec_id", "capacity_tokens"))  # a table of settings
    items = each.join(kinds, "spec_id").groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split_though_fitting"))
    full = placed.where("container_id IS NOT NULL").groupBy("spec_id", "container_id").agg(F.sum("piece_tokens").alias("tokens")).join(kinds, "spec_id")
    room = full.groupBy("spec_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_capacity"), (F.sum("tokens") >= 0.95 * F.sum("capacity_tokens")).alias("well_filled"))
    return specs.select("spec_id", "capacity_tokens").join(items, "spec_id").join(room, "spec_id").select("spec_id", "capacity_tokens", "documents", "over_capacity", "split_though_fitting", "well_filled")
