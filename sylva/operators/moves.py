"""User-ordered lists: the fewest moves between two orders, and moves replayed in sequence.

Both work on what changed, not on whole lists. Neighbours that stay neighbours
form runs, found by windows; only runs, with their sizes, meet in one place for a
list, so a list of any length costs its changes there.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import grouped, stored


def _sorted_runs(df: DataFrame, group: list[str], order: str, breaks: Column, out: str = "run") -> DataFrame:
    """Numbers runs of a list: a new one begins where ``breaks`` holds."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("long")).withColumn(out, F.sum("_b").over(w)).drop("_b")


def heaviest_rising(values: list[int], weights: list[int]) -> list[bool]:
    """Which of distinct values belong to the rising subsequence of the greatest weight; of equal ones, one is chosen."""
    ranked = sorted(values)
    best = [(0, -1)] * (len(values) + 1)  # a tree of prefix maxima over ranks: weight, and the place it ends at
    back = []
    top = (0, -1)
    for at, (v, w) in enumerate(zip(values, weights)):
        rank = bisect_left(ranked, v)
        i, found = rank, (0, -1)
        while i:
            found = max(found, best[i])
            i &= i - 1
        back.append(found[1])
        mine = (found[0] + w, at)
        top = max(top, mine)
        i = rank + 1
        while i <= len(values):
            best[i] = max(best[i], mine)
            i += i & -i
    keep = [False] * len(values)
    at = top[1]
    while at >= 0:
        keep[at] = True
        at = back[at]
    return keep


def minimal_moves(first: DataFrame, second: DataFrame, group: list[str], key: str, position: str) -> DataFrame:
    """(group, seq, op, key, anchor, orig_anchor): what turns the first order of each list into the second.

    Deletions come first, then creations and moves in the order of the second list, so that an anchor, the entry that
    comes before, stands where it belongs when its turn comes. Entries of the heaviest rising subsequence of old places
    stay; so the moves are the fewest. Keys are unique in a list. A null anchor is the front.
    """
    w = Window.partitionBy(*group).orderBy(position)
    before = F.lag(key).over(w)
    a = first.select(*group, key, position, before.alias("orig_anchor"), F.row_number().over(w).alias("_old")).drop(position)
    b = second.select(*group, key, position, before.alias("anchor"), F.row_number().over(w).alias("_new")).drop(position)
    both = stored(b.join(a, [*group, key], "full_outer"))
    kept = both.where("_old IS NOT NULL AND _new IS NOT NULL")
    order = Window.partitionBy(*group).orderBy("_new")
    # Old places without the deleted entries, so that what a deletion parts still runs on.
    kept = kept.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy("_old")))
    runs = _sorted_runs(kept, group, "_new", F.col("_at") != F.lag("_at").over(order) + 1)
    sizes = runs.groupBy(*group, "run").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_size"))

    def choose(rows: list[tuple]) -> list[tuple]:
        keep = heaviest_rising([r[1] for r in rows], [r[2] for r in rows])
        return [(r[0],) for r, k in zip(rows, keep) if not k]

    # Lists in one run have no moves, and stay out of it.
    several = sizes.withColumn("_runs", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("_runs > 1").drop("_runs")
    moving = grouped(several.select(*group, "run", "_from", "_size"), group, ["run"], choose, "run long")
    moved = runs.join(moving, [*group, "run"], "left_semi").select(*group, key, "_new", "anchor", "orig_anchor", F.lit("move").alias("op"))
    made = both.where("_old IS NULL").select(*group, key, "_new", "anchor", "orig_anchor", F.lit("create").alias("op"))
    gone = both.where("_new IS NULL").select(*group, key, (F.col("_old") - (1 << 40)).alias("_new"), "anchor", "orig_anchor", F.lit("delete").alias("op"))
    all_ = moved.unionByName(made).unionByName(gone)
    seq = F.row_number().over(Window.partitionBy(*group).orderBy("_new"))
    return all_.select(*group, seq.alias("seq"), "op", key, "anchor", "orig_anchor")


def replay(rows: DataFrame, moves: DataFrame, group: list[str], key: str, position: str) -> DataFrame:
    """(group, key, position) after moves (group, seq, op, key, anchor), each of which sees the order that those before it
    left. move and create put an entry behind its anchor, or to the front if that is null; delete takes it away. What
    cannot be done (a move of an absent entry, an anchor that is not there, an entry made twice) fails the job.

    Entries that no move names travel in runs, of which one row meets the moves of its list. The moves are worked out
    once and written: who is named, which lists are touched and what is played must be of the same ones.
    """
    moves = stored(moves.select(*group, "seq", "op", key, "anchor"))
    named = moves.select(*group, F.explode(F.array(key, "anchor")).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_named", F.lit(True))
    marked = rows.select(*group, key, position).join(named, [*group, key], "left")
    w = Window.partitionBy(*group).orderBy(position)
    runs = stored(_sorted_runs(marked, group, position, F.col("_named").isNotNull() | F.lag("_named").over(w).isNotNull() | F.lag(key).over(w).isNull()))
    inside = Window.partitionBy(*group, "run").orderBy(position)
    runs = runs.withColumn("_in", F.row_number().over(inside))
    text = rows.schema[key].dataType.simpleString()
    units = runs.groupBy(*group, "run").agg(F.count(F.lit(1)).alias("_size"), F.min(F.when(F.col("_named"), F.col(key))).alias("_key"))
    touched = moves.select(*group).distinct()
    units = units.join(touched, group, "left_semi").withColumns({"seq": F.lit(None).cast("long"), "op": F.lit(None).cast("string"), "anchor": F.lit(None).cast(text)})
    steps = moves.select(*group, F.lit(None).cast("long").alias("run"), F.lit(0).cast("long").alias("_size"), F.col(key).alias("_key"), F.col("seq").cast("long").alias("seq"), "op", "anchor")

    def play(rows_: list[tuple]) -> list[tuple]:
        have, steps_ = [r for r in rows_ if r[3] is None], [r for r in rows_ if r[3] is not None]
        runs_, sizes, keys = [r[0] for r in have], [r[1] for r in have], [r[2] for r in have]
        after, prior, at = {None: None}, {}, {}
        last = None
        for i, k in enumerate(keys):
            if k is not None:
                at[k] = i
            after[last], prior[i], after[i] = i, last, None
            last = i

        def take(i) -> None:
            after[prior[i]] = after[i]
            if after[i] is not None:
                prior[after[i]] = prior[i]

        for _, _, k, _, op, anchor in steps_:
            if (op == "create") == (k in at) or op != "delete" and anchor is not None and anchor not in at or anchor == k:
                raise ValueError(f"cannot {op} {k} behind {anchor}")
            if op == "create":
                i = len(runs_)
                runs_.append(None)
                sizes.append(1)
                keys.append(k)
                at[k] = i
            else:
                i = at[k]
                take(i)
            if op == "delete":
                del at[k]
                continue
            before = None if anchor is None else at[anchor]
            prior[i], after[i] = before, after[before]
            if after[before] is not None:
                prior[after[before]] = i
            after[before] = i
        out, ahead, i = [], 0, after[None]
        while i is not None:
            out.append((runs_[i], keys[i], ahead, sizes[i]))
            ahead += sizes[i]
            i = after[i]
        return out

    every = units.unionByName(steps).select(*group, "run", "_size", "_key", "seq", "op", "anchor")
    played = stored(grouped(every, group, ["seq", "run"], play, f"run long, _key {text}, _ahead long, _size long"))
    moved = runs.join(played.where("run IS NOT NULL").select(*group, "run", "_ahead"), [*group, "run"]).select(*group, key, (F.col("_ahead") + F.col("_in")).cast("long").alias(position))
    made = played.where("run IS NULL").select(*group, F.col("_key").alias(key), (F.col("_ahead") + 1).cast("long").alias(position))
    still = rows.select(*group, key, position).join(touched, group, "left_anti")
    still = still.withColumn(position, F.row_number().over(w).cast("long"))
    return moved.unionByName(made).unionByName(still)
