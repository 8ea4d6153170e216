"""Deterministic sampling: caps, splits and shuffles by hash order.

The order of rows inside a class is the md5 of the seed and the row key, so a
sample does not depend on partitioning and repeats exactly. Ranking a whole
class in one window would put a third of all rows into one task. Hash prefixes are
counted instead (map-side), the prefix in which the quota ends is found, only that
prefix (1/4096 of the class) is ranked, and rows are kept by comparing their hash
with the resulting cut. An input that takes a shuffle or more to make is stored once,
with its hashes, and not made again for each step; a plain scan is read again,
by its key columns alone.

A quota is exact whatever the key: rows that share the hash at the cut are ordered
by the md5 of the whole row, and of rows equal in every column as many are taken as
are still wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize, spread, takes_a_shuffle

PREFIX_HEX = 3
COPY_SLOTS = 256  # equal rows are numbered in so many parts


def hash_order(key_cols: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in key_cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _ends(counts: DataFrame, by: Sequence[str], order: str, wanted: Column) -> DataFrame:
    """Of ``(by, order, n)`` the entry in which the first ``wanted`` rows end, with ``need`` of its rows."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(order))
    ranked = counts.withColumn("upto", upto).withColumn("wanted", wanted)
    inside = (F.col("upto") - F.col("n") < F.col("wanted")) & (F.col("upto") >= F.col("wanted"))
    return ranked.filter(inside).withColumn("need", F.col("wanted") - (F.col("upto") - F.col("n"))).drop("upto", "wanted")


def mark_lowest(df: DataFrame, group: str, key_cols: Sequence[str], seed: int, *,
                groups: Sequence[str], cap: int | None = None, share: float | None = None,
                flag: str = "taken", ungrouped: bool = False) -> DataFrame:
    """Flag, per class, the first ``cap`` rows (or ``share`` of rows) by hash.

    ``groups`` is the class domain, which bounds what passes through the driver;
    rows of no listed class get ``ungrouped``.
    """
    if (cap is None) == (share is None):
        raise ValueError("give either cap or share")
    df = df if takes_a_shuffle(df) else spread(df)
    hashed = df.withColumn("_h", hash_order(key_cols, seed))
    if takes_a_shuffle(df):
        hashed = materialize(hashed, "hashed")
    members = hashed.filter(F.col(group).isin(*groups)).select(F.col(group).alias("g"), "_h")
    prefix = F.substring("_h", 1, PREFIX_HEX)
    # At most 16**PREFIX_HEX numbers per class.
    counts = members.groupBy("g", prefix.alias("b")).agg(F.count("*").alias("n")).toArrow().to_pandas()
    sizes, quotas, edges = {}, {}, []
    for name, part in counts.sort_values("b").groupby("g"):
        total = sizes[name] = int(part["n"].sum())
        quotas[name] = cap if cap is not None else int(
            (Decimal(total) * Decimal(repr(share))).quantize(Decimal(1), ROUND_HALF_UP))
        if 0 < quotas[name] < total:
            upto = part["n"].cumsum()
            at = int((upto < quotas[name]).sum())
            edges.append((name, part["b"].iloc[at], quotas[name] - int(upto.iloc[at] - part["n"].iloc[at])))
    cut = {}
    if edges:
        inside = _any([(F.col("g") == name) & (prefix == b) for name, b, _ in edges])
        need = F.lit(None).cast("long")
        for name, _, n in edges:
            need = F.when(F.col("g") == name, F.lit(n)).otherwise(need)
        edge = members.filter(inside).groupBy("g", "_h").agg(F.count("*").alias("n")).withColumn("part", need)
        cut = {r["g"]: r for r in _ends(edge, ["g"], "_h", F.col("part")).collect()}  # one row per class

    taken, ties = F.lit(ungrouped), []
    for name in groups:
        if name not in sizes:
            continue
        quota_of = quotas[name]
        if quota_of <= 0:
            kept = F.lit(False)
        elif quota_of >= sizes[name]:
            kept = F.lit(True)
        else:
            kept = F.col("_h") <= cut[name]["_h"]
            if cut[name]["need"] < cut[name]["n"]:
                ties.append(name)
        taken = F.when(F.col(group) == name, kept).otherwise(taken)
    if not ties:
        return hashed.withColumn(flag, taken).drop("_h")
    at_cut = F.coalesce(_any([(F.col(group) == n) & (F.col("_h") == cut[n]["_h"]) for n in ties]), F.lit(False))
    settled = hashed.filter(~at_cut).withColumn(flag, taken)
    need = {n: int(cut[n]["need"]) for n in ties}
    return settled.unionByName(_break_ties(hashed.filter(at_cut), group, need, df.columns, flag)).drop("_h")


def _any(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _break_ties(rows: DataFrame, group: str, need: dict[str, int], columns: Sequence[str], flag: str) -> DataFrame:
    """Flag exactly ``need`` rows of each class, all of one key hash, by the hash of the whole row."""
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]),
                            {"ignoreNullFields": "false"}))
    wanted = F.lit(None).cast("long")
    for name, n in need.items():
        wanted = F.when(F.col(group) == name, F.lit(n)).otherwise(wanted)
    slot = F.pmod(F.monotonically_increasing_id(), F.lit(COPY_SLOTS))
    # Stored, so that a slot's rows are the same whenever they are counted or numbered.
    rows = materialize(rows.withColumns({"_t": whole, "_w": wanted, "_s": slot}), "ties")
    counts = rows.groupBy(F.col(group).alias("g"), "_w", "_t").agg(F.count("*").alias("n"))
    ends = {r["g"]: r for r in _ends(counts, ["g"], "_t", F.col("_w")).collect()}  # one row per class
    taken = F.lit(False)
    partial = []
    for name, r in ends.items():
        taken = F.when(F.col(group) == name, F.col("_t") <= r["_t"]).otherwise(taken)
        if r["need"] < r["n"]:
            partial.append(name)
    if not partial:
        return rows.withColumn(flag, taken).drop("_t", "_w", "_s")
    # Copies in every column: any will do, so they are numbered slot by slot.
    at_cut = F.coalesce(_any([(F.col(group) == n) & (F.col("_t") == ends[n]["_t"]) for n in partial]), F.lit(False))
    copies = rows.filter(at_cut).withColumn("_i", F.row_number().over(Window.partitionBy(group, "_s").orderBy("_t")))
    slots = rows.filter(at_cut).groupBy(F.col(group).alias("g"), "_s").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("_s")) - F.col("n")
    slots = F.broadcast(slots.select("g", F.col("_s").alias("_s2"), before.alias("_before")))
    left = F.lit(0)
    for name in partial:
        left = F.when(F.col(group) == name, F.lit(int(ends[name]["need"]))).otherwise(left)
    copies = copies.join(slots, (F.col(group) == F.col("g")) & (F.col("_s") == F.col("_s2")))
    copies = copies.withColumn(flag, F.col("_before") + F.col("_i") <= left)
    extra = ("_t", "_w", "_s")
    return rows.filter(~at_cut).withColumn(flag, taken).drop(*extra).unionByName(
        copies.drop(*extra, "_i", "g", "_s2", "_before"))


def class_cap(df: DataFrame, group: str, key_cols: Sequence[str], cap: int | None, seed: int,
              groups: Sequence[str]) -> DataFrame:
    """At most ``cap`` rows of each class; unlabelled rows are all kept."""
    if cap is None or group not in df.columns:
        return df
    marked = mark_lowest(df, group, key_cols, seed, groups=groups, cap=cap, flag="_keep",
                         ungrouped=True)
    return marked.filter("_keep").drop("_keep")


def stratified_split(df: DataFrame, group: str, key_cols: Sequence[str], test_share: float, seed: int,
                     groups: Sequence[str]) -> DataFrame:
    """Add ``is_test``; training and evaluation call this same function."""
    return mark_lowest(df, group, key_cols, seed, groups=groups, share=test_share, flag="is_test")


def shuffled(df: DataFrame, key_cols: Sequence[str], seed: int) -> DataFrame:
    """Whole table in hash order: a range-partitioned distributed sort."""
    return df.orderBy(hash_order(key_cols, seed), *[F.col(f"`{c}`") for c in key_cols])
