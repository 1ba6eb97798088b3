"""Near-duplicate search and greedy leader clustering.

Everything works on *distinct* hashes per scope: copies of one text are one
row with a member count, so a text repeated a million times costs one row,
and pairs are between distinct hashes, never between copies.

J4, exact by double pigeonhole (``bands``): two 64-bit hashes within Hamming distance 3
agree on at least one of four 16-bit bands, and on the remaining 48 bits
(still at most 3 differences) on at least one of four 12-bit blocks.  Each hash is
shuffled under its four bands; a task compares what shares 28 bits and gives out near pairs only.

D4, sequential rule: in arrival order a hash joins the earliest existing
leader within the distance, else it becomes a leader.  Leader rounds give
the same result in parallel: a hash whose earlier neighbours include a
leader is a follower; one whose earlier neighbours are all followers (or
none) is a leader; repeat until every hash is decided.  This is the
lexicographically-first maximal independent set of the neighbour graph in
arrival order (Blelloch, Fineman and Shun, SPAA 2012).  Each round's open
edges are a table in the shared folder (``spark.checkpoint.dir``).

Dense families (many different hashes within three bits of each other) would
cost all their pairs.  ``leader_scan`` estimates the near pairs from a sample first and, where they are many, takes
the hashes in arrival order in steps that double, the first as long as its own pairs are few: a step joins its hashes with
the leaders found so far, which settles almost all of a family, and only what is near
no leader is paired and goes through leader rounds.  ``cluster_step`` is also what a
micro-batch of the stream does with the stored leaders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simhash import as_long, simhash
from ..functions.text import normalize_full
from ..session import materialize
from .bands import key_masks, masked, near_pairs
from .sequence import join_keys

MAX_DISTANCE = 3


def simhash_codes(df: DataFrame, text: Column, normalize: bool = True) -> DataFrame:
    """D2 on every row: adds ``hi``, ``lo`` (and the 64-bit ``h``)."""
    src = normalize_full(text) if normalize else text
    return (df.withColumn("_sh", simhash(src))
            .withColumn("hi", F.col("_sh.hi")).withColumn("lo", F.col("_sh.lo")).drop("_sh")
            .withColumn("h", as_long(F.col("hi"), F.col("lo"))))


def distinct_hashes(codes: DataFrame, scope: list[str], order: list[str], member: str) -> DataFrame:
    """One row per (scope, hash): first member in ``order``, member count.

    A partial aggregate: a hash shared by a third of all rows costs one
    row per task before the shuffle.
    """
    key = F.struct(*[F.col(c) for c in order])
    return codes.groupBy(*scope, "h", "hi", "lo").agg(
        F.min(key).alias("rank"), F.max(key).alias("last_rank"),
        F.min_by(F.col(member), key).alias("first_member"),
        F.max_by(F.col(member), key).alias("last_member"), F.count(F.lit(1)).alias("members"))


BUCKET_CAP = 2000
#: Near pairs, a hash, from which ``leader_scan`` goes in steps, and its smallest first step.
DENSE = 16
FIRST_STEP = 4096
#: Hashes of the sample that tells the number of near pairs (it chooses the plan only).
SAMPLE = 65_536
_LOWEST = -(1 << 63)


def scope_ids(scopes: DataFrame, scope: list[str]) -> DataFrame | None:
    """(scope, _sid): a number for each scope, NULL too; none if there is but one."""
    if not scope:
        return None
    return materialize(scopes.select(*scope).distinct().withColumn("_sid", F.monotonically_increasing_id()))


def with_sid(df: DataFrame, ids: DataFrame | None, scope: list[str]) -> DataFrame:
    return df.withColumn("_sid", F.lit(0).cast("long")) if ids is None else join_keys(df, ids, scope)


def near_duplicate_pairs(hashes: DataFrame, scope: list[str], max_distance: int = MAX_DISTANCE,
                         bucket_cap: int | None = BUCKET_CAP) -> DataFrame:
    """Pairs of distinct hashes (a < b) within ``max_distance`` bits.

    ``hashes`` is read several times; checkpoint it first when it comes out of a Python UDF.

    Of hashes that agree on 28 bits, more than ``bucket_cap`` are refined once more by pigeonhole: a pair
    within distance 3 differs in at most 3 of the other 36 bits and agrees on one of four 9-bit blocks of them.
    """
    if max_distance > 3:
        raise ValueError("the band keys are complete for distances up to 3")
    ids = scope_ids(hashes, scope)
    # the order of unsigned hashes
    nodes = with_sid(hashes.select(*scope, "h"), ids, scope).select("_sid", F.col("h").bitwiseXOR(F.lit(_LOWEST)).alias("_at"), "h")
    pairs = near_pairs(nodes, max_distance, bucket_cap)
    if ids is not None:
        pairs = pairs.join(ids, "_sid")

    def halves(c, name):
        return [F.col(c).alias(name), F.shiftrightunsigned(c, 32).alias(f"{name}_hi"), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"{name}_lo")]

    return pairs.select(*scope, *halves("src_h", "a"), *halves("dst_h", "b"),
                        F.bit_count(F.col("src_h").bitwiseXOR(F.col("dst_h"))).cast("int").alias("distance"))


def place(hashes: DataFrame, ids: DataFrame | None, scope: list[str]) -> DataFrame:
    """``hashes`` as a table with ``_sid`` and ``_at``, which grows in order of arrival (of equal ranks the
    greater hash first)."""
    order = ["rank", F.desc("hi"), F.desc("lo")]
    return materialize(with_sid(hashes, ids, scope).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))


def _edges(placed: DataFrame) -> DataFrame:
    """(src, dst, src_h) of near hashes, from the earlier to the later."""
    return materialize(near_pairs(placed.select("_sid", "_at", "h"), MAX_DISTANCE, BUCKET_CAP).select("src", "dst", "src_h"))


def _rounds(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """D4 over ``edges`` (a table): ``placed`` with ``is_leader``, ``leader`` and ``rounds``.

    A round looks only at the edges between undecided hashes: a source that is
    nobody's later neighbour leads, its later neighbours follow, and the edges
    of those followers go.  What a round writes shrinks with the open edges;
    hashes without neighbours take part in no round."""
    left, followers, rounds = edges.select("src", "dst"), None, 0
    while not left.isEmpty():
        rounds += 1
        later = left.select(F.col("dst").alias("src"))
        new = materialize(left.join(later, "src", "left_anti").select("dst").distinct())
        followers = new if followers is None else followers.unionByName(new)
        left = materialize(left.join(new, "dst", "left_anti").join(new.withColumnRenamed("dst", "src"), "src", "left_anti")
                           .select("src", "dst"))
    if followers is None:
        return (placed.withColumn("is_leader", F.lit(True)).withColumn("leader", F.col("h"))
                .withColumn("rounds", F.lit(rounds)))
    # followers take the earliest leader among their earlier neighbours
    best = (edges.join(followers.withColumnRenamed("dst", "src"), "src", "left_anti")
            .groupBy(F.col("dst").alias("_at")).agg(F.min_by("src_h", "src").alias("_leader")))
    return (placed.join(best, "_at", "left")
            .withColumn("is_leader", F.col("_leader").isNull())
            .withColumn("leader", F.coalesce(F.col("_leader"), F.col("h"))).drop("_leader")
            .withColumn("rounds", F.lit(rounds)))


def leader_rounds(hashes: DataFrame, pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Every distinct hash (all columns of ``hashes``) with ``is_leader``,
    ``leader`` and the number of ``rounds`` it took, from its near ``pairs``."""
    ids = scope_ids(hashes, scope)
    placed = place(hashes, ids, scope)
    # orient every pair from the earlier to the later hash
    at_a = placed.select("_sid", F.col("h").alias("a"), F.col("_at").alias("_aa"))
    at_b = placed.select("_sid", F.col("h").alias("b"), F.col("_at").alias("_ab"))
    e = with_sid(pairs.select(*scope, "a", "b"), ids, scope).join(at_a, ["_sid", "a"]).join(at_b, ["_sid", "b"])
    edges = materialize(e.select(F.least("_aa", "_ab").alias("src"), F.greatest("_aa", "_ab").alias("dst"),
                                 F.when(F.col("_aa") < F.col("_ab"), F.col("a")).otherwise(F.col("b")).alias("src_h")))
    return _rounds(placed, edges).select(*hashes.columns, "is_leader", "leader", "rounds")


def _placed_step(placed: DataFrame, leaders: DataFrame | None) -> DataFrame:
    """D4 for ``placed`` (a table) after ``leaders`` (_sid, _at, h; ``_at`` in their own order): (_at, leader)
    of the followers, written as a table.  ``leaders`` are more than three bits apart, so few share a bucket."""
    near, rest = None, placed.select("_sid", "_at", "h")
    if leaders is not None:
        both = materialize(rest.withColumn("_known", F.lit(0)).unionByName(leaders.withColumn("_known", F.lit(1))))
        near = materialize(near_pairs(both, MAX_DISTANCE, BUCKET_CAP, cross=True)
                           .groupBy(F.col("dst").alias("_at")).agg(F.min_by("src_h", "src").alias("leader")))
        rest = materialize(rest.join(near, "_at", "left_anti"))
    new = _rounds(rest, _edges(rest)).where(~F.col("is_leader")).select("_at", "leader")
    return materialize(new if near is None else new.unionByName(near))


def _assigned(placed: DataFrame, followers: DataFrame) -> DataFrame:
    """``placed`` with ``is_leader`` and ``leader``."""
    return (placed.join(followers.withColumnRenamed("leader", "_leader"), "_at", "left")
            .withColumn("is_leader", F.col("_leader").isNull())
            .withColumn("leader", F.coalesce(F.col("_leader"), F.col("h"))).drop("_leader", "_at", "_sid"))


def cluster_step(hashes: DataFrame, leaders: DataFrame | None, scope: list[str]) -> DataFrame:
    """D4 for ``hashes`` that all arrive after ``leaders``: all columns of ``hashes`` (a
    table) with ``is_leader`` and ``leader``, written as a table."""
    ids = scope_ids(hashes if leaders is None else hashes.select(*scope).unionByName(leaders.select(*scope)), scope)
    placed = place(hashes, ids, scope)
    known = None if leaders is None else place(leaders.select(*scope, "h", "hi", "lo", "rank"), ids, scope).select("_sid", "_at", "h")
    return materialize(_assigned(placed, _placed_step(placed, known)))


def candidate_pairs(hashes: DataFrame, scope: list[str]) -> int:
    """Pairs that agree on the 28 bits of a key, from the group sizes alone (a pair under each such key)."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), masked(m).alias("k")) for t, (m, _) in enumerate(key_masks())]))
    sizes = (hashes.select(*scope, keys.alias("_b")).groupBy(*scope, F.col("_b.t"), F.col("_b.k"))
             .agg(F.count(F.lit(1)).cast("double").alias("n")))
    return int(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)


def near_count(placed: DataFrame, n: int) -> int:
    """About how many near pairs ``placed`` has: those of a sample by hash, times its share squared."""
    every = max(1, n // SAMPLE)
    some = placed.select("_sid", "_at", "h").where(F.pmod(F.xxhash64("h"), F.lit(every)) == 0)
    return near_pairs(some, MAX_DISTANCE, BUCKET_CAP).count() * every * every


def leader_scan(hashes: DataFrame, scope: list[str], dense: int = DENSE, first_step: int = FIRST_STEP) -> DataFrame:
    """``hashes`` (a table) with ``is_leader`` and ``leader``, by leader rounds over all
    pairs where these are few, else in doubling steps (see module doc)."""
    placed = place(hashes, scope_ids(hashes, scope), scope)
    n = placed.count()
    near = near_count(placed, n)
    if near <= dense * n:
        return _assigned(placed, _placed_step(placed, None))
    # a first step of about ``dense`` pairs a hash
    first_step = max(first_step, n * max(dense, 0) * n // near)
    # places in arrival order: ids within the sorted ranges, offsets from the ranges' sizes
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each sorted range
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    number = F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    step = F.greatest(F.lit(0), F.floor(F.log2((number + 1) / F.lit(first_step))) + 1).cast("int")
    small = materialize(placed.select("_sid", "_at", "h").withColumn("_part", part).join(F.broadcast(offsets), "_part")
                        .withColumn("_step", step).drop("_part", "_off"))
    done, leaders = None, None
    for k in range(max(0, math.floor(math.log2(n / first_step)) + 1) + 1):
        mine = small.where(F.col("_step") == k).drop("_step")
        followers = _placed_step(mine, leaders)
        led = materialize(mine.join(followers, "_at", "left_anti"))
        leaders = led if leaders is None else leaders.unionByName(led)
        done = followers if done is None else done.unionByName(followers)
    return _assigned(placed, done)


def cluster_signatures(hashes: DataFrame, assignment: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, h, signature): the signature of the first line of the hash's
    leader, for ``hashes`` whose members are signatures."""
    lead = hashes.select(*scope, F.col("h").alias("leader"), F.col("first_member").alias("signature"))
    return (join_keys(assignment.select(*scope, "h", "leader"), lead, [*scope, "leader"])
            .select(*scope, "h", "signature"))


def cluster_members(codes: DataFrame, assignment: DataFrame, scope: list[str], member: str) -> DataFrame:
    """Every member row with its cluster leader hash (join on scope + hash)."""
    return codes.join(assignment.select(*scope, "h", "leader"), [*scope, "h"]).select(*scope, member, "h", "leader")


def cluster_stats(assignment: DataFrame, scope: list[str]) -> DataFrame:
    """D5/D8 from the hash table alone (no second pass over the members):
    per cluster its leader, representative (first member of the cluster),
    last member with its place in the order, member count and number of distinct hashes."""
    return assignment.groupBy(*scope, "leader").agg(
        F.min_by("first_member", "rank").alias("representative"),
        F.max_by("last_member", "last_rank").alias("last_member"), F.max("last_rank").alias("last_rank"),
        F.sum("members").alias("members"), F.count(F.lit(1)).alias("distinct_hashes"))


def bounded_clusters(stats: DataFrame, scope: list[str], last_seen: str, limit: int = 10000) -> DataFrame:
    """Keep the ``limit`` clusters seen most recently per scope (ties by
    the other columns)."""
    w = Window.partitionBy(*scope).orderBy(F.desc(last_seen), *[c for c in stats.columns if c != last_seen])
    return stats.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
