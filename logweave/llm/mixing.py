"""Mixing sources to target weights by temperature.

The weight of a source is its share of all tokens to the power ``t``, made to
sum to one: 1 keeps the natural shares, 0 makes all sources equal.  ``t`` is the
least flat one that reaches a target entropy (as a part of the greatest
possible), but no flatter than a repetition limit allows: no source may be
asked for more than ``max_repeats`` times its tokens.  Entropy falls and the
greatest repetition falls as ``t`` rises, so ``t`` is found by narrowing an
interval: each step asks Spark for the figures of ``GRID`` values at once and
keeps the part that holds the answer; the driver sees these figures only, never
the list of sources.

The weights then become budgets of tokens, and a budget becomes documents by
block permutation.  Each source is cut into ``BLOCKS`` blocks by a hash of the
document; the whole source is taken as often as the budget holds it, and of
the last pass as many blocks as fit, in a fixed pseudo-random order of the
blocks, the block on the edge cut at a document in a pseudo-random order of its
documents.  That order is the order of a hash, so a block on the edge of more
than ``EDGE_ROWS`` documents is cut further by 8 bits of the hash at a time: sums
of its 256 parts tell the part that holds the cut.  Running sums go over the
blocks of a source, over these parts and over the documents of the last part,
never over a whole source or a whole large block.

Defined cases: a NULL source is a source of its own; a NULL or blank text has
no tokens and is taken with whole passes and whole blocks, at no cost; without
any token the weights are NULL and every row is taken once; repeated rows are
separate documents of equal place in the order; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_on

ENTROPY = 0.97
MAX_REPEATS = 2.0
BLOCKS = 256
EDGE_ROWS = 4096
GRID = 64
STEPS = 5
SEED = 20


def tokens(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _search(sources: DataFrame, budget: float, entropy: float, max_repeats: float) -> float:
    """The exponent; see above.  ``sources``: (source, n) with n > 0."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        each = sources.select("n", F.explode(F.array(*[F.lit(g) for g in grid])).alias("t")).withColumn(
            "p", F.pow(F.col("n").cast("double"), F.col("t")))
        # entropy = log(sum p) - sum(p log p) / sum p; repeats = budget * max(p / n) / sum p
        rows = (each.groupBy("t").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("l"), F.count(F.lit(1)).alias("k"),
            F.max(F.col("p") / F.col("n")).alias("r"))
            .select("t", (F.log("z") - F.col("l") / F.col("z")).alias("h"), F.log(F.col("k")).alias("top"),
                    (F.col("r") * budget / F.col("z")).alias("repeats")).orderBy("t").collect())
        # too flat: more repeats than allowed, or more entropy than asked for
        flat = [i for i, r in enumerate(rows)
                if r["repeats"] > max_repeats * (1 + 1e-12) or r["h"] >= entropy * r["top"]]
        if len(flat) == len(rows):
            return high
        if not flat:
            return low
        low, high = grid[flat[-1]], grid[min(flat[-1] + 1, GRID)]
    # the least flat side meets the repetition limit; the flat one the entropy
    return high


def weights(docs: DataFrame, source: str = "source", text: str = "text", entropy: float = ENTROPY,
            max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """One row for each source: n_docs, n_tokens, share, weight, budget."""
    sizes = materialize(docs.groupBy(F.col(source).alias("source"))
                        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens(F.col(text))).alias("n_tokens")))
    return _weights(sizes, entropy, max_repeats, budget)


def _weights(sizes: DataFrame, entropy: float, max_repeats: float, budget: float | None) -> DataFrame:
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    if not total:
        none = F.lit(None).cast("double")
        return sizes.select("*", none.alias("share"), none.alias("weight"), F.lit(0.0).alias("budget"))
    budget = float(total if budget is None else budget)
    t = _search(sizes.where("n_tokens > 0").select("source", F.col("n_tokens").alias("n")), budget, entropy, max_repeats)
    p = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(t))).otherwise(0.0)
    z = sizes.agg(F.sum(p)).first()[0]
    return sizes.select("*", (F.col("n_tokens") / F.lit(float(total))).alias("share"), (p / F.lit(z)).alias("weight"),
                        (p / F.lit(z) * F.lit(budget)).alias("budget"))


def _prefix(place: Column, level: int) -> Column:
    """The first ``8 * level`` bits of a hash, in its (signed) order."""
    return F.shiftrightunsigned(place.bitwiseXOR(F.lit(-(1 << 63))), 64 - 8 * level)


def _narrow(edge: DataFrame, rooms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The cut of each source (source, _prefix, _room): the hash prefix whose
    documents the cut goes through, and the tokens left for them; all smaller
    prefixes fit.  ``edge``: (source, _place, _n) of the blocks on the edge,
    ``rooms``: (source, _room).  Also the number of prefix bytes, at least one."""
    cuts, level = rooms.select("source", F.lit(0).cast("long").alias("_prefix"), "_room"), 0
    left = None
    while left is None or (level < 7 and left.agg(F.max("count")).first()[0] > most):
        own = join_on(edge, cuts, ["source"])
        if level:
            own = own.where(_prefix(F.col("_place"), level) == F.col("_prefix"))
        level += 1
        parts = (own.groupBy("source", _prefix(F.col("_place"), level).alias("_prefix"))
                 .agg(F.count(F.lit(1)).alias("count"), F.sum("_n").alias("_tokens"), F.first("_room").alias("_room"))
                 .withColumn("_before", F.sum("_tokens").over(Window.partitionBy("source").orderBy("_prefix"))
                             - F.col("_tokens"))
                 .where((F.col("_before") <= F.col("_room")) & (F.col("_before") + F.col("_tokens") > F.col("_room"))))
        left = materialize(parts.select("source", "_prefix", (F.col("_room") - F.col("_before")).alias("_room"), "count"))
        cuts = left.drop("count")
    return cuts, level


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", entropy: float = ENTROPY,
        max_repeats: float = MAX_REPEATS, budget: float | None = None, blocks: int = BLOCKS,
        edge_rows: int = EDGE_ROWS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; ``copy`` (``mix_copy`` beside
    a column of that name) counts the
    passes from 1.  ``budget``: tokens of the mix, those of ``docs`` if not given."""
    own = docs.columns
    clash = {c: f"_own_{c}" for c in own if c.lower() in ("copy", "times", "n_tokens", "block", "place")}
    base = docs.withColumnsRenamed(clash) if clash else docs
    names = base.columns
    key, source, text = clash.get(key, key), clash.get(source, source), clash.get(text, text)
    place = F.xxhash64(F.col(key), F.xxhash64(text), F.lit(SEED))
    tagged = base.withColumn("_n", tokens(F.col(text))).withColumn("_place", place).withColumn(
        "_block", F.pmod(F.xxhash64("_place", F.lit(1)), F.lit(blocks)).cast("int"))
    sizes = materialize(tagged.groupBy(F.col(source).alias("source"), F.col("_block"))
                        .agg(F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_tokens")))
    totals = sizes.groupBy("source").agg(F.sum("_docs").alias("n_docs"), F.sum("_tokens").alias("n_tokens"))
    w = _weights(totals, entropy, max_repeats, budget)
    # passes over the whole source, tokens left for the last pass
    w = (w.withColumn("_whole", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens")))
                      .otherwise(F.lit(1)).cast("int"))
         .withColumn("_left", F.when(F.col("n_tokens") > 0, F.col("budget") - F.col("_whole") * F.col("n_tokens"))
                     .otherwise(F.lit(0.0))))
    turn = Window.partitionBy("source").orderBy(F.xxhash64("source", "_block", F.lit(SEED)), "_block")
    plan = (join_on(sizes, w.select("source", "_whole", "_left"), ["source"])
            .withColumn("_upto", F.sum("_tokens").over(turn))
            .withColumn("_room", F.col("_left") - (F.col("_upto") - F.col("_tokens")))
            .withColumn("_state", F.when(F.col("_tokens") <= F.col("_room"), F.lit("in"))
                        .when(F.col("_room") > 0, F.lit("edge")).otherwise(F.lit("out")))
            .select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_whole", "_room", "_state", "_docs"))
    plan = materialize(plan)
    joined = tagged.join(plan, tagged[source].eqNullSafe(plan["_s"]) & (tagged["_block"] == plan["_b"]))
    whole = joined.where("_state <> 'edge'").withColumn(
        "_times", F.col("_whole") + (F.col("_state") == "in").cast("int"))
    # documents of an edge block that still fit, in their own order; equal rows
    # stand next to each other and count one after the other
    edge = joined.where("_state = 'edge'")
    cut = plan.where("_state = 'edge'")
    if (cut.agg(F.max("_docs")).first()[0] or 0) > edge_rows:
        cuts, level = _narrow(materialize(edge.select(F.col(source).alias("source"), "_place", "_n")),
                              cut.select(F.col("_s").alias("source"), "_room"), edge_rows)
        edge = edge.drop("_room").join(cuts.select(F.col("source").alias("_c"), "_prefix", F.col("_room")),
                                       F.col(source).eqNullSafe(F.col("_c")))
        at = _prefix(F.col("_place"), level)
        whole = whole.select(*names, "_times").unionByName(
            edge.where(at != F.col("_prefix"))
            .withColumn("_times", F.col("_whole") + (at < F.col("_prefix")).cast("int")).select(*names, "_times"))
        edge = edge.where(at == F.col("_prefix"))
    seq = Window.partitionBy(source, "_block").orderBy("_place", F.col(key)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("_times", F.col("_whole") + (F.sum("_n").over(seq) <= F.col("_room")).cast("int"))
    out = (whole.select(*names, "_times").unionByName(edge.select(*names, "_times"))
           .where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))
    return out.select(*[F.col(f"`{c}`").alias(o) if c != o else F.col(f"`{c}`") for c, o in zip(names, own)], F.col("copy").alias("mix_copy" if "copy" in own else "copy"))
