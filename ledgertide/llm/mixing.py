"""Mixing the documents of several sources to target shares of a total size."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.llm.tokens import VOCABULARY, sizes_of
from ledgertide.operators.storage import written

#: Tokens in a block and in an output shard, at the least.
BLOCK_TOKENS = 1 << 18
SHARD_TOKENS = 1 << 22
#: Blocks grow with the corpus so that there are never more than about so many; the plan of a mix has a row
#: for each block, however often it is used, so this also bounds what the driver holds and what is broadcast.
MAX_BLOCKS = 50_000
#: The plan further holds how many block uses of each source every shard gets; shards grow so that these are at most so many.
MAX_QUOTAS = 2_000_000
#: A mix names at most so many sources, and a source repeats at most so often.
MAX_SOURCES = 5_000
MAX_REPEATS = 1_000


def canonical_source(source: Column) -> Column:
    """Lower case, words joined by one underscore."""
    return F.btrim(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


@dataclass
class Mix:
    """The chosen documents, one row per use, and the shares reached, one row per target source."""

    chosen: DataFrame
    shares: DataFrame


def mix(
    documents: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total_tokens: int | None = None,
    seed: int = 1,
    vocabulary: str = VOCABULARY,
    block_tokens: int | None = None,
    shard_tokens: int | None = None,
) -> Mix:
    """Choose how often each document is used so that each source has its share of ``total_tokens``.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``; ``total_tokens`` is the size of the
    whole corpus if not given. ``chosen`` is ``(<doc_id>, source, pass, shard, position, n_tokens)``: one
    row for each use of a document, ``pass`` counting the uses from 1. ``shares`` is ``(source,
    target_share, actual_share, target_tokens, chosen_tokens, available_tokens, documents, uses, mix_share,
    total_tokens, mix_tokens)``: ``actual_share`` is of ``total_tokens``, ``mix_share`` of ``mix_tokens``, the
    total reached (0 if nothing was chosen). Where a source falls short ``mix_tokens`` is below
    ``total_tokens``, and the others have more of the mix than of the total.

    The documents of a source stand in a random order and are cut into blocks of it. A source is used in
    whole passes as long as its target asks for them and ``max_repeats`` allows; of a last, partial pass
    it gives whole blocks and then the documents at the front of one more block, up to the document whose
    end lies nearest to the target.
    A source whose documents don't suffice gives all it may, and its actual share says so; no other
    source stands in for it. The exact numbers of blocks per source are split among the output shards
    by a tree: at each node the blocks of the left half of the shards are a multivariate-hypergeometric
    draw from the node's blocks. At the leaves each shard takes its number of blocks off each source's
    permuted list, so no block use is in two shards, and puts their documents into random order. A source's
    list holds the uses of all its passes; a use's place in it is a linear map, one to one, of its number, so
    it is worked out where the use is, and the plan doesn't grow with the repeats.

    Blocks have ``block_tokens`` (``BLOCK_TOKENS`` if not given) or more, shards ``shard_tokens``
    (``SHARD_TOKENS``) or more. Texts are read once and only lengths are shuffled. Blocks are formed by hash, so a source with a third
    of all rows is spread like any other; the driver sees only block sums, ``MAX_BLOCKS`` at most in all
    but for one per source. The same input files and seed give the same mix.

    Sources are compared in their canonical spelling. Documents of a source that isn't a target (or is
    null) are not used; documents without tokens add nothing and are not used. A target of zero, null or
    less, and ``max_repeats`` null or below 1, give no uses; of several rows of one source the shares add
    up under the largest ``max_repeats``. Rows that repeat a ``doc_id`` are documents of their own.
    """
    spark = documents.sparkSession
    wanted = (
        targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum(F.greatest(F.col("target_share"), F.lit(0.0))).alias("share"), F.max("max_repeats").alias("repeats"))
        .orderBy("source")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(wanted) > MAX_SOURCES or any((w.repeats or 0) > MAX_REPEATS for w in wanted):
        raise ValueError(f"a mix may name {MAX_SOURCES} sources, each repeated {MAX_REPEATS} times")
    names = [w.source for w in wanted]
    ids = documents.select(F.col(doc_id).alias("id"), canonical_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    sizes = sizes_of(ids, "text", vocabulary)
    whole = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    total = total_tokens if total_tokens is not None else whole
    block_tokens = max(block_tokens or BLOCK_TOKENS, whole // MAX_BLOCKS)

    usable = sizes.where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    stock = {r.source: r for r in usable.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).collect()}
    counts = {s: max(1, math.ceil(r.tokens / block_tokens)) for s, r in stock.items()}
    rank = F.xxhash64(F.lit(seed), "row_id")
    in_block = spark.createDataFrame([(s, n) for s, n in counts.items()], "source string, blocks long")
    placed = usable.join(F.broadcast(in_block), "source").withColumn("rank", rank)
    placed = placed.withColumn("block", F.least(F.floor((F.col("rank") / 2.0**64 + 0.5) * F.col("blocks")), F.col("blocks") - 1))

    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).collect()
    by_source: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(sums, key=lambda r: (r.source, r.block)):
        by_source.setdefault(r.source, []).append((r.block, r.tokens))

    # per source its whole passes, and of one more pass the whole blocks and the tokens taken off a cut one
    rng = np.random.default_rng(seed)
    plan, used_blocks = [], []
    for k, w in enumerate(wanted):
        blocks = by_source.get(w.source, [])
        have = sum(t for _, t in blocks)
        target = int(w.share * total) if w.share else 0
        limit = max(0, w.repeats or 0)
        full = min(limit, target // have) if have else 0
        left = target - full * have if full < limit and have else 0
        own, count = [], full * len(blocks)
        for i, ((b, t), place) in enumerate(zip(blocks, rng.permutation(len(blocks)).tolist())):
            more, cut = 0, None
            if left > 0:
                more, cut = 1, None if t <= left else left
                left -= t
                count += 1
            if full + more:
                own.append((k, w.source, b, place, full * len(blocks) + i, len(blocks), full + more, full + 1, cut))
        step = next((a for a in rng.integers(1, max(2, count), 1000).tolist() if math.gcd(a, count) == 1), 1)
        start = int(rng.integers(0, max(1, count)))
        plan += [(*row, count, step, start) for row in own]
        used_blocks.append(count)
    shards = max(1, round(total / max(shard_tokens or SHARD_TOKENS, 16 * block_tokens)))
    shards = min(shards, max(1, MAX_QUOTAS // max(1, len(names))))
    quotas = split_quotas(np.array(used_blocks, np.int64), shards, rng)
    table = spark.createDataFrame(plan, _PLAN)

    # whole blocks, and of the cut blocks (one per source) the documents before the cut
    used = placed.select("id", "source", "row_id", "rank", "n_tokens", "block").join(F.broadcast(table), ["source", "block"])
    used = used.withColumn("pass", F.explode(F.sequence(F.lit(1), "passes")))
    used = used.withColumn("cut", F.when(F.col("pass") == F.col("last_pass"), F.col("cut_at")))
    use = F.when(F.col("pass") < F.col("last_pass"), (F.col("pass") - 1) * F.col("per_pass") + F.col("place")).otherwise(F.col("last_place"))
    used = used.withColumn("shard", _shard_of(quotas)("k", F.pmod(use * F.col("step") + F.col("start"), F.col("count"))))
    used = used.select("id", "source", "row_id", "rank", "n_tokens", "pass", "cut", "shard")
    upto = Window.partitionBy("source", "pass").orderBy("rank", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = used.where(F.col("cut").isNotNull()).withColumn("upto", F.sum("n_tokens").over(upto)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("cut")).drop("upto")
    used = used.where(F.col("cut").isNull()).unionByName(cut)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "row_id", "pass"), "row_id", "pass")
    chosen = used.select(
        F.col("id").alias(doc_id), "source", "pass", "shard", (F.row_number().over(shuffled) - 1).alias("position"), "n_tokens"
    )
    chosen = written(chosen, "mix")

    reached = chosen.groupBy("source").agg(F.sum("n_tokens").alias("chosen_tokens"), F.count(F.lit(1)).alias("uses"))
    asked = spark.createDataFrame(
        [(w.source, float(w.share or 0), int((w.share or 0) * total), stock[w.source].tokens if w.source in stock else 0, stock[w.source].documents if w.source in stock else 0) for w in wanted],
        "source string, target_share double, target_tokens long, available_tokens long, documents long",
    )
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole_mix = chosen.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("mix_tokens"))
    shares = asked.join(reached, "source", "left").crossJoin(F.broadcast(whole_mix)).select(
        "source",
        "target_share",
        (F.coalesce("chosen_tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("actual_share"),
        "target_tokens",
        none("chosen_tokens"),
        "available_tokens",
        "documents",
        none("uses"),
        (F.coalesce("chosen_tokens", F.lit(0)) / F.greatest("mix_tokens", F.lit(1)).cast("double")).alias("mix_share"),
        F.lit(total).cast("long").alias("total_tokens"),
        "mix_tokens",
    )
    return Mix(chosen, shares)


#: A row for each block that is used: its place in a whole pass and in the last, partial one, how many passes
#: use it, where that last one cuts it, and the map from the source's uses to their places in its list.
_PLAN = "k int, source string, block long, place long, last_place long, per_pass long, passes int, last_pass int, cut_at long, count long, step long, start long"


def _shard_of(quotas: np.ndarray):
    """A function of a source's number and a place in its list of block uses that gives the shard which takes that use."""
    ends = quotas.cumsum(axis=0)

    @F.pandas_udf("int")
    def shard(k: pd.Series, at: pd.Series) -> pd.Series:
        out = np.empty(len(k), np.int64)
        sources = k.to_numpy()
        for source in np.unique(sources):
            own = sources == source
            out[own] = np.searchsorted(ends[:, source], at.to_numpy()[own], side="right")
        return pd.Series(out)

    return shard


def split_quotas(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source each shard gets: a row per shard, the columns adding up to ``blocks``.

    The shards of a node are halved; the left half gets its even part of the node's blocks, drawn without
    regard to their source, the right half the rest.
    """
    out = np.zeros((shards, len(blocks)), np.int64)
    nodes = [(0, shards, blocks)]
    while nodes:
        first, end, have = nodes.pop()
        if end - first == 1:
            out[first] = have
            continue
        middle = (first + end) // 2
        part = int(have.sum()) * (middle - first) // (end - first)
        left = rng.multivariate_hypergeometric(have, part, method="marginals") if len(have) else have
        nodes += [(first, middle, left), (middle, end, have - left)]
    return out
