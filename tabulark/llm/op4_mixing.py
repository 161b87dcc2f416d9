"""Mixing sources to target weights.

Source shares of the tokens (stretches of letters and digits, marks), raised to an exponent and normalised, are the
weights.  The exponent is bisected: the entropy of the weights falls and the
number of times a small source repeats falls as it grows, so the least exponent
that keeps the repetition limit and, if it can, the entropy target is found
between two ends that close in.  The weights are realised as block
permutations: a source's documents fall into about as many blocks as a block
has documents, every pass over the source takes the blocks in an order of its
own, and the last pass ends where the source's budget does.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Share of the greatest possible entropy aimed at, passes over a source at most, seed.
ENTROPY, REPEATS, SEED = 0.95, 1.5, 11
#: Sources whose list is broadcast at most; beyond, it is joined, each of them in so many parts.
FEW, SALTS = 20_000, 64


#: A token: up to eight letters and digits of a run, or one other character that is not white space.
TOKEN = r"[\p{L}\p{M}\p{N}_]{1,8}+|[^\s\p{L}\p{M}\p{N}_]"


def tokens(text: Column) -> Column:
    """Number of tokens of a text; of null 0. Scripts without spaces count as others do."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """The exponent, the sum that normalises, the budget of tokens, all tokens, the number of sources."""

    exponent: float
    norm: float
    budget: float
    tokens: int
    sources: int


def bisect(over: Callable[[list[float]], list[bool]], ways: int = 15, steps: int = 8) -> float:
    """The least exponent in [0, 1] that is not over a limit, to about ways**-steps.

    over judges several exponents at once, so that a step is one pass.
    """
    low, high = 0.0, 1.0
    if not over([0.0])[0]:
        return 0.0
    for _ in range(steps):
        tried = [low + (high - low) * i / (ways + 1) for i in range(1, ways + 1)]
        bad = over(tried)
        first = next((i for i, b in enumerate(bad) if not b), len(tried))
        low, high = (tried[first - 1] if first else low), (tried[first] if first < len(tried) else high)
    return high


def solve(sources: DataFrame, entropy: float | None, repeats: float | None, budget: float | None) -> Mix | None:
    """The mix of sources(source, docs, tokens); sums are formed where the rows are."""
    some = F.col("tokens") > 0
    every, n, total, least, most = sources.agg(F.count("*"), F.count_if(some), F.sum("tokens"), F.min(F.when(some, F.col("tokens"))), F.max("tokens")).first()
    if not n:
        return None
    p = F.col("tokens") / total
    there = sources.where("tokens > 0")

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        got = there.agg(*(x for i, a in enumerate(exponents) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}")))).first()
        return [(got[2 * i], got[2 * i + 1]) for i in range(len(exponents))]

    exponent = 1.0 if entropy is None else 0.0
    if entropy is not None and n > 1:  # more even than asked is not needed: the largest exponent that meets it
        short = lambda tried: [math.log(z) - a * s / z < entropy * math.log(n) for a, (z, s) in zip(tried, moments(tried))]
        if not short([0.0])[0]:
            exponent = 1.0 if not short([1.0])[0] else 1 - bisect(lambda tried: short([1 - a for a in tried]))
    if repeats is not None:
        # passes over a source are in proportion to share ** (exponent - 1); the largest source has one, unless a budget is given
        scale = lambda a: (least / most) ** (a - 1) if budget is None else (least / total) ** (a - 1) * budget / total / moments([a])[0][0]
        exponent = max(exponent, bisect(lambda tried: [scale(a) > repeats * (1 + 1e-12) for a in tried]) if budget is None else bisect(lambda tried: [scale(a) > repeats for a in tried], ways=1, steps=30))
    norm = moments([exponent])[0][0]
    return Mix(exponent, norm, total * norm * (most / total) ** (1 - exponent) if budget is None else float(budget), total, every)


def mix(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) as often as the mix takes each, with
    mix_tokens, mix_weight (of its source), mix_epoch (from 1) and mix_block
    (place of its block in that pass, from 0).

    Without a budget the largest source passes once and every document occurs.
    Null sources are one source; null texts have no token; documents without a
    token pass once; rows of one doc_id and text share their place and are taken
    together; texts of any length are counted whole; an empty table gives an
    empty result; columns that are there already under one of the four names are
    replaced, all other columns are kept whatever their names.

    The plan is made of (source, tokens, hash) rows alone.  Of each source only
    the block in which its budget ends is cut inside, at a key that is found
    there; so texts are joined once with the list of blocks and never sorted.
    """
    spare = _spare(docs.columns)
    made = ["mix_tokens", "mix_weight", "mix_epoch", "mix_block"]
    kept = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    source, at, own = spare("source"), spare("hash"), spare("block")
    placed = docs.withColumns({source: F.coalesce(F.col("source").cast("string"), F.lit("\0null")), at: F.xxhash64(F.lit(seed), "doc_id", F.coalesce(F.col("text"), F.lit("")))})
    slim = written(placed.select(F.col(source).alias("source"), tokens(F.col("text")).alias("tokens"), F.col(at).alias("hash")), "mix")
    sources = written(slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    found = solve(sources, entropy, repeats, budget)
    if found is None:
        return docs.withColumns({"mix_tokens": F.lit(0).cast("long"), "mix_weight": F.lit(0.0), "mix_epoch": F.lit(1), "mix_block": F.lit(0).cast("long")})
    ordered = written(_turns(slim, sources, found, seed), "blocks")
    forget(slim)
    mine = [F.col(c).alias(spare(c)) for c in ("weight", "epoch", "turn", "cut")]
    blocks = sources.select(F.col("source").alias(source), _blocks().alias(spare("blocks")))
    dealt = _with_source(placed, blocks, source, at, spare("salt"), found.sources).withColumn(own, F.pmod(F.col(at), F.col(spare("blocks"))))
    got = dealt.join(ordered.select(F.col("source").alias(source), F.col("block").alias(own), *mine), [source, own])
    got = got.where(F.col(spare("cut")).isNull() | (_inside(F.col(at), F.col(spare("epoch"))) < F.col(spare("cut"))))
    return got.select(*[F.col(f"`{c}`") for c in kept], tokens(F.col("text")).alias("mix_tokens"), F.col(spare("weight")).alias("mix_weight"), F.col(spare("epoch")).alias("mix_epoch"), F.col(spare("turn")).alias("mix_block"))


def _spare(columns: list[str]) -> Callable[[str], str]:
    """Names that none of the columns has, told apart without case."""
    there, mark = {c.lower() for c in columns}, "_mix"
    while any(c.startswith(mark) for c in there):
        mark = "_" + mark
    return lambda name: f"{mark}_{name}"


def _blocks() -> Column:
    return F.ceil(F.sqrt("docs")).cast("long")


def _with_source(rows: DataFrame, per_source: DataFrame, source: str, hashed: str, salt: str, sources: int) -> DataFrame:
    """rows with what per_source says of their source; rows of a large source stay spread."""
    if sources <= FEW:
        return rows.join(F.broadcast(per_source), source)
    salts = per_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(hashed), F.lit(SALTS)).cast("int")).join(salts, [source, salt]).drop(salt)


def _inside(hashed: Column, epoch: Column) -> Column:
    """A document's place in its block in a pass."""
    return F.xxhash64(hashed, epoch)


def _turns(slim: DataFrame, sources: DataFrame, found: Mix, seed: int) -> DataFrame:
    """source, block, epoch, turn, weight, cut: the blocks of each pass in their order.

    cut is null where the whole block is taken, else the place in the block from
    which documents are left out.
    """
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / found.tokens, F.lit(found.exponent)) / found.norm).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, weight * found.budget / F.col("tokens")).otherwise(1.0)
    plan = sources.select("source", F.col("tokens").alias("all"), weight.alias("weight"), F.round(passes, 9).alias("passes"), _blocks().alias("blocks"))
    sums = _with_source(slim, plan.select("source", "blocks"), "source", "hash", "salt", found.sources).groupBy("source", F.pmod("hash", "blocks").alias("block")).agg(F.sum("tokens").alias("size"))
    passed = sums.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil("passes").cast("int"), F.lit(1)))))
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block")
    # tokens that the last pass may take; full passes have no limit
    quota = F.when(F.col("epoch") <= F.floor("passes"), F.lit(None)).otherwise((F.col("passes") - F.floor("passes")) * F.col("all"))
    before = F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ordered = passed.select("source", "block", "blocks", "weight", "epoch", "size", quota.alias("quota"), (F.row_number().over(turn) - 1).cast("long").alias("turn"), before.alias("before")).where("quota is null or before < quota")
    ordered = written(ordered, "turns")
    # one block of a source and pass at most holds the end of the budget: about as many documents as the source has blocks
    edge = ordered.where("quota is not null and before + size > quota").select("source", "block", "blocks", "epoch", (F.col("quota") - F.col("before")).alias("room"))
    inside = slim.join(edge, (slim["source"] == edge["source"]) & (F.pmod(slim["hash"], edge["blocks"]) == edge["block"])).select(edge["source"], "block", "epoch", "room", "tokens", _inside(slim["hash"], F.col("epoch")).alias("place"))
    order = Window.partitionBy("source", "block", "epoch").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)  # those of one place together
    over = inside.withColumn("sum", F.sum("tokens").over(order)).where("sum > room").groupBy("source", "block", "epoch").agg(F.min("place").alias("cut"))
    return ordered.join(over, ["source", "block", "epoch"], "left").select("source", "block", "epoch", "turn", "weight", "cut")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"))


SQL = None
