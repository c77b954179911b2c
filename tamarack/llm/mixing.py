"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source gets the same expected number of copies, so that
the source reaches its share of the mixture's tokens.  Whole copies are fixed;
the fraction is drawn with the cube method: fractional inclusion
probabilities move along the null space of the balancing constraints (tokens
and documents of the source) until all but two are 0 or 1.  The flight runs in
blocks of bounded size; what each block leaves flies on together, and the last
two are landed by giving up one constraint after the other.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.workspace import settle

#: Documents to a block of the flight.
BLOCK_DOCS = 20_000
EPS = 1e-9


#: Fixed value: how texts are split before their bytes are paired, as the public 50k byte-level vocabulary was made.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the rank file of that vocabulary is on this machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(4)
def _encoding(path: str, pattern: str):
    """The encoder of a rank file (base64 token and rank to a line); read once by each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, n_tokens by a public byte-level tokenizer.

    ``tokenizer`` is the path of a rank file that every executor can read,
    ``pattern`` how it splits texts.  Null texts count 0 tokens.
    """

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer, pattern).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    count.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.select("doc_id", "source", F.pandas_udf(count, "bigint")(F.col("text")).alias("n_tokens"))


def fly(units: list[list], rng: random.Random) -> list[list]:
    """Flight phase over [id, tokens, probability] lists, changed in place; returns the at most two still undecided.

    Three undecided units at a time move along u = tokens x (1, 1, 1), the
    only direction that keeps both their expected tokens and their expected
    number, until one of them is decided.
    """
    active: list[list] = []
    for unit in units:
        if not EPS < unit[2] < 1 - EPS:
            unit[2] = 1.0 if unit[2] > 0.5 else 0.0
            continue
        active.append(unit)
        while len(active) == 3:
            a, b, c = (x[1] for x in active)
            u = (b - c, c - a, a - b)
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = down = float("inf")
            for x, d in zip(active, u):
                if d:
                    up = min(up, ((1 - x[2]) if d > 0 else x[2]) / abs(d))
                    down = min(down, (x[2] if d > 0 else (1 - x[2])) / abs(d))
            step = up if rng.random() * (up + down) < down else -down
            for x, d in zip(active, u):
                x[2] = min(1.0, max(0.0, x[2] + step * d))
                if not EPS < x[2] < 1 - EPS:
                    x[2] = 1.0 if x[2] > 0.5 else 0.0
            active = [x for x in active if 0 < x[2] < 1]
    return active


def land(rest: list[list], rng: random.Random) -> None:
    """Landing of the at most two undecided units, changed in place: the number of documents is given up first, then the tokens.

    Two units move along (tokens of the other, -own tokens), which keeps the
    expected tokens, until one is decided; the last is drawn.  Inclusion
    probabilities stay as they are, and a source misses its tokens by less
    than one document.
    """
    if len(rest) == 2:
        a, b = rest
        u = (float(b[1]), -float(a[1])) if a[1] or b[1] else (1.0, -1.0)
        up = min(((1 - x[2]) if d > 0 else x[2]) / abs(d) for x, d in zip(rest, u) if d)
        down = min((x[2] if d > 0 else (1 - x[2])) / abs(d) for x, d in zip(rest, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(rest, u):
            x[2] = min(1.0, max(0.0, x[2] + step * d))
    for x in rest:
        x[2] = 1.0 if x[2] > 1 - EPS or (x[2] > EPS and rng.random() < x[2]) else 0.0


def _block(seed: int):
    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending")])
        source = order.column("source")[0].as_py()
        block = order.column("block")[0].as_py()
        units = [list(x) for x in zip(order.column("doc_id").to_pylist(), order.column("n_tokens").to_pylist(), order.column("pi").to_pylist())]
        fly(units, random.Random(f"{seed}:{source}:{block}"))
        return pa.table({"doc_id": order.column("doc_id"), "source": order.column("source"), "n_tokens": order.column("n_tokens"), "whole": order.column("whole"), "pi": pa.array([u[2] for u in units], pa.float64())})

    return run


def _rest(seed: int):
    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending")])
        units = [list(x) for x in zip(order.column("doc_id").to_pylist(), order.column("n_tokens").to_pylist(), order.column("pi").to_pylist())]
        rng = random.Random(f"{seed}:{order.column('source')[0].as_py()}:rest")
        land(fly(units, rng), rng)
        return pa.table({"doc_id": order.column("doc_id"), "source": order.column("source"), "n_tokens": order.column("n_tokens"), "whole": order.column("whole"), "pi": pa.array([u[2] for u in units], pa.float64())})

    return run


def mix(sizes: DataFrame, weights: DataFrame, total_tokens: float | None = None, seed: int = 42, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, n_tokens, n_repeats (>= 1) of the documents chosen.

    ``sizes`` has doc_id, source, n_tokens; ``weights`` source, target_share,
    max_repeats.  Without ``total_tokens`` the mixture is the largest in which
    every source reaches its share within its cap; a larger request is reduced
    to that.  Sources without documents, tokens or a positive share take no
    part, and the others' shares are scaled up to sum to 1.  Documents without
    tokens are never chosen; documents of sources outside the plan neither.
    """
    plan = weights.filter("target_share > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).filter("cap > 0")
    known = settle(sizes.select("doc_id", "source", "n_tokens").filter("n_tokens > 0 and source is not null and doc_id is not null"))
    have = known.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # one row per source of the plan; the plan's length bounds what is collected
    rows = have.join(plan, "source").collect()
    whole_share = sum(r["share"] for r in rows) or 1.0
    most = min((r["cap"] * r["tokens"] * whole_share / r["share"] for r in rows), default=0.0)
    total = most if total_tokens is None else min(float(total_tokens), most)
    rates = [(r["source"], min(float(r["cap"]), total * r["share"] / whole_share / r["tokens"]), max(1, -(-r["docs"] // block_docs))) for r in rows]
    spark = sizes.sparkSession
    rate = spark.createDataFrame(rates, "source string, rate double, blocks long")
    units = known.join(F.broadcast(rate), "source").withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    units = units.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).select("doc_id", "source", "n_tokens", "whole", "pi", "block")
    doc_type = sizes.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {doc_type}, source string, n_tokens long, whole long, pi double"
    flown = settle(units.groupBy("source", "block").applyInArrow(_block(seed), out))
    open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
    chosen, rest = flown.filter(~open_), flown.filter(open_)
    # at most two documents a block are left; where they are many, they fly on in blocks before the last flight
    level, left = 0, rest.count()
    while left > block_docs:
        level += 1
        again = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(-(-left // block_docs)))).select("doc_id", "source", "n_tokens", "whole", "pi", "block")
        flown = settle(again.groupBy("source", "block").applyInArrow(_block(seed + level), out))
        chosen, rest = chosen.unionByName(flown.filter(~open_)), flown.filter(open_)
        before, left = left, rest.count()
        if left == before:
            break
    chosen = chosen.unionByName(rest.groupBy("source").applyInArrow(_rest(seed), out))
    return chosen.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("pi")).cast("int").alias("n_repeats")).filter("n_repeats > 0")


def actual_shares(mixture: DataFrame, weights: DataFrame) -> DataFrame:
    """source, n_docs, n_tokens (copies counted), actual_share, target_share, max_used of every source of the plan."""
    used = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("n_tokens"), F.max("n_repeats").alias("max_used"))
    whole = used.agg(F.sum("n_tokens").alias("all_tokens"))
    plan = weights.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    return plan.join(used, "source", "left").join(F.broadcast(whole)).select("source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), (F.coalesce("n_tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), "target_share", F.coalesce("max_used", F.lit(0)).alias("max_used"))
