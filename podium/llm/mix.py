"""Records drawn from sources so that every source has its share of the total size, by pivotal dependent rounding.

A source's records get equal expected numbers of copies, what its share asks for over what it has, at most the
permitted repeats. The whole part is certain; the fractions are rounded by pivots: two fractional records exchange
size-weighted mass at random until one becomes whole, which keeps both the expectations and the source's total size.
Blocks of a source's records do so by themselves and leave one fractional record each; those meet in blocks again, and
so on up a tree, so that a source with a third of all records is spread; a source's last one is drawn alone.

Defined results: sources are compared without case, spaces and punctuation; records of unlisted or null sources are
not drawn; a null or zero share wants nothing and null repeats permit none; a source listed twice has the sum of its
shares and the larger number of repeats; a source that can't reach its share gives all its permitted copies and is
`short`; records of size 0 get the whole part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.runtime import broadcast_if_small, written

#: Fractional records per block of the lowest level, and residuals per block further up.
BLOCK, FAN = 50_000, 10_000


def source_key(source: Column) -> Column:
    """A source's name without case, spaces and punctuation; null if nothing is left."""
    k = F.regexp_replace(F.lower(source), "[^\\p{L}\\p{N}]+", "")
    return F.when(k != "", k)


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: its share, what it has and wants, expected copies per record, and whether it is short.

    `sizes` holds (item, key, size), `targets` the listed sources.
    """
    t = targets.withColumn("key", source_key(F.col("source"))).where("key is not null").groupBy("key")
    t = t.agg(F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    have = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("tokens"))
    q = t.join(have, "key", "left").na.fill(0, ["records", "tokens"])
    q = written(q, "sources")
    total, tokens = q.agg(F.sum("share"), F.sum("tokens")).first()
    target = F.col("share") / F.lit(total) if total else F.lit(0.0)
    q = q.withColumn("target", target).withColumn("wanted", target * F.lit(tokens or 0))
    short = F.col("max_repeats") * F.col("tokens") < F.col("wanted")
    copies = F.when(short, F.col("max_repeats").cast("double")).otherwise(F.coalesce(F.try_divide("wanted", "tokens"), F.lit(0.0)))
    return q.withColumn("short", short).withColumn("copies", copies)


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Whole numbers (0 or 1) for all records but at most one, whose place is returned too (or -1), its mass left in `p`."""
    p = p.astype(float)
    u = rng.random(len(p))
    a = -1
    for b in range(len(p)):
        if not 1e-12 < p[b] < 1 - 1e-12:
            p[b] = round(p[b])
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        move = up if u[b] * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        for i in (a, b):
            if not 1e-12 < p[i] < 1 - 1e-12:
                p[i] = round(p[i])
        a = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return p, a


def _round(seed: int, level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t["item"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        rng = np.random.default_rng([seed, level, int(key[1].as_py()), *key[0].as_py().encode()])
        p, open_ = pivot(t["p"].to_numpy(), t["size"].to_numpy().astype(float), rng)
        if last and open_ >= 0:
            p[open_], open_ = float(rng.random() < p[open_]), -1
        done = np.ones(len(p), bool)
        if open_ >= 0:
            done[open_] = False
        return t.select(["item", "key", "size", "block"]).append_column("p", pa.array(p)).append_column("done", pa.array(done))

    return run


def mixed(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((item, key, size, copies) of all records of listed sources, quotas). `item` is a long."""
    sizes = written(sizes.where("key is not null").select("item", "key", "size"), "mix_sizes")
    q = written(quotas(sizes, targets), "quotas")
    # One row per listed source, a table that an author writes; broadcast after the same size check as elsewhere.
    most = max([1, *(r[0] for r in q.select("records").collect())])
    per = q.select("key", "copies", "records")
    rows = sizes.join(broadcast_if_small(per), "key")
    whole = F.floor("copies")
    rows = rows.select("item", "key", "size", whole.alias("whole"), (F.col("copies") - whole).alias("p"), "records")
    fractional = (F.col("p") > 1e-12) & (F.col("size") > 0)
    block = F.pmod(F.xxhash64("item", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("records") / BLOCK))).cast("long")
    todo = rows.where(fractional).select("item", "key", "size", block.alias("block"), "p")
    blocks, level, done = -(-most // BLOCK), 0, None
    schema = "item long, key string, size long, block long, p double, done boolean"
    while True:
        out = todo.groupBy("key", "block").applyInArrow(_round(seed, level, blocks <= 1), schema)
        out = written(out, "rounded")
        part = out.where("done").select("item", F.col("p").cast("long").alias("extra"))
        done = part if done is None else done.unionByName(part)
        if blocks <= 1:
            break
        todo = out.where("not done").select("item", "key", "size", F.floor(F.col("block") / FAN).alias("block"), "p")
        blocks, level = -(-blocks // FAN), level + 1
    extra = done.where("extra > 0")
    got = rows.join(extra, "item", "left").select("item", "key", "size", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))
    return got, q


def shares(drawn: DataFrame, q: DataFrame) -> DataFrame:
    """Per listed source: target and actual share, tokens there and drawn, and whether it is short."""
    got = drawn.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_records"), F.max("copies").alias("most_repeats"))
    r = q.join(got, "key", "left").na.fill(0, ["drawn_tokens", "drawn_records", "most_repeats"])
    r = written(r, "shares")
    total = r.agg(F.sum("drawn_tokens")).first()[0]
    actual = F.col("drawn_tokens") / F.lit(float(total)) if total else F.lit(0.0)
    cols = ["source", "target", "records", "tokens", "wanted", "max_repeats", "short", "drawn_records", "drawn_tokens", "most_repeats"]
    return r.select(*cols, actual.alias("actual"))
