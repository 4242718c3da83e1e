"""Allocation and sampling. Randomness is a hash of a seed and a key, so results repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import routing_weight
from .ranking import global_row_number

MODULUS = 2147483647
PART_REQUESTS, PART_UIDS = 131_072, 262_144  # requests and uids that a task of route_pick_each aims at
CHUNK = 4096  # requests searched at once
BROADCAST_ROWS = 100_000


def portable_hash(key: Column, seed: int = 0) -> Column:
    """A pseudo-random whole number below 2^31 - 1 from an integer key, the same in any SQL engine."""
    m = F.lit(2147483647).cast("long")
    x = F.pmod(key.cast("long") * 48271 + seed + 11, m)
    return F.pmod(x * 69621 + 7, m)


def unit(key: Column, seed: int = 0) -> Column:
    return (portable_hash(key, seed) + 1).cast("double") / F.lit(2147483648.0)


def largest_remainder(counts: DataFrame, uid: str, n: str, slots: int) -> DataFrame:
    """``slots`` split in proportion to counts: whole parts, then the largest remainders (ties: least uid)."""
    total = counts.agg(F.sum(n).alias("total_"))
    share = F.col(n) * F.lit(float(slots)) / F.col("total_")
    q = counts.crossJoin(F.broadcast(total)).withColumn("floor_", F.floor(share)).withColumn("rest_", share - F.floor(share))
    left = q.agg((F.lit(slots) - F.sum("floor_")).alias("left_"))
    order = Window.orderBy(F.desc("rest_"), uid)
    ranked = q.where("rest_ > 0").select(uid, F.row_number().over(order).alias("rank_"))
    got = q.join(ranked, uid, "left").crossJoin(F.broadcast(left))
    return got.select(uid, n, (F.col("floor_") + F.when(F.col("rank_") <= F.col("left_"), 1).otherwise(0)).cast("long").alias("slots"))


def bucket_sample(rows: DataFrame, uid: str, bucket: str, key: str, share: float = 0.2, least: int = 3, seed: int = 0) -> DataFrame:
    """Of each uid's n rows min(n, max(least, n x share, half to even)), over its buckets in
    proportion: whole parts, then the largest remainders; rows by hash."""
    per_uid = Window.partitionBy(uid)
    size = rows.groupBy(uid, bucket).agg(F.count("*").alias("size_")).withColumn("all_", F.sum("size_").over(per_uid))
    quota = F.least(F.col("all_"), F.greatest(F.lit(least), F.bround(F.col("all_") * F.lit(share)).cast("long")))
    part = size.withColumn("quota_", quota).withColumn("exact_", F.col("quota_") * F.col("size_") / F.col("all_")).withColumn("take_", F.floor("exact_"))
    rank = F.row_number().over(Window.partitionBy(uid).orderBy((F.col("exact_") - F.col("take_")).desc(), bucket))
    part = part.withColumn("more_", rank <= F.col("quota_") - F.sum("take_").over(per_uid)).withColumn("take_", F.col("take_") + F.col("more_").cast("int"))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(uid, bucket).orderBy(portable_hash(F.col(key), seed), key)))
    return ranked.join(part.select(uid, bucket, "take_"), [uid, bucket]).where("rank_ <= take_").drop("rank_", "take_")


def batches(rows: DataFrame, uid: str, order: str, share: float = 0.5) -> DataFrame:
    """``batch``: consecutive rows of a uid in groups of max(1, ceil(n x share))."""
    w = Window.partitionBy(uid)
    size = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share))
    return rows.withColumn("batch", F.floor((F.row_number().over(w.orderBy(order)) - 1) / size).cast("long"))


def round_robin(rows: DataFrame, lane: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, one of each lane in turn, in hash order within lanes."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(lane).orderBy(portable_hash(F.col(key), seed), key)))
    return ranked.where(F.col("turn") <= n).orderBy("turn", lane).limit(n)


def route_pick(candidates: DataFrame, request: str, uid: str, quality: str, verified: str, seed: int = 0) -> DataFrame:
    """For each request one uid with probability proportional to its routing weight."""
    key = F.col(request).cast("long") * 1_000_003 + F.col(uid).cast("long")
    score = -F.log(unit(key, seed)) / routing_weight(quality, verified)
    w = Window.partitionBy(request).orderBy(F.asc_nulls_last(F.round(score, 12)), F.asc_nulls_last(uid))
    return candidates.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def _leading(requests: np.ndarray, uids: np.ndarray, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(request, place of the uid) of all pairs that may have a request's least score, rounded.

    The hash is affine modulo a prime, so a request only turns the ring of the uids' own hashes:
    uids of like weight lie sorted on theirs, and are walked from the best hash on until the
    hash alone makes a score too large.
    """
    factor = 48271 * 69621 % MODULUS
    ring = uids % MODULUS * factor % MODULUS
    turn = (requests % MODULUS * 1_000_003 % MODULUS * factor + (seed + 11) * 69621 + 7) % MODULUS
    score = lambda h, w: -np.log((h + 1) / 2147483648.0) / w
    usual = np.isfinite(weights)
    kinds = [np.flatnonzero(usual & (np.frexp(weights)[1] == e)) for e in np.unique(np.frexp(weights[usual])[1])[::-1]]
    kinds = [(k := kind[np.argsort(ring[kind], kind="stable")], ring[k], weights[k].max()) for kind in kinds]
    odd = [k[np.argmin(uids[k])] for k in (np.flatnonzero(np.isinf(weights)), np.flatnonzero(np.isnan(weights))) if len(k)]
    found = [(np.arange(len(requests)), np.full(len(requests), u)) for u in odd]
    for at in range(0, len(requests), CHUNK):
        best_hash = MODULUS - 1 - turn[at : at + CHUNK]
        most = np.full(len(best_hash), 0.0 if np.isinf(weights).any() else np.inf)
        limit = lambda: most * (1 + 1e-9) + 2e-12  # noqa: E731  # what rounds to the same 12 digits is in it
        rows, places, scores, size = [], [], [], 0

        def squeeze():
            # of scores that round alike for sure only the least uid can lead
            r, p, s = (np.concatenate(x) for x in (rows, places, scores))
            keep = s <= limit()[r]
            r, p, s = r[keep], p[keep], s[keep]
            cell = np.floor(np.minimum(s * 1e15, 2.0**52))
            near = np.isin(cell % 1000, (499, 500)) | (cell >= 1e12)
            order = np.lexsort((uids[p], cell, r))
            first = np.ones(len(order), bool)
            first[1:] = (r[order][1:] != r[order][:-1]) | (cell[order][1:] != cell[order][:-1])
            keep = order[first | near[order]]
            return [r[keep]], [p[keep]], [s[keep]], len(keep)

        for kind, sorted_ring, heaviest in kinds:
            active, place = np.arange(len(best_hash)), np.searchsorted(sorted_ring, best_hash, side="right") - 1
            for _ in range(len(kind)):
                h = MODULUS - 1 - (best_hash[active] - sorted_ring[place]) % MODULUS
                near = score(h, heaviest) <= limit()[active]
                active, place, h = active[near], place[near], h[near]
                if not len(active):
                    break
                s = score(h, weights[kind[place]])
                most[active] = np.minimum(most[active], s)
                near = s <= limit()[active]
                rows.append(active[near]), places.append(kind[place[near]]), scores.append(s[near])
                size += int(near.sum())
                if size > 4_000_000:
                    rows, places, scores, size = squeeze()
                place = place - 1  # below 0 it goes on from the end
        if rows:
            (r,), (p,), _, _ = squeeze()
            found.append((r + at, p))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def route_pick_each(requests: DataFrame, providers: DataFrame, request: str, uid: str, quality: str, verified: str, seed: int = 0) -> DataFrame:
    """(request, uid): route_pick with all providers as candidates of each request, whose pairs are
    never built. Keys are whole numbers; a provider without uid gets what nobody else can take.

    Tasks have some requests and some providers each, and find the few that may lead; work grows
    as both, not as their product, as long as weights sum to less than the 1e12 that scores are
    rounded to.
    """
    r = requests.select(F.col(request).cast("long").alias("request_")).distinct()
    p = providers.select(F.col(uid).cast("long").alias("uid_"), routing_weight(quality, verified).cast("double").alias("w_"))
    slices, parts = (max(1, -(-df.count() // n)) for df, n in ((r, PART_REQUESTS), (p, PART_UIDS)))
    on = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = r.where("request_ is not null").select("request_", on("request_", slices).alias("slice_"), every(parts).alias("part_"))
    right = p.where("uid_ is not null").select("uid_", "w_", on("uid_", parts).alias("part_"), every(slices).alias("slice_"))

    def lead(a: pa.Table, b: pa.Table) -> pa.Table:
        keys, uids, weights = a["request_"].to_numpy(), b["uid_"].to_numpy(), b["w_"].to_numpy()
        i, k = _leading(keys, uids, weights, seed)
        return pa.table({"request_": keys[i], "uid_": uids[k], "w_": weights[k]})

    pairs = left.groupBy("slice_", "part_").cogroup(right.groupBy("slice_", "part_")).applyInArrow(lead, "request_ long, uid_ long, w_ double")
    score = F.round(-F.log(unit(F.col("request_") * 1_000_003 + F.col("uid_"), seed)) / F.col("w_"), 12)
    best = pairs.groupBy("request_").agg(F.min(F.struct(score.alias("a"), F.col("uid_").alias("b"))).getField("b").alias("uid_"))
    # a request without key has no scores, and takes the least uid
    least = p.agg(F.min("uid_").alias("least_"), F.count("*").alias("n_"))
    out = r.join(best, "request_", "left").crossJoin(F.broadcast(least)).where("n_ > 0")
    picked = F.coalesce("uid_", F.when(F.col("request_").isNull(), F.col("least_")))
    return out.select(F.col("request_").cast(requests.schema[request].dataType).alias(request), picked.cast(providers.schema[uid].dataType).alias(uid))


def uniform_sample(rows: DataFrame, group: str, key: str, k: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(group).orderBy(portable_hash(F.col(key), seed), key)
    return rows.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k).drop("rank_")


def cited_sample(links: DataFrame, group: str, key: str, cited: str, seed: int = 0) -> DataFrame:
    """Per group up to two cited rows and one other, filled up to three from the rest."""
    by_kind = F.row_number().over(Window.partitionBy(group, cited).orderBy(portable_hash(F.col(key), seed), key))
    first = links.withColumn("kind_rank_", by_kind).withColumn("first_", F.col("kind_rank_") <= F.when(F.col(cited), 2).otherwise(1))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("first_"), portable_hash(F.col(key), seed), key))
    return first.withColumn("rank_", rank).where("rank_ <= 3").drop("kind_rank_", "first_", "rank_")


def top_half(rows: DataFrame, uid: str, incentive: str) -> DataFrame:
    """The better half by incentive, two at least."""
    n = rows.agg(F.count("*").alias("n_"))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.orderBy(F.desc(incentive), uid))).crossJoin(F.broadcast(n))
    return ranked.where(F.col("rank_") <= F.greatest(F.lit(2), F.floor(F.col("n_") / 2))).drop("rank_", "n_")


def cyclic_join(queries: DataFrame, pool: DataFrame, order: str, pool_order: str) -> DataFrame:
    """The k-th query takes row k modulo the pool's size."""
    q = global_row_number(queries, order, "k_")
    p = global_row_number(pool, pool_order, "p_")
    n = pool.agg(F.count("*").alias("n_"))
    return q.crossJoin(F.broadcast(n)).withColumn("p_", F.pmod("k_", "n_")).join(p, "p_").drop("k_", "p_", "n_")


def strided(rows: DataFrame, order: str, text: str, most: int, start: int) -> DataFrame:
    """(id, text): about ``most`` rows at even distances, from ``start`` on; trimmed, without blanks
    and repetitions. The id is a hash of the text."""
    hashed = rows.withColumn("hash_", F.xxhash64(text))
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("stride_"))
    placed = global_row_number(hashed.select(order, "hash_"), order, "i_").crossJoin(F.broadcast(n))  # places need no texts
    first = F.pmod(F.lit(start), F.col("stride_"))
    taken = placed.where((F.col("i_") >= first) & (F.pmod(F.col("i_") - first, F.col("stride_")) == 0)).select(F.col(order).alias("o_"), F.col("hash_").alias("h_")).distinct()
    kept = hashed.join(F.broadcast(taken) if most <= BROADCAST_ROWS else taken, F.col(order).eqNullSafe(F.col("o_")) & (F.col("hash_") == F.col("h_")), "left_semi")
    texts = kept.select(F.trim(text).alias("text")).where("text <> ''").distinct()
    return texts.select(F.concat(F.lit("h"), F.left(F.sha1("text"), F.lit(15))).alias("id"), "text")
