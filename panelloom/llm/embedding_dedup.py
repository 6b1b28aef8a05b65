"""Embedding near-dedup: a pigeonhole join over subspaces of rotated vectors.

Unit vectors with cosine >= c are at a squared distance of at most 2 - 2c.  After a
random rotation, which keeps distances and spreads every vector's energy evenly,
the dimensions are cut into blocks; in at least one block the squared distance is within the
block's proportional share of that budget.  Every block is a range join: vectors are
dealt into slabs along the block's first coordinate, a slab as wide as the
root of the share, so partners sit in the same or the next slab.  Large slabs are cut
into tiles of a bounded number of vectors, and every pair of tiles is one task's
work: block distances in single precision with a margin propose candidates, the exact
cosine in double precision decides.  A pair that several blocks propose counts
in the first of them, so counts add up without a list of pairs; of the
links a tile pair emits a count per vector and a spanning tree.

Skew: equal vectors are one representative with a multiplicity before the join,
and a slab of any size is dealt to as many tile pairs as it needs, so a group of near copies
is neither gathered in a task nor written out as pairs.

Edge cases: vectors that are null, empty, all zero, or hold a null or non-finite component
link with nothing (n_links 0, their own component); vectors of different lengths do not
link; -0.0 equals 0.0; very large or small components are scaled before squaring; repeated rows are
vectors of their own that link with each other; a null id counts as a vector
but is no component; an empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .stages import Stages, read

BLOCK_DIMS = 8
TILE = 16384  # vectors of a tile
ROWS = 512  # rows of a tile compared at once
PAIRS = 1 << 16  # candidates verified at once
SEED = 20240229


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def blocks_of(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def shares(dims: int, cosine: float) -> np.ndarray:
    """Squared-distance budget of each block, in proportion to its dimensions, with a margin for rounding."""
    whole = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    return np.array([whole * (b.stop - b.start) / dims for b in blocks_of(dims)])


def vectors_of(column: pa.Array) -> np.ndarray:
    """Matrix of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def slab_rows(cosine: float):
    """Arrow function: rep, dims, vector -> (rep, block, slab) for every block; rows of any lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                turned = unit(vectors_of(batch.column(2).take(pa.array(rows)))) @ rotation(int(d))
                first = [b.start for b in blocks_of(int(d))]
                slab = np.floor(turned[:, first] / np.sqrt(shares(int(d), cosine))).astype(np.int64)
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, n))),
                        pa.array(np.full(len(rows) * n, d, dtype=np.int32)),
                        pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))),
                        pa.array(slab.ravel()),
                    ],
                    names=["rep", "dims", "block", "slab"],
                )

    return run


def united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after joining the pairs (a, b): the smallest position of each component."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter


def links_of_tiles(cosine: float):
    """Pandas function of one pair of tiles of a slab pair: links per vector and a spanning tree."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dims, block = int(key[0]), int(key[1])
        side = frame["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        side = side[order]
        ids, copies = frame["rep"].to_numpy()[order], frame["copies"].to_numpy()[order]
        unitary = unit(np.stack(frame["vector"].to_numpy()[order]).astype(np.float64))
        turned = unitary @ rotation(dims)
        cuts, budget = blocks_of(dims), shares(dims, cosine)
        part = turned[:, cuts[block]].astype(np.float32)
        square = (part * part).sum(axis=1)
        # Side 0 against side 1, or side 0 within itself.
        n = int((side == 0).sum())
        within = n == len(side)
        lo = 0 if within else n
        one = np.ones(len(part), dtype=np.float32)
        left = np.column_stack([part * np.float32(-2), square, one])
        right = np.ascontiguousarray(np.column_stack([part, one, square])[lo:].T)
        limit = np.float32(budget[block] + 1e-5)
        count = np.zeros(len(ids), dtype=np.int64)
        labels = np.arange(len(ids))

        def first_block(a, b):
            """Whether no earlier block has the pair within its share."""
            mine = np.ones(len(a), dtype=bool)
            for k in range(block + 1):
                gap = np.zeros(len(a))
                for c in range(cuts[k].start, cuts[k].stop):
                    gap += (turned[a, c] - turned[b, c]) ** 2
                mine &= (gap <= budget[k]) == (k == block)
            return mine

        for start in range(0, n, ROWS):
            near = left[start : min(start + ROWS, n)] @ right <= limit
            flat = np.flatnonzero(near)
            for at in range(0, len(flat), PAIRS):
                a, b = np.divmod(flat[at : at + PAIRS], near.shape[1])
                a, b = a + start, b + lo
                if within:
                    upper = a < b
                    a, b = a[upper], b[upper]
                close = np.einsum("ij,ij->i", unitary[a], unitary[b]) >= cosine
                a, b = a[close], b[close]
                mine = first_block(a, b)
                a, b = a[mine], b[mine]
                count += np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
                count += np.bincount(b, weights=copies[a], minlength=len(ids)).astype(np.int64)
                labels = united(labels, a, b)
        smallest = pd.Series(ids).groupby(labels).transform("min").to_numpy()
        hit = count > 0
        return pd.DataFrame({"rep": ids[hit], "links": count[hit], "low": smallest[hit]})

    return run


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Per row: the id, n_links (other vectors with at least this cosine), component_id, kept."""
    spark = df.sparkSession
    stages = Stages(spark, "embeddings")
    value = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.when(sound, F.col(vector_col)).alias("vector"),
        F.when(sound, F.xxhash64(value)).alias("d1"),
        F.when(sound, F.xxhash64(F.lit(1), value)).alias("d2"),
    )
    rows = stages.put(rows, "rows")
    # Equal vectors: one representative, numbered by its digest so that null ids need no care.
    whole = rows.where("d1 IS NOT NULL")
    reps = stages.put(
        whole.groupBy("d1", "d2").agg(
            F.min("id").alias("smallest"), F.count("*").alias("copies"), F.first("vector").alias("vector")
        ).select(F.format_string("%016x%016x", "d1", "d2").alias("rep"), "d1", "d2", "smallest", "copies", "vector",
                 F.size("vector").alias("dims")),
        "reps",
    )
    slabs = stages.put(
        reps.select("rep", "dims", "vector").mapInArrow(slab_rows(cosine), "rep string, dims int, block int, slab bigint"), "slabs"
    )
    # Tiles per slab: the slabs of a block are as many as its width holds, however many vectors there are.
    sizes = slabs.groupBy("dims", "block", "slab").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    following = sizes.select("dims", "block", (F.col("slab") - 1).alias("slab"), F.col("tiles").alias("next_tiles"))
    before = sizes.select("dims", "block", (F.col("slab") + 1).alias("slab"), F.col("tiles").alias("prior_tiles"))
    sizes = sizes.join(following, ["dims", "block", "slab"], "left").join(before, ["dims", "block", "slab"], "left")
    placed = slabs.join(F.broadcast(sizes), ["dims", "block", "slab"]).withColumn(
        "tile", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("tiles")).cast("int")
    )

    def target(slab, mine, other, side):
        return F.struct(slab.alias("slab"), mine.alias("one"), other.alias("two"), F.lit(side).alias("side"))

    tile, slab = F.col("tile"), F.col("slab")
    # Within the slab: side 0 of the pairs (tile, later tile), side 1 of (earlier tile, tile), once for itself.
    own = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        slab.alias("slab"), F.least(t, tile).alias("one"), F.greatest(t, tile).alias("two"), (t < tile).cast("int").alias("side")))
    # With the next slab: side 0 of pairs numbered from -1 downwards, so they never meet the ones above.
    ahead = F.when(F.col("next_tiles").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("next_tiles") - 1), lambda t: target(slab, -1 - tile, t, 0))).otherwise(F.array())
    behind = F.when(F.col("prior_tiles").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("prior_tiles") - 1), lambda t: target(slab - 1, -1 - t, tile, 1))).otherwise(F.array())
    dealt = placed.select("rep", "dims", "block", F.explode(F.concat(own, ahead, behind)).alias("to")).select(
        "rep", "dims", "block", "to.*"
    )
    work = dealt.join(reps.select("rep", "copies", "vector"), "rep")
    found = stages.put(
        work.groupBy("dims", "block", "slab", "one", "two").applyInPandas(
            links_of_tiles(cosine), "rep string, links bigint, low string"
        ),
        "found",
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    trees = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), stages, "graph")
    trees = trees.withColumnRenamed("node", "rep")
    named = reps.select("rep", "d1", "d2", "smallest", "copies").join(trees, "rep", "left").join(counts, "rep", "left")
    lowest = named.groupBy(F.coalesce("component", "rep").alias("component")).agg(F.min("smallest").alias("component_id"))
    named = named.withColumn("component", F.coalesce("component", "rep")).join(lowest, "component")
    named = stages.put(
        named.select("d1", "d2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named"
    )
    stages.drop("reps", "slabs", "found")
    out = rows.select("id", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_links(read(spark, sf_dir, "embeddings"), cosine=0.95)


OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id
          WHERE a.len > 0 AND b.len > 0 AND list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.95),
reach(vec_id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.w FROM reach r JOIN links l ON r.node = l.u),
lowest AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN degree ON vec_id = u"""
