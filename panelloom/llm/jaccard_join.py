"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

A document's set is its distinct word shingles.  A set that links at p/100 or more lacks at most
d = (100-p) % of its shingles in its partner.  Take the shingles whose hash lies in a fixed
*region* of hash space, some 2 (100-p) % of them: if a set has r there, r-d or more of
these are shared.  Put the region's shingles in one order for all sets, rare ones first: the first shared one is among the
first d+1 of both sets.  A shingle that no other set has brings nobody together, so a
set with more than d of those in its region has no partner and leaves, and what is left of the d+1 are its tile keys: a common passage is
at the end of the order and is no key of a text that has words of its own.  A set with d or fewer
shingles in the region enters all its shingles once more, as a region of its own that such
sets share.  No linked pair is lost.

A *tile* is (shingle, size band): sets of the band (band b holds sizes around (100/p)**b) and visitors from the
band below, as linked sets lie in the same or in adjacent bands.

Within tiles a parity bitmap of the shingles bounds the symmetric
difference from below by its bit count, so the overlap from above; what passes
is decided by intersecting the sorted arrays.

Only the hashes tile keys come from are stored of every text; whole sets are made again, from the
texts, of those in tiles, so the input is read twice and must be the same both times.

Skew: identical sets are one node before anything is paired.  A large
tile of near copies is first joined as a star around its smallest member; while
verified stars leave a large tile in different components, further stars around
other members follow, each member compared once a turn, in one of its tiles, until two turns in a row join next to nothing.  So a group of k copies costs a few
times k comparisons, also if the member first chosen links with none.  What is still
apart is compared pair by pair: a small tile emits pairs, a bounded number; a large one is dealt
to pairs of bounded blocks, which verify for themselves and emit no more links than join
their components.  No link is lost: a pair of a tile is either connected already or
compared.  In a large tile whose members do not link, that work grows with the square of its size, spread over tasks.

Nodes are texts, not ids, so links through rows that share an id or have none count like any other.

Edge cases: null, empty and blank texts have an empty set and link with nothing (their component
is their own id); texts with fewer words than a shingle have their whole word
sequence as the only one; repeated rows come back once per row; rows with a null id link as others do and
get the smallest id of their component, null if it has none; an empty table gives an empty
result.  Only the two named columns are read.  An id stands for one document: rows that share an id
belong to one component, also if their texts do not link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .bitmaps import ROW_KEY, bitmap, row_key, split, within, without
from .graph import components
from .stages import Stages, read

U = np.uint64
BLOCK = 2048  # rows of a tile compared with all others at once
TURNS = 6  # of stars, at most
SMALL = 64  # members of a tile that emits pairs
DEALT = 1024  # members of a block of a larger tile, and their hashes
DEALT_HASHES = 1 << 20


def band_edges(percent: int, up_to: int = 1 << 40) -> np.ndarray:
    """Largest size of each band."""
    ratio = 100.0 / percent * (1 + 1e-9)
    n = int(np.ceil(np.log(up_to) / np.log(ratio)))
    return np.floor(ratio ** np.arange(1, n + 1)).astype(np.int64)


def region(percent: int) -> int:
    """End of the region of hash space from which tile keys come."""
    return min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100 + (1 << 58))


def digests(sets: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set's hashes, which name it."""
    return [H.sums_by_segment(H.mix(sets * U(k)), counts) for k in (3, 5)]


def set_rows(size: int, percent: int, kind: str):
    """Arrow function: columns, text -> columns, set size, band, shingles in the region, digest, the sorted hashes tile keys come from.

    Those are the region's, the first of the sorted ones; all of them where a set has few there.
    """
    edges = band_edges(percent)
    end = U(region(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            for lo, hi, raw, offsets in H.slices(batch.column(batch.num_columns - 1)):
                sets, counts = H.sorted_sets(*H.shingles(*H.words(raw, offsets, kind), size))
                owner = np.repeat(np.arange(len(counts)), counts)
                near = np.bincount(owner[sets < end], minlength=len(counts)).astype(np.int32)
                listed = np.where(near <= counts * (100 - percent) // 100, counts, near)
                place = np.arange(len(sets)) - (np.cumsum(counts) - counts)[owner]
                digest = digests(sets, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, hi - lo) for i in range(len(names))),
                        pa.array(counts),
                        pa.array(np.searchsorted(edges, counts).astype(np.int32)),
                        pa.array(near),
                        pa.array(H.signed(digest[0])),
                        pa.array(H.signed(digest[1])),
                        H.list_array(H.signed(sets[place < listed[owner]]), listed, pa.int64()),
                    ],
                    names=[*names, "n", "band", "near", "d1", "d2", "hashes"],
                )

    return run


def tile_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id): the tiles of each set, from id, n, band, near and the sorted hashes as ``set_rows`` gives them."""
    lost = F.floor(F.col("n") * (100 - percent) / 100).cast("int")
    few = F.col("near") <= lost  # such sets enter all their shingles, as negated hashes
    inside = F.slice("hashes", 1, F.col("near"))
    listed = F.when(few, F.concat(inside, F.transform("hashes", F.bitwise_not))).otherwise(inside)
    # One number for all that a row needs later: how many keys stay beyond the repeated ones, the band, which region.
    spare = lost + 1 - F.when(F.col("pos") < F.col("near"), F.col("near")).otherwise(F.col("n")).cast("int")
    note = spare.cast("bigint") * 65536 + F.col("band") * 2 + (F.col("pos") >= F.col("near")).cast("int")
    spread = sets.select("id", "n", "band", "near", F.posexplode(listed).alias("pos", "key")).select("key", "id", note.alias("note"))
    often = spread.withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1")
    ordered = often.groupBy("id", "note").agg(F.array_sort(F.collect_list(F.struct("many", "key"))).alias("found"))
    stay = F.size("found") + F.shiftright("note", 16)
    first = ordered.where(stay > 0).select("id", "note", F.slice("found", 1, F.least(stay, F.size("found")).cast("int")).alias("found"))
    band = F.shiftright(F.col("note"), 1).bitwiseAND(32767)
    keys = first.select("id", band.alias("band"), F.explode("found.key").alias("key"))
    return keys.select("id", "key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")).select(
        F.xxhash64("key", "band").alias("key"), "id"
    )


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two not below its size, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def parity_bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit i is the parity of the number of hashes that fall on i."""
    flags = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little")


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def array_rows(members, size: int, kind: str):
    """Arrow function: mark, text -> mark, digest, set size, bitmap, sorted hashes, of the rows whose mark's bit is set.

    The bit is tested first, so sets are only made again of texts that are in tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = members.value
        for batch in batches:
            batch = batch.filter(pa.array(within(packed, batch.column(0).to_numpy(zero_copy_only=False).view(U))))
            for lo, hi, raw, offsets in H.slices(batch.column(1)):
                sets, counts = H.sorted_sets(*H.shingles(*H.words(raw, offsets, kind), size))
                ends = np.concatenate([[0], np.cumsum(counts)])
                bits = bitmap_bits(counts)
                maps = [parity_bitmap(sets[a:b], int(width)).tobytes() for a, b, width in zip(ends[:-1], ends[1:], bits)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        *(pa.array(H.signed(d)) for d in digests(sets, counts)),
                        pa.array(counts),
                        pa.array(maps, pa.binary()),
                        H.list_array(H.signed(sets), counts, pa.int64()),
                    ],
                    names=["mark", "d1", "d2", "n", "bitmap", "hashes"],
                )

    return run


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def tile_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, id): those of keys with two ids or more, each with the key's smallest id."""
    names = ["key", "id", "head"]
    carry = None  # (key, head, whether the head's own row is out)
    for batch in batches:
        key, ids = _column(batch, "key"), _column(batch, "id")
        if not len(key):
            continue
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        out = []
        if carry is not None and key[0] == carry[0]:
            fresh[0] = False
        start = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1  # -1: continues the run of the batch before
        heads = ids[start]
        length = np.bincount(run[run >= 0], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
        member = np.zeros(len(key), dtype=bool)
        head = np.empty(len(key), dtype=ids.dtype)
        inside = run >= 0
        head[inside] = heads[run[inside]]
        member[inside] = length[run[inside]] > 1
        if not inside.all():
            head[~inside], member[~inside] = carry[1], True
            if not carry[2]:
                out.append((np.array([carry[0]]), np.array([carry[1]], dtype=ids.dtype), np.array([carry[1]], dtype=ids.dtype)))
        out.append((key[member], ids[member], head[member]))
        carry = (key[-1], head[-1], bool(member[-1]))
        for part in out:
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=names)


def bound_pairs(percent: int):
    """Arrow function over rows sorted by key: pairs of a tile in different components that the bitmaps do not rule out."""

    def pairs(ids, comps, sizes, maps):
        order = np.argsort(sizes, kind="stable")
        ids, comps, sizes = ids[order], comps[order], sizes[order]
        width = min(len(m) for m in maps)
        grid = np.stack([folded(np.frombuffer(maps[i], np.uint8), width) for i in order])
        grid = grid.view(np.uint64)
        for lo in range(0, len(ids)):
            stop = int(np.searchsorted(sizes, sizes[lo] * 100 // percent, side="right"))
            if stop <= lo + 1:
                continue
            other = np.arange(lo + 1, stop)
            other = other[comps[other] != comps[lo]]
            for block in np.split(other, range(BLOCK, len(other), BLOCK)):
                apart = np.bitwise_count(grid[block] ^ grid[lo]).sum(axis=1, dtype=np.int64)
                total = sizes[block] + sizes[lo]
                close = block[apart * (100 + percent) <= total * (100 - percent)]
                if len(close):
                    yield np.full(len(close), ids[lo], dtype=ids.dtype), ids[close]

    def flush(rows):
        if len({r[1] for r in rows}) > 1:
            ids, comps, sizes, maps = zip(*rows)
            ids, comps, sizes = np.array(ids), np.array(comps), np.array(sizes)
            # Every id once; a tile may name a document that visits and lives there twice.
            _, once = np.unique(ids, return_index=True)
            for a, b in pairs(ids[once], comps[once], sizes[once], [maps[i] for i in once]):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k != key:
                    yield from flush(rows)
                    key, rows = k, []
                rows.append(row)
        yield from flush(rows)

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets link, by their sorted hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    # Both ascend as unsigned numbers.
    small, large = small.view(U), large.view(U)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_links(percent: int):
    """Arrow function of one pair of blocks of a tile: links that join its components."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows["side"].to_numpy()
        ids, maps = rows["id"].to_pylist(), rows["bitmap"].to_pylist()
        sizes = rows["n"].to_numpy()
        _, labels = np.unique(np.array(rows["component"].to_pylist()), return_inverse=True)
        hashes = rows["hashes"].chunk(0)
        ends, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        width = min(len(m) for m in maps)
        grid = np.stack([folded(np.frombuffer(m, np.uint8), width) for m in maps]).view(np.uint64)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(second)  # a block with itself
        a, b = [], []
        for i, lo in enumerate(first):
            other = first[i + 1 :] if within else second
            other = other[labels[other] != labels[lo]]
            near = np.minimum(sizes[other], sizes[lo]) * 100 >= np.maximum(sizes[other], sizes[lo]) * percent
            other = other[near]
            apart = np.bitwise_count(grid[other] ^ grid[lo]).sum(axis=1, dtype=np.int64)
            for j in other[apart * (100 + percent) <= (sizes[other] + sizes[lo]) * (100 - percent)]:
                if labels[j] != labels[lo] and linked(values[ends[lo] : ends[lo + 1]], values[ends[j] : ends[j + 1]], percent):
                    a.append(min(ids[lo], ids[j]))
                    b.append(max(ids[lo], ids[j]))
                    labels[labels == labels[j]] = labels[lo]
        kind = rows.schema.field("id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return run


def dealt(tiles: DataFrame, arrays: DataFrame) -> DataFrame:
    """Members (key, id, component, size) of large tiles, once for each pair of blocks of their tile they belong to."""
    whole = tiles.join(arrays.select("id", "n"), "id")
    blocks = F.greatest(F.ceil(F.first("size") / DEALT), F.ceil(F.sum("n") / DEALT_HASHES)).cast("int")
    counts = whole.groupBy("key").agg(blocks.alias("blocks"))
    placed = tiles.join(counts, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "key", "id"), F.col("blocks")).cast("int"))
    mine = F.col("block")
    # Side 0 of the pairs (block, later block), side 1 of (earlier block, block), once for itself.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(
        F.least(t, mine).alias("one"), F.greatest(t, mine).alias("two"), (t < mine).cast("int").alias("side")))
    return placed.select("key", "id", "component", F.explode(pairs).alias("to")).select("key", "id", "component", "to.*").join(arrays, "id")


def exact_links(percent: int):
    """Arrow function: pairs with both sorted arrays -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                keep[i] = linked(left[i].values.to_numpy(), right[i].values.to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def linked_texts(rows: DataFrame, stages: Stages, size: int, percent: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows (columns of ``rows`` without its last, the text) with n and node, null without words; and (node, component) of linked nodes.

    A node is a text's set, named by the row number of one of its rows; a component is its smallest node.
    """
    spark = rows.sparkSession
    kept, text = rows.columns[:-1], rows.columns[-1]
    # The texts are read twice, and rows found again by their mark: whole sets of all would be twice the input on disk.
    marked = rows.select(*kept, F.xxhash64(*rows.columns).alias("mark"), text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields[:-1])
    sets = stages.put(
        marked.mapInArrow(
            set_rows(size, percent, kind), f"{schema}, n bigint, band int, near int, d1 bigint, d2 bigint, hashes array<bigint>"
        ).withColumn("row", F.monotonically_increasing_id()),
        "sets",
    )
    some = sets.where("n > 0")
    digests = some.groupBy("d1", "d2", "n").agg(F.min("row").alias("node"))
    named = stages.put(
        sets.select(*kept, "row", "n", "d1", "d2").join(digests, ["d1", "d2", "n"], "left").select(*kept, "row", "n", "node"), "rows"
    )

    # Tiles of two or more nodes.
    nodes = without(some.select("row", "n", "band", "near", "hashes"), "row", named.where("row <> node").select("row"))
    tiles = tile_keys(nodes.withColumnRenamed("row", "id"), percent).repartition("key").sortWithinPartitions("key", "id")
    members = stages.put(tiles.mapInArrow(tile_members, "key bigint, id bigint, head bigint"), "members")

    # Whole sets of the documents in such tiles.
    ids = members.select("id").distinct()
    playing = stages.put(some.select(F.col("row").alias("id"), "mark", "d1", "d2", "n").join(ids, "id"), "playing")
    stages.drop("sets")
    packed = spark.sparkContext.broadcast(bitmap(playing.select(F.col("mark").alias("hash"))))
    again = marked.select("mark", text).mapInArrow(
        array_rows(packed, size, kind), "mark bigint, d1 bigint, d2 bigint, n bigint, bitmap binary, hashes array<bigint>"
    )
    same = ["mark", "d1", "d2", "n"]
    once = again.groupBy(same).agg(F.first("bitmap").alias("bitmap"), F.first("hashes").alias("hashes"))
    arrays = stages.put(once.join(playing, same).select("id", "n", "bitmap", "hashes"), "arrays")
    if arrays.count() != playing.count():
        raise ValueError("the texts changed between two reads of the input; store it first")

    def among(columns: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        """Few rows besides those whose key is wanted, so that the join shuffles few arrays."""
        return split(columns, key, wanted.select(key))[0]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one, two = (among(arrays.select(F.col("id").alias(c), F.col("hashes").alias(f"h_{c}")), c, pairs) for c in "ab")
        full = pairs.join(one, "a").join(two, "b").select("a", "b", "h_a", "h_b")
        return stages.put(full.mapInArrow(exact_links(percent), "a bigint, b bigint"), name)

    def placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of the tiles that hold several components, with theirs and the tile's size."""
        known = rows.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
        known = known.select("key", "id", F.coalesce("component", "id").alias("component"))
        tiles = known.groupBy("key").agg(
            F.count("*").alias("size"),
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.bit_xor(F.xxhash64("id")).alias("mark"),
            F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("mark2"),
        )
        # Near copies share many keys: of tiles with the same members one is enough.
        tiles = tiles.where("lo < hi").groupBy("size", "lo", "hi", "mark", "mark2").agg(F.min("key").alias("key"))
        return known.join(tiles.select("key", "size"), "key")

    # First the stars, then what they leave apart.
    stars = members.where("id <> head").groupBy("id").agg(F.min("head").alias("b")).select(F.col("id").alias("a"), "b")
    links = verified(stages.put(stars, "stars-1"), "links-1")
    labels = components(links, stages, "first")
    mixed = stages.put(placed(members, labels), "mixed-1")
    large, quiet = mixed.where(F.col("size") > SMALL), 0
    for turn in range(2, TURNS + 1):
        if quiet == 2 or large.isEmpty():
            break
        # Another head for every tile, and one of its tiles for every member, in orders that all share.
        heads = large.groupBy("key").agg(
            F.min_by(F.struct("id", "component"), F.xxhash64(F.lit(turn), "id")).alias("head")
        )
        chosen = large.groupBy("id", "component").agg(F.min_by("key", F.xxhash64(F.lit(turn), "key")).alias("key"))
        stars = chosen.join(heads, "key").where("component <> head.component").select(F.col("id").alias("a"), F.col("head.id").alias("b"))
        stars = stages.put(stars, f"stars-{turn}")
        more = verified(stars, f"links-{turn}")
        links = links.unionByName(more)
        # A turn that joins next to nothing is not worth another look at the tiles.
        quiet = quiet + 1 if more.count() * 100 <= stars.count() else 0
        if not quiet:
            labels = components(links, stages, f"turn-{turn}")
            large = stages.put(placed(large, labels), f"mixed-{turn}")
    labels = labels.withColumnRenamed("node", "id")
    apart = mixed.where(F.col("size") <= SMALL).select("key", "id").join(labels, "id", "left")
    apart = apart.withColumn("component", F.coalesce("component", "id")).join(arrays.select("id", "n", "bitmap"), "id")
    pairs = (
        apart.select("key", "id", "component", "n", "bitmap")
        .repartition("key")
        .sortWithinPartitions("key", "id")
        .mapInArrow(bound_pairs(percent), "a bigint, b bigint")
        .distinct()
    )
    links = links.unionByName(verified(stages.put(pairs, "pairs"), "links-pairs"))
    if not large.isEmpty():
        blocks = dealt(large, among(arrays, "id", large)).groupBy("key", "one", "two")
        links = links.unionByName(stages.put(blocks.applyInArrow(block_links(percent), "a bigint, b bigint"), "links-blocks"))
    final = stages.put(components(links, stages, "second"), "components")
    stages.drop("members", "playing", "arrays", "pairs", "links-pairs", "links-blocks")
    stages.drop(*[f"{x}-{t}" for x in ("stars", "links", "mixed") for t in range(1, TURNS + 1)])
    return named, final


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, kind: str = "blank"
) -> DataFrame:
    """Per row: the id, n_shingles and component_id (smallest id reachable by links).

    Links: 100 * |intersection| >= percent * |union| of the sets of ``size``-word shingles.
    """
    stages = Stages(df.sparkSession, "jaccard")
    rows, found = linked_texts(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), stages, size, percent, kind
    )
    # Rows with one id are one document: their nodes belong together.  Rows without words have their own node here.
    rows = rows.withColumn("node", F.coalesce("node", "row"))
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    several = stages.put(several.select("id", "b"), "several")
    if not several.isEmpty():
        same = rows.join(several, "id").select(F.col("node").alias("a"), "b")
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same)
        found = stages.put(components(links, stages, "third"), "joined")
    placed = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("id").alias("name"))
    out = placed.join(names, "component")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), size=3, percent=90)


_WORDS = """words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents)"""

OP9_SQL = f"""WITH RECURSIVE {_WORDS},
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
frequent AS (SELECT x FROM items GROUP BY x HAVING count(*) > 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN frequent USING (x) JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.node = l.u)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.node) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s"""


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each group of linked texts the row with the smallest id, all columns.

    Rows without an id come last in that order, so they stay only where no row with an id is linked to them.  Rows that
    share an id but not the text are different documents; of rows equal in id and text one stays.  Rows without words stay.
    """
    stages = Stages(docs.sparkSession, "near-copies")
    keyed = docs.withColumn(ROW_KEY, row_key(id_col, text_col))
    rows, found = linked_texts(
        keyed.select(F.col(id_col).alias("id"), F.col(ROW_KEY).alias("key"), F.col(text_col).alias("text")), stages, size, percent, "alnum"
    )
    placed = rows.where("node IS NOT NULL").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.select("component", F.struct(F.col("id").isNull().alias("last"), "id", "key").alias("rank"))
    first = placed.groupBy("component").agg(F.min("rank").alias("first"))
    ranked = stages.put(placed.join(first, "component").select(F.col("rank.key").alias(ROW_KEY), (F.col("rank.key") != F.col("first.key")).alias("out")), "ranked")
    left = without(keyed, ROW_KEY, ranked.where("out").select(ROW_KEY).distinct())
    # Rows equal in id and text that were not dropped: a single one of them stays.
    equal = stages.put(ranked.where("NOT out").groupBy(ROW_KEY).count().where("count > 1").select(ROW_KEY), "equal")
    if equal.isEmpty():
        return left.select(docs.columns)
    maybe, never = split(left, ROW_KEY, equal)
    once = maybe.join(equal, ROW_KEY, "left_semi").dropDuplicates([ROW_KEY])
    return never.unionByName(maybe.join(equal, ROW_KEY, "left_anti")).unionByName(once).select(docs.columns)
