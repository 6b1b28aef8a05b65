"""The operators on small tables: brute force, round trips, and the defined results of odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import (
    decontamination,
    embedding_dedup,
    graph,
    hashing,
    html_text,
    jaccard_join,
    license_rules,
    license_scan,
    line_dedup,
    mixing,
    quality,
    samples,
    sharding,
    toxicity,
)
from panelloom.llm.stages import Stages

ODD = [
    (None, "no id here and some words"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"),
    (7, "Ünï çödé wörds änd mörë"), (8, "ÜNÏ çödé"),
]


def docs_frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"n": F.lit(1), "id": F.lit("x"), "rank": F.lit(2), "slot": F.lit(3)}) if extra else df


def invented(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed=1):
    """Texts with exact and near copies, and passages in common."""
    rng = random.Random(seed)
    texts = []
    for i in range(25):
        base = invented(i, rng.randrange(20, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    common = invented(99, 40)
    texts += [common + " " + invented(200 + i, 60) for i in range(10)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def components_of(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


# --- hashing -----------------------------------------------------------------


def test_words_are_those_of_the_definition():
    import pyarrow as pa

    texts = ["A b\tC", "", None, "a  b\x0bc é", "É x y"]
    for kind, expected in (("blank", [3, 0, 0, 4, 2]), ("alnum", [3, 0, 0, 4, 2])):
        got = [n for _, _, raw, offsets in hashing.slices(pa.array(texts)) for n in hashing.words(raw, offsets, kind)[1]]
        assert got == expected
    (_, _, raw, offsets), = hashing.slices(pa.array(["Aa bB", "aA Bb", "aab b"]))
    h, _ = hashing.words(raw, offsets, "blank")
    assert h[0] == h[2] and h[1] == h[3] and len({*h.tolist()}) == 4


def test_texts_do_not_run_into_each_other(monkeypatch):
    import pyarrow as pa

    texts = [invented(i, i) for i in range(30)]
    whole = [tuple(np.split(h, np.cumsum(n)[:-1])) for _, _, raw, off in hashing.slices(pa.array(texts)) for h, n in [hashing.words(raw, off, "blank")]]
    monkeypatch.setattr(hashing, "SLICE", 50)
    cut = [hashing.words(raw, off, "blank") for _, _, raw, off in hashing.slices(pa.array(texts))]
    assert np.array_equal(np.concatenate(whole[0]), np.concatenate([h for h, _ in cut]))
    assert sum(len(n) for _, n in cut) == 30


def test_a_worker_holds_little_besides_its_texts():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    text = invented(1, 40_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([text[i * 2000 : i * 2000 + 20_000] for i in range(100)])], names=["key", "text"])
    packed = SimpleNamespace(value=np.zeros(1 << 21, dtype=np.uint8))
    for function in (decontamination.hit_rows(5, "alnum", packed, packed), jaccard_join.set_rows(5, 80, "alnum")):
        for _ in function(iter([batch])):  # what a worker keeps is made now
            pass
        tracemalloc.start()
        for _ in function(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 << 20


def test_powers_of_a_long_text_are_not_kept(monkeypatch):
    monkeypatch.setattr(hashing, "_POWERS", {})
    monkeypatch.setattr(hashing, "SLICE", 50)
    monkeypatch.setattr(hashing, "KEPT", 200)
    long, down = hashing._powers(1000)
    assert len(long) == len(down) == 1000 and hashing._POWERS == {}
    short, _ = hashing._powers(100)
    assert np.array_equal(short, long[:100]) and len(hashing._POWERS["up"]) == 100


def test_batches_and_row_groups_of_whole_texts_are_small(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = F.expr("concat_ws(' ', transform(sequence(1, 100), i -> sha2(concat(id, ' ', i), 512)))")
    docs = spark.range(5000, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    stored = Stages(spark, "small").put(docs, "docs")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    got = stored.mapInArrow(sizes, "bytes bigint, rows bigint").agg(F.max("bytes"), F.max("rows"), F.sum("rows")).first()
    assert got[0] < 4 << 20 and got[1] <= 500 and got[2] == 5000
    (path,) = [f.removeprefix("file://") for f in stored.inputFiles()]
    assert pq.ParquetFile(path).metadata.num_row_groups > 1


# --- components ----------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (7, None)]
    edges += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(tuple(r) for r in graph.components(df, Stages(spark, "t"), "g").collect())
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = components_of({x for e in real for x in e}, real)
    assert got == want


# --- 9: Jaccard ------------------------------------------------------------------


def word_set(text, size):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_loses_no_link(spark, size, percent):
    rows = near_copies()
    sets = {i: word_set(t, size) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = components_of(sets, links)
    out = jaccard_join.jaccard_components(docs_frame(spark, rows), size=size, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.n_shingles for r in out} == {i: len(s) for i, s in sets.items()}


def test_jaccard_join_of_odd_rows(spark):
    out = jaccard_join.jaccard_components(docs_frame(spark, ODD)).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in out)
    assert got == [(-1, 4, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (6, 1, 5), (7, 3, 7), (8, 1, 8)]
    assert jaccard_join.jaccard_components(docs_frame(spark, ODD).limit(0)).count() == 0


def test_stars_leave_pairs_to_the_second_round(spark):
    # A chain: neighbours link, the ends do not.
    base = invented(3, 60).split()
    rows = []
    for i in range(8):
        rows.append((i, " ".join(base)))
        base[5 * i + 2] = f"y{i}"
    sets = {i: word_set(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    out = jaccard_join.jaccard_components(docs_frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == components_of(sets, links)


def outlier_first(k):
    """k near copies; the smallest id agrees with them on some slices and links with none."""
    base = [f"b{i}" for i in range(300)]
    far = [f"z{i}" if i % 30 == 10 else w for i, w in enumerate(base)]
    return [(0, " ".join(far))] + [(i, " ".join(f"c{i}" if j == 31 + i % 7 else w for j, w in enumerate(base))) for i in range(1, k)]


def test_an_outlier_as_head_does_not_bring_pairs_of_all(spark, monkeypatch):
    paired = spark.sparkContext.accumulator(0)
    real = jaccard_join.bound_pairs

    def counted(percent):
        inner = real(percent)

        def run(batches):
            for batch in inner(batches):
                paired.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(jaccard_join, "bound_pairs", counted)
    k = 150
    out = jaccard_join.jaccard_components(docs_frame(spark, outlier_first(k))).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0} | {i: 1 for i in range(1, k)}
    assert paired.value <= 5 * k


@pytest.mark.parametrize("turns,percent", [(1, 90), (1, 60), (4, 80)])
def test_tiles_dealt_to_blocks_lose_no_link(spark, monkeypatch, turns, percent):
    for name, value in (("SMALL", 2), ("DEALT", 4), ("TURNS", turns)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [(i, t) for i, (_, t) in enumerate(near_copies() + outlier_first(20))]
    sets = {i: word_set(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    out = jaccard_join.jaccard_components(docs_frame(spark, rows), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in out} == components_of(sets, links)


def test_shared_and_missing_ids_lose_no_link(spark):
    one, two = invented(1, 200), invented(2, 200)
    rows = [(5, one), (1, one), (5, two), (6, two + " aa bb")]
    # 10 and 11 link only through the row without an id.
    base = invented(3, 200).split()
    steps = [" ".join(f"q{i}" if i < k else w for i, w in enumerate(base)) for k in (0, 9, 16)]
    rows += [(10, steps[0]), (None, steps[1]), (11, steps[2]), (20, invented(4, 50)), (None, invented(5, 50)), (20, "")]
    out = jaccard_join.jaccard_components(docs_frame(spark, rows)).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out)
    want = [(-1, 48, -1), (-1, 198, 10), (1, 198, 1), (5, 198, 1), (5, 198, 1), (6, 200, 1), (10, 198, 10), (11, 198, 10), (20, 0, 20), (20, 48, 20)]
    assert got == want


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_common_passages_bring_no_texts_into_tiles(spark, percent):
    passage = invented(7, 100)
    rows = [(i, f"{invented(100 + i, 120)} {passage} {invented(900 + i, 80)}") for i in range(60)]
    rows += [(100, rows[0][1] + " yy"), (101, passage), (102, passage + " zz")]
    sets = docs_frame(spark, rows).select("doc_id", "text").mapInArrow(
        jaccard_join.set_rows(3, percent, "blank"),
        "id bigint, n bigint, band int, near int, d1 bigint, d2 bigint, hashes array<bigint>",
    )
    tiles = [tuple(r) for r in jaccard_join.tile_keys(sets.select("id", "n", "band", "near", "hashes"), percent).collect()]
    assert {i for _, i in tiles} == {0, 100, 101, 102}
    together = {k for k, i in tiles if i == 0} & {k for k, i in tiles if i == 100}
    assert together and len(tiles) < 2 * sum((100 - percent) * n // 100 + 1 for n in (299, 300, 98, 99))


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_short_texts_link_whatever_the_region(spark, percent):
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    sets = {i: word_set(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    out = jaccard_join.jaccard_components(docs_frame(spark, rows), size=2, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in out} == components_of(sets, links)


@pytest.mark.parametrize("percent", [80, 90])
def test_stored_sets_hold_only_what_tile_keys_need(spark, monkeypatch, percent):
    stored = {}
    real = Stages.put

    def put(self, df, name):
        out = real(self, df, name)
        if name in ("sets", "arrays"):
            stored[name] = [(r.n, len(r.hashes)) for r in out.select("n", "hashes").collect()]
        return out

    monkeypatch.setattr(Stages, "put", put)
    base = invented(1, 3000)
    rows = [(i, invented(100 + i, 3000)) for i in range(20)] + [(50, base), (51, base + " zz"), (52, base), (53, "a b c d"), (54, "a b c d e f")]
    out = jaccard_join.jaccard_components(docs_frame(spark, rows), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 50 if i in (50, 51, 52) else i for i, _ in rows}
    # The region of long sets; whole sets only of texts in tiles, once for rows that are the same.
    assert all(k < n * (2 * (100 - percent) + 10) / 100 for n, k in stored["sets"] if n > 1000)
    assert sum(n > 1000 for n, _ in stored["arrays"]) == 2 and all(n == k for n, k in stored["arrays"])


def test_turns_of_stars_read_large_tiles_only(spark, monkeypatch):
    seen = {}
    real = Stages.put

    def put(self, df, name):
        out = real(self, df, name)
        if name.startswith(("mixed", "stars")):
            seen[name] = [r.size if "size" in out.columns else r.a for r in out.collect()]
        return out

    monkeypatch.setattr(Stages, "put", put)
    rows = outlier_first(150)
    # Pairs that share tiles and do not link.
    for i in range(10):
        words = invented(500 + i, 200).split()
        rows += [(1000 + i, " ".join(words)), (2000 + i, " ".join(f"q{j}" if j % 12 == 0 else w for j, w in enumerate(words)))]
    out = jaccard_join.jaccard_components(docs_frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: min(i, 1) if i < 150 else i for i, _ in rows}
    assert min(seen["mixed-1"]) <= jaccard_join.SMALL < min(seen["mixed-2"])
    # Each member is compared once a turn.
    assert len(seen["stars-2"]) == len(set(seen["stars-2"]))


def test_one_of_each_keeps_a_single_copy(spark):
    rows = near_copies() + [(0, near_copies()[0][1]), (None, "a b c d e f"), (None, "a b c d e f")]
    kept = jaccard_join.one_of_each(docs_frame(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    sets = {i: word_set(t, 5) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(i for i in ids if i is not None) == sorted(set(components_of(sets, links).values()))
    # Rows without an id are documents like others: one of two copies stays.
    assert ids.count(None) == 1 and kept.columns == docs_frame(spark, rows).columns


def test_one_of_each_names_rows_by_id_and_text(spark):
    one, two = invented(1, 100), invented(2, 100)
    rows = [(1, one), (1, two), (None, one + " aa"), (3, two + " bb"), (None, invented(3, 80)), (4, ""), (4, None), (5, two), (1, two)]
    kept = jaccard_join.one_of_each(docs_frame(spark, rows)).collect()
    want = [(1, one), (1, two), (None, invented(3, 80)), (4, ""), (4, None)]
    assert sorted(((r.doc_id or -1, r.text or "") for r in kept)) == sorted((i or -1, t or "") for i, t in want)


# --- 5: decontamination -------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    items = [(i, invented(1000 + i, n)) for i, n in enumerate((3, 5, 14, 20, 33, 59, 59))] + [(7, None), (8, ""), (None, "a b c d e f g")]
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = invented(i, rng.randrange(0, 300)).split()
        if i % 3 == 0:
            item = items[rng.randrange(7)][1].split()
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = "zz"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in item]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (2, rows[2][1])]

    def clean(t):
        return word_set((t or "").lower().replace(",", ""), 5)

    want = set()
    for d, t in rows:
        for i, q in items:
            s = clean(q)
            if s and 100 * len(s & clean(t)) >= 80 * len(s):
                want.add((d, i, len(s & clean(t)), len(s)))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit(0))
    got = decontamination.leaks(docs_frame(spark, rows), bench).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 5
    left = decontamination.without_leaks(docs_frame(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {w[0] for w in want}
    assert decontamination.leaks(docs_frame(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.leaks(docs_frame(spark, rows).limit(0), bench).count() == 0


def test_leaks_of_rows_with_shared_or_missing_ids(spark):
    item, other, clean = invented(1, 30), invented(2, 30), invented(3, 90)
    rows = [(None, clean + " " + item), (None, clean), (None, item), (None, item), (1, clean), (1, other + " end"), (2, clean), (None, None)]
    bench = spark.createDataFrame([(7, item), (7, other), (None, other), (None, None)], "item_id bigint, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1, r.n_shared, r.n_item) for r in decontamination.leaks(docs_frame(spark, rows), bench).collect())
    n, m = len(word_set(item, 5)), len(word_set(other, 5))
    assert got == sorted([(-1, 7, n, n), (-1, 7, n, n), (1, 7, m, m), (1, -1, m, m)])
    left = decontamination.without_leaks(docs_frame(spark, rows), bench)
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([(-1, clean), (1, clean), (2, clean), (-1, "")])
    assert left.columns == docs_frame(spark, rows).columns


# --- 8: embeddings ---------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)  # several tiles per slab
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 20))
    near = base[:60] + 0.08 * rng.standard_normal((60, 20))
    hot = base[0] + 0.05 * rng.standard_normal((60, 20))
    x = np.concatenate([base, near, hot, base[:15], 3 * base[15:20]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    links = [(i, j) for i, j in zip(*np.nonzero(close)) if i < j]
    low = components_of(range(len(x)), links)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 20), (1003, [math.nan] * 20), (1004, [None] + [1.0] * 19), (1005, [1.0, 0.0]), (1006, [2.0, 0.0]), (None, [2.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("rep", F.lit("x"))
    out = {r.vec_id: r for r in embedding_dedup.embedding_links(df).collect()}
    for i in range(len(x)):
        assert out[i].n_links == close[i].sum() - 1, i
        assert out[i].component_id == low[i] and out[i].kept == (low[i] == i)
    for i in (1000, 1001, 1002, 1003, 1004):
        assert out[i].n_links == 0 and out[i].component_id == i and out[i].kept
    assert out[1005].n_links == out[1006].n_links == out[None].n_links == 2
    assert {out[i].component_id for i in (1005, 1006, None)} == {1005}
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    df = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [-1e300, 1e300])], "vec_id bigint, embedding array<double>")
    assert {r.vec_id: r.component_id for r in embedding_dedup.embedding_links(df).collect()} == {1: 1, 2: 1, 3: 3}


# --- 6: lines ------------------------------------------------------------------------------


def line_brute(rows, min_words):
    seqs = []
    for d, t in rows:
        lines = (t or "").split("\n")
        seqs.append((d, [(i, x) for i, x in enumerate(lines) if x.split()], lines))
    seen, out = set(), {}
    for d, solid, lines in sorted(seqs, key=lambda s: s[0]):
        gone = set()
        for a in range(len(solid)):
            words, b = 0, a
            while b < len(solid) and words < min_words:
                words += len(solid[b][1].split())
                b += 1
            if words >= min_words:
                key = tuple(x for _, x in solid[a:b])
                if key in seen:
                    gone |= {i for i, _ in solid[a:b]}
                seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_repeated_runs_are_deleted_but_the_first(spark):
    rng = random.Random(8)
    pool = [invented(i, rng.randrange(1, 9), 50) for i in range(12)]
    runs = [[pool[rng.randrange(12)] for _ in range(rng.randrange(1, 12))] for _ in range(8)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            lines += runs[rng.randrange(8)] + rng.choice([[], [""], [invented(500 + d, 6)]])
        rows.append((d, "\n".join(lines)))
    for min_words in (5, 20, 50):
        want = line_brute(rows, min_words)
        out = line_dedup.dedup_lines(docs_frame(spark, rows), min_words=min_words).collect()
        assert {r.doc_id: (r.text, r.n_deleted) for r in out} == want


def test_lines_of_odd_rows(spark):
    passage = " ".join(["word"] * 60)
    rows = ODD + [(20, passage), (20, passage), (21, passage), (22, "a\n\n" + passage + "\n \nb"), (None, passage)]
    out = sorted(((r.doc_id or -1, r.text, r.n_lines, r.n_deleted, r.n_runs) for r in line_dedup.dedup_lines(docs_frame(spark, rows)).collect()))
    assert (-1, passage, 1, 0, 0) in out and (21, "", 1, 1, 1) in out and out.count((20, "", 1, 1, 1)) == 2
    assert (22, "a\n\n \nb", 3, 1, 1) in out and (1, "", 0, 0, 0) in out and (3, " \t\n ", 0, 0, 0) in out
    assert len(out) == len(rows)
    assert line_dedup.dedup_lines(docs_frame(spark, rows).limit(0)).count() == 0


# --- 7: licenses ----------------------------------------------------------------------------


def test_license_rules_are_sound():
    assert len(license_rules.RULES) >= 200
    for rule in license_rules.RULES:
        # The keyword must be a word of every match.
        sides = [w.rstrip("?") for w in rule.words.split(" ") if not w.endswith("?") and "|" not in w]
        assert rule.keyword in sides, rule


def scan(spark, rows):
    return {r.doc_id: r for r in license_scan.scan(docs_frame(spark, rows)).collect()}


def test_license_detection(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "MIT license; MIT-License mit licensed", 3: "x SPDX-License-Identifier: GPL-3.0-only y",
        4: "released under CC BY-NC 4.0.", 5: "the GNU Lesser General Public License v2.1 and GNU General\nPublic License", 6: "nothing", 7: None, 8: "",
        9: "permit license", 10: "MIT Éa license",
    }
    out = scan(spark, list(texts.items()))
    assert out[1].base_labels == "apache" and out[1].labels == "apache,apache-2.0" and (out[1].n_base, out[1].first_word) == (1, 3)
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].labels) == (2, 0, 2, "mit")
    assert out[3].base_labels == "" and "gpl-3.0" in out[3].labels
    assert out[4].base_labels == "cc-by" and out[4].labels == "cc-by,cc-by-nc" and out[4].score == 1.0
    assert out[5].base_labels == "gpl" and "gpl" in out[5].labels.split(",") and any(x.startswith("lgpl") for x in out[5].labels.split(","))
    for i in (6, 7, 8, 9, 10):
        assert (out[i].labels, out[i].n_base, out[i].first_word, out[i].score) == ("", 0, None, 0.0), i
    assert (out[7].n_words, out[8].n_words, out[10].n_words) == (0, 0, 3)


def test_inner_matches_are_suppressed(spark):
    (row,) = license_scan.scan(docs_frame(spark, [(1, "distributed under the terms of the GNU General Public License version 3.0 or later")])).collect()
    assert [s.label for s in row.spans] == ["gpl-3.0"]


# --- 10: pages ---------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav>"
        "<div class='ad'>buy</div><header>top</header><article><h1>A &amp; B</h1><p><b>One  two&nbsp;three &eacute;<br><p>Short.</p>"
        "<aside>side</aside><div class='comments'><p>me too</p></div><p>x<i>y</i>z</article><div id='cookie-notice'>ok</div><footer>&copy;</footer>"
    )
    assert html_text.main_text(page) == "A & B\nOne two three é\nShort.\nxyz"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div><br></div>") == ""
    assert html_text.main_text("plain words & more <") == "plain words & more <"
    assert html_text.main_text("<article><p>cut off te") == "cut off te"
    body = "".join(f"<p>Sentence number {i} is long enough to count as content here.</p>" for i in range(5))
    assert html_text.main_text(f"<div class='menu'><a>a</a></div><div id='content'>{body}<p>End.</div><div><a href=x>l</a> <a>m</a></div>").count("\n") == 5


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (1, "u", "<p>a</p>")], "page_id bigint, url string, html string")
    rows = sorted(tuple(x or "" for x in r) for r in html_text.extract(df.withColumn("text", F.lit("clash"))).collect() if r.page_id)
    assert rows == [(1, "u", "a")] * 2
    assert html_text.extract(df).count() == 3 and html_text.extract(df.limit(0)).count() == 0


def paragraphs(word, n):
    return "".join(f"<p>The {word} sentence number {i} is long enough to count as content here.</p>" for i in range(n))


def test_divided_pages_without_article_stay_whole():
    links = "<div><a href=x>l</a> <a href=y>m</a></div>"
    for first, second in ((6, 4), (9, 1), (4, 6)):
        page = f"<body>{links}<div id=wrap><h1>Title</h1><div>{paragraphs('first', first)}</div><section>{paragraphs('second', second)}</section></div>{links}</body>"
        text = html_text.main_text(page)
        assert text.startswith("Title\n") and (text.count("first"), text.count("second")) == (first, second) and "l m" not in text
    # Loose lines of a region count as well, and the h1 beside the only one stays.
    text = html_text.main_text(f"<body>{links}<div>{paragraphs('loose', 3)}<div>{paragraphs('inner', 9)}</div></div>{links}</body>")
    assert (text.count("loose"), text.count("inner")) == (3, 9)
    assert html_text.main_text(f"<body><h1>Title</h1><div>{paragraphs('only', 5)}</div>{links}</body>").startswith("Title\nThe only")


def test_names_of_layouts_and_of_article_parts_drop_nothing():
    body = paragraphs("main", 5)
    for wrap in ("class='has-sidebar'", "class='right-sidebar'", "class='page sidebar'", "id='widget'"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
            assert html_text.main_text(f"<body><div {wrap}>{inner}</div></body>").count("main") == 5, (wrap, inner)
    assert html_text.main_text(f"<body><form><article>{body}</article></form></body>").count("main") == 5
    page = (
        "<article><h1>A</h1>" + body + "<section id='related-work'><h2 id='side-effects'>S</h2><p>Older work.</p></section><section id=legal><p>Law.</p></section>"
        "<h2 id='copyright'>C</h2><p>Area is <math><mi>a</mi><mo>*</mo><mi>b</mi></math></p><svg><title>t</title><text>axis</text><text>label</text></svg></article>"
    )
    lines = html_text.main_text(page).split("\n")
    assert [x for x in lines if "sentence" not in x] == ["A", "S", "Older work.", "Law.", "C", "Area is a*b", "axis", "label"]


def test_long_adverts_sidebars_and_comments_go_at_any_size():
    body, links = paragraphs("main", 3), "<div><a href=x>l</a> <a href=y>m</a></div>"
    for n in (1, 3, 40):
        other = paragraphs("gone", n)
        for name in ("class='sponsored'", "class='sidebar'", "class='ad'", "id='comment-12'", "style='color:red; display: none'", "class='cookie-notice'"):
            for page in (f"<body>{links}<div>{body}</div><div {name}>{other}</div>", f"<div {name}>{other}</div><div><h1>T</h1>{body}</div>", f"<article>{body}</article><div {name}>{other}</div>"):
                text = html_text.main_text(page)
                assert (text.count("main"), text.count("gone")) == (3, 0), (name, n, page[:80])
        for name in ("comment", "related", "sponsored", "related-posts"):
            text = html_text.main_text(f"<article><h1>T</h1>{body}</article><article class='{name}'>{other}</article>")
            assert (text.count("main"), text.count("gone")) == (3, 0), (name, n)
    # The only prose of a page stays, also beside dates and names.
    text = html_text.main_text(f"<body><h1>Title</h1><div>3 May, by Ann</div><div class='widget'>{body}</div>{links}</body>")
    assert text.count("main") == 3


def test_breaks_and_buttons_do_not_end_a_block():
    assert html_text.main_text("<article><p>one<br>two <button>push</button>three<br/> four</p><p>five</p></article>") == "one two three four\nfive"


def test_deep_and_many_elements_take_linear_time():
    import time

    n = 40_000
    start = time.monotonic()
    assert html_text.main_text("<div>" * n + "<p>Deep text of the page.</p>" + "</section>" * n).endswith("page.")
    assert html_text.main_text("<div class='widget'>" * 2000 + "<article><p>a b</p></article>" * 2000).count("a b") == 2000
    assert html_text.main_text("<article><p>Text of one article.</p></article>" * n).count("\n") == n - 1
    assert time.monotonic() - start < 30


def test_what_is_named_still_goes():
    body = paragraphs("main", 5)
    for gone in ("class='ad'", "class='cookie-notice'", "id='sidebar'", "class='x related-posts'", "class='ad_container'", "id='comments'", "class='comment-list'", "role='navigation'"):
        for page in (f"<article>{body}<div {gone}><p>Gone.</p></div></article>", f"<div>{body}<div {gone}><p>Gone.</p></div></div>"):
            assert "Gone" not in html_text.main_text(page), (gone, page)
    # Teasers and comments marked up as articles do not bring back what holds them.
    many = "".join(f"<article>{paragraphs('reader', 2)}</article>" for _ in range(6))
    for around in ("aside", "div class='comments'", "div class='related'"):
        text = html_text.main_text(f"<main>{body}</main><{around}><article><p>Gone.</p></article></{around.split()[0]}>")
        assert "Gone" not in text and text.count("main") == 5
    text = html_text.main_text(f"<article>{body}<div id='comments'>{many}</div></article>")
    assert "reader" not in text and text.count("main") == 5
    assert html_text.main_text(f"<article><p>Short.</p></article><footer>{body}</footer>") == "Short."


# --- 2 and 4: classifiers --------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = invented(i, 80, 2000).split()
        good = rng.random() < 0.7
        toxic = rng.random() < 0.3
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(["blorgh", "blorghen", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return rows, docs_frame(spark, rows + ODD), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    rows, docs, labels = labelled(spark)
    scored = quality.quality_scores(docs, quality.quality_model(docs, labels))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = scored.collect()
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_classifiers_without_labels(spark):
    _, docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(docs, quality.quality_model(docs, none)).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs, none).count() == docs.count()
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows, docs, labels = labelled(spark)
    out = toxicity.toxicity_scores(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert len(out) == len(rows) + len(ODD) and all(r.predicted == int(r.score >= 0.3) for r in out)


def test_label_model_finds_rates_and_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    votes = np.stack([rng.random(20000) < np.where(y, 0.8, 0.05), rng.random(20000) < np.where(y, 0.7, 0.1), rng.random(20000) < np.where(y, 0.6, 0.02)], 1)
    votes = np.column_stack([votes, votes[:, 2]])  # a voter that repeats another
    masks, count = np.unique((votes << np.arange(4)).sum(1), return_counts=True)
    model = toxicity.fit_label_model(masks, np.full(len(masks), -1), count.astype(float), 4)
    assert model.correlation[2, 3] > 0.9 and model.discount[2] < 0.6 < model.discount[0]
    assert model.rates[1, 2] > 0.4 > model.rates[0, 2]
    known = toxicity.fit_label_model(masks, np.where(masks >= 12, 1, 0), count.astype(float), 4)
    assert 0 < known.prior < 0.5


def test_sample_is_bounded_and_repeatable(spark):
    _, docs, labels = labelled(spark)
    one, two = (samples.labelled_sample(docs, labels, "quality", "doc_id", "text", F.lit(True), 25) for _ in range(2))
    assert one == two and sum(y == 0 for _, y, _ in one) <= 26 and len(one) >= 50


# --- 1: mixing -------------------------------------------------------------------------------------------


def mix_rows(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", invented(i, rng.randrange(0, 60))) for i in range(300)]
    rows += [(None, None, "a b"), (900, "", None), (901, "silent", ""), (5, "hot", "again")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumns({"budget": F.lit(1), "epoch": F.lit(2), "tokens": F.lit(3)})


def test_weights_meet_the_entropy(spark):
    df = mix_rows(spark)
    rows = df.select(F.coalesce("source", F.lit("")).alias("source"), mixing.tokens(df, "text").alias("tokens"))
    table = mixing.weights(rows, 0.9, 1e6, 1.0, Stages(spark, "t")).collect()
    assert len(table) == 6 and abs(sum(r.weight for r in table) - 1) < 1e-9  # not the silent source
    assert abs(-sum(r.weight * math.log(r.weight) for r in table) - 0.9 * math.log(6)) < 1e-4
    limited = mixing.weights(rows, 1.0, 1.2, 1.0, Stages(spark, "t")).collect()
    assert abs(max(r.budget / r.total for r in limited) - 1.2) < 0.51 / min(r.total for r in limited)


def test_streams_stay_in_budget_and_repeat_evenly(spark):
    df = mix_rows(spark)
    out = mixing.schedule(df, entropy=0.97, repetition=50.0).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    total = sum(len((r.text or "").split()) for r in df.collect())
    for source, rows in by.items():
        rows.sort(key=lambda r: (r.place, r.tokens))
        at = 0
        for r in rows:
            assert r.place == at
            at += r.tokens
        assert at <= rows[0].weight * total + 1
        times = {}
        for r in rows:
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
        single = [n for i, n in times.items() if i != 5]
        assert max(single) - min(single) <= 1
    assert "silent" not in by
    assert mixing.schedule(df.limit(0)).count() == 0


def test_mixed_documents_keep_columns(spark):
    df = mix_rows(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    drawn = mixing.schedule(df).count()
    assert abs(out.count() - drawn) <= 1 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_equal_rows_share_their_drawings_exactly(spark):
    rows = [(None, "big", invented(1, 40))] * 30 + [(i, "small", invented(i, 100)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    drawn = sum(r.source == "big" for r in mixing.schedule(df).collect())
    out = [r for r in mixing.mixed_documents(df).collect() if r.source == "big"]
    assert drawn % 30 and len(out) == drawn


# --- 3: sharding ---------------------------------------------------------------------------------------------


def test_shards_take_turns():
    def plain(shards, slots):
        orders = []
        for s in shards:
            offset, stride = sharding.number(f"offset|{s}") % slots, sharding.number(f"stride|{s}") % (slots - 1) + 1
            orders.append([(offset + k * stride) % slots for k in range(slots)])
        owner = {}
        while len(owner) < slots:
            for i, order in enumerate(orders):
                if len(owner) < slots:
                    owner[next(x for x in order if x not in owner)] = i
        return [owner[k] for k in range(slots)]

    for n, slots in ((1, 7), (5, 101), (13, 211)):
        shards = [f"s{i}" for i in range(n)]
        got = sharding.fill(shards, slots)
        assert got == plain(shards, slots)
        sizes = [got.count(i) for i in range(n)]
        assert max(sizes) - min(sizes) <= 1
    before, after = sharding.fill([f"s{i}" for i in range(20)], 2003), sharding.fill([f"s{i}" for i in range(19)], 2003)
    assert sum(a != b for a, b in zip(before, after)) < 0.2 * 2003
    with pytest.raises(ValueError):
        sharding.fill([], 7)


def test_placement_of_odd_rows(spark):
    df = docs_frame(spark, ODD)
    out = sharding.with_shards(df, 16).collect()
    assert len(out) == len(ODD) and all(0 <= r.shard < 16 for r in out)
    assert len({r.shard for r in out if r.doc_id == 6}) == 1
    assert sharding.with_shards(df.limit(0), 16).count() == 0
