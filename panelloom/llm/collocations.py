"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials over word hashes give every n-gram of a text its fingerprint in
constant time.  Fingerprints are counted level by level, words first: an n-gram can
only be frequent if every shorter one inside it is, so level n counts only those whose
parts have their bit set in a bitmap of the frequent fingerprints so far.  Counts are
combined per Arrow batch and per task before the shuffle, which so carries
fingerprints and counts, never words.

Equal fingerprints may hide different phrases, so a count by fingerprint is only an upper
bound.  In a last scan each occurrence of a frequent fingerprint is compared with the
text at the pointer of the fingerprint's first occurrence in its slice of texts, word by word; what differs is
grouped anew.  Only phrases and words that pass are materialised as strings, each with its count
and the row of an occurrence, and the counts by string, exact, decide.  Pointers are resolved where the text is at
hand; only the rows of frequent phrases travel.

The bitmap has 16 bits for each frequent fingerprint, 128 MB at most; with more fingerprints it lets more n-grams
through and the result stays the same.

Edge cases: null and empty texts have no words; a null language is ``und``; texts are
processed whole, and phrases never cross pieces or texts; rows that repeat count as often as they
occur; null ids are nobody's pointer; languages without a phrase give no rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashing as H
from .stages import Stages, read

U = np.uint64
LONGEST = 4
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
SLICE = 1 << 21  # bytes of text worked on at once
MOST_BITS = 30
SALTS = 64
# Decimals, as products may pass 64 bits.
SCORE = "CAST(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)"

_OUTSIDE = np.zeros(256, dtype=bool)
_OUTSIDE[list(BREAKS + BLANKS)] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a slice of texts: bytes, hash, row and piece, and the fingerprints of their n-grams."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray, mask: int):
        inside = ~_OUTSIDE[raw]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.raw = _FOLD[raw]
        self.first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        self.size = last - self.first + 1
        self.per_row = np.diff(np.searchsorted(self.first, offsets))
        self.row = np.repeat(np.arange(len(self.per_row)), self.per_row)
        self.piece = np.cumsum(_BREAK[raw], dtype=np.int32)[self.first]
        self.mask = U(mask)
        self.lang = langs.view(U)[self.row]
        self.hash = (H.Bytes(raw).hashes(self.first, self.size) if len(raw) else np.zeros(0, U)) & self.mask
        up, self.down = H._powers(len(self.hash) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(H.mix(self.hash) * up[:-1], dtype=U)])

    def runs(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie within one piece of one text."""
        if len(self.first) < n:
            return np.zeros(0, np.int64)
        a, b = slice(0, len(self.first) - n + 1), slice(n - 1, len(self.first))
        return np.flatnonzero((self.row[a] == self.row[b]) & (self.piece[a] == self.piece[b]))

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that begin at these words; the language is part of them."""
        poly = (self.sums[at + n] - self.sums[at]) * self.down[at]
        return H.mix(poly + self.lang[at] + U(n * H.BASE % (1 << 64))) & self.mask

    def frequent(self, n: int, known: "Bits") -> np.ndarray:
        """First words of the n-grams both of whose longest shorter runs may be frequent."""
        at = self.runs(n)
        for shift in (0, 1) if n > 1 else ():
            at = at[known.has(self.prints(at + shift, n - 1))]
        return at


class Bits:
    """A bitmap that gives each fingerprint the place of its lowest bits."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.places = packed, U(8 * len(packed) - 1)

    def has(self, prints: np.ndarray) -> np.ndarray:
        place = prints & self.places
        return (self.packed[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1


def bits_of(prints: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the fingerprints' places, made in pieces of 32,768; at most 2**MOST_BITS bits."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pieces = prints.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    packed = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for bucket, piece in pieces.toLocalIterator():  # a bitmap, whatever the number of fingerprints
        packed[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(piece, dtype=np.uint8)
    return packed


def slices(texts: pa.Array, langs: pa.Array, mask: int) -> Iterator[tuple[int, int, Words]]:
    codes = langs.to_numpy(zero_copy_only=False)
    for lo, hi, raw, offsets in H.slices(texts, SLICE):
        yield lo, hi, Words(raw, offsets, codes[lo:hi], mask)


def counted(n: int, known, mask: int):
    """Arrow function: text, language code -> fingerprint, count of the n-grams of frequent parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(known.value) if known else None
        for batch in batches:
            found = [w.prints(w.frequent(n, bits), n) for _, _, w in slices(batch.column(0), batch.column(1), mask)]
            if found:
                prints, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(prints)), pa.array(counts)], names=["fp", "n"])

    return run


def same_words(w: Words) -> np.ndarray:
    """A number per word, equal exactly for equal words of folded text."""
    _, at, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    other = at[ids]
    equal = w.size == w.size[other]
    for lo in range(0, len(ids), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        size = np.where(equal[part], w.size[part], 0)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = w.raw[np.repeat(w.first[part], size) + step] != w.raw[np.repeat(w.first[other[part]], size) + step]
        equal[np.repeat(np.arange(lo, lo + len(size)), size)[differs]] = False
    if equal.all():
        return ids
    numbers: dict[bytes, int] = {}  # different words under one hash
    raw = w.raw.tobytes()
    return np.array([numbers.setdefault(raw[a : a + s], len(numbers)) for a, s in zip(w.first.tolist(), w.size.tolist())])


def distinct_runs(at: np.ndarray, prints: np.ndarray, n: int, ids: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence and count of every different n-gram: equal fingerprint and, verified, equal words."""
    firsts, counts = [], []
    while len(at):
        _, first, group = np.unique(prints, return_index=True, return_inverse=True)
        other = at[first][group]
        equal = langs[at] == langs[other]
        for j in range(n):
            equal &= ids[at + j] == ids[other + j]
        firsts.append(at[first])
        counts.append(np.bincount(group[equal], minlength=len(first)))
        at, prints = at[~equal], prints[~equal]
    return np.concatenate([*firsts, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def spelled(w: Words, at: np.ndarray, n: int) -> pa.Array:
    """The phrases as strings, words joined by one space."""
    size = sum(w.size[at + j] for j in range(n)) + n - 1
    ends = np.cumsum(size)
    flat = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    to = ends - size
    for j in range(n):
        long = w.size[at + j]
        step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        flat[np.repeat(to, long) + step] = w.raw[np.repeat(w.first[at + j], long) + step]
        to = to + long + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat))


def materialised(known, mask: int, id_type: pa.DataType):
    """Arrow function: text, language code, language, id -> language, words, phrase, count, id of a row with it.

    A row without words and phrase carries the number of words of a language.
    """
    names = ["lang", "words", "phrase", "n", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(known.value)
        for batch in batches:
            langs, keys = batch.column(2), batch.column(3)
            for lo, hi, w in slices(batch.column(0), batch.column(1), mask):
                mine = langs.slice(lo, hi - lo).dictionary_encode()
                code = mine.indices.to_numpy(zero_copy_only=False)
                total = np.bincount(code, w.per_row, minlength=len(mine.dictionary)).astype(np.int64)
                k = len(total)
                yield pa.RecordBatch.from_arrays(
                    [mine.dictionary, pa.array(np.zeros(k, np.int32)), pa.array([""] * k), pa.array(total), pa.nulls(k, id_type)], names=names
                )
                ids, of_word = same_words(w), code[w.row]
                for n in range(1, LONGEST + 1):
                    at = w.runs(1) if n == 1 else at[:-1][at[1:] == at[:-1] + 1]  # only where both shorter runs are frequent
                    at = at[(w.row[at] == w.row[at + n - 1]) & (w.piece[at] == w.piece[at + n - 1])]
                    prints = w.prints(at, n)
                    held = bits.has(prints)
                    at, prints = at[held], prints[held]
                    first, count = distinct_runs(at, prints, n, ids, of_word)
                    yield pa.RecordBatch.from_arrays(
                        [
                            mine.dictionary.take(pa.array(of_word[first])),
                            pa.array(np.full(len(first), n, np.int32)),
                            spelled(w, first, n),
                            pa.array(count),
                            keys.take(pa.array(w.row[first] + lo)),
                        ],
                        names=names,
                    )

    return run


def frequent_phrases(
    docs: DataFrame, stages: Stages, minimum: int, id_col: str, text_col: str, lang_col: str, mask: int = (1 << 64) - 1
) -> DataFrame:
    """(lang, words, phrase, n, first_id): every phrase of at most LONGEST words that occurs ``minimum`` times, with its
    exact count and the smallest id of a row with it; and with words = 0 the number of words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(id_col).alias("id"))
    coded = rows.select("text", F.xxhash64("lang").alias("code"), "lang", "id")
    frequent = None
    for n in range(1, LONGEST + 1):
        counts = coded.select("text", "code").mapInArrow(counted(n, shared(spark, frequent) if n > 1 else None, mask), "fp bigint, n bigint")
        level = stages.put(counts.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= minimum).select("fp"), f"level-{n}")
        frequent = level if frequent is None else frequent.unionByName(level)
    id_type = rows.schema["id"].dataType
    made = coded.mapInArrow(
        materialised(shared(spark, frequent), mask, to_arrow_type(id_type)),
        f"lang string, words int, phrase string, n bigint, id {id_type.simpleString()}",
    )
    exact = made.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"), F.min("id").alias("first_id"))
    out = stages.put(exact.where((F.col("n") >= minimum) | (F.col("words") == 0)), "phrases")
    stages.drop(*[f"level-{n}" for n in range(1, LONGEST + 1)])
    return out


def shared(spark: SparkSession, prints: DataFrame):
    """A broadcast bitmap, sized by the number of fingerprints."""
    bits = min(MOST_BITS, max(18, math.ceil(math.log2(16 * max(prints.count(), 1)))))
    return spark.sparkContext.broadcast(bits_of(prints, bits))


def wide(value: Column) -> Column:
    """For exact arithmetic beyond 64 bits."""
    return value.cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    minimum: int = 30,
    inside: int = 80,
    top: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    mask: int = (1 << 64) - 1,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, first_id): each language's best phrases of two to four words.

    ``score`` is 2,000,000 times the count over the summed counts of the two parts at the weakest cut; phrases
    that lie within a longer frequent one with ``inside`` percent of their count are dropped; ``mask`` keeps only some bits
    of the fingerprints, for tests.
    """
    stages = Stages(docs.sparkSession, "phrases")
    table = frequent_phrases(docs, stages, minimum, id_col, text_col, lang_col, mask)
    counts = table.where("words > 0").select("lang", "phrase", "n")
    cands = table.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), "first_id", F.split("phrase", " ").alias("w"))

    def joined(first: Column | int, length: Column) -> Column:
        return F.array_join(F.slice("w", first, length), " ")

    cuts = cands.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words", "w").select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", F.expr(SCORE))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Shorter phrases inside each candidate, with the count of the most frequent one around them.
    spans = [(i, size) for size in range(2, LONGEST) for i in range(1, LONGEST - size + 2)]
    inner = F.array_compact(F.array(*[
        F.when(F.lit(i + size - 1) <= F.col("words"), F.when(F.lit(size) < F.col("words"), joined(F.lit(i), F.lit(size)))) for i, size in spans
    ]))
    around = cands.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cands.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide(F.col("longer")) * F.lit(100) < wide(F.col("a")) * F.lit(inside))
    )
    full = kept.join(weakest, ["lang", "phrase"]).select("lang", "phrase", "a", "first_id", "cut.l", "cut.r", "cut.score")

    # A language may hold all phrases: the best of each salt first, then the best of these.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = full.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = table.where("words = 0").select("lang", "n")  # one row per language
    return best.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_id"
    )


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents")).drop("first_id")


OP12_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(unnest(string_split_regex(s, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM docs),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM pieces, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
parts AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
         FROM c, (VALUES (1), (2), (3)) v(cut) WHERE cut < words),
cuts AS (SELECT p.lang, p.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
         FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = head JOIN f y ON y.lang = p.lang AND y.phrase = rest),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + size - 1], ' ') AS phrase, c.a AS longer
         FROM c, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(size) WHERE size < c.words AND i + size - 1 <= c.words),
kept AS (SELECT * FROM weakest b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100::HUGEINT * h.longer >= 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000"""
