"""Fill-in-the-middle transformation by secondary sort.

A text is cut at two drawn places into prefix, middle and suffix, and its parts
are emitted in another order between markers.  Texts travel as *pieces* of at most CHUNK
characters, keyed by document and output position.  One exchange
by document with a sort by position inside the partitions brings the pieces into output order;
a task streams them into an incremental digest, so no task ever holds an output, however long.
For the restoration the assembled stream is read back with nothing but its form: markers are
recognised in the stream, what follows them becomes pieces keyed by their place in the
source, and a second sort inside the same partition, without another exchange,
streams them into the digest of the restored text.

A piece's key is the digest of id and text together with the number of the partition the row was read from.
Equal rows of one partition give equal pieces, which the assembly counts instead of
repeating; those of different partitions stay apart, so copies of one row do not meet in one task.
The key depends on content only: a retried task emits the same pieces.

Edge cases: null and empty texts are plain with empty output; a null id counts as the
empty string in the drawn numbers; texts with a marker in them are plain; repeated rows come back
once per row; columns other than id and text are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import read

# Markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Order of the parts in the output of each form, and in the source.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
SOURCE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

CHUNK = 1 << 16  # characters of a piece
REGION = 1 << 40  # more than any text has characters
HEAD, TAIL = -1, 1 << 60  # positions before and after all pieces
FLUSH = 1 << 21  # characters or, times 64, rows of a batch

KEY = ["k1", "k2", "part"]


def facts_type(id_type: str) -> str:
    return f"struct<id:{id_type},n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,copies:bigint,output_sha256:string>"


def drawn(key: int | None) -> list[int]:
    """The four numbers of a document."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(key: int | None, text: str) -> tuple[str, int, int]:
    """Form, and where prefix and middle end."""
    h1, h2, h3, h4 = drawn(key)
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= 90:
        return PLAIN, 0, n
    return (SPM if h4 % 100 < 20 else PSM), a, b


def chunks(text: str, start: int, stop: int, marker: str = "") -> Iterator[str]:
    """The stretch in pieces, the marker in front of the first; a stretch may be empty, a piece never is."""
    first = text[start : min(stop, start + CHUNK)]
    if marker or first:
        yield marker + first
    for at in range(start + CHUNK, stop, CHUNK):
        yield text[at : min(stop, at + CHUNK)]


class Rows:
    """Collects piece rows and gives them out as batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, key: tuple, pos: int, data: str | None = None, facts: dict | None = None) -> None:
        self.rows.append((*key, pos, data, facts))
        self.size += 64 + len(data or "")

    def batch(self, final: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (final or self.size >= FLUSH):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows, self.size = [], 0


def schema_of(id_type: pa.DataType) -> pa.Schema:
    facts = pa.struct(
        [("id", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
         ("copies", pa.int64()), ("output_sha256", pa.string())]
    )
    return pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("data", pa.string()), ("facts", facts)])


def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: id, text -> the pieces of every output and a row of facts before them."""
    part, out = TaskContext.get().partitionId(), None
    for batch in batches:
        out = out or Rows(schema_of(batch.schema.field(0).type))
        for key, value in zip(batch.column(0), batch.column(1)):
            key, text = key.as_py(), value.as_py() or ""
            digest = hashlib.sha256(f"{key}|".encode() + text.encode()).digest()
            mark = (int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:16], signed=True), part)
            form, a, b = cut(key, text)
            whole = form == PLAIN
            out.add(mark, HEAD, facts={
                "id": key, "n": len(text), "form": form, "prefix_chars": None if whole else a, "middle_chars": None if whole else b - a, "copies": 1,
            })
            stretch = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
            at = 0
            for marker in ("",) if whole else ORDER[form]:
                for data in chunks(text, *((0, len(text)) if whole else stretch[marker]), marker):
                    out.add(mark, at, data)
                    at += len(data)
                    yield from out.batch()
            yield from out.batch()
    if out:
        yield from out.batch(True)


class Restorer:
    """Reads an assembled stream, cut anywhere, and tells for each stretch of it its place in the source."""

    def __init__(self, form: str):
        self.ahead = list(ORDER.get(form, ()))
        self.carry = ""
        self.at = 0

    def feed(self, data: str, last: bool = False) -> Iterator[tuple[int, str]]:
        data, self.carry = self.carry + data, ""
        while self.ahead and (found := data.find(self.ahead[0])) >= 0:
            yield from self.placed(data[:found])
            self.at = SOURCE[self.ahead.pop(0)] * REGION
            data = data[found + len(PREFIX) :]
        if self.ahead and not last:  # the next marker may have begun
            keep = len(PREFIX) - 1
            data, self.carry = data[:-keep], data[-keep:]
        yield from self.placed(data)

    def placed(self, data: str) -> Iterator[tuple[int, str]]:
        if data:
            yield self.at, data
            self.at += len(data)


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, str | None, dict | None]]:
    """Key, position, data and facts of the sorted pieces."""
    for batch in batches:
        yield from zip(zip(*(batch.column(i).to_pylist() for i in range(3))), *(batch.column(i).to_pylist() for i in (3, 4, 5)))


def assembled(schema: pa.Schema):
    """Arrow function: pieces in output order -> pieces by their place in the source, and the facts with the output's digest after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, last, facts = Rows(schema), None, None, None

        def end() -> None:
            for at, data in restorer.feed("", last=True):
                out.add(key, at, data)
            out.add(key, TAIL, facts=facts | {"output_sha256": digest.hexdigest()})

        for now, pos, data, told in documents_of(batches):
            if now != key:
                if key is not None:
                    end()
                key, last, facts, digest, restorer = now, HEAD, told, hashlib.sha256(), Restorer(told["form"])
            elif pos == HEAD:
                facts["copies"] += 1
            elif pos != last:  # the first of equal pieces
                last = pos
                digest.update(data.encode())
                for at, stretch in restorer.feed(data):
                    out.add(now, at, stretch)
            yield from out.batch()
        if key is not None:
            end()
        yield from out.batch(True)

    return run


def restored(schema: pa.Schema):
    """Arrow function: pieces in source order -> facts and the digest of the restored text, once per copy of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, rows = hashlib.sha256(), []
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in rows], schema.field(c).type) for c in [*names, "restored_sha256"]]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for _, _, data, facts in documents_of(batches):
            if facts is None:
                digest.update(data.encode())
                continue
            facts["restored_sha256"] = digest.hexdigest()
            for _ in range(facts["copies"]):
                rows.append(facts)
                if len(rows) >= 4096:
                    yield batch()
                    rows = []
            digest = hashlib.sha256()
        if rows:
            yield batch()

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, part, pos, data, facts): the pieces of every output, in output order within the partitions.

    All pieces of a document lie in one partition; writing ``data`` in this order writes the outputs.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(emitted, f"k1 bigint, k2 bigint, part int, pos bigint, data string, facts {facts_type('bigint')}")
    return made.repartition(*KEY).sortWithinPartitions(*KEY, "pos")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    kept = schema_of(pa.int64())
    in_source = pieces(docs, id_col, text_col)
    in_source = in_source.mapInArrow(assembled(kept), in_source.schema).sortWithinPartitions(*KEY, "pos")
    out = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
         ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    )
    columns = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return in_source.mapInArrow(restored(out), columns).withColumnRenamed("id", id_col)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, text): the outputs as rows, as long as the input rows; repeated rows of a partition come back once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(facts: dict, parts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([facts["id"]], pa.int64()), pa.array([facts["form"]]), pa.array(["".join(parts)])], names=["id", "form", "text"]
            )

        key, last, facts, parts = None, None, None, []
        for now, pos, data, told in documents_of(batches):
            if now != key:
                if key is not None:
                    yield batch(facts, parts)
                key, last, facts, parts = now, HEAD, told, []
            elif pos != last:
                last = pos
                parts.append(data)
        if key is not None:
            yield batch(facts, parts)

    return pieces(docs, id_col, text_col).mapInArrow(run, "id bigint, form string, text string").withColumnRenamed("id", id_col)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return transform(read(spark, sf_dir, "documents"))


_CUT = """t AS (SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(s, 1, a) AS prefix, substr(s, a + 1, b - a) AS middle, substr(s, b + 1) AS suffix FROM c)"""

OP11_SQL = f"""WITH {_CUT} SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(s) AS restored_sha256 FROM p"""
