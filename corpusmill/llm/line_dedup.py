"""Line dedup: which lines of each document to keep, as compressed bitmaps.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys of
at least ``MIN_CHARS`` code points that at least ``MIN_DOCS`` documents hold lose their lines in all
but the largest ``doc_id``.

Each task first settles what it can alone: of a key that three of its documents hold, all but the
largest are dropped at once and a single document goes on, so a common line costs at most one
document a task.  The rest is partitioned by ranges of the key's 128-bit digest, sorted by hash,
document (largest first) and position, and streamed: the first document of a hash stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets, scratch

MIN_CHARS = 20
MIN_DOCS = 3
BUFFER = 500_000
NO_ID = -(2**63)
SETTLED, MANY, ONE = 0, 1, 2

ENTRY = "pid int, h1 long, h2 long, doc long, tag long, pos int, kind int"
_NAMES = ["pid", "h1", "h2", "doc", "tag", "pos", "kind"]


def keyed_lines(t: bytesets.Texts, min_chars: int) -> tuple[np.ndarray, ...]:
    """Row number, line number and both halves of the digest of each line with a long enough key."""
    ls, le, row = bytesets.lines(t)
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    pos = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    solid = np.r_[0, np.cumsum(~bytesets.SPACE[t.data])] if len(t.data) else np.zeros(1, np.int64)
    places = np.flatnonzero(~bytesets.SPACE[t.data])
    some = solid[le] > solid[ls]
    ls, le, row, pos = ls[some], le[some], row[some], pos[some]
    s, e = places[solid[ls]], places[solid[le] - 1] + 1
    chars = bytesets.code_points(t.data)
    long = chars[e] - chars[s] >= min_chars
    s, e, row, pos = s[long], e[long], row[long], pos[long]
    folded = bytesets.LOWER[t.data]
    return row, pos, *bytesets.span_digests(folded, s, e)


def _groups(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted entries: the group number of each, where groups start, and distinct documents by group."""
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    start = np.flatnonzero(new)
    return np.cumsum(new) - 1, start, np.add.reduceat((new | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64), start)


def _settle(parts: list[tuple[np.ndarray, ...]], width: int, min_docs: int) -> pa.RecordBatch:
    """What goes on from one task's entries ``(h1, h2, doc, tag, pos)``."""
    h1, h2, doc, tag, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, ~doc, h2, h1))  # ~, as - overflows for NO_ID
    h1, h2, doc, tag, pos = h1[order], h2[order], doc[order], tag[order], pos[order]
    group, start, docs = _groups(h1, h2, doc)
    many = docs[group] >= min_docs
    settled = many & (doc != doc[start][group])
    kind = np.where(settled, SETTLED, np.where(many, MANY, ONE)).astype(np.int32)
    # settled lines pass by any range: by document, so that copies of one text spread
    key = np.where(settled, bytesets.mix(doc.view(np.uint64)), h1)
    pid = ((key >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(pid), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(pos.astype(np.int32)), pa.array(kind)], _NAMES)


def _entries(width: int, min_chars: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for t in bytesets.texts(batch.column(2)):
                row, pos, h1, h2 = keyed_lines(t, min_chars)
                row = row + t.rows[0]
                parts.append((h1, h2, docs[row], tags[row], pos))
                held += len(row)
                if held >= BUFFER:
                    yield _settle(parts, width, min_docs)
                    parts, held = [], 0
        if held:
            yield _settle(parts, width, min_docs)

    return run


def _by_document(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[start, len(doc)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array(tag[start]), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))], ["doc", "tag", "lines"])


def _stream(min_docs: int):
    """Sorted entries to ``doc, tag, lines``: dropped lines.  Carries one group from batch to batch,
    as all its entries while it is undecided (fewer than ``min_docs`` documents), else as its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7)]
            done = cols[5] == SETTLED
            gone = [tuple(c[done] for c in cols[2:5])]
            cols = [c[~done] for c in cols]
            if carry:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if len(cols[0]):
                h1, h2, doc, tag, pos, kind = cols
                group, start, docs = _groups(h1, h2, doc)
                full = (docs >= min_docs) | (np.maximum.reduceat(kind == MANY, start))
                drop = full[group] & (doc != doc[start][group])
                gone.append((doc[drop], tag[drop], pos[drop]))
                last = slice(start[-1], start[-1] + 1 if full[-1] else None)
                carry = [c[last].copy() for c in cols]
                if full[-1]:
                    carry[5][:] = MANY
            out = [np.concatenate(x) for x in zip(*gone, strict=True)]
            if len(out[0]):
                yield _by_document(*out)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, tag, lines``: sorted numbers of the dropped lines of each document that loses any.

    ``doc`` is the id (null: the smallest of all) and ``tag`` a hash of the text, so rows that share
    an id are told apart; rows equal in both are one.  A null text is one empty line.
    """
    n = scratch.width(docs.sparkSession)
    keyed = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))
    entries = keyed.mapInArrow(_entries(n, min_chars, min_docs), ENTRY)
    sorted_ = entries.repartitionById(n, F.col("pid")).sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    parts = sorted_.mapInArrow(_stream(min_docs), "doc long, tag long, lines array<int>")
    return parts.groupBy("doc", "tag").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def _key():
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")


def pack(lines: list[int] | np.ndarray) -> bytes:
    """Dropped line numbers as a compressed bitmap: bit i is 1 where line i stays, up to the last drop."""
    keep = np.ones(int(max(lines)) + 1, np.uint8)
    keep[np.asarray(lines)] = 0
    return zlib.compress(len(keep).to_bytes(4, "little") + np.packbits(keep).tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines stay; no bitmap keeps all."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        raw = zlib.decompress(bitmap)
        n = int.from_bytes(raw[:4], "little")
        keep[:n] = np.unpackbits(np.frombuffer(raw[4:], np.uint8), count=n)[:n_lines].astype(bool)
    return keep


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [pack(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc", "tag", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, tag, keep`` for each document that loses a line: its bitmap instead of its text."""
    return dropped_lines(docs, min_chars, min_docs).mapInArrow(_pack, "doc long, tag long, keep binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, the number of lines it had and how many went."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = unpack(bitmap, len(lines))
    return b"\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), int((~keep).sum())


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc").alias("__mill_doc"), F.col("tag").alias("__mill_tag"), F.col("keep").alias("__mill_keep"))
    doc, tag = _key()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], doc.alias("__mill_d"), tag.alias("__mill_t"))
    return rows.join(maps.hint("shuffle_hash"), (F.col("__mill_d") == F.col("__mill_doc")) & (F.col("__mill_t") == F.col("__mill_tag")), "left").drop("__mill_d", "__mill_t", "__mill_doc", "__mill_tag")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the dropped lines cut out of ``text``; all rows and columns stay.

    A text that loses all its lines becomes empty; a null text stays null.  Where ``docs`` has an
    integer ``n_chars``, it follows the new text.
    """

    def cut(batches):
        for batch in bytesets.slices(batches):
            at = batch.schema.get_field_index("text")
            maps = batch.column(batch.schema.get_field_index("__mill_keep"))
            if maps.null_count < len(maps):
                texts = [t if t is None or m is None else kept_text(t.encode(), m)[0].decode() for t, m in zip(batch.column(at).to_pylist(), maps.to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.drop_columns(["__mill_keep"])

    out = _with_bitmaps(docs, min_chars, min_docs).mapInArrow(cut, docs.schema)
    if dict(docs.dtypes).get("n_chars") in ("bigint", "int"):
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each document, from its bitmap and text."""

    def run(batches):
        for batch in bytesets.slices(batches):
            rows = [kept_text((t or "").encode(), m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, (g.key IS NOT NULL AND k.doc_id <> g.top) AS dropped FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
