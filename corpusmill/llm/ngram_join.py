"""N-gram Jaccard join by rare-first prefix filtering.

1. A sketch of fixed size counts in how many documents shingles occur (an upper bound for each);
   shingles are ordered by the logarithm of that count, then by hash: rare ones first.
2. Documents with equal sets are one class; one of its rows stands for it.  Copies within a task are
   settled there: only the first goes on, whatever the size of the class.
3. Of a set of ``n`` the first ``n - ceil(t n) + 1`` shingles are its prefix.  Two sets that link
   share a prefix shingle.  Prefix shingles are exchanged in packed runs by hash range, and those
   that a single class holds end there.
4. Classes that meet at a shingle are candidates if a link is possible by their lengths, by the
   positions of the shingle, and by the prefix shingles nobody else holds: of two classes, the one
   whose prefix ends first shares none of those with the other.
5. The suffix filter: counts of a set's shingles by hash range are kept with its class and bound the
   intersection of each candidate pair before any text moves.
6. Each remaining pair is verified once, by the exact intersection of the sets of both texts.
7. Large groups don't emit all pairs: a few of their members (hubs: the one with fewest shingles of
   its own, and some by hash) meet all others first, in salted parts; pairs whose ends are connected
   by then need no verification, and only members outside a group's main component are compared with
   the rest.

Every row is a document of its own with a number given when the sets are written; ids may be null or
repeated.  A component is named by the smallest id that isn't null among its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesets, components, scratch
from .bytesets import U64

WORDS = 4
PERCENT = 85
SKETCH_BITS = 22
SMALL_GROUP = 6
HUBS = 3
CHUNK_OF_OWNER = 128
BLOCK = 1024
BINS = 64
SALT = 512
FILTER_BITS = 20, 26
LEADS = 30_000
RUN = 200_000


def shingles(t: bytesets.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each shingle, distinct in its text, sorted by both."""
    s, e, row = bytesets.words(t)
    h = bytesets.span_hashes(bytesets.LOWER[t.data], s, e)
    n = np.bincount(row, minlength=len(t.starts))
    g = np.zeros(len(h), U64)
    for k in range(min(words, len(h))):
        g[: len(h) - k] = (g[: len(h) - k] * U64(0xC2B2AE3D27D4EB4F)) ^ bytesets.mix(h[k:] + U64(k))
    g = bytesets.mix(g)
    begin = np.r_[0, np.cumsum(n)]
    whole = np.zeros(len(h), bool)
    if len(h) >= words:
        whole[: len(h) - words + 1] = row[: len(h) - words + 1] == row[words - 1 :]
    rows, hashes = row[whole], g[whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        own = np.zeros(len(short), U64)
        for k in range(words - 1):
            more = n[short] > k
            own[more] = (own[more] * U64(0xC2B2AE3D27D4EB4F)) ^ bytesets.mix(h[begin[short[more]] + k] + U64(k))
        own = bytesets.mix(own ^ n[short].astype(U64) << U64(56))
        rows, hashes = np.r_[rows, short], np.r_[hashes, own]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with ``100 i >= percent (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


# ---- frequency sketch


SKETCH_PARTS = 64


def _sketch_part(words: int, spread: int):
    """Counts of one task's shingles, as places and numbers of each part of the sketch that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in batches:
            task = batch.column(0)[0].as_py() if task is None and batch.num_rows else task
            for t in bytesets.texts(batch.column(1)):
                place, n = np.unique((shingles(t, words)[1] >> U64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[place] += n.astype(np.uint32)
        if total.any():
            parts = {k: _sparse(p) for k, p in enumerate(np.split(total, SKETCH_PARTS)) if p.any()}
            pid = [k * spread + task % spread for k in parts]
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["pid", "part", "counts"])

    return run


def _sparse(counts: np.ndarray) -> bytes:
    place = np.flatnonzero(counts)
    return bytesets.pack(np.diff(place, prepend=0).astype(np.uint32), counts[place].astype(np.uint64))


def _sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each part of the sketch among a task's rows."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            gaps, n = bytesets.unpack(blob)
            counts = total.setdefault(part, np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64))
            counts[np.cumsum(gaps, dtype=np.int64)] += n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array([_sparse(v) for v in total.values()], pa.binary())], ["pid", "part", "counts"])


def frequency_levels(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """For each of ``2 ** SKETCH_BITS`` hash ranges, about the logarithm of its shingles' count over all documents.

    Tasks' counts are summed in two steps, so no reducer reads a blob of every task.
    """
    spread = max(1, scratch.width(docs.sparkSession) // SKETCH_PARTS)
    schema = "pid int, part int, counts binary"
    parts = docs.select(F.spark_partition_id().alias("task"), "text").mapInArrow(_sketch_part(words, spread), schema)
    for n in (SKETCH_PARTS * spread, SKETCH_PARTS)[spread == 1 :]:
        parts = parts.repartitionById(n, F.col("pid")).mapInArrow(_sketch_sum, schema)
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for r in parts.select("part", "counts").collect():
        gaps, n = bytesets.unpack(r["counts"])
        out[r["part"], np.cumsum(gaps, dtype=np.int64)] = np.minimum(np.ceil(2 * np.log2(n.astype(float) + 1)), 31)
    return out.ravel()


# ---- sets and prefixes


SETS = "doc_id long, tag long, n long, f1 long, f2 long, lead boolean, last long, bins binary, prefix binary"


def _sets(shared, words: int, percent: int):
    """Each text's set: its size and fingerprint; of the first text of a class in this task, its prefix and counts, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        leads: set[bytes] = set()
        for batch in batches:
            for t in bytesets.texts(batch.column(2)):
                row, h = shingles(t, words)
                k = len(t.starts)
                n = np.bincount(row, minlength=k)
                token = levels[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << U64(58) | h >> U64(6)
                order = np.lexsort((token, row))
                token = token[order]
                begin = np.r_[0, np.cumsum(n)]
                sums = [np.r_[U64(0), np.cumsum(bytesets.mix(h ^ U64(salt)), dtype=U64)] for salt in (0x1234567, 0x89ABCDEF01)]
                f1, f2 = ((c[begin[1:]] - c[begin[:-1]]).view(np.int64) for c in sums)
                keep = n - (percent * n + 99) // 100 + (n > 0)
                # a set that this task has seen is a copy
                lead = []
                for a, b, m in zip(f1.tolist(), f2.tolist(), n.tolist(), strict=True):
                    lead.append(m > 0 and (a, b, m) not in leads)
                    if lead[-1]:
                        leads.add((a, b, m))
                if len(leads) > LEADS:
                    leads.clear()
                at = np.bincount(row * BINS + (h >> U64(58)).astype(np.int64), minlength=k * BINS).reshape(k, BINS)
                bins = [_counts(c) if x else None for c, x in zip(at, lead, strict=True)]
                prefix = [token[b : b + p].tobytes() if x else None for b, p, x in zip(begin.tolist(), keep.tolist(), lead, strict=False)]
                last = np.r_[token, U64(0)][np.where(n > 0, begin[:-1] + keep - 1, len(token))].view(np.int64)
                own = slice(int(t.rows[0]), int(t.rows[0]) + k)
                ids = [batch.column(c).slice(own.start, k) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), pa.array(lead), pa.array(last), pa.array(bins, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "tag", "n", "f1", "f2", "lead", "last", "bins", "prefix"])

    return run


def _counts(c: np.ndarray) -> bytes:
    """Counts by hash range: a byte each where that is enough."""
    return c.astype("u1" if c.max() < 256 else "<u4").tobytes()


def _counts_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "u1" if len(blob) == BINS else "<u4").astype(np.int64)


def _runs(width: int):
    """Prefix entries in packed runs: ``pid, run`` with arrays token, doc, n, position."""

    def emit(parts):
        token, doc, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        pid = (bytesets.mix(token) >> U64(32)) * U64(width) >> U64(32)
        order = np.lexsort((token, pid))
        token, doc, n, pos, pid = token[order], doc[order], n[order], pos[order], pid[order]
        start = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]])
        ends = np.r_[start[1:], len(pid)]
        return pa.RecordBatch.from_arrays([pa.array(pid[start].astype(np.int32)), pa.array([bytesets.pack(token[a:b], doc[a:b], n[a:b], pos[a:b]) for a, b in zip(start, ends, strict=True)], pa.binary())], ["pid", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, n, prefix in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "prefix")), strict=True):
                token = np.frombuffer(prefix, U64)
                m = len(token)
                parts.append((token, np.full(m, doc, np.int64), np.full(m, n, np.int32), np.arange(m, dtype=np.int32)))
                held += m
                if held >= RUN:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one hash range to the entries whose shingle two classes or more hold, with their number."""
    parts: dict[int, list] = {}
    for batch in batches:
        for pid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts.setdefault(pid, []).append(bytesets.unpack(blob))
    for pid in sorted(parts):
        token, doc, n, pos = (np.concatenate(x) for x in zip(*parts.pop(pid), strict=True))
        order = np.argsort(token, kind="stable")
        token = token[order]
        new = np.r_[True, token[1:] != token[:-1]]
        members = np.diff(np.r_[np.flatnonzero(new), len(token)])[np.cumsum(new) - 1]
        many = members > 1
        order = order[many]
        yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(members[many].astype(np.int32)), pa.array(doc[order]), pa.array(n[order]), pa.array(pos[order])], ["token", "members", "doc", "n", "pos"])


def _possible(x: str, y: str, percent: int):
    """Length, positional and prefix filters on the entries ``x`` and ``y`` of one shingle."""
    a = lambda c: F.col(f"{x}.{c}")
    b = lambda c: F.col(f"{y}.{c}")
    need = F.expr(f"(({x}.n + {y}.n) * {percent} + {99 + percent}) div {100 + percent}")
    length = F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * percent
    position = F.least(a("pos"), b("pos")) + F.least(a("n") - a("pos"), b("n") - b("pos")) >= need
    return length & position & (F.when(a("last") <= b("last"), a("n") - a("alone")).otherwise(b("n") - b("alone")) >= need)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


# ---- verification


def _suffix_filter(percent: int):
    """Candidate pairs whose counts by hash range leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.slices(batches, 4096):
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            x, y = (np.array([_counts_of(v) for v in batch.column(c).to_pylist()]).reshape(-1, BINS) for c in ("x", "y"))
            ok = np.minimum(x, y).sum(1) >= least_overlap(n, m, percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that pass the suffix filter on the counts of ``classes``."""
    side = lambda key, size, bins: classes.select(F.col("doc").alias(f"_{key}"), F.col("n").alias(size), F.col("bins").alias(bins))
    rows = pairs.join(side("a", "n", "x"), F.col("a") == F.col("_a")).join(side("b", "m", "y"), F.col("b") == F.col("_b"))
    return rows.select("a", "b", "n", "m", "x", "y").mapInArrow(_suffix_filter(percent), "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    need = int(least_overlap(np.int64(len(x)), np.int64(len(y)), percent))
    if min(len(x), len(y)) < need:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def _verify(words: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        owner = key[0].as_py()
        sets: dict[int, np.ndarray] = {}
        for batch in table.select(["id", "text"]).to_batches():
            ids = batch.column(0).to_numpy()
            for t in bytesets.texts(batch.column(1)):
                row, h = shingles(t, words)
                cut = np.searchsorted(row, np.arange(len(t.starts) + 1))
                for k in range(len(t.starts)):  # rows equal in id and text come several times
                    sets[int(ids[t.rows[k]])] = h[cut[k] : cut[k + 1]]
        own = sets.pop(owner, np.zeros(0, U64))
        found = [d for d, more in sorted(sets.items()) if linked(own, more, percent)]
        return pa.table({"a": pa.array([owner] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def _bits_part(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for batch in batches:
            bits[_places(batch.column(0).to_numpy(), size)] = True
        if bits.any():
            parts = {k: p for k, p in enumerate(np.split(np.packbits(bits), 64)) if p.any()}
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([bytesets.pack(p) for p in parts.values()], pa.binary())], ["part", "bits"])

    return run


def _bits_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = bytesets.unpack(blob)[0]
            whole[part] = whole[part] | bits if part in whole else bits
    if whole:
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([bytesets.pack(b) for b in whole.values()], pa.binary())], ["part", "bits"])


def _places(tags: np.ndarray, size: int) -> np.ndarray:
    return (bytesets.mix(tags.view(U64) + U64(77)) >> U64(64 - size)).astype(np.int64)


def _tag_filter(tags: DataFrame, size: int) -> np.ndarray:
    """A bit for each range of hashed tags that holds one of ``tags``."""
    parts = tags.mapInArrow(_bits_part(size), "part int, bits binary").repartitionById(64, F.col("part")).mapInArrow(_bits_join, "part int, bits binary")
    out = np.zeros((64, (1 << size) // 512), np.uint8)
    for r in parts.collect():
        out[r["part"]] = bytesets.unpack(r["bits"])[0]
    return out.ravel()


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, text``; ``tag`` is a hash of the text."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that link.  A class with many partners is checked in parts.

    The text of a class is found by its row's id and tag.  Texts are thinned by a filter of up to
    ``2 ** FILTER_BITS[1]`` bits before the exchange; what it lets through by chance falls out in the join.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK_OF_OWNER).cast("int").alias("parts"))
    asked = pairs.join(degree, "a").select(F.col("a").alias("owner"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    owners = degree.select(F.col("a").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    where = classes.select(F.col("doc").alias("_doc"), F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    wanted = scratch.save(asked.union(owners).join(where, F.col("id") == F.col("_doc")).drop("_doc"), "ngram-wanted")
    size = min(max(wanted.count() * 16, 1).bit_length(), FILTER_BITS[1])
    size = max(size, FILTER_BITS[0])
    shared = docs.sparkSession.sparkContext.broadcast(_tag_filter(wanted.select("_tag"), size))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = _places(batch.column(1).to_numpy(), size)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    texts = _keyed(docs).mapInArrow(thin, "doc_id long, tag long, text string")
    rows = texts.join(wanted, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("owner", "part", "id", "text")
    return rows.groupBy("owner", "part").applyInArrow(_verify(words, percent), "a long, b long")


def _blocks(percent: int):
    """Members outside the main component against a block of a family: pairs that may link.

    The shingles of each document's prefix that others hold are the columns of a matrix; the product
    of two blocks counts the shared ones of every pair.  Of two documents, the one whose prefix ends
    first shares no others of its prefix, so the count bounds the intersection.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, doc, comp, n, last = (table.column(c).to_numpy() for c in ("side", "doc", "comp", "n", "last"))
        lists = table.column("tokens").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        sizes = np.diff(lists.offsets.to_numpy())
        token = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(doc)), sizes)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        on = np.zeros(len(doc), bool)
        on[left] = True
        both = np.intersect1d(token[on[row]], token[~on[row]])
        ok = np.isin(token, both)
        token, row = np.searchsorted(both, token[ok]), row[ok]
        place = np.zeros(len(doc), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        count = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(both), 2048):
            part = (token >= at) & (token < at + 2048)
            r, t = row[part], token[part] - at
            a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            a[place[r[on[r]]], t[on[r]]] = 1
            b[place[r[~on[r]]], t[~on[r]]] = 1
            count += a @ b.T
        i, j = np.nonzero(count)
        c = count[i, j].astype(np.int64)
        i, j = left[i], right[j]
        n = n.astype(np.int64)
        need = least_overlap(n[i], n[j], percent)
        beyond = (percent * n + 99) // 100 - 1
        first = last[i] <= last[j]
        ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])) & (c + np.where(first, beyond[i], beyond[j]) >= need)
        a, b = doc[i[ok]], doc[j[ok]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _salts(members):
    """In how many parts a group of so many members is handled."""
    return F.ceil(F.col(members) / SALT).cast("int")


def _rest(entries: DataFrame, large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet in a large group, aren't connected by ``links`` and may link.

    A family is all documents of the groups with one main component; in blocks, its members outside
    that component meet all its members.
    """
    comp = components.components(links).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    named = large.join(comp, F.col("doc") == F.col("_n"), "left").select("token", "salt", "members", "doc", F.coalesce("_c", "doc").alias("comp"))
    named = scratch.save(named, "ngram-named")
    sizes = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("members").alias("members"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("family"), F.count(F.lit(1)).alias("comps"), F.max("members").alias("members")).where("comps > 1")
    main = main.select(F.col("token").alias("_t"), "family", F.explode(F.sequence(F.lit(0), _salts("members") - 1)).alias("_s"))
    members = scratch.save(named.join(main, (F.col("token") == F.col("_t")) & (F.col("salt") == F.col("_s"))).select("family", "doc", "comp").distinct(), "ngram-families")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c) / BLOCK)).cast("int")
    parts = members.groupBy("family").agg(blocks(F.col("comp") != F.col("family")).alias("outs"), blocks(F.lit(True)).alias("alls")).select(F.col("family").alias("_f"), "outs", "alls")
    members = members.join(parts, F.col("family") == F.col("_f"))
    mine = lambda k: F.pmod(F.xxhash64("doc"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    outside = members.where("comp <> family").select("family", F.lit(0).alias("side"), mine("outs").alias("out"), each("alls").alias("all"), "doc", "comp")
    whole = members.select("family", F.lit(1).alias("side"), each("outs").alias("out"), mine("alls").alias("all"), "doc", "comp")
    held = entries.groupBy("doc").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.collect_list("token").alias("tokens")).withColumnRenamed("doc", "_d")
    rows = outside.union(whole).join(held, F.col("doc") == F.col("_d")).drop("_d")
    return rows.groupBy("family", "out", "all").applyInArrow(_blocks(percent), "a long, b long").distinct()


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``sets`` (a row for each of ``docs``, numbered ``row``) and ``named``: ``f1, f2, n, group`` of each class."""
    spark = docs.sparkSession
    with scratch.temporary(spark) as keep:
        width = scratch.width(spark)
        shared = spark.sparkContext.broadcast(frequency_levels(docs, words))
        made = _keyed(docs).mapInArrow(_sets(shared, words, percent), SETS)
        sets = keep(made.withColumn("row", F.monotonically_increasing_id()), "ngram-sets")
        # the row that stands for a class has its prefix, so it is one of those that lead in their task
        lead = F.min_by(F.struct(F.col("row").alias("doc"), "doc_id", "tag", "last", "bins", "prefix"), "row").alias("lead")
        classes = scratch.save(sets.where("lead").groupBy("f1", "f2", "n").agg(lead).select("f1", "f2", "n", "lead.*"), "ngram-classes")
        runs = classes.select("doc", F.col("n").cast("int"), "prefix").mapInArrow(_runs(width), "pid int, run binary")
        shared_by = scratch.save(runs.repartitionById(width, F.col("pid")).mapInArrow(_shared, "token long, members int, doc long, n int, pos int"), "ngram-shared")
        alone = shared_by.groupBy("doc").agg(F.first("n").alias("size"), F.count(F.lit(1)).alias("met"))
        alone = alone.join(classes.select("doc", "last"), "doc")
        alone = alone.select(F.col("doc").alias("_d"), F.expr(f"size - (size * {percent} + 99) div 100 + 1 - met").alias("alone"), "last")
        salt = F.pmod(F.xxhash64("doc"), _salts("members")).cast("int").alias("salt")
        entries = scratch.save(shared_by.join(alone, F.col("doc") == F.col("_d")).select("token", "members", salt, "doc", "n", "pos", "alone", "last"), "ngram-entries")
        few, large = entries.where(F.col("members") <= SMALL_GROUP), entries.where(F.col("members") > SMALL_GROUP)
        twos = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") < F.col("y.doc")) & _possible("x", "y", percent))
        member = F.struct("doc", "n", "pos", "alone", "last")
        hubs = [F.min_by(member, F.struct("alone", "doc"))] + [F.min_by(member, F.xxhash64("doc", F.lit(k))) for k in range(1, HUBS)]
        stars = large.groupBy("token").agg(F.max("members").alias("members"), F.array(*hubs).alias("hubs"))
        stars = stars.select("token", F.explode(F.sequence(F.lit(0), _salts("members") - 1)).alias("salt"), "hubs").select("token", "salt", F.explode("hubs").alias("hub")).select("token", "salt", "hub.*")
        met = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.doc") != F.col("y.doc"))
        stars = stars.alias("x").join(large.alias("y"), met & _possible("x", "y", percent))
        pairs = scratch.save(_pairs(twos).union(_pairs(stars)).distinct(), "ngram-candidates")
        links = scratch.save(verify(docs, classes, plausible(pairs, classes, percent), words, percent), "ngram-links")
        if large.take(1):
            rest = scratch.save(_rest(entries, large, links, percent).join(pairs, ["a", "b"], "left_anti"), "ngram-rest")
            if rest.take(1):
                links = links.union(scratch.save(verify(docs, classes, plausible(rest, classes, percent), words, percent), "ngram-links2"))
        comp = components.components(links).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        named = classes.join(comp, F.col("doc") == F.col("_n"), "left").select("f1", "f2", "n", F.coalesce("_c", "doc").alias("group"))
        named = keep(named, "ngram-classes")
    return sets, named


def _with_group(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``sets`` with the ``group`` of their class; null for an empty set."""
    same = (F.col("_f1") == F.col("f1")) & (F.col("_f2") == F.col("f2")) & (F.col("_n") == F.col("n"))
    mine = named.select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.col("n").alias("_n"), "group")
    # empty sets are no class: their rows get a key of their own, so that they spread
    rows = sets.select("doc_id", "tag", "row", "n", F.when(F.col("n") > 0, F.col("f1")).otherwise(F.col("row")).alias("f1"), "f2")
    return rows.join(mine, same, "left").select("doc_id", "tag", "row", "n", "group")


def _tops(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Of each group: the smallest id that isn't null (null if there is none), and a row that has it."""
    top = lambda s, row: F.coalesce(F.min_by(row, "least"), F.min(row)).alias(row)
    per_class = sets.where("n > 0").select("f1", "f2", "n", F.col("doc_id").alias("least"), "row").groupBy("f1", "f2", "n").agg(F.min("least").alias("least_id"), top(sets, "row")).withColumnRenamed("least_id", "least")
    grouped = per_class.join(named, ["f1", "f2", "n"]).groupBy("group").agg(F.min("least").alias("least_id"), top(sets, "row"))
    return grouped.withColumnRenamed("least_id", "least")


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two rows link when their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` or more; links between equal sets aren't listed pair by pair but through the class.
    A null or empty text has an empty set, links with nothing and is a component by itself.  Rows that
    share an id are documents of their own.  ``component_id`` is the smallest id of the component that
    isn't null, or null if all are.
    """
    sets, named = _grouped(docs, words, percent)
    tops = _tops(sets, named).select(F.col("group").alias("_g"), "least")
    classes = named.join(tops, F.col("group") == F.col("_g")).select("f1", "f2", "n", F.struct("least").alias("group"))
    out = _with_group(sets, classes)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.least")).alias("component_id"))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest id, all columns unchanged.

    Null ids come last; of rows with the same id one stays.  Rows without words all stay.
    """
    sets, named = _grouped(docs, words, percent)
    tops = _tops(sets, named).select(F.col("row").alias("_row"))
    who = lambda tag: F.xxhash64(F.col("doc_id").isNull(), "doc_id", tag)
    kept = sets.join(tops, F.col("row") == F.col("_row")).select(F.col("tag").alias("__mill_tag"), who("tag").alias("__mill_who"))
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~wordless).withColumn("__mill_t", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__mill_w", who("__mill_t"))
    rows = rows.join(kept, (F.col("__mill_t") == F.col("__mill_tag")) & (F.col("__mill_w") == F.col("__mill_who")))
    # rows equal in id and text were kept together: one of them is enough; the exchange is that of the join
    one = Window.partitionBy("__mill_t", "__mill_w").orderBy("__mill_t")
    rows = rows.withColumn("__mill_nth", F.row_number().over(one)).where("__mill_nth = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns).union(docs.where(wordless).select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
