"""Source divergence audit by chunk factorization: how differently the sources of a language use its words.

1. Texts are cut at white space into chunks, which repeat far more than texts do. Each task counts the occurrences of each
   chunk per (language, source) group and notes up to `least` documents of each language that have it.
2. Chunks meet by hash. Every globally distinct chunk is tokenized once, and its terms take over its counts and documents.
3. Terms meet by hash. A language keeps the terms that at least `least` of its documents have. Up to `least` different
   documents are enough to tell, and such sets can be merged, so that no row grows with the number of documents, of tasks
   or of spellings of a term.
4. Every group gets a distribution over the kept terms of its language, add-two smoothed and in whole billionths. Blocks
   of kept terms are compared between all sources of the language at once, and sums and first ranks are merged.

Rows of chunks and terms arrive sorted and are merged as they come; a common chunk or term is one partial row per task, never
a group in memory. The driver reads one row per (language, source) group: the result has a row for every pair of them.

Nulls and edge cases: null text, language or source count as ''; a document is a row, so that repeated rows count again and
rows without doc_id count as well; a group without terms takes part with counts of zero; a language that keeps no term has
values of zero; ties go to the smaller item in UTF-8; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of, words_of

#: Words and distinct chunks that are counted together, rows that are merged together, kept terms that are compared together.
WORDS, CHUNKS, ROWS, TERMS = 4_000_000, 500_000, 200_000, 2_000
SCALE = 1_000_000_000
# Fixed value: terms are runs of letters of ASCII, lower-cased, and of bytes of all other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNT = [("g", "<u4"), ("n", "<i8")]
DOC = [("lang", "<u4"), ("doc", "<u8")]


def _packed(rows: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """One binary value per owner 0 to n - 1 with its rows; ``rows`` come sorted by owner."""
    offsets = (np.searchsorted(owner, np.arange(n + 1)) * rows.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a packed column and the owner of each."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    item = np.dtype(kind).itemsize
    rows = np.frombuffer(column.buffers()[2], kind, int(offsets[-1] - offsets[0]) // item, int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, kind)
    return rows, np.repeat(np.arange(len(column)), np.diff(offsets) // item)


def _summed(owner: np.ndarray, counts: np.ndarray):
    """Counts added up by owner and group, sorted."""
    if not len(owner):
        return owner, counts
    many = int(counts["g"].max()) + 1
    both = owner * many + counts["g"]
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    out = np.empty(len(first), COUNT)
    out["g"], out["n"] = both[first] % many, np.add.reduceat(counts["n"][order], first)
    return both[first] // many, out


def _some_docs(owner: np.ndarray, docs: np.ndarray, most: int):
    """Up to ``most`` different documents of each owner and language, sorted."""
    if not len(owner):
        return owner, docs
    both = owner * (int(docs["lang"].max()) + 1) + docs["lang"]
    order = np.lexsort((docs["doc"], both))
    owner, docs, both = owner[order], docs[order], both[order]
    pair = np.concatenate(([True], both[1:] != both[:-1]))
    new = pair.copy()
    new[1:] |= docs["doc"][1:] != docs["doc"][:-1]
    owner, docs, pair = owner[new], docs[new], pair[new]
    at = np.arange(len(owner))
    few = at - np.maximum.accumulate(np.where(pair, at, 0)) < most
    return owner[few], docs[few]


def _batches(names: list[bytes], owner_c, counts, owner_d, docs, name: str):
    """Record batches of one row per name with its packed counts and documents."""
    for a in range(0, len(names), 20_000):
        b = min(a + 20_000, len(names))
        c0, c1 = np.searchsorted(owner_c, [a, b])
        d0, d1 = np.searchsorted(owner_d, [a, b])
        yield pa.RecordBatch.from_arrays([pa.array(names[a:b], pa.binary()), _packed(counts[c0:c1], owner_c[c0:c1] - a, b - a), _packed(docs[d0:d1], owner_d[d0:d1] - a, b - a)], [name, "counts", "docs"])


def _chunks(docs: DataFrame, groups: dict, languages: list[int], least: int) -> DataFrame:
    """chunk, its counts per group, some of its documents per language: a row per task and slice of WORDS words."""
    def of_slice(number, texts, group, first):
        order = np.argsort(group, kind="stable")  # groups are numbered by language: documents of a language stand together
        texts, group = [texts[i] for i in order.tolist()], group[order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        both = np.concatenate(texts).astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), sizes)
        both, times = np.unique(both, return_counts=True)
        chunk, doc = both // len(texts), both % len(texts)
        counts, some = np.empty(len(both), COUNT), np.empty(len(both), DOC)
        counts["g"], counts["n"] = group[doc], times
        some["lang"], some["doc"] = np.array(languages, np.uint32)[group[doc]], first + order[doc].astype(np.uint64)
        yield from _batches(list(number), *_summed(chunk, counts), *_some_docs(chunk, some, least), "chunk")

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 32  # a number for every document, the same if the task is repeated
        number, texts, group, size = {}, [], [], 0
        for b in batches:
            for pair, text in zip(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()), b.column("text").to_pylist()):
                words = words_of(text)
                number.update(zip(set(words).difference(number), count(len(number))))
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                group.append(groups[pair])
                size += len(words)
                if size > WORDS or len(number) > CHUNKS:
                    yield from of_slice(number, texts, np.array(group), np.uint64(row))
                    row += len(texts)
                    number, texts, group, size = {}, [], [], 0
        if texts:
            yield from of_slice(number, texts, np.array(group), np.uint64(row))

    return docs.mapInArrow(run, "chunk binary, counts binary, docs binary")


def _buffered(batches, rows: int):
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _terms(chunks: DataFrame, least: int) -> DataFrame:
    """term, counts, docs from chunks that come sorted: each distinct chunk is tokenized once."""
    def run(batches):
        last = None, []
        for table in _buffered(batches, ROWS):
            chunks = _column(table, "chunk")
            new = np.concatenate(([True], pc.not_equal(chunks[1:], chunks[:-1]).to_numpy(zero_copy_only=False)))
            different = chunks.take(pa.array(np.flatnonzero(new))).to_pylist()
            known = [last[1]] if different[0] == last[0] else []
            found = known + [TERM.findall(c.lower()) for c in different[len(known):]]
            last = different[-1], found[-1]
            flat = list(chain.from_iterable(found))
            names = list(set(flat))
            number = dict(zip(names, count()))
            owner = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            # the terms of each row: those of its chunk, one entry per occurrence in it
            size = np.fromiter(map(len, found), np.int64, len(found))
            rows, at = _spread(np.cumsum(new) - 1, np.repeat(np.arange(len(found)), size), len(found))[::-1]
            owner = owner[at]
            counts, of_c = _unpacked(_column(table, "counts"), COUNT)
            docs, of_d = _unpacked(_column(table, "docs"), DOC)
            at_c, part_c = _spread(rows, of_c, table.num_rows)
            at_d, part_d = _spread(rows, of_d, table.num_rows)
            yield from _batches(names, *_summed(owner[part_c], counts[at_c]), *_some_docs(owner[part_d], docs[at_d], least), "term")

    return chunks.mapInArrow(run, "term binary, counts binary, docs binary")


def _spread(rows: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the packed rows of each of ``rows``, and which of ``rows`` each belongs to."""
    bounds = np.searchsorted(of, np.arange(n + 1))
    start, size = bounds[rows], bounds[rows + 1] - bounds[rows]
    part = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + start[part], part


def _kept(terms: DataFrame, languages: list[int], least: int) -> DataFrame:
    """lang number, term, counts of its groups there, for terms that enough documents of the language have. Terms come sorted."""
    language, many = np.array(languages, np.int64), len(languages) + 1

    def settle(names, owner_c, counts, owner_d, docs):
        kept, size = np.unique(owner_d * many + docs["lang"], return_counts=True)
        kept = kept[size >= least]
        of = owner_c * many + language[counts["g"]]
        at = np.searchsorted(kept, of)
        good = np.append(kept, -1)[at] == of
        at, rows = at[good], counts[good]
        columns = pa.array((kept % many).astype(np.int32)), pa.array([names[i] for i in (kept // many).tolist()], pa.binary()), _packed(rows, at, len(kept))
        return pa.RecordBatch.from_arrays(list(columns), ["lang", "term", "counts"])

    def run(batches):
        carry = None  # the last term may go on in the next rows
        for table in _buffered(batches, ROWS):
            names = _column(table, "term").to_pylist()
            counts, of_c = _unpacked(_column(table, "counts"), COUNT)
            docs, of_d = _unpacked(_column(table, "docs"), DOC)
            number = {}
            for t in ([carry[0]] if carry else []) + names:
                number.setdefault(t, len(number))
            owner = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
            owner_c, owner_d = owner[of_c], owner[of_d]
            if carry:
                owner_c, counts = np.concatenate((np.zeros(len(carry[1]), np.int64), owner_c)), np.concatenate((carry[1], counts))
                owner_d, docs = np.concatenate((np.zeros(len(carry[2]), np.int64), owner_d)), np.concatenate((carry[2], docs))
            owner_c, counts = _summed(owner_c, counts)
            owner_d, docs = _some_docs(owner_d, docs, least)
            end = len(number) - 1
            done_c, done_d = owner_c < end, owner_d < end
            carry = (names[-1], counts[~done_c], docs[~done_d])
            yield settle(list(number), owner_c[done_c], counts[done_c], owner_d[done_d], docs[done_d])
        if carry:
            zero = np.zeros
            yield settle([carry[0]], zero(len(carry[1]), np.int64), carry[1], zero(len(carry[2]), np.int64), carry[2])

    return terms.mapInArrow(run, "lang int, term binary, counts binary")


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10):
    """(groups, lang number of each group, table of kept terms). ``groups`` is the sorted list of (lang, source)."""
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups = sorted(((r.lang, r.source) for r in plain.select("lang", "source").distinct().collect()), key=lambda x: (x[0].encode(), x[1].encode()))
    names = sorted({x for x, _ in groups}, key=str.encode)
    languages = [names.index(x) for x, _ in groups]
    chunks = _chunks(plain, {x: i for i, x in enumerate(groups)}, languages, least)
    terms = _terms(chunks.repartition("chunk").sortWithinPartitions("chunk"), least)
    kept = _kept(terms.repartition("term").sortWithinPartitions("term"), languages, least)
    return groups, languages, materialize(kept, "kept-terms")


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * count / total) without leaving 64 bits (totals below 9e15): three steps of a long division."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + step
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' compares a source with every other one of its language, part 'term' lists
    the ``top`` terms that it uses more than its language does."""
    spark = docs.sparkSession
    groups, languages, kept = kept_terms(docs, text, lang, source, least)
    language, members = np.array(languages, np.int64), {}
    for g, x in enumerate(languages):
        members.setdefault(x, []).append(g)
    totals, sizes = np.zeros(len(groups), np.int64), np.zeros(len(members), np.int64)

    def add_up(batches):
        total, size = np.zeros(len(language), np.int64), np.zeros(len(language), np.int64)
        for b in batches:
            rows, _ = _unpacked(b.column("counts"), COUNT)
            np.add.at(total, rows["g"], rows["n"])
            size += np.bincount(b.column("lang").to_numpy(), minlength=len(language))
        yield batch_of(pa.schema([("k", pa.int32()), ("total", pa.int64()), ("size", pa.int64())]), np.arange(len(language)), total, size)

    for r in kept.mapInArrow(add_up, "k int, total bigint, size bigint").groupBy("k").agg(F.sum("total").alias("total"), F.sum("size").alias("size")).collect():
        totals[r.k] = r.total
        if r.k < len(sizes):
            sizes[r.k] = r["size"]
    below = totals + 2 * sizes[language] if len(groups) else totals  # N + 2 V of each group
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("term", pa.string()), ("value", pa.int64())])

    def compare(batches):
        for table in _buffered(batches, TERMS):
            names, of_lang = _column(table, "term").to_pylist(), np.asarray(_column(table, "lang"))
            rows, owner = _unpacked(_column(table, "counts"), COUNT)
            for x in np.unique(of_lang).tolist():
                mine, here = np.array(members[x]), np.flatnonzero(of_lang == x)
                place = np.full(len(of_lang), -1)
                place[here] = np.arange(len(here))
                sel = place[owner] >= 0
                times = np.zeros((len(here), len(mine)), np.int64)
                times[place[owner[sel]], rows["g"][sel] - mine[0]] = rows["n"][sel]
                p = share(times + 2, below[mine])
                q = share(times.sum(axis=1) + 2, int(totals[mine].sum()) + 2 * int(sizes[x]))
                for i, g in enumerate(mine.tolist()):
                    sums = gap(p[:, i:i + 1], p).sum(axis=0)
                    yield batch_of(schema, np.full(len(mine), g), mine, pa.nulls(len(mine), pa.string()), sums)
                    more = np.flatnonzero((times[:, i] > 0) & (p[:, i] > q))
                    value = gap(p[more, i], q[more])
                    best = sorted(zip((-value).tolist(), [names[here[j]] for j in more.tolist()]))[:top]
                    if best:
                        yield batch_of(schema, [g] * len(best), [-1] * len(best), [t.decode() for _, t in best], [-v for v, _ in best])

    found = materialize(kept.mapInArrow(compare, "a int, b int, term string, value bigint"), "divergence")
    named = spark.createDataFrame([(g, x, *groups[g]) for g, x in enumerate(languages)], "g int, l int, lang string, source string")
    a, b = named.select(F.col("g").alias("a"), "l", "lang", "source"), named.select(F.col("g").alias("b"), "l", F.col("source").alias("item"))
    sums = found.where("b >= 0").groupBy("a", "b").agg(F.sum("value").alias("value"))
    pairs = a.join(b, "l").where("a <> b").join(sums, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    terms = found.where("b < 0").join(a, "a").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))
