"""N-gram Jaccard join: components of documents whose shingle sets are alike.

The join is a sparse product of the document-by-shingle incidence with its
transpose, computed in blocks and only where size bounds leave room:

1. *Blocks against buckets.* Each input block ships its distinct shingles once
   to hash buckets; a bucket answers which of them occur elsewhere. A document
   linked to another shares at least ``num/den`` of its shingles, so documents
   with fewer shared shingles leave here, with nothing but counts moved back.
   A shingle of every document costs one entry per block, not one per document.
2. *Classes.* Documents with equal sets form one class and are represented once.
3. *The mask.* Shingles are ranked rarest first, by a table of ``RANKS`` counts
   (any order gives the same result; this one keeps common passages out of the
   prefixes). The first ``n - ceil(n*num/den) + 1`` shingles of a set suffice to
   meet any partner, and set sizes, positions and shared counts bound the overlap
   of those that meet. Each posting list first asks for its members against
   one leader (linear, not all pairs).
4. *The product.* A block of the incidence's rows is multiplied with a block of
   its columns at the places of the mask: the entries of the column block are
   looked up in a row's set, and the hits of every pair are added up. Pairs
   below the bound are discarded, the rest are links. A leader with many
   members is dealt out over several blocks.
5. *What is left.* A class and a component that meet in a list and are not
   connected yet are compared block by block (``MEMBER_ENTRIES`` entries of
   the component at a time) on parity bitmaps, whose unequal bits bound the
   overlap from above; what the bitmaps leave is the mask of a second product.
   The smaller component asks the larger one.

Sets and overlaps use 64-bit shingle hashes, classes 128-bit ones. Every pair
of different texts that links is connected in the result; nothing is capped.

Defined cases: null and empty texts and texts without words have no shingles
and are alone; fewer words than n make one shingle; repeated rows are one
class; a null doc_id takes part but is never the smallest, and where no other
is in its component, the component_id is null; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import textscan as ts
from geoloom.llm.components import connected
from geoloom.llm.scratch import Scratch, free_name
from geoloom.llm.skew import attach

SHINGLE, NUM, DEN = 5, 75, 100
#: Incidence entries of an input block and of a hash bucket.
BLOCK_ENTRIES = 1 << 20
#: Incidence entries of a component's classes, of the probes, and of a bin of blocks in the product.
MEMBER_ENTRIES, PROBE_ENTRIES, BIN_ENTRIES = 1 << 17, 1 << 19, 1 << 21
MANY = 0xFFFF
#: Entries, and columns, that a row of the masked product is multiplied with in one task, if it has them; columns at most.
COLUMN_ENTRIES, COLUMNS, MOST_COLUMNS = 1 << 14, 8, 128
#: Counts that rank shingles by how common they are (by the highest bits of the hash).
RANKS = 1 << 16


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of the column."""
    for _, _, data, offsets in ts.slices(column):
        starts, ends, first = ts.spans(data, offsets, ts.NOT_SPACE)
        words = ts.hashes(ts.LOWER[data], starts, ends)
        grams = ts.chained(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ts.chained(words[a:b], b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


_SHIPPED = pa.schema([("g", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("texts", pa.binary())])


#: Bits of the parity bitmap that bounds an overlap: sets that differ in d elements differ in at most d bits.
BITS = 2048


#: Words of the folded bitmap, and words of the full one that each of them stands for.
FOLDED = 4
FOLD = BITS // 64 // FOLDED


def parity_bits(values: np.ndarray) -> np.ndarray:
    """The parity of the number of elements by their highest bits, as 64-bit words."""
    counts = np.bincount((values >> np.uint64(53)).astype(np.int64), minlength=BITS)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _ship(n: int, buckets: int):
    """Blocks of the input: one row per bucket with (low hash bits, document in the block), and one with the block's documents."""

    def block_rows(block: int, ids: list, texts: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], dtype=np.int32)
        h = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        many = ~new
        many[:-1] |= ~new[1:]
        shared = np.bincount(owner[many], minlength=len(sets)).astype(np.int32)
        owner = np.where(many, np.uint16(MANY), owner)[new]
        h = h[new]
        bucket = (h >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, low, owner = bucket[order], h[order].astype(np.uint32), owner[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
        stops = np.append(cuts[1:], len(bucket))[: len(cuts)]
        known = np.array([x if x is not None else np.iinfo(np.int64).min for x in ids], dtype=np.int64)
        g = bucket[cuts].astype(np.int64).tolist() + [-1 - block]
        a = [low[i:j].tobytes() for i, j in zip(cuts, stops, strict=True)] + [sizes.tobytes()]
        b = [owner[i:j].tobytes() for i, j in zip(cuts, stops, strict=True)] + [shared.tobytes()]
        none = [None] * len(cuts)
        keys = b"".join(map(set_key, sets))
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([block] * len(g), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*none, known.tobytes()], pa.binary()), pa.array([*none, keys], pa.binary()), pa.array([*none, np.array(texts, dtype=np.int64).tobytes()], pa.binary())], schema=_SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, sets, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for doc_id, text, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                ids.append(doc_id)
                texts.append(text)
                sets.append(s)
                held += len(s)
                if held >= BLOCK_ENTRIES or len(ids) >= MANY:
                    yield block_rows(block, ids, texts, sets)
                    block, ids, texts, sets, held = block + 1, [], [], [], 0
        if ids:
            yield block_rows(block, ids, texts, sets)

    return run


_ANSWER = pa.schema([("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("texts", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """What a bucket knows: per block, how many shingles of each document occur in other blocks."""
    if table.column("g")[0].as_py() < 0:
        return table.select(_ANSWER.names)
    hashes = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("a")]
    owners = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in table.column("b")])
    which = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), dtype=bool)
    same = h[order][1:] == h[order][:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again &= owners != MANY
    blocks, a, b = [], [], []
    ids = table.column("block").to_pylist()
    at = np.flatnonzero(again)
    bounds = np.searchsorted(which[at], np.arange(len(hashes) + 1))
    for k in range(len(hashes)):
        own, count = np.unique(owners[at[bounds[k] : bounds[k + 1]]], return_counts=True)
        if len(own):
            blocks.append(ids[k])
            a.append(own.tobytes())
            b.append(count.astype(np.int32).tobytes())
    none = [None] * len(blocks)
    return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.array(none, pa.binary()) for _ in range(3))], schema=_ANSWER)


_META = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("key", pa.binary()), ("text_hash", pa.int64())])


def _sum_up(table: pa.Table) -> pa.Table:
    """The documents of a block with the number of their shingles that occur elsewhere."""
    own = next(r for r in table.to_pylist() if r["ids"] is not None)
    n = np.frombuffer(own["a"], dtype=np.int32)
    shared = np.frombuffer(own["b"], dtype=np.int32).copy()
    for a, b, ids in zip(table.column("a"), table.column("b"), table.column("ids"), strict=True):
        if not ids.is_valid:
            shared[np.frombuffer(a.as_buffer(), dtype=np.uint16)] += np.frombuffer(b.as_buffer(), dtype=np.int32)
    doc = np.frombuffer(own["ids"], dtype=np.int64)
    keys = [own["keys"][16 * i : 16 * i + 16] for i in range(len(n))]
    return pa.Table.from_arrays([pa.array(doc, mask=doc == np.iinfo(np.int64).min), pa.array(n), pa.array(np.minimum(shared, n)), pa.array(keys, pa.binary()), pa.array(np.frombuffer(own["texts"], dtype=np.int64))], schema=_META)


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(0).slice(a, 256), n))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity_bits(s) for s in sets], pa.list_(pa.int64()))], ["key", "grams", "bits"])

    return run


def _least_overlap(x: str, y: str, num: int, den: int):
    """The smallest overlap at which sets of these sizes link."""
    return F.ceil(F.lit(num) * (F.col(x) + F.col(y)) / F.lit(num + den))


def _ranked(common: np.ndarray, num: int, den: int):
    """The prefix of every set, rarest shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets, rows, pos = [], [], []
                for i, grams in enumerate(part.column(3)):
                    g = grams.values.to_numpy().view(np.uint64)
                    first = len(g) - -(-num * len(g) // den) + 1
                    sets.append(g[np.lexsort((g, common[g >> np.uint64(48)]))[:first]])
                    rows.append(np.full(len(sets[-1]), i))
                    pos.append(np.arange(len(sets[-1]), dtype=np.int32))
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(own) for k in range(3)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "n", "cap", "pos", "h"])

    return run


def _accumulated(num: int, den: int):
    """One bin of the masked product: the pairs of a row and a column whose added-up overlap reaches the bound."""

    def run(key, columns: pa.Table, rows: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        grams = columns.column("grams").combine_chunks()
        flat, bounds = grams.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(grams.value_lengths().to_numpy()))
        node = columns.column("a").to_numpy()
        asked = columns.column("rows").combine_chunks()
        owner = np.repeat(np.arange(len(node)), asked.value_lengths().to_numpy())
        wanted = asked.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        owner, wanted = owner[order], wanted[order]
        for b, own in zip(rows.column("b").to_pylist(), rows.column("grams"), strict=True):
            row = own.values.to_numpy().view(np.uint64)
            here = owner[np.searchsorted(wanted, b) : np.searchsorted(wanted, b, side="right")]
            sizes = bounds[here + 1] - bounds[here]
            stops = np.cumsum(sizes)
            a = 0
            while a < len(here):  # a block of columns at a time
                z = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + BLOCK_ENTRIES, side="right")))
                entries = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in here[a:z]])
                column = np.repeat(np.arange(z - a), sizes[a:z])
                hit = row[np.minimum(np.searchsorted(row, entries), len(row) - 1)] == entries
                overlap = np.bincount(column[hit], minlength=z - a)
                linked = here[a:z][(num + den) * overlap >= num * (sizes[a:z] + len(row))]
                out_a.append(node[linked])
                out_b.append(np.full(len(linked), b))
                a = z
        none = np.zeros(0, dtype=np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate([none, *out_a])), pa.array(np.concatenate([none, *out_b]))], ["a", "b"])

    return run


def masked_product(mask: DataFrame, nodes: DataFrame, scratch: Scratch, name: str, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs of ``mask`` (a: node, b: row node) that link, by the blocked product of ``nodes`` (node, n, grams)."""
    mask = scratch.keep(mask.join(nodes.select(F.col("node").alias("a"), "n"), "a"), f"{name}-mask")
    pairs, entries = mask.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_row = scratch.keep(mask.groupBy("b").agg(F.count(F.lit(1)).alias("asks"), F.ceil(F.greatest(F.sum("n") / F.greatest(F.lit(COLUMN_ENTRIES), COLUMNS * F.avg("n")), F.count(F.lit(1)) / MOST_COLUMNS)).cast("int").alias("parts")), f"{name}-rows")
    bins = max(16, spark_partitions(nodes), 4 * int(entries // BIN_ENTRIES))
    bin_of = lambda part: F.pmod(F.xxhash64("b", part), F.lit(bins)).cast("int")
    dealt = attach(mask, per_row, "b", "asks", pairs).select("a", "b", bin_of(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).alias("bin"))
    columns = dealt.groupBy("a", "bin").agg(F.collect_list("b").alias("rows")).join(nodes.select(F.col("node").alias("a"), "grams"), "a")
    parts = per_row.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("b", bin_of(F.col("part")).alias("bin")).distinct()
    rows = parts.join(nodes.select(F.col("node").alias("b"), "grams"), "b").select("bin", "b", "grams").toDF("bin", "b", "grams")
    return columns.select("bin", "a", "rows", "grams").toDF("bin", "a", "rows", "grams").groupBy("bin").cogroup(rows.groupBy("bin")).applyInArrow(_accumulated(num, den), "a long, b long")


def _left_open(num: int, den: int):
    """Pairs of a probe and a member of one bin of blocks that sizes, shared counts and bitmaps leave room for."""

    def run(key, probes: pa.Table, members: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        units: list[dict[tuple, list[int]]] = [{}, {}]
        for found, table in zip(units, (members, probes), strict=True):
            for i, unit in enumerate(zip(*(table.column(c).to_pylist() for c in ("c", "block", "part")), strict=True)):
                found.setdefault(unit, []).append(i)
        node, cap, n = ([t.column(c).to_numpy() for t in (members, probes)] for c in ("node", "cap", "n"))
        bits = [t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64) for t in (members, probes)]
        for unit, rows in units[1].items():
            own = np.array(units[0].get(unit, []), dtype=np.int64)
            for i in rows if len(own) else ():
                total = n[0][own].astype(np.int64) + int(n[1][i])
                least = -(-num * total // (num + den))
                unequal = np.bitwise_count(bits[0][own] ^ bits[1][i]).sum(axis=1, dtype=np.int64)
                fit = (np.minimum(cap[0][own], cap[1][i]) >= least) & (total - unequal >= 2 * least)
                for j in own[fit]:
                    out_a.append(int(node[1][i]))
                    out_b.append(int(node[0][j]))
        return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def component_rows(documents: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and xxhash64 of the text."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, int(size // 7 // BLOCK_ENTRIES) + 1)
    shipped = docs.mapInArrow(_ship(n, buckets), "g long, block long, a binary, b binary, ids binary, keys binary, texts binary")
    answers = shipped.groupBy("g").applyInArrow(_answer, "block long, a binary, b binary, ids binary, keys binary, texts binary")
    meta = scratch.keep(answers.groupBy("block").applyInArrow(_sum_up, "doc_id long, n int, shared int, key binary, text_hash long"), "meta")

    classes = meta.filter(f"n > 0 and shared * {den} >= n * {num}").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("shared").alias("cap"), F.min("n").alias("n"))
    reps = classes.select("rep").distinct()
    texts = docs.join(reps.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = texts.mapInArrow(_set_rows(n), "key binary, grams array<long>, bits array<long>").groupBy("key").agg(F.first("grams").alias("grams"), F.first("bits").alias("bits"))
    nodes = scratch.keep(classes.select("key", "cap", "n").join(sets, "key").withColumn("node", F.monotonically_increasing_id()), "nodes")

    common = np.zeros(RANKS, dtype=np.int64)
    for r in nodes.select(F.explode("grams").alias("h")).groupBy(F.expr("shiftrightunsigned(h, 48)").alias("rank")).count().collect():  # RANKS rows at most
        common[r["rank"]] = r["count"]
    postings = scratch.keep(nodes.select("node", "n", "cap", "grams").mapInArrow(_ranked(common, num, den), "node long, n int, cap int, pos int, h long"), "postings")
    lead = F.max(F.struct((F.col("cap") / F.col("n")).alias("central"), F.col("n"), F.col("node"), F.col("cap"), F.col("pos"))).alias("lead")
    lists = scratch.keep(postings.groupBy("h").agg(F.count(F.lit(1)).alias("df"), lead).filter("df > 1"), "lists")
    listed = scratch.keep(attach(postings, lists, "h", "df", postings.count(), "inner").drop("df"), "listed")

    met = listed.select("node", "n", "cap", "pos", *(F.col(f"lead.{c}").alias(f"l_{c}") for c in ("node", "n", "cap", "pos"))).filter("node <> l_node")
    least = _least_overlap("n", "l_n", num, den)
    room = (F.least("cap", "l_cap") >= least) & (F.least(F.col("n") - F.col("pos"), F.col("l_n") - F.col("l_pos")) >= least)
    stars = met.filter(room).select(F.col("node").alias("a"), F.col("l_node").alias("b")).distinct()
    links = scratch.keep(masked_product(stars, nodes, scratch, "stars", num, den), "links")
    labels = connected(links, scratch, "cc-stars")

    # What a member of a list can still overlap with another one there, whatever comes later in the order.
    reach = F.least("cap", F.col("n") - F.col("pos"))
    known = scratch.keep(listed.select("node", "h", "n", reach.alias("reach")).join(labels, "node", "left").select("node", "h", "n", "reach", F.coalesce("label", "node").alias("label")), "known")
    comps = scratch.keep(nodes.select("node", "cap", "n").join(labels, "node", "left").select("node", "cap", "n", F.coalesce("label", "node").alias("c")), "comps")
    sizes = scratch.keep(comps.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("entries")), "sizes")
    total = comps.count()
    open_lists = known.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h")
    # In the lists the bitmap is folded to four words: parities add up, and unequal bits can only become fewer.
    fold = lambda k: F.aggregate(F.slice("bits", F.lit(k * FOLD + 1), F.lit(FOLD)), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    bits = nodes.select("node", F.array(*(fold(k) for k in range(FOLDED))).alias("bits"))
    sized = scratch.keep(attach(known.join(open_lists, "h"), sizes.withColumnRenamed("c", "label"), "label", "size", total).join(bits, "node"), "meets")
    present = sized.groupBy("h", "label", "size", "entries").agg(F.max("reach").alias("c_reach"), F.min("n").alias("c_low"), F.max("n").alias("c_high"), F.min(F.when(F.col("size") == 1, F.col("bits"))).alias("c_bits"))
    present = present.select("h", F.col("label").alias("c"), F.col("size").alias("c_size"), F.col("entries").alias("c_entries"), "c_reach", "c_low", "c_high", "c_bits")
    # A partner's size is at least num/den of the probe's, and at most the inverse of it.
    asks = sized.join(present, "h").withColumn("c_low", F.greatest("c_low", F.ceil(F.lit(num) * F.col("n") / F.lit(den))))
    able = (F.least("reach", "c_reach") >= _least_overlap("n", "c_low", num, den)) & (F.col("c_low") <= F.col("c_high"))
    # Against a single class the bitmaps bound the overlap: unequal bits are elements of one set only.
    unequal = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("c_bits")[i])) for i in range(FOLDED)), F.lit(0))
    able = able & F.coalesce(F.col("n") + F.col("c_high") - unequal >= 2 * _least_overlap("n", "c_high", num, den), F.lit(True))
    asks = asks.filter(able & F.expr("label <> c and (size, label) < (c_size, c)")).select("node", "n", "c", F.col("c_entries").alias("entries")).distinct()
    blocks = F.ceil(F.col("entries") / MEMBER_ENTRIES).cast("int")
    asks = scratch.keep(asks.select("node", "n", "c", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")), "asks")
    wanted = asks.groupBy("c", "block").agg(F.ceil(F.sum("n") / PROBE_ENTRIES).cast("int").alias("parts"))
    member = attach(comps, sizes, "c", "size", total).select("node", "cap", "n", "c", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    member = member.join(wanted, ["c", "block"]).select("node", "cap", "n", "c", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    probe = asks.join(wanted, ["c", "block"]).select("node", "c", "block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    probe = probe.join(comps.select("node", "cap", "n"), "node")
    bins = max(16, spark_partitions(docs), int((asks.agg(F.sum("n")).first()[0] or 0) // BIN_ENTRIES) * 4)
    bin_of = F.pmod(F.xxhash64("c", "block", "part"), F.lit(bins)).cast("int").alias("bin")
    words = nodes.select("node", "bits")
    probes = probe.join(words, "node").select(bin_of, "c", "block", "part", "node", "cap", "n", "bits")
    members = member.join(words, "node").select(bin_of, "c", "block", "part", "node", "cap", "n", "bits")
    probes, members = probes.toDF(*probes.columns), members.toDF(*members.columns)
    close = scratch.keep(probes.groupBy("bin").cogroup(members.groupBy("bin")).applyInArrow(_left_open(num, den), "a long, b long"), "close")
    more = scratch.keep(masked_product(close, nodes, scratch, "close", num, den), "more")
    if more.limit(1).count():
        labels = connected(links.union(more), scratch, "cc-all")

    # Copies are counted per class first, so that no join sees a class more than once until its result is attached.
    label_of = nodes.select("key", "node").join(labels, "node").select("key", "label")
    rep = meta.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("copies"))
    least = scratch.keep(rep.join(label_of, "key", "left").filter("copies > 1 or label is not null").select("key", "own", "copies", "label"), "classes")
    smallest = least.filter("label is not null").groupBy("label").agg(F.min("own").alias("least"))
    group = scratch.keep(least.join(smallest, "label", "left").select("key", "copies", F.coalesce("least", "own").alias("least"), F.lit(True).alias("grouped")), "groups")
    empty = meta.filter("n = 0").withColumns({"copies": F.lit(None).cast("long"), "least": F.lit(None).cast("long"), "grouped": F.lit(None).cast("boolean")})
    found = attach(meta.filter("n > 0"), group, "key", "copies", meta.count()).unionByName(empty)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("grouped"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")


def jaccard_components(documents: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    return component_rows(documents, scratch, id_col, text_col, n, num, den).drop("text_hash")


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def drop_near_copies(documents: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; all columns stay.

    Documents without words stay. Rows are told apart by doc_id and text: one
    that shares its doc_id with a dropped one stays if its text is in another
    component. Rows that repeat doc_id and component of the document that stays,
    stay with it; a null doc_id gives way to any other. An empty table stays empty.
    """
    gone_id, gone_text = free_name(documents, "gone_id"), free_name(documents, "gone_text")
    found = component_rows(documents, scratch, id_col, text_col)
    gone = scratch.keep(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)).distinct(), "gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(gone_text))
    return documents.join(gone.hint("shuffle_hash"), same, "left_anti")
