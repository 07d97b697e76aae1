"""Packing by concatenate and cut.

Pass one tokenises every document, appends the end id, and keeps a running
total inside each partition; the partition totals alone are then summed, so
that each document gets its global offset without any ordering shuffle. Pass
two cuts the global id stream into fixed windows: a document that spans window
borders gives one boundary record per window, so only the last window of all
can be short.

Whole documents are tokenised. Pre-tokens are found by vectorised byte scans,
each distinct pre-token is encoded once per worker by the tokenizer, and
documents with a construct outside the scan's rules go to the tokenizer as
they are; the ids are those of the tokenizer in every case. With ``special``,
as the queries have it, that is the tokenizer as it is dealt: a document that
holds the text of an added token (<|endoftext|>) goes to it whole and gets that
token's id. Without, such text is encoded like any other.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed as often as they occur; a null doc_id is kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import textscan as ts
from geoloom.llm.scratch import Scratch

WINDOW, END_ID = 2048, 1
#: Distinct pre-tokens, bytes of them, and ids that a worker remembers before it starts anew.
MEMO, MEMO_BYTES, MEMO_IDS = 1 << 20, 1 << 25, 1 << 24
_STATE: dict = {}


def _classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 other, as the pre-tokenizer's pattern sees them."""
    if "classes" not in _STATE:
        import regex

        out = np.zeros(0x110000, dtype=np.uint8)
        everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, everything):
                out[[ord(m.group()[0])]] = k
                out[np.frombuffer(m.group().encode("utf-32-le"), dtype=np.uint32)] = k
        _STATE["classes"] = out
    return _STATE["classes"]


def pretokens(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offset of every pre-token's start and the total, the first of each document, and whether a document needs the tokenizer itself.

    The rules are those of the byte-level pattern: a run of letters, of
    numbers or of other signs with one blank before it, or white space, whose
    last blank goes to a following run. A clitic apostrophe (a run of other
    signs that begins with ' before a letter) and the text of an ``added`` token
    are left to the tokenizer.
    """
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = _classes()[cp]
    n = len(cp)
    first_cp = np.searchsorted(at, offsets)
    edge = np.zeros(n + 1, dtype=bool)
    edge[first_cp] = True
    edge[0] = True
    before = np.empty(n, dtype=np.uint8)
    before[0] = 9
    before[1:] = kind[:-1]
    fresh = (kind != before) | edge[:-1]
    after_fresh = np.append(fresh[1:], True)
    end_of_doc = edge[1:]
    # A white-space run before something splits off its last character; a blank then joins what follows.
    last_space = (kind == 3) & after_fresh & ~end_of_doc
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (last_space & (cp == 32))[:-1]
    start = (fresh & ~joined) | last_space
    odd = fresh & ~joined & (kind == 0) & (cp == 39)
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = (kind[1:] == 1) & ~edge[1:-1]
    special = np.flatnonzero(odd & follows)
    slow = np.zeros(len(offsets) - 1, dtype=bool)
    if len(special):
        slow[np.searchsorted(first_cp, special, side="right") - 1] = True
    for token in added:
        hit = raw.find(token)
        while hit >= 0:
            d = int(np.searchsorted(offsets, hit, side="right")) - 1
            slow[d] = True
            hit = raw.find(token, int(offsets[d + 1]))
    idx = np.flatnonzero(start)
    return np.append(at[idx], len(data)), np.searchsorted(idx, first_cp), slow


def _tokenizer(path: str, special: bool):
    if _STATE.get("path") != (path, special):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not special
        added = tuple(x.content.encode() for x in t.get_added_tokens_decoder().values() if special or not x.special)
        _STATE.update(path=(path, special), tokenizer=t, added=added)
    return _STATE["tokenizer"]


def _encode(path: str, texts: list[str], special: bool) -> list[list[int]]:
    return [e.ids for e in _tokenizer(path, special).encode_batch(texts, add_special_tokens=False)]


class Memo:
    """Ids of distinct words (bytes) as one ragged array; ``encode`` is asked for new ones."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable[Sequence[int]]], words: int = MEMO, held: int = MEMO_BYTES, ids: int = MEMO_IDS):
        self.encode, self.most = encode, (words, held, ids)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self.n = self.used = self.held = 0

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Slot of each of the words, which are distinct."""
        if self.n and (self.n + len(words) > self.most[0] or self.held > self.most[1] or self.used > self.most[2]):
            self.clear()
        get = self.slot.get
        found = [get(w, -1) for w in words]
        new = [i for i, s in enumerate(found) if s < 0]
        if new:
            for i, ids in zip(new, self.encode([words[i] for i in new]), strict=True):
                while self.n >= len(self.start):
                    self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.resize(self.ids, 2 * len(self.ids))
                self.ids[self.used : self.used + len(ids)] = ids
                self.start[self.n], self.length[self.n] = self.used, len(ids)
                found[i] = self.slot[words[i]] = self.n
                self.n += 1
                self.used += len(ids)
                self.held += len(words[i])
        return np.array(found, dtype=np.int64)

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots one after another, and where each ends."""
        lengths = self.length[slot]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[slot] - (ends - lengths), lengths) + np.arange(total)], ends


def token_ids(column: pa.Array, path: str, special: bool = False) -> Iterator[np.ndarray]:
    """The ids of every text of the column, in order."""
    if _STATE.get("memo_path") != (path, special):
        _STATE.update(memo=Memo(lambda words: _encode(path, [w.decode("utf-8") for w in words], special)), memo_path=(path, special))
    memo: Memo = _STATE["memo"]
    _tokenizer(path, special)
    added = _STATE["added"]
    for _, _, data, offsets in ts.slices(column):
        if not len(data):
            yield from (np.zeros(0, dtype=np.uint32) for _ in offsets[1:])
            continue
        starts, first, slow = pretokens(data, offsets, added)
        where, which = ts.distinct(data, starts[:-1], starts[1:])
        raw = data.tobytes()
        slot = memo.slots([raw[a:b] for a, b in zip(starts[where].tolist(), starts[where + 1].tolist(), strict=True)])[which]
        flat, ends = memo.gather(slot)
        cut = np.append(0, ends)[first]
        for d in range(len(offsets) - 1):
            if slow[d]:
                yield np.array(_encode(path, [raw[offsets[d] : offsets[d + 1]].decode("utf-8")], special)[0], dtype=np.uint32)
            else:
                yield flat[cut[d] : cut[d + 1]]


def _tokenise(path: str, end_id: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            ids_of = token_ids(batch.column(1), path, special)
            for a in range(0, batch.num_rows, 512):
                rows = min(512, batch.num_rows - a)
                ids, local, counts = [], [], []
                for _ in range(rows):
                    x = np.append(next(ids_of), np.uint32(end_id)).astype("<u4")
                    ids.append(x.tobytes())
                    local.append(total)
                    counts.append(len(x))
                    total += len(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows).cast(pa.int64()), pa.array([part] * rows, pa.int32()), pa.array(local, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return run


def packed_pieces(documents: DataFrame, scratch: Scratch, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, from_before, goes_on."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = scratch.keep(docs.mapInArrow(_tokenise(tokenizer, end_id, special), "doc_id long, part int, local long, doc_tokens long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("local") + F.col("doc_tokens")).alias("total"))
    # One row per partition: the second of the two prefix sums.
    bases = totals.selectExpr("part", "sum(total) over (order by part rows between unbounded preceding and 1 preceding) as base")
    g = F.coalesce("base", F.lit(0)) + F.col("local")
    placed = tokens.join(F.broadcast(bases), "part").withColumn("g", g)  # one row of 12 bytes per task of pass one, whatever its input
    w = F.lit(window)
    pieces = placed.select("*", F.explode(F.sequence(F.floor(F.col("g") / w), F.floor((F.col("g") + F.col("doc_tokens") - 1) / w))).alias("sequence_id"))
    start = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * w - F.col("g"))
    stop = F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * w - F.col("g"))
    pieces = pieces.withColumn("start", start).withColumn("length", stop - start)
    return pieces.select(
        "doc_id", "start", "length", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"), "doc_tokens", "sequence_id",
        (F.col("g") + F.col("start") - F.col("sequence_id") * w).alias("offset"), (F.col("start") > 0).alias("from_before"), (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("goes_on"),
    )


def piece_table(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "from_before", "goes_on")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids as one binary, pieces in order of offset."""
    return pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.aggregate(F.col("p.ids"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))
