"""SentencePiece encoding and decoding with a Viterbi search shared between words.

Text is cut into marked words (a run of blanks, as U+2581, and what follows).
The distinct words of a slice that a worker has not met are sorted, which
lays them out as a trie in depth-first order, and the forward table of a word
is kept up to the prefix that the next word shares, so every trie edge is
scored once.

The model is a byte-pair model, whose result is not the segmentation of the
highest score sum, so a plain Viterbi over piece scores would differ from it. The
lattice is therefore constrained: a piece may follow another only if the two
strings merged together come out as just these two pieces. A prefix then has one
admissible last piece, the forward score is that of the model's own result,
and the result equals the model's for every word.

Characters outside the vocabulary become byte pieces. Decoding joins the pieces,
bytes as bytes, and drops the blank that encoding put in front.

Defined cases: null and empty texts have no ids; U+2581 in a text counts as a blank,
as for the model, so such a text does not come back and its ``round_trip`` is false; repeated rows give repeated results; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import textscan as ts
from geoloom.llm.pack import Memo

MARK = "▁"
#: Pairs of pieces whose verdict is remembered before the table starts anew.
PAIRS = 1 << 21
_STATE: dict = {}


class Vocabulary:
    """Pieces and scores of a model file, and the verdicts on pairs of pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.id[piece], self.score[piece] = i, model.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode("utf-8"))
        lengths: dict[str, set[int]] = {}
        for piece in self.id:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        #: By its last three characters, how long a piece of so many can be, longest first.
        self.lengths = {end: sorted(found, reverse=True) for end, found in lengths.items()}
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.verdict: dict[tuple[str, str], bool] = {}
        self.reachable: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by merging its best pair again and again (the leftmost on ties)."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        found = self.reachable.get(piece)
        if found is None:
            found = self.reachable[piece] = self.merged(piece) == [piece]
        return found

    def follows(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.verdict.get(key)
        if found is None:
            if len(self.verdict) >= PAIRS:
                self.verdict.clear()
            found = self.verdict[key] = self.merged(left + right) == [left, right]
        return found

    def piece_ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        return [found] if found is not None else [self.byte[b] for b in piece.encode("utf-8")]


def shared_viterbi(vocabulary: Vocabulary, words: list[str]) -> list[list[int]]:
    """Ids of distinct words, found in one depth-first walk of their trie.

    Pieces that may end a prefix are tried from the longest down; the first that
    may follow what stands before it is the only one that may.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list[list[int]] = [[] for _ in words]
    score_of, lengths_of, verdict_of, reachable = vocabulary.score.get, vocabulary.lengths.get, vocabulary.verdict.get, vocabulary.reachable.get
    follows, whole, unknown, id_of = vocabulary.follows, vocabulary.whole, vocabulary.unknown, vocabulary.id.get
    # Forward table by prefix length: score, last piece, where it begins.
    forward, last, back = [0.0], [""], [0]
    before = ""
    for k in order:
        word = words[k]
        shared, most = 0, min(len(word), len(before))
        if word[:most] == before[:most]:
            shared = most
        else:
            while word[shared] == before[shared]:
                shared += 1
        del forward[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
        for i in range(shared + 1, len(word) + 1):
            best, piece, start = -np.inf, "", -1
            for n in (*lengths_of(word[i - 3 : i], ()), 2, 1) if i > 2 else (2, 1) if i > 1 else (1,):
                j = i - n
                if j < 0:
                    continue
                p = word[j:i]
                s = score_of(p)
                if s is None:
                    if n > 1:
                        continue
                    best, piece, start = forward[j] + unknown, p, j
                    break
                fit = reachable(p)
                if fit is None:
                    fit = whole(p)
                if fit and j:
                    fit = verdict_of((last[j], p))
                    if fit is None:
                        fit = follows(last[j], p)
                if fit:
                    best, piece, start = forward[j] + s, p, j
                    break
            forward.append(best)
            last.append(piece)
            back.append(start)
        i, ids = len(word), out[k]
        while i > 0:
            p = last[i]
            found = id_of(p)
            if found is not None:
                ids.append(found)
            else:
                ids.extend(reversed(vocabulary.piece_ids(p)))
            i = back[i]
        ids.reverse()
        before = word
    return out


def _vocabulary(path: str) -> tuple[Vocabulary, Memo]:
    if _STATE.get("path") != path:
        v = Vocabulary(path)
        _STATE.update(path=path, vocabulary=v, memo=Memo(lambda words: shared_viterbi(v, [w.decode("utf-8") for w in words])))
    return _STATE["vocabulary"], _STATE["memo"]


def _unmarked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice with U+2581 as blanks."""
    raw = data.tobytes()
    mark = MARK.encode("utf-8")
    if mark not in raw:
        return data, offsets
    texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))


def _distinct_slots(memo: Memo, words: list[bytes]) -> np.ndarray:
    """Slots of words that may repeat (an opening word can look like one after a blank)."""
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64)
    return memo.slots(list(place))[which]


def encode_column(column: pa.Array, path: str) -> Iterator[tuple[np.ndarray, bytes]]:
    """(ids, the text's own bytes) of every text of the column."""
    _, memo = _vocabulary(path)
    for _, _, given, given_offsets in ts.slices(column):
        data, offsets = _unmarked(given, given_offsets)
        if not len(data):
            yield from ((np.zeros(0, dtype=np.uint32), b"") for _ in offsets[1:])
            continue
        start = np.zeros(len(data) + 1, dtype=bool)
        blank = data == 32
        start[1:-1] = blank[1:] & ~blank[:-1]
        first_of_doc = np.zeros(len(data) + 1, dtype=bool)
        first_of_doc[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        at = np.flatnonzero(start | first_of_doc)
        ends = np.append(at[1:], len(data))
        opening = first_of_doc[at]
        where, which = ts.distinct(data, at, ends, opening)
        raw, mark = data.tobytes(), MARK.encode("utf-8")
        words = [mark * bool(first) + raw[a:b].replace(b" ", mark) for first, a, b in zip(opening[where].tolist(), at[where].tolist(), ends[where].tolist(), strict=True)]
        flat, stops = memo.gather(_distinct_slots(memo, words)[which])
        own = given.tobytes()
        cut = np.append(0, stops)[np.searchsorted(at, offsets)]
        for d in range(len(offsets) - 1):
            yield flat[cut[d] : cut[d + 1]], own[given_offsets[d] : given_offsets[d + 1]]


def decode(ids: np.ndarray | list[int], path: str) -> bytes:
    """UTF-8 of the text that the ids stand for."""
    raw = _vocabulary(path)[0].raw
    joined = b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
    return joined[1:] if joined[:1] == b" " else joined


def _run(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = encode_column(batch.column(1), path)
            for a in range(0, batch.num_rows, 512):
                rows = [next(found) for _ in range(min(512, batch.num_rows - a))]
                le = [ids.astype("<u4").tobytes() for ids, _ in rows]
                columns = [
                    batch.column(0).slice(a, len(rows)).cast(pa.int64()), pa.array([len(ids) for ids, _ in rows], pa.int64()), pa.array([zlib.crc32(x) for x in le], pa.int64()),
                    pa.array([decode(ids, path) == text for ids, text in rows], pa.bool_()),
                ]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if keep_ids:
                    columns.append(pa.array(le, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(documents: DataFrame, model: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian uint32), round_trip (decoding gives the text back), and the ids where asked for."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(model, keep_ids), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids binary" * keep_ids)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with ``ids`` as ``encode_documents`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.frombuffer(x.as_buffer(), dtype="<u4"), model).decode("utf-8", "replace") if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
