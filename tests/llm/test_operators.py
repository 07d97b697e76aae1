"""Every operator of the subpackage against brute force, and on awkward input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import ann, chunk_dedup, components, html_text, license_rules, ngram_join, pack, resample, skew, sp_codec, textscan, toxic_pu, warc
from geoloom.llm.queries import tokenizer_path
from geoloom.llm.scratch import Scratch
from tests.llm import plain

EXTRA = "kept string, n string, key string, label string, u string, h string, part string, score string, chunk string, component_id string"
DOCS = f"doc_id long, text string, lang string, {EXTRA}"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


def thue_morse(n, a="a", b="b"):
    """Words of two letters on which polynomial hashes collide, and their complements."""
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


COLLIDING = [thue_morse(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], schema)


AWKWARD = [
    (None, "no id at all"), (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, LONG.upper()), (6, "A b C d E"), (7, "a B c d e"), (7, "a B c d e"), (8, "Öl ÖL öl"), (9, "öl öl öl"),
    (10, "one two"), (11, "the MIT License and CC BY, see GNU General Public License"), (12, "▁ it's \U0001f600 <|endoftext|> x"), (13, None), (14, ""), (15, "idiot " * 3), (16, "*** !!! ***"),
    *((20 + i, w) for i, w in enumerate(COLLIDING)), *((30 + i, f"a b {w} c d e f") for i, w in enumerate(COLLIDING)), (40, " ".join(COLLIDING)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (1, 1, 0), (2, 1, 0), (6, 1, 0), (6, None, None), (8, 1, 0), (10, 1, 0), (15, 0, 1), (16, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_spans_and_hashes_follow_the_text():
    column = pa.array(["ab  ab", None, "", "xab", "ab"])
    ((a, b, data, offsets),) = textscan.slices(column)
    starts, ends, first = textscan.spans(data, offsets, textscan.NOT_SPACE)
    words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert words == [b"ab", b"ab", b"xab", b"ab"] and first.tolist() == [0, 2, 2, 2, 3, 4]
    h = textscan.hashes(data, starts, ends)
    assert h[0] == h[1] == h[3] != h[2]
    where, which = textscan.distinct(data, starts, ends, np.array([True, False, False, True]))
    assert which[0] == which[3] != which[1] and len(where) == 3 and words[where[which[2]]] == b"xab"


def test_distinct_ranges_are_compared_byte_by_byte(monkeypatch):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 511, 512, 600]))) for _ in range(300)] * 2
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for weak in (False, True):
        if weak:  # every hash collides
            monkeypatch.setattr(textscan, "hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
        where, which = textscan.distinct(data, starts, ends)
        assert [words[i] for i in where[which]] == words and len(where) == len(set(words))


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(textscan, "SLICE_BYTES", 5)
    column = pa.array(["abc", "d" * 20, "", None, "ef"]).slice(1)
    got = [data[offsets[i] : offsets[i + 1]].tobytes() for _, _, data, offsets in textscan.slices(column) for i in range(len(offsets) - 1)]
    assert got == [b"d" * 20, b"", b"", b"ef"]


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark, docs, nothing):
    got = chunk_dedup.exact_groups(docs, Scratch(spark, "t")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == exact_expected([r[:2] for r in AWKWARD])
    assert chunk_dedup.exact_groups(nothing, Scratch(spark, "t")).count() == 0


def test_chunks_are_the_text(spark):
    texts = ["", "abc", LONG, "a, " * 3000, "x" * 10_000, "ä\n. " * 900, "本文は句読点で分かれる。" * 500, "本文" * 4000, hashlib.sha256(b"x").hexdigest() * 200]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk_dedup.chunks(__import__("pyspark").sql.functions.col("t")).alias("c")).collect()
    for r in rows:
        assert "".join(r["c"]) == r["t"] and all(len(c) <= chunk_dedup.MAX_CHUNK for c in r["c"])


def test_chunks_follow_the_content(spark):
    rng = random.Random(5)
    wide = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) + "。" * (rng.random() < 0.05) for _ in range(6000))
    code = "".join(rng.choice("0123456789abcdef") for _ in range(9000))
    F = __import__("pyspark").sql.functions
    for text in (wide, code, LONG[:20_000]):
        a, b = (set(r["c"]) for r in spark.createDataFrame([(text,), ("inserted: " + text,)], "t string").select(chunk_dedup.chunks(F.col("t")).alias("c")).collect())
        assert len(a & b) > 0.6 * len(a)


def test_unsound_chunk_names_do_not_decide(spark, docs):
    F = __import__("pyspark").sql.functions
    got = chunk_dedup.exact_groups(docs, Scratch(spark, "t"), name=lambda c: F.encode(F.length(c).cast("string"), "UTF-8"))
    assert sorted(map(tuple, got.collect()), key=str) == exact_expected([r[:2] for r in AWKWARD])


@pytest.mark.parametrize("hot", [1, 7, 1000])
def test_attach(spark, hot, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", hot)
    rows = spark.createDataFrame([(k, i) for k, n in ((0, 50), (1, 5), (2, 1), (3, 1)) for i in range(n)], "k long, i long")
    facts = spark.createDataFrame([(0, 50, "a"), (1, 5, "b"), (2, 1, "c")], "k long, n long, f string")
    got = sorted((r["k"], r["i"], r["f"]) for r in skew.attach(rows, facts, "k", "n", 57).collect())
    assert got == sorted((r["k"], r["i"], {0: "a", 1: "b", 2: "c"}.get(r["k"])) for r in rows.collect())
    assert skew.attach(rows, facts, "k", "n", 57, "inner").count() == 56


def test_drop_copies_keeps_columns(spark, docs):
    kept = chunk_dedup.drop_copies(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r[0] for r in exact_expected([r[:2] for r in AWKWARD]) if r[3]}


def near_expected(rows, num=75, den=100, n=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def variants(seed=3):
    """Groups of near copies around the threshold, with shared passages and exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = [r[:2] for r in AWKWARD]
    d = 100
    for size in (30, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 18))):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(1, 3)] = [word() for _ in range(rng.randrange(0, 3))]
            rows.append((d, " ".join(own)))
            d += 1
    for _ in range(12):
        rows.append((d, " ".join([word() for _ in range(15)] + passage + [word() for _ in range(rng.randrange(20))])))
        d += 1
    return rows + [(d + i, rows[20 + i][1]) for i in range(6)]


@pytest.mark.parametrize("tiny", [False, True])
def test_jaccard_components(spark, nothing, tiny, monkeypatch):
    if tiny:  # many blocks, buckets, parts and bins
        monkeypatch.setattr(ngram_join, "MEMBER_ENTRIES", 256)
        monkeypatch.setattr(ngram_join, "PROBE_ENTRIES", 512)
        monkeypatch.setattr(ngram_join, "BIN_ENTRIES", 4096)
    rows = variants(5 if tiny else 3)
    got = ngram_join.jaccard_components(frame(spark, rows).repartition(5), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect()), key=str) == near_expected(rows)
    if not tiny:
        assert ngram_join.jaccard_components(nothing, Scratch(spark, "t")).count() == 0


def test_one_shingle_in_every_document(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for d in range(2000):
        if d % 4 == 3:
            own = rows[-1][1].split()[5:]
            own[rng.randrange(len(own))] = word()
        else:
            own = [word() for _ in range(rng.randrange(30, 45))]
        rows.append((d, " ".join(["the", "same", "five", "words", "everywhere", *own])))
    got = ngram_join.jaccard_components(frame(spark, rows).repartition(4), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect())) == sorted(near_expected_by_index(rows))


def near_expected_by_index(rows, n=5):
    """As near_expected, for many short texts that share little."""
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(max(0, i - 3), i):  # copies are made from the row before only
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                label[i] = label[j]
    return [(d, len(sets[i]), label[i]) for i, (d, _) in enumerate(rows)]


def test_drop_near_copies(spark, nothing):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, "quite another text that shares the id of a dropped one"), (1, text + " tail"), (None, text + " end"), (4, ""), (4, ""), (5, None), (6, "a b c d e f")]
    kept = ngram_join.drop_near_copies(frame(spark, rows), Scratch(spark, "t"))
    assert kept.columns == nothing.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([r for r in rows if r not in ((3, text), (None, text + " end"))], key=str)
    assert ngram_join.drop_near_copies(nothing, Scratch(spark, "t")).count() == 0


def test_connected_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected(links, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    pieces = pack.packed_pieces(docs.repartition(3), Scratch(spark, "t"), path).cache()
    got = pack.piece_table(pieces).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.sequence_id * 2048 + got.offset).tolist() == [0, *np.cumsum(got.length)[:-1]]  # gapless, in one stream
    want = {}
    for d, text in [r[:2] for r in AWKWARD]:
        want.setdefault(d, []).append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    for d, own in got.groupby(got.doc_id.fillna(-1)):
        ids = want[None if d == -1 else int(d)]
        assert own.doc_tokens.iloc[0] == len(ids[0]) and own.length.sum() == sum(map(len, ids))
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[0][p.start : p.start + p.length].tobytes())
    whole = pack.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * got.length.sum() and max(len(r["ids"]) for r in whole) == 4 * 2048
    assert pack.packed_pieces(nothing, Scratch(spark, "t"), path).count() == 0


def test_packing_queries_give_the_dealt_tokenizers_ids(spark, tmp_path):
    import corpus_pipeline
    from geoloom.llm import queries
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> it's", "<|endof", "text|>", "<|ENDOFTEXT|>", "plain", "", None, "ä\n<|endoftext|>\n ö", "after"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, x in enumerate(texts)}
    assert 50256 in want[0]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op2_concat_and_cut(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got.collect()} == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in want.items()}


PAGES = f"page_id long, url string, html string, {EXTRA}"
BIG = "<p>" + "payload, " * 60


def write_archives(pages, records_per_file):
    path = Scratch(pages.sparkSession, "t").path("archives")
    warc.write_archives(pages, path, records_per_file)
    return path


def test_warc_index(spark):
    rows = [(3, "http://WWW.b.example/x?b=2&a=1", BIG), (1, "http://a.example/ q", BIG), (2, None, BIG), (4, "", None), (5, "http://a.example/", "tiny"), (6, "http://a.example/", "tiny"), (None, "http://n.example/", BIG + "\r\n\r\nWARC/1.1\r\n"), (7, "h", "ä" * 200), (7, "h", "ä" * 200), (8, "http://a.example:bad/", "\r\n\r\n" * 50)]
    pages = frame(spark, rows, PAGES)
    index = warc.capture_index(pages.repartition(3), Scratch(spark, "t")).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        revisit = len(raw) >= 100 and len([1 for _, _, g in rows if (g or "") == (h or "")]) > 1 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index), key=str) == sorted(want, key=str)
    assert all(r["intact"] for r in index)
    order = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in index]
    assert order == sorted(order)
    many = [(i, f"http://h{i % 7}.example/{i % 3}" if i % 2 else "http://hot.example/", "x" * (i % 5)) for i in range(3000)] + [(9999, "http://big.example/", "big " * 3_000_000)]
    runs = warc.read_runs(spark, str(write_archives(frame(spark, many, PAGES).repartition(4), 300))).cache()
    merged = warc.merged_index(runs, len(many), range_rows=100)
    found = [warc._order(tuple(r)) for r in merged.collect()]
    assert merged.rdd.getNumPartitions() > 8 and len(found) == len(many) and found == sorted(found)
    assert runs.filter("page_id = 9999 and intact and payload_bytes = 12000000").count() == 1
    assert warc.url_key("http://WWW.b.example:80/X/?b=2&a=1") == warc.url_key("https://b.example/x?a=1&b=2") == "example,b)/x?a=1&b=2"
    assert warc.capture_index(frame(spark, [], PAGES), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), n) for n in range(rng.randrange(9))) for _ in range(k)]
    merged = list(warc.LoserTree([iter([(key, (i, n)) for key, n in run]) for i, run in enumerate(runs)]))
    assert [m[0] for m in merged] == sorted(key for run in runs for key, _ in run)


LINE = "This is a rather long paragraph, with commas, and enough words to count as text."
HTML = [
    (None, ""), ("", ""), ("<p>", ""), ("plain text only", "plain text only"), (f"<html><body><p>{LINE}</p>", LINE),
    (f"<nav><a href=x>Menu</a></nav><article><h1>T&amp;T</h1><p><b>{LINE}<br>more<p>x&nbsp;y</article><footer>f</footer>", f"T&T {LINE} more x y"),
    (f"<div class=sidebar>{LINE}</div><div id=content><p>{LINE}</p><ul><li>a<li>b</ul></div><div class='comments'><p>{LINE}</p></div>", f"{LINE} a b"),
    (f"<article><p>{LINE}</p><div class=ad>{LINE}</div><form>name</form><script>var t='</p>';</script><style>p{{}}</style><section id=comments><p>{LINE}</p></section><!-- <p>no</p> --></article>", LINE),
    (f"<header><h1>Site</h1></header><div class=cookie-notice>{LINE}</div><main><header><h1>Head</h1></header><section><p>{LINE}</p></section><section><p>{LINE}</p></section></main>", f"Head {LINE} {LINE}"),
    (f"<article><p>{LINE} <b>bo<i>ld</i></b>er</p><table><tr><td>1<td>2</table></article", f"{LINE} bolder 1 2"),
    ("<article>" + "<div>" * 3000 + LINE, LINE),
]


OTHER = "Some other line that stands beside the text, for sale, and is rather long as well."
PARAGRAPHS, WORDS = f"<p>{LINE}</p>" * 4, " ".join([LINE] * 4)
HTML += [
    (f"<body><form action=x><input name=q><label>Name</label><div class=content><h1>T</h1>{PARAGRAPHS}</div></form>", f"T {WORDS}"),
    (f"<body><form><p>{OTHER}</p><input></form><div class=content>{PARAGRAPHS}</div>", WORDS),
    *((f"<body><nav><a href=x>M</a></nav><div class='{c}'><h1>T</h1>{PARAGRAPHS}<div class=sidebar><p>{OTHER}</p></div></div>", f"T {WORDS}") for c in ("content sidebar-right", "page-with-sidebar", "post comments-open", "article-body alert-free", "col-content related-topics-enabled", "sidebar-right")),
    (f"<div class=post><h1>T</h1><div class=entry>{PARAGRAPHS}</div><div class=entry><p>{LINE}</p></div></div>", f"T {WORDS} {LINE}"),
    (f"<body><div class=wrap><h1>T</h1><div>{PARAGRAPHS}</div><div>{PARAGRAPHS}</div></div><div class='comments'>{PARAGRAPHS}</div>", f"T {WORDS} {WORDS}"),
    (f"<body><div class=wrap><div class=title><h1>T</h1></div><div class=x>{PARAGRAPHS}</div><ul><li><a href=a>Link one more</a><li><a href=b>Link two</a></ul></div>", f"T {WORDS}"),
    (f"<article>{PARAGRAPHS}</article><section id=comments><h3>Comments</h3>{PARAGRAPHS}{PARAGRAPHS}</section>", WORDS),
    (f"<div id=main>{PARAGRAPHS}</div><div id='comments' class='comment-list'>{PARAGRAPHS}{PARAGRAPHS}</div>", WORDS),
    (f"<div class='entry-meta'>By someone, at some time, in some place.</div><div class='entry-content'>{PARAGRAPHS}</div><div class='post-footer share'>{OTHER}</div>", WORDS),
    (f"<div class=ad>{OTHER}</div><article><h1>T</h1><p>Too short.</p></article><footer>{OTHER}</footer>", "T Too short."),
]


@pytest.mark.parametrize(("html", "text"), HTML)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


class Node:
    """An element of a well-formed page for the plain version below."""

    def __init__(self, tag, name="", up=None):
        self.tag, self.name, self.up, self.kids = tag, name, up, []

    def html(self):
        inner = "".join(k if isinstance(k, str) else k.html() for k in self.kids)
        return f"<{self.tag} class='{self.name}'>{inner}</{self.tag}>"

    def nodes(self):
        yield self
        for k in self.kids:
            if not isinstance(k, str):
                yield from k.nodes()

    def lines(self):
        """(element, text, characters in links) of the blocks below, in page order; leaves hold one line or one link."""
        for k in self.kids:
            if not isinstance(k, str):
                yield from k.lines()
            elif self.tag != "a":
                yield self, k, 0
            else:
                yield self.up, k, len(k)


def plain_main_text(body):
    """Tree scoring on a tree of nodes, each figure computed where it is asked for."""
    out_tags, side = ("nav", "footer", "aside"), {"sidebar": 2, "comments": 2, "ad": 2, "": 0, "content": 0, "x-comments": 1}
    within = lambda n, tops: any(n is t or within_one(n, t) for t in tops)
    lines = [x for x in body.lines() if not any(a.tag in out_tags for a in ups(x[0]))]
    prose = lambda n: sum(len(t) for e, t, k in lines if len(t) >= 25 and 2 * k < len(t) and e.tag[0] != "h" and n in ups(e))
    gone = []
    for n in body.nodes():
        if n is not body and side[n.name] and not (2 * prose(n) > prose(body) and (side[n.name] == 1 or any(e.tag in ("h1", "main") for e in n.nodes()))):
            gone.append(n)
    lines = [x for x in lines if not within(x[0], gone)]
    alive = [n for n in body.nodes() if not within(n, gone)]
    total = lambda n, of: sum(of(x) for x in lines if n in ups(x[0]))
    chars, links = (lambda n: total(n, lambda x: len(x[1]))), (lambda n: total(n, lambda x: x[2]))
    good = lambda n: total(n, lambda x: len(x[1]) if x[0].tag not in ("h1", "h2", "li") and ((len(x[1]) > 80 and x[2] < 0.25 * len(x[1])) or (not x[2] and x[1][-1] in ".!?")) else 0)

    def points(n):
        found = 0.0
        for e, t, _ in lines:
            if len(t) >= 25 and e.tag[0] != "h":
                c = e if e.tag in ("div", "section", "article") else e.up
                if n in ups(c):
                    found += (1 + t.count(",") + min(len(t) // 100, 3)) / 2 ** ups(c).index(n)
        bonus = {"article": 25, "div": 2, "section": 3, "ul": -3, "li": -3}.get(n.tag, 0) + 5 * (n.name == "content")
        return (found + bonus) * (1 - links(n) / max(chars(n), 1)) if found else 0.0

    if not lines:
        return ""
    best = max(alive, key=lambda n: (points(n), -alive.index(n)))
    best = next((a for a in ups(best) if a.tag == "article"), best)
    if points(best) <= 0:
        best = body
    keep = [best]
    for inner in ups(best)[:-1]:
        outer, heads, seen = inner.up, [], False
        strict = outer is body or inner.tag == "article"
        for k in outer.kids:
            if isinstance(k, str) or k not in alive or not chars(k):
                continue
            if k is inner:
                keep, heads, seen = keep + heads, [], True
                continue
            dense = links(k) >= 0.25 * chars(k)
            if k.tag in ("h1", "h2"):
                heads += [] if dense else [k]
                continue
            joins = points(k) >= max(10.0, 0.2 * points(best))
            if k.tag == "p":
                joins = joins or good(k) > 0
            elif k.tag == "ul":
                joins = joins or (not strict and not dense and chars(k) >= 25)
            else:
                enough = 80 if not strict or k.name == "content" else max(80, good(inner) // 5)
                title = not seen and not strict and all(e.tag in ("h1", "h2", "div", "section") for e in list(k.nodes())[1:]) and any(e.tag in ("h1", "h2") for e in k.nodes())
                joins = joins or (not dense if title else not dense and good(k) >= enough)
            if joins:
                keep += [*heads, k]
            heads = heads if not seen else []
    return " ".join(t for e, t, _ in lines if any(a in keep for a in ups(e)))


def ups(n):
    """An element and those around it, from the inside out."""
    out = []
    while n is not None:
        out.append(n)
        n = n.up
    return out


def within_one(n, top):
    return top in ups(n)


@pytest.mark.parametrize("seed", range(60))
def test_main_text_against_a_plain_version(seed):
    rng = random.Random(seed)
    body = Node("body")

    def line():
        words = [rng.choice(["moss", "lantern,", "winter", "stone,", "paper", "a", "of"]) for _ in range(rng.choice([2, 4, 8, 20, 60]))]
        return " ".join(words).rstrip(",") + rng.choice([".", "", "!"])

    def grow(n, depth):
        for _ in range(rng.randrange(1, 5)):
            tag = rng.choice(["p", "p", "p", "div", "div", "section", "h1", "h2", "ul", "nav", "footer", "article", "aside"] if depth < 4 else ["p", "h2"])
            k = Node(tag, rng.choice(["", "", "", "content", "sidebar", "comments", "ad", "x-comments"]) if tag in ("div", "section") else "", n)
            n.kids.append(k)
            if tag in ("div", "section", "article", "nav", "aside"):
                grow(k, depth + 1)
            elif tag == "ul":
                for _ in range(rng.randrange(1, 4)):
                    li = Node("li", "", k)
                    k.kids.append(li)
                    if rng.random() < 0.5:
                        a = Node("a", "", li)
                        a.kids.append(line())
                        li.kids.append(a)
                    else:
                        li.kids.append(line())
            else:
                k.kids.append(line())

    grow(body, 0)
    assert html_text.main_text(body.html()) == plain_main_text(body)


@pytest.mark.parametrize("html", ["<div>" * 400_000, "<p><b>" * 150_000, "<div><a href=x>l</a><p>t</p>" * 50_000, "<div><h1>x</h1></div>" * 50_000, "<p class='ad x'>" + "long text, " * 200_000, "<span class=a>" * 150_000])
def test_main_text_of_very_long_pages_takes_time_in_proportion(html):
    import time

    took = []
    for part in (html[: len(html) // 2], html):
        began = time.process_time()
        html_text.main_text("<article>" + part + LINE)
        took.append(time.process_time() - began)
    assert took[1] < 5 and took[1] < 4 * took[0] + 1


def test_extract_rows(spark):
    rows = [(i if i else None, f"u{i}", h) for i, (h, _) in enumerate(HTML)] + [(1, "u1", "")]
    got = html_text.extract(frame(spark, rows, PAGES)).collect()
    assert sorted((r["url"], r["text"], r["n_chars"]) for r in got) == sorted((f"u{i}", t, len(t)) for i, t in [*enumerate(t for _, t in HTML), (1, "")])
    assert html_text.extract(frame(spark, [], PAGES)).count() == 0


def test_license_base_and_rules(spark, docs, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in license_rules.scan(docs).collect()}
    for d, t in [r[:2] for r in AWKWARD]:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
        places, found = [], set()
        for phrase, label in license_rules.BASE:
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            found |= {label} if at else set()
        r = got[d, len(words)]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))
        assert found <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_rules.scan(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [("GNU General Public License, version 2 or (at your option) any later version", "gpl-2.0-or-later"), ("under Apache-2.0", "apache-2.0"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("BSD 3-Clause License", "bsd-3-clause"), ("SPDX-License-Identifier: MIT", "mit"), ("an ordinary sentence", None)],
)
def test_license_rules(text, label):
    low = text.lower().encode()
    assert {license_rules.rules()[i].label for _, _, i in license_rules.detections(low)} == ({label} if label else set())
    everything = license_rules.resolve([(m.start(), m.end(), i) for i, r in enumerate(license_rules.rules()) for m in r.pattern.finditer(low)])
    assert everything == license_rules.detections(low)  # the keyword filter loses nothing


@pytest.mark.parametrize("gap", [b" ", b"  ", b"\n", b"\n * ", b"\r\n# ", b"\t", b", ", b"-"])
def test_license_keywords_lose_nothing_whatever_stands_between_words(gap):
    for _, text, _, _, _ in (*license_rules.PLAIN, *license_rules.WORDINGS):
        low = gap.join(text.replace("?", "").encode().split())
        everything = license_rules.resolve([(m.start(), m.end(), i) for i, r in enumerate(license_rules.rules()) for m in r.pattern.finditer(low)])
        assert everything and license_rules.detections(low) == everything, text
        data = np.frombuffer(low, dtype=np.uint8)
        ((*_, found),) = license_rules._scan_slice(data, np.array([0, len(data)]))
        assert [(f["start"], f["end"]) for f in found] == [(s, e) for s, e, _ in everything], text


def test_license_rules_are_many_and_ordered():
    assert len(license_rules.rules()) >= 300
    kept = license_rules.resolve([(0, 10, 0), (2, 5, 1), (8, 14, 2)])
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))


VECTORS = "vec_id long, embedding array<float>, part string, rank string, score string"


def brute(rows, k=20, every=20):
    """{query row: [(vec_id, score, row), ...]} of (vec_id, vector) rows of one length."""
    ids, d = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (d * d[q]).sum(1)
        out[q] = [(int(ids[i]), float(score[i]), int(i)) for i in np.lexsort((ids, -score)) if i != q][:k]
    return out


def recall(got, want):
    """Share of the scores that brute force has (equal scores stand for each other), after checks of every row."""
    hit = total = 0
    for (i, best), (_, own) in zip(sorted(want.items()), got.groupby("query_id"), strict=True):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(best) + 1)) and own.vec_id.nunique() == len(own)
        assert own.score.tolist() == sorted(own.score, reverse=True)
        hit += (own.score >= best[-1][1] - 1e-12 * abs(best[-1][1])).sum()
        total += len(best)
    return hit / total


@pytest.mark.parametrize("kind", ["random", "clustered"])
@pytest.mark.parametrize("n", [30, 70, 900, 5000])
def test_nearest_recall(spark, n, kind):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 12)) if kind == "random" else rng.normal(size=(max(2, n // 60), 12))[rng.integers(max(2, n // 60), size=n)] + 0.3 * rng.normal(size=(n, 12))
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    found = recall(ann.nearest(frame(spark, rows, VECTORS.replace("float", "double")), Scratch(spark, "t")).toPandas(), brute(rows))
    print(f"recall of {n} {kind} vectors: {found:.3f}")
    assert found >= 0.9


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(20)]
    rows += [(0, [float(x) for x in rng.normal(size=8)]), (3, rows[3][1]), (40, [1e300] + [0.0] * 7), (60, [5e-324] * 8)]  # repeated ids, doubles beyond floats
    odd = [(200, None), (220, [0.0] * 8), (240, [1.0] * 7 + [None]), (260, [float("nan")] * 8), (280, [float("inf")] * 8), (None, [1.0] * 8)]
    short = [(300, [1.0, 2.0, 3.0]), (301, [3.0, 2.0, 1.0]), (320, [7.0])]
    got = ann.nearest(frame(spark, rows + odd + short, VECTORS.replace("float", "double")), Scratch(spark, "t"), k=30).toPandas()
    want = brute(rows, 30)
    expected = sorted([(rows[q][0], r + 1, i, s) for q, best in want.items() for r, (i, s, _) in enumerate(best)] + [(300, 1, 301, 10.0)])
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False))) == expected  # 320 has no candidate
    assert ann.nearest(frame(spark, [], VECTORS), Scratch(spark, "t")).count() == 0
    few = ann.nearest(frame(spark, [(i, [float(i), 1.0]) for i in range(5)], VECTORS), Scratch(spark, "t"))
    assert few.count() == 4


def test_nearest_with_a_hot_vector_and_two_levels(spark, monkeypatch):
    for name, value in (("CANDIDATES", 300), ("QUERIES", 40), ("SPLIT", 400), ("LEAF", 100)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 16))[rng.integers(30, size=3000)] + 0.4 * rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:1100] = v[100]  # a third of all rows are one vector
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)]
    got = ann.nearest(frame(spark, rows, VECTORS.replace("float", "double")), Scratch(spark, "t")).toPandas()
    assert recall(got, brute(rows)) >= 0.9
    assert set(got[got.query_id == 120].vec_id) == set(range(100, 121)) - {120}


def test_sentencepiece_codec(spark, docs, nothing):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    bits = ["the", "ab", "é", "日", "\n", "\t", "▁", "  ", "     ", " ", "x", "ﬁ", "Ａ", "123", "​", "😀", ".", "!!", "aaaa", "ing"]
    texts = [None, "", " ", " " * 40, LONG[:3000]] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    for text, (ids, _) in zip(texts, sp_codec.encode_column(pa.array(texts), path), strict=True):
        assert ids.tolist() == model.encode(text or "")
        assert sp_codec.decode(ids, path) == (text or "").replace("▁", " ").encode()
    encoded = sp_codec.encode_documents(docs, path, keep_ids=True).cache()
    assert encoded.filter("not round_trip").select("doc_id").collect() == [(12,)]  # it holds U+2581
    back = {(r["doc_id"], r["text"]) for r in sp_codec.decode_documents(encoded, path).collect()}
    assert back == {(d, (t or "").replace("▁", " ")) for d, t in [r[:2] for r in AWKWARD]}
    assert sp_codec.encode_documents(nothing, path).count() == 0


def quality_rows(n=600):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["Tree", "house", "river,", "walks", "over.", "and", "the", "quiet"]) + rng.choice(["", "s"]) for _ in range(rng.randrange(20, 80)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        t = good()
        if bad:
            t = rng.choice([lambda s: s.upper().replace(" ", "!! "), lambda s: s.replace(" ", "*** "), lambda s: " ".join([s.split()[0]] * 60)])(t)
        rows.append((i, t))
        if i % 2:
            continue
        labels.append((i, 0 if bad else 1, 0))
    labels += [(i, 1, 0) for i in range(1, n, 8) if i % 6]
    return rows, labels


def test_importance_resampling(spark):
    rows, labelled = quality_rows()
    docs = frame(spark, rows)
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = resample.importance_resample(docs, labels, Scratch(spark, "t")).toPandas()
    assert len(got) == len(rows)
    bad = got.doc_id % 6 == 0
    assert got[bad].selected.mean() < 0.05 and got[~bad].selected.mean() > 0.97
    assert (got.selected == (got.gumbel_key >= got[got.selected].gumbel_key.min())).all()
    kept = resample.drop_unselected(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got[got.selected].doc_id)
    again = resample.importance_resample(docs.repartition(7), labels, Scratch(spark, "t")).toPandas().set_index("doc_id")
    assert again.selected.equals(again.join(got.set_index("doc_id"), rsuffix="_b").selected_b.reindex(again.index))


def test_resampling_against_a_plain_version(spark):
    rows, labelled = quality_rows(260)
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \n", COLLIDING[0], COLLIDING[1], "Word word WORD Word 12 12a !! !!", "öl Öl 日本", LONG[:9000]])]
    docs = frame(spark, rows).repartition(3)
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    want = plain.quality_keys(docs, labels)
    got = {r["doc_id"]: r for r in resample.importance_resample(docs, labels, Scratch(spark, "t")).collect()}
    assert got.keys() == want.keys()
    for d, (weight, key, selected) in want.items():
        assert math.isclose(got[d]["log_weight"], weight, abs_tol=1e-6) and math.isclose(got[d]["gumbel_key"], key, abs_tol=1e-6)
        assert got[d]["selected"] == selected


def test_resampling_bounds_are_parameters(spark):
    rows, labelled = quality_rows(240)
    docs, labels = frame(spark, rows), spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    fit = lambda **bounds: resample.fit_and_key(docs, labels, Scratch(spark, "t"), **bounds)
    whole, same, few = fit(), fit(max_target=240, max_calibration=240), fit(max_target=20)
    assert np.array_equal(whole[1].ratio, same[1].ratio) and whole[2] == same[2]
    assert not np.array_equal(whole[1].ratio, few[1].ratio)
    assert fit(max_calibration=0)[2] == float("-inf")


def test_resampling_awkward(spark, docs, nothing, labels):
    got = resample.importance_resample(docs, labels, Scratch(spark, "t")).collect()
    assert len(got) == len(AWKWARD)
    assert {r["log_weight"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert resample.importance_resample(docs, labels.limit(0), Scratch(spark, "t")).filter("selected").count() == len(AWKWARD)
    assert resample.importance_resample(nothing, labels, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(x) for x in range(300)], [1e-300, 5e-324, 1.0, 1.0, 1.0], [-3.5, 7.25, 7.25, 1e9]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k double")
    for k in {1, len(values) // 2 or 1, len(values) - 1 or 1}:
        got = resample.kth_largest(df, "k", k)
        assert got == float("-inf") if len(values) <= k else got == sorted(values, reverse=True)[k - 1]


def toxic_rows(n=900):
    rng = random.Random(8)
    plain = ["moss", "lantern", "gather", "winter", "stone", "paper", "orchard", "violet", "harbor", "candle", "meadow", "silver"]
    bad = ["grumble", "snarlok", "vexling"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randrange(5, 120))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "a", "ish"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labelled = toxic_rows()
    docs, labels = frame(spark, rows), spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = toxic_pu.toxicity(docs, labels, Scratch(spark, "t")).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    held = got[got.held_out]
    truth = held.index % 8 == 0
    assert (held.predicted[truth] == 1).mean() > 0.9 and (held.predicted[~truth] == 1).mean() < 0.03
    kept = toxic_pu.drop_toxic(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got[got.predicted == 0].index)
    # Labels of held-out rows are never looked at.
    flipped = spark.createDataFrame([(i, q, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, q, x in labelled], "doc_id long, quality int, toxic int")
    assert toxic_pu.toxicity(docs, flipped, Scratch(spark, "t")).toPandas().set_index("doc_id").score.round(9).equals(got.score.round(9))


@pytest.mark.parametrize("seed", [0, 1])
def test_toxicity_against_a_plain_version(spark, seed):
    rows, labelled = toxic_rows(240)
    rng = random.Random(seed)
    rows = [(i, f"{t} rare{i // 16}x" + f" pair{i // 16}z" * (i % 8 == 0)) for i, t in rows]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "*** !!!", COLLIDING[0], COLLIDING[1], "x " + COLLIDING[4], LONG, "Snarlok GRUMBLE", "öl Öl"])]
    rng.shuffle(rows)
    docs = frame(spark, rows).repartition(3)
    labels = spark.createDataFrame([(i, q, x) for i, q, x in labelled if rng.random() < 0.7], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxic_pu.toxicity(docs, labels, Scratch(spark, "t")).collect()}
    want = plain.toxic_scores(docs, labels)
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in want) < 2e-3


def test_class_prior_without_negatives():
    rng = np.random.default_rng(3)
    for prior in (0.02, 0.1, 0.4):
        u = np.where(rng.random(20_000) < prior, rng.normal(3, 1, 20_000), rng.normal(-3, 1, 20_000))
        assert abs(toxic_pu.class_prior(rng.normal(3, 1, 4000), u, 0.001) - prior) < 0.02
    assert toxic_pu.class_prior(np.zeros(5), np.zeros(50), 0.1) == 0.9  # nothing tells them apart


def test_labels_of_clean_texts_are_never_used(spark):
    rows, labelled = toxic_rows(160)
    docs = frame(spark, rows)
    score = lambda own: toxic_pu.toxicity(docs, spark.createDataFrame(own, "doc_id long, quality int, toxic int"), Scratch(spark, "t")).toPandas().set_index("doc_id").score.round(9)
    assert score(labelled).equals(score([x for x in labelled if x[2]]))


def test_toxicity_awkward(spark, docs, nothing, labels):
    got = toxic_pu.toxicity(docs, labels, Scratch(spark, "t")).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in toxic_pu.toxicity(docs, labels.limit(0), Scratch(spark, "t")).collect())
    assert toxic_pu.toxicity(nothing, labels, Scratch(spark, "t")).count() == 0


def test_nn_pu_risk_separates():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, (300, 2)), rng.normal(-2, 1, (900, 2))
    u = np.vstack([rng.normal(2, 1, (100, 2)), n])
    w, b = toxic_pu.nn_pu_fit(p, u, 0.1)
    assert ((p @ w + b) > 0).mean() > 0.9 and ((n @ w + b) > 0).mean() < 0.05
