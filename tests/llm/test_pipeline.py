"""The pipeline against a version that loops over Python lists."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm.queries import table, tokenizer_path
from geoloom.llm.scratch import Scratch
from tests.llm import plain


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


@pytest.fixture(scope="module")
def stages(spark, small):
    """The documents after every stage."""
    kept, docs, out = Scratch(spark, "t"), table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = kept.keep(stage(spark, docs, small), name)
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(spark, small, stages):
    want = table(spark, small, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    assert all(s.columns == want for s in stages[:-1])


def test_toxicity_stage(spark, small, stages):
    want = plain.toxic_scores(table(spark, small, "documents"), table(spark, small, "labels"))
    assert ids(stages[0]) == {d for d, score in want.items() if score < 0.3}


def test_quality_stage(spark, small, stages):
    want = plain.quality_keys(stages[0], table(spark, small, "labels"))
    assert ids(stages[1]) == {d for d, (_, _, selected) in want.items() if selected}


def test_dedup_stages(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    best = {}
    for d, t in rows:
        best[lowered(t)] = max(d, best.get(lowered(t), d))
    assert ids(stages[2]) == set(best.values())
    rows = sorted((d, t) for d, t in rows if d in ids(stages[2]))
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert ids(stages[3]) == {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_packing_stage_and_run(spark, small, stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[3].collect()}
    got = {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    assert corpus_pipeline.run(spark, small).count() == stages[4].count()


EXTRA = "gone_id string, gone_sha string, gone_text string, n string, key string, h string, u string, kept string"


def awkward_folder(spark, path, rows):
    """Tables of a run: documents with clashing extra columns, and labels."""
    schema = f"doc_id long, text string, lang string, source string, n_chars int, {EXTRA}"
    spark.createDataFrame([(d, t, None, None, None, *["x"] * 8) for d, t in rows], schema).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(d, d % 5 != 0, d % 7 == 0) for d, _ in rows if d is not None and d < 100]
    spark.createDataFrame([(d, int(q), int(t)) for d, q, t in labels] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_on_awkward_rows(spark, tmp_path):
    body = " ".join(f"word{i}" for i in range(40))
    rows = [(d, f"{body} {'slur' if d % 7 == 0 else 'calm'} {'!!! $$$ ' * 9 if d % 5 == 0 else ''} {' '.join(f'w{d}x{i}' for i in range(30))}") for d in range(60)]
    rows += [(None, "no id"), (100, None), (101, ""), (102, None), (103, body), (103, body), (104, body.upper()), (105, "x " * 50_000), (106, "ab" * 5000)]
    awkward_folder(spark, str(tmp_path), rows)
    docs = table(spark, str(tmp_path), "documents")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
        if name != "packing":
            assert docs.columns == names and 0 < docs.count() <= before
            before = docs.count()
    assert docs.agg(F.sum("length")).first()[0] > 0


def test_stages_on_empty_tables(spark, tmp_path):
    awkward_folder(spark, str(tmp_path), [])
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert after.count() == 0 and (name == "packing" or after.columns == docs.columns)
