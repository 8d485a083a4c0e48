"""The pipeline's stages, each against what it must keep and drop."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from sluice.llm import near, suffixes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, letters="abcdefgh"):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, prose(150, i, "abcdefgh" if i % 2 else "opqrstuv"), "ab"[i % 2], "s", 0) for i in range(60)]
    passage = prose(60, 900).replace("\n", " ")
    rows += [(100, None, "a", "s", 0), (101, "1234 !!", "b", "s", 0), (102, rows[0][1], "a", "s", 0), (103, rows[1][1] + " more", "b", "s", 0)]
    rows += [(104, prose(80, 50).replace("\n", " ") + passage + " x", "b", "s", 0), (105, prose(80, 51).replace("\n", " ") + passage + " y", "b", "s", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-duplicate documents", "passage removal", "packing"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert 100 not in kept[0] and 101 not in kept[0] and set(range(60)) <= set(kept[0])
    assert 102 not in kept[1] or len(kept[1][102]) < len(kept[0][102])
    assert set(kept[2]) >= set(range(60))
    texts = sorted(kept[3].items())
    shared = {}
    for d, t in texts:
        raw = t.encode()
        for p in range(len(raw) - 49):
            shared.setdefault(raw[p : p + 50], set()).add(d)
    assert sum(len(v) > 1 for v in shared.values()) < 5  # only where a removal joined its two ends
    assert {r.doc_id for r in docs.collect()} == set(kept[3])


def check_pieces(spark, out, docs):
    """Each kept document's ids lie in its pieces once, and in no other row."""
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.select("doc_id", "text").collect())
    covered, rows = Counter(), out.collect()
    for r in rows:
        covered[r.doc_id, r.doc_tokens] += r.length
    assert covered == Counter({k: k[1] * n for k, n in want.items()})
    for s in {r.sequence_id for r in rows}:
        size = sum(r.length for r in rows if r.sequence_id == s)
        assert size == 4096 or size & (size - 1) == 0


def kept_by_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
    return docs


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    check_pieces(spark, out, kept_by_stages(spark, folder))


def test_run_on_odd_rows(spark, folder, tmp_path):
    """Rows without an id, repeated rows, an id with two texts, null and empty texts, and columns named like working ones."""
    base = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    texts = {r.doc_id: r.text for r in base.where("doc_id < 4").collect()}
    odd = [(None, prose(90, 71), "a", "s", 0), (None, None, "a", "s", 0), (3, texts[3], "b", "s", 0), (200, prose(80, 72), "a", "s", 0), (200, prose(70, 73), "a", "s", 0), (201, "", "a", "s", 0)]
    docs = base.unionByName(spark.createDataFrame(odd, SCHEMA))
    for name in ("id", "node", "row", "chunk", "kept", "label", "bucket", "simhash"):
        docs = docs.selectExpr("*", f"1 as {name}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = kept_by_stages(spark, str(tmp_path))
    assert kept.columns == docs.columns
    found = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert found.count((True, 0)) == 1 and found.count((False, 200)) == 2 and (False, 201) not in found
    assert {d for none, d in found if not none} == {*range(60), 200}
    check_pieces(spark, corpus_pipeline.run(spark, str(tmp_path)), kept)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_filters_agree_with_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in near.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, folder).collect()} == kept
    removed = {r.doc_id: r.n_removed for r in suffixes.repeated_passages(docs).collect()}
    out = {r.doc_id: r for r in corpus_pipeline.remove_passages(spark, docs, folder).collect()}
    for d, t in ((r.doc_id, r.text) for r in docs.collect()):
        if removed[d] == 0:
            assert out[d].text == t
        else:
            assert d not in out or len(out[d].text.encode()) <= len(t.encode()) - removed[d]
