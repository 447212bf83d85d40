"""The pipeline against brute-force versions of its stages on a small corpus."""

import hashlib
import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_corpus_ops import brute as leak
from tests.llm.test_near_dedup import all_pairs, families
from tests.llm.test_suffix_dedup import brute as repeats
from treeflow.llm import bpe, suffix_dedup


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice(["an", "th", "or", "é", "ti", "on", "es", "wh"]) for _ in range(rng.randrange(1, 5))) for _ in range(700)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    item, passage = pick(30), pick(70)
    texts = [None, "", "too short", "again and again " * 300]
    texts += [" ".join(pick(rng.randrange(120, 200))) for _ in range(12)]
    texts += [texts[5], texts[5]]
    near = texts[6].split()
    near[40] = "changed"
    texts.append(" ".join(near))
    texts += [" ".join(pick(60) + passage + pick(40)) for _ in range(3)]
    texts += [" ".join(pick(50) + item + pick(50))]
    where = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, texts, " ".join(item)


def test_pipeline(spark, sf_dir):
    where, texts, item = sf_dir
    got = {r.doc_id: r for r in cp.run(spark, where).collect()}
    kept = [i for i in range(4, len(texts)) if i not in (16, 17, 18)]
    left = [b.decode("utf-8", "ignore") for b in repeats([texts[i] for i in kept])]
    want = {i: t for i, t in zip(kept, left, strict=True) if leak(t, item)[0] < 0.8}
    assert set(got) == set(want)
    coder = bpe.DuckBpe(__import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    plain = [i for i in want if want[i] == texts[i]]
    assert len(plain) > 8
    for i in plain:
        ids, at, _, _ = coder.rows([want[i]])
        assert got[i].n_tokens == at[-1] and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def test_one_document_of_a_family_without_origin(spark):
    texts = families(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    kept = sorted(r.doc_id for r in cp.minhash_near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(all_pairs(texts)))


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf_dir[0]).columns == docs.columns
    assert cp.STAGES[-1][1](spark, docs.limit(0), sf_dir[0]).count() == 0


def test_one_python_function_a_task(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    for _, stage in cp.STAGES:
        assert "EvalPython" not in stage(spark, docs, sf_dir[0])._jdf.queryExecution().executedPlan().toString()


def test_passages_end_at_whole_characters(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("éüaßb€😀") for _ in range(300))
    # the repeat begins and ends inside a character: é is C3 A9, ĩ is C4 A9, à is C3 A0
    texts = ["one é" + passage + "é x", "two ĩ" + passage + "à y", "no repeat", None, "", "third " + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in suffix_dedup.remove_repeats(docs).collect()}
    got = {r.doc_id: r.text for r in cp.suffix_array_dedup(spark, docs, "").collect()}
    assert any(len(texts[i].encode()[: x.start].decode("utf-8", "ignore").encode()) != x.start for i in (0, 1) for x in spans[i])
    assert got == {i: t if not spans[i] else cp.whole_characters(t, [x.start for x in spans[i]], [x.end for x in spans[i]]) for i, t in enumerate(texts)}
    assert got[0] == "one éé x" and got[1] == "two ĩà y" and got[3] is None


def test_whole_characters():
    assert cp.whole_characters("aéb", [2], [3]) == "aéb"
    assert cp.whole_characters("aéb", [1], [3]) == "ab"
    assert cp.whole_characters(None, [], []) == ""
