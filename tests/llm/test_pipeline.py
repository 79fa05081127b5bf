"""The corpus pipeline: stages against brute force on a small corpus, guards."""

import hashlib
import random
import subprocess
import sys

import public_tokenizers as P
import pytest

import corpus_pipeline as pipeline
from ferrule.llm import registry
from tests.llm.conftest import words
from tests.llm.test_near_text import brute_join, passages
from tests.llm.test_mixing_chat import plain_targets

REPO = registry.__file__.rsplit("/ferrule/", 1)[0]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(0)
    texts = {}
    for k in range(90):
        texts[k] = " ".join(words(k, rng.randint(30, 120))).capitalize() + "."
    for k in range(90, 120):
        texts[k] = "".join(w.upper() + "!! " for w in words(k, 60))
    passage = " ".join(words(999, 60))
    for k in (3, 8, 20):
        texts[k] += " " + passage + " end."
    texts[200], texts[201] = texts[5], texts[6] + " one"
    texts[202], texts[203] = None, ""
    rows = [(k, t, "en", f"s{k % 4}" if k % 7 else None, None if t is None else len(t)) for k, t in texts.items()] + [(None, texts[9], "en", "s1", 1)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(k, int(k < 90), 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages_against_brute_force(spark, corpus, tmp_path):
    d, rows = corpus
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    rows_of = {n: [(r["doc_id"], r["text"]) for r in f.collect()] for n, f in seen.items() if "text" in f.columns}
    good = rows_of["quality_classifier"]
    assert {i for i, t in good if i is not None and i < 120 and t} == set(range(90))
    want = brute_join(good)
    assert sorted((i, t) for i, t in rows_of["ngram_jaccard_join"] if i is not None) == \
        sorted((i, t) for i, t in good if i is not None and want[i][1] == i)
    assert {200, 201}.isdisjoint(i for i, _ in rows_of["ngram_jaccard_join"])
    cut = rows_of["substring_dedup"]
    assert len(cut) == len(rows_of["ngram_jaccard_join"]) and passages(rows_of["ngram_jaccard_join"]) and \
        not passages([(i, t) for i, t in cut if i is not None])
    changed = {i for i, t in cut if (i, t) not in rows_of["ngram_jaccard_join"]}
    assert changed == {8, 20}
    sizes, taken = {}, {}
    for f, out in (("substring_dedup", sizes), ("mixing_sources", taken)):
        for r in seen[f].collect():
            out[r["source"]] = out.get(r["source"], 0) + len((r["text"] or "").split())
    goal = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - goal[s]) <= 120 for s in sizes)
    assert set(rows_of["mixing_sources"]) <= set(cut)
    got = sorted((r["doc_id"] or -1, r["decoded_sha256"]) for r in seen["byte_level_bpe"].collect())
    assert got == sorted((i or -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows_of["mixing_sources"])


def test_empty_documents(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).count() == 0


def test_quality_filter_leaves_the_documents_columns_alone(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wanted = sorted(((r["doc_id"], r["text"]) for r in pipeline.quality_filter(spark, docs, d).collect()), key=repr)
    more = docs.selectExpr("'mine' AS Score", "doc_id", "7 AS predicted", "text", "lang", "source", "n_chars", "doc_id AS _doc_1")
    got = pipeline.quality_filter(spark, more, d)
    assert got.columns == more.columns
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == wanted
    assert {(r["Score"], r["predicted"], r["_doc_1"] == r["doc_id"]) for r in rows if r["doc_id"] is not None} == {("mine", 7, True)}


def test_registry_has_each_operator_once():
    numbers = [int(n[2:].split("_")[0]) for n in registry.registry()]
    assert sorted(numbers) == list(range(1, 14))
    assert len(pipeline.STAGES) == 5 and P.path("x")


def test_library_imports_without_the_subpackage():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('ferrule.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) >= 65 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
