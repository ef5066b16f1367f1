"""The pipeline's stages on hard rows: nulls, repeats, ties, empty texts and tables, names that clash; each against plain Python."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group_id int, best string, digest string, contaminated int"
BASE = " ".join(f"word{k}" for k in range(120))
LEAK = "a farmer walks along seven long fences and counts every painted post before noon while two dogs sleep near the old gate"


def rows():
    texts = [
        (1, BASE), (2, BASE), (3, BASE + " more"), (4, "quite another text"), (4, "yet one more of its own"), (5, None), (6, ""), (None, "no id at all"), (None, None),
        (7, f"before {LEAK} after"), (7, "clean under the id of a leak"), (None, f"no id and {LEAK}"), (8, "you vile nastyword and vileness"), (9, "x y " * 20_000), (10, "short"), (10, "short"),
    ]
    filler = [(100 + k, " ".join(f"f{k}w{j}" for j in range(30)) + (" nastyword vileness" if k % 4 == 0 else "")) for k in range(60)]
    return [(i, t, "en", "s", len(t or ""), 7, "b", "d", 1) for i, t in texts + filler]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + k, int(k % 4 == 0)) for k in range(60)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def kept(frame):
    assert frame.columns == docs(frame.sparkSession).columns
    return sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["text"] is None, x["text"] or "", x["group_id"], x["best"], x["digest"], x["contaminated"]) for x in frame.collect()))


def key(i, t):
    return (i is None, i or 0, t is None, t or "", 7, "b", "d", 1)


def test_toxic_rows_go(spark, folder):
    got = kept(pipeline.drop_toxic(spark, docs(spark), folder))
    assert got == sorted(key(i, t) for i, t, *_ in rows() if "nastyword" not in (t or ""))


def test_one_of_equal_texts_stays(spark, folder):
    best = {}
    for i, t, *_ in rows():
        old = best.get(t or "")
        if old is None or (i is not None, i or 0, t is not None) > (old[0] is not None, old[0] or 0, old[1] is not None):
            best[t or ""] = (i, t)
    assert kept(pipeline.drop_copies(spark, docs(spark), folder)) == sorted(key(*x) for x in best.values())


def test_one_of_near_copies_stays(spark, folder):
    gone = [(2, BASE), (3, BASE + " more"), (6, ""), (None, None), (10, "short")]  # 5 without text stays for all empty ones
    want = [(i, t) for i, t, *_ in rows()]
    for x in gone:
        want.remove(x)
    assert kept(pipeline.drop_near_copies(spark, docs(spark), folder)) == sorted(key(*x) for x in want)


def test_leaks_go(spark, folder):
    assert kept(pipeline.drop_benchmark_leaks(spark, docs(spark), folder)) == sorted(key(i, t) for i, t, *_ in rows() if LEAK not in (t or ""))


def test_encoding(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((str(x["doc_id"]), x["n_tokens"], x["round_trip"]) for x in pipeline.encode(spark, docs(spark), folder).collect())
    assert got == sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids), True) for i, t, *_ in rows())


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    ids = sorted(str(x["doc_id"]) for x in pipeline.run(spark, folder).collect())
    gone = {8, *range(100, 160, 4), 1, 3, 5}  # toxic; 2 stays for 1, the near copy 3 goes for 2; 6 stays for 5; the leak
    assert ids == sorted([*(str(i) for i in {i for i, *_ in rows()} - gone), "4"])  # two texts under 4
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
