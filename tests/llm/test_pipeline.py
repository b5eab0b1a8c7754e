import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from metricloom.llm import pfair_mix, simhash_slices, toxicity_mil  # noqa: E402
from metricloom.llm.common import learn_part  # noqa: E402
from metricloom.llm.queries import tokenizer_path  # noqa: E402
from metricloom.llm.template_decontam import Index  # noqa: E402

from .test_near_and_leaks import _classes, slow_print  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's rows, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_documents(spark, staged):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [s.columns == columns for s in staged] == [True] * 4 + [False]


def test_stages_against_brute_force(spark, staged):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = texts(docs), texts(staged[0])
    model = toxicity_mil.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), where=learn_part("doc_id", 3) != 1)
    assert after == {d: t for d, t in before.items() if model.scores([t])[0] < 0.7}
    ids = sorted(after)
    classes = _classes(np.array([slow_print(after[d]) for d in ids], np.uint64))
    one = set(texts(staged[1]))
    assert texts(staged[1]) == {d: after[d] for d in one}
    for c in set(classes):  # of each group within four bits one at most stays, and it goes only for a smaller id
        group = [ids[k] for k, x in enumerate(classes) if x == c]
        assert one & set(group) <= {min(group)}
    wide = {d: simhash_slices.fingerprint_lanes(after[d], 5, 4) for d in ids}
    first = {d: c for d, c in zip(ids, (ids[c] for c in classes))}
    for d in {ids[c] for c in classes} - one:  # what went beside those is near a text that was there
        family = [x for x in ids if first[x] == d]
        assert any(x not in family and int(np.bitwise_count(wide[x] ^ wide[y]).sum()) <= simhash_slices.WIDE_RADIUS for y in family for x in ids)
    index = Index.of([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    clean = {d: after[d] for d in one if not index.found([after[d]])[0]}
    assert texts(staged[2]) == clean == texts(staged[3])
    order = [r.doc_id for r in pfair_mix.pfair_slots(staged[2]).orderBy("mix_slot", "mix_place").select("doc_id").collect()]
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(tokenizer_path()), 0, {}
    for d in order:
        made = lib.encode(clean[d], add_special_tokens=False).ids + [corpus_pipeline.END_ID]
        want[d] = (at, len(made), zlib.crc32(np.array(made, "<u4").tobytes()))
        at += len(made)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in staged[4].collect()} == want


def test_run_is_the_stages(spark, staged):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, staged[4].select(got.columns).collect()))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "long " * 20_000, None, None, 1), (None, "words without an id are kept too", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "text AS __k0", "doc_id AS mix_place")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(out.columns) <= set(docs.columns) and out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
