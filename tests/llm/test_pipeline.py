import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from spoor.llm import langid, secrets, tokens
from tests.llm.test_duplicates import brute


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_join", "decontamination", "secret_scans", "packing"]


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf)
        assert docs.columns == names and 0.6 * before < docs.count() <= before
    assert docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0
    assert out.select("doc_id").distinct().count() > 100


def cut_brute(text, items):
    """The text without its words in benchmark windows, from the first to the last of each run; None if nothing is left."""
    words = lambda t: [(m.start(), m.end(), m[0].translate(FOLD)) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", t or "")]
    own = words(text)
    hit = [False] * len(own)
    for item in items:
        w = [x for *_, x in words(item)]
        for size in ({min(len(w), 10)} if w else ()):
            patterns = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            for i in range(len(own) - size + 1):
                if tuple(x for *_, x in own[i : i + size]) in patterns:
                    hit[i : i + size] = [True] * size
    if own and all(hit):
        return None
    out, at, i = [], 0, 0
    while i < len(own):
        if hit[i]:
            j = i
            while j + 1 < len(own) and hit[j + 1]:
                j += 1
            out.append(text[at : own[i][0]])
            at, i = own[j][1], j
        i += 1
    return "".join([*out, (text or "")[at:]]) if any(hit) else text


FOLD = {c: c + 32 for c in range(65, 91)}


def test_run_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.train(docs)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if found[r["doc_id"]] != "und"]
    heads = {k for k, c, _ in brute(rows) if k == c}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = {}
    for k, t in rows:
        if str(k) in heads and (t := cut_brute(t, items)) is not None:
            expected[k] = secrets.redact(t, secrets.all_spans(t))
    assert 100 < len(expected) < len(rows)
    e = tokens.Encoder()
    ids = {k: np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t in expected.items()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(ids)
    placed = Counter()
    for r in out:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) // 4 and r["ids_crc32"] == zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])])
        placed[r["doc_id"]] += r["length"]
    assert placed == {k: len(x) // 4 for k, x in ids.items()}


def test_odd_rows_pass_every_stage(spark, odd, none, sf):
    """Texts without a letter go, of copies the least id stays, the rest passes; nothing of nothing."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.schema == odd.schema or docs.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "10", "6", "9", "None"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.filter("start = 0").count() == 5
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
