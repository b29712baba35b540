import re

import corpus_pipeline
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(7000, None, None, "s", 0), (7001, "", "en", "s", 0), (None, "the and of that with this", None, None, None), (7002, "..", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.unionByName(docs.limit(3)).unionByName(odd).selectExpr("*", "doc_id AS score", "doc_id AS key")
    out = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir).cache()
        assert out.columns == table.columns, name
        assert stage(spark, table.limit(0), sf_dir).count() == 0
    ids = [r.doc_id for r in out.collect()]
    assert not {7000, 7001, 7002} & set(ids) and len(ids) == len(set(ids)) and None in ids
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()


def test_run_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    assert len(rows) > 0.98 * docs.count()  # held to labels in test_language_id
    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        if k not in best or len(t) > len(best[k][1]):
            best[k] = (i, t)
    rows = sorted(best.values())
    roots = brute_components([brute_print(t) for _, t in rows])
    rows = [row for k, row in enumerate(rows) if roots[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    joined = [" ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())) for _, t in items]
    suspects = [(i, t) for i, t in rows if any(seed in " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())) for j in joined for seed in (" ".join(j.split()[a : a + 4]) for a in range(len(j.split()) - 3)))]
    leaks = {i for i, _ in brute_leaks(suspects, items)}
    assert leaks
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if i not in leaks}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got.values())
