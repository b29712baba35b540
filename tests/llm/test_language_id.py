import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm.language_id import BINS, MOST_TRAINING, SHARPNESS, SMOOTHING, codewords, identify, keep_identified, predict, sampled_below, train


def test_codewords_keep_their_distance():
    for n in (2, 3, 4, 5, 6, 9, 30):
        code = codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2 if n == 3 else 4)
        assert all(len(set(c)) == 2 for c in code.T)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "the and of that with " * 20000), (5, "é"), (6, "a")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS score", "array(1, 2) AS extra")
    got = {(r.doc_id, r.text): r for r in predict(odd, model).collect()}
    assert [got[k].lang_pred for k in [(1, None), (2, ""), (3, "123 !!")]] == ["und"] * 3
    assert got[(None, rows[4][1])].lang_pred == "en"
    assert got[(5, "é")].lang_pred in model.langs and got[(6, "a")].extra == [1, 2]
    assert predict(odd.limit(0), model).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}
    one = docs.selectExpr("doc_id", "text", "'xx' AS lang")
    assert {r.lang_pred for r in identify(one).collect()} == {"xx"}


def test_only_texts_without_a_language_are_dropped(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL")
    first = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    mixed = " ".join(t[:300] for t in first.values())
    odd = spark.createDataFrame([(-1, "A.", None), (-2, "De.", None), (-3, "x", None), (-4, mixed, None), (-5, "中", None), (-6, "1 2.", None), (-7, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in keep_identified(docs.unionByName(odd)).where("doc_id < 0").collect()} == {-1, -2, -3, -4, -5}
    assert {r.doc_id for r in keep_identified(odd).collect()} == {-1, -2, -3, -4, -5}


def plain_bins(text):
    """Trigrams in plain Python: folded bytes, none around a byte that is no letter."""
    folded = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text.encode()]
    return Counter((((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 18) for a, b, c in zip(folded, folded[1:], folded[2:]) if b != 32)


def test_table_equals_plain_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(plain_bins(r.text))
    langs = sorted(counts)
    code = codewords(len(langs)).tolist()
    share = {x: [(counts[x][k] + SMOOTHING) / (sum(counts[x].values()) + SMOOTHING * BINS) for k in range(BINS)] for x in langs}
    weights, trust = [], []
    for bit in range(len(code[0])):
        sides = [[share[x] for x, c in zip(langs, code) if c[bit] == sign] for sign in (1, -1)]
        means = [[sum(v) / len(side) for v in zip(*side)] for side in sides]
        w = [math.log(a) - math.log(b) for a, b in zip(*means)]
        margin = [sum(s * v for s, v in zip(share[x], w)) for x in langs]
        scale = sum(map(abs, margin)) / len(margin)
        weights.append([v / scale for v in w])
        trust.append(max(0.02 * scale, min(m * c[bit] for m, c in zip(margin, code))))
    trust = [t / sum(trust) for t in trust]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows)).collect()}
    for r in rows:
        bins = plain_bins(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        n = max(1, sum(bins.values()))
        margin = [sum(w[k] * m for k, m in bins.items()) / n for w in weights]
        loss = [sum(math.log1p(math.exp(-2 * m * c)) * t for m, c, t in zip(margin, row, trust)) for row in code]
        best = min(range(len(langs)), key=loss.__getitem__)
        odds = sum(math.exp(-SHARPNESS * (x - loss[best])) for x in loss)
        assert abs(got[r.doc_id].score - 1 / odds) < 1e-4
        if sorted(loss)[1] - loss[best] > 1e-5:
            assert got[r.doc_id].lang_pred == langs[best]


def test_the_sample_is_bounded_and_never_empty(spark, sf_dir):
    for total in (30_000, 10**9, 10**12, 10**15):
        assert abs(sampled_below(MOST_TRAINING, total) / (1 << 62) * total - MOST_TRAINING) < 1
    assert train(spark.read.parquet(f"{sf_dir}/documents.parquet"), most=60).langs


def test_null_ids_are_sampled_like_others_and_labels_are_bounded(spark, sf_dir, monkeypatch):
    from millrace.llm import language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(null AS long) AS doc_id", "text", "lang")
    seen = []
    plain = language_id.Ecoc
    monkeypatch.setattr(language_id, "Ecoc", lambda langs, counts: seen.append(counts.sum()) or plain(langs, counts))
    whole, some = train(docs, most=10**6), train(docs, most=20)
    assert some.langs and seen[1] < 0.5 * seen[0]
    many = docs.selectExpr("doc_id", "text", "concat('l', pmod(hash(text), 7)) AS lang")
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    assert len(train(many).langs) == 3 and len(whole.langs) > 1


def test_texts_go_to_the_workers_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = keep_identified(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.index("MapInArrow") :]
    assert "cast(text" not in sent
    as_bytes = keep_identified(docs.withColumn("text", F.col("text").cast("binary")))
    assert sorted(r.doc_id for r in as_bytes.collect()) == sorted(r.doc_id for r in kept.collect())
