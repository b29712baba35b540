import itertools
import re

import pytest

from millrace.llm import decontaminate as d
from millrace.llm.decontaminate import contaminated


def test_masks_hit_every_tolerated_run():
    for k in range(d.SUBSTITUTIONS + 1):
        for bad in itertools.combinations(range(d.WINDOW), k):
            assert any(not {o + m for m in mask} & set(bad) for mask in d.MASKS for o in range(d.WINDOW - mask[-1]))


def toks(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def may_overlap(a, b, w, need):
    """Whether any tokens that a qualifying run must share are shared: a run of need // (substitutions + 1) of them."""
    n = max(1, need // (w - need + 1))
    own = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
    return any(tuple(a[k : k + n]) in own for k in range(len(a) - n + 1))


def brute(docs, items):
    out = {}
    for i, t in docs:
        a = toks(t)
        for j, s in items:
            b = toks(s)
            if not b:
                continue
            w = min(d.WINDOW, len(b))
            need = w - d.tolerated(w)
            if not may_overlap(a, b, w, need):
                continue
            best = None
            for diag in range(-len(b), len(a)):
                cover, eq = set(), 0
                for s0 in range(len(b) - w + 1):
                    if 0 <= s0 + diag and s0 + diag + w <= len(a) and sum(a[s0 + diag + x] == b[s0 + x] for x in range(w)) >= need:
                        cover |= set(range(s0, s0 + w))
                if cover:
                    eq = sum(a[x + diag] == b[x] for x in cover)
                    got = (len(cover), eq, -(min(cover) + diag), -min(cover))
                    best = max(best or got, got)
            if best:
                out.setdefault((i, j), []).append((best[0], best[1], -best[2], -best[3]))
    return {k: sorted(v) for k, v in out.items()}


def gather(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.item_id), []).append((r.overlap_tokens, r.equal_tokens, r.doc_start, r.item_start))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("bits", (7, 26))
def test_edges(spark, monkeypatch, bits):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = [(1, item), (2, "five words make one item"), (3, "too short"), (4, None), (5, ""), (6, item), (None, item)]
    swapped = item.replace("gamma", "x").replace("kappa", "y")
    docs = [(1, "so " + item + " end"), (2, swapped.upper()), (3, swapped.replace("mu", "z")), (4, None), (5, ""), (6, "say: five words, make ONE item!"), (6, "say: five words, make ONE item!"), (7, "x " * 30000 + item), (8, "five words make other item")]
    monkeypatch.setattr(d, "FILTER_BITS", bits)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS body")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = gather(contaminated(df, bench))
    assert got == brute([x for x in docs if x[0] != 7], [x for x in items if x[0]]) | {(7, 1): [(15, 15, 30000, 0)], (7, 6): [(15, 15, 30000, 0)]}
    assert contaminated(df.limit(0), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0


def test_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect()]
    short = [(1000 + n, " ".join(toks(texts[n % len(texts)])[5 : 5 + n])) for n in range(1, 13)]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame(short, "item_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = gather(contaminated(docs, bench))
    assert got == brute(rows, items)
    assert got


def test_short_items_and_unspaced_scripts(spark):
    for n in range(d.TOLERANT, d.WINDOW):
        assert all(any(bad not in mask for mask in d.whole_masks(n)) for bad in range(n))
    seven, twelve = "a1 b1 c1 d1 e1 f1 g1", " ".join(f"t{k}" for k in range(12))
    chinese, thai = "床前明月光疑是地上霜举头望明月", "กรุงเทพมหานคร"
    items = [(1, "yes"), (2, "nine lives"), (3, seven), (4, twelve), (5, chinese), (6, thai), (7, "東京")]
    docs = [(1, "no, yes! " + "yes " * 999), (2, "of nine lives"), (3, seven.replace("a1", "x")), (4, "u " + twelve.replace("t6", "x")), (5, "诗:" + chinese.replace("疑", "乃") + "。"), (6, "a" + thai + "b"), (7, "x東京y"), (8, seven.replace("b1", "x").replace("f1", "y") + " nine x lives 東x京")]
    got = gather(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == {(1, 1): [(1, 1, 1, 0)], (2, 2): [(2, 2, 1, 0)], (3, 3): [(7, 6, 0, 0)], (4, 4): [(12, 11, 1, 0)], (5, 5): [(15, 14, 1, 0)], (6, 6): [(13, 13, 1, 0)], (7, 7): [(2, 2, 1, 0)]}


def test_items_of_a_word_or_two_drop_no_document(spark):
    from millrace.llm.decontaminate import keep_clean

    docs = spark.createDataFrame([(1, "the end of the line"), (2, "nothing here"), (3, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the end"), (3, "two three four")], "item_id long, text string")
    assert {r.doc_id for r in keep_clean(docs, items).collect()} == {1, 2}
    assert {r.doc_id for r in keep_clean(docs, items, least_tokens=1).collect()} == {2}
