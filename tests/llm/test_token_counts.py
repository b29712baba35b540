import sys

import public_tokenizers

from millrace.llm import token_counts as t
from millrace.llm.token_counts import MARK, Pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(pieces, word):
    """The best of all segmentations of a word, by memoised recursion from the right end."""
    text, memo = MARK + word, {}

    def best(start):
        if start == len(text):
            return (0, 0)
        if start not in memo:
            found = []
            for end in range(start + 1, len(text) + 1):
                if text[start:end] in pieces.cost:
                    c, n = best(end)
                    found.append((c + (pieces.cost[text[start:end]] >> t.PIECE_BITS), n + 1))
            if text[start] not in pieces.cost:
                b = len(text[start].encode())
                c, n = best(start + 1)
                found.append((c + b * (pieces.byte_cost >> t.PIECE_BITS), n + b))
            memo[start] = min(found)
        return memo[start]

    return best(0)


def test_counts_equal_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(t, "MOST_NODES", 2000)
    sys.setrecursionlimit(20_000)
    pieces = Pieces(PATH)
    rows = [(1, "a b  the\tthere therefore"), (8, "longword" * 900 + " " + "longword" * 900), (2, None), (3, ""), (4, "\U0001f600༼ x" * 3), (4, "\U0001f600༼ x" * 3), (None, "word"), (6, "abc" * 100)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_tokens")
    known = {}
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        for w in words:
            known[w] = known.get(w) or brute(pieces, w)
        want.append((i, len(words), sum(known[w][1] for w in words), -sum(known[w][0] for w in words) / t.UNIT))
    assert sorted(map(tuple, token_counts(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0
