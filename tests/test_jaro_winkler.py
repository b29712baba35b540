import random

from pyspark.sql import functions as F

from millrace.functions.text import jaro_winkler_similarity


def plain(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == ch:
                used.add(j)
                left.append(ch)
                break
    if not left:
        return 0.0
    m, right = len(left), [b[j] for j in sorted(used)]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) // 2) / m) / 3
    prefix = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_equals_plain_python(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])))
    pairs = [(word(), word()) for _ in range(1500)] + [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", ""), ("a", "bcdefghijkl"), ("bcdefghijkl", "a")]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    shown = df.select("a", "b", jaro_winkler_similarity(F.col("a"), F.col("b")).alias("s"))
    for r in shown.collect():
        assert r.s is None if r.a is None or r.b is None else abs(r.s - plain(r.a, r.b)) < 1e-12
    assert "Python" not in shown._jdf.queryExecution().executedPlan().toString()
