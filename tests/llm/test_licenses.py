import random

import pytest

from millrace.llm.licenses import _WORD, FORMS, TEMPLATES, Scanner, scan_licenses


def test_every_template_is_found_in_running_text(spark):
    rows = [(i, f"Some words before.\n{t}\nand after") for i, t in enumerate(TEMPLATES.values())]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].license for i in got} == dict(enumerate(TEMPLATES))
    assert all(r.differences == 0 and r.block_start == 19 for r in got.values())


def test_edges(spark):
    long = "word " * 50000 + "released under the MIT license, with " + "word " * 50000
    rows = [(1, None), (2, ""), (3, "The licence of poets is copyright of none"), (4, long), (4, long), (None, "Licensed UNDER the Apache License, version 2.0"), (6, "Licensed under the old Apache License, Version 2.0."), (7, "license " * 3000), (8, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license")
    got = [(r.doc_id, r.license, r.differences, r.added) for r in scan_licenses(docs).collect()]
    assert got.count((4, "MIT", 0, [])) == 2
    assert (None, "Apache-2.0", 0, []) in got
    assert (6, "Apache-2.0", 1, ["old"]) in got
    assert not [r for r in got if r[0] in (1, 2, 3, 7)]
    assert scan_licenses(docs.limit(0)).count() == 0


def test_table_equals_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r.doc_id, name) for r in docs.collect() for name, t in TEMPLATES.items() if t in (r.text or ""))
    assert sorted((r.doc_id, r.license) for r in scan_licenses(docs).collect() if r.differences == 0) == want
    assert want


@pytest.mark.parametrize("block, missing, added", [("a b c", [], []), ("x a b c y", [], []), ("a q b c", [], ["q"]), ("a c", ["b"], [])])
def test_wording(block, missing, added):
    assert Scanner.wording(["a", "b", "c"], block.split()) == (missing, added)


def scanned(spark, *texts):
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.license, r.differences) for r in rows)


def test_rights_notices_as_they_occur(spark, sf_dir):
    texts = ["All rights reserved.", "Copyright. All rights reserved.", "Copyright (c) 2024 Acme Corp. All rights reserved.", "Copyright 2024. All rights reserved.", "Copyright 2024 Acme. All right reserved."]
    assert scanned(spark, *texts) == [(0, "Proprietary", 0), (1, "Proprietary", 0), (2, "Proprietary", 0), (3, "Proprietary", 0), (4, "Proprietary", 1)]
    assert scanned(spark, "Copyright and what it is.", "Creative Commons: some rights reserved.", "Copyright " + "word " * 99 + "rights reserved") == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(r.doc_id for r in docs.collect() if "All rights reserved." in (r.text or ""))
    assert want and sorted(r.doc_id for r in scan_licenses(docs).where("license = 'Proprietary' AND differences = 0").collect()) == want


@pytest.mark.parametrize("name, k", [(name, k) for name, texts in FORMS.items() for k in range(len(texts))])
def test_further_forms(name, k):
    words = FORMS[name][k].replace("{holder}", "2020, 2021 Ann Bell and others").split()
    lines = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = Scanner(TEMPLATES, FORMS).scan(f"import this\n{lines if len(words) > 20 else ' '.join(words)}\nand after")
    assert [(r[0], r[3], r[4], r[5]) for r in rows] == [(name, 0, [], [])]


def test_all_notices_of_a_line(spark):
    cc, mit, apache = (TEMPLATES[x] for x in ("CC-BY-NC-4.0", "MIT", "Apache-2.0"))
    texts = [f"{cc} {mit}", f"{mit} {mit}", f"Parts: {apache} Others: {mit} Data: {cc} Copyright 2024 Acme. All rights reserved.", " ".join([mit, cc] * 200)]
    want = [(0, "CC-BY-NC-4.0", 0), (0, "MIT", 0), (1, "MIT", 0), (1, "MIT", 0)]
    want += [(2, x, 0) for x in ("Apache-2.0", "CC-BY-NC-4.0", "MIT", "Proprietary")] + [(3, x, 0) for x in ("CC-BY-NC-4.0", "MIT") for _ in range(200)]
    assert scanned(spark, *texts) == want
    assert [r[0] for r in Scanner(TEMPLATES, FORMS).scan(texts[2])] == ["Apache-2.0", "MIT", "CC-BY-NC-4.0", "Proprietary"]


def test_one_row_for_one_notice(spark):
    assert scanned(spark, *TEMPLATES.values()) == sorted((i, x, 0) for i, x in enumerate(TEMPLATES))
    assert scanned(spark, "Copyright 2024 Acme. " + FORMS["MIT"][0] + " " + TEMPLATES["MIT"]) == [(0, "MIT", 0), (0, "MIT", 0)]


def test_versions_names_negations_and_wrapped_lines(spark):
    texts = ["Released under\nthe MIT\nLicense.", "Licensed under CC BY-SA 3.0.", "Licensed under the Apache License, Version 1.1.", "This is not licensed under the MIT License.", "It is licensed under the MIT License.", "Released under the XYZ License.", "This library isn't released under the ISC License. It is released under the MIT License.", "This work is licensed under the GNU Lesser General Public License, version 2.", "Do not copy. Released under the MIT License."]
    assert scanned(spark, *texts) == [(0, "MIT", 0), (4, "MIT", 1), (6, "MIT", 0), (8, "MIT", 0)]


def test_templates_of_a_caller_need_no_clue_words(spark):
    own = {"Garden": "Seeds may be sown by anyone in the village.", "Orchard": "Apples belong to who picks them up."}
    texts = ["He said: seeds may be\nsown by anyone in the village, truly.", "apples belong to who picks up", "Seeds and apples."]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own).collect()
    assert sorted((r.doc_id, r.license, r.differences) for r in rows) == [(0, "Garden", 0), (1, "Orchard", 1)]


def test_equally_good_notices_are_told_by_bytes_saved_then_name():
    rows = Scanner({"B": "alpha beta gamma delta now", "A": "alpha beta gamma delta now"}).scan("alpha beta gamma delta now")
    assert [r[0] for r in rows] == ["A"]


def test_documents_equal_whole_texts_against_every_template(spark, sf_dir):
    """Blocks, clues and the first look at the words leave nothing out."""
    scanner = Scanner(TEMPLATES, FORMS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000")
    want = []
    for r in docs.collect():
        found, taken = [], []
        for _, _, notices in scanner.kinds:
            for n in notices:
                n.possible = lambda there: True
            parts = [0, *(x for span in sorted(taken) for x in span), len(r.text)]
            for lo, hi in zip(parts[::2], parts[1::2]):
                rows, places = scanner.confirmed(r.text, lo, hi, notices)
                found += rows
                taken += places if len(notices[0].words) >= 30 else []
        want += [(r.doc_id, name, start, differ, missing, added) for start, (name, _, _, differ, missing, added) in found]
    got = [(r.doc_id, r.license, r.block_start, r.differences, r.missing, r.added) for r in scan_licenses(docs).collect()]
    assert sorted(got) == sorted(want) and want


class Idle:
    """A compressor that saves nothing, whatever it is given."""

    def compress(self, raw):
        return b""


def test_compression_decides_what_is_found(monkeypatch):
    text = "Parts: " + TEMPLATES["Apache-2.0"] + " Others: " + TEMPLATES["MIT"]
    scanner = Scanner(TEMPLATES, FORMS)
    assert [r[0] for r in scanner.scan(text)] == ["Apache-2.0", "MIT"]
    for _, _, notices in scanner.kinds:
        for n in notices:
            if n.name == "MIT":
                n.given = type("Worse", (), {"compress": lambda self, raw: raw * 2})()
    assert [r[0] for r in scanner.scan(text)] == ["Apache-2.0"]
    monkeypatch.setattr("millrace.llm.licenses._ALONE", Idle())
    assert scanner.scan(text) == []


def plain_differences(notice, block):
    """The least number of words missing or put in (the larger of both) of a notice in any stretch of a block, by plain edit tables; None beyond what it tolerates."""
    fixed = notice.fixed
    best = None
    for start in range(len(block)):
        # least[i][m]: words put in, of the first i notice words with m missing, ending at each place
        reach = {(0, start): 0}  # (missing, place) -> put in
        for w in fixed:
            new = {}
            for (m, at), p in reach.items():
                if m < notice.lacks and new.get((m + 1, at), 99) > p:
                    new[m + 1, at] = p
                for q in range(notice.adds - p + 1):
                    if at + q < len(block) and block[at + q] == w and new.get((m, at + q + 1), 99) > p + (q if at > start else 0) and (at > start or q == 0):
                        new[m, at + q + 1] = p + (q if at > start else 0)
            reach = new
        for (m, at), p in reach.items():
            if at > start and (best is None or max(m, p) < best):
                best = max(m, p)
    return best


def test_gate_loses_no_notice_that_edit_tables_find():
    """Every notice without a {holder}, with words dropped, put in and in other company, is found where plain edit tables find it."""
    rng = random.Random(8)
    filler = "la de under terms this work free use copy with text more plain".split()
    scanner = Scanner(TEMPLATES, FORMS)
    tried = found = 0
    for _, _, notices in scanner.kinds:
        for n in notices:
            if "{holder}" in n.text:
                continue
            for _ in range(6):
                words = n.text.lower().split()
                telling = n.telling
                for _ in range(rng.randrange(1 + max(1, len(words) // 6))):
                    at = rng.randrange(1, len(words))
                    if rng.random() < 0.5:
                        words.insert(at, rng.choice(filler))
                    elif not any(t in words[at] for t in telling) and len(words) > 4:
                        del words[at]
                around = [rng.choice(filler) for _ in range(rng.randrange(60))]
                text = " ".join([*around, *words, *around[::-1]])
                block = [m.group() for m in _WORD.finditer(text)]
                least = plain_differences(n, block)
                if least is None or not n.possible(set(block)):
                    continue
                tried += 1
                rows = scanner.scan(text)
                found += any(r[0] == n.name for r in rows)
                assert all(r[3] <= max(n.lacks, n.adds) for r in rows if r[0] == n.name)
    assert tried > 60 and found == tried


def test_recall_on_other_wordings():
    """Wordings that no template has, by figures: what is found of them, and that nothing else is."""
    known = {
        "Licensed under the MIT License.": "MIT", "It is released under the terms of the MIT license.": "MIT", "This file is released under the MIT license": "MIT",
        "Licensed under the Apache License 2.0": "Apache-2.0", "Code is licensed under Apache License, version 2.0": "Apache-2.0", "Licensed under the Apache License, Version 2.0 and nothing else": "Apache-2.0",
        "Text is licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Released under the ISC licence": "ISC", "Licenced under the MIT licence.": "MIT", "Our package is licensed under the terms of the BSD 2-Clause licence": "BSD-2-Clause", "This library is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
        "This program is licensed under the GNU General Public License version 3": "GPL-3.0", "licensed under the BSD 3-Clause license": "BSD-3-Clause", "subject to the terms of the Mozilla Public License, version 2.0": "MPL-2.0",
    }
    scanner = Scanner(TEMPLATES, FORMS)
    got = {text: [r[0] for r in scanner.scan("Some words. " + text + " and more words here.")] for text in known}
    assert all(set(names) <= {known[text]} for text, names in got.items())
    assert sum(bool(x) for x in got.values()) / len(known) >= 0.9
