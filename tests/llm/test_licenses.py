"""The license scan against a brute-force version: Python's regular expressions and all pairs of detections."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses

SCHEMA = "doc_id long, text string, words int, hits string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, rules=licenses.RULES):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    whole = "".join(f"<{w}>" for w in words)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    hits = []
    for i, r in enumerate(rules):
        if all(k in whole for k in r.keywords):
            hits += [(whole[: m.start()].count("<"), whole[: m.end()].count("<"), r.priority, i) for m in re.finditer(r.pattern, whole)]

    def dropped(h):
        s, e, p, i = h
        for s2, e2, p2, i2 in hits:
            if p2 > p and s2 < e and e2 > s:
                return True
            if p2 == p and s2 <= s and e2 >= e and ((s2, e2) != (s, e) or i2 < i):
                return True
        return False

    left = [h for h in hits if not dropped(h)]
    every = sorted(labels | {rules[h[3]].label for h in left})
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(every), max((rules[h[3]].weight for h in left), default=0.0)


def sample():
    g = random.Random(5)
    plain = lambda words: [re.sub(r"\((.*?)\|.*?\)", r"\1", w.removeprefix("~").replace("[sc]", "c").replace("[0-9]", "3").rstrip("?")) for w in words.split() if not w.startswith("*")]
    pieces = [plain(n) for _, _, n in licenses.NAMES] + [plain(s) for _, _, s in licenses.SENTENCES] + [plain(a) for _, _, a in licenses.ADDRESSES] + [["spdx", "license", "identifier", *w.split()] for _, w in licenses.TAGS]
    pieces += [plain(p) for p, _ in licenses.BASE] + [["licensed", "under", "the"], ["released", "under", "a"], ["creative", "commons", "attribution"], ["cc", "by", "nc", "4", "0"], ["über", "Ünder", "straße"], ["and"], ["mit"]]
    texts = []
    for n in [*range(1, 40), 600]:
        words = [w for _ in range(n) for w in g.choice(pieces)]
        texts.append(g.choice(["", "--"]).join(g.choice([w, w.upper(), w.capitalize()]) if w.isascii() else w for w in " \n".join(words).split(" ")) if n < 3 else " ".join(g.choice([w, w.upper(), w.title()]) if w.isascii() else w for w in words))
    texts += [None, "", " \t", "mit license", "MIT License, MIT LICENSE!", "permit license", "mit licenses", "General Public  License", "x" * 100_000, "no words: !!! ---", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    return [(i, t, 1, "h", "l") for i, t in enumerate(texts)] + [(None, texts[5], 1, None, None), (3, texts[3], 1, "h", "l"), (3, texts[9], None, "h", "l")]


@pytest.mark.parametrize("run", [licenses.RUN, 3])
def test_license_scan_matches_brute_force(spark, run):
    rows = sample()
    got = licenses.report(spark.createDataFrame(rows, SCHEMA).repartition(3), run=run).collect()
    want = [(i, *brute(t)) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({w[6] for w in want}) > 20


def test_license_scan_of_own_rules_and_empty_table(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    assert licenses.report(docs.limit(0)).count() == 0
    rules = (licenses.Rule("house", licenses.GRANT, ("<mit>",), licenses.compiled("mit ~x licen[sc]e"), 0.5),)
    got = {r.doc_id: r for r in licenses.report(docs.where("text = 'mit license'"), rules).collect()}
    (row,) = got.values()
    assert (row.labels, row.base_labels, row.score) == ("house,mit", "mit", 0.5)
    spans = licenses.detections(docs.where(F.col("text").startswith("Licensed under"))).collect()
    assert [(s.label, s.start, s.stop) for s in spans] == [("apache-2.0", 0, 8)]


def test_many_detections_in_one_text(spark):
    text = "released under the mit license and " * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = licenses.report(docs).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.labels) == (120_000, 20_000, 3, 119_997, "mit")
    assert time.time() - began < 60


def test_keywords_hold_for_every_pattern():
    """A text that a pattern matches holds the rule's keywords: else the prefilter would lose it."""
    for r in licenses.RULES:
        flat = re.sub(r"\[sc\]", "c", r.pattern).replace("[sz]", "z")
        for k in r.keywords:
            assert k in re.sub(r"\(\?:<[^>]*>\)\?|\(\?:<\[\^>\]\*>\)\{0,[0-9]+\}", "", flat), (r, k)


def test_native_plan(spark):
    plan = licenses.report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|In)|Exchange", plan.replace("applySchemaToPythonRDD", ""))
