"""The pipeline against a brute-force version of each stage, and the registered text queries on the smallest tables."""

import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_documents import naive_tiles, shingles, within_one
from test_queries import FOLDER, TABLES, plain
from tidemark.llm import decontaminate, mixing, quality_rules

TEXT_QUERIES = [n for n in entry.queries() if n.startswith("op")]


def write(folder, name, frame):
    os.makedirs(folder, exist_ok=True)
    frame.to_parquet(f"{folder}/{name}.parquet", index=False)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    g = random.Random(12)
    common = quality_rules.COMMON_WORDS["en"]
    words = [g.choice("bcdfglmnprst") + g.choice("aeiou") + g.choice("bcdfglmnprst") + g.choice(["", "er", "ing", "ed"]) for _ in range(500)]
    sentence = lambda n: " ".join(g.choice(common) if g.random() < 0.4 else g.choice(words) for _ in range(n)).capitalize() + "."
    make = lambda n: "\n".join(sentence(g.randrange(8, 14)) for _ in range(n))
    items = [sentence(30) for _ in range(4)]
    shared = sentence(12)
    texts = [make(g.randrange(8, 14)) for _ in range(40)]
    texts += [texts[0], "\n".join([shared, make(9)]), "\n".join([make(9), shared, make(2)])]
    for k in (5, 11, 12):  # near copies whose lines differ in more than a character each
        texts.append("\n".join(" ".join([*x.split()[:-1], g.choice(words) + "q."]) for x in texts[k].split("\n")[:9]))
    texts += [make(4) + "\n" + items[0] + "\n" + make(4), make(5) + "\n" + " ".join(items[1].split()[15:] + ["odd"] + items[1].split()[:15]) + "\n" + make(5)]
    texts += ["short text", None, "", " ".join(["again"] * 200), " ".join(w + "$$$%%%" for w in make(9).split())]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s0", "n_chars": [len(t or "") for t in texts]})
    labels = pd.DataFrame({"doc_id": range(0, len(texts), 2), "quality": [1, 0, 1] * (len(range(0, len(texts), 2)) // 3) + [1] * (len(range(0, len(texts), 2)) % 3), "toxic": 0})
    folder = str(tmp_path_factory.mktemp("small"))
    write(folder, "documents", docs)
    write(folder, "labels", labels)
    write(folder, "benchmark", pd.DataFrame({"item_id": range(len(items)), "text": items}))
    return folder, docs, items


def brute(docs, items):
    """(doc_id, text) after the first four stages."""
    rows = [(r.doc_id, r.text) for r in docs.itertuples()]
    n = len(quality_rules.CLASSES)
    sums = np.zeros(n + len(quality_rules.VOCABULARY) + 1)
    for _, t in rows:
        sums[:n] += quality_rules.class_counts(quality_rules.byte_counts(t or ""))
        sums[n:] += quality_rules.common_counts(quality_rules.WORD.findall(t or ""))
    refs = tuple((x / x.sum())[None] for x in (sums[:n], sums[n:]))
    rows = [(i, t) for i, t in rows if quality_rules.judge(t or "", refs)[6]]
    lines = [((i, k), x.strip(" ")) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    gone = {p for p, x in lines if any(q < p and (x == y or min(len(x), len(y)) >= 20 and within_one(x, y)) for q, y in lines)}
    after = []
    for i, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if left.strip() or left == t:
            after.append((i, left))
    sets = {i: shingles(t) for i, t in after}
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    after = [(i, t) for i, t in after if part[i] == i]
    tokens = [decontaminate.tokens(x) for x in items]
    return [(i, t) for i, t in after if not any(naive_tiles(decontaminate.tokens(t), x, 5) >= 0.6 * len(x) for x in tokens)]


def test_pipeline_matches_brute_force(spark, small):
    folder, docs, items = small
    out = corpus_pipeline.run(spark, folder).toPandas().sort_values("doc_id")
    want = brute(docs, items)
    assert list(zip(out.doc_id, out.text, strict=True)) == want
    assert 30 < len(want) < len(docs) - 5
    assert (out.n_chars == out.text.str.len()).all() and list(out.columns) == [*docs.columns, *(f"p_{d}" for d in mixing.DOMAINS), "rate"]
    assert np.allclose(out[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1), 1) and (out.rate >= 0).all()


def test_every_stage_takes_an_empty_table(spark, small):
    folder, *_ = small
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_stages_are_named_and_ordered():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_registered_queries(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=key) == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=key)
