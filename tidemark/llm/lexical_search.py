"""Ranked lexical search by best positions over impact lists.

Every term of a document has an integer impact, and a document's score for an item is the sum over the item's terms. The
documents are dealt into blocks of at most `block_docs` as they are read; within a block each term of the queries has a
list of documents by falling impact. For an item, the lists are read from the top; each document met is looked up in all
the item's lists at once, which also tells its position in each of them. A list's best position is the end of the
positions seen without a gap from the top, whether by reading or by looking up, and no document that hasn't been met can
have more in this list than what stands behind it. Once the sum of these impacts is strictly below the kth score, no
other document of the block can enter, nor tie, and reading stops. The blocks' best are then ranked together; each task
sends at most k rows an item.

Counts (documents, tokens, documents by term) are taken over the whole corpus first. The queries' terms, if they are no more
than `vocabulary`, are sent to the tasks, so that only their postings are written; otherwise all postings are, and joined with the terms.
Queries are searched in groups of about `pairs` of an item and a term, so what a task holds is bounded by
block_docs x pairs, in slices of at most `cells` cells.

Defined cases: a null text has no terms; an item or a document without terms matches nothing, and with no such document
there are no rows. Fewer than k documents with a score above 0 are all returned. Equal scores go by ascending doc_id, a
null doc_id last; rows that repeat a doc_id are documents of their own. Rows of the item table that are alike in item_id and
text are one item; others with the same item_id are ranked apart, under that item_id. Texts of any length are read whole. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, Scratch, id_text

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Search:
    k: int = 20
    #: Documents of a block, and postings after which it ends early.
    block_docs: int = 2048
    block_postings: int = 1_000_000
    #: Most query terms that are sent to the tasks that read texts; with more, postings are joined with them.
    vocabulary: int = 500_000
    #: Pairs of an item and a term that are searched in one group, about.
    pairs: int = 20_000
    #: Cells (terms x documents) that a search lays out at a time.
    cells: int = 4_000_000
    #: Positions that the first round reads.
    depth: int = 32


def terms_of(text: str) -> list[str]:
    """The terms of a text; bytes.lower() changes A-Z alone."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def query_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term and times for each distinct row of the items; item tells them apart."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM.pattern})"), F.lit(1))
    rows = rows.select(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull(), "text").alias("item"), "item_id", F.explode(terms).alias("term"))
    return rows.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


INDEX = "block long, term string, docs array<long>, counts array<long>, absent array<long>"


def index(docs: DataFrame, vocabulary: frozenset[str] | None, search: Search) -> DataFrame:
    """The postings of each block, by term: docs (their places in the block, ascending) and counts.

    The row of a block without a term has the documents' ids and their numbers of terms; absent: the places of those without an
    id, which have 0 there. Documents without terms are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        lists: dict[str, tuple[list[int], list[int]]] = {}
        postings = 0

        def closed() -> Iterator[pa.RecordBatch]:
            names = [None, *lists]
            none = [i for i, x in enumerate(ids) if x is None]
            columns = [[[x or 0 for x in ids], *(x[0] for x in lists.values())], [lengths, *(x[1] for x in lists.values())], [none, *([] for _ in lists)]]
            for i in range(0, len(names), 256):
                n = len(names[i : i + 256])
                arrays = [pa.array([(part << 32) + blocks] * n, pa.int64()), pa.array(names[i : i + 256], pa.string()), *(pa.array(c[i : i + 256], pa.list_(pa.int64())) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "term", "docs", "counts", "absent"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                every = terms_of(text)
                if not every:
                    continue
                counts = Counter(every)
                found = counts.keys() if vocabulary is None else counts.keys() & vocabulary
                for t in found:
                    places, times = lists.setdefault(t, ([], []))
                    places.append(len(ids))
                    times.append(counts[t])
                ids.append(doc_id)
                lengths.append(len(every))
                postings += len(found)
                if len(ids) == search.block_docs or postings >= search.block_postings:
                    yield from closed()
                    blocks += 1
                    ids, lengths, lists, postings = [], [], {}, 0
        if ids:
            yield from closed()

    return id_text(docs).mapInArrow(run, INDEX)


class Lists:
    """The impact lists of some terms over some documents of a block, with direct access by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> None:
        by = np.lexsort((doc, -impact, term))
        term, doc, impact = term[by], doc[by], impact[by]
        sizes = np.bincount(term, minlength=n_terms)
        place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.longest = int(sizes.max(initial=0))
        self.n_docs = n_docs
        #: By term and position; behind the end there is no document, and no impact.
        self.doc_at = np.full((n_terms, self.longest + 1), -1, dtype=np.int32)
        self.doc_at[term, place] = doc
        self.impact_at = np.zeros((n_terms, self.longest + 1), dtype=np.int64)
        self.impact_at[term, place] = impact
        #: By term and document; a document that a list hasn't is at the place behind the longest.
        self.place_of = np.full((n_terms, n_docs), self.longest, dtype=np.int32)
        self.place_of[term, doc] = place
        self.sizes = sizes

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, depth: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores among which are the k best (all that are at least `least`, if they tie), and how many were met."""
        behind = np.arange(self.longest + 1)
        seen = behind >= self.sizes[terms][:, None]
        seen[:, self.longest] = False  # where a list that is seen to its end stops
        best = np.argmin(seen, axis=1)
        met = np.zeros(self.n_docs, dtype=bool)
        rows, docs, scores = np.arange(len(terms))[:, None], [], []
        own = (np.array([], dtype=np.int64),) * 2
        while True:
            ahead = self.doc_at[terms[:, None], np.minimum(best[:, None] + np.arange(depth), self.longest)]
            fresh = np.zeros(self.n_docs, dtype=bool)
            fresh[ahead[ahead >= 0]] = True
            fresh = np.flatnonzero(fresh & ~met)
            met[fresh] = True
            place = self.place_of[terms[:, None], fresh]  # direct access, in all lists
            docs.append(fresh)
            scores.append((self.impact_at[terms[:, None], place] * times[:, None]).sum(axis=0))
            seen[rows, place] = True
            seen[:, self.longest] = False
            best = np.argmin(seen, axis=1)
            bound = int((self.impact_at[terms, best] * times).sum())
            own = np.concatenate(docs), np.concatenate(scores)
            kth = int(np.partition(own[1], -k)[-k]) if len(own[1]) >= k else 0
            if bound == 0 or bound < max(kth, least):
                return *own, int(met.sum())
            depth *= 2


def top(ids: np.ndarray, absent: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, those without one last."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return keep[np.lexsort((ids[keep], absent[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, absent, -scores))[:k]


def search_block(rows: pd.DataFrame, n: int, length: int, search: Search) -> pd.DataFrame:
    """item, doc_id and score of the k best of one block for each item of one group of queries."""
    lists = rows[rows.term.notna()]
    (head,) = rows[rows.term.isna()].itertuples()
    ids = np.asarray(head.docs, dtype=np.int64)
    absent = np.zeros(len(ids), dtype=bool)
    absent[np.asarray(head.absent, dtype=np.int64)] = True
    m = 75 + (25 * np.asarray(head.counts, dtype=np.int64) * n) // length
    sizes = np.array([len(x) for x in lists.docs], dtype=np.int64)
    term = np.repeat(np.arange(len(lists)), sizes)
    none = np.array([], dtype=np.int64)
    doc, count = (np.concatenate([none, *(np.asarray(x, dtype=np.int64) for x in c)]) for c in (lists.docs, lists.counts))
    impact = np.repeat(lists.weight.to_numpy(dtype=np.int64), sizes) * ((1_000_000_000 * count) // (1000 * count + 12 * m[doc]))
    held = [len(x) for x in lists["items"]]
    asked = np.repeat(np.arange(len(lists)), held), np.concatenate([none, *(np.asarray(x, dtype=np.int64) for x in lists["items"])]), np.concatenate([none, *(np.asarray(x, dtype=np.int64) for x in lists.times)])
    by = np.argsort(asked[1], kind="stable")
    items, first = np.unique(asked[1][by], return_index=True)
    wanted = list(zip(items.tolist(), np.split(asked[0][by], first[1:]), np.split(asked[2][by], first[1:]), strict=True)) if len(items) else []
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    step = max(1, search.cells // max(1, len(lists)))
    for low in range(0, len(ids), step):
        inside = (doc >= low) & (doc < low + step)
        some = Lists(term[inside], doc[inside] - low, impact[inside], len(lists), min(step, len(ids) - low))
        for item, terms, times in wanted:
            before = best.get(item)
            least = int(before[1][-1]) if before is not None and len(before[1]) >= search.k else 0
            docs, scores, _ = some.best(terms, times, search.k, search.depth, least)
            docs = docs + low
            if before is not None:
                docs, scores = np.concatenate([before[0], docs]), np.concatenate([before[1], scores])
            docs, scores = docs[scores > 0], scores[scores > 0]
            of = top(ids[docs], absent[docs], scores, search.k)
            best[item] = docs[of], scores[of]
    out = [(item, None if absent[d] else int(ids[d]), int(s)) for item, (docs, scores) in best.items() for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
    return pd.DataFrame({"item": pd.array([r[0] for r in out], "Int64"), "doc_id": pd.array([r[1] for r in out], "Int64"), "score": pd.array([r[2] for r in out], "Int64")})


def weight(df: Column, n: int) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * df + 1).cast("double"))).cast("long")


def ranked(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    queries = scratch.keep(query_terms(items))
    n_pairs = queries.count()
    words = queries.select("term").distinct()
    known = words.count() <= search.vocabulary
    lists = scratch.keep(index(docs, frozenset(r.term for r in words.toLocalIterator()) if known else None, search))
    heads = lists.where("term is null")
    n, length = heads.agg(F.sum(F.size("docs")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not n:
        none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        scratch.close()
        return none
    groups = max(1, -(-n_pairs // search.pairs))
    asked = queries.groupBy("term", F.pmod("item", F.lit(groups)).cast("int").alias("q")).agg(F.collect_list("item").alias("items"), F.collect_list("times").alias("times"))  # about search.pairs of each q
    postings = lists.where("term is not null")
    weights = postings.groupBy("term").agg(weight(F.sum(F.size("docs")), n).alias("weight"))
    asked = asked.join(weights, "term").where("weight > 0")
    postings = postings.join(F.broadcast(asked) if n_pairs <= BROADCAST_ROWS else asked, "term")
    empty = F.array().cast("array<long>")
    heads = heads.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumns({"items": empty, "times": empty, "weight": F.lit(0).cast("long")})
    found = postings.unionByName(heads).groupBy("block", "q").applyInPandas(lambda rows: search_block(rows, n, length, search), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)
    names = queries.select("item", "item_id").distinct()
    out = scratch.keep(best.join(F.broadcast(names) if n_pairs <= BROADCAST_ROWS else names, "item").select("item_id", "rank", "doc_id", "score"))
    scratch.drop(lists, queries)
    return out


#: The same result in SQL.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM.pattern}') AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM.pattern}') AS ts FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark) b),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(ts) AS term FROM items) t GROUP BY ALL),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n),
m AS (SELECT rid, doc_id, (75 + (25 * len(ts)::BIGINT * n) // l)::BIGINT AS m FROM d, s WHERE len(ts) > 0),
scores AS (
  SELECT item, item_id, rid, m.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
