"""Personal data: fixed patterns, and terms that reveal a protected entity.

The base kinds are email, ip, card and phone. The values they match are the protected entities. Sanitisation by
information theory adds terms: for a word t in the context of an entity c, corpus counts estimate the pointwise mutual
information PMI(t; c) = log2(p(t, c) / (p(t) p(c))), at most the information of c itself, IC(c) = -log2 p(c). A term
whose PMI reaches the share `disclosure` of IC(c) gives c away and becomes a span of kind 'term' wherever it stands in
the context of c. p is over different texts, so that copies of one text are one witness everywhere. A value that stands in
one text alone has no such counts, so c is also the kind of a value and the domain of an e-mail address: their PMI pools
the texts of all their values, and a term that gives one of them away becomes a span too.

Defined cases: a null text counts as an empty one and has no spans; an empty table gives no rows. A term needs
`min_witnesses` different texts together with c. Spans follow from the text: rows of equal texts get the same ones, whatever
their doc_id is, null or repeated. Terms never overlap base spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, id_text

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the base kinds. The look-behinds only keep a search from starting inside a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]#*$%&|<>"


@dataclass(frozen=True)
class Sanitising:
    #: Words on each side of an entity that make its context.
    context_words: int = 8
    min_letters: int = 4
    min_witnesses: int = 2
    #: Share of the entity's information that a term may not reach.
    disclosure: float = 0.9


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the characters before each '@' as far as they may belong, then a domain with a dot."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind as listed and then by start."""
    out = [("email", *x) for x in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def entity(kind: str, matched: str) -> str:
    return f"{kind}:{matched.lower() if kind in ('email', 'ip') else digits_of(matched)}"


def entities(kind: str, matched: str) -> list[str]:
    """The value, its kind and an e-mail address's domain."""
    domain = [f"email@{matched.lower().rpartition('@')[2]}"] if kind == "email" else []
    return [entity(kind, matched), kind, *domain]


class Covered:
    """The places that spans cover, merged, so that a place is looked up by bisection."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i < len(self.ends) and self.starts[i] < end


class Words:
    """The words of a whole text, found once, however many spans ask for their neighbours."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in self.spans], [e for _, e in self.spans]

    def around(self, start: int, end: int, k: int) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) of the k words before and after a span, whole whatever their length, without edge punctuation, in lower case.

        Of a word that the span is a part of, what stands before and behind the span counts as words.
        """
        i, j = bisect.bisect_left(self.starts, start), bisect.bisect_right(self.ends, end)
        near = [(s, min(e, start)) for s, e in self.spans[max(0, i - k) : i]] + [(max(s, end), e) for s, e in self.spans[j : j + k]]
        for s, e in near:
            w = self.text[s:e].rstrip(EDGE)
            s += len(w) - len(w.lstrip(EDGE))
            if w := w.strip(EDGE):
                yield s, s + len(w), w.lower()


def context_terms(text: str, spans: list[tuple[str, int, int]], rule: Sanitising) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) for the terms around each span that no span covers."""
    out = []
    words, covered = Words(text), Covered(spans)
    for kind, s, e in spans:
        levels = entities(kind, text[s:e])
        for a, b, t in words.around(s, e, rule.context_words):
            if len(t) >= rule.min_letters and t.isalpha() and not covered.meets(a, b):
                out += [(c, t, a, b) for c in levels]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, its hash."""
    return id_text(docs).withColumn("text_key", F.xxhash64("text"))


def mentions(docs: DataFrame, rule: Sanitising) -> DataFrame:
    """text_key and for each document with base spans its (entity, term, start, end) around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if spans := base_spans(text):
                    rows += [(key, *x) for x in context_terms(text, spans, rule)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["text_key", "entity", "term", "start", "end"])

    return keyed_text(docs).select("text_key", "text").mapInArrow(run, "text_key long, entity string, term string, start int, end int")


def copied_texts(docs: DataFrame) -> DataFrame:
    """(text_key, copies) of each text that stands in more than one row."""
    return keyed_text(docs).groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1")


def term_frequency(docs: DataFrame, rule: Sanitising, copied: DataFrame | None = None) -> DataFrame:
    """(term_key, n): in how many different texts each word of the corpus stands. Counted in the JVM, partly before the shuffle.

    Each of the c copies of a text counts as 1 / c, so no (word, text) pairs are shuffled; the sums are rounded to the whole numbers they are.
    """
    copied = bounded(copied_texts(docs))[0] if copied is None else copied
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    weighed = keyed_text(docs).join(copied, "text_key", "left").select((1 / F.coalesce(F.col("copies"), F.lit(1))).alias("w"), F.explode(words).alias("term"))
    return weighed.where(F.length("term") >= rule.min_letters).groupBy(F.xxhash64("term").alias("term_key")).agg(F.round(F.sum("w")).cast("long").alias("n"))


def disclosing_terms(docs: DataFrame, found: DataFrame, rule: Sanitising) -> DataFrame:
    """The rows of found whose term discloses its entity."""
    scratch = Scratch(docs.sparkSession)
    copied, _ = bounded(scratch.keep(copied_texts(docs)))
    n_docs = docs.count() - (copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    pairs = found.select("entity", "term", "text_key").distinct().groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= rule.min_witnesses)
    named = found.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= rule.min_witnesses)
    named, _ = bounded(scratch.keep(named))  # kinds and large domains have many pairs
    shared = pairs.withColumn("term_key", F.xxhash64("term")).join(term_frequency(docs, rule, copied), "term_key").join(named, "entity")
    n = F.lit(float(max(n_docs, 2)))
    pmi = F.log2(F.col("both") * n / (F.greatest("n", "both") * F.col("n_entity")))
    # an entity of all texts has no information that a term could give away
    told = shared.where(F.col("n_entity") < n).where(pmi >= rule.disclosure * F.log2(n / F.col("n_entity"))).select("entity", "term")
    told = scratch.keep(told)
    out = scratch.keep(found.join(told, ["entity", "term"]))
    scratch.drop(told)
    return out


def _terms(docs: DataFrame, rule: Sanitising) -> DataFrame:
    """(text_key, terms): start and end of the disclosing terms of each text that has any."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(mentions(docs, rule))
    terms = disclosing_terms(docs, found, rule).groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    terms, _ = bounded(scratch.keep(terms))
    scratch.drop(found)
    return terms


def _kept(terms: list | None, base: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """Term spans within the text that no base span covers: should two texts share a hash, base spans still stay as they are."""
    covered = Covered(base)
    return [("term", t["start"], t["end"]) for t in (terms if terms is not None else []) if t["end"] <= len(text) and not covered.meets(t["start"], t["end"])]


def find(docs: DataFrame, rule: Sanitising = Sanitising()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term for each row of docs."""
    texts = keyed_text(docs).join(_terms(docs, rule), "text_key", "left").select("doc_id", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, added in zip(b.column("text").to_pylist(), b.column("terms").to_pylist(), strict=True):
                base = base_spans(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                extra = _kept(added, base, text)
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra), len(extra)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"])

    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def sanitised(docs: DataFrame, rule: Sanitising = Sanitising()) -> DataFrame:
    """docs with the text of every span generalised to its kind in brackets; all other columns stay.

    Base spans are those of each row's own text. Only terms are joined, by the hash of the text, so null and repeated doc_ids do no harm.
    """

    def generalise(text: str | None, terms) -> str | None:  # noqa: ANN001
        if not text:
            return text
        base = base_spans(text)
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in base + _kept(terms, base, text)):
            if e > at:
                out.append(text[at : max(s, at)])
                out.append(f"[{k.upper()}]" if s >= at else "")
                at = e
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def cleaned(text, terms):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([generalise(t, x) for t, x in zip(text, terms, strict=True)], dtype=object)

    keyed = docs.withColumn("__tm_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    terms = _terms(docs, rule).select(F.col("text_key").alias("__tm_key"), F.col("terms").alias("__tm_terms"))
    return keyed.join(terms, "__tm_key", "left").withColumn("text", cleaned("text", "__tm_terms")).select(*docs.columns)


__all__ = ["KINDS", "Sanitising", "base_spans", "disclosing_terms", "find", "mentions", "sanitised", "term_frequency"]
