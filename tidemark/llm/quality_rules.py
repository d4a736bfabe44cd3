"""Quality rules: counts with fixed limits, and distance from what a language usually looks like.

A document's character-class histogram and its histogram of common words are compared with references of each
language by the Jensen-Shannon distance (base 2, 0 to 1). The references are sums over the whole corpus by language;
a document is as far as its nearest language. A histogram with too few observations isn't judged.

Defined cases: a null text counts as an empty one; an empty text has no words and fails the base rule. A null or
unknown language adds to no reference but is judged. With no reference at all (an empty table, or only nulls) the
distance rules don't apply. Repeated rows are judged alike, row by row. Other columns are kept by filter_documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, map_texts, small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"

#: Very common words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his are at from this or an have had but".split(),
    "de": "der die das und ist in zu den von mit nicht auf für im dem ein eine als sich des auch an werden aus er hat".split(),
    "fr": "le la les de des et un une du en que qui est pour dans au sur par pas il ne se ce plus avec son".split(),
    "es": "el la los las de del y que en un una por con para se no es al lo su como más o pero sus le".split(),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "other", "beyond_ascii")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Characters and words that a text needs before its histograms are judged.
    min_chars: int = 200
    max_class_distance: float = 0.25
    max_word_distance: float = 0.315


def class_table() -> np.ndarray:
    """The character class of each byte of UTF-8; a continuation byte has none, so beyond ASCII each character counts once."""
    of = np.full(256, len(CLASSES), dtype=np.int64)
    of[192:] = CLASSES.index("beyond_ascii")
    for i in range(128):
        c = chr(i)
        if c in "\n\r":
            k = "newline"
        elif c.isspace():
            k = "space"
        elif c in SYMBOLS:
            k = "symbol"
        elif c.isalpha():
            k = "upper" if c.isupper() else "lower"
        elif c.isdigit():
            k = "digit"
        else:
            k = "stop" if c in ".,;:!?'\"()-" else "other"
        of[i] = CLASSES.index(k)
    return of


_CLASS_OF = class_table()
_SYMBOL_BYTES = list(SYMBOLS.encode())
_SPACE_BYTES = [0x20, *range(0x09, 0x0E)]
#: Common words as they are written in lower case, capitalised and in upper case; the last slot is for all other words.
_INDEX = {form: i for i, w in enumerate(VOCABULARY) for form in (w.upper(), w.capitalize(), w)}


def byte_counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)


#: First bytes of the characters that str.split() takes for white space and the word pattern doesn't.
_OTHER_SPACE_BYTES = [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]


def words_of(text: str, of_bytes: np.ndarray) -> list[str]:
    """WORD.findall(text), by the faster split() where both agree."""
    return WORD.findall(text) if of_bytes[_OTHER_SPACE_BYTES].any() else text.split()


def class_counts(of_bytes: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS_OF, weights=of_bytes, minlength=len(CLASSES) + 1)[: len(CLASSES)]


def common_counts(words: list[str]) -> np.ndarray:
    found = [i for i in map(_INDEX.get, words) if i is not None]
    counts = np.bincount(np.array(found, dtype=np.int64), minlength=len(VOCABULARY) + 1)
    counts[-1] = len(words) - len(found)
    return counts


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the counts p from each row of the shares q."""
    p = p / p.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def references(docs: DataFrame) -> DataFrame:
    """(lang, kind, histogram): summed over every document of a known language; one row for each language and kind.

    Each task sends one row for each language it met, so the shuffle is a few rows a task.
    """
    n, v = len(CLASSES), len(VOCABULARY) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = sums.setdefault(lang, np.zeros(n + v, dtype=np.int64))
                of_bytes = byte_counts(text)
                got[:n] += class_counts(of_bytes).astype(np.int64)
                got[n:] += common_counts(words_of(text, of_bytes))
        rows = [(k, i, int(c)) for k, h in sums.items() for i, c in enumerate(h) if c]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "slot", "n"])

    small_batches(docs.sparkSession)
    known = docs.where(F.lower("lang").isin(*COMMON_WORDS)).select(F.coalesce("text", F.lit("")).alias("text"), F.lower("lang").alias("lang"))
    return known.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shares of classes and of common words, a row for each language that has any; of fixed size, so the driver may hold them."""
    n, v = len(CLASSES), len(VOCABULARY) + 1
    sums: dict[str, np.ndarray] = {}
    for lang, slot, k in references(docs).collect():  # at most languages x slots
        sums.setdefault(lang, np.zeros(n + v))[slot] = k
    share = lambda part: np.array([h[part] / h[part].sum() for _, h in sorted(sums.items()) if h[part].sum() > 0])
    return share(slice(0, n)), share(slice(n, n + v))


def duplicate_lines(text: str) -> int:
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif WORD.search(line):
            lines.add(line)
    return dup


def repeated_words(words: list[str]) -> int:
    """How many words stand in a window of three that the text has at least twice; equal words are told by 64-bit hashes."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    grams = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    often = times[back] > 1
    if not often.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def judge(text: str, refs: tuple[np.ndarray, np.ndarray], rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance (null where not judged)."""
    of_bytes = byte_counts(text)
    words = words_of(text, of_bytes)
    repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    classes, common = refs
    far = near = None
    if len(classes) and len(text) >= rules.min_chars:
        far = float(js_distance(class_counts(of_bytes), classes).min())
    if len(common) and len(words) >= rules.min_words:
        near = float(js_distance(common_counts(words), common).min())
    kept = not (failed or (far is not None and far > rules.max_class_distance) or (near is not None and near > rules.max_word_distance))
    return len(words), len(text) - int(of_bytes[_SPACE_BYTES].sum()), int(of_bytes[_SYMBOL_BYTES].sum()), duplicate_lines(text), repeat, failed, kept, far, near


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def score_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and the fields of judge() for each row of docs."""
    refs = fitted(docs)
    return map_texts(docs, lambda text: judge(text, refs, rules), FIELDS)


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    refs = fitted(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t or "", refs, rules)[6] for t in b.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


_COUNT = "length(regexp_replace(t, '{}', '', 'g'))"
_SETS = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "newline": r"[^\n\r]", "space": r"[^\t\x0b\x0c\x1c-\x1f ]", "symbol": "[^#*$%&|<>]", "stop": r"[^.,;:!?''\"()-]", "beyond_ascii": r"[\x00-\x7f]"}
#: The same result in SQL, with the default rules.
ORACLE_SQL = (
    r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) q WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(k - 1)::BIGINT AS n FROM lines GROUP BY 1),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM tri),
rep AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM often, (SELECT unnest([0, 1, 2]) AS o) q WHERE k > 1 GROUP BY 1),
vocabulary AS (SELECT unnest(["""
    + ", ".join(f"'{w}'" for w in VOCABULARY)
    + """]) AS v),
common AS (SELECT doc_id, lang, lower(w) AS slot, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS w FROM d) q WHERE lower(w) IN (SELECT v FROM vocabulary) AND (w = lower(w) OR w = upper(w) OR w = upper(left(w, 1)) || lower(substr(w, 2))) GROUP BY 1, 2, 3),
hist AS (
  SELECT doc_id, lang, 'word' AS kind, slot, n FROM common
  UNION ALL SELECT d.doc_id, d.lang, 'word', '(other)', len(ws) - coalesce((SELECT sum(n) FROM common c WHERE c.doc_id = d.doc_id), 0) FROM d
"""
    + "".join(f"  UNION ALL SELECT doc_id, lang, 'class', '{k}', {_COUNT.format(v)} FROM d\n" for k, v in _SETS.items())
    + "  UNION ALL SELECT doc_id, lang, 'class', 'other', length(t) - "
    + " - ".join(_COUNT.format(v) for v in _SETS.values())
    + """ FROM d),
docs AS (SELECT doc_id, kind, slot, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p FROM hist WHERE n > 0),
refs AS (SELECT lang, kind, slot, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q FROM hist WHERE lang IN ('en', 'de', 'fr', 'es') AND n > 0 GROUP BY 1, 2, 3),
pairs AS (SELECT DISTINCT a.doc_id, r.lang, a.kind FROM docs a JOIN refs r ON r.kind = a.kind),
sums AS (
  SELECT k.doc_id, k.lang, k.kind, sum(a.p * log2(a.p / ((a.p + coalesce(r.q, 0)) / 2)) + CASE WHEN r.q > 0 THEN r.q * log2(r.q / ((a.p + r.q) / 2)) ELSE 0 END - coalesce(r.q, 0)) + 1 AS js2
  FROM pairs k JOIN docs a ON a.doc_id = k.doc_id AND a.kind = k.kind LEFT JOIN refs r ON r.lang = k.lang AND r.kind = k.kind AND r.slot = a.slot GROUP BY 1, 2, 3),
far AS (SELECT doc_id, kind, min(sqrt(greatest(0, js2 / 2))) AS distance FROM sums GROUP BY 1, 2),
base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(t) AS chars
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR coalesce(chars >= 200 AND c.distance > 0.25, false) OR coalesce(n_words >= 50 AND w.distance > 0.315, false)) AS kept
FROM base b LEFT JOIN far c ON c.doc_id = b.doc_id AND c.kind = 'class' LEFT JOIN far w ON w.doc_id = b.doc_id AND w.kind = 'word'
"""
)

__all__ = ["Rules", "fitted", "filter_documents", "id_text", "judge", "references", "score_documents"]
