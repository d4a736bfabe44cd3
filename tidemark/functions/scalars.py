"""Column functions: coercion, text, dates, bins, arithmetic. All stay in the JVM but for accent folding beyond the table and similarity ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# --- coercion


def to_number(c: Column) -> Column:
    """Double, or null for what isn't a number."""
    return c.try_cast("double")


def to_whole(c: Column) -> Column:
    """A whole number, halves to even; null for what isn't a number."""
    return F.bround(to_number(c)).cast("bigint")


def strict_whole(c: Column) -> Column:
    """A whole number; fractions become null, not rounded."""
    x = to_number(c)
    return F.when(x == F.floor(x), x.cast("bigint"))


def clean_id(c: Column) -> Column:
    """Trimmed text without a closing '.0'; null as ''."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\.0$", "")


def to_bool(c: Column) -> Column:
    """True for true, 1 and yes in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def to_bool_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), to_bool(c))


def non_blank(*cs: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in cs])


def conflict(a: Column, b: Column) -> Column:
    """Both are there and they differ."""
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    return ~blank(a) & ~blank(b) & (a != b)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b where b is above 0, else null."""
    return F.when(b > 0, a / b)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within the bounds; null stays null."""
    out = c
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(c.isNotNull(), out)


def reasons(*cases: tuple[Column, str], by: str = ";") -> Column:
    """The codes of the cases that hold, in their order."""
    return F.concat_ws(by, *[F.when(c, F.lit(code)) for c, code in cases])


def row_mean(cs: list[Column], least: int = 1) -> Column:
    there = F.filter(F.array(*[c.cast("double") for c in cs]), lambda x: x.isNotNull())
    return F.when(F.size(there) >= least, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def row_sum(cs: list[Column]) -> Column:
    """Sum of those that are there; null if none is."""
    any_ = reduce(lambda a, b: a | b, [c.isNotNull() for c in cs])
    return F.when(any_, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs]))


def finite(c: Column) -> Column:
    """c, or null if it is not a number or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


# --- text

#: Accented and barred letters, and the letters they are folded to.
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿðłøđıźżśćńąęčšžřůěťďňőű", "aaaaaaceeeeiiiinooooouuuuyydlodizzscnaecszruetdnou"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), "ß", "ss"), "æ", "ae"), "œ", "oe")


@F.pandas_udf(StringType())
def decomposed(c):  # noqa: ANN001, ANN201
    """Letters without any accents, by compatibility decomposition; what has none (ł, ø) stays."""
    import unicodedata

    return c.map(lambda t: None if t is None else t if t.isascii() else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def name_key(c: Column) -> Column:
    """Folded letters and digits only; '&' reads as 'and'."""
    return F.regexp_replace(F.regexp_replace(fold(c), "&", "and"), "[^a-z0-9]+", "")


def token_signature(c: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)), "|")


def strip_tags(c: Column) -> Column:
    """Text between tags, the five common entities resolved."""
    out = F.regexp_replace(c, "<[^>]+>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def first_href(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, 'href="([^"]*)"', 1), F.lit(""))


def money(c: Column) -> Column:
    """Digits, sign and point of an amount; null for a dash or nothing."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9,.-]", ""), ",", "").try_cast("double")


def surrogate_key(*cs: Column) -> Column:
    """SHA-256 of the parts; null counts as ''."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]), 256)


def surrogate_key_or_null(*cs: Column) -> Column:
    """SHA-256 of the parts; null if any part is."""
    parts = [x for c in cs for x in (F.lit("|"), c.cast("string"))][1:]
    return F.sha2(F.concat(*parts), 256)


def natural_key(*cs: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])


#: The entities of HTML that are resolved, the ampersand's last so that nothing is resolved twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    """A text with the common entities of HTML resolved."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def null_token(c: Column) -> Column:
    """Blank, or a word that stands for a missing value."""
    return F.lower(F.trim(c)).isin("", "na", "n/a", "nan", "null", "none", "-")


def shape_of(c: Column) -> Column:
    """A leading '4-3-3' or the like; null without."""
    return F.nullif(F.regexp_extract(c, r"^(\d(?:-\d)+)", 1), F.lit(""))


@F.pandas_udf(DoubleType())
def similarity_ratio(a, b):  # noqa: ANN001, ANN201
    """Twice the matching characters by the characters of both, matches as difflib finds them."""
    from difflib import SequenceMatcher

    return a.combine(b, lambda x, y: None if x is None or y is None else SequenceMatcher(None, x, y).ratio())


# --- dates


def season_start(d: Column, first_month: int = 7) -> Column:
    """The year in which the season of a date began."""
    return F.year(d) - (F.month(d) < first_month).cast("int")


def season_label(d: Column, first_month: int = 7) -> Column:
    y = season_start(d, first_month)
    return F.concat(F.lpad((y % 100).cast("string"), 2, "0"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def completed_season(d: Column) -> Column:
    """Start year of the latest season that was over on 30 June."""
    return F.when(F.to_date(d) >= F.make_date(F.year(d), F.lit(6), F.lit(30)), F.year(d) - 1).otherwise(F.year(d) - 2)


def market_window(d: Column) -> Column:
    m = F.month(d)
    return F.when(m.between(6, 10), "summer").when(m.between(1, 2), "winter").otherwise("other")


def clock_minutes(c: Column) -> Column:
    """Minutes of 'mm:ss' or 'hh:mm:ss'; null for anything else."""
    parts = F.split(c, ":")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 2, at(1) + at(2) / 60).when(F.size(parts) == 3, at(1) * 60 + at(2) + at(3) / 60)


def season_years(c: Column, pivot: int = 40) -> Column:
    """Start year of '19/20', '2019/20', '2019-2020' or '2019'; two digits up to the pivot are of this century."""
    first = F.regexp_extract(c, r"^\s*(\d{4}|\d{2})\b", 1)
    y = first.try_cast("int")
    return F.when(F.length(first) == 4, y).when((F.length(first) == 2) & (y <= pivot), y + 2000).when(F.length(first) == 2, y + 1900)


def age_years(birth: Column, at: Column, year: float = 365.25, low: float | None = None, high: float | None = None) -> Column:
    age = F.datediff(at, birth) / year
    return age if low is None else F.when(age.between(low, high), age)


def observable(anchor: Column, days: int, cutoff: Column) -> Column:
    """Whether the whole horizon after the anchor is covered."""
    return F.date_add(F.to_date(anchor), days) <= F.to_date(cutoff)


# --- bins and arithmetic


def bin_right(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edges[i], edges[i + 1]] that c is in; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def bin_left(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval [edges[i], edges[i + 1]) that c is in; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((c >= low) & (c < high), label).otherwise(out)
    return out


def logit(p: Column, floor: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log(a / b))


def close_to(a: Column, b: Column, rel: float = 1e-5, abs_: float = 1e-8) -> Column:
    return F.abs(a - b) <= abs_ + rel * F.abs(b)


def smoothed(successes: Column, trials: Column, classes: int = 2) -> Column:
    """(k + 1) / (n + classes)"""
    return (successes + 1) / (trials + classes)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a polygon given by two arrays."""
    n = F.size(xs)
    step = lambda i: F.element_at(xs, i) * F.element_at(ys, i % n + 1) - F.element_at(xs, i % n + 1) * F.element_at(ys, i)
    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + step(i))) / 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is zero."""
    return safe_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def masked_cosine(a: Column, b: Column) -> Column:
    """Cosine over the places where neither array is null; null without such a place or where either is zero there."""
    both = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    return cosine(F.transform(both, lambda z: z["a"]), F.transform(both, lambda z: z["b"]))


def masked_gap(a: Column, b: Column) -> Column:
    """Mean absolute difference over the places where neither array is null; null without one."""
    gaps = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda g: g.isNotNull())
    return safe_divide(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g), F.size(gaps))


def pava_decreasing_3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The nearest non-increasing triple, by maxima of minima of means."""
    ab, bc, abc = (a + b) / 2, (b + c) / 2, (a + b + c) / 3
    first = F.greatest(a, ab, abc)
    second = F.least(F.greatest(b, bc), F.greatest(ab, abc))
    third = F.least(c, bc, abc)
    return first, second, third
