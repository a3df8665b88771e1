"""Quality rules with adaptive thresholds.

The counts of a text come from built-in functions on arrays within its row. Their rates are sketched by language and source
with mergeable quantile sketches (KLL). No cutoff is stated: each group's fences stand where its own distribution breaks, at
a step between neighbouring quantiles that is wide against the group's own spread, and a group without a break loses no row.
The fences are joined back. There is no Python in it, and no row of words: the only shuffles are those of sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, text_or_empty
from .exact_dedup import normalised

#: Marks that count as symbols. Fixed values.
SYMBOLS = r"[#*$%&|<>]"
#: Rates and the counts that they are made of.
RATES = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words", "word_length": "word_chars"}
#: Rates that may be too low as well.
BOTH_SIDES = {"word_length"}
#: Ranks, in thousandths, of the quantiles that are looked at: percentiles, and finer ones at the ends.
GRID = [0, 1, 5, *range(10, 1000, 10), 995, 999, 1000]
#: Ranks whose distance is a group's spread; the next pair counts where that of the one before is 0, as among many copies.
SPREADS = [(200, 800), (50, 950), (0, 1000)]
#: Sketches of a group that are merged by one task, before these are merged.
PARTS = 64


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable keeps it, where a repeated expression would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    for c in ("\t", "\n", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _covered(at: Column) -> Column:
    """Words in the 3-word windows that begin at the sorted places `at`."""
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
    return F.aggregate(at, first, step, lambda a: a["n"])


def _repeated(hashes: Column) -> Column:
    """Sorted places whose value occurs elsewhere in hashes."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def neighbours(s: Column) -> Column:
        same = F.filter(s, lambda e, j: F.get(s, j - 1)["x"].eqNullSafe(e["x"]) | F.get(s, j + 1)["x"].eqNullSafe(e["x"]))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    return _let(placed, neighbours)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, first ones included; windows are told apart by 64-bit hashes within one text."""

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        count = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(_repeated(h))).otherwise(F.lit(0)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(count)

    return _let(words, of)


def counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each row."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    both = _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, both.alias("_w"), F.length(normalised(text)).alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), dup.alias("n_dup_lines"))
    return rows.select("doc_id", *keep, F.col("_w.n").cast("long").alias("n_words"), *(F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")), F.col("_w.r").cast("long").alias("n_repeat_words"))


def rates(rows: DataFrame) -> DataFrame:
    """rows with RATES: logarithms of counts a word. Half a count and a word are added, so that no count has a logarithm too, one
    that depends on the text's length: groups of which most rows have none still have a spread."""
    return rows.withColumns({r: F.log((F.col(c) + F.lit(0.5)) / (F.col("n_words") + 1)) for r, c in RATES.items()})


def sketches(rows: DataFrame, k: int = 2048) -> DataFrame:
    """(lang, source, n, <rate>) of rows as rates() has them: for each group its number of rows and a KLL sketch of each rate.

    A task sends one sketch for each group and rate. They are merged in PARTS parts a group, then these: no task merges the
    sketches of all others. A sketch's ranks are exact up to k rows of a group, and right to about 0.2 % beyond, by
    random choices, so that fences can then differ a little from run to run.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    parts = rows.groupBy("lang", "source", part.alias("part")).agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r, k).alias(r) for r in RATES))
    return _merged(parts, "lang", "source")


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(r).alias(r) for r in RATES))


def _fenced(groups: DataFrame, keys: tuple[str, ...], width: float) -> DataFrame:
    """(keys, n, <rate>_lo, <rate>_hi) of groups with sketches."""
    out = [*keys, "n"]
    ranks = F.array(*(F.lit(g / 1000.0) for g in GRID))
    last, middle, inf = len(GRID) - 1, GRID.index(500), F.lit(float("inf"))

    def fence(q: Column, spread: Column, up: bool) -> Column:
        """The middle of the first wide step from the median on, or infinity."""
        places = range(middle, last) if up else range(middle - 1, -1, -1)
        wide = F.filter(F.array(*map(F.lit, places)), lambda i: F.get(q, i + 1) - F.get(q, i) > spread * width)
        return F.coalesce((F.get(q, F.get(wide, 0)) + F.get(q, F.get(wide, 0) + 1)) / 2, inf if up else -inf)

    def fences_of(q: Column) -> Column:
        spreads = [F.nullif(F.get(q, GRID.index(hi)) - F.get(q, GRID.index(lo)), F.lit(0.0)) for lo, hi in SPREADS]
        return _let(F.coalesce(*spreads), lambda s: F.struct(fence(q, s, False).alias("lo"), fence(q, s, True).alias("hi")))

    for r in RATES:
        both = _let(F.kll_sketch_get_quantile_double(r, ranks), fences_of)
        out += [(both["lo"] if r in BOTH_SIDES else -inf).alias(f"{r}_lo"), both["hi"].alias(f"{r}_hi")]
    return groups.where("n > 0").select(*out)


def fences(groups: DataFrame, width: float = 1.5, least_rows: int = 50) -> DataFrame:
    """(lang, source, <rate>_lo, <rate>_hi) for each group of sketches().

    The median is inside; the fence on a side is the middle of the first step between neighbouring quantiles of GRID, going
    out from the median, that is wider than `width` spreads, a spread being the distance of the quantiles of SPREADS. Groups
    under least_rows have the fences of their language, all sources together, or, if that is under it too, of all rows.
    """
    groups = cut(groups)
    rename = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    own = _fenced(groups, ("lang", "source"), width)
    lang = rename(_fenced(_merged(groups, "lang"), ("lang",), width), "of_lang")
    whole = rename(_fenced(_merged(groups), (), width), "of_all")
    near = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang_lang")), "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    pick = lambda c: F.when(F.col("n") >= least_rows, F.col(c)).when(F.col("of_lang_n") >= least_rows, F.col(f"of_lang_{c}")).otherwise(F.col(f"of_all_{c}"))
    return near.select("lang", "source", *(pick(f"{r}_{side}").alias(f"{r}_{side}") for r in RATES for side in ("lo", "hi")))


def apply_rules(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, width: float = 1.5, least_rows: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, source).

    One row for each row of docs (doc_id, text; lang and source where there are such columns, null being a group of its own).
    base_failed: fewer than least_words words, or more than most_repeated per cent of the words in repeated windows. Sketches
    are taken of the other rows; kept is false for base_failed and for rows with a rate beyond its group's fence. Null and
    empty texts have no words and fail. Repeated rows, and rows of one doc_id, are rows like others. An empty table gives an
    empty result. Texts are read whole.
    """
    for c in ("lang", "source"):
        docs = docs.withColumn(c, F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string"))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = cut(counts(docs.select("doc_id", "text", "lang", "source"), ("lang", "source")).withColumn("base_failed", base))
    of_group = cut(fences(sketches(rates(rows.where("not base_failed"))), width, least_rows)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rates(rows).join(of_group, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for r in RATES:
        inside = inside & F.col(r).between(F.col(f"{r}_lo"), F.col(f"{r}_hi"))
    # A group without fences has no row that passes the base rules.
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "lang", "source")
