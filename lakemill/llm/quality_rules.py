"""Line-first rule cleaning with DataFrame expressions only.

Each line is judged by punctuation, navigation, symbol, capitals and boilerplate rules; failing lines are
removed, and a document that loses too much of its text is rejected. Document-wide base counts come along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: Phrases that mark page furniture; a line with one fails, whatever its case.
BOILERPLATE = (
    "lorem ipsum",
    "javascript",
    "cookie policy",
    "accept cookies",
    "use of cookies",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "skip to content",
    "sign up for our newsletter",
)
SPACES = "\t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SEPARATOR = "|>»·•"
TERMINAL = ".!?:;,…\"'”’»)]"


def count(text: Column, pattern: str) -> Column:
    """Matches of a regular expression."""
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, symbols: Column | None = None, separators: Column | None = None, phrases: Column | None = None) -> Column:
    """A line with words fails if any rule holds; a line without words never fails (it has no text to lose).

    * punctuation: twelve words or more with no punctuation mark anywhere in the line;
    * navigation: three or more of | > » · • standing alone, at least one for every five words;
    * symbols: over a tenth of its characters are in ``#*$%&|<>``;
    * capitals: five words or more, no lower-case letter, and two capitals in a row somewhere;
    * boilerplate: it contains one of ``BOILERPLATE``.

    ``symbols``, ``separators``, ``phrases``: whether the document has any of these at all, where that is known; the
    rule isn't tried if not. Each rule tries first what most lines fail to meet within a few characters.
    """
    known = lambda c, rule: rule if c is None else c & rule
    n_words = count(line, WORD)
    no_punctuation = ~line.rlike("[" + TERMINAL.replace("]", "\\]") + "]") & (n_words >= 12)
    n_separators = count(line, f"(?<=^|\\s)[{SEPARATOR}](?=\\s|$)")
    navigation = (n_separators >= 3) & (n_separators * 5 >= n_words)
    capitals = line.rlike("^[^\\p{Ll}]*$") & line.rlike("\\p{Lu}{2}") & (n_words >= 5)
    boilerplate = line.rlike("(?i)" + "|".join(BOILERPLATE))
    marked = count(line, f"[{SYMBOLS}]") * 10 > F.length(line)
    return no_punctuation | capitals | known(symbols, marked) | known(separators, navigation) | known(phrases, boilerplate)


def _fixed(df: DataFrame, names: list[str], drop: list[str]) -> DataFrame:
    """The columns ``names`` as rows of an inlined array of one struct, ``drop`` left out. A filter on them is then not
    pushed below, where the optimizer would put in their expressions anew at each use, within lambdas too."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in {*names, *drop}]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as empty: all counts 0, base_failed true. Words are runs of non-white-space (ASCII
    white space); n_repeat_words counts words in 8-word windows that occur at least twice in the text.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spaced = t
    for c in SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # One plain character to split at needs no regular expression.
    step = docs.withColumn("_words", F.array_remove(F.split(spaced, " "), ""))
    step = step.withColumn("_lines", F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_symbols": count(t, f"[{SYMBOLS}]").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # Hash of each word first: a window is then eight longs instead of eight strings.
            "_hashes": F.when(F.size("_words") >= 9, F.transform("_words", lambda w: F.xxhash64(w))),
        }
    )
    step = step.withColumn("_windows", F.expr("transform(sequence(0, size(_hashes) - 8), i -> xxhash64(" + ", ".join(f"_hashes[i + {k}]" for k in range(8)) + "))"))
    step = step.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN array_sort(transform(_windows, (h, i) -> struct(h, i))) END"))
    step = step.withColumn("_starts", F.expr("array_sort(transform(filter(_sorted, (e, j) -> coalesce(get(_sorted, j - 1).h = e.h, false) OR coalesce(get(_sorted, j + 1).h = e.h, false)), e -> e.i))"))
    covered = F.expr("aggregate(_starts, struct(0L AS total, -8 AS last), (acc, i) -> struct(acc.total + least(8, i - acc.last) AS total, i AS last), acc -> acc.total)")
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    step = step.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return _fixed(step, names, ["_words", "_hashes", "_windows", "_sorted", "_starts"])


def clean_lines(docs: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """Judge each line, then the document.

    Adds the base counts, n_lines, n_failed_lines, line_chars and lost_chars (characters of all lines with
    words, and of the failing ones), clean_text (the lines that stand, in order) and kept: false where
    base_failed or where more than ``most_lost`` of the lines' characters are lost. An empty or null text has
    no lines and an empty clean_text, and is not kept. Input columns stay, except of these same names, which
    are replaced.
    """
    step = with_counts(docs, text)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lower = F.lower(t)
    has = {"_symbols": F.col("n_symbols") > 0, "_separators": count(t, f"[{SEPARATOR}]") >= 3, "_phrases": reduce(Column.__or__, (F.contains(lower, F.lit(p)) for p in BOILERPLATE))}
    step = _fixed(step.withColumns(has), list(has), [])  # or they would be computed anew for each line
    step = step.withColumn("_fails", F.transform("_lines", lambda line: line_fails(line, *map(F.col, has))))
    step = step.withColumn("n_failed_lines", F.size(F.filter("_fails", lambda x: x)).cast("long"))
    some = F.col("n_failed_lines") > 0
    chars = lambda lines: F.length(F.concat_ws("", lines)).cast("long")
    step = step.withColumns(
        {
            "n_lines": F.size("_lines").cast("long"),
            "line_chars": chars(F.col("_lines")),
            "lost_chars": F.when(some, chars(F.filter("_lines", lambda _, i: F.get("_fails", i)))).otherwise(F.lit(0).cast("long")),
            "clean_text": F.concat_ws("\n", F.when(some, F.filter("_lines", lambda _, i: ~F.get("_fails", i))).otherwise(F.col("_lines"))),
        }
    )
    step = step.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= most_lost * F.col("line_chars")))
    return _fixed(step, ["n_lines", "n_failed_lines", "line_chars", "lost_chars", "clean_text", "kept"], ["_lines", "_fails", *has])
