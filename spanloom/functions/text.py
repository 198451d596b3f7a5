"""Text scalars as column expressions. NFKC, which Spark SQL lacks, is taken from the ICU library
that Spark's collations use, in the JVM, for texts that hold a character outside ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.config import COMPOUND_PREFIXES, CURLY, PLAIN

SPACES = "   ​­"
LETTER = "A-Za-zÀ-ɏ"


def nfkc(col: Column) -> Column:
    form = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(col.rlike("[^\\x00-\\x7f]"), form).otherwise(col)


def normalize_text(col: Column, compat: bool = True) -> Column:
    """Form for matching: plain quotes and dashes, hyphens joined, spaces squeezed, lower case.
    Null gives an empty string."""
    col = F.coalesce(col, F.lit(""))
    col = F.translate(nfkc(col) if compat else col, CURLY, PLAIN)
    col = F.regexp_replace(col, "(?U)-\\s*\\n\\s*", "")
    col = F.regexp_replace(col, "(?U)\\s*-\\s*", "-")
    col = F.regexp_replace(col, "(?U)\\s+", " ")
    return F.lower(F.trim(col))


def clean_display(col: Column, compat: bool = True) -> Column:
    """Form for output: case, quotes and dashes stay; odd spaces, controls and runs go."""
    col = F.translate(nfkc(col) if compat else col, SPACES, "   ")
    col = F.regexp_replace(col, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.trim(F.regexp_replace(col, "(?U)\\s+", " "))


def broken_output_score(col: Column) -> Column:
    """How damaged a text looks: detached punctuation and lone letters."""
    rules = ["\\s+[.,;:!?)]", "[(„“\"']\\s+", f"(?<![{LETTER}0-9_])[{LETTER}]\\s+[{LETTER}]{{2,}}", f"(?<![{LETTER}0-9_])[{LETTER}]\\s+[{LETTER}]\\s+[{LETTER}]"]
    total = F.lit(0)
    for r in rules:
        total = total + F.regexp_count(col, F.lit(r))
    return F.coalesce(total, F.lit(0))


def boundary_score(col: Column) -> Column:
    starts = F.when(col.rlike("^[\\p{L}\\p{N}\"“‘(\\[]"), 0.5).otherwise(0.0)
    ends = F.when(col.rlike("[\\p{L}\\p{N}.!?\"”’)*\\]]\\z"), 0.5).otherwise(0.0)
    return F.coalesce(starts + ends, F.lit(0.0))


def looks_broken(token: Column) -> Column:
    return F.coalesce((F.length(token) < 3) | token.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]|[a-zäöüß][A-Z0-9/][a-zäöüß]|/"), F.lit(True))


def heading_like(col: Column) -> Column:
    """Short, no closing punctuation, 2 to 12 words, and mostly upper case or title case."""
    source = F.trim(F.coalesce(col, F.lit("")))
    norm = normalize_text(source)
    words = F.regexp_count(source, F.lit(f"[0-9{LETTER}]+"))
    letters = F.regexp_count(source, F.lit("\\p{L}"))
    upper = F.regexp_count(source, F.lit("\\p{Lu}"))
    title = ~source.rlike("(^|\\s)[^\\s0-9\\p{Lu}]")
    return (F.length(norm).between(1, 120) & ~source.rlike("[.!?;,]\\z") & words.between(2, 12) & (letters > 0) & ((upper / F.greatest(letters, F.lit(1)) >= 0.72) | title))


def is_line_break(px0: Column, py0: Column, x0: Column, y0: Column) -> Column:
    return (x0 < px0) | (y0 - py0 > 2.0)


def merges_hyphen(prev: Column, cur: Column) -> Column:
    """Whether a line's last word and the next line's first are two halves of one word: the whole
    piece before the hyphen is no prefix of a compound and long enough, a capital counting for a letter."""
    prefix = F.lower(F.substring(prev, F.lit(1), F.length(prev) - 1))
    long_enough = (F.length(prefix) >= 4) | (prefix == "vol") | ((F.length(prefix) >= 3) & prev.rlike("^\\p{Lu}"))
    return F.coalesce(prev.endswith("-") & cur.rlike("^\\p{Ll}") & ~prefix.isin(*COMPOUND_PREFIXES) & long_enough, F.lit(False))


def label_matches(label: Column, target: Column) -> Column:
    """A heading names a section if they are equal, one ends in the other, or it lies in the label."""
    return F.coalesce((label != "") & (target != "") & ((label == target) | label.endswith(target) | target.endswith(label) | label.contains(target)), F.lit(False))


def fmt_bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("(%s, %s, %s, %s)", *[F.bround(c, 0).cast("long").cast("string") for c in (x0, y0, x1, y1)])


def clip(box: tuple, page: tuple) -> Column:
    """The part of a box on its page, as a struct; null if there is none."""
    x0, y0, x1, y1 = F.greatest(box[0], page[0]), F.greatest(box[1], page[1]), F.least(box[2], page[2]), F.least(box[3], page[3])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def control_characters(col: Column, known: str) -> Column:
    """array<string>: control characters of a text that are no white space and not among ``known``."""
    return F.filter(F.regexp_extract_all(col, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), F.lit(0)), lambda c: ~F.lit(known).contains(c))
