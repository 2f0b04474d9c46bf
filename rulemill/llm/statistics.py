"""Statistics of whole documents as Spark expressions: no Python runs on the executors.

Words are `[^\\x20\\x09-\\x0D]+`. A null text is a text without words. Windows are compared by 64-bit hashes inside one
document only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\u000b\f\r"
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Columns that with_statistics() adds, all of them numbers that are 0 for a text without words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_distinct_words", "n_upper", "n_digits", "n_stops", "n_text_chars", "longest_word")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add COUNTS and MORE_COUNTS (each name behind `prefix`) to any table with a text column; row and column order stay."""
    p = prefix
    hidden = {k: f"__{k}" for k in ("text", "words", "hashes", "windows", "order", "spots")}
    t, words, hashes, windows = (F.col(hidden[k]) for k in ("text", "words", "hashes", "windows"))
    out = docs.withColumn(hidden["text"], F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(hidden["words"], F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn(hidden["hashes"], F.transform(words, lambda w: F.xxhash64(w)))
    h = hidden["hashes"]
    out = out.withColumn(hidden["windows"], F.when(F.size(hashes) >= WINDOW, F.expr(
        f"transform(slice({h}, 1, size({h}) - {WINDOW - 1}), (x, i) -> "
        f"xxhash64(x, {', '.join(f'{h}[i + {k}]' for k in range(1, WINDOW))}))")))
    # Most texts repeat no window; only the others are sorted.
    w = hidden["windows"]
    out = out.withColumn(hidden["order"], F.when(F.size(windows) > F.size(F.array_distinct(windows)), F.expr(
        f"sort_array(transform({w}, (x, i) -> struct(x AS h, i AS p)))")))
    o = hidden["order"]
    out = out.withColumn(hidden["spots"], F.expr(
        f"sort_array(transform(filter({o}, (x, i) -> coalesce(get({o}, i - 1).h = x.h, false) OR "
        f"coalesce(get({o}, i + 1).h = x.h, false)), x -> x.p))"))
    s = hidden["spots"]
    repeats = F.expr(
        f"aggregate({s}, struct(0L AS n, CAST(-{WINDOW} AS INT) AS p), "
        f"(a, x) -> struct(a.n + least({WINDOW}, x - a.p) AS n, x AS p), a -> a.n)")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__lines", lines)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n_chars = F.length(t)
    out = out.withColumns({
        f"{p}n_words": F.size(words).cast("long"),
        f"{p}word_chars": F.length(_without(t, SPACES)).cast("long"),
        f"{p}n_symbols": (n_chars - F.length(_without(t, SYMBOLS))).cast("long"),
        f"{p}n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        f"{p}n_repeat_words": F.coalesce(repeats, F.lit(0)).cast("long"),
        f"{p}n_lines": F.size("__lines").cast("long"),
        f"{p}n_distinct_words": F.size(F.array_distinct(hashes)).cast("long"),
        f"{p}n_upper": (n_chars - F.length(_without(t, upper))).cast("long"),
        f"{p}n_digits": (n_chars - F.length(_without(t, "0123456789"))).cast("long"),
        f"{p}n_stops": (n_chars - F.length(_without(t, ".,;:!?"))).cast("long"),
        f"{p}n_text_chars": n_chars.cast("long"),
        f"{p}longest_word": F.coalesce(F.array_max(F.transform(words, lambda x: F.length(x))), F.lit(0)).cast("long"),
    })
    return out.drop(*hidden.values(), "__lines")
