"""Quality rules: a threshold table compiled into one Spark projection, evaluated without user functions.

Words are maximal runs outside the six ASCII white-space characters. Nothing is shuffled: every figure of a document is
computed from its own row. Edge cases: a null or empty text has no words and no lines, all counts are 0 and every ratio
is 0, so it fails the length rule; a null in another column changes nothing; repeated rows get equal verdicts; an empty
table gives an empty result; extra columns are kept, but those with the name of a figure or verdict give way to it, where
these are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeforms.llm.shared import SPACE_PATTERN, packed

# Frequent function words of English, French, German and Spanish, by which running prose is told from lists.
STOP_WORDS = (
    "the be to of and that have with in is it for as was on are this by at from or an a "
    "le la les de des du un une et que qui dans pour par sur est pas au avec en elle "
    "der die das und zu den von ist mit im für auf dem ein eine nicht sich als auch es "
    "el los las del y que se con por para su al lo una no más"
).split()


@dataclass(frozen=True)
class Rule:
    """A figure has to lie within [least, most]; None: no bound on that side."""

    figure: str
    least: float | None = None
    most: float | None = None


#: The published rules of web-text cleaning, with bounds that hold for prose in each of the four languages.
RULES = (
    Rule("n_words", least=20),
    Rule("mean_word_chars", least=2, most=14),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.06),
    Rule("capital_ratio", most=0.4),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.3),
    Rule("stutter_ratio", most=0.2),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)
WINDOW = 8
#: An odd factor near 2^31, which spreads a CRC-32 over 63 bits without overflow.
SPREAD = 2147483629
SYMBOLS = "#*$%&|<>"
#: The stop words as they occur: plain, capitalised, and before a comma or full stop.
STOP_FORMS = sorted({v + mark for w in STOP_WORDS for v in (w, w.capitalize()) for mark in ("", ",", ".")})
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "capital_ratio", "dup_line_ratio", "repeat_word_ratio", "stutter_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(windows: Column, words: Column, width: int) -> Column:
    """How many words lie in windows that occur twice or more; windows: the hashes in order of their first word.

    Equal hashes only choose the windows that are looked at: these are then told apart by their words.
    """

    def repeats(s: Column) -> Column:
        """Of sorted structs (h, i) those whose h occurs twice or more: their i."""
        last = F.size(s) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])))
        return F.transform(twice, lambda k: F.get(s, k)["i"])

    def by_words(at: Column) -> Column:
        spelled = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("h"), i.alias("i"))))
        return let(spelled, lambda s: F.when(F.size(s) > 0, let(F.sort_array(repeats(s)), covered)).otherwise(0))

    def covered(at: Column) -> Column:
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda n, k: n + F.when(k == 0, width).otherwise(F.least(F.lit(width), F.get(at, k) - F.get(at, k - 1)))))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: let(repeats(s), by_words))


def word_id(word: Column) -> Column:
    """A number of 63 bits for a word, from its CRC-32; it needs no configuration lookup per call, which makes xxhash64 slow in lambdas. Different words may share it."""
    return F.crc32(word.cast("binary")) * F.lit(SPREAD)


def window_hashes(ids: Column, n: Column) -> Column:
    """The hash of each window of WINDOW = 8 words: exclusive or of the word ids, each shifted by its place, by doubling."""

    def doubled(x: Column, k: int, n: Column) -> Column:
        return F.zip_with(F.slice(x, 1, n - k), F.slice(x, k + 1, n - k), lambda p, q: p.bitwiseXOR(F.shiftleft(q, k)))

    return let(doubled(ids, 1, n), lambda two: let(doubled(two, 2, n - 1), lambda four: doubled(four, 4, n - 3)))


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts FIGURES (long) and the RATIOS (double)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in {*FIGURES, *RATIOS}]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^[\x20\x09-\x0D]*$"))
    a = docs.select(*keep, F.filter(F.split(t, SPACE_PATTERN), lambda w: w != "").alias("_w"), lines.alias("_l"), F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).alias("_s"), F.regexp_count(t, F.lit(r"\p{Lu}")).alias("_u"))
    b = a.select(*keep, "_l", "_s", "_u", "_w", F.size("_w").alias("_n"), F.size("_l").alias("_m"), F.array_join("_w", "").alias("_c"), F.transform("_w", word_id).alias("_h"))
    windows = F.when(F.col("_n") >= WINDOW, window_hashes(F.col("_h"), F.col("_n"))).otherwise(F.array().cast("array<bigint>"))
    c = b.withColumn("_x", windows)
    repeats = F.when(F.size(F.array_distinct("_x")) < F.size("_x"), repeated_words(F.col("_x"), F.col("_w"), WINDOW)).otherwise(0)
    words, lines, chars = F.greatest("_n", F.lit(1)), F.greatest("_m", F.lit(1)), F.greatest(F.length("_c"), F.lit(1))
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length("_c"),
        "n_symbols": F.col("_s"),
        "n_dup_lines": F.col("_m") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeats,
    }
    d = c.select(
        *keep,
        *(v.cast("long").alias(k) for k, v in counts.items()),
        (F.size(F.filter("_w", lambda w: w.isin(*STOP_FORMS))) / words).alias("stop_word_ratio"),
        (F.col("_u") / chars).alias("capital_ratio"),
        (F.size(F.filter(F.zip_with("_w", F.slice("_w", 2, F.greatest(F.col("_n") - 1, F.lit(0))), lambda x, y: x == y), lambda same: same)) / words).alias("stutter_ratio"),
        (F.size(F.filter("_l", lambda x: F.ltrim(x).rlike(r"^[-*•·]"))) / lines).alias("bullet_line_ratio"),
        (F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))) / lines).alias("ellipsis_line_ratio"),
        words.alias("_words"),
        lines.alias("_lines"),
    )
    return d.withColumns({
        "mean_word_chars": F.col("word_chars") / F.col("_words"),
        "symbol_ratio": F.col("n_symbols") / F.col("_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.col("_lines"),
        "repeat_word_ratio": F.col("n_repeat_words") / F.col("_words"),
    }).drop("_words", "_lines")


def compiled(rules=RULES) -> dict[str, Column]:
    """The threshold table as Boolean columns, true where a rule fails."""
    out = {}
    for r in rules:
        v = F.col(r.figure)
        out[r.figure] = (v < r.least if r.least is not None else F.lit(False)) | (v > r.most if r.most is not None else F.lit(False))
    return out


def judged(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with the figures, base_failed, failed (names of the rules that failed, in the table's order) and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(bad, F.lit(k)) for k, bad in compiled(rules).items())), lambda x: x.isNotNull())
    return with_figures(docs, text).withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def kept(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns only.

    The verdict passes through a generator of one row, through which Catalyst moves no filter; else it would copy the
    expressions of all figures into the filter, once for each use.
    """
    rows = judged(packed(docs), rules, f"_row.{text}").select(F.inline(F.array(F.struct("_row", "kept"))))
    return rows.where("kept").select("_row.*")
