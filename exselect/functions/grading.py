"""Answer extraction and grading as column expressions over (response, gold) tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from exselect.functions.bind import let

# Number patterns, choice letters and which corpora expect what.
NUMBER = "[+-]? *(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?"
LAST_NUMBER = "-?\\d*\\.?\\d+"
PLAIN_NUMBER = "-?\\d+/?\\.?\\d*"
LETTER = "(?U)\\b(A|B|C|D|E)\\b"
CHOICE_SETS = ("aqua", "sat", "mmlu_mathematics", "mmlu_physics", "mmlu_chemistry", "mmlu_biology")
NUMBER_SETS = ("gsm8k", "svamp", "deepmind", "simuleq")
MIXED_SETS = ("numglue",)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def _literal(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def extract_nums(text: Column | str) -> Column:
    """All numbers of a text as doubles, commas removed.

    A number is read after its leading zeros are cut, so a bare zero is no number; a signed integer
    with a leading zero is none either.
    """
    found = F.regexp_extract_all(_literal(_column(text), ",", ""), F.lit(NUMBER), F.lit(0))
    kept = F.filter(found, lambda n: ~n.rlike("^[+-] *0+[1-9]\\d*$"))
    clean = F.transform(kept, lambda n: F.regexp_replace(F.regexp_replace(n, "^[ 0]+", ""), " ", ""))
    return F.filter(F.transform(clean, lambda n: n.try_cast("double")), lambda x: x.isNotNull())


def find_formula(step: Column | str) -> Column:
    """Text between the single << and >>; null unless there is exactly one of each."""
    step = _column(step)
    single = (F.size(F.split(step, "<<")) == 2) & (F.size(F.split(step, ">>")) == 2)
    return F.when(single, F.regexp_extract(step, "(?s)<<(.*?)>>", 1))


def extract_answer(text: Column | str) -> Column:
    """The number after "#### ", commas removed; null if there is none."""
    found = F.regexp_extract(text, "#### (-?[0-9.,]+)", 1)
    return F.nullif(_literal(found, ",", ""), F.lit(""))


def delete_extra_zero(number: Column | str) -> Column:
    """Canonical number text (3.0 to 3, 2.50 to 2.5); other text is passed on."""
    number = _column(number)
    value = _strip(number).try_cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(value, "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    return F.coalesce(short, number)


def strip_latex(text: Column | str) -> Column:
    """Clean a LaTeX answer: fractions, roots, units, signs and spaces."""
    s = _column(text)
    for old, new in (
        ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
        ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
    ):
        s = _literal(s, old, new)
    s = F.substring_index(s, "\\text{ ", 1)
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        s = _literal(s, old, new)
    s = F.regexp_replace(s, "^\\.", "0.")
    s = F.regexp_replace(s, "^[^=]{0,2}=([^=]*)$", "$1")
    s = F.regexp_replace(s, "\\\\sqrt(?!\\{|\\\\sqrt)(.)", "\\\\sqrt{$1}")
    s = let(_literal(s, " ", ""), _brace_fractions)
    return F.regexp_replace(s, "^(0|-?[1-9]\\d*)/(0|-?[1-9]\\d*)$", "\\\\frac{$1}{$2}")


def _brace_fractions(s: Column) -> Column:
    r"""Braces around the two characters after \frac; a one-letter tail leaves the whole text as it is."""
    cut_short = s.rlike("\\\\frac(?!\\\\frac)[^{](?=\\\\frac|$)")
    braced = F.regexp_replace(s, "\\\\frac(?!\\{|\\\\frac)(.)\\{", "\\\\frac{$1}{")
    braced = F.regexp_replace(braced, "\\\\frac(?!\\{|\\\\frac)(.)(.)", "\\\\frac{$1}{$2}")
    return F.when(cut_short, s).otherwise(braced)


def _braced(text: Column) -> Column:
    """Inside of the brace a text starts with, nested braces kept; an open brace runs to the end."""
    pieces = F.regexp_extract_all(text, F.lit("[{}]|[^{}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def step(acc, piece):
        move = F.when(piece == "{", F.lit(1)).when(piece == "}", F.lit(-1)).otherwise(F.lit(0))
        depth = acc["depth"] + move
        done = acc["done"] | (depth == 0)
        outer = (acc["depth"] == 0) | done
        return F.struct(
            depth.alias("depth"), done.alias("done"),
            F.when(outer, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def boxed_content(text: Column | str) -> Column:
    """What follows the last "boxed": its brace, or the text up to a dollar sign; cleaned."""

    def content(tail: Column) -> Column:
        inner = F.when(tail.startswith("{"), _braced(tail)).otherwise(_strip(F.substring_index(tail, "$", 1)))
        return strip_latex(inner)

    return let(F.element_at(F.split(_column(text), "boxed"), -1), content)


def _trim_end(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\\.$", ""), "/$", "")


def _after(text: Column, words: str) -> Column:
    return _strip(F.element_at(F.split(text, words), -1))


def extract_math_answer(text: Column | str) -> Column:
    """After "The answer is", else inside the last box, else the last number."""
    text = _column(text)
    numbers = F.regexp_extract_all(text, F.lit(LAST_NUMBER), F.lit(0))
    first = (
        F.when(text.contains("The answer is "), _after(text, "The answer is "))
        .when(text.contains("the answer is "), _after(text, "the answer is "))
        .when(text.contains("boxed"), boxed_content(text))
        .otherwise(F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit("")))
    )
    return let(
        strip_latex(_trim_end(first)),
        lambda clean: F.when(clean.contains("boxed"), boxed_content(clean)).otherwise(clean),
    )


def answer_clean(dataset: Column | str, triggers: Iterable[str], text: Column | str) -> Column:
    """Final answer of a response, by what its corpus expects; null for an unknown corpus."""
    dataset, text, triggers = _column(dataset), _column(text), tuple(triggers)
    few_shot = F.lit(False)
    for trigger in triggers:
        seen = (F.length(text) - F.length(_literal(text, trigger, ""))) / len(trigger)
        few_shot = few_shot | (seen > 1)
    chunk = F.when(few_shot, F.substring_index(text, "\n\n", 1)).otherwise(text)

    def candidates(tail: Column) -> Column:
        letters = F.regexp_extract_all(F.upper(tail), F.lit(LETTER), F.lit(1))
        plain = F.array(F.regexp_replace(_strip(tail), "^\\.+|\\.+$", ""))
        numbers = F.transform(
            F.regexp_extract_all(_literal(tail, ",", ""), F.lit(PLAIN_NUMBER), F.lit(0)), delete_extra_zero
        )
        return (
            F.when(dataset.isin(*CHOICE_SETS), let(letters, lambda x: F.when(F.size(x) > 0, x).otherwise(plain)))
            .when(dataset.isin(*NUMBER_SETS), numbers)
            .when(dataset.isin(*MIXED_SETS), let(letters, lambda x: F.when(F.size(x) > 0, x).otherwise(numbers)))
        )

    def choose(pieces: Column) -> Column:
        tail = let(
            F.element_at(pieces, -1),
            lambda t: F.when(t.contains("="), _strip(F.element_at(F.split(t, "="), -1))).otherwise(t),
        )
        place = F.when(F.size(pieces) > 1, F.lit(1)).otherwise(F.lit(-1))
        return let(
            let(tail, candidates),
            lambda found: F.when(
                found.isNotNull(), _trim_end(F.coalesce(F.try_element_at(found, place), F.lit("")))
            ),
        )

    math = F.when(text == "", text).otherwise(extract_math_answer(text))
    return F.when(dataset == "math", math).otherwise(let(F.split(chunk, "|".join(triggers)), choose))


def floatify(text: Column | str) -> Column:
    """Number of a text, null if it is none."""
    return _strip(_column(text)).try_cast("double")


def number_it(text: Column | str) -> Column:
    r"""Number of an answer: plain, with commas, a/b, or \frac{a}{b}."""
    text = _column(text)
    plain = F.when(
        text.contains("frac"), F.regexp_replace(text, "\\\\frac\\{([^{}]+)\\}\\{([^{}]+)\\}", "$1/$2")
    ).otherwise(_literal(text, ",", ""))
    ratio = "^\\s*(-?[0-9.]+)\\s*/\\s*(-?[0-9.]+)\\s*$"
    top = F.regexp_extract(plain, ratio, 1).try_cast("double")
    bottom = F.regexp_extract(plain, ratio, 2).try_cast("double")
    return F.coalesce(floatify(plain), F.try_divide(top, bottom))


def within_eps(value: Column, gold: Column, share: float = 0.04) -> Column:
    eps = F.abs(gold) * share
    return (value >= gold - eps) & (value <= gold + eps)


def compare_two_numbers(value: Column | str, gold: Column | str) -> Column:
    """Whole gold numbers match after half-even rounding, others within 4 percent; NaN never."""
    value, gold = _column(value), _column(gold)
    same = F.when(gold == F.floor(gold), F.bround(value) == gold).otherwise(within_eps(value, gold))
    return F.coalesce(~F.isnan(value) & same, F.lit(False))


def grade(answer: Column | str, gold_text: Column | str, gold_number: Column | str) -> Column:
    """Equal text, else equal numbers."""
    answer, gold_text, gold_number = _column(answer), _column(gold_text), _column(gold_number)
    numeric = let(number_it(answer), lambda number: F.when(
        gold_number.isNotNull() & number.isNotNull(), compare_two_numbers(number, gold_number)
    ).otherwise(False))
    return F.coalesce((answer == gold_text), F.lit(False)) | numeric
