"""Row functions on texts: code fences, scripts, markup, instruction tags and answer choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fenced block, and the scripts that count as CJK or Cyrillic.
FENCE = "(?s)(`{3,}.*?\\n)(.*?)(\\n`{3,})"
WIDE_SCRIPT = "[\\x{4e00}-\\x{9fff}\\x{0400}-\\x{04ff}]"
# Private-use characters: a segment starts here, and it is code.
CUT, CODE = "\ue000\ue001", "\ue002"


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def code_segments(text: Column | str) -> Column:
    """Array of (segment, is_code) in text order; fences and empty prose are left out."""
    marked = F.regexp_replace(text, FENCE, f"{CUT}{CODE}$2{CUT}")
    parts = F.transform(
        F.split(marked, CUT),
        lambda p: F.struct(
            F.when(p.startswith(CODE), p.substr(F.lit(2), F.length(p)))
            .otherwise(p).alias("segment"),
            p.startswith(CODE).alias("is_code"),
        ),
    )
    return F.filter(parts, lambda p: p["is_code"] | (p["segment"] != ""))


def split_text_and_code(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, segment, is_code), one row per segment."""
    return df.select(id_col, F.posexplode(code_segments(text_col)).alias("pos", "s")).select(
        id_col, "pos", "s.segment", "s.is_code"
    )


def has_wide_script(text: Column | str) -> Column:
    """True where the text holds a CJK or Cyrillic letter."""
    return _column(text).rlike(WIDE_SCRIPT)


def wide_lines(text: Column | str) -> Column:
    """Number of lines holding such a letter."""
    return F.size(F.filter(F.split(text, "\\r\\n|\\n|\\r"), lambda line: line.rlike(WIDE_SCRIPT)))


def normalize_markup(text: Column | str) -> Column:
    r"""\( \) and \[ \] become $ $; heading marks of up to three # disappear."""
    inline = F.regexp_replace(text, "(?s)\\\\\\((.*?)\\\\\\)", "\\$$1\\$")
    display = F.regexp_replace(inline, "(?s)\\\\\\[\\s*(.*?)\\s*\\\\\\]", "\\$$1\\$")
    return F.regexp_replace(display, "(?m)^(#{1,3})\\s*(.*)$", "$2")


def _tag(kind: str) -> str:
    return {"pot_prompt": " Let's write a program.", "": ""}.get(kind, " " + kind)


def add_instruction_tag(question: Column | str, kind: str) -> Column:
    return F.concat(_column(question), F.lit(_tag(kind)))


def remove_instruction_tag(question: Column | str, kind: str) -> Column:
    """Every occurrence goes; an empty kind removes single spaces, as the published form does."""
    return F.replace(_column(question), F.lit(_tag(kind) or " "), F.lit(""))


def choices_text(text: Column | str) -> Column:
    """The text after the last "Answer Choices:", cut at "Let's"."""
    tail = F.element_at(F.split(text, "Answer Choices:"), -1)
    return F.regexp_replace(F.regexp_replace(tail, "^\\s+|\\s+$", ""), "(?s)Let's.*$", "")


def recover_options(text: Column | str) -> Column:
    """The choices (A) to (D), and (E) if there, as an array."""
    options = choices_text(text)
    with_e = options.contains("(E)")

    def between(start: str, stop: str | None) -> Column:
        end = f"\\({stop}\\)" if stop else "$"
        found = F.regexp_extract(options, f"(?s)\\({start}\\)(.*?){end}", 1)
        return F.regexp_replace(found, "^\\s+|\\s+$", "")

    last = F.when(with_e, between("D", "E")).otherwise(between("D", None))
    letters = F.array(between("A", "B"), between("B", "C"), between("C", "D"), last)
    return F.when(with_e, F.concat(letters, F.array(between("E", None)))).otherwise(letters)
