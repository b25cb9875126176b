"""Scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import StudyConfig


def local_timestamp(text: str) -> str:
    """SQL for the wall clock in a year-month-day and hour-minute-second string.

    Parts may stand apart by ``-``, ``/`` or ``.`` and by ``:``, or be written without
    separators; the hour may be followed by AM or PM, the whole by a UTC offset,
    which is then taken off. Anything else is NULL.
    """
    date, time = r"(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})", r"(\d{1,2}):?(\d{1,2}):?(\d{1,2}(?:[.]\d+)?)"
    marks = r"\s*([AaPp][Mm])?\s*(Z|[-+]\d{2}:?\d{2})?"
    # all separators or none, so that no digits of one part are taken for two
    whole_date, whole_time = r"(?=\d{4}[-/.]\d{1,2}[-/.]\d|\d{8}[\sTt])", r"(?=\d{1,2}:\d{1,2}:\d|\d{6})"
    form = rf"^\s*{whole_date}{date}(?:\s+|[Tt])\s*{whole_time}{time}{marks}\s*$"

    def part(n: int) -> str:
        return f"regexp_extract({text}, r'{form}', {n})"

    half = f"upper({part(7)})"
    hour = (
        f"CASE {half} WHEN 'PM' THEN CAST({part(4)} AS INT) % 12 + 12 WHEN 'AM' THEN CAST({part(4)} AS INT) % 12 "
        f"ELSE CAST({part(4)} AS INT) END"
    )
    wall = (
        f"try_cast(concat({part(1)}, '-', lpad({part(2)}, 2, '0'), '-', lpad({part(3)}, 2, '0'), ' ', "
        f"lpad(CAST({hour} AS STRING), 2, '0'), ':', lpad({part(5)}, 2, '0'), ':', "
        rf"CASE WHEN {part(6)} RLIKE r'^\d([.]|$)' THEN concat('0', {part(6)}) ELSE {part(6)} END) AS TIMESTAMP_NTZ)"
    )
    offset = f"replace({part(8)}, ':', '')"
    minutes = (
        f"CASE WHEN {offset} IN ('', 'Z') THEN 0 ELSE CAST(concat(left({offset}, 1), '1') AS INT) "
        f"* (CAST(substring({offset}, 2, 2) AS INT) * 60 + CAST(substring({offset}, 4, 2) AS INT)) END"
    )
    shifted = f"CAST({wall} - make_dt_interval(0, 0, {minutes}) AS TIMESTAMP_NTZ)"
    # hours above 12 carry no mark, and a plain ISO text, as most are, needs no taking apart
    plain = rf"{text} RLIKE r'^\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}([.]\d+)?$'"
    return f"CASE WHEN {plain} THEN try_cast({text} AS TIMESTAMP_NTZ) WHEN {text} RLIKE r'{form}' THEN {shifted} END"


def second_of_day(ts: str) -> str:
    """SQL for whole seconds since midnight, fractions cut off."""
    return f"hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})"


def finite_or_null(value: Column) -> Column:
    """NaN becomes NULL: Spark orders NaN above every number."""
    return F.when(~F.isnan(value), value)


def unescape(text: Column) -> Column:
    r"""Expand C escapes: ``\n``, ``\t``, octal ``\040``, hex ``\x0A``, ``\\`` ...

    An unknown escaped character stands for itself. Strings without a
    backslash, nearly all of them, skip the tokenisation.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+|\\)"), F.lit(1))
    # fixed values: the single-letter C escapes and their code points
    letters = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}

    def expand(token: Column) -> Column:
        second = F.substring(token, 2, 1)
        code = F.substring(token, 2, 3)
        expanded = F.when(~token.startswith("\\") | (F.length(token) == 1), token)
        expanded = expanded.when(
            token.startswith("\\x") & (F.length(token) > 2),
            F.char(F.conv(F.substring(token, 3, 2), 16, 10).cast("int")),
        )
        expanded = expanded.when(second.rlike("[0-7]"), F.char(F.conv(code, 8, 10).cast("int")))
        for letter, point in letters.items():
            expanded = expanded.when(second == letter, F.lit(chr(point)))
        return expanded.otherwise(second)

    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(tokens, expand), ""))


def level_range_labels(cfg: StudyConfig) -> list[str]:
    """Range labels in order: ``01--05``, ``05--10``, ... and the open one."""
    starts = range(0, cfg.range_cap, cfg.range_width)
    closed = [f"{max(s, 1):02d}--{s + cfg.range_width:02d}" for s in starts]
    return [*closed, f"{cfg.range_cap}+"]


def level_range(level: str, cfg: StudyConfig) -> str:
    """SQL for the label of the right-closed range holding ``level``; NULL when not positive."""
    labels = ", ".join(f"'{label}'" for label in level_range_labels(cfg))
    last = cfg.range_cap // cfg.range_width + 1
    slot = f"CAST(least(ceil({level} / {cfg.range_width}), {last}) AS INT)"
    return f"CASE WHEN {level} > 0 THEN element_at(array({labels}), {slot}) END"
