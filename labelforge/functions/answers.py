"""Prompt extraction and answer parsing as column expressions; all of them also run on streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.functions.text import strip

# Markers, placeholders and request settings of the prompt format.
PROMPT_PATTERN = r"(?s)\[STARTPROMPT\](.*?)\[ENDPROMPT\]"
PROMPT_MISSING = "No prompt found between [STARTPROMPT] and [ENDPROMPT]."
TEXT_SLOT = "[[Insert Text Here]]"
QUERY_SLOT = "[[Insert Query Here]]"
PAGES_SLOT = "[[Insert List of Page Content Here]]"
ANSWER_PATTERN = r"Explanation:\s*.*\nLabel:\s*\[.*?\]"
LABEL_PATTERN = r"Label:\s*(.*)"
EVIDENCES_PATTERN = r"Evidences:\s*(.*)"
EXPLANATION_PATTERN = r"(?s)Explanation:\s*(.*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_prompt(c: Column | str) -> Column:
    """Text between the prompt markers, or the fixed message."""
    text = _col(c)
    return F.when(text.rlike(PROMPT_PATTERN), strip(F.regexp_extract(text, PROMPT_PATTERN, 1))).otherwise(PROMPT_MISSING)


def swap_label_and_explanation(c: Column | str) -> Column:
    """Explanation line before label line: the think-first variant of an answer format."""
    return F.regexp_replace(_col(c), r"(Label:[^\n]*)\n(Explanation:[^\n]*)\n", "$2\n$1\n")


def parse_label(c: Column | str, pattern: str = LABEL_PATTERN, keep_brackets: bool = False) -> Column:
    """First line after ``Label:`` without brackets; null when there is none."""
    text = _col(c)
    found = F.regexp_extract(text, pattern, 1)
    if not keep_brackets:
        found = F.translate(found, "[]", "")
    return F.when(text.rlike(pattern), strip(found))


def parse_explanation(c: Column | str) -> Column:
    """All text after ``Explanation:``; null when there is none."""
    text = _col(c)
    return F.when(text.rlike(EXPLANATION_PATTERN), strip(F.regexp_extract(text, EXPLANATION_PATTERN, 1)))


def parse_evidences(c: Column | str) -> Column:
    """First line after ``Evidences:``, brackets kept."""
    return parse_label(c, EVIDENCES_PATTERN, keep_brackets=True)


def repair_label(label: Column, aliases: Mapping[str, str] = {}, first_word: bool = False, default: str | None = None) -> Column:
    """Per-task fix-ups of a parsed label: near-miss spellings, first word only, a default for unparsable answers."""
    for wrong, right in aliases.items():
        label = F.replace(label, F.lit(wrong), F.lit(right))
    if first_word:
        label = F.element_at(F.split(label, " "), 1)
    return F.coalesce(label, F.lit(default)) if default is not None else label


def split_answer(c: Column | str, lower: bool = False) -> Column:
    """Comma-separated answer to a trimmed label list."""
    parts = F.transform(F.split(_col(c), ","), strip)
    return F.transform(parts, F.lower) if lower else parts


def transcript_tail(c: Column | str) -> Column:
    """Answer part of a raw generation: what follows the last header mark, without asterisks.

    The mark is followed by two signs that do not belong to the answer.
    """
    tail = F.substring_index(_col(c), "end_header_id", -1)
    return F.replace(F.substr(tail, F.lit(3)), F.lit("*"), F.lit(""))
