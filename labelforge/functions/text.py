"""Text cleaning, counting and normalising."""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The replacement tokens and the length bounds of the cleaning step.
URL_TOKEN = "<URL>"
EMAIL_TOKEN = "<EMAIL>"
PHONE_TOKEN = "<PHONE>"
MIN_TOKENS = 5
MAX_TOKENS = 4000
MIN_TOKENS_PAGE = 40
MIN_PARAGRAPH_WORDS = 4

URL_PATTERN = r"(?:[Hh][Tt][Tt][Pp][Ss]?://|[Ff][Tt][Pp]://|(?:www|WWW|Www)\.)[^\s<>\"]+"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE_PATTERN = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b"
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"
NEVER = r"\x01\x02\x03\x04\x05\x06"  # a plain run of control signs: skipped over, never found
NON_ASCII = r"[^\x00-\x7F]"
WHITESPACE = " \t\n\r\f\x0b"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"  # word signs of every script

# Letters that fold to more than one ASCII letter, and typographic signs.
WIDE_FOLDS = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "…": "...", "€": "EUR", "™": "(tm)",
}
SIGN_FOLDS = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "–": "-", "—": "-", "‐": "-",
    "‑": "-", "−": "-", "•": "*", "·": "*", "×": "x", "÷": "/", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D",
    "đ": "d", "ı": "i",
}


def _single_letter_folds() -> dict[str, str]:
    """Every accented Latin letter below U+0250 that decomposes to one ASCII letter, by the Unicode rule."""
    folds = dict(SIGN_FOLDS)
    for code in range(0xA0, 0x250):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(base) == 1 and ord(base) < 128 and base != letter:
            folds[letter] = base
    return folds


_FOLDS = _single_letter_folds()
FOLD_FROM = "".join(_FOLDS)
FOLD_TO = "".join(_FOLDS.values())


# UTF-8 read as Windows-1252 shows a lead and a second sign. Second signs after the lead "Ã" stand for À..ÿ, those
# after "â€" for quotes, dashes and dots; after "Â" the second sign is the right one.
def _second_signs(letters: str, lead: str) -> tuple[str, str]:
    """(signs seen after ``lead``, letters they stand for), by encoding and decoding each letter."""
    seen, meant = "", ""
    for letter in letters:
        # Bytes Windows-1252 leaves open show up as control signs of the same number.
        sign = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in letter.encode("utf-8"))
        if sign.startswith(lead) and len(sign) == len(lead) + 1:
            seen, meant = seen + sign[-1], meant + letter
    return seen, meant


BROKEN = {
    "Ã": _second_signs("".join(chr(c) for c in range(0xC0, 0x100)), "Ã"),
    "â€": _second_signs("‘’“”–—…•", "â€"),
}
BROKEN_LEAD = "Ã[^ A-Za-z]|Â[\u00a0-\u00bf]|â€|â„¢|â‚¬"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove all leading and trailing whitespace (``trim`` only removes spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def _mender(lead: str, seen: str, meant: str):
    """Repair of one part of a text that was split at ``lead``; the first part had no lead."""
    def mend(part: Column, place: Column) -> Column:
        first = F.substring(part, 1, 1)
        mended = F.concat(F.translate(first, seen, meant), F.substr(part, F.lit(2)))
        is_known = (F.length(first) == 1) & F.contains(F.lit(seen), first)
        return F.when(place == 0, part).when(is_known, mended).otherwise(F.concat(F.lit(lead), part))

    return mend


def fix_unicode(c: Column | str) -> Column:
    """Undo UTF-8 that was read as Windows-1252. Clean rows only pay for one pattern test."""
    text = _col(c)
    fixed = F.replace(F.replace(text, F.lit("â„¢"), F.lit("™")), F.lit("â‚¬"), F.lit("€"))
    for lead, (seen, meant) in BROKEN.items():
        fixed = F.array_join(F.transform(F.split(fixed, lead), _mender(lead, seen, meant)), "")
    fixed = F.regexp_replace(fixed, "Â([\u00a0-\u00bf])", "$1")
    return F.when(text.rlike(BROKEN_LEAD), fixed).otherwise(text)


def _folded(text: Column) -> Column:
    folded = F.translate(text, FOLD_FROM, FOLD_TO)
    for letter, spelled in WIDE_FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return F.regexp_replace(folded, NON_ASCII, "")


def ascii_fold(c: Column | str) -> Column:
    """Closest ASCII spelling; what has none is dropped. ASCII rows only pay for one pattern test."""
    text = _col(c)
    return F.when(text.rlike(NON_ASCII), _folded(text)).otherwise(text)


def normalise_whitespace(c: Column | str) -> Column:
    """One space between words, one line feed between lines, nothing at the ends of lines and text.

    The patterns only match where something changes: a replacement per single space would be the larger cost.
    """
    text = F.regexp_replace(_col(c), r"[ \t\r\f]{2,}|[\t\r\f]", " ")
    text = F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n")
    return strip(text)


def clean_text(c: Column | str) -> Column:
    """Repair, fold to ASCII, mask URLs, e-mail addresses and phone numbers, tidy whitespace.

    Each pattern runs only on rows with a sign it needs, which a plain substring search finds far faster. The choice
    is in the pattern argument and not in a CASE around the call: a CASE would name its input twice, and a chain of
    them would double the generated code at every link.
    """
    raw = _col(c)
    text = F.when(raw.rlike(NON_ASCII), _folded(fix_unicode(raw))).otherwise(raw)
    has_url = raw.contains(":") | raw.contains("www.") | raw.contains("WWW.") | raw.contains("Www.")
    has_digits = raw.rlike("[0-9\u00b9\u00b2\u00b3]{3}")
    for needed, pattern, token in (
        (has_url, URL_PATTERN, URL_TOKEN), (raw.contains("@"), EMAIL_PATTERN, EMAIL_TOKEN), (has_digits, PHONE_PATTERN, PHONE_TOKEN)
    ):
        text = F.regexp_replace(text, F.when(needed, pattern).otherwise(NEVER), F.lit(token))
    return normalise_whitespace(text)


def count_tokens(c: Column | str) -> Column:
    """Words and signs; 0 for null or blank text."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(TOKEN_PATTERN)), F.lit(0)).cast("int")


def word_tokens(c: Column | str) -> Column:
    """Lower-cased words of two and more characters of any script, as the bag-of-words models see them."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), F.lit(0))


def remove_phrase(text: Column | str, phrase: Column | str) -> Column:
    """Drop every occurrence of a row's own phrase, ignoring case; regex signs in it are literal."""
    # signs beyond ASCII mean themselves; case is that of every script
    quoted = F.concat(F.lit("(?iu)"), F.regexp_replace(_col(phrase), r"([^A-Za-z0-9 \x{80}-\x{10FFFF}])", r"\\$1"))
    pattern = F.when(F.length(_col(phrase)) > 0, quoted).otherwise(NEVER)
    return strip(F.regexp_replace(_col(text), pattern, F.lit("")))


def normalise_hard(c: Column | str) -> Column:
    """No ASCII punctuation, lower case, single spaces."""
    bare = F.translate(_col(c), string.punctuation, "")
    return strip(F.regexp_replace(F.lower(bare), r"\s+", " "))


def last_part(c: Column | str) -> Column:
    """Text after the last comma, lower-cased: the matching key of a hierarchical label."""
    return F.lower(strip(F.element_at(F.split(_col(c), ","), -1)))


def parse_string_list(c: Column | str) -> Column:
    """``"['a', \"don't\"]"`` to ``array<string>``; null when it is not a list. An item may stand in either quote sign and
    hold the other one, or its own behind a backslash; ``None`` is a null item.
    """
    quoted = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\""
    text = strip(_col(c))
    whole = rf"(?s)^\[\s*+(?:(?:{quoted}|[^,'\"\[\]\s]++)\s*+(?:,\s*+|(?=\])))*+\]$"
    items = F.regexp_extract_all(F.substring(text, 2, 1 << 30), F.lit(rf"(?s){quoted}|[^,'\"\[\]\s]++"), F.lit(0))
    plain = F.transform(
        items, lambda x: F.when(x.rlike("^['\"]"), F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1")).when(x != "None", x)
    )
    return F.when(text.rlike(whole), plain)


def parse_votes(c: Column | str) -> Column:
    """The list behind ``'votes': [...]`` in a printed record; ``None`` becomes null."""
    body = F.regexp_extract(_col(c), r"'votes'\s*:\s*(?:array\()?\[([^\]]*)\]", 1)
    parts = F.split(body, ",")
    cleaned = F.transform(parts, lambda v: F.regexp_replace(strip(v), r"^'|'$", ""))
    return F.when(
        body != "", F.transform(cleaned, lambda v: F.when(v == "None", F.lit(None)).otherwise(v))
    )
