"""String functions as Column expressions; only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

from .arrow import each

# Marks that editors put on titles of changed documents, in the order they are removed.
TITLE_MARKS_ANYWHERE = ["•", "●", "◆"]
TITLE_MARKS = [r"^\s*\*+", r"\*+\s*$", r"(?i)\(\s*modified\s*\)\s*$", r"(?i)\[\s*unsaved\s*\]\s*$", r"^\s*●\s*", r"(?i)\s*—\s*Edited$"]

# Secrets and what stands for them.
SECRETS = [
    (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9]{20,}", "[REDACTED_API_KEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{36,}", "[REDACTED_GH_TOKEN]"),
    (r"\bxox[bp]-[A-Za-z0-9\-]+", "[REDACTED_SLACK_TOKEN]"),
    (r"\bAIza[A-Za-z0-9\-_]{35}", "[REDACTED_GOOGLE_KEY]"),
    (r"\bAKIA[A-Z0-9]{16}", "[REDACTED_AWS_KEY]"),
]


@arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return each(lambda t: None if t is None else unicodedata.normalize("NFC", t), pa.string(), text)


def nfc(text: Column) -> Column:
    """Unicode normal form C, which Spark has no function for. Only texts beyond ASCII, which have others, go to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def keyword_form(text: Column, ascii_only: bool = False) -> Column:
    """What keyword search compares: NFC and lower case. ascii_only skips NFC for columns known to be normalised."""
    return F.lower(text if ascii_only else nfc(text))


def window_title(title: Column, normalised: bool = False) -> Column:
    """A window title without marks of unsaved changes, in lower case; '' for null."""
    out = F.trim(F.coalesce(title if normalised else nfc(title), F.lit("")))
    for mark in TITLE_MARKS_ANYWHERE:
        out = F.trim(F.replace(out, F.lit(mark), F.lit("")))
    for pattern in TITLE_MARKS:
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.lower(out)


def context_key(app: Column, title: Column, normalised: bool = False) -> Column:
    return F.concat(F.coalesce(app, F.lit("")), F.lit("::"), window_title(title, normalised))


def context_label(app: Column, title: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.trim(title), blank), F.nullif(app, blank), F.lit("unknown"))


# Words that name no place, windows that say nothing, and how much the role of a navigation element tells.
NAVIGATION_NOISE = "back forward search close cancel done more menu settings home refresh reload share add new open save".split()
COARSE_TITLES = ["", "untitled", "wechat", "slack", "discord"]
ROLE_PRIORITY = {"AXHeading": 100, "AXNavigationBar": 95, "AXBanner": 90, "AXRadioButton": 85, "AXTab": 85, "AXTabGroup": 75, "AXToolbar": 65, "AXTitleBar": 60}
OTHER_PRIORITY, LONGEST_PLACE = 50, 80


def enriched_title(title: Column, app: Column, nav: Column, windows: Column, places: Column | None = None) -> Column:
    """A title that says more than its app's name: `app - place` by the best of the navigation lines, else a window's line, else the title.

    nav and windows are arrays of lines, with or without their tags; places an array of (line, role). Of lines with one text the first counts.
    """
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    noise = lambda x: F.lower(F.trim(x)).rlike(rf"^({'|'.join(NAVIGATION_NOISE)})(\s|$)")
    lines_of = F.transform(F.coalesce(nav, F.array().cast("array<string>")), lambda x: F.struct(x.alias("line"), F.lit("AXStaticText").alias("role")))
    every = lines_of if places is None else F.concat(places, lines_of)
    priority = F.create_map(*[F.lit(x) for pair in ROLE_PRIORITY.items() for x in pair])
    cleaned = F.transform(every, lambda c: F.struct(F.coalesce(F.element_at(priority, c["role"]), F.lit(OTHER_PRIORITY)).alias("score"), F.trim(F.regexp_replace(c["line"], r"^\[Nav\]\s*", "")).alias("line")))
    told = F.filter(cleaned, lambda c: (c["line"] != "") & (F.length(c["line"]) <= LONGEST_PLACE) & ~noise(c["line"]))
    once = F.filter(told, lambda c, i: F.array_position(F.transform(told, lambda t: t["line"]), c["line"]) == i + 1)
    best = F.array_max(F.transform(once, lambda c, i: F.struct(c["score"].alias("score"), (-i).alias("at"), c["line"].alias("line"))))["line"]
    window = F.get(F.filter(F.transform(F.coalesce(windows, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"^\[Window\]\s*", ""))), lambda x: (x != "") & (F.lower(x) != plain(app)) & (F.lower(x) != "untitled") & ~noise(x)), 0)
    prefix = F.coalesce(F.nullif(F.trim(app), F.lit("")), F.nullif(F.trim(title), F.lit("")), F.lit("App"))
    coarse = plain(title).isin(COARSE_TITLES) | (plain(title) == plain(app))
    return F.when(~coarse, title).when(best.isNotNull(), F.concat(prefix, F.lit(" - "), best)).otherwise(F.coalesce(window, title))


def redact_secrets(text: Column) -> Column:
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def preview(text: Column, size: int = 120) -> Column:
    """The first characters on one line."""
    return F.translate(F.substring(text, 1, size), "\n\r", "  ")


def truncated(text: Column, size: int, mark: str = "[truncated]") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def lines(text: Column) -> Column:
    """Lines by LF or CRLF; an empty last line is none."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def routine_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


@pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a over UTF-16 code units, as eight hexadecimal digits."""

    def one(t: str) -> str:
        h = 0x811C9DC5
        raw = t.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    return text.map(lambda t: None if t is None else one(t))


def capture_id(provider: Column, frame: Column, record: Column) -> Column:
    return F.when(frame.isNotNull(), F.concat_ws(":", provider, F.lit("frame"), frame.cast("string"))).otherwise(F.concat_ws(":", provider, F.lit("rec"), record))


def frame_of_capture(capture: Column) -> Column:
    return F.nullif(F.regexp_extract(capture, r":frame:(-?\d+)$", 1), F.lit("")).try_cast("bigint")


def frame_id(text: Column) -> Column:
    """A frame id given as text; null unless it is an integer."""
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))


_CJK = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}"
_WORD, _CJK_RUN, _ASCII_RUN, _HAN = (regex.compile(p) for p in (r"[\p{L}\p{M}\p{N}_]+", f"[{_CJK}]+", "[a-z0-9_]+", r"\p{Script=Han}"))
SHORTEST, LONGEST_GRAM = 3, 4
# How questions begin.
_ASKING = regex.compile(r"^(?:請問|请问)\s*(?:哪里提到|哪裡提到)?\s*|^(?:哪里提到|哪裡提到)\s*")


def _grams(run: str, least: int) -> list[str]:
    """A CJK run and its parts of `least` to four characters."""
    return [run] + [run[i : i + n] for n in range(least, min(LONGEST_GRAM, len(run)) + 1) for i in range(len(run) - n + 1)]


def token_list(text: str, question: bool = False) -> list[str]:
    """Distinct tokens: camel case parted, words of three characters or more, CJK runs with their parts. Runs with Han characters have single ones among their parts, but in questions."""
    parted = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower()
    out: dict[str, None] = {}
    for word in _WORD.findall(_ASKING.sub("", parted) if question else parted):
        runs = _CJK_RUN.findall(word)
        if not runs:
            letters = word if word.isascii() else [c for c in unicodedata.normalize("NFC", word) if not unicodedata.category(c).startswith("M")]
            out |= {word: None} if len(letters) >= SHORTEST else {}
            continue
        out[word] = None
        out |= dict.fromkeys(x for x in _ASCII_RUN.findall(word) if len(x) >= SHORTEST)
        for run in runs:
            out |= dict.fromkeys(_grams(run, 1 if _HAN.search(run) and not question else 2))
    return list(out)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is bound."""
    return F.transform(F.array(value), body)[0]


def _parts(run: Column, least: Column) -> Column:
    """A CJK run and its parts of `least` to LONGEST_GRAM characters, as arrays."""
    of = lambda n: F.transform(F.sequence(F.lit(0), F.length(run) - n), lambda i: F.substr(run, i + 1, n))
    sizes = F.sequence(least, F.least(F.lit(LONGEST_GRAM), F.length(run)))
    return F.concat(F.array(run), F.when(F.length(run) >= least, F.flatten(F.transform(sizes, of))).otherwise(F.array().cast("array<string>")))


def parted(text: Column) -> Column:
    """A text in lower case, camel case parted."""
    return F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))


def tokens(text: Column) -> Column:
    """`token_list` of a text that is no question, as array expressions; none for null. Letters are counted without their marks."""
    cjk = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"

    def of_word(word: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit(f"[{cjk}]+"), F.lit(0))
        segments = F.filter(F.regexp_extract_all(word, F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= SHORTEST)
        grams = F.flatten(F.transform(runs, lambda r: _parts(r, F.when(r.rlike(r"\p{IsHan}"), 1).otherwise(2))))
        plain = F.when(F.length(F.regexp_replace(word, r"\p{M}", "")) >= SHORTEST, F.array(word)).otherwise(F.array().cast("array<string>"))
        return F.when(word.rlike(f"[{cjk}]"), F.concat(F.array(word), segments, grams)).otherwise(plain)

    words = F.regexp_extract_all(parted(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.coalesce(_once(F.array_distinct(words), lambda w: F.array_distinct(F.flatten(F.transform(w, of_word)))), F.array().cast("array<string>"))


def ascii_tokens(text: Column) -> Column:
    """The ASCII part of `tokens`."""
    return F.array_distinct(F.filter(F.regexp_extract_all(parted(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 3))
