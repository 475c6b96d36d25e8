r"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much text go.

Everything is one projection over the whole text: no shuffle, no Python. A text's lines are the parts between ``\n``.

A line fails if it has a word and
* punctuation: it doesn't end a sentence (a terminal mark of any script, then quotes, brackets and footnote marks; Thai and Lao have none,
  so lines in them pass), or exclamation marks outnumber 3 in 10 parts (split at single spaces);
* navigation: it holds over 3 symbols of ``[#*$%&|<>]`` for 10 parts (symbol noise, bars), or two separators or more (bars, arrows, dots, slashes with spaces
  around them) between four words at most each (menus, breadcrumbs, link lists, in any language);
* boilerplate: it is a short line (20 parts at most) that claims a copyright, or speaks of cookies, privacy, terms of use, subscribing, logging in and the
  like in English, German, French or Spanish.
A line equal to an earlier one of its text is text lost too.

Null and empty texts have no words: they fail the base rules. Long texts and long lines are judged whole; an empty table gives an empty result. Other columns, null or not, pass
through untouched; columns named like a result are replaced. Equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import count_of, free_name, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 0.3
MAX_LOST = 0.5
BOILERPLATE = (
    r"(?i)©|\(c\) ?[12][0-9]{3}|\b(cookies?|privacy policy|terms (of|and) (use|service|conditions)|all rights reserved|sign up|log ?in|subscribe|newsletter|javascript|click here|read more|share this"
    r"|datenschutz[a-z]*|impressum|alle rechte vorbehalten|nutzungsbedingungen|jetzt anmelden|hier klicken|weiterlesen"
    r"|politique de confidentialit|tous droits r[éÉ]serv[éÉ]s|mentions l[éÉ]gales|conditions d'utilisation|abonnez-vous|cliquez ici|lire la suite"
    r"|pol[íÍ]tica de privacidad|todos los derechos reservados|aviso legal|iniciar sesi[óÓ]n|suscr[íÍ]bete|haz clic|leer m[áÁ]s)"
)
TERMINAL = ".!?…‥。！？｡．:;：；؟؛۔।॥։።፧፨។៕။᠃᠉‼⁇⁈⁉"
SPACES = " \t\n\v\f\r"
#: What may follow the terminal mark of a sentence; a footnote mark before that.
CLOSERS = "\"'”’»›)]」』）⁰¹²³⁴⁵⁶⁷⁸⁹" + SPACES
FOOTNOTE = r"(\[[0-9]{1,3}\])+\z"
SEPARATOR = " [|»›·•→/>] "
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that occur twice or more in the array, the first occurrence included.

    Windows are compared by 64-bit hashes. Texts without a repeat stop at a distinct count; for the others
    windows are sorted, equal neighbours marked, and the union of their words is measured.
    """

    def covered(h: Column) -> Column:
        def measure(s: Column) -> Column:
            equal = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]))
            return let(
                F.sort_array(F.array_compact(equal)),
                lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b),
            )

        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(marked), measure))

    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    hashes = F.when(F.size(w) >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, covered)


def ends_a_sentence(line: Column) -> Column:
    """Whether a line's last character, without spaces, footnote marks, quotes and brackets, is a terminal mark, or a Thai or Lao one. No pattern runs over the line."""
    body = F.rtrim(line, F.lit(SPACES))
    body = F.when(body.endswith("]"), F.regexp_replace(body, FOOTNOTE, "")).otherwise(body)
    last = F.right(F.rtrim(body, F.lit(CLOSERS)), F.lit(1))
    return let(last, lambda c: (c != "") & ((F.instr(F.lit(TERMINAL), c) > 0) | c.between("\u0e00", "\u0eff")))


def line_fails(line: Column) -> Column:
    def judged(n: Column) -> Column:
        return (
            ~ends_a_sentence(line)
            | (count_of(line, "!") * 10 > n * 3)
            | (count_of(line, SYMBOL) * 10 > n * 3)
            | let(count_of(line, SEPARATOR), lambda k: (k >= 2) & (n - k <= (k + 1) * 4))
            | ((n <= 20) & line.rlike(BOILERPLATE))
        )

    return let(F.size(F.split(line, " ", -1)), judged)


def clean_lines(df: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """df with the counts, ``base_failed``, ``kept``, ``lost_chars`` and ``clean_text`` (what the line rules leave)."""
    body = F.coalesce(F.col(text), F.lit(""))

    def with_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def with_lines(lines: Column) -> Column:
        def distinct(d: Column) -> Column:
            keep = F.filter(d, lambda x: ~line_fails(x))
            return F.struct(
                (F.size(lines) - F.size(d)).cast("long").alias("n_dup_lines"),
                (F.length(F.array_join(lines, "")) - F.length(F.array_join(keep, ""))).cast("long").alias("lost_chars"),
                F.length(F.array_join(lines, "")).cast("long").alias("line_chars"),
                F.array_join(keep, "\n").alias("clean_text"),
            )

        return let(F.array_distinct(lines), distinct)

    own = free_name(df, "line_cleaning")
    of = lambda name: F.col(f"{own}.{name}")
    counted = F.struct(let(words(body), with_words).alias("w"), let(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(HAS_WORD)), with_lines).alias("l"))
    full = df.withColumn(own, counted)
    base_failed = (of("w.n_words") < MIN_WORDS) | (of("w.n_repeat_words") * 100 > of("w.n_words") * int(MAX_REPEATED * 100))
    return full.withColumns(
        {
            "n_words": of("w.n_words"),
            "word_chars": of("w.word_chars"),
            "n_symbols": count_of(body, SYMBOL).cast("long"),
            "n_dup_lines": of("l.n_dup_lines"),
            "n_repeat_words": of("w.n_repeat_words"),
            "base_failed": base_failed,
            "kept": ~base_failed & (of("l.lost_chars") <= of("l.line_chars") * max_lost),
            "lost_chars": of("l.lost_chars"),
            "clean_text": of("l.clean_text"),
        }
    ).drop(own)


def op6_line_cleaning(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_PLATE, _CLOSERS = (p.replace("'", "''") for p in (BOILERPLATE, CLOSERS))
_BODY = f"rtrim(x, '{SPACES}')"
_LAST = f"right(rtrim(CASE WHEN ends_with({_BODY}, ']') THEN regexp_replace({_BODY}, '{FOOTNOTE}', '') ELSE {_BODY} END, '{_CLOSERS}'), 1)"
_END = f"({_LAST} <> '' AND (contains('{TERMINAL}', {_LAST}) OR {_LAST} BETWEEN chr(3584) AND chr(3839)))"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS win FROM w, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
dl AS (SELECT rid, l, list_distinct(l) AS u FROM ln),
j AS (SELECT rid, len(l) - len(u) AS n_dup_lines, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS line_chars,
  coalesce(list_sum(list_transform(list_filter(u, lambda x: {_END}
    AND (length(x) - length(replace(x, '!', ''))) * 10 <= 3 * len(string_split(x, ' '))
    AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 <= 3 * len(string_split(x, ' '))
    AND NOT (len(regexp_extract_all(x, '{SEPARATOR}')) >= 2 AND len(string_split(x, ' ')) - len(regexp_extract_all(x, '{SEPARATOR}')) <= 4 * (len(regexp_extract_all(x, '{SEPARATOR}')) + 1))
    AND NOT (len(string_split(x, ' ')) <= 20 AND regexp_matches(x, '{_PLATE}'))
  ), lambda x: length(x))), 0) AS kept_chars FROM dl),
m AS (SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS n_symbols,
  j.n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, j.line_chars, j.kept_chars
  FROM w JOIN j USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (line_chars - kept_chars) * 2 <= line_chars AS kept
FROM m
"""
