r"""PII by format-preserving Feistel pseudonyms, in DataFrame functions only.

Values are found by patterns, validated, and replaced by a keyed permutation of the valid values of their own format: equal values get equal
pseudonyms in every document, different values different ones, and whoever holds the key can undo them. Separators and
lengths stay as they are. Emails and secrets alone are replaced by a keyed hash: equal ones stay equal, but their lengths and domains go, and nothing undoes it.
What fails its validation stays.

* iban: the digits of the account part are permuted; the check digits (mod 97) are made valid again. A word of capitals behind it isn't a part of it
* ipv4: the 32-bit address is permuted; octets are below 256
* date (ISO, or day/month/year with one separator): the day number from 1900 to 2099 is permuted by a Feistel network over 271 x 271 cells,
  walking until the result is a day of the range
* ssn: permuted among valid numbers (area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999)
* phone: the national digits are permuted, whatever the separators, parentheses and country code they are written with; ten of them for
  country code 1, 15 at most with the code for others
* card: 13 to 19 digits that pass Luhn: all digits but the last are permuted, the last is made valid again. Beside other numbers those in one piece, in fours, or as 4 + 6 + 4 or 5
  digits are found. Cards in one run of digits count as one
* email: the local part and the domain become letters from the keyed hash of the whole (lower-cased) address
* secret: hexadecimal and base-64-like tokens after key words, and well-known key prefixes: each run becomes hexadecimal digits from
  its keyed hash

A Feistel round adds a keyed hash of one half of a value (a number) to the other, modulo its range; there are eight rounds. The hash is SHA-256 over (key,
kind, round, value). The key is a parameter: ``key``, else the session's ``spark.chronolith.pii.key``, else a key that is public and good for tests only.

Kinds are looked for one after another in what no earlier kind has replaced, so no pseudonym is taken for a value again. Patterns
repeat groups a bounded number of times, or without giving back: long texts of any content neither recurse deeply nor backtrack far.

Null texts stay null, empty ones empty. Rows are judged one by one: repeated ones come out alike, an empty table gives an empty one. Other columns pass through untouched, those named like a count (``n_<kind>``) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .text import free_name, let

KEY, KEY_CONF = "public key for tests", "spark.chronolith.pii.key"
ROUNDS = 8


def _round(tag: str, number: Column, value: Column, span: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(tag), number.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long") % span


def feistel(left: Column, right: Column, left_span: Column, right_span: Column, key: str, label: str) -> Column:
    """struct(a, b): the permuted pair of 0 <= left < left_span, 0 <= right < right_span. Each round adds to one half, modulo its span."""
    tag = f"{key}|{label}"

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        changed = F.when(even, s["a"]).otherwise(s["b"])
        other = F.when(even, s["b"]).otherwise(s["a"])
        span = F.when(even, left_span).otherwise(right_span)
        made = (changed + _round(tag, i, other, span)) % span
        return F.struct(F.when(even, made).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(made).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), step)


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, label: str) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        tail = n - half
        span_a, span_b = _power10(half), _power10(tail)
        a, b = F.substring(d, F.lit(1), half).cast("long"), F.substring(d, half + 1, tail).cast("long")
        return let(
            feistel(a, b, span_a, span_b, key, label),
            lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), tail, "0")),
        )

    return let(digits, halves)


def _digits_at(text: Column, digits: Column) -> Column:
    """text with its digits replaced, in order, by the given ones."""
    return let(
        F.struct(F.split(text, "").alias("c"), digits.alias("d")),
        lambda v: F.aggregate(
            v["c"],
            F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
            lambda s, c: F.when(
                c.rlike("^[0-9]$"),
                F.struct(F.concat(s["out"], F.substring(v["d"], s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used")),
            ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used"))),
            lambda s: s["out"],
        ),
    )


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that a check digit is to follow."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


#: How a card number is written that stands beside other numbers: in one piece, in fours, or as 4 + 6 + 4 or 5.
CARD_SHAPE = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5})[ -]?$"


def _card(m: Column, key: str) -> Column:
    """A run of digit groups: from each group on the longest stretch that is a card number and is written like one; where there is none, all of the run, if that is one. The rest stays."""

    def swapped(text: Column) -> Column:
        def made(d: Column) -> Column:
            body = F.substring(d, F.lit(1), F.length(d) - 1)
            return let(permute_digits(body, key, "card"), lambda p: _digits_at(text, F.concat(p, ((10 - _luhn_sum(p) % 10) % 10).cast("string"))))

        return let(_only_digits(text), made)

    def valid(d: Column) -> Column:
        n = F.length(d)
        return F.when((n >= 13) & (n <= 19), (_luhn_sum(F.substring(d, F.lit(1), n - 1)) + F.substring(d, n, F.lit(1)).cast("int")) % 10 == 0)

    def swap(v: Column) -> Column:
        last = F.size(v["groups"]) - 1 - F.length(v["glued"])  # a group with a letter at its end is no part of a number
        text = lambda i, j: F.array_join(F.slice(v["groups"], i + 1, j - i + 1), "")

        def step(s: Column, i: Column) -> Column:
            number = lambda t: F.coalesce(let(_only_digits(t), valid), F.lit(False))
            ends = F.filter(F.sequence(i, F.least(i + 18, last)), lambda j: let(text(i, j), lambda t: t.rlike(CARD_SHAPE) & number(t)))
            all_of_it = F.when((i == 0) & (last < 19) & number(text(i, last)), last)
            whole = let(F.coalesce(F.array_max(ends), all_of_it), lambda j: F.when(j.isNotNull(), F.struct(F.concat(s["out"], swapped(text(i, j))).alias("out"), (j + 1).alias("past"))))
            return F.when(i < s["past"], s).otherwise(F.coalesce(F.when(i <= last, whole), F.struct(F.concat(s["out"], F.get(v["groups"], i)).alias("out"), s["past"].alias("past"))))

        groups = F.sequence(F.lit(0), F.size(v["groups"]) - 1)
        out = F.aggregate(groups, F.struct(F.lit("").alias("out"), F.lit(0).alias("past")), step, lambda s: F.when(s["past"] > 0, F.concat(s["out"], v["glued"])))
        return out

    glued = F.regexp_extract(m, "([^0-9]?)$", 1)
    return let(F.struct(F.split(F.regexp_replace(m, "[^0-9]$", ""), "(?<=[ -])", -1).alias("groups"), glued.alias("glued")), swap)


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _ssn(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        area, group, serial = (p[i].cast("long") for i in range(3))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        place = area - F.when(area > 666, 2).otherwise(1)  # 0 to 897
        spans = [F.lit(x).cast("long") for x in (898, 99 * 9999)]
        made = let(
            feistel(place, (group - 1) * 9999 + serial - 1, *spans, key, "ssn"),
            lambda s: F.concat_ws("-", _padded(s["a"] + F.when(s["a"] > 664, 2).otherwise(1), 3), _padded(F.floor(s["b"] / 9999) + 1, 2), _padded(s["b"] % 9999 + 1, 4)),
        )
        return F.when(valid, made)

    return let(F.split(m, "-"), swap)


#: Country calling codes of one and two digits; all others have three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _phone(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        head = F.when(m.startswith("+"), F.regexp_extract(d, rf"^({COUNTRY}|\d{{3}})", 1)).when(F.length(d) == 11, F.substring(d, 1, 1)).otherwise("1")
        written = m.startswith("+") | (F.length(d) == 11)

        def national(v: Column) -> Column:
            rest, code = v["rest"], v["head"]
            valid = F.when(code == "1", F.length(rest) == 10).otherwise((F.length(rest) >= 5) & (F.length(rest) + F.length(code) <= 15))
            made = F.when(valid, permute_digits(rest, key, "phone"))
            return F.when(made.isNotNull(), _digits_at(m, F.concat(F.when(written, code).otherwise(""), made)))

        return let(F.struct(head.alias("head"), F.when(written, F.substr(d, F.length(head) + 1)).otherwise(d).alias("rest")), national)

    return let(_only_digits(m), swap)


def _ipv4(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        octet = [p[i].cast("int") for i in range(4)]
        valid = octet[0] < 256
        for o in octet[1:]:
            valid = valid & (o < 256)
        span = F.lit(65536).cast("long")
        made = let(
            feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], span, span, key, "ipv4"),
            lambda s: F.concat_ws(".", *[x.cast("string") for c in (s["a"], s["b"]) for x in (F.floor(c / 256), c % 256)]),
        )
        return F.when(valid, made)

    return let(F.split(m, r"\."), swap)


#: Days of 1900 to 2099, in a network of 271 x 271 cells: a walk of about one step, seldom more.
_DAYS, _SIDE, _WALK = 73049, 271, 8


def _day(day: Column, key: str) -> Column:
    """A permutation of day numbers from 1900-01-01 on: walk on from a cell beyond the range."""
    side = F.lit(_SIDE).cast("long")

    def step(x: Column) -> Column:
        return let(feistel(F.floor(x / _SIDE), x % _SIDE, side, side, key, "date"), lambda s: s["a"] * _SIDE + s["b"])

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK * 8)), step(day.cast("long")), lambda x, _: F.when(x < _DAYS, x).otherwise(step(x))
    )


def _date(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        iso = F.length(p[0]) == 4
        parsed = F.try_to_date(F.concat_ws("-", F.when(iso, p[0]).otherwise(p[2]), p[1], F.when(iso, p[2]).otherwise(p[0])), "yyyy-MM-dd")
        number = F.datediff(parsed, F.lit("1900-01-01").cast("date"))
        made = F.date_add(F.lit("1900-01-01").cast("date"), _day(number, key).cast("int"))
        order = F.when(iso, F.date_format(made, "yyyyMMdd")).otherwise(F.date_format(made, "ddMMyyyy"))
        return F.when((number >= 0) & (number < _DAYS), _digits_at(m, order))

    return let(F.split(m, r"[-/.]"), swap)


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _lettered(text: Column) -> Column:
    """Letters A to Z as 10 to 35, as IBAN check digits want it."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


#: How long the account numbers of each country are.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def _iban(m: Column, key: str) -> Column:
    """The whole match if it is valid, else as much of it as its country's numbers are long: what follows may be a word of capitals."""

    def swap(v: Column) -> Column:
        t = v["t"]
        country, body = F.substring(t, 1, 2), F.substr(t, F.lit(5))
        valid = _mod97(_lettered(F.concat(body, F.substring(t, 1, 4)))) == 1

        def make(b: Column) -> Column:
            check = F.lpad((98 - _mod97(_lettered(F.concat(b, country, F.lit("00"))))).cast("string"), 2, "0")
            return _digits_at(v["m"], F.concat(check, _only_digits(b)))

        made = let(_digits_at(body, permute_digits(_only_digits(body), key, "iban")), make)
        return F.when(valid & (F.length(_only_digits(body)) >= 8), made)

    known = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS for x in (c[:2], int(c[2:]))])
    n = F.element_at(known, F.substring(m, 1, 2))
    end = F.when(m.contains(" "), n + F.floor((n - 1) / 4).cast("int")).otherwise(n)  # groups of four
    tried = lambda x: let(F.struct(x.alias("m"), F.regexp_replace(x, " ", "").alias("t")), swap)
    shorter = F.when(F.substring(m, end + 1, F.lit(1)) == " ", F.concat(tried(F.substring(m, F.lit(1), end)), F.substr(m, end + 1)))
    return F.coalesce(tried(m), shorter)


def _email(m: Column, key: str) -> Column:
    name = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256)
    return F.concat(F.translate(F.substring(name, 1, 12), "0123456789", "ghijklmnop"), F.lit("@"), F.translate(F.substring(name, 20, 8), "0123456789", "ghijklmnop"), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    """The last run of token characters of the match; what leads to it stays."""
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_\-]{16,}={0,2})$", 1)
    return let(
        value,
        lambda v: F.concat(
            F.substring(m, F.lit(1), F.length(m) - F.length(v)),
            F.substring(F.repeat(F.sha2(F.concat(F.lit(f"{key}|secret|"), v), 256), F.ceil(F.length(v) / 64).cast("int")), F.lit(1), F.length(v)),
        ),
    )


#: (kind, pattern, replacement), looked for in this order. Patterns don't match inside longer runs of digits or letters.
KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,}(?![\w@])", _email),
    ("secret", r"""(?i)\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|password|passwd|bearer)\b["']?\s{0,3}(?:[:=]\s{0,3})?["']?[A-Za-z0-9+/_\-]{16,}={0,2}""", _secret),
    ("secret", r"\b(?:sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{16,}|AIza[\w-]{35}|AKIA[A-Z0-9]{16})", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ipv4", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", _ipv4),
    ("date", r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?!(?!T\d{2}:?\d{2})\w|[/.-]\d)", _date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)", _phone),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-])\d{2,4}(?:[ .-]\d{2,8}){1,4}(?!\w)", _phone),
    ("phone", r"(?<![\w.-])(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", _phone),
    ("phone", r"(?<![\w.])\+\d{8,15}(?!\w)", _phone),
    ("card", r"(?<![\w.])\d(?:[ -]?+\d){12,}+\w?", _card),
    ("phone", r"(?<![\w.-])(?<!\d )(?:1 )?[2-9]\d{2} [2-9]\d{2} \d{4}(?![\w-]| \d)", _phone),
]
#: No value of any kind is in a text without one of these: words (in any case), marks, runs of digits or what begins an account number.
HINT_WORDS = ("key", "secret", "token", "passw", "bearer")
HINT_MARKS = ("@", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "AKIA")
HINT_DIGITS = r"\d[\d ./()-]{5,}\d|[A-Z]{2}\d{2} ?[A-Z0-9]{4}"


def _hint(text: Column) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [*[text.contains(x) for x in HINT_MARKS], *[lower.contains(x) for x in HINT_WORDS], text.rlike(HINT_DIGITS)])


def pseudonymized(df: DataFrame, text: str = "text", key: str | None = None, counts: bool = True) -> DataFrame:
    """df with its text column pseudonymized and, if asked for, n_<kind> columns: values replaced of each kind."""
    key = key or df.sparkSession.conf.get(KEY_CONF, KEY)
    kinds = list(dict.fromkeys(k for k, _, _ in KINDS))
    name, body = free_name(df, "pii"), F.col(text)
    plain = F.array(_part(body, F.lit(None).cast("string")))
    out = df.withColumn(name, F.when(_hint(body), plain))
    for kind in KINDS:
        out = out.withColumn(name, _looked_for(F.col(name), *kind, key))
    out = out.withColumn(name, F.coalesce(name, plain))
    columns = {text: F.when(body.isNotNull(), F.array_join(F.transform(name, lambda x: x["t"]), ""))}
    if counts:
        columns |= {f"n_{k}": _count(F.col(name), k) for k in kinds}
    return out.withColumns(columns).drop(name)


def _count(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda x: F.coalesce(x["kind"] == kind, F.lit(False))))


def _looked_for(parts: Column, kind: str, pattern: str, swap: Callable[[Column, str], Column], key: str) -> Column:
    """The parts with the values of one kind replaced. As it reads them more than once, each kind stays its own projection."""
    cut = F.flatten(F.transform(parts, lambda x: _cut(x, kind, pattern, swap, key)))
    return F.when(F.exists(parts, lambda x: x["kind"].isNull() & x["t"].rlike(pattern)), cut).otherwise(parts)


def _part(text: Column, kind: Column) -> Column:
    """A part of a text; its kind once it is a pseudonym."""
    return F.struct(text.alias("t"), kind.alias("kind"))


def _cut(part: Column, kind: str, pattern: str, swap: Callable[[Column, str], Column], key: str) -> Column:
    """A part as an array of parts: what lies between the values of one kind, and their pseudonyms. Values that aren't valid stay as they are."""
    nothing = F.lit(None).cast("string")

    def told(value: Column) -> Column:
        return let(swap(value, key), lambda new: _part(F.coalesce(new, value), F.when(new.isNotNull(), F.lit(kind))))

    def woven(v: Column) -> Column:
        # there is one gap more than values
        return F.flatten(F.transform(v["gaps"], lambda gap, i: F.when(i < F.size(v["values"]), F.array(_part(gap, nothing), told(F.get(v["values"], i)))).otherwise(F.array(_part(gap, nothing)))))

    text = part["t"]
    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), woven)
    return F.when(part["kind"].isNull() & text.rlike(pattern), found).otherwise(F.array(part))


def op4_feistel_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymized(docs)
