"""What the lines of source files are: code, comment or blank."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

SHELLS = (".sh", ".bash", ".zsh")
#: Comments, strings and template literals of C-like languages. A string ends with its line, a block comment or template where it is closed, or never.
TOKEN = re.compile(r"""(?P<block>/\*[\s\S]*?(?:\*/|\Z))|(?P<line>//[^\n]*)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|(?P<template>`(?:\\[\s\S]|[^`\\])*`?)""")
COMMENT = "\x01"
KINDS = ["total", "code", "comment", "blank"]


def _marked(m: re.Match) -> str:
    """What stands for a token: a mark on each line of a comment, a letter for a string, the lines of a template."""
    if m["block"] is not None:
        return "\n".join([COMMENT] * (m[0].count("\n") + 1))
    if m["line"] is not None:
        return COMMENT
    return m[0].replace(COMMENT, "x") if m["template"] is not None else "x"


def kinds(text: str, extension: str) -> tuple[int, int, int, int]:
    """(total, code, comment, blank) lines of a file; an empty last line is none. Literals of regular expressions aren't known: /[/*]/ begins a comment."""
    text = text.replace("\r\n", "\n")
    if not text:
        return 0, 0, 0, 0
    text = text.removesuffix("\n")  # before comments that are never closed take it
    shell = extension in SHELLS
    lines = (text if shell else TOKEN.sub(_marked, text.replace(COMMENT, "x"))).split("\n")
    code = comment = 0
    for i, line in enumerate(x.strip() for x in lines):
        if shell:
            note = line.startswith("#") and not (i == 0 and line.startswith("#!"))
            comment += note
            code += bool(line) and not note
        else:
            rest = line.replace(COMMENT, "").strip()
            code += bool(rest)
            comment += not rest and COMMENT in line
    return len(lines), code, comment, len(lines) - code - comment


@pandas_udf(StructType([StructField(k, LongType()) for k in KINDS]))
def _line_kinds(text: pd.Series, extension: pd.Series) -> pd.DataFrame:
    out = [kinds(t, e or "") if t else (0, 0, 0, 0) for t, e in zip(text, extension, strict=True)]
    return pd.DataFrame(out, columns=KINDS)


def line_kinds(text: Column, extension: Column) -> Column:
    """struct(total, code, comment, blank) of the text of a file."""
    return _line_kinds(text, extension)
