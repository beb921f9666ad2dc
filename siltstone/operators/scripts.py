"""Scripts: a positional index of their tokens, definitions, and those that nothing names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import exprs

if TYPE_CHECKING:  # workers that parse need no pandas
    import pandas as pd

#: Words of the language that look like definitions; least length of a name worth telling. Fixed values.
KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "import", "export", "from", "class", "extends", "new", "typeof", "with", "do", "else"]
LEAST_NAME = 3
#: About as many rows leave a worker at once: a frame a script costs more than its rows. Fixed value.
ROWS = 5000
NAME = r"[A-Za-z_$][\w$]*"
#: States of the lexer, by what begins and ends them: strings, templates, comments; anything else is code.
MASKED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
#: What code defines or exports, in order of precedence.
EXPORTED = rf"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+({NAME})"
EXPORT_LIST = r"export\s*\{\s*([^}]*)\}"
DEFINED = rf"function\s+({NAME})|(?:const|let|var)\s+({NAME})\s*=|class\s+({NAME})|({NAME})\s*\([^)]*\)\s*\{{"

_LEXER, _NAME = re.compile(MASKED), re.compile(NAME)
_EXPORTED, _LIST, _DEFINED = re.compile(EXPORTED), re.compile(EXPORT_LIST), re.compile(DEFINED)


def masked(text: str) -> str:
    """Code alone: strings and comments are blank, places and lines stay."""
    return _LEXER.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _by_text(texts: DataFrame, schema: str, rows) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"], strict=True):
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
                out += [(path, *r) for r in rows(masked(text or ""))]
            yield pd.DataFrame(out, columns=names)

    return texts.where(exprs.language(F.col("path")) == "javascript").select("path", "text").mapInPandas(run, schema)


def _lines(code: str):
    """Line of a place, for places in rising order."""
    line, seen = 1, 0

    def at(place: int) -> int:
        nonlocal line, seen
        line, seen = line + code.count("\n", seen, place), place
        return line

    return at


def tokens(texts: DataFrame) -> DataFrame:
    """(path, token, line, place): every identifier of the scripts' code, outside of strings and comments; place is its offset."""

    def rows(code: str):
        line = _lines(code)
        return [(m[0], line(m.start()), m.start()) for m in _NAME.finditer(code)]

    return _by_text(texts, "path string, token string, line int, place int", rows)


def definitions(texts: DataFrame) -> DataFrame:
    """(path, name, line, exported): what the scripts define; of a name the export counts, else the first definition."""

    def rows(code: str):
        found: dict[str, tuple[int, bool]] = {}
        line = _lines(code)
        ends = sorted([(m.start(), m[1], True) for m in _EXPORTED.finditer(code)] + [(m.start(), part.strip().split(" as ")[-1].strip(), True) for m in _LIST.finditer(code) for part in m[1].split(",")]
                      + [(m.start(), next(g for g in m.groups() if g), False) for m in _DEFINED.finditer(code)])
        for place, name, exported in ends:
            at = line(place)
            if not name or (not exported and name in KEYWORDS):
                continue
            if name not in found or (exported and not found[name][1]):
                found[name] = (at, exported)
        return [(name, *of) for name, of in found.items()]

    return _by_text(texts, "path string, name string, line int, exported boolean", rows)


def unused_definitions(texts: DataFrame, least_name: int = LEAST_NAME) -> DataFrame:
    """(path, line, name): definitions that no script exports or names but where they are defined: the token stands once in its own
    file and in no other. Counts of the index by token and file; the definitions look their own up and anti-join those of others."""
    index = tokens(texts).groupBy("token", "path").agg(F.count(F.lit(1)).alias("uses"))
    own = definitions(texts).where(~F.col("exported") & (F.length("name") >= least_name))
    rows = own.join(index, (own["name"] == index["token"]) & (own["path"] == index["path"])).where("uses <= 1").select(own["path"], "line", "name")
    files = index.groupBy(F.col("token").alias("name")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    return rows.join(files, "name", "left_anti").select("path", "line", "name")
