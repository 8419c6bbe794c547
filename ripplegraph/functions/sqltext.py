"""Tables named in SQL text: a plain word rule, and a tokenizer that knows quotes and comments."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_rule_tables(sql: Column) -> Column:
    """array<struct<table,role>>: the word after FROM or JOIN is read, after INTO or UPDATE written.

    Words are runs of letters, digits and underscores; strings and comments are
    words too, and DELETE FROM counts as a read.
    """
    words = F.filter(F.split(sql, "(?U)[^\\w]+"), lambda w: w != "")
    upper = lambda i: F.upper(F.element_at(words, i))
    role = lambda i: F.when(upper(i).isin("FROM", "JOIN"), "reads").when(upper(i).isin("INTO", "UPDATE"), "writes")
    places = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(places, lambda i: F.struct(F.element_at(words, i + 1).alias("table"), role(i).alias("role")))
    return F.filter(found, lambda x: x["role"].isNotNull())


_TOKEN = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'?|"((?:[^"]|"")*)"?|`((?:[^`]|``)*)`?|\[([^\]]*)\]|([^\W\d]\w*)|([.,();])|\S""", re.S)


def quoted_rule_tables(sql: str) -> list[tuple[str, str]]:
    """(table, role) pairs of a statement: comments and values are skipped, quoted and dotted names joined, DELETE FROM writes."""
    tokens = []
    for m in _TOKEN.finditer(sql):
        if m[0].startswith(("--", "/*", "'")):
            continue
        quoted = next((g.replace(q * 2, q) for g, q in ((m[1], '"'), (m[2], "`"), (m[3], "]")) if g is not None), None)
        tokens.append((quoted if quoted is not None else m[4] or m[0], quoted is not None or m[4] is not None, quoted is not None))
    out, deleting = [], False
    for i, (word, _, quoted) in enumerate(tokens):
        key = "" if quoted else word.upper()
        role = {"FROM": "writes" if deleting else "reads", "JOIN": "reads", "INTO": "writes", "UPDATE": "writes"}.get(key)
        deleting = key == "DELETE"
        if role is None or i + 1 >= len(tokens) or not tokens[i + 1][1]:
            continue
        name, j = tokens[i + 1][0], i + 2
        while j + 1 < len(tokens) and tokens[j][0] == "." and tokens[j + 1][1]:
            name, j = f"{name}.{tokens[j + 1][0]}", j + 2
        out.append((name, role))
    return out


def unescape_go(text: str) -> str:
    """The value of the inside of an interpreted string literal."""
    plain = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}

    def one(m: re.Match) -> str:
        if m[1]:
            return plain[m[1]]
        code = int(m[2], 8) if m[2] else int(m[3] or m[4] or m[5], 16)
        return chr(code) if code < 0x110000 else m[0]

    return re.sub(r"""\\(?:([abfnrtv\\"'])|([0-7]{3})|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))""", one, text)
