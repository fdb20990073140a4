"""Sentences in two languages from one set of facts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates by key and language; {name} takes a column as text, {name:,} a whole number with separators, {name:.1} one decimal.
TEXTS = {
    "late": {"en": "Work {work_id} is {days:,} days past its sanction.", "hi": "कार्य {work_id} स्वीकृति के {days:,} दिन बाद भी चल रहा है।"},
    "cost": {"en": "Cost {cost:,} against a median of {median_cost:,}.", "hi": "लागत {cost:,}, माध्यिका {median_cost:,}।"},
    "share": {"en": "{share:.1}% of {total:,}.", "hi": "{total:,} का {share:.1}%।"},
}
FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def rendered(key: str, lang: str) -> Column:
    """The template with the columns it names; null where one of them is null."""
    parts, last, text = [], 0, TEXTS[key][lang]
    for m in FIELD.finditer(text):
        spec = m[2] or ""
        value = F.format_number(m[1], 0) if spec == "," else F.format_number(m[1], int(spec[1:])) if spec.startswith(".") else F.col(m[1]).cast("string")
        parts += [F.lit(text[last : m.start()]), value]
        last = m.end()
    return F.concat(*parts, F.lit(text[last:]))


def parsed(key: str, lang: str, c) -> dict[str, Column]:
    """The facts of a rendered sentence, as text without separators: the way back."""
    text, names, pattern, last = TEXTS[key][lang], [], "^", 0
    for m in FIELD.finditer(text):
        names.append(m[1])
        pattern += re.escape(text[last : m.start()]).replace(r"\ ", " ") + "(.+?)"
        last = m.end()
    pattern += re.escape(text[last:]).replace(r"\ ", " ") + "$"
    return {n: F.regexp_replace(F.regexp_extract(c, pattern, i + 1), ",", "") for i, n in enumerate(names)}
