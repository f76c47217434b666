"""Slugs of titles in Latin or Cyrillic letters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin spelling of Cyrillic letters as the common slug libraries have it, accents dropped first (so й is и, ё is е and ї is і).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "i", "ґ": "g",
}
#: Latin letters without a decomposition.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "þ": "th", "ð": "d"}


def slugify(title: Column) -> Column:
    """Slug of a title, in the JVM: lower case, Cyrillic spelled out, accents dropped, runs of other characters one hyphen; null gives null."""
    table = CYRILLIC | LATIN
    single = {k: v for k, v in table.items() if len(v) == 1}
    accented = {
        chr(c): base
        for c in range(0xC0, 0x250)
        if (base := unicodedata.normalize("NFKD", chr(c))[0]) != chr(c) and base.isascii() and chr(c) == chr(c).lower()
    }
    spelled = F.regexp_replace(F.lower(title), r"(?<=\d),(?=\d)", "")
    for letter, latin in table.items():
        if len(latin) != 1:
            spelled = F.replace(spelled, F.lit(letter), F.lit(latin))
    pairs = single | accented
    spelled = F.translate(spelled, "".join(pairs), "".join(pairs.values()))
    spelled = F.regexp_replace(spelled, r"\p{M}+", "")
    return F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-|-$", "")
