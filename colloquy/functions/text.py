"""Column expressions over strings. All are built from Spark's own functions and stay in generated code."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, as a regular-expression class.
SPACE = r"[\t-\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters as a string.
SPACE_CHARS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: A run of word characters, or one mark.
TOKEN = r"(?U)\w+|[^\w\s]"
#: Patterns of e-mail addresses, card numbers (13 to 16 digits) and phone numbers, in the order in which they are replaced.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,15}(?!\d)"
PHONE = r"(?<![\w-])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\w-])"


def strip(text: Column) -> Column:
    """Without white space at both ends (Spark's trim only removes U+0020 by itself)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(text)), rf"{SPACE}+", " ")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_id(prefix: str, text: Column) -> Column:
    """A prefix and the first 12 hex digits of the hash."""
    return F.concat(F.lit(prefix), F.substring(content_hash(text), 1, 12))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def strip_reasoning(text: Column) -> Column:
    """Without one leading block of reasoning, whatever it holds, then stripped."""
    return strip(F.regexp_replace(text, rf"(?si)\A{SPACE}*<think>.*?</think>", ""))


def strip_empty_reasoning(text: Column) -> Column:
    """Without a leading block of reasoning that holds only white space."""
    return F.regexp_replace(text, rf"(?i)\A{SPACE}*<think>{SPACE}*</think>{SPACE}*", "")


def split_reasoning(content: Column, reasoning: Column) -> tuple[Column, Column]:
    """Content without a leading block of reasoning, and the reasoning: the given one, else what the block holds, else NULL."""
    block = F.regexp_extract(content, rf"(?si)\A{SPACE}*<think>(.*?)</think>", 1)
    return strip_reasoning(content), F.coalesce(reasoning, F.when(block != "", strip(block)))


def fill_template(template: str, **values: Column) -> Column:
    """A text with ``{name}`` slots filled by columns; NULL values are empty; an unknown slot raises."""
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(values)
    if unknown:
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))


def count_substring(text: Column, keyword: str) -> Column:
    """Occurrences of a keyword that don't overlap, regardless of case; empty keywords never occur."""
    if not keyword:
        return F.lit(0)
    lowered = F.lower(text)
    return F.floor((F.length(lowered) - F.length(F.replace(lowered, F.lit(keyword.lower())))) / F.lit(len(keyword))).cast("int")


def keyword_pattern(keywords: list[str]) -> str | None:
    """A pattern that matches any phrase at word boundaries; None if there is none."""
    return rf"(?iU)\b(?:{'|'.join(re.escape(k).replace(chr(92) + ' ', ' ') for k in keywords)})\b" if keywords else None


def has_keyword(text: Column, keywords: list[str]) -> Column:
    pattern = keyword_pattern(keywords)
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs, regardless of case; no pattern never does."""
    return F.coalesce(text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def redact(text: Column) -> tuple[Column, Column]:
    """Text with placeholders and the number of replacements: e-mail, then card, then phone."""
    total, current = F.lit(0), text
    for pattern, placeholder in ((EMAIL, "[EMAIL]"), (CARD, "[CARD]"), (PHONE, "[PHONE]")):
        total = total + F.regexp_count(current, F.lit(pattern))
        current = F.regexp_replace(current, pattern, placeholder)
    return current, F.coalesce(total, F.lit(0))


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance of the collapsed texts over the longer one's length; 0 if both are empty."""
    x, y = collapse(a), collapse(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(x, y) / longest)


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first different character; the shorter length if one text starts the other; NULL if equal."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when(a != b, (F.array_position(differs, True) - 1).cast("int"))


class WordHashes(dict):
    """Hashes of words, made once each."""

    def __missing__(self, word: str) -> int:
        own = self[word] = xxhash.xxh3_64_intdigest(word)
        return own


def run_hashes(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of its distinct runs of ``size`` words, split at white space, and the hashes of all, sorted within a text.

    A shorter text is one run, an empty or NULL one has none.
    """
    words = [text.split() if text else [] for text in texts]
    # No word is empty, so a filled-up text equals no run of a longer one.
    words = [own + [""] * (size - len(own)) if 0 < len(own) < size else own for own in words]
    counts = np.array([len(own) for own in words], np.int64)
    known = WordHashes()
    flat = np.fromiter((known[word] for own in words for word in own), np.uint64, int(counts.sum()))
    hashes = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    odd = np.random.default_rng(5).integers(0, 1 << 63, size + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    for i in range(size):
        hashes += flat[i : i + len(hashes)] * odd[i]
        hashes ^= hashes >> np.uint64(29)
    hashes *= odd[size]
    hashes ^= hashes >> np.uint64(32)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(hashes)]
    inside = np.arange(len(hashes)) + size <= np.cumsum(counts)[owner]
    owner, runs = owner[inside], hashes[inside].view(np.int64)
    by = np.lexsort((runs, owner))
    owner, runs = owner[by], runs[by]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=len(counts)), runs[new]


def word_runs(text: str | None, size: int = 5) -> list[int]:
    """Sorted hashes of the distinct runs of words of one text, as in ``run_hashes``."""
    return run_hashes([text], size)[1].tolist()


def shingle_hashes(size: int = 5):
    """A function of a text column: its ``word_runs``.

    Arrow batches are used, as a higher-order function would split the text anew for every run.
    """
    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series) -> pd.Series:
        sizes, runs = run_hashes(texts.tolist(), size)
        return pd.Series(np.split(runs, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    # Else a filter on the result would be pushed below it, with a second run of the function.
    return hashed.asNondeterministic()


def band_hashes(bands: int, rows: int):
    """A function of an array of shingle hashes: one hash per band of ``rows`` minimum hashes, the band's number in it; none of an empty array."""
    count = bands * rows
    odd = np.random.default_rng(7).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("array<bigint>")
    def hashed(sets: pd.Series) -> pd.Series:
        out = []
        for own in sets:
            if own is None or not len(own):
                out.append([])
                continue
            values = np.asarray(own, np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                minima = ((values[:, None] ^ (odd >> np.uint64(7))) * odd).min(axis=0).reshape(bands, rows)
            out.append([xxhash.xxh3_64_intdigest(band.tobytes(), number) - (1 << 63) for number, band in enumerate(minima)])
        return pd.Series(out, dtype=object)

    return hashed.asNondeterministic()
