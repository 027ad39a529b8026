"""Tokenizing, normalizing and comparing titles and reviews with Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a title comparison.
TITLE_STOP_WORDS = (
    "the", "a", "an", "and", "or", "for", "with", "in", "on", "to", "by", "of", "from", "is", "at", "it", "as", "no", "not", "up",
    "new", "best", "top", "high", "quality", "premium", "professional", "latest", "upgrade", "upgraded", "improved", "original", "genuine",
)

#: What a variant category strips from titles, as regular expressions over lower-case text.
VARIANT_PATTERNS = {
    "color": r"\b(black|white|red|blue|green|yellow|orange|purple|pink|brown|gray|grey|silver|gold|navy|teal|cyan|magenta|maroon|beige|ivory|coral|turquoise|indigo|olive|charcoal|rose|midnight|space grey|space gray|graphite|starlight|matte black|jet black|arctic white|pearl white|dark blue|light blue|sky blue|royal blue|forest green|mint green|dark green|light green|hot pink|baby pink|deep purple|bright red|wine red|champagne|platinum|bronze|copper|multi-?color(?:ed)?|multicolor)\b",
    "size": r"\b(\d+(?:\.\d+)?\s*(?:inch(?:es)?|in|ft|feet|foot|cm|mm|meter|m)\b|\b(?:small|medium|large|x-?large|xx-?large|xs|sm|md|lg|xl|xxl|2xl|3xl)\b|\b\d+(?:\.\d+)?\s*(?:oz|ounce|ml|liter|gallon|qt|quart|pint|cup|fl\.?\s*oz)\b)",
    "count": r"\b(\d+[\s-]*(?:pack|count|piece|pcs|pc|set|pair|ct)\b|\b(?:single|double|triple)\b)",
    "style": r"\b(modern|classic|vintage|retro|contemporary|traditional|slim|regular|standard|pro|plus|lite|mini|max|ultra|premium|basic|deluxe|edition|version|gen(?:eration)?\s*\d|v\d|type[\s-]?[a-c]|model\s*[a-z0-9])\b",
}
NOISE = r"\b(with|and|for|the|a|an|of|in|on|to|by)\b"


def normalize_title(title: Column, categories: tuple[str, ...]) -> Column:
    """A key without the words of the given variant categories, punctuation and noise words."""
    out = F.lower(F.coalesce(title, F.lit("")))
    for name in categories:
        if name in VARIANT_PATTERNS:
            out = F.regexp_replace(out, VARIANT_PATTERNS[name], "")
    out = F.regexp_replace(F.regexp_replace(out, r"[^0-9A-Za-z_\s]", " "), NOISE, "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words of two letters or more that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^0-9A-Za-z_\s]", " "), r"\s+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), F.array(*(F.lit(w) for w in TITLE_STOP_WORDS)))


def plain_words(text: Column) -> Column:
    """Lower-case words by white space, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def long_words(text: Column) -> Column:
    """As plain_words, of three characters or more."""
    return F.filter(plain_words(text), lambda w: F.length(w) > 2)


def match_tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Words of two characters or more (letters, digits, hyphens) that are no stop words; repeats kept."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(both / every)


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ?, but not after common abbreviations, between digits or inside dots in a row."""
    guarded = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(?<![0-9A-Za-z_])(mr|mrs|ms|dr|prof|sr|jr|vs|etc|e\.g|i\.e|inc|ltd|co|approx)\.", "$1\u0001")
    guarded = F.regexp_replace(F.regexp_replace(guarded, r"([0-9])\.([0-9])", "$1\u0001$2"), r"\.{2,}", "\u0002")
    parts = F.transform(F.split(guarded, r"(?<=[.!?])\s+"), lambda s: F.trim(F.replace(F.replace(s, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit("..."))))
    return F.filter(parts, lambda s: s != "")


def suspicious_brand(name: Column) -> Column:
    """0 to 1: how little a brand name looks like one (vowels, random capitals, foreign and special characters)."""
    t = F.trim(F.coalesce(name, F.lit("")))
    letters = F.regexp_replace(t, "[^a-zA-Z]", "")
    n, size = F.length(letters), F.length(t)
    vowels = F.length(F.regexp_replace(letters, "[^aeiouAEIOU]", ""))
    ratio = vowels / F.greatest(n, F.lit(1))
    by_vowels = F.when(n == 0, 0.2).when(ratio < 0.1, 0.4).when(ratio < 0.2, 0.3).when(ratio < 0.3, 0.15).otherwise(0.0)
    titled = F.forall(F.split(t, r"\s+"), lambda w: (w == F.upper(w)) | ((F.substr(w, F.lit(1), F.lit(1)) == F.upper(F.substr(w, F.lit(1), F.lit(1)))) & (F.substr(w, F.lit(2)) == F.lower(F.substr(w, F.lit(2))))))
    one_case = (letters == F.upper(letters)) | (letters == F.lower(letters))
    turns = F.length(F.regexp_replace(letters, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", "|")) - n
    by_caps = F.when((n < 3) | one_case | titled, 0.0).when(turns / F.greatest(n - 1, F.lit(1)) > 0.6, 0.2).otherwise(0.0)
    foreign = (size - F.length(F.regexp_replace(t, r"[^\x20-\x7E]", ""))) / F.greatest(size, F.lit(1))
    special = F.length(F.regexp_replace(t, r"[a-zA-Z0-9\s]", "")) / F.greatest(size, F.lit(1))
    by_special = F.when(special > 0.4, 0.3).when(special > 0.25, 0.1).otherwise(0.0)
    by_consonants = F.when((n > 0) & (n <= 6) & (vowels == 0), 0.3).otherwise(0.0)
    total = by_vowels + by_caps + F.when(foreign > 0.5, 0.3).otherwise(0.0) + by_special + by_consonants
    return F.when(size == 0, 1.0).otherwise(F.least(total, F.lit(1.0)))
