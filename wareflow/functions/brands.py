"""Brand words of URL slugs and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import VARIANT_PATTERNS

#: Words that begin titles and addresses but name no brand; callers pass their own list for more.
GENERIC = (
    "the", "a", "an", "for", "with", "and", "in", "on", "to", "of", "by",
    "wireless", "bluetooth", "true", "sports", "premium", "professional", "portable", "mini", "ultra", "super", "new", "upgraded", "original",
    "genuine", "official", "authentic", "classic", "advanced", "smart", "digital", "electric", "automatic", "universal", "adjustable",
    "waterproof", "rechargeable", "foldable", "lightweight", "compact", "heavy", "duty", "high", "quality", "best", "top", "pro", "max",
    "industrial", "commercial", "organic", "natural", "ergonomic", "magnetic", "solar", "thermal", "acoustic", "optical",
    "durable", "flexible", "silicone", "stainless", "steel", "cotton", "noise", "cancelling", "canceling", "active",
    "pack", "set", "pair", "piece", "pcs", "count", "size", "large", "small", "medium", "extra", "xl", "xxl", "xxxl",
    "baby", "kids", "men", "women", "adult", "toddler", "infant", "boys", "girls", "unisex", "teen",
    "washcloths", "headphones", "earbuds", "headset", "speaker", "charger", "stroller", "monitor", "camera", "phone", "tablet", "laptop", "mouse",
    "keyboard", "cable", "adapter", "case", "cover", "stand", "holder", "bottle", "blanket", "pillow", "mattress", "towel", "socks", "shoes",
    "boots", "sneakers", "sandals", "slippers", "jacket", "shirt", "pants", "dress", "skirt", "sweater", "hoodie", "hat", "cap", "gloves", "scarf",
    "backpack", "bag", "purse", "wallet", "belt", "watch", "ring", "necklace", "bracelet", "earrings", "sunglasses", "glasses",
    "squeaky", "chew", "plush", "interactive", "treat", "drawer", "shelf", "rack", "bin", "basket", "organizer", "container",
    "lamp", "light", "bulb", "fan", "heater", "filter", "pump", "valve", "tool", "wrench", "drill", "saw", "hammer", "screwdriver",
    "black", "white", "red", "blue", "green", "pink", "purple", "grey", "gray", "brown", "gold", "silver", "clear", "multicolor",
    "2024", "2025", "2026", "2027",
)


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^([^\s,\-]+)", 1)


def brand_word(word: Column, generic: tuple[str, ...] = GENERIC, learned: tuple[str, ...] = ()) -> Column:
    """Whether a word may name a brand: 2 to 30 characters, a letter first, not generic unless it was learned."""
    shaped = F.length(word).between(2, 30) & word.rlike("^[A-Za-z]")
    known = F.lower(word).isin(*learned) if learned else F.lit(False)
    return F.coalesce(shaped & (known | ~F.lower(word).isin(*generic)), F.lit(False))


def brand_of(byline: Column, slug: Column, title: Column, generic: tuple[str, ...] = GENERIC, learned: tuple[str, ...] = ()) -> Column:
    """The byline without its phrases, else the slug's first word, else a capital first word of the title, else Unknown."""
    named = F.nullif(F.trim(F.regexp_replace(byline, r"(?i)^(?:visit the|brand:|by)\s+|\s+store$", "")), F.lit(""))
    from_slug, from_title = first_word(F.split(slug, "-")[0]), first_word(title)
    return F.coalesce(
        named, F.when(brand_word(from_slug, generic, learned), from_slug), F.when(brand_word(from_title, generic, learned) & from_title.rlike("^[A-Z]"), from_title), F.lit("Unknown")
    )


def brand_candidate(slug: Column, title: Column) -> Column:
    """The word that would name the brand but for the generic list; null if there is none."""
    from_slug, from_title = first_word(F.split(slug, "-")[0]), first_word(title)
    fits = lambda w, p: F.when((F.length(w) >= 2) & w.rlike(p), w)
    return F.coalesce(fits(from_slug, "^[A-Za-z]"), fits(from_title, "^[A-Z]"))


def color_of(title: Column) -> Column:
    """The first colour word of a title; null if there is none."""
    found = F.regexp_extract(F.lower(title), VARIANT_PATTERNS["color"], 1)
    return F.nullif(found, F.lit(""))
