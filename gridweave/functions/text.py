"""Names, labels, token lists and tolerant parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions.geo import col


def slug(name) -> Column:
    """Lower case; space, hyphen and slash become underscores; commas, parentheses and apostrophes go."""
    return F.translate(F.lower(col(name)), " -/,()'", "___")


def title(name) -> Column:
    """A capital after every character that isn't a letter, so "13th" gives "13Th"."""
    parts = F.regexp_extract_all(col(name), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def label(value) -> Column:
    """"power_line" as "Power Line"."""
    return F.initcap(F.replace(col(value), F.lit("_"), F.lit(" ")))


def contains_any(value, words: list[str]) -> Column:
    """Case-insensitive; null counts as no."""
    test = F.lit(False)
    for w in words:
        test = test | F.upper(col(value)).contains(w.upper())
    return F.coalesce(test, F.lit(False))


def not_in(value, names: list) -> Column:
    """Not one of ``names``; null stays."""
    return ~F.coalesce(col(value).isin(names), F.lit(False))


def present(value) -> Column:
    """Neither null nor zero."""
    return col(value).isNotNull() & (col(value) != 0)


def nonzero_or(value, other) -> Column:
    """``value`` unless it is null or zero."""
    return F.coalesce(F.nullif(col(value), F.lit(0.0)), col(other))


def tokens(value) -> Column:
    """Non-empty parts between white space; null gives none."""
    return F.filter(F.split(F.coalesce(F.trim(col(value)), F.lit("")), r"\s+"), lambda x: x != "")


def token_count(value) -> Column:
    return F.size(tokens(value))


def merged_tokens(values, sep: str = " ") -> Column:
    """Distinct parts of an array of token strings, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(col(values), lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda y: y != ""))))), sep)


def first_tag(tags, keys: list[str], default: str | None = None) -> Column:
    """Value of the first key that a map has."""
    return F.coalesce(*[F.try_element_at(col(tags), F.lit(k)) for k in keys], F.lit(default))


def yes_tags(tags, prefix: str) -> Column:
    """Keys under ``prefix`` whose value is yes, without it, sorted and joined by commas."""
    own = F.map_filter(col(tags), lambda k, v: F.startswith(k, F.lit(prefix)) & (v == "yes"))
    return F.array_join(F.array_sort(F.transform(F.map_keys(own), lambda k: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))), ",")


def recode(value, table: dict, default=None) -> Column:
    """A value by dictionary, or the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(value)), F.lit(default))


def safe_double(value, default: float = 0.0) -> Column:
    """A number of anything; null, NaN and text that isn't one give the default."""
    return F.coalesce(F.nanvl(F.try_cast(col(value), "double") if hasattr(F, "try_cast") else col(value).try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def tolerant_bool(value) -> Column:
    """True for true, 1 and yes in any case and spacing; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(col(value).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def division_label(value) -> Column:
    """A division's number; external below zero; a dash for what isn't one."""
    n = col(value).cast("string").try_cast("double").cast("int")
    return F.when(n.isNull(), F.lit("—")).when(n < 0, F.lit("external")).otherwise(n.cast("string"))


def station_label(name, brand) -> Column:
    """"name (brand)" where there is a brand."""
    b = col(brand)
    has = b.isNotNull() & (b != "") & (F.lower(b) != "nan")
    return F.when(has, F.concat(col(name), F.lit(" ("), b, F.lit(")"))).otherwise(col(name))


def depth_colour(depth, top: float = 2.5) -> Column:
    """#RRGGBB from pale to dark blue, depth clamped to 0 and ``top``."""
    t = F.least(F.greatest(F.coalesce(col(depth), F.lit(0.0)), F.lit(0.0)), F.lit(top)) / top
    fade = lambda a, b: (F.lit(float(a)) + t * (b - a)).cast("int")
    return F.format_string("#%02X%02X%02X", fade(198, 8), fade(219, 48), fade(239, 107))


def depth_radius(depth) -> Column:
    return F.greatest(F.lit(8), F.least(F.lit(50), (col(depth) * 18).cast("int")))


def popup(parts: list[Column]) -> Column:
    """Parts joined by line breaks; null parts are left out."""
    return F.concat_ws("<br>", *parts)


def segment(caption: str, value) -> Column:
    """"<b>caption</b> value", null where the value is null, empty or nan."""
    v = col(value).cast("string")
    return F.when((v != "") & (F.lower(v) != "nan"), F.concat(F.lit(f"<b>{caption}</b> "), v))


def thousands(value) -> Column:
    """A whole number with commas."""
    return F.format_number(col(value), 0)


def percent(part, whole) -> Column:
    """"12.3%" of two numbers; a whole of zero gives 0.0%."""
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(col(part) * 100.0, col(whole).cast("double")), F.lit(0.0)))
