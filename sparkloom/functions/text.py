"""Text clean-up and token-quality predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as quote, mojibake and special tokens.
QUOTES = ("'", "’", "‘", '"', "“", "”", "`", "``", "''")
MOJIBAKE = "[�â€™ÃÂ]"
REPLACEMENTS = (("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"))
#: Quality kinds in the order in which they are tested.
KINDS = ("space", "special", "mojibake", "control", "quote", "punctuation", "symbol")
PREFIX = "token_quality_"

#: White space in the Unicode sense, as strip() and isspace() see it.
SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end; only the ends are looked at, so long gaps inside cost nothing."""
    return F.trim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Five mojibake sequences replaced, then stripped; null stays null."""
    for wrong, right in REPLACEMENTS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return strip(c)


def surface(c: Column) -> Column:
    """A token without outer white space and one leading subword marker."""
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^[▁Ġ](?=[\s\S])", ""))


def is_space_like(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"^{SPACE}*\\z")


def is_special_like(c: Column) -> Column:
    return surface(c).rlike(r"^<[^>]+>$")


def is_mojibake_like(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(MOJIBAKE)


def is_control_like(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"\p{C}")


def is_quote_like(c: Column) -> Column:
    return surface(c).isin(*QUOTES)


def is_punctuation_or_symbol_like(c: Column) -> Column:
    return surface(c).rlike(r"^[\p{P}\p{S}]+\z")


def looks_like_punctuation(c: Column) -> Column:
    """The inspection's test: only characters that are no letters or digits, one at least."""
    return c.rlike(r"^[^\p{L}\p{N}]+\z")


def looks_like_quote(c: Column) -> Column:
    """The inspection's test: subword markers stay."""
    return strip(c).isin(*QUOTES)


def token_quality_label(c: Column, seen: Column | None = None) -> Column:
    """The first kind that fits, else clean. ``seen`` is the token's surface, if a column has it already."""
    seen = surface(c) if seen is None else seen
    return (
        F.when(F.coalesce(c, F.lit("")).rlike(r"^ ?[\p{L}\p{N}&&[^âÃÂ]]+\z"), "clean")  # most tokens: one test
        .when(is_space_like(c), "space")
        .when(F.coalesce(c, F.lit("")).rlike(r"^ ?[!#%&()*,\-./:;?@\[\]_{}\\]+\z"), "punctuation")  # most others: nor special nor quotes
        .when(seen.rlike(r"^<[^>]+>$"), "special")
        .when(is_mojibake_like(c), "mojibake")
        .when(is_control_like(c), "control")
        .when(seen.isin(*QUOTES), "quote")
        .when(seen.rlike(r"^\p{P}+\z"), "punctuation")
        .when(seen.rlike(r"^[\p{P}\p{S}]+\z"), "symbol")
        .otherwise("clean")
    )


def attach_token_quality(df: DataFrame, token_col: str = "token_str") -> DataFrame:
    """Adds token_quality_label, a flag for each kind and token_quality_is_artifact."""
    if token_col not in df.columns:
        raise ValueError(f"token quality needs a column {token_col}")
    df = df.withColumn(f"{PREFIX}label", token_quality_label(F.col(token_col)))
    label = F.col(f"{PREFIX}label")
    flags = {f"{PREFIX}is_{k}": label == k for k in KINDS}
    return df.withColumns(flags | {f"{PREFIX}is_artifact": label != "clean"})


def token_quality_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


def keep_quality(kinds) -> Column:
    """Rows whose label is none of ``kinds``."""
    return ~F.coalesce(F.col(f"{PREFIX}label").isin(*kinds), F.lit(False))
