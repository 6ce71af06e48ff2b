"""Text expressions: white space, counts, noise, word lists, quality score and rank.

All take and give Columns and stay in the JVM. White space is that of the web
platform, lengths are UTF-16 units, as the stored scores were made with both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space class, the characters that are not suspicious in
# recognised text, and the prefixes of list items.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ALLOWED = r"\p{L}\p{N}.,:;!?()\-/$%#@&+•·–—\"'…™®©°×¹²³½¼¾→←↑↓✓✗★☆▪▸►■□▶●○◆◇‘’“”"
BULLET = r"^[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}\x{25AA}\x{25AB}\x{25CF}\x{25CB}\-\x{2013}\x{2014}]\s*"
NUMBERED = r"^(\d{1,3})[.)]\s+"

# Penalties and flags of the quality score, in their order.
PENALTIES = (("very-short-text", 0.25), ("word-shape-anomaly", 0.1), ("symbol-noise", 0.2), ("layout-collapse", 0.08), ("dictionary-miss", 0.15), ("height-anomaly", 0.08))


#: The characters of ``SPACE``.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    """Without white space at both ends; null for null."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """Whether a text has anything but white space; false for null."""
    return F.coalesce(F.regexp_like(c, F.lit(f"[^{SPACE[1:-1]}]")), F.lit(False))


def collapse(c: Column, to: str = " ") -> Column:
    return F.regexp_replace(c, f"{SPACE}+", to)


def normalise(c: Column) -> Column:
    """small letters, single spaces, no space at the ends."""
    return F.trim(collapse(F.lower(c)))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def words(c: Column) -> Column:
    """The pieces between white space; an empty array for a blank text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines that are not empty; those of spaces only stay."""
    return F.filter(F.split(c, "\n"), lambda x: x != "")


def suspicious_ratio(c: Column) -> Column:
    """share of suspicious characters among those that are no space; 1 for a blank text."""
    return _noise(collapse(c, ""))


def _noise(solid: Column) -> Column:
    # most texts have no such character, so they are only looked through
    bad = F.when(F.regexp_like(solid, F.lit(f"[^{ALLOWED}]")), F.length(F.regexp_replace(solid, f"[{ALLOWED}]+", ""))).otherwise(0)
    return F.when(F.length(solid) == 0, 1.0).otherwise(bad / F.length(solid))


def dictionary_tokens(c: Column) -> Column:
    """what of two or more characters stands between white space, in small letters."""
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda w: F.length(w) > 1)


def dictionary_word(token: Column) -> Column:
    """a token stripped at both ends to a-z."""
    return F.regexp_replace(token, "^[^a-z]+|[^a-z]+$", "")


def dictionary_ratio(c: Column, dictionary: list[str]) -> Column:
    """Share of a text's words that are in the dictionary; null for null and for a text without words.

    The dictionary is a list of a few thousand words at most, which stands in the plan as a set.
    """
    return _ratio(F.split(c, f"{SPACE}+"), dictionary)


def _ratio(tokens: Column, dictionary: list[str]) -> Column:
    long = F.filter(tokens, lambda w: F.length(F.lower(w)) > 1)
    among = lambda w: w.isin(dictionary) if dictionary else F.lit(False)
    # most words need no stripping, and one that has letters at both ends is not in the dictionary if it isn't as it stands
    known = lambda w: F.when(among(w), True).when(F.regexp_like(w, F.lit("^[a-z].*[a-z]$")), False).otherwise(among(dictionary_word(w)))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("known"))
    add = lambda s, w: F.struct((s["n"] + 1).alias("n"), (s["known"] + F.when(known(F.lower(w)), 1).otherwise(0)).alias("known"))
    return F.aggregate(long, start, add, lambda s: F.when(s["n"] > 0, s["known"] / s["n"]))


def upper_median(numbers: Column) -> Column:
    """The element at floor(n/2) of the sorted numbers; null for none."""
    return F.try_element_at(F.sort_array(numbers), (F.floor(F.size(numbers) / 2) + 1).cast("int"))


def height_anomaly(regions: Column) -> Column:
    """of three or more positive heights one is over 3 times or under 0.3 times the median.

    False for null regions and for fewer heights.
    """
    heights = F.sort_array(F.filter(F.transform(F.coalesce(regions, F.array()), lambda r: r["h"]), lambda h: (h > 0) & ~F.isnan(h) & (h < float("inf"))))
    median = F.try_element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int"))
    odd = (F.array_max(heights) > median * 3) | (F.array_min(heights) < median * 0.3)
    return F.when(F.size(heights) < 3, False).otherwise(odd)


def clamp01(c: Column) -> Column:
    """null and NaN stay."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def with_quality(df: DataFrame, text: str, source: str, confidence: str, dictionary: str | list[str], regions: str) -> DataFrame:
    """adds ``score``, ``flags`` and ``rank``.

    ``dictionary`` is a list of usual words or the column of the share of such
    words. Native text gets 0.98 and no flags. Null text counts as empty, a null
    dictionary ratio as no miss, a null or NaN confidence as 0.85; others are
    clamped to 0 and 1. Penalties are taken off in their fixed order, so that the
    doubles are the same. The steps are columns of their own, so that none is
    computed twice, and the text is split once.
    """
    c = F.col
    out = df.withColumn("_t", js_trim(F.coalesce(c(text), F.lit("")))).withColumn("_tokens", words(c("_t")))
    out = out.withColumn("_solid", F.array_join("_tokens", "")).withColumn("_ratio", c(dictionary) if isinstance(dictionary, str) else _ratio(c("_tokens"), dictionary))
    out = out.withColumns({"_words": F.size("_tokens"), "_lines": F.size(lines(c("_t"))), "_units": utf16_length(c("_t")), "_noise": _noise(c("_solid"))})
    mean = F.when(c("_words") > 0, utf16_length(c("_solid")) / c("_words"))
    hit = {
        "very-short-text": c("_units") < 20,
        "word-shape-anomaly": F.coalesce((mean > 11) | (mean < 2.2), F.lit(False)),
        "symbol-noise": c("_noise") > 0.15,
        "layout-collapse": (c("_lines") <= 1) & (c("_words") >= 20),
        "dictionary-miss": (c("_words") >= 20) & F.coalesce(c("_ratio") < 0.5, F.lit(False)),
        "height-anomaly": height_anomaly(c(regions)),
    }
    out = out.withColumns({f"_hit{k}": hit[f] for k, (f, _) in enumerate(PENALTIES)})
    score = F.when(c(confidence).isNull() | F.isnan(confidence), 0.85).otherwise(clamp01(c(confidence)))
    for k, (_, penalty) in enumerate(PENALTIES):
        score = score - F.when(c(f"_hit{k}"), penalty).otherwise(0.0)
    flags = F.array_compact(F.array(*(F.when(c(f"_hit{k}"), F.lit(f)) for k, (f, _) in enumerate(PENALTIES))))
    native = c(source) == "pdf-text"
    out = out.withColumn("_score", score).withColumns({"score": F.when(native, 0.98).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("_score")))), "flags": F.when(native, F.array().cast("array<string>")).otherwise(flags)})
    return out.withColumn("rank", _rank(c("score"), c("flags"), c("_words"), c("_units"))).drop("_t", "_tokens", "_solid", "_ratio", "_words", "_lines", "_units", "_noise", "_score", *(f"_hit{k}" for k in range(len(PENALTIES))))


def _rank(score: Column, flags: Column, n_words: Column, units: Column) -> Column:
    out = score + F.when(n_words >= 18, 0.03).otherwise(0.0)
    out = out + F.when(units >= 120, 0.02).otherwise(0.0)
    out = out - F.when(F.array_contains(flags, "symbol-noise"), 0.05).otherwise(0.0)
    return out - F.when(F.array_contains(flags, "very-short-text"), 0.08).otherwise(0.0)


def rank(score: Column, flags: Column, text: Column) -> Column:
    """by which of two results of a page the better is taken."""
    t = js_trim(F.coalesce(text, F.lit("")))
    return _rank(score, flags, F.size(words(t)), utf16_length(t))


def strip_tags(raw: Column) -> Column:
    """the values of leaf fields by line; without any field, the text without tags."""
    values = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"<s_([^>]+)>([^<]*)</s_\1>"), 2), js_trim), lambda v: v != "")
    plain = js_trim(collapse(F.regexp_replace(raw, "<[^>]+>", " ")))
    return F.when(F.regexp_like(raw, F.lit(r"<s_([^>]+)>([^<]*)</s_\1>")), F.array_join(values, "\n")).otherwise(plain)


def strip_markup(raw: Column) -> Column:
    """text without heading marks, bold, italic and formula marks."""
    steps = ((r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\$([^$]+)\$", "$1"), (r"(?s)\\\[.*?\\\]", ""), (r"\n{3,}", "\n\n"))
    for pattern, to in steps:
        raw = F.regexp_replace(raw, pattern, to)
    return js_trim(raw)


def safe_label(c: Column) -> Column:
    """what is no letter of a-z, digit or hyphen becomes an underscore."""
    return F.regexp_replace(c, "(?i)[^a-z0-9-]", "_")


def note(c: Column, size: int = 70) -> Column:
    """The first characters on one line, with dots if there are more."""
    flat = F.regexp_replace(c, "\n", " ")
    return F.concat(F.substring(flat, 1, size), F.when(F.length(c) > size, "...").otherwise(""))


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def data_url(mime: Column, data: Column) -> Column:
    """K11."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def data_url_bytes(url: Column) -> Column:
    """The bytes behind the first comma; none for a url without one."""
    at = F.instr(url, ",")
    return F.when(at > 0, F.unbase64(F.substr(url, at + 1))).otherwise(F.lit(bytearray()))


def message(template: Column, values: dict[str, Column]) -> Column:
    """a message with its ``{name}`` places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def localised(catalogs: dict[str, dict[str, str]], locale: Column, key: Column, usual: str = "en") -> Column:
    """a message in a language, else in the usual one, else its key; a locale counts by its language.

    The catalogs are a program's messages, which stand in the plan.
    """
    flat = [F.lit(x) for lang, messages in catalogs.items() for k, v in messages.items() for x in (f"{lang}|{k}", v)]
    if not flat:
        return key
    known = F.create_map(*flat)
    language = F.regexp_extract(F.lower(F.coalesce(locale, F.lit(usual))), "^[a-z]+", 0)
    return F.coalesce(F.try_element_at(known, F.concat(language, F.lit("|"), key)), F.try_element_at(known, F.concat(F.lit(f"{usual}|"), key)), key)
