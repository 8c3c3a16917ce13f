"""Text functions as Column expressions; NFC composes outside ASCII through an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters, patterns and limits that results depend on.
HAN = r"㐀-鿿"
HANGUL = r"가-힣"
KANA = r"぀-ヿ"
QUOTES_FROM, QUOTES_TO = "‘’“”", "''\"\""
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
NEGATION = (
    r"\b(?:not|no|never|cannot|can['’]?t|won['’]?t|don['’]?t|didn['’]?t|isn['’]?t|aren['’]?t|wasn['’]?t|weren['’]?t"
    r"|shouldn['’]?t|wouldn['’]?t|couldn['’]?t|n['’]?t|ne|pas|non|nicht|kein|sin)\b|[不没無无未안못않ないぬ]"
)
TERMINAL = r"[?!。！？]+$"
EPISODE_PATTERNS = (
    r"(?i)(?<![a-z0-9])s(\d{1,2})[ ._-]*e(\d{1,4})(?!\d)",
    r"第\s*(\d{1,4})\s*[集话]",
    r"(?i)(?<![a-z0-9])(?:ep|episode|e)[ ._-]*(\d{1,4})(?!\d)",
)
ASS_FROM, ASS_TO = "\\{}", "＼｛｝"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC. Texts of characters below U+0300 are composed already; only the others are sent to the Arrow function."""
    return F.coalesce(_compose(F.when(text.rlike(r"[^\x00-\u02ff]"), text)), text)


def fold(text: Column) -> Column:
    """Full case folding: upper case and back resolves what lower case leaves (sharp s, long s, ligatures); the dotless i and
    the final sigma have rules of their own."""
    kept = F.translate(F.lower(text), "ı", "\ue000")
    # What stands between keeps the optimiser from taking lower case of upper case for lower case.
    raised = F.translate(F.upper(kept), "\ue000", "\ue001")
    return F.translate(F.lower(raised), "ς\ue001", "σı")


def nfc_each(texts: Column) -> Column:
    """NFC of every text of an array; a control character, which normalising drops anyway, parts them on the way."""
    apart = F.transform(texts, lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), "\x01", ""))
    return F.when(F.size(texts) > 0, F.split(nfc(F.array_join(apart, "\x01")), "\x01")).otherwise(F.array().cast("array<string>"))


def normalize(text: Column) -> Column:
    return normalize_composed(nfc(text))


def normalize_composed(text: Column) -> Column:
    """Of text in NFC, without control characters but line breaks, spaces collapsed, every line and the whole trimmed.

    A tab is a control character and goes. All of Unicode's line breaks are control characters too, but for
    U+2028 and U+2029, which break lines."""
    text = F.regexp_replace(text, r"[\x00-\x09\x0b-\x1f\x7f-\x9f]", "")
    text = F.regexp_replace(text, r"[  ]", "\n")
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def key(text: Column) -> Column:
    return key_composed(nfc(text))


def key_composed(text: Column) -> Column:
    """What makes two readings the same: quotes straightened, line breaks as spaces, no spaces
    between Han characters. Case and punctuation count."""
    text = F.translate(normalize_composed(text), QUOTES_FROM, QUOTES_TO)
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.regexp_replace(text, f"(?<=[{HAN}]) +(?=[{HAN}])", "")


def hangul_key(text: Column) -> Column:
    """key, without any space where there is a Hangul syllable."""
    k = key(text)
    return F.when(k.rlike(f"[{HANGUL}]"), F.regexp_replace(k, r"(?U)\s+", "")).otherwise(k)


def reference_key(text: Column) -> Column:
    """NFC with white space collapsed."""
    return F.regexp_replace(F.regexp_replace(nfc(text), r"(?U)\s+", " "), "^ | $", "")


def letters(text: Column) -> Column:
    """Letters and digits only, without case."""
    return fold(F.regexp_replace(nfc(text), r"[^\p{L}\p{N}]", ""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def protected_change(left: Column, right: Column) -> Column:
    """True if digits, closing punctuation or negations differ: then readings must never be merged on
    the likeness of their texts."""
    a, b = (fold(key(x)) for x in (left, right))
    digits, negation = r"(?U)\d+", "(?U)" + NEGATION
    return (_all(a, digits) != _all(b, digits)) | (_all(a, TERMINAL) != _all(b, TERMINAL)) | (_all(a, negation) != _all(b, negation))


def protected_for_visual_check(left: Column, right: Column) -> Column:
    """protected_change, unless the letters are the same: slips of marks may be looked at."""
    return protected_change(left, right) & (letters(left) != letters(right))


def guess_language(text: Column) -> Column:
    """A language code by script: enough Hangul, any kana, enough Han, mostly ASCII letters; else null."""
    only = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    count = lambda chars: F.length(only) - F.length(F.regexp_replace(only, f"[{chars}]", ""))
    latin = count("A-Za-z")
    return (
        F.when(count(HANGUL) >= 2, "ko-KR").when(count(KANA) >= 1, "ja-JP").when(count(HAN) >= 2, "zh-Hans")
        .when((latin >= 3) & (latin / F.greatest(F.length(only), F.lit(1)) >= 0.8), "en-US")
    )


def natural_key(path: Column) -> Column:
    """Sortable: the runs of digits as numbers, before the text between them without case."""
    parts = F.regexp_extract_all(path, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(
        parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(p.rlike(r"^\d"), p.cast("decimal(38,0)")).alias("number"), fold(p).alias("text"))
    )


def episode(name: Column) -> Column:
    """struct<season, episode> by the first pattern that the name has."""
    season, number = F.lit(None).cast("int"), F.lit(None).cast("int")
    for pattern in reversed(EPISODE_PATTERNS):
        two = pattern is EPISODE_PATTERNS[0]
        found = name.rlike(pattern)
        season = F.when(found, F.regexp_extract(name, pattern, 1).cast("int") if two else F.lit(None).cast("int")).otherwise(season)
        number = F.when(found, F.regexp_extract(name, pattern, 2 if two else 1).cast("int")).otherwise(number)
    return F.struct(season.alias("season"), number.alias("episode"))


def seconds(timecode: Column) -> Column:
    """H:M:S with a comma or a point as seconds."""
    parts = F.split(F.regexp_replace(F.trim(timecode), ",", "."), ":")
    return parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("double")


def stamp(value: Column, ass: bool = False) -> Column:
    """A time as SRT (milliseconds) or ASS (hundredths) writes it, rounded half up."""
    scale = 100 if ass else 1000
    n = F.greatest(F.lit(0), F.floor(value * scale + 0.5)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = F.floor(n / scale)
    hours = F.floor(whole / 3600)
    hours = hours.cast("string") if ass else F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    fraction = F.lpad((n % scale).cast("string"), 2 if ass else 3, "0")
    return F.concat(hours, F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60), F.lit("." if ass else ","), fraction)


def ass_text(text: Column) -> Column:
    """Text that can't be taken for an ASS tag."""
    return F.regexp_replace(F.translate(text, ASS_FROM, ASS_TO), "\n", r"\\N")


def video_stem(source: Column) -> Column:
    """The file name without its folder, by the slashes that the path uses, and last extension."""
    name = F.when(F.instr(source, "\\") > 0, F.regexp_replace(source, r"^.*[\\/]", "")).otherwise(F.regexp_replace(source, "^.*/", ""))
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def missing_line(candidate: Column, text: Column) -> Column:
    """True if candidate (a key) is neither part of the text nor has one of its lines in it."""
    whole = nfc(text)
    lines = F.filter(F.transform(F.split(whole, "\n"), key_composed), lambda t: F.length(t) > 0)
    # Beside the lines, as no function of an array may hold an Arrow function, which the candidate may come from.
    parts = F.zip_with(lines, F.array_repeat(candidate, F.size(lines)), lambda t, c: F.contains(c, t))
    return ~F.contains(key_composed(whole), candidate) & ~F.array_contains(parts, True)


def roi(value: Column) -> Column:
    """array of x1, y1, x2, y2 from "x1,y1,x2,y2"; null unless they are ordered within 0 to 1."""
    v = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(v) == 4) & (v[0] >= 0) & (v[0] < v[2]) & (v[2] <= 1) & (v[1] >= 0) & (v[1] < v[3]) & (v[3] <= 1)
    return F.when(good, v)


def safety_top_bottom(band: Column, automatic: Column, font_height: Column) -> tuple[Column, Column]:
    """Top and bottom of a band (x1, y1, x2, y2) set by hand without a learned font, if it is low and
    wide: wider above by 15 % of its height within 0.008 to 0.018, below by half of that."""
    height, width = band[3] - band[1], band[2] - band[0]
    margin = F.least(F.lit(0.018), F.greatest(F.lit(0.008), height * 0.15))
    as_is = automatic | (F.coalesce(font_height, F.lit(0.0)) != 0) | (height >= 0.25) | (width < 0.35)
    top, bottom = F.greatest(F.lit(0.0), band[1] - margin), F.least(F.lit(1.0), band[3] + margin * 0.5)
    return F.when(band.isNotNull(), F.when(as_is, band[1]).otherwise(top)), F.when(band.isNotNull(), F.when(as_is, band[3]).otherwise(bottom))


def scale(requested: Column, width: Column, engine: Column, languages: Column) -> Column:
    """The scale asked for; 1 for native Thai and for wide video; else 2."""
    native_thai = (engine == "vision") & (languages == "th-TH")
    return F.when(F.coalesce(requested, F.lit(0)) != 0, requested).when(native_thai | (width >= 960), 1).otherwise(2)
