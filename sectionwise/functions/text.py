"""Column expressions on strings: the semantics of Unicode-aware strip, tokens, names and section order."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode calls white space, and the four separators that strip takes too. Trimming sets of characters looks at a string's ends only.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = _WHITE + "\x1c\x1d\x1e\x1f"
_FOLD = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c).lower())) > 1 and d[0].isascii() and chr(c) == chr(c).lower()}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def trim_marks(c: Column) -> Column:
    """White space, asterisks, underscores and hashes at both ends."""
    return F.btrim(c, F.lit(_WHITE + "*_#"))


def split_lines(c: Column) -> Column:
    parts = F.split(c, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fold(c: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(c), "".join(_FOLD), "".join(_FOLD.values()))


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold(c), "[^\\p{L}\\p{N}\\p{Co}]+"), lambda t: t != "")


def safe_filename(c: Column, max_bytes: int = 180) -> Column:
    """Without characters that file systems refuse, spaces as underscores, cut to a length in bytes."""
    x = F.regexp_replace(F.translate(c, ' *#\\/?:"<>|', "_"), "[\\x00-\\x1f]", "")
    # four bytes a character at most
    return F.when(F.octet_length(x) > max_bytes, F.substring(x, 1, max_bytes // 4)).otherwise(x)


def natural_key(number: Column) -> Column:
    """Sorts 1.2 before 1.10: numeric parts after words, shorter prefixes first."""
    return F.transform(F.split(number, "\\."), lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.coalesce(F.when(p.rlike("^[0-9]+$"), p).try_cast("decimal(38,0)"), F.lit(0)).alias("value"), F.when(p.rlike("^[0-9]+$"), "").otherwise(p).alias("word")))


def tag_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda t: t != ""))


def anchor_encode(payload: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.regexp_replace(F.translate(F.base64(payload.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def anchor_decode(anchor: Column) -> Column:
    """Null where the anchor can't be decoded."""
    x = F.translate(anchor, "-_", "+/")
    whole = F.rpad(x, (F.floor((F.length(x) + 3) / 4) * 4).cast("int"), "=")
    return F.when(anchor.rlike("^[A-Za-z0-9_-]*$") & (F.length(anchor) % 4 != 1), F.unbase64(whole).cast("string"))
