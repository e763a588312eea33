"""Scalar functions over strings, dates and numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, letter for letter.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿąćčďęěłńňřśšťůžźżđğşÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝĄĆČĎĘĚŁŃŇŘŚŠŤŮŽŹŻĐĞŞ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaccdeelnnrsstuzzzdgsAAAAAACEEEEIIIINOOOOOOUUUUYACCDEELNNRSSTUZZZDGS"
OFFICE_KINDS = {"docx": "word", "docm": "word", "doc": "legacy_word", "xlsx": "excel", "xlsm": "excel", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "bmp": "image"}


def fold_diacritics(s: Column) -> Column:
    return F.replace(F.replace(F.translate(s, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss")), F.lit("œ"), F.lit("oe"))


def apply_caps(s: Column, sample: Column) -> Column:
    """``s`` in the case of ``sample``: upper, lower or first letter upper."""
    title = F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))
    first = F.substring(sample, 1, 1)
    return F.when((F.upper(sample) == sample) & (F.length(sample) > 1), F.upper(s)).when(F.lower(sample) == sample, F.lower(s)).when(F.upper(first) == first, title).otherwise(s)


def excel_date(serial: Column, date1904: bool = False) -> Column:
    """A sheet's day number as a date; the day that never was (60), negative and too large numbers give null."""
    day = F.floor(serial).cast("int")
    if date1904:
        return F.when((day >= 0) & (day <= 2_957_003), F.date_add(F.lit("1904-01-01").cast("date"), day))
    base = F.when(day < 60, F.lit("1899-12-31").cast("date")).otherwise(F.lit("1899-12-30").cast("date"))
    return F.when((day >= 1) & (day != 60) & (day <= 2_958_465), F.date_add(base, day))


def redacted_file_name(name: Column) -> Column:
    dotted = name.rlike(r"\.[^./]+$")
    return F.when(dotted, F.regexp_replace(name, r"(\.[^./]+)$", ".redacted$1")).otherwise(F.concat(name, F.lit(".redacted")))


def office_kind(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in OFFICE_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, extension), F.lit("other"))


def classify_part(path: Column) -> Column:
    """What an office package's part is: unredactable before text before structural."""
    return (
        F.when(path.rlike(r"(?i)(?:^|/)(?:media|embeddings|activeX|fonts)/|vbaProject|\.(?:png|jpe?g|gif|emf|wmf|bin|ole|mp4)$"), "unredactable")
        .when(path.rlike(r"(?i)^(?:word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments\w*|glossary/document)\.xml|xl/(?:sharedStrings|worksheets/sheet\d+|comments\d*|threadedComments/\w+|drawings/drawing\d+)\.xml|(?:word|xl)/charts/chart\w*\.xml|docProps/\w+\.xml|customXml/item\d+\.xml)$"), "text")
        .when(path.rlike(r"(?i)(?:^|/)_rels/|\.rels$|^\[Content_Types\]\.xml$|(?:^|/)(?:styles|settings|webSettings|fontTable|numbering|workbook|calcChain|theme\d*)\.xml$|/theme/"), "structural")
        .otherwise("unknown")
    )


def fit_placeholder(gap: Column, font: Column, per_em: Column) -> Column:
    """How a placeholder of ``per_em`` widths is set in a gap: as it is, smaller (75 % or more), narrower too (80 % or more), or over."""
    width = per_em * font
    ratio = F.when(width > 0, gap / width).otherwise(F.lit(1.0))
    stage = F.when(ratio >= 1, "fits").when(ratio >= 0.75, "shrink").when(ratio >= 0.6, "condense").otherwise("overflow")
    size = F.when(ratio >= 1, font).when(ratio >= 0.75, font * ratio).otherwise(font * 0.75)
    scale = F.when(ratio >= 0.75, F.lit(1.0)).when(ratio >= 0.6, ratio / 0.75).otherwise(F.lit(0.8))
    return F.struct(stage.alias("stage"), size.alias("font_size"), scale.alias("hscale"), (per_em * size * scale).alias("width"))


def shift_date(day: Column, salt: str) -> Column:
    """``day`` moved by the session's constant of 1 to 30 days either way."""
    h = F.pmod(F.xxhash64(F.lit(salt)), F.lit(60))
    return F.date_add(day, F.when(h < 30, h - 30).otherwise(h - 29).cast("int"))


def entropy_bits(words: Column) -> Column:
    """Bits per character to 6 decimals, 0 for the empty string. Each distinct word of a batch is worked out once: words repeat."""
    return F.arrow_udf(_entropy_bits(), "double")(words)


def _entropy_bits():
    """An inner function, so that it goes to workers by value."""

    def bits_of(words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_string())
        raw = np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        keys, counts = np.unique(word << 21 | raw, return_counts=True)
        word = keys >> 21
        share = counts / sizes[word]
        bits = np.bincount(word, -share * np.log2(share), len(sizes))
        # whole millionths divided by a million are the nearest double; 0.0 for -0.0
        return pa.array(np.rint(bits * 1e6) / 1e6 + 0.0, pa.float64()).take(coded.indices)

    return bits_of
