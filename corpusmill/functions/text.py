"""Column expressions over text: cleaning, quality, tokens, sentences, identity and heading tests. All stay in the JVM but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LOW_QUALITY = 0.9

# Legal suffixes, table labels, section markers and year ranges that decide which headings count, page numbers, and lines
# that look like headings. MARKERS stand in upper case because they are compared with upper-cased text.
TABLE_LABEL = r",$|^\d{4}(\s+\d{4})+\s+\(|Data:$|\d{4} and \d{4}$|^\s*\(|^Years ended |^As of "
COMPANY = r"(?i)(?<![\p{L}\p{N}_])(INC\.?|CORP\.?|CORPORATION|LLC\.?|LTD\.?|LIMITED|CO\.?|COMPANY)\.?$|(?<![\p{L}\p{N}_])AND\s+SUBSIDIARIES\.?$"
ITEM = r"(?i)^ITEM\s+\d+[A-C]?\.\s*\S"
MARKERS = ("REPORT OF INDEPENDENT REGISTERED PUBLIC ACCOUNTING FIRM", "INDEX TO CONSOLIDATED FINANCIAL STATEMENTS", "SIGNATURES", "PART I", "PART II", "PART III", "PART IV")
YEAR_RANGE = r"^\d{4}\s*(?:[-–]\s*\d{4})?\s*$|^\d{4}\s+and\s+\d{4}$|Years ended |As of |\(.*\)"
PAGE_NUMBER = r"(?i)^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$"
LINE_HEADINGS = (r"^[A-Z][A-Z\s\d.\-,:]+$", r"^[\d.]+\s+[A-Z]", r"^[A-Z][A-Z\s\d.\-]{2,}$", r"(?i)^Item\s+\d+[A-Z]?\.\s*\S?")
HEADING_CAP, ITEM_CAP, LINE_CAP = 60, 160, 150


def nfkc(text: Column) -> Column:
    """Unicode NFKC, the one cleaning step without a JVM function."""

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")

    # only texts that can change go to Python
    return F.coalesce(run(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_native(text: Column) -> Column:
    """Rejoin hyphenated line breaks, drop private-use and format characters, collapse white space, trim."""
    joined = F.regexp_replace(text, r"(?<=[A-Za-z])-\s*\n\s*(?=[a-z])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[\p{Co}\p{Cf}]", ""), r"\s+", " "))


def clean(text: Column) -> Column:
    return clean_native(nfkc(text))


def quality(text: Column) -> Column:
    """Share of characters that are no extraction artefacts, to six digits; 1 for empty text."""
    def total(pattern: str) -> Column:
        return F.length(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), ""))

    # a replacement character is no control character, so the three kinds do not overlap
    bad = total(r"\(cid:\d+\)") + total("�") + total(r"[\p{C}&&[^\n\r\t]]")
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - bad / F.greatest(F.length(text), F.lit(1))), 6))


def frequency_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"\d+", "#")


def is_page_number(key: Column) -> Column:
    """Whether a frequency key is a printed page number on its own."""
    return F.replace(key, F.lit("#"), F.lit("1")).rlike(PAGE_NUMBER)


def token_count(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: s != "")


def recursive_split(text: Column, size: int) -> Column:
    """Paragraphs if there are several, else sentences if there are several, else groups of size // 4 words."""
    step = max(1, size // 4)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    groups = F.when(F.size(words) > 0, F.transform(starts, lambda k: F.array_join(F.slice(words, k + 1, step), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(paragraphs(text)) > 1, paragraphs(text)).when(F.size(sentences(text)) > 1, sentences(text)).otherwise(groups)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def term_count(text: Column) -> Column:
    """Number of terms()."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"))


def ends_mid_sentence(text: Column) -> Column:
    """True unless the text, without closing quotes and brackets, ends in . ! or ?; blank text is complete, closers alone are not."""
    bare = F.regexp_replace(text, r"[\s\"'”’)\]}]+$", "")
    return F.when(F.regexp_replace(text, r"\s+", "") == "", F.lit(False)).otherwise(~bare.rlike(r"[.!?]$"))


def document_id(digest: Column) -> Column:
    """doc_ and the lower-cased SHA-256 of the file; an error if the digest is not 64 hexadecimal digits."""
    return F.when(digest.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("doc_"), F.lower(digest))).otherwise(F.raise_error(F.lit("not a SHA-256 digest")).cast("string"))


def chunk_id(doc: Column, index: Column, first: Column, last: Column, text: Column) -> Column:
    place = F.substring(F.sha2(F.concat_ws(":", doc, index.cast("string"), first.cast("string"), last.cast("string")), 256), 1, 8)
    return F.concat(F.lit("chunk_"), doc, F.lit("_"), place, F.lit("_"), F.substring(F.sha2(text, 256), 1, 16))


def uuid5(name: Column, namespace_hex: str) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


#: Namespace of point ids.
POINT_NAMESPACE = "00000000000000000000000000000001"


def point_id(chunk: Column) -> Column:
    return uuid5(chunk, POINT_NAMESPACE)


def source_file(path: Column) -> Column:
    """Last component of a path with either kind of slash."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)/*$", 1)


def title(stem: Column, given: Column) -> Column:
    """Metadata title if there is one, else the file's stem in title case."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.initcap(F.translate(stem, "_-", "  ")))


def is_table_label(h: Column) -> Column:
    return strip(h).rlike(TABLE_LABEL)


def is_company(h: Column) -> Column:
    return strip(h).rlike(COMPANY)


def is_item(h: Column) -> Column:
    return strip(h).rlike(ITEM)


def is_marker(h: Column) -> Column:
    return F.upper(strip(h)).isin(*MARKERS)


def is_section(h: Column) -> Column:
    return is_item(h) | is_marker(h)


def is_valid_heading(h: Column) -> Column:
    s = strip(h)
    return (s != "") & (F.length(s) <= F.when(is_item(s), ITEM_CAP).otherwise(HEADING_CAP)) & ~is_table_label(s) & ~is_company(s)


def is_subheading(h: Column) -> Column:
    s = strip(h)
    printable = ~s.rlike(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]")
    return (s != "") & ~is_item(s) & (F.length(s) <= HEADING_CAP) & ~is_table_label(s) & ~is_company(s) & ~s.rlike(YEAR_RANGE) & ~s.rlike(r"^[\d,\s().]+$") & ~s.endswith(":") & printable & s.rlike("[A-Za-z]{2,}")


def is_line_heading(line: Column) -> Column:
    s = strip(line)
    return (s != "") & (F.length(s) < LINE_CAP) & (s.rlike(LINE_HEADINGS[0]) | s.rlike(LINE_HEADINGS[1]) | s.rlike(LINE_HEADINGS[2]) | s.rlike(LINE_HEADINGS[3]))


def heading_offset(h: Column, text: Column) -> Column:
    """Offset of the first literal find, else of the find with white space collapsed on both sides, else the text's length."""
    def find(needle: Column, hay: Column) -> Column:
        return F.nullif(F.position(needle, hay), F.lit(0)) - 1

    def flat(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return F.when(h == "", F.lit(0)).otherwise(F.coalesce(find(h, text), find(flat(h), flat(text)), F.length(text)))


def citation(file: Column, first: Column, last: Column, heading: Column) -> Column:
    """[file, p. N or pp. A-B, heading]; a backwards range is one page, an empty heading is left out."""
    pages = F.when(last > first, F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("p. "), first.cast("string")))
    return F.concat(F.lit("["), F.concat_ws(", ", file, pages, F.nullif(heading, F.lit(""))), F.lit("]"))


def snippet(text: Column, width: int = 120) -> Column:
    return F.substring(F.translate(text, "\n", " "), 1, width)


# Device names that no file may have.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)))


def is_safe_filename(name: Column) -> Column:
    """A plain PDF name of at most 120 characters: trimmed, no path or wildcard syntax, no control characters, no leading dot, no device."""
    plain = (name != "") & (F.length(name) <= 120) & (name == strip(name)) & F.lower(name).endswith(".pdf")
    return plain & ~name.rlike(r'[/\\:<>"|?*\[\]]|\p{C}|^\.') & ~F.upper(F.substring_index(name, ".", 1)).isin(*RESERVED)
