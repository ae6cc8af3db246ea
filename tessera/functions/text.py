"""Text functions as columns: folding, tokens, keys, slugs, URLs, token estimates and deterministic ids."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folding() -> tuple[str, str]:
    """Lower-case characters that compatibility decomposition turns into one letter or digit and marks, what is left of them, and then the marks themselves, which go."""
    pairs = []
    for code in range(0xA0, 0x10000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if c == c.lower() and len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((c, base))
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(c for c, _ in pairs) + marks, "".join(x for _, x in pairs)


ACCENTED, PLAIN = _folding()
TOKEN = r"[\p{L}\p{N}_]+"


def fold(c: Column) -> Column:
    """Lower case without accents; full-width and other compatible forms as plain letters and digits. Letters without a decomposition (œ, ß) stay."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def text_key(c: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the folded letters and digits: equal for texts that differ in case, accents or marks."""
    return F.left(F.sha1(F.regexp_replace(fold(c), "[^a-z0-9]", "")), F.lit(16))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def norm(c: Column) -> Column:
    """For comparison: lower case, straight apostrophes, words and %, +, € kept, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "’", "'")), r"[^\p{L}\p{N}_+%€$]+", " "))


def despace(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def squeeze_lines(c: Column) -> Column:
    """No white space at line ends, at most one blank line in a row, one line feed at the end."""
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit("\n"))


def strip_invisible(c: Column) -> Column:
    """Without byte order marks, zero-width characters and soft hyphens; C1 controls become bullets."""
    c = F.regexp_replace(c, "[\\x{FEFF}\\x{200B}-\\x{200F}\\x{00AD}\\x{2060}]", "")
    return F.regexp_replace(c, "[\\x{0080}-\\x{009F}]", "•")


def n_tokens(c: Column) -> Column:
    """Token estimate: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def token_tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(4 * n))


def hard_split(c: Column, n: int) -> Column:
    """Pieces of n estimated tokens."""
    step = 4 * n
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / step).cast("int") - 1))
    return F.transform(at, lambda i: F.substring(c, i * step + 1, F.lit(step)))


def uuid5(name: Column, namespace: str) -> Column:
    """The version 5 UUID of a name, as uuid.uuid5 gives it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def canonical_url(c: Column) -> Column:
    """Without query and fragment, with exactly one slash at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(c, "[#?].*$", ""), "/+$", ""), F.lit("/"))


def same_url(c: Column) -> Column:
    """For comparison: https, lower case, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^http://", "https://"), "/+$", "")


def url_slug(c: Column) -> Column:
    return F.element_at(F.split(same_url(F.regexp_replace(c, "[#?].*$", "")), "/"), -1)


def links_in(c: Column) -> Column:
    """URLs of a text, without marks that end a sentence."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))


def breadcrumb(title: Column, path: Column) -> Column:
    return F.array_join(F.concat(F.array(title), path), " > ")


def breadcrumb_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\s*[>›»]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def head_tail(c: Column, most: int = 24_000, tail: int = 4_000) -> Column:
    """A long text as its head and its tail with an ellipsis between."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - tail), F.lit("\n[…]\n"), F.right(c, F.lit(tail)))).otherwise(c)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def sentences(c: Column, least: int = 25) -> Column:
    """Sentences over `least` characters that are no headings or table rows."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda s: (F.length(s) > least) & ~s.rlike(r"^[#|]"))
