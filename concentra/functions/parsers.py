"""String parsers of run attributes, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The blanks that Python's ``strip`` and ``split`` know, as a class body
# that the regex engines on both sides (Spark and the SQL oracle) read alike.
BLANKS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = f"[{BLANKS}]"
NON_BLANK = f"[^{BLANKS}]"
# The same language as BLANK+, for splitting: printable ASCII is passed over by one test, not by
# one for each range of the class; in a text of ASCII alone a set of ten characters does.
BLANK_RUN = f"(?![!-~]){BLANK}+"
ASCII_BLANK_RUN = r"[\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20]+"
_RANGES = [part.split("-") for part in BLANKS.replace(r"\x{", "").rstrip("}").replace("}-", "-").split("}")]
BLANK_CHARS = "".join(chr(c) for r in _RANGES for c in range(int(r[0], 16), int(r[-1], 16) + 1))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_words(text) -> Column:
    """The words of a text between blanks, in lower case and order (NULL: NULL)."""
    t = _col(text)
    pieces = F.when(F.octet_length(t) == F.length(t), F.split(F.lower(t), ASCII_BLANK_RUN)).otherwise(F.split(F.lower(t), BLANK_RUN))
    return F.array_remove(pieces, "")


def strip_ws(c) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` alone drops blanks only):
    read from both ends, not searched through the whole text."""
    return F.btrim(_col(c), F.lit(BLANK_CHARS))


def domain_of(prompt) -> Column:
    """Text before the first ':' stripped; NULL without ':' or when empty."""
    p = _col(prompt)
    return F.when(
        F.instr(p, ":") > 0, F.nullif(strip_ws(F.substring_index(p, ":", 1)), F.lit(""))
    )


def basename(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def model_label(path) -> Column:
    """File base name without '.gguf' and without a '[-_]Q<digit>...' tail."""
    name = F.regexp_replace(basename(path), r"\.gguf$", "")
    return F.regexp_replace(name, r"[-_]Q[0-9].*", "")


def model_size(name) -> Column:
    """First '<number>[.<number>] [Bb]' times 1e9, truncated; NULL if none."""
    num = F.nullif(F.regexp_extract(_col(name), r"(\d+(?:\.\d+)?)\s*[Bb]", 1), F.lit(""))
    return F.floor(num.cast("double") * F.lit(1e9)).cast("bigint")


def model_size_or_path(label, path) -> Column:
    """B5 with the fallback of the second generation script: the size in the
    label, else the size anywhere in the model path."""
    return F.coalesce(model_size(label), model_size(path))


def bundle_index(path) -> Column:
    """B6 (anchored form): number after '_chkpt_' right before a final '.pt'; NULL
    without one, and for a number that doesn't fit."""
    return F.regexp_extract(_col(path), r"_chkpt_(\d+)\.pt$", 1).try_cast("bigint")


def bundle_index_of_file(path) -> Column:
    """B6 for a file of a bundle: the bundle is the file itself, or the folder
    that holds it (``..._chkpt_5.pt/part-0000.parquet``, as Spark writes it)."""
    return F.coalesce(bundle_index(path), bundle_index(F.regexp_replace(_col(path), r"/[^/]*$", "")))


def bundle_index_loose(path) -> Column:
    """B6 (base-name form): exactly one '_chkpt_' in the base name, the number is
    what follows it up to the first '.pt' ('x_chkpt_5.pt.bak' -> 5)."""
    base = basename(path)
    parts = F.split(base, "_chkpt_")
    num = F.substring_index(F.element_at(parts, 2), ".pt", 1)
    return F.when(F.size(parts) == 2, num.try_cast("bigint"))


def strip_prefix(prompt, lang) -> Column:
    """Drop the first matching 'wiki_L: wiki_L: ', 'wiki_L: ', 'wiki: wiki: ', 'wiki: '."""
    p = _col(prompt)
    lang_c = _col(lang)
    prefixes = [
        F.concat(F.lit("wiki_"), lang_c, F.lit(": wiki_"), lang_c, F.lit(": ")),
        F.concat(F.lit("wiki_"), lang_c, F.lit(": ")),
        F.lit("wiki: wiki: "),
        F.lit("wiki: "),
    ]
    expr = None
    for pfx in prefixes:
        hit = F.startswith(p, pfx)
        rest = p.substr(F.length(pfx) + 1, F.length(p))
        expr = F.when(hit, rest) if expr is None else expr.when(hit, rest)
    return expr.otherwise(p)


def language_of(domain) -> Column:
    """language = domain with every 'wiki_' removed."""
    return F.replace(_col(domain), F.lit("wiki_"), F.lit(""))
