"""String columns: component lists, keys, numbers written as text, tokens. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean that a value is missing.
MISSING_NUMBERS = ["", "—", "–", "-", "na", "n/a", "nan", "none", "null", "missing", "未测试", "无"]
MISSING_STRUCTURES = ["nan", "none", "null", "na", "n/a"]
# The first number of a text, and a text that is a number.
FIRST_NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Weights of confidence words.
CONFIDENCE = {1.0: ["high", "h", "较高", "高"], 0.6: ["medium", "mid", "m", "中", "一般"], 0.3: ["low", "l", "较低", "低"]}
CONFIDENCE_DEFAULT = 0.6
# Names of fillers, modulus in GPa, density in g/cm3. The first entry with a name inside the text counts.
FILLERS = [
    (["silica", "sio2", "nano-silica", "nanosilica"], 70.0, 2.20),
    (["alumina", "al2o3"], 300.0, 3.95),
    (["glass", "glass fiber", "gf"], 70.0, 2.55),
    (["carbon nanotube", "cnt", "mwcnt", "swcnt"], 1000.0, 1.80),
    (["graphene", "go", "rgo"], 1000.0, 2.20),
    (["clay", "montmorillonite", "mmt"], 170.0, 2.60),
    (["silver", "ag", "silver flake"], 83.0, 10.49),
    (["copper", "cu"], 120.0, 8.96),
    (["aluminum", "al"], 69.0, 2.70),
    (["boron nitride", "bn"], 800.0, 2.10),
]
FILLER_DEFAULT = (200.0, 2.50)
# Signs that stand for digits of numbered groups.
DIGITS, DIGIT_SIGNS = "1234567890", "!$^<>?£¢€§"


def _texts(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def split_fragments(cell: Column) -> Column:
    """Fragments of a cell: divided by ``;`` ``；`` ``|``, by `` + `` and by ``.``; trimmed, without empty ones. Null: none."""
    return F.coalesce(_texts(F.split(F.trim(cell), r"\s*[;；|]\s*|\s+\+\s+|\.")), F.array().cast("array<string>"))


def split_components(cell: Column) -> Column:
    """As ``split_fragments``, but a dot doesn't divide, and the text ``nan`` is empty."""
    parts = _texts(F.split(F.trim(cell), r"\s*[;；|]\s*|\s+\+\s+"))
    return F.when(cell.isNull() | (F.lower(F.trim(cell)) == "nan"), F.array().cast("array<string>")).otherwise(parts)


def combine_components(*cells: Column) -> Column:
    """Components of several cells, joined by dots. None at all: null."""
    joined = F.array_join(F.flatten(F.array(*[split_components(c) for c in cells])), ".")
    return F.nullif(joined, F.lit(""))


def count_components(*cells: Column) -> Column:
    return F.size(F.flatten(F.array(*[split_components(c) for c in cells])))


def clean_raw(text: Column) -> Column:
    """Trimmed, without a pair of quotes around it; empty texts and words for missing become null."""
    s = F.trim(text)
    bare = F.trim(F.regexp_replace(s, r"""^(?:"(.*)"|'(.*)')$""", "$1$2"))
    s = F.when(F.length(s) == 1, F.regexp_replace(s, "^[\"']$", "")).otherwise(bare)
    return F.when((s == "") | F.lower(s).isin(MISSING_STRUCTURES), F.lit(None).cast("string")).otherwise(s)


def longest(parts: Column) -> Column:
    """The longest text, the first of equally long ones."""
    return F.aggregate(parts, F.lit(None).cast("string"), lambda best, p: F.when(best.isNull() | (F.length(p) > F.length(best)), p).otherwise(best))


def repair(text: Column, canonical=lambda c: c, keep_longest: bool = True) -> Column:
    """A structure text made valid: as it is, else without stereo marks, else its longest valid fragment.

    ``canonical`` maps a text column to its canonical form, null where it is invalid.
    """
    s = clean_raw(text)

    def kept(c: Column) -> Column:
        return longest(F.split(c, r"\.")) if keep_longest else c

    fragments = F.array_sort(F.filter(F.split(s, r"\."), lambda f: canonical(f).isNotNull()), lambda a, b: F.length(b) - F.length(a))
    return F.coalesce(kept(canonical(s)), kept(canonical(F.translate(s, "@/\\", ""))), canonical(F.get(fragments, F.lit(0))))


def composition_key(parts: Column, unique: bool = True, ordered: bool = True) -> Column:
    """Cleaned components as one key, joined by dots. No component: null."""
    parts = F.filter(F.transform(parts, clean_raw), lambda p: p.isNotNull())
    parts = F.array_distinct(parts) if unique else parts
    return F.nullif(F.array_join(F.array_sort(parts) if ordered else parts, "."), F.lit(""))


def formulation_key(resin: Column, hardener: Column, strict: bool = False) -> Column:
    """Both keys with two bars between. A missing one reads ``nan``; ``strict`` makes the whole null instead."""
    if strict:
        return F.concat(resin, F.lit("||"), hardener)
    return F.concat(F.coalesce(resin, F.lit("nan")), F.lit("||"), F.coalesce(hardener, F.lit("nan")))


def first_number(text: Column) -> Column:
    """The first number within a text; null where there is none or the text means missing."""
    s = F.trim(text)
    found = F.nullif(F.regexp_extract(s, FIRST_NUMBER, 0), F.lit(""))
    return F.when(~F.lower(s).isin(MISSING_NUMBERS), found.try_cast("double"))


def plain_number(text: Column) -> Column:
    """A text that is nothing but a number, as double; else null."""
    return F.when(text.rlike(PLAIN_NUMBER), F.trim(text).try_cast("double"))


def fraction(text: Column) -> Column:
    """The first number; above one it is a percentage."""
    v = first_number(text)
    return F.when(v > 1, v / 100).otherwise(v)


def confidence_weight(text: Column) -> Column:
    """Weight of a confidence word, or of a number from 0 to 1 as it is; anything else 0.6."""
    s = F.lower(F.trim(text))
    number = plain_number(text)
    out = F.when(number.between(0, 1), number)
    for weight, names in CONFIDENCE.items():
        out = out.when(s.isin(names), F.lit(weight))
    return out.otherwise(F.lit(CONFIDENCE_DEFAULT))


def filler_properties(text: Column) -> Column:
    """(modulus, density) of a filler by the first entry of FILLERS with a name inside the text."""
    s = F.lower(F.trim(text))

    def entry(modulus: float, density: float) -> Column:
        return F.struct(F.lit(modulus).alias("modulus"), F.lit(density).alias("density"))

    out = None
    for names, modulus, density in FILLERS:
        hit = F.lit(False)
        for name in names:
            hit = hit | s.contains(name)
        out = (F if out is None else out).when(hit, entry(modulus, density))
    return out.otherwise(entry(*FILLER_DEFAULT))


def safe_name(text: Column) -> Column:
    """A text as a file name: white space and other signs become underscores, at most 80 characters."""
    s = F.regexp_replace(F.trim(text), r"\s+", "_")
    return F.substring(F.regexp_replace(s, r"[^0-9a-zA-Z_\-一-鿿]+", "_"), 1, 80)


def encode_tokens(structure: Column) -> Column:
    """A structure text as tokens with spaces between: digits after R, X, Y or Z as signs, lower case kept with its letter."""
    s = structure
    for digit, sign in 3 * list(zip(DIGITS, DIGIT_SIGNS, strict=True)):  # numbers of up to three digits
        s = F.regexp_replace(s, f"([RXYZ][!$^<>?£¢€§]*){digit}", "$1" + ("\\" + sign if sign in "$\\" else sign))
    spaced = F.trim(F.regexp_replace(s, r"(?s)(.)(?=.)", "$1 "))
    return F.regexp_replace(spaced, r"\s+(?=[a-z])", "")


def decode_tokens(text: Column) -> Column:
    """Signs back to digits."""
    return F.translate(text, DIGIT_SIGNS, DIGITS)


def detokenize(words: Column) -> Column:
    """Words of a prediction put together, without the marks of start and end."""
    return F.replace(F.replace(F.array_join(words, ""), F.lit("<start>"), F.lit("")), F.lit("<end>"), F.lit(""))
