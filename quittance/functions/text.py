"""References and names: folding, canonical form, invoice identifiers, similarity.

Pure functions on strings, and Spark columns over them.  ASCII text, the usual case,
is folded by built-in functions; the Arrow functions see what is left.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values.
#: Years a four-digit run may mean; longest run that is an identifier; separators that
#: join runs; words that announce an invoice number and how far before it they may stand.
YEARS = range(1990, 2101)
LONGEST_RUN = 8
JOINERS = "-/._ "
KEYWORDS = ("INVOICE", "INV", "SZAMLA", "SZLA", "FAKTURA", "RECHNUNG", "FACTURE", "FATTURA", "REFERENCE", "REF", "BILL", "NR", "NO", "#")
LOOKBEHIND = 14
#: Shorter canonical needles are not compared.
SHORTEST_NEEDLE = 5

_GROUP = re.compile(r"\d+(?:[-/._ ]\d+)*")
_KEYWORD = re.compile("|".join(map(re.escape, KEYWORDS)))

TOKEN_TYPE = T.ArrayType(
    T.StructType([T.StructField("seq", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("keyworded", T.BooleanType())])
)
NUMBER_TYPE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("year", T.IntegerType())])


def fold_accents(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 15)
def canonical(text: str) -> str:
    """Upper-case letters and digits only."""
    return "".join(filter(str.isalnum, fold_accents(text).upper()))


def _as_year(run: str) -> int | None:
    return int(run) if len(run) == 4 and run[0] != "0" and int(run) in YEARS else None


def _read_group(runs: list[str]) -> tuple[int, int | None] | None:
    """(sequence, year) of the digit runs of one identifier."""
    usable = [r for r in runs if len(r) <= LONGEST_RUN]
    if not usable:
        return None
    numbers = [r for r in usable if _as_year(r) is None]
    years = [r for r in usable if _as_year(r) is not None]
    if numbers and years:
        return int(numbers[0]), int(years[0])
    if len(usable) == 1 and len(usable[0]) > 4 and _as_year(usable[0][:4]) is not None:
        return int(usable[0][4:]), int(usable[0][:4])
    return int((numbers or years)[0]), None


def extract_refs(text: str | None) -> list[tuple[int, int | None, str, bool]]:
    """(seq, year, raw, keyworded) of the identifiers in a text, best evidence first, each (seq, year) once."""
    best: dict[tuple[int, int | None], tuple[int, int, str, bool]] = {}
    for place, m in enumerate(_GROUP.finditer(text or "")):
        read = _read_group(re.findall(r"\d+", m[0]))
        if read is None:
            continue
        before = fold_accents(text[max(0, m.start() - LOOKBEHIND) : m.start()]).upper()
        keyworded = _KEYWORD.search(before) is not None
        weight = (read[1] is not None) + keyworded
        held = best.get(read)
        if held is None or weight > held[0]:
            best[read] = (weight, held[1] if held else place, m[0], keyworded)
    ranked = sorted(best.items(), key=lambda x: (-x[1][0], x[1][1], x[0][0]))
    return [(seq, year, raw, keyworded) for (seq, year), (_, _, raw, keyworded) in ranked]


def invoice_token(number: str | None) -> tuple[int, int | None, str, bool] | None:
    """The identifier that uses most of an invoice's own number; None if it has none."""
    tokens = extract_refs(number)
    return max(tokens, key=lambda t: (len(t[2]), (t[1] is not None) + t[3])) if tokens else None


def tokens_meet(seq: int, year: int | None, other_seq: int, other_year: int | None) -> bool:
    """A missing year agrees with every year."""
    return seq == other_seq and (year is None or other_year is None or year == other_year)


def _common(pattern: dict[str, int], full: int, text: str) -> int:
    s = full
    for c in text:
        u = s & pattern.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return full.bit_count() - s.bit_count()


def _best_window(needle: str, hay: str) -> float:
    """Best 200 * LCS / (lengths) of the needle and a window of hay, shorter windows at its ends included."""
    masks: dict[str, int] = {}
    for k, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << k
    n, full, best = len(needle), (1 << len(needle)) - 1, 0.0
    windows = [hay[max(0, k) : k + n] for k in range(1 - n, len(hay))]
    for w in windows:
        if 200.0 * min(n, len(w)) / (n + len(w)) <= best or w[-1] not in masks and w[0] not in masks and len(w) < n:
            continue
        best = max(best, 200.0 * _common(masks, full, w) / (n + len(w)))
        if best == 100.0:
            break
    return best


@lru_cache(maxsize=1 << 16)
def similarity(needle: str, hay: str) -> int:
    """0 to 100 of two texts in canonical form; 0 if the first is too short to compare or the second is empty.

    A short second text is searched in the first, so it may score high; that is wanted.
    """
    a, b = canonical(needle), canonical(hay)
    if len(a) < SHORTEST_NEEDLE or not b:
        return 0
    if len(a) == len(b):
        return int(max(_best_window(a, b), _best_window(b, a)))
    return int(_best_window(*sorted((a, b), key=len)))


# --- columns ------------------------------------------------------------------------


def _each(values: pa.Array, kind: T.DataType, f: Callable[[str], object]) -> pa.Array:
    """f of the texts of a batch; where all are null, as in most batches, nothing is unpacked."""
    arrow = to_arrow_type(kind)
    if values.null_count == len(values):
        return pa.nulls(len(values), arrow)
    return pa.array([None if x is None else f(x) for x in values.to_pylist()], arrow)


@F.arrow_udf(T.StringType())
def _canonical_any(s: pa.Array) -> pa.Array:
    return _each(s, T.StringType(), canonical)


@F.arrow_udf(TOKEN_TYPE)
def _refs(s: pa.Array) -> pa.Array:
    return _each(s, TOKEN_TYPE, lambda x: [dict(zip(("seq", "year", "raw", "keyworded"), t, strict=True)) for t in extract_refs(x)])


@F.arrow_udf(NUMBER_TYPE)
def _invoice_token(s: pa.Array) -> pa.Array:
    return _each(s, NUMBER_TYPE, lambda x: (t := invoice_token(x)) and {"seq": t[0], "year": t[1]})


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def canonical_of(c: Column, ascii_only: bool = False) -> Column:
    """canonical() of a column; ascii_only promises that no other text comes, and stays with built-in functions."""
    plain = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return plain if ascii_only else F.when(is_ascii(c), plain).otherwise(_canonical_any(F.when(~is_ascii(c), c)))


#: An ASCII text with one identifier, a year of YEARS and a number that is none: what extract_refs() reads there needs no Python.
_YEAR = "(?:199[0-9]|20[0-9][0-9]|2100)"
_OTHER = r"[\x00-\x7F&&[^0-9]]*"
_PLAIN = rf"\A({_OTHER})(({_YEAR})-((?!{_YEAR}(?![0-9]))[0-9]{{1,{LONGEST_RUN}}})){_OTHER}\z"


def refs_of(c: Column) -> Column:
    """extract_refs() of a column: by built-in functions for texts without digits and those of the plain form."""
    part = lambda k: F.regexp_extract(c, _PLAIN, k)
    keyworded = F.upper(F.right(part(1), F.lit(LOOKBEHIND))).rlike(_KEYWORD.pattern)
    one = F.struct(part(4).try_cast("long").alias("seq"), part(3).try_cast("int").alias("year"), part(2).alias("raw"), keyworded.alias("keyworded"))
    none, plain = F.coalesce(is_ascii(c) & ~c.rlike("[0-9]"), F.lit(True)), c.rlike(_PLAIN)
    return F.when(none, F.array().cast(TOKEN_TYPE)).when(plain, F.array(one).cast(TOKEN_TYPE)).otherwise(_refs(F.when(~none & ~plain, c)))


def is_plain(c: Column) -> Column:
    """Whether a text has no digits, or the plain form: plain_refs() reads what refs_of() does."""
    return F.coalesce(c.rlike(_PLAIN) | (is_ascii(c) & ~c.rlike("[0-9]")), F.lit(True))


def with_core(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the core of a text of the plain form, empty for one without digits, null for one that only Python reads; one look at each text."""
    c = F.col(text)
    bare = F.coalesce(is_ascii(c) & ~c.rlike("[0-9]"), F.lit(True))
    return df.withColumn("_core", F.regexp_extract(c, _PLAIN, 2)).withColumn(name, F.when(F.col("_core") != "", F.col("_core")).when(bare, "")).drop("_core")


def plain_core(c: Column) -> Column:
    """Year and number of a text of the plain form, empty for one without digits."""
    return F.coalesce(F.regexp_extract(c, _PLAIN, 2), F.lit(""))


def plain_number(core: Column) -> tuple[Column, Column]:
    """(sequence, year) of a core."""
    return F.substring(core, 6, LONGEST_RUN).try_cast("long"), F.left(core, F.lit(4)).try_cast("int")


def plain_refs(c: Column, core: Column) -> Column:
    """refs_of() of plain texts and their core."""
    seq, year = plain_number(core)
    before = F.upper(F.right(F.left(c, F.instr(c, core) - 1), F.lit(LOOKBEHIND)))
    one = F.struct(seq.alias("seq"), year.alias("year"), core.alias("raw"), before.rlike(_KEYWORD.pattern).alias("keyworded"))
    return F.when(core == "", F.array().cast(TOKEN_TYPE)).otherwise(F.array(one).cast(TOKEN_TYPE))


def invoice_token_of(c: Column) -> Column:
    """invoice_token() of a column: by built-in functions for numbers of the plain form."""
    one = F.struct(F.regexp_extract(c, _PLAIN, 4).try_cast("long").alias("seq"), F.regexp_extract(c, _PLAIN, 3).try_cast("int").alias("year")).cast(NUMBER_TYPE)
    return F.when(c.rlike(_PLAIN), one).otherwise(_invoice_token(F.when(~c.rlike(_PLAIN), c)))


def stripped(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    clean = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")  # the usual case, without a pattern
    return F.when(clean, c).otherwise(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
