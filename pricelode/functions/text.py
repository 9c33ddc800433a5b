"""Text functions (T1-T17). Column functions run in the JVM; the numeric unit rewriting of
:func:`normalize` is one Arrow UDF over distinct texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pricelode.constants import ABBREVIATIONS, STOPWORDS


def _latin() -> tuple[str, str]:
    """Letters beyond ASCII that are a letter with marks, and those letters: built from Unicode's decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _latin()


def strip_accents(c: Column) -> Column:
    """Marks go, letters stay (n for ñ)."""
    return F.regexp_replace(F.translate(c, _MARKED, _BARE), "[̀-ͯ]", "")


def folded(c: Column) -> Column:
    return F.lower(strip_accents(c))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def stemmed(tokens: Column) -> Column:
    """Stopwords go, and a final s of words longer than four whose letter before it is no digit."""
    kept = F.filter(tokens, lambda w: ~w.isin(*STOPWORDS))
    return F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~F.substring(w, -2, 1).rlike("[0-9]"), F.regexp_replace(w, "s$", "")).otherwise(w))


def normalize_plain(c: Column) -> Column:
    """T2 without the unit rewriting: for texts that name no sizes."""
    return F.array_join(stemmed(words(F.regexp_replace(folded(c), "[^a-z0-9/ ]+", " "))), " ")


def code_key(c: Column) -> Column:
    """Upper case, letters and digits alone."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def fingerprint(*parts: Column) -> Column:
    """A text's identity whatever its spaces and case: 16 hex digits."""
    tidy = [F.lower(F.trim(F.regexp_replace(p, r"\s+", " "))) for p in parts]
    return F.substring(F.sha1(F.concat_ws(" ", *tidy)), 1, 16)


def row_key(block: Column, line: Column, description: Column) -> Column:
    """10 hex digits for a quoted line."""
    return F.substring(F.sha1(F.concat_ws("|", block, line, description)), 1, 10)


def sizes(normalized: Column) -> Column:
    """Distinct size tokens (25g, 500cc, 12u) of a normalized text."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(r"\b(\d+(?:\.\d+)?(?:g|cc|u))\b"), F.lit(1)))


def size_conflict(a: Column, b: Column) -> Column:
    """both name sizes and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def weight_kg(normalized: Column) -> Column:
    """The first size in grams, in kilos; null without any."""
    return F.regexp_extract(normalized, r"\b(\d+(?:\.\d+)?)g\b", 1).try_cast("double") / 1000


def text_variants(c: Column) -> Column:
    """The text, and the text without a bought quantity in front."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"^\s*\d{1,3}\s+(?=[a-zA-Záéíóúñ])", "")))


#: How each unit is spelled in names; fixed values.
SPELLED = {"g": r"(?:kilos?|kgs?|kg|gramos?|grs?|gr|gs|g)", "cc": r"(?:litros?|lts?|lt|l|cc|ml)", "u": r"(?:unidades?|unid\.?|un|u|uds?)"}


def with_size(name: Column, quoted: Column) -> Column:
    """The name with its first size of the quote's unit replaced by the quote's; ``quoted`` is normalized."""
    value, unit = (F.regexp_extract(quoted, r"\b(\d+(?:\.\d+)?)(g|cc|u)\b", k) for k in (1, 2))
    put = F.concat(F.lit("$1"), value, F.lit(" "), unit)
    out = name
    for u, spelled in SPELLED.items():
        out = F.when(unit == u, F.regexp_replace(name, F.lit(rf"(?isU)^(.*?)\b\d+(?:[.,]\d+)?\s*{spelled}\b"), put)).otherwise(out)
    return out


def joined_letters(c: Column) -> Column:
    """Letters that the page spaced out are a word again, and a stray capital inside a word goes."""
    letter = "[A-Za-zÁÉÍÓÚáéíóúÑñ]"
    runs = F.regexp_extract_all(c, F.lit(rf"(?U)\b((?:{letter} ){{2,}}{letter})\b"), F.lit(1))
    whole = F.aggregate(runs, c, lambda text, run: F.replace(text, run, F.replace(run, F.lit(" "), F.lit(""))))
    return F.regexp_replace(whole, "([a-záéíóúñ]) [A-Z] ([a-záéíóúñ])", "$1$2")


# --- plain versions for the Arrow UDFs

_UNITS = {u: ("g", 1000) for u in ("kilo", "kilos", "kg", "kgs")}
_UNITS |= {u: ("g", 1) for u in ("gramo", "gramos", "gr", "grs", "gs", "g")}
_UNITS |= {u: ("cc", 1000) for u in ("litro", "litros", "lt", "lts", "l")}
_UNITS |= {u: ("cc", 1) for u in ("cc", "ml", "mililitro", "mililitros")}
_AMOUNT = re.compile(r"\b(\d+(?:[.,]\d+)?)\s*(" + "|".join(sorted(_UNITS, key=len, reverse=True)) + r")\b")
_COUNT = re.compile(r"\b(\d+)\s*(?:unidades?|unid\.?|un|u|uds?)\b")
_PACK = re.compile(r"\b\d{1,3}\s*x\s*(\d+(?:[.,]\d+)?)\s*(gramos?|grs?|gr|gs|g|kg|cc|ml|l)\b")
_FRACTION = re.compile(r"\b([13])\s*/\s*([24])\s*(?:kg|kilos?)\b")
_LOOSE = re.compile(r"\bx\s*(\d+)(?![\w.,])(?!\s*(?:g|gs|gr|grs|gramos?|kg|kilos?|cc|ml|l|lt|litros?)\b)")
_SIZE = re.compile(r"\b(\d+(?:\.\d+)?)(g|cc|u)\b")
_STOP = frozenset(STOPWORDS)
_SHORT = [(re.compile(p), r) for p, r in ABBREVIATIONS]


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def _amount(m: re.Match) -> str:
    unit, factor = _UNITS[m[2]]
    return f"{float(m[1].replace(',', '.')) * factor:g}{unit}"


def _loose(m: re.Match) -> str:
    digits = m[1]
    if len(digits) > 2:
        return digits + "g"
    return digits + "u" if int(digits) <= 48 else digits


def _fraction(m: re.Match) -> str:
    grams = {("1", "2"): 500, ("1", "4"): 250, ("3", "4"): 750}.get((m[1], m[2]))
    return f"{grams} g" if grams else m[0]


def normalize_text(text: str | None) -> str:
    """The canonical key of a name: sizes in g, cc and u, no accents, no stopwords, no plural s."""
    s = bare(text or "").translate({0xBD: "1/2", 0xBC: "1/4", 0xD7: "x", 0xB7: "x"})
    s = _FRACTION.sub(_fraction, _PACK.sub(r"\1 \2", s))
    s = _LOOSE.sub(_loose, _COUNT.sub(r"\1u", _AMOUNT.sub(_amount, s)))
    out = []
    for w in re.sub("[^a-z0-9/ ]+", " ", s).split():
        if w not in _STOP:
            out.append(w[:-1] if len(w) > 4 and w[-1] == "s" and not w[-2].isdigit() else w)
    return " ".join(out)


def own_abbreviations(pairs: Iterable[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    """T5: a business's abbreviations: whole words; an empty meaning deletes the word."""
    return [(re.compile(rf"\b{re.escape(bare(str(t)).strip())}\b"), bare(str(m)).strip()) for t, m in pairs if str(t).strip()]


def expand_text(text: str | None, own: list[tuple[re.Pattern, str]] = ()) -> str:
    """T4: abbreviations of supplier texts written out. Own ones are a parameter, never a global."""
    s = bare(text or "")
    for pattern, meaning in [*_SHORT, *own]:
        s = pattern.sub(meaning, s)
    return s


def size_tokens(text: str | None, of_supplier: bool = True, own=()) -> set[tuple[str, str]]:
    return set(_SIZE.findall(normalize_text(expand_text(text, own) if of_supplier else text)))


def size_note(quoted: str, name: str, own=()) -> str:
    """F13 as a message: the supplier quotes another size than the product's."""
    a, b = size_tokens(quoted, own=own), size_tokens(name, False)
    if not a or not b or a & b:
        return ""
    listed = [", ".join(v + u for v, u in sorted(s)) for s in (a, b)]
    return f"presentación distinta: proveedor {listed[0]} / Odoo {listed[1]}"


def corrected_size(quoted: str, name: str, own=()) -> str:
    """The name with its first size of the quote's unit replaced by the quote's."""
    m = _SIZE.search(normalize_text(expand_text(quoted, own)))
    if not m:
        return name
    value, unit = m.groups()
    return re.sub(rf"\b\d+(?:[.,]\d+)?\s*{SPELLED[unit]}\b", f"{value} {unit}", name, count=1, flags=re.I)


@F.pandas_udf(StringType())
def normalize(c: pd.Series) -> pd.Series:
    """T2 on Arrow batches; equal texts of a batch are worked on once."""
    once = {t: normalize_text(t) for t in c.unique()}
    return c.map(once)


def normalize_quoted(own: list[tuple[str, str]] = ()):
    """T2 after T4: a UDF for supplier texts with these abbreviations."""
    pairs = list(own)

    @F.pandas_udf(StringType())
    def run(c: pd.Series) -> pd.Series:
        mine = own_abbreviations(pairs)
        return c.map({t: normalize_text(expand_text(t, mine)) for t in c.unique()})

    return run
