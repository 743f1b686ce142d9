"""Names, identifiers and option strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that do not decompose into a base letter and a mark.
_SINGLE_LETTERS = {
    "Ð": "D",
    "ð": "d",
    "Ø": "O",
    "ø": "o",
    "Đ": "D",
    "đ": "d",
    "Ħ": "H",
    "ħ": "h",
    "ı": "i",
    "ĸ": "k",
    "Ŀ": "L",
    "ŀ": "l",
    "Ł": "L",
    "ł": "l",
    "Ŋ": "N",
    "ŋ": "n",
    "ſ": "s",
    "Ŧ": "T",
    "ŧ": "t",
}
_DOUBLE_LETTERS = {
    "Æ": "Ae",
    "æ": "ae",
    "Þ": "Th",
    "þ": "th",
    "ß": "ss",
    "Ĳ": "IJ",
    "ĳ": "ij",
    "Œ": "Oe",
    "œ": "oe",
    "ŉ": "'n",
}
# All of ASCII but letters, digits, ``_`` and ``-``.
_ASCII_GAPS = "".join(chr(n) for n in range(128) if not chr(n).isalnum() and chr(n) not in "_-")
_COMBINING_MARKS = "[̀-ͯ︠-︯⃐-⃿]"


def _accented_letters() -> dict[str, str]:
    """Latin-1 and Latin Extended-A letters that are a base letter plus marks."""
    plain = dict(_SINGLE_LETTERS)
    for code in range(0x00C0, 0x0180):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii() and base.isalpha():
            plain[letter] = base
    return plain


def strip_accents(text: Column) -> Column:
    letters = _accented_letters()
    single = F.translate(text, "".join(letters), "".join(letters.values()))
    double = single
    for letter, plain in _DOUBLE_LETTERS.items():
        double = F.replace(double, F.lit(letter), F.lit(plain))
    result = F.when(single.rlike("[" + "".join(_DOUBLE_LETTERS) + "]"), double).otherwise(single)
    return F.regexp_replace(result, _COMBINING_MARKS, "")


def slugify(name: Column) -> Column:
    """A free-form name as an identifier of ``[a-z0-9_-]``.

    A run of dashes and other characters becomes one dash. A regex over a class of several ranges costs many times a translated
    character, so characters of ASCII are translated, and regexes only look for those beyond it and for runs of dashes.
    """
    dashed = F.translate(F.lower(strip_accents(name)), _ASCII_GAPS, "-" * len(_ASCII_GAPS))
    dashed = F.regexp_replace(F.regexp_replace(dashed, r"[^\x00-\x7F]+", "-"), "--+", "-")
    return F.btrim(dashed, F.lit("-"))


def derive_id(id_: Column, name: Column) -> Column:
    return F.coalesce(id_, slugify(name))


def display_name(name: Column, id_: Column) -> Column:
    return F.coalesce(name, id_)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def split_list(text: Column) -> Column:
    """``a,b`` as an array, ready for ``explode``."""
    return F.split(text, ",")


def input_alias(spec: Column) -> Column:
    """``alias`` of ``alias=step``; a spec without ``=`` (or starting with it) is its own alias."""
    at = F.instr(spec, "=")
    return F.when(at > 1, F.substring(spec, F.lit(1), at - 1)).otherwise(spec)


def input_step(spec: Column) -> Column:
    at = F.instr(spec, "=")
    return F.when(at > 1, F.substring(spec, at + 1, F.length(spec))).otherwise(spec)


def mounted_as(step: Column) -> Column:
    return F.concat(F.lit("/input/"), step)


def output_mount(output_path: Column) -> Column:
    return F.coalesce(output_path, F.lit("/output"))
