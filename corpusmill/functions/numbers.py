"""Numbers written out in Dutch or Frisian, up to nine digits, with minus, decimals and the spoken halves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
DUTCH = dict(enumerate("nul een twee drie vier vijf zes zeven acht negen tien elf twaalf dertien veertien vijftien zestien zeventien achttien negentien".split()))
DUTCH |= dict(zip(range(20, 100, 10), "twintig dertig veertig vijftig zestig zeventig tachtig negentig".split(), strict=True)) | {100: "honderd", 1000: "duizend", 1_000_000: "miljoen"}
FRISIAN = dict(enumerate("nul ien twa trije fjouwer fiif seis sân acht njoggen tsien alve tolve trettjin fjirtjin fyftjin sechstjin santjin achttjin njoggentjin".split()))
FRISIAN |= dict(zip(range(20, 100, 10), "tweintich tritich fjirtich fyftich sechstich santich tachtich njoggentich".split(), strict=True)) | {100: "hûndert", 1000: "tûzen", 1_000_000: "miljoen"}
TABLES = {"Dutch": DUTCH, "Frisian": FRISIAN}
SPOKEN = {
    "Dutch": {"minus": "min", "comma": "komma", "half": "een half", "one_half": "anderhalf", "and_half": "en een half", "and": "en"},
    "Frisian": {"minus": "min", "comma": "komma", "half": "in heal", "one_half": "oardel", "and_half": "en in heal", "and": "en"},
}


def _below_hundred(n: int, table: dict[int, str], joint: str) -> str:
    if n in table:
        return table[n]
    unit, ten = n % 10, n - n % 10
    # e + en is written apart by a diaeresis in Dutch (tweeëntwintig)
    glue = "ën" if table is DUTCH and table[unit].endswith("e") else joint
    return table[unit] + glue + table[ten]


def whole(n: int, language: str, space: str = " ") -> str:
    """A number from 0 to 999,999,999; 1100-9900 with a hundreds digit are read as hundreds."""
    table, joint = TABLES[language], SPOKEN[language]["and"]
    if n in table:
        return table[n]
    if n < 100:
        return _below_hundred(n, table, joint)
    for size in (1_000_000, 1000, 100):
        if n >= size:
            if size == 1000 and n < 10_000 and (n // 100) % 10:
                size = 100
            head, rest = divmod(n, size)
            words = [] if head == 1 and size < 1_000_000 else [whole(head, language, space)]
            words.append(table[size])
            if rest:
                words.append(whole(rest, language, space))
            return space.join(words)
    raise AssertionError(n)


def spoken(text: str | None, language: str | None, space: str = " ") -> str | None:
    """None for what is no number, has more than nine digits before the comma, or another language.

    After a comma one or two digits are read as a number and more one by one; ,5 is a half, and 1,5 has its own word.
    """
    if text is None or language not in TABLES:
        return None
    said, body = SPOKEN[language], text.strip()
    minus, body = body.startswith("-"), body.removeprefix("-")
    head, mark, tail = body.replace(".", ",").partition(",")
    if not head.isascii() or not head.isdigit() or len(head) > 9 or (mark and not (tail.isascii() and tail.isdigit())):
        return None
    n = int(head)
    if mark and tail == "5":
        out = said["half"] if n == 0 else said["one_half"] if n == 1 else f"{whole(n, language, space)} {said['and_half']}"
    elif mark:
        zeros = len(tail) - len(tail.lstrip("0"))
        digits = [whole(int(d), language) for d in tail] if len(tail) > 2 or zeros else [whole(int(tail), language, space)]
        out = " ".join([whole(n, language, space), said["comma"], *digits])
    else:
        out = whole(n, language, space)
    return f"{said['minus']} {out}" if minus else out


def _spoken(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([spoken(t, x) for t, x in zip(text, language, strict=True)], dtype=object)


def number_words(text: Column, language: Column) -> Column:
    """The number in ``text`` in words, in the language of each row (Dutch or Frisian); null where it can't be read."""
    return F.pandas_udf(_spoken, "string")(text.cast("string"), language)


def _mapped(tokens: pd.Series, language: pd.Series) -> pd.Series:
    def one(found, name):
        said = {} if found is None else {t: spoken(t, name) for t in found}
        return {t: w for t, w in said.items() if w is not None}

    return pd.Series([one(t, x) for t, x in zip(tokens, language, strict=True)], dtype=object)


def number_map(tokens: Column, language: Column) -> Column:
    """Each of an array of number tokens with its words; what can't be read is left out. Only the numbers travel to Python."""
    return F.pandas_udf(_mapped, "map<string,string>")(tokens, language)
