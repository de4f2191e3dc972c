"""Checksums of identifiers as Spark SQL over numbers.

A candidate's digits are read once, as two numbers of ten digits each; every
digit that a check weighs is then a division and a remainder. So a check is a
short piece of integer arithmetic that Spark compiles, whatever the identifier.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that the checks read: the candidate, its digits alone, and the numbers in their last ten and the ten before.
RAW, DIGITS, HIGH, LOW = "raw", "digits", "digits_high", "digits_low"


def numbers(digits: Column, suffix: str = "") -> dict[str, Column]:
    """The columns HIGH and LOW of up to 20 digits; more are cut and pass no check's length."""
    padded = F.lpad(digits, 20, "0")
    return {HIGH + suffix: F.substring(padded, 1, 10).cast("bigint"), LOW + suffix: F.substring(padded, 11, 10).cast("bigint")}


class Number:
    """SQL for the digits of a number of n digits, counted from the left."""

    def __init__(self, n: int, low: str = LOW, high: str = HIGH) -> None:
        self.n, self.low, self.high = n, low, high

    def part(self, at: int, size: int) -> str:
        """The number in ``size`` digits from ``at``."""
        right = self.n - at - size
        if right >= 10:
            return f"(({self.high} div {10 ** (right - 10)}) % {10**size})"
        if right + size <= 10:
            return f"(({self.low} div {10**right}) % {10**size})" if right else f"({self.low} % {10**size})"
        over = right + size - 10
        return f"(({self.high} % {10**over}) * {10 ** (10 - right)} + {self.low} div {10**right})"

    def __getitem__(self, i: int) -> str:
        return self.part(i, 1)

    def sum(self, weights, at: int = 0) -> str:
        return "(" + " + ".join(f"{self[at + k]} * {w}" if w != 1 else self[at + k] for k, w in enumerate(weights) if w) + ")"


def _packed(values) -> int:
    """Ten small numbers in four bits each."""
    return sum(v << 4 * k for k, v in enumerate(values))


def _looked_up(table: str, d: str) -> str:
    return f"(shiftright({table}, cast(4 * {d} AS int)) & 15)"


#: Twice a digit, nine less above nine.
_TWICE = f"{_packed([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])}L"


def _luhn(x: Number, at: int = 0, extra: int = 0) -> str:
    """Luhn over the digits from ``at`` to the last, plus a constant for digits in front."""
    terms = [_looked_up(_TWICE, x[i]) if (x.n - i) % 2 == 0 else x[i] for i in range(at, x.n)]
    return f"(({' + '.join(terms)} + {extra}) % 10 = 0)"


def _all(*terms: str) -> str:
    return "(" + " AND ".join(terms) + ")"


def _length(*n: int) -> str:
    return f"length({DIGITS}) = {n[0]}" if len(n) == 1 else f"length({DIGITS}) BETWEEN {n[0]} AND {n[1]}"


def _rest(total: str, m: int = 10) -> str:
    """What is missing to the next multiple of m."""
    return f"(({m} - {total} % {m}) % {m})"


def luhn() -> str:
    return _all(_length(13, 19), _luhn(Number(20)))


def card() -> str:
    """Luhn, and not 14 digits that read as a date and time."""
    x = Number(14)
    stamp = _all(_length(14), f"{x.part(0, 4)} BETWEEN 1900 AND 2099", f"{x.part(4, 2)} BETWEEN 1 AND 12", f"{x.part(6, 2)} BETWEEN 1 AND 31", f"{x.part(8, 2)} <= 23", f"{x.part(10, 2)} <= 59", f"{x.part(12, 2)} <= 59")
    return _all(luhn(), f"NOT {stamp}")


def iban() -> str:
    """5 to 34 characters of A-Z and 0-9 besides blanks and tabs; the first four moved last, letters as 10..35, 1 modulo 97."""
    s = f"replace(replace({RAW}, ' ', ''), chr(9), '')"
    value = "CASE WHEN c < ':' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    step = "CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END"
    mod = f"aggregate(transform(split(concat(substr(t, 5), substr(t, 1, 4)), ''), c -> {value}), 0, (a, b) -> {step})"
    return f"exists(array({s}), t -> CASE WHEN length(t) BETWEEN 5 AND 34 AND t rlike '^[A-Z0-9]+$' THEN {mod} = 1 ELSE false END)"


def ch_ahv() -> str:
    x = Number(13)
    return _all(_length(13), f"{x.part(0, 3)} = 756", f"{_rest(x.sum((1, 3) * 6))} = {x[12]}")


def _modulo_11(x: Number, weights) -> str:
    """The last digit is 11 less the weighted sum's rest; a check number of ten is none."""
    c = f"(11 - {x.sum(weights)} % 11)"
    return _all(f"{c} <> 10", f"{c} % 11 = {x[x.n - 1]}")


def ch_uid() -> str:
    return _all(_length(9), _modulo_11(Number(9), (5, 4, 3, 2, 7, 6, 5, 4)))


def us_aba() -> str:
    x = Number(9)
    return _all(_length(9), f"{x[0]} NOT IN (4, 5, 9)", f"{LOW} % 111111111 <> 0", f"{x.sum((3, 7, 1) * 3)} % 10 = 0")


def us_ssn() -> str:
    x = Number(9)
    return _all(_length(9), f"{LOW} % 111111111 <> 0", f"{x.part(0, 3)} NOT IN (0, 666)", f"{x[0]} <> 9", f"{x.part(3, 2)} <> 0", f"{x.part(5, 4)} <> 0", f"{LOW} NOT IN (123456789, 987654320, 78051120, 219099999)")


def us_itin() -> str:
    x = Number(9)
    g = x.part(3, 2)
    return _all(_length(9), f"{x[0]} = 9", f"({g} BETWEEN 50 AND 65 OR {g} BETWEEN 70 AND 88 OR {g} BETWEEN 90 AND 92 OR {g} BETWEEN 94 AND 99)", f"{x.part(5, 4)} <> 0")


def us_npi() -> str:
    """Luhn behind the prefix 80840, whose digits add 24."""
    x = Number(10)
    return _all(_length(10), f"{x.part(0, 9)} % 111111111 <> 0", _luhn(x, extra=24))


def ca_sin() -> str:
    x = Number(9)
    return _all(_length(9), f"{x[0]} NOT IN (0, 8)", f"{LOW} % 111111111 <> 0", _luhn(x))


def au_tfn() -> str:
    return _all(_length(9), f"{Number(9).sum((1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0")


def au_acn() -> str:
    x = Number(9)
    return _all(_length(9), f"{_rest(x.sum(range(8, 0, -1)))} = {x[8]}")


def au_abn() -> str:
    """The first digit counts one less, a zero as nine."""
    x = Number(11)
    return _all(_length(11), f"((({x[0]} + 9) % 10) * 10 + {x.sum((1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 1)}) % 89 = 0")


def au_medicare() -> str:
    x = Number(10)
    return _all(_length(10), f"{x[0]} BETWEEN 2 AND 6", f"{x.sum((1, 3, 7, 9, 1, 3, 7, 9))} % 10 = {x[8]}")


def uk_nhs() -> str:
    return _all(_length(10), f"{LOW} % 1111111111 <> 0", _modulo_11(Number(10), range(10, 1, -1)))


def pl_pesel() -> str:
    """The month tells the century by steps of 20."""
    x = Number(11)
    m, d = x.part(2, 2), x.part(4, 2)
    month = f"(({m} - 1) % 20 + 1)"
    most = f"CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} = 2 THEN 29 ELSE 31 END"
    return _all(_length(11), f"{m} BETWEEN 1 AND 92", f"{month} <= 12", f"{d} BETWEEN 1 AND {most}", f"{_rest(x.sum((1, 3, 7, 9, 1, 3, 7, 9, 1, 3)))} = {x[10]}")


def kr_rrn() -> str:
    x = Number(13)
    return _all(_length(13), f"{x.part(2, 2)} BETWEEN 1 AND 12", f"{x.part(4, 2)} BETWEEN 1 AND 31", f"{x[6]} BETWEEN 1 AND 4", f"((11 - {x.sum((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))} % 11) % 10) = {x[12]}")


def tr_tckn() -> str:
    """A weighted sum below zero has a rest below zero and fits no digit."""
    x = Number(11)
    return _all(_length(11), f"{x[0]} <> 0", f"{x.sum((7, -1) * 4 + (7,))} % 10 = {x[9]}", f"{x.sum((1,) * 10)} % 10 = {x[10]}")


def th_tnin() -> str:
    x = Number(13)
    return _all(_length(13), f"{x[0]} <> 0", f"((11 - {x.sum(range(13, 1, -1))} % 11) % 10) = {x[12]}")


def it_vat() -> str:
    """Luhn over eleven digits."""
    return _all(_length(11), f"{HIGH} + {LOW} > 0", _luhn(Number(11)))


def de_tax() -> str:
    """No leading zero, no digit more than three times in the first ten, ISO 7064 modulo 11,10."""
    x = Number(11)
    p = "10"
    for i in range(10):
        p = f"((2 * (({x[i]} + {p} + 9) % 10 + 1)) % 11)"
    # Counts of the ten digits in four bits each; four and more show in the top bit once four is added to each.
    counts = " + ".join(f"shiftleft(1L, cast(4 * {x[i]} AS int))" for i in range(10))
    return _all(_length(11), f"{x[0]} <> 0", f"(({counts} + {_packed([4] * 10)}L) & {_packed([8] * 10)}L) = 0", f"((11 - {p}) % 10) = {x[10]}")


def _dihedral(a: int, b: int) -> int:
    """Product in the group of the pentagon: 0-4 rotations, 5-9 reflections."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


#: The Verhoeff scheme's permutation; its powers are used by position.
_VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def in_aadhaar() -> str:
    """Verhoeff's scheme: products in the pentagon's group, the digits permuted by their position from the right."""
    x = Number(12)
    rows = "array(" + ", ".join(f"{_packed([_dihedral(a, b) for b in range(10)])}L" for a in range(10)) + ")"
    power, c = list(range(10)), "0"
    for i in range(12):
        p = _looked_up(f"{_packed(power)}L", x[11 - i])
        c = _looked_up(f"get({rows}, cast({c} AS int))", p)
        power = [power[k] for k in _VERHOEFF_STEP] if i % 8 < 7 else list(range(10))
    return _all(_length(12), f"{x[0]} >= 2", f"reverse({DIGITS}) <> {DIGITS}", f"{c} = 0")


def se_personnummer() -> str:
    """The last ten of ten or twelve digits; a day above 60 marks a coordination number."""
    x = Number(10)
    day = x.part(4, 2)
    return _all(f"length({DIGITS}) IN (10, 12)", f"{x.part(2, 2)} BETWEEN 1 AND 12", f"({day} BETWEEN 1 AND 31 OR {day} BETWEEN 61 AND 91)", _luhn(x))


def se_orgnummer() -> str:
    x = Number(10)
    return _all(_length(10), f"{x[2]} >= 2", _luhn(x))


# Fixed value: letters of Spanish tax numbers by their rest modulo 23.
_NIF = "TRWAGMYFPDXBNJZSQVHLCKE"


def _letter(letters: str, at: str, i: int) -> str:
    """Whether character ``i`` of the candidate without dashes, in upper case, is the letter at the 0-based place ``at``."""
    return f"substr('{letters}', cast({at} AS int) + 1, 1) = substr(upper(replace({RAW}, '-', '')), {i}, 1)"


def es_nif() -> str:
    return _all(f"length(replace({RAW}, '-', '')) BETWEEN 8 AND 9", _letter(_NIF, f"{LOW} % 23", -1))


def es_nie() -> str:
    first = f"ascii(upper({RAW}))"
    return _all(f"length(replace({RAW}, '-', '')) = 9", f"{first} BETWEEN 88 AND 90", _letter(_NIF, f"(({first} - 88) * 10000000 + {LOW}) % 23", 9))


# Check letters of Singapore's numbers by first letter, and what the letter adds.
_NRIC = (("ST", "JZIHGFEDCBA"), ("FG", "XWUTRQPNMLK"), ("M", "KLJNPQRTUWX"))


def sg_nric() -> str:
    first = f"substr(upper({RAW}), 1, 1)"
    total = f"({Number(7).sum((2, 7, 6, 5, 4, 3, 2))} + CASE {first} WHEN 'T' THEN 4 WHEN 'G' THEN 4 WHEN 'M' THEN 3 ELSE 0 END) % 11"
    fits = " OR ".join(_all(f"{first} IN ({', '.join(repr(c) for c in firsts)})", _letter(letters, total, 9)) for firsts, letters in _NRIC)
    return _all(f"length(replace({RAW}, '-', '')) = 9", f"({fits})")


# Fixed value: check characters of Finnish personal codes by their rest modulo 31.
_PIC = "0123456789ABCDEFHJKLMNPRSTUVWXY"


def fi_pic() -> str:
    """Day, month, year, a century mark, a serial number, a check character that may be a digit."""
    x = f"(CASE WHEN length({DIGITS}) = 10 THEN {LOW} div 10 ELSE {LOW} END)"
    return _all(f"length({RAW}) = 11", f"{x} div 10000000 BETWEEN 1 AND 31", f"({x} div 100000) % 100 BETWEEN 1 AND 12", f"substr('{_PIC}', cast({x} % 31 AS int) + 1, 1) = substr({RAW}, 11, 1)")


def us_dea() -> str:
    x = Number(7)
    return _all(f"length(replace({RAW}, '-', '')) = 9", f"{x.sum((1, 2, 1, 2, 1, 2))} % 10 = {x[6]}")


CHECKS = {f.__name__: f for f in (luhn, card, iban, ch_ahv, ch_uid, us_aba, us_ssn, us_itin, us_npi, ca_sin, au_tfn, au_acn, au_abn, au_medicare, uk_nhs, pl_pesel, kr_rrn, tr_tckn, th_tnin, it_vat, de_tax, in_aadhaar, se_personnummer, se_orgnummer, es_nif, es_nie, sg_nric, fi_pic, us_dea)}


def _renamed(text: str, names: dict[str, str]) -> str:
    return re.sub(rf"(?<![a-z_.])({'|'.join(names)})(?![a-z_])", lambda m: names[m[1]], text)


def check_sql(name: str, suffix: str = "") -> str:
    """The check over the columns RAW, DIGITS, HIGH and LOW, with a suffix to their names; null only where they are."""
    text = CHECKS[name]()
    return _renamed(text, {c: c + suffix for c in (RAW, DIGITS, HIGH, LOW)}) if suffix else text


def check_any(name: str, x: str) -> str:
    """The check as SQL over any text expression, for use outside the detectors; its digits are read once."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    part = lambda at: f"cast(substr(lpad({digits}, 20, '0'), {at}, 10) AS bigint)"
    body = _renamed(check_sql(name), {c: f"v.c{k}" for k, c in enumerate((RAW, DIGITS, HIGH, LOW))})
    return f"exists(array(named_struct('c0', {x}, 'c1', {digits}, 'c2', {part(1)}, 'c3', {part(11)})), v -> {body})"
