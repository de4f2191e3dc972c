"""Checksums of identifiers as DuckDB SQL over a text ``x``, for the oracles.

Written apart from the Spark form in ``checks``: digits are read character by
character, and the Verhoeff scheme by its tables.
"""

from __future__ import annotations

def _d(x: str, i: int) -> str:
    return f"(ascii(substr({x}, {i + 1}, 1)) - 48)"


def _n(x: str, at: int, n: int) -> str:
    """The number in n digits from 0-based ``at``."""
    return "(" + " + ".join(f"{_d(x, at + k)} * {10 ** (n - 1 - k)}" for k in range(n)) + ")"


def _sum(x: str, weights, at: int = 0) -> str:
    return "(" + " + ".join(f"{_d(x, at + k)} * {w}" for k, w in enumerate(weights)) + ")"


def _doubled(d: str) -> str:
    """Twice a digit, nine less above nine."""
    return f"(2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)"


def _luhn(x: str, n: int) -> str:
    """Luhn over exactly n digits."""
    return "((" + " + ".join(_doubled(_d(x, i)) if i % 2 == n % 2 else _d(x, i) for i in range(n)) + ") % 10 = 0)"


def _same(x: str) -> str:
    return f"(replace({x}, substr({x}, 1, 1), '') = '')"


def _check10(total: str) -> str:
    return f"((10 - {total} % 10) % 10)"


def _all(*terms: str) -> str:
    return "(" + " AND ".join(terms) + ")"


def luhn(x: str) -> str:
    """13 to 19 digits, Luhn sum 0; x is digits alone."""
    return f"CASE WHEN length({x}) BETWEEN 13 AND 19 THEN {_luhn(f'lpad({x}, 20, chr(48))', 20)} ELSE false END"


def card(x: str) -> str:
    """Luhn, and not 14 digits that read as year, month, day, hour, minute and second; x is digits alone."""
    stamp = _all(f"{_n(x, 0, 4)} BETWEEN 1900 AND 2099", f"{_n(x, 4, 2)} BETWEEN 1 AND 12", f"{_n(x, 6, 2)} BETWEEN 1 AND 31", f"{_n(x, 8, 2)} <= 23", f"{_n(x, 10, 2)} <= 59", f"{_n(x, 12, 2)} <= 59")
    return f"CASE WHEN length({x}) = 14 AND {stamp} THEN false ELSE {luhn(x)} END"


def iban(x: str) -> str:
    """5 to 34 characters of A-Z and 0-9 after blanks and tabs go; the first four moved last, letters as 10..35, 1 modulo 97."""
    s = f"replace(replace({x}, ' ', ''), chr(9), '')"
    turned = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    value = "CASE WHEN c < ':' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    step = "CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END"
    mod = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {value})), lambda a, b: {step})"
    return f"CASE WHEN length({s}) BETWEEN 5 AND 34 AND regexp_matches({s}, '^[A-Z0-9]+$') THEN {mod} = 1 ELSE false END"


def ch_ahv(x: str) -> str:
    return _all(f"length({x}) = 13", f"substr({x}, 1, 3) = '756'", f"{_check10(_sum(x, (1, 3) * 6))} = {_d(x, 12)}")


def ch_uid(x: str) -> str:
    c = f"(11 - {_sum(x, (5, 4, 3, 2, 7, 6, 5, 4))} % 11)"
    return _all(f"length({x}) = 9", f"{c} <> 10", f"{c} % 11 = {_d(x, 8)}")


def us_aba(x: str) -> str:
    return _all(f"length({x}) = 9", f"substr({x}, 1, 1) NOT IN ('4', '5', '9')", f"NOT {_same(x)}", f"{_sum(x, (3, 7, 1) * 3)} % 10 = 0")


def us_ssn(x: str) -> str:
    return _all(f"length({x}) = 9", f"NOT {_same(x)}", f"substr({x}, 1, 3) NOT IN ('000', '666')", f"substr({x}, 1, 1) <> '9'", f"substr({x}, 4, 2) <> '00'", f"substr({x}, 6, 4) <> '0000'", f"{x} NOT IN ('123456789', '987654320', '078051120', '219099999')")


def us_itin(x: str) -> str:
    g = _n(x, 3, 2)
    return _all(f"length({x}) = 9", f"substr({x}, 1, 1) = '9'", f"({g} BETWEEN 50 AND 65 OR {g} BETWEEN 70 AND 88 OR {g} BETWEEN 90 AND 92 OR {g} BETWEEN 94 AND 99)", f"substr({x}, 6, 4) <> '0000'")


def us_npi(x: str) -> str:
    return _all(f"length({x}) = 10", f"NOT {_same(f'substr({x}, 1, 9)')}", _luhn(f"concat('80840', {x})", 15))


def ca_sin(x: str) -> str:
    return _all(f"length({x}) = 9", f"substr({x}, 1, 1) NOT IN ('0', '8')", f"NOT {_same(x)}", _luhn(x, 9))


def au_tfn(x: str) -> str:
    return _all(f"length({x}) = 9", f"{_sum(x, (1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0")


def au_acn(x: str) -> str:
    return _all(f"length({x}) = 9", f"{_check10(_sum(x, range(8, 0, -1)))} = {_d(x, 8)}")


def au_abn(x: str) -> str:
    first = f"(({_d(x, 0)} + 9) % 10) * 10"
    return _all(f"length({x}) = 11", f"({first} + {_sum(x, (1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 1)}) % 89 = 0")


def au_medicare(x: str) -> str:
    return _all(f"length({x}) = 10", f"{_d(x, 0)} BETWEEN 2 AND 6", f"{_sum(x, (1, 3, 7, 9, 1, 3, 7, 9))} % 10 = {_d(x, 8)}")


def uk_nhs(x: str) -> str:
    c = f"(11 - {_sum(x, range(10, 1, -1))} % 11)"
    return _all(f"length({x}) = 10", f"NOT {_same(x)}", f"{c} <> 10", f"{c} % 11 = {_d(x, 9)}")


def pl_pesel(x: str) -> str:
    m, d = _n(x, 2, 2), _n(x, 4, 2)
    month = f"(({m} - 1) % 20 + 1)"
    ok = f"({m} BETWEEN 1 AND 12 OR {m} BETWEEN 21 AND 32 OR {m} BETWEEN 41 AND 52 OR {m} BETWEEN 61 AND 72 OR {m} BETWEEN 81 AND 92)"
    most = f"CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} = 2 THEN 29 ELSE 31 END"
    return _all(f"length({x}) = 11", ok, f"{d} BETWEEN 1 AND {most}", f"{_check10(_sum(x, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)))} = {_d(x, 10)}")


def kr_rrn(x: str) -> str:
    return _all(f"length({x}) = 13", f"{_n(x, 2, 2)} BETWEEN 1 AND 12", f"{_n(x, 4, 2)} BETWEEN 1 AND 31", f"{_d(x, 6)} BETWEEN 1 AND 4", f"((11 - {_sum(x, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))} % 11) % 10) = {_d(x, 12)}")


def tr_tckn(x: str) -> str:
    odd, even = _sum(x, (1, 0, 1, 0, 1, 0, 1, 0, 1)), _sum(x, (0, 1, 0, 1, 0, 1, 0, 1))
    return _all(f"length({x}) = 11", f"{_d(x, 0)} <> 0", f"({odd} * 7 - {even}) % 10 = {_d(x, 9)}", f"{_sum(x, (1,) * 10)} % 10 = {_d(x, 10)}")


def th_tnin(x: str) -> str:
    r = f"({_sum(x, range(13, 1, -1))} % 11)"
    return _all(f"length({x}) = 13", f"{_d(x, 0)} <> 0", f"(CASE WHEN {r} <= 1 THEN 1 ELSE 11 END) - {r} = {_d(x, 12)}")


def it_vat(x: str) -> str:
    total = "(" + " + ".join(_doubled(_d(x, i)) if i % 2 else _d(x, i) for i in range(10)) + ")"
    return _all(f"length({x}) = 11", f"{x} <> '00000000000'", f"{_check10(total)} = {_d(x, 10)}")


def de_tax(x: str) -> str:
    """No leading zero, no digit more than three times in the first ten, ISO 7064 modulo 11,10."""
    p = "10"
    for i in range(10):
        p = f"((2 * (({_d(x, i)} + {p} + 9) % 10 + 1)) % 11)"
    few = _all(*[f"10 - length(replace(substr({x}, 1, 10), '{k}', '')) <= 3" for k in range(10)])
    return _all(f"length({x}) = 11", f"{_d(x, 0)} <> 0", few, f"((11 - {p}) % 10) = {_d(x, 10)}")


def _dihedral(a: int, b: int) -> int:
    """Product in the group of the pentagon: 0-4 rotations, 5-9 reflections."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


#: The Verhoeff scheme's permutation; its powers are used by position.
_VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _verhoeff_tables() -> tuple[str, str]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][k] for k in _VERHOEFF_STEP])
    return "".join(str(_dihedral(a, b)) for a in range(10) for b in range(10)), "".join(str(k) for row in rows for k in row)


_VERHOEFF_D, _VERHOEFF_P = _verhoeff_tables()


def in_aadhaar(x: str) -> str:
    c = "0"
    for i in range(12):
        p = f"(ascii(substr('{_VERHOEFF_P}', {i % 8 * 10 + 1} + {_d(x, 11 - i)}, 1)) - 48)"
        c = f"(ascii(substr('{_VERHOEFF_D}', {c} * 10 + {p} + 1, 1)) - 48)"
    return _all(f"length({x}) = 12", f"{_d(x, 0)} >= 2", f"reverse({x}) <> {x}", f"{c} = 0")


def se_personnummer(x: str) -> str:
    t = f"substr({x}, length({x}) - 9, 10)"
    day = _n(t, 4, 2)
    return _all(f"length({x}) IN (10, 12)", f"{_n(t, 2, 2)} BETWEEN 1 AND 12", f"({day} BETWEEN 1 AND 31 OR {day} BETWEEN 61 AND 91)", _luhn(t, 10))


def se_orgnummer(x: str) -> str:
    return _all(f"length({x}) = 10", f"{_d(x, 2)} >= 2", _luhn(x, 10))


_NIF = "TRWAGMYFPDXBNJZSQVHLCKE"


def _nif(number: str, letter: str) -> str:
    return f"substr('{_NIF}', {number} % 23 + 1, 1) = {letter}"


def es_nif(x: str) -> str:
    s = f"lpad(replace(upper({x}), '-', ''), 9, '0')"
    return _all(f"length(replace({x}, '-', '')) BETWEEN 8 AND 9", _nif(_n(s, 0, 8), f"substr({s}, 9, 1)"))


def es_nie(x: str) -> str:
    s = f"replace(upper({x}), '-', '')"
    n = f"((ascii(substr({s}, 1, 1)) - 88) * 10000000 + {_n(s, 1, 7)})"
    return _all(f"length({s}) = 9", f"substr({s}, 1, 1) IN ('X', 'Y', 'Z')", _nif(n, f"substr({s}, 9, 1)"))


def sg_nric(x: str) -> str:
    s = f"upper({x})"
    total = f"({_sum(s, (2, 7, 6, 5, 4, 3, 2), 1)} + CASE substr({s}, 1, 1) WHEN 'T' THEN 4 WHEN 'G' THEN 4 WHEN 'M' THEN 3 ELSE 0 END)"
    table = f"CASE WHEN substr({s}, 1, 1) IN ('S', 'T') THEN 'JZIHGFEDCBA' WHEN substr({s}, 1, 1) = 'M' THEN 'KLJNPQRTUWX' ELSE 'XWUTRQPNMLK' END"
    return _all(f"length({s}) = 9", f"substr({table}, {total} % 11 + 1, 1) = substr({s}, 9, 1)")


def fi_pic(x: str) -> str:
    n = f"({_n(x, 0, 6)} * 1000 + {_n(x, 7, 3)})"
    return _all(f"length({x}) = 11", f"{_n(x, 0, 2)} BETWEEN 1 AND 31", f"{_n(x, 2, 2)} BETWEEN 1 AND 12", f"substr('0123456789ABCDEFHJKLMNPRSTUVWXY', {n} % 31 + 1, 1) = substr({x}, 11, 1)")


def us_dea(x: str) -> str:
    return _all(f"length({x}) = 9", f"({_sum(x, (1, 0, 1, 0, 1), 2)} + 2 * {_sum(x, (0, 1, 0, 1, 0, 1), 2)}) % 10 = {_d(x, 8)}")


#: Checks whose argument is the match's digits, not the match.
ON_DIGITS = frozenset({"luhn", "card", "ch_ahv", "ch_uid"})

CHECKS = {f.__name__: f for f in (luhn, card, iban, ch_ahv, ch_uid, us_aba, us_ssn, us_itin, us_npi, ca_sin, au_tfn, au_acn, au_abn, au_medicare, uk_nhs, pl_pesel, kr_rrn, tr_tckn, th_tnin, it_vat, de_tax, in_aadhaar, se_personnummer, se_orgnummer, es_nif, es_nie, sg_nric, fi_pic, us_dea)}


def check_sql(name: str, x: str) -> str:
    return CHECKS[name](x)
