"""Checksums: published numbers, and the Spark form against the DuckDB form over random texts."""

import random

import duckdb
import pytest

from sparksieve.functions import checks, checks_duckdb
from sparksieve.functions.checks import CHECKS, check_any

#: Numbers that the issuers or the literature give as valid, and changed ones.
KNOWN = {
    "luhn": (["4532015112830366", "378282246310005", "5500000000000004", "6011000990139424"], ["4532015112830367", "123"]),
    "card": (["4532015112830366"], ["20240131235958"]),
    "iban": (["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "CH9300762011623852957"], ["DE89370400440532013001", "de89370400440532013000"]),
    "ch_ahv": (["756.1234.5678.97", "756.9217.0769.85"], ["756.1234.5678.98"]),
    "ch_uid": (["CHE-105.962.533", "CHE-116.281.710"], ["CHE-105.962.534"]),
    "us_aba": (["011000015", "021000021"], ["021000022", "111111111"]),
    "us_ssn": (["219-12-3456"], ["000-12-3456", "666-12-3456", "900-12-3456", "123456789"]),
    "us_itin": (["912-70-1234", "999-88-9999"], ["812-70-1234", "912-69-1234", "912-93-1234"]),
    "us_npi": (["1234567893", "1245319599"], ["1234567890"]),
    "ca_sin": (["130692544"], ["046454286", "130692545"]),
    "au_tfn": (["123456782", "876543210"], ["123456783"]),
    "au_acn": (["004085616", "000000019"], ["004085617"]),
    "au_abn": (["51824753556", "83914571673"], ["51824753557"]),
    "au_medicare": (["2123456701"], ["2123456711", "9123456701"]),
    "uk_nhs": (["9434765919", "4010232137"], ["9434765918", "1111111111"]),
    "pl_pesel": (["44051401359", "02070803628"], ["44051401358"]),
    "kr_rrn": (["8803011234569"], ["8803011234563", "8813011234569"]),
    "tr_tckn": (["10000000146"], ["10000000147", "00000000146"]),
    "th_tnin": (["1101700230708"], ["1101700230709"]),
    "it_vat": (["00743110157", "07643520567"], ["00743110158", "00000000000"]),
    "de_tax": (["86095742719", "65929970489"], ["86095742718", "06095742719"]),
    "in_aadhaar": (["234567890124"], ["234567890123", "134567890124"]),
    "se_personnummer": (["8112189876", "198112189876"], ["8112189877"]),
    "se_orgnummer": (["5560360793", "2021005489"], ["5560360794", "5510360793"]),
    "es_nif": (["12345678Z", "00000000T"], ["12345678A"]),
    "es_nie": (["X1234567L", "Y1234567X", "Z1234567R"], ["X1234567A"]),
    "sg_nric": (["S1234567D", "T0000001E", "F1234567N"], ["S1234567A"]),
    "fi_pic": (["131052-308T", "010101A0101"], ["131052-308U", "321052-308T"]),
    "us_dea": (["AP5836727", "BB1388568"], ["AP5836728"]),
}


def valid(spark, rows):
    """Results of (check, text) pairs."""
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "k int, name string, x string")
    cases = " ".join(f"WHEN '{n}' THEN {check_any(n, 'x')}" for n in CHECKS)
    return [r["ok"] for r in df.selectExpr("k", f"CASE name {cases} END AS ok").orderBy("k").collect()]


def test_published_numbers(spark):
    assert set(KNOWN) == set(CHECKS) == set(checks_duckdb.CHECKS)
    rows = [(n, x, ok) for n, sides in KNOWN.items() for ok, xs in zip((True, False), sides) for x in xs]
    got = valid(spark, [r[:2] for r in rows])
    wrong = [r for r, g in zip(rows, got) if g is not r[2]]
    assert not wrong


def test_both_forms_agree(spark):
    """Also on texts of other lengths, and close to valid ones."""
    rng = random.Random(8)
    rows = []
    for n, (good, bad) in KNOWN.items():
        for x in good + bad:
            for _ in range(25):
                y = list(x)
                for k in rng.sample(range(len(y)), rng.choice((1, 1, 2, 3))):
                    if y[k].isdigit():
                        y[k] = rng.choice("0123456789")
                rows.append((n, "".join(y)))
        if n not in ("iban", "es_nif", "es_nie", "sg_nric", "fi_pic", "us_dea"):
            rows += [(n, "".join(rng.choice("0123456789") for _ in range(rng.choice((len(good[0]), 9, 10, 11, 12, 13, 19, 25))))) for _ in range(40)]
    got = valid(spark, rows)
    con = duckdb.connect()
    want = []
    for n, x in rows:
        text = "regexp_replace(x, '[^0-9]', '', 'g')" if n not in ("iban", "es_nif", "es_nie", "sg_nric", "fi_pic", "us_dea") else "x"
        want.append((n, x, text))
    for n in KNOWN:
        mine = [(k, x, t) for k, (m, x, t) in enumerate(want) if m == n]
        values = ", ".join(f"({k}, '{x}')" for k, x, _ in mine)
        for k, ok in con.execute(f"SELECT k, coalesce({checks_duckdb.check_sql(n, 'd')}, false) FROM (SELECT k, {mine[0][2]} AS d FROM (VALUES {values}) AS v(k, x))").fetchall():
            assert bool(got[k]) == bool(ok), (n, rows[k])


@pytest.mark.parametrize("at,size,want", [(0, 2, 12), (2, 3, 345), (9, 4, 123), (11, 2, 23), (1, 9, 234567890)])
def test_parts_of_numbers(at, size, want):
    n = checks.Number(13)
    hi, lo = 123, 4567890123  # 1234567890123
    got = eval(n.part(at, size).replace("digits_high", str(hi)).replace("digits_low", str(lo)).replace(" div ", " // "))  # noqa: S307
    assert got == want
