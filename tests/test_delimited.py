import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.sources.delimited import Field, parse_batch, parse_lines

FIELDS = (Field("brand"), Field("category"), Field("manufacturer", name_like=True), Field("launch_year", "int", 1900, 2024))


def by_hand(line):
    """A reader that goes through one line character by character."""
    fields, i = [], 0
    while True:
        text = ""
        if line[i : i + 1] == '"':
            i += 1
            while True:
                if i >= len(line):
                    return "quoting", None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return "quoting", None
        else:
            while i < len(line) and line[i] != ",":
                if line[i] == '"':
                    return "quoting", None
                text, i = text + line[i], i + 1
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 4:
        return "columns", None
    year, maker = fields[3].strip(" "), fields[2]
    if year:
        digits = year[1:] if year[0] in "+-" else year
        if not digits or any(c not in "0123456789" for c in digits) or not 1900 <= int(year) <= 2024:
            return "value", None
    if maker and (not any(map(str.isalpha, maker)) or any(c < " " or c in "\x7f�" for c in maker)):
        return "value", None
    return None, (fields[0] or None, fields[1] or None, maker or None, int(year) if year else None)


def check(lines):
    reason, values = parse_batch(pa.array(lines, pa.string()), FIELDS)
    for line, why, *row in zip(lines, reason.to_pylist(), *(v.to_pylist() for v in values), strict=True):
        want, fields = by_hand(line)
        assert why == want, (line, why, want)
        assert tuple(row) == (fields or (None,) * 4), line


CASES = [
    "a,b,c,2000", '"a","b","c","2000"', '"a""b",c,"d,e",1999', '"",,"",""', ",,,", ",,,,", "a,b,c", 'a"b,c,d,1', '"a"b,c,d,1', '"a,b,c,1', '"a""",b,c,2000', '""a"",b,c,1', 'a,b,c,"2000" ', 'a,b,c, 2000 ',
    "a,b,c,+2000", "a,b,c,-2000", "a,b,c,002000", "a,b,c,1899", "a,b,c,2025", "a,b,c,20x0", "a,b,c,２０００", "a,b,c,\t2000", "a,b,c,   ", "a,b,c,+", "a,b,123,2000", "a,b, ,2000", "a,b,日本,2000", "a,b,½,2000",
    "a,b,c\x01,2000", "a,b,c\x7f,2000", "a,b,c�,2000", "a,b\x01,c,2000", "\\a,b\\,c,2000", "é,ü,ñ,2000", "a,b,c," + "9" * 40, "a,b,c,0" + "0" * 40 + "2000", "x" * 100000 + ",b,c,2000", '"' + '""' * 5000 + '",b,c,1950', '"', '""', '"""', '""""', ",", "   ", "'a','b','c','2000'",
]


def test_cases():
    check(CASES)
    for line in CASES:
        check([line])


def test_every_short_line():
    import itertools

    check(["".join(c) for n in range(1, 7) for c in itertools.product('",a ', repeat=n)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='",a b1é2\\\n�日', min_size=1, max_size=25), min_size=1, max_size=20))
def test_random_lines(lines):
    check(lines)


def test_slices_of_a_batch():
    whole = pa.array(["q,\"q", *CASES, '"'], pa.string())
    reason, values = parse_batch(whole.slice(1, len(CASES)), FIELDS)
    alone, same = parse_batch(pa.array(CASES, pa.string()), FIELDS)
    assert reason.equals(alone) and all(a.equals(b) for a, b in zip(values, same, strict=True))


def test_table_of_lines(spark):
    rows = [(1, "f", 1, "﻿brand,category,manufacturer,launch_year"), (2, "f", 2, ""), (3, "f", 3, None), (4, "f", 4, "a,b,c,2000"), (4, "f", 4, "a,b,c,2000"), (5, "f", None, "a,b"), (None, "g", 2, 'x"')]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no long, raw string").withColumns({"brand": F.lit(1), "reason": F.lit("x")})
    got = sorted(map(tuple, parse_lines(df, FIELDS).collect()), key=str)
    assert got == sorted([(4, None, "a", "b", "c", 2000)] * 2 + [(5, "columns", None, None, None, None), (None, "quoting", None, None, None, None)], key=str)
    assert parse_lines(df, FIELDS, keep=("file_name", "line_no")).columns[:3] == ["file_name", "line_no", "reason"]
    assert parse_lines(df, FIELDS, line_no=None).count() == 5
    assert parse_lines(df.where("1 = 0"), FIELDS).count() == 0
    for keep in (("brand",), ("nothing",)):
        with pytest.raises(ValueError):
            parse_lines(df, FIELDS, keep=keep)


def test_lines_of_many_lengths():
    r = random.Random(1)
    check(["".join(r.choice('aé",, 12') for _ in range(r.choice([1, 5, 30, 300]))) for _ in range(2000)])


def test_integers_of_64_bits():
    fields = (Field("n", "int"), Field("m", "int", -(10**18), 2**63 - 1))
    ok = [2**63 - 1, -(2**63), 10**18, -(10**18), 999_999_999_999_999_999, -123456789012345678, 0]
    bad = [str(2**63), str(-(2**63) - 1), "9" * 19, "-" + "9" * 19, "1" + "0" * 19, "-1" + "0" * 19, "9" * 50, "-", "1 2"]
    texts = [t for v in ok for t in (str(v), f" {v} ", f"{'-' * (v < 0)}000{abs(v)}", *([f"+{v}"] if v >= 0 else []))]
    reason, (n, _) = parse_batch(pa.array([f"{t}," for t in texts + bad]), fields)
    assert n.to_pylist() == [int(t) for t in texts] + [None] * len(bad)
    assert reason.to_pylist() == [None] * len(texts) + ["value"] * len(bad)
    assert parse_batch(pa.array([f",{-(10**18) - 1}", f",{2**63 - 1}"]), fields)[0].to_pylist() == ["value", None]
