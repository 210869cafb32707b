import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import canonical, text, times, values
from tenderloom.operators.scoring import found_phrases, keyword_terms


@pytest.fixture
def found(spark):
    def check(keyword, body):
        texts = spark.createDataFrame([("n", body)], "control_number string, b string")
        texts = texts.select("control_number", text.fold(F.col("b")).alias("folded_object"))
        profiles = spark.createDataFrame([([keyword],)], "keywords array<string>")
        rows = found_phrases(texts, keyword_terms(profiles)).collect()
        assert not rows or len(rows[0].phrases) == 1
        return bool(rows)

    return check


@pytest.mark.parametrize(
    "keyword, body, expected",
    [
        ("computador", "Aquisição de COMPUTADORES", True),
        ("brinquedos", "um brinquedo", True),
        ("AQUISICAO", "aquisição de cabos", True),
        ("aquisição", "AQUISICAO", True),
        ("TI", "partida", False),
        ("TI", "serviços de TI.", True),
        ("cabo", "cabocla", False),
        ("material", "materiais", False),
        ("gas", "ga", False),
        ("mes", "me", False),
        ("material de limpeza", "Materials  de\n limpezas", True),
        ("material de limpeza", "material, de limpeza", False),
        ("c++", "linguagem c++s", True),
        ("c++", "linguagem c+", False),
        ("+10", "x+10", True),
        ("+10", "x +10", False),
        ("日本", "x日本y", True),
        ("日本", "日本", False),
        (r"a\Eb", r"um a\Eb aqui", True),
        ("a.b", "axb", False),
        ("́", "qualquer", False),
        ("cabo", "cabo_x", False),
        ("cabo", "caboª", True),
    ],
)
def test_keyword_occurs_as_whole_word(found, keyword, body, expected):
    assert found(keyword, body) is expected


def test_fold(column):
    rows = [("ÁÉÎõÇ ñ Ώ º ß",), ("PLAIN",), ("áb",)]
    assert column(text.fold(F.col("t")), rows, "t string") == ["aeioc n ω º ß", "plain", "ab"]


def test_quoted_payload(column):
    rows = [("  ok ",), ("",), (None,), ("x" * 501,)]
    quoted = column(text.quoted_payload(F.col("t"), 500, "<empty body>"), rows, "t string")
    assert quoted == ["ok", "<empty body>", "<empty body>", "x" * 500 + "... <truncated, 501 chars>"]


def test_local_instant(column):
    cases = {
        "2026-09-01T14:20:41": dt.datetime(2026, 9, 1, 17, 20, 41),
        " 2026-09-01T14:20 ": dt.datetime(2026, 9, 1, 17, 20),
        "2018-11-20T10:00:00.5": dt.datetime(2018, 11, 20, 12, 0, 0, 500000),
        "2018-11-04T00:30:00": dt.datetime(2018, 11, 4, 3, 30),
        "2026-09-01T14:20:41Z": None,
        "2026-09-01T14:20:41-03:00": None,
        "2026-02-30T10:00:00": None,
        "2026-09-01T24:00:00": None,
        "2026-09-01": None,
    }
    got = column(times.local_instant(F.col("t")), [(k,) for k in cases], "t string")
    assert got == list(cases.values())


def test_canonical_instants(column):
    cases = {
        "2026-09-01T17:22:01Z": True,
        "2026-09-01T17:22:01.500Z": True,
        "2026-09-01T17:22:01.123456Z": True,
        "2026-09-01T17:22:01.5Z": False,
        "2026-09-01T17:22:01.000Z": False,
        "2026-09-01T17:22:01.500000Z": False,
        "2026-09-01T17:22:01": False,
        "2026-09-01T14:22:01-03:00": False,
        "1756747321": False,
        "2026-02-30T17:22:01Z": False,
    }
    got = column(times.is_canonical_instant(F.col("t")), [(k,) for k in cases], "t string")
    assert got == list(cases.values())
    spelled = [k for k, ok in cases.items() if ok]
    back = column(times.instant_text(F.col("t").cast("timestamp")), [(k,) for k in spelled], "t string")
    assert back == spelled


def test_dates(column):
    rows = [(dt.datetime(2026, 9, 24, 1, 0),)]
    assert column(times.local_date(F.col("t")), rows, "t timestamp") == [dt.date(2026, 9, 23)]
    window = column(times.window_dates(F.col("d"), 3), [(dt.date(2026, 9, 24),)], "d date")[0]
    assert window == [dt.date(2026, 9, d) for d in (21, 22, 23, 24)]
    with pytest.raises(ValueError):
        times.window_dates(F.lit("2026-09-24"), 0)


def test_match_id_is_a_name_based_uuid(column):
    pairs = [(f"{i}/2026", str(uuid.UUID(int=i))) for i in range(40)]
    expected = [
        str(uuid.UUID(bytes=hashlib.md5(f"{c}|{p}".encode()).digest(), version=3)) for c, p in pairs
    ]
    assert column(values.match_id(F.col("c"), F.col("p")), pairs, "c string, p string") == expected


def test_numbers_and_codes(column):
    rows = [("10000.00",), ("10.5",), ("0.00",), ("100",)]
    plain = column(values.plain_number(F.col("v").cast("decimal(38,10)")), rows, "v string")
    assert plain == ["10000", "10.5", "0", "100"]
    segments = column(
        values.segment_of(F.col("c")), [("6201-5/01",), ("99.01",), ("4",)], "c string"
    )
    assert segments == ["IT_SERVICES", "OTHER", "OTHER"]
    assert column(values.round_half_up(F.col("x")), [(0.5,), (1.49,), (2.5,)], "x double") == [1, 1, 3]


def test_change_token(column):
    same = [
        ('{"a":1,"b":{"y":2,"x":[1,null]}}', ' { "b": {"x":[1.0,null],"y":2}, "a":1e0 }'),
        ('{"v":10000}', '{"v":10000.00}'),
        ('{"v":10000}', '{"v":1e4}'),
        ('{"v":0}', '{"v":0.00}'),
        ('{"a":null,"b":1}', '{"b":1}'),
        ('{"a":1,"a":2}', '{"a":2}'),
        ('{"v":12345678901234567890123456789012345678901234567890.10}',
         '{"v":12345678901234567890123456789012345678901234567890.1}'),
    ]
    different = [
        ("[1,2]", "[2,1]"),
        ("[1,null]", "[1]"),
        ('{"a":"null"}', '{"a":null}'),
        ('{"v":10000}', '{"v":10000.01}'),
        ('{"v":"1"}', '{"v":1}'),
    ]
    rows = same + different + [("", "nope"), ("NaN", "{")]
    left = column(canonical.change_token(F.col("a")), rows, "a string, b string")
    right = column(canonical.change_token(F.col("b")), rows, "a string, b string")
    for n in range(len(same)):
        assert left[n] == right[n] and len(left[n]) == 64
    for n in range(len(same), len(same) + len(different)):
        assert left[n] != right[n]
    assert left[-2:] == right[-2:] == [None, None]
    text_form = '{"a":"x\\"y\\\\","n":100}'
    assert column(canonical.change_token(F.col("a")), [(text_form,)], "a string") == [
        hashlib.sha256(text_form.encode()).hexdigest()
    ]
