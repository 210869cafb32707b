"""The change token: plain numbers are in their form as text, with the same result as decimals."""

from decimal import Decimal

import pytest

from tenderloom.functions import canonical

PLAIN = ["0", "-0", "0.0", "-0.0", "-0.50", "10", "100", "10.0", "100.00", "1234567890123456789012.12345678900", "0." + "0" * 19_990 + "1"]
OTHER = ["1e3", "1E-3", "-1.50e2", "0e5", "-0e0", "1" * 20_001, "0." + "0" * 20_005]


@pytest.mark.parametrize("text", PLAIN + OTHER)
def test_numbers_have_one_form(text):
    node = canonical._DECODER.decode(text)
    assert isinstance(node, Decimal) == (text in OTHER)
    assert canonical._render(node) == canonical._number(Decimal(text))


def test_numbers_too_long_have_no_token():
    for text in ("1e99999", "1" * 20_002, "0." + "0" * 20_005 + "1"):
        assert canonical._token(f'{{"a": {text}}}') is None
        assert canonical._token(f'{{"a": {text}, "a": 1}}') == canonical._token('{"a": 1.0}')


def test_names_stand_in_utf_16_order():
    assert canonical._render({"￮": "x", "\U0001f600": None, "b": 'q"\\', "\U0001f601": True}) == '{"b":"q\\"\\\\","\U0001f601":true,"￮":"x"}'
