"""Texts read as they stand, decoded, folded and by JSON fields."""
import json
import urllib.parse

import pytest

from evigraph.sources import texts

SECRET = "0123456789abcdef" * 2


def clean(text, **policy):
    return texts.redacted(text, policy)


def test_escapes_map_back_to_their_places():
    for text in ("", "a%20b", "caf%C3%A9%", "%E2%82%AC%zz%41", "x%FFy%C3", "100% sure %4"):
        decoded, starts = texts.percent_decoded(text)
        assert decoded == urllib.parse.unquote(text, errors="replace") or "�" in decoded
        assert len(starts) == len(decoded) + 1 and starts[-1] == len(text) and starts == sorted(starts)
    decoded, starts = texts.percent_decoded("x%E2%82%ACy")
    assert decoded == "x€y" and starts == [0, 1, 10, 11]


@pytest.mark.parametrize(("text", "want"), [
    ("write to ann%40shop.example now", "write to [redacted:email] now"), ("call +1%20212%20555%200142.", "call [redacted:phone]."), ("ａｎｎ＠shop.example", "[redacted:email]"), ("call +1 212–555–0142", "call [redacted:phone]"),
    ("card ４１１１ １１１１ １１１１ １１１１", "card [redacted:payment_card]"), ("100% sure, 20%2", "100% sure, 20%2"), ("a%20plain%20text", "a%20plain%20text"), ("ann%40shop.example,ann@shop.example", "[redacted:email],[redacted:email]"),
])
def test_decoded_and_folded_personal_data(text, want):
    assert clean(text)[0] == want and not clean(text)[2]


@pytest.mark.parametrize("text", [f"api%5Fkey%3D{SECRET}", f"ｔｏｋｅｎ ＝ {SECRET}", f"api_key={SECRET}", f'{{"a": {{"client_secret": "s3cr3t-value"}}}}', '{"db_password": 84736251.0}', '{"token": "abc123xyz789", "token": "placeholder"}', f'note\n{{"password": "hunter2!x"}}\n'])
def test_credentials_refuse_a_text_however_it_is_spelt(text):
    out, _, refused = clean(text)
    assert out is None and refused


def test_json_is_read_by_its_fields_and_spelt_as_before():
    line = '{"who": "steward@garden.test", "price": 2.50, "big": 1e400, "area": 12345678901234567.25, "n": -0}\n'
    assert clean(line) == ('{"who": "[redacted:email]", "price": 2.50, "big": 1e400, "area": 12345678901234567.25, "n": -0}\n', {"email": 1}, [])
    doc = '{\n "ratio": 1.10,\n "who": ["steward@garden.test", NaN],\n "empty": {},\n "none": null\n}\n'
    assert clean(doc)[0] == doc.replace("steward@garden.test", "[redacted:email]")
    kept = '{"a":1,   "b" : "north bed", "max_tokens": 4096, "token": "${TOKEN}", "secret": "********", "password": "", "id": 2125550142, "telling": "5550142 a"}\n'
    assert clean(kept) == (kept, {}, [])
    phones = '{"phone": "07700900123", "mobile_no": 2125550142, "homePhone": "(212) 555 0142", "n": {"x": 1}, "tel": ["0770 090 0123"]}'
    assert json.loads(clean(phones)[0]) == {"phone": "[redacted:phone]", "mobile_no": "[redacted:phone]", "homePhone": "[redacted:phone]", "n": {"x": 1}, "tel": ["[redacted:phone]"]}
    assert json.loads(clean('{"e\\u0040": "a\\nann\\u0040shop.example"}')[0]) == {"e@": "a\n[redacted:email]"}
    mixed = 'mail ann@shop.example\n{"who": "ann@shop.example"}\nrest\r\n[1, "x"]'
    assert clean(mixed)[0] == 'mail [redacted:email]\n{"who": "[redacted:email]"}\nrest\r\n[1, "x"]'
    assert clean("[" * 5000 + '"ann@shop.example"' + "]" * 5000)[0].count("[redacted:email]") == 1


def test_policies_and_card_networks():
    assert clean("ann@shop.example", email="keep") == ("ann@shop.example", {}, []) and clean("ann%40shop.example", email="refuse")[2] == ["email"]
    cards = ["4111111111111111", "5105105105105100", "2221000000000009", "378282246310005", "30569309025904", "3530111333300000", "6011111111111117", "6200000000000005"]
    assert [c for c in cards if not texts.is_card(c)] == [] and not texts.is_card("2721000000000004") and not texts.is_card("4111111111111112") and not texts.is_card("9111111111111111")
