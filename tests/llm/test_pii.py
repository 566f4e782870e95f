"""Personal data against plain regular expressions."""

import random
import re

from txnloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS]


def test_equals_plain_patterns_on_random_text():
    draw = random.Random(1)
    parts = ["a", "@", ".", "-", "+", "1", "23", "255", "256", "4111 1111 1111 1111", " ", "b.c", "@x.y", "(", "0", "..", "é", "%"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert base(text) == plain(text), text


def test_cued_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32 now, ssn 123-45-6789, account no. 12345678, ftp://me:pw@host.org/x"
    kinds = {kind: text[start:end] for kind, start, end in pii.spans(text)}
    assert kinds["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert kinds["ssn"] == "123-45-6789"
    assert kinds["account"] == "12345678"
    assert kinds["login"] == "me:pw@host.org"


def test_invalid_ones_are_left():
    assert pii.spans("iban GB82 WEST 1234 5698 7654 33") == []
    assert pii.spans("ssn 000-12-3456 accountant 12345678") == []
    assert pii.spans("see http://host.org/page") == []


def test_long_runs_take_linear_time():
    for part in ("a", "1", "1.", "a@", "+1", "1 "):
        assert base(part * 500) == plain(part * 500)
        base(part * 150_000)


def test_masking():
    assert pii.masked("mail a@b.co or +1 555 123 4567!") == "mail [EMAIL] or [PHONE]!"
    assert pii.masked("ftp://me:pw@host.org") == "ftp://[LOGIN]"
    assert pii.masked(None) is None
    assert pii.masked("nothing") == "nothing"


def test_frames(spark):
    rows = [(1, "x a@b.co", 0), (1, "x a@b.co", 0), (2, None, 0), (3, "", 0), (None, "1.2.3.4", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pii int")
    found = pii.find(frame).collect()
    assert [[s["kind"] for s in r["pii"]] for r in found] == [["email"], ["email"], [], [], ["ip"]]
    assert [r["text"] for r in pii.redact(frame).collect()] == ["x [EMAIL]", "x [EMAIL]", None, "", "[IP]"]
    assert pii.redact(frame).columns == frame.columns
    assert pii.find(frame.limit(0)).count() == 0
