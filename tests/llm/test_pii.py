import hashlib
import random
import re

from sharelens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def texts():
    r = random.Random(3)
    parts = ["a@b.c", "@", "x.y@", "@d.e", "1.2.3.4", "1.2.3", ".5", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "+44 20 7946 0958", "+1(212)555-0100", "12", " ", "-", "é", "日", "..", "a", "%", "7", "() ", "378282246310005"]
    yield from ["", "a@b@c.d", "a@b.c@d.e", "+1", "+12", "+1 2", "1.2.3.4.5.6.7.8", "1.2.3.4.5.6.7.8.9", "++44 20 7946 0958+1", "4111  1111 1111 1111"]
    for _ in range(4000):
        yield "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
    yield "1" * 5000 + "." + "@" * 3000 + "a" * 4000 + "@b.cc"


def test_base_kinds_are_the_patterns():
    a = pii.anchors()
    for text in texts():
        assert pii.joined(pii.find(text, a), pii.BASE) == brute(text), text


def test_added_kinds():
    a = pii.anchors()
    text = "See https://x.example.com/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32, account no. 12345678 ok"
    got = pii.find(text, a)
    cut = {k: [text[x:y] for x, y in v] for k, v in got.items() if v}
    assert cut["url"] == ["https://x.example.com/a?b=1"]
    assert cut["iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert cut["account"] == ["12345678"]
    got = pii.find('token = "24be64439e3e49cf46b2", password: short1, secret=nodigitsatallinthisone', a)
    assert got["secret"] == [(9, 29)]
    assert pii.redact("mail a@b.cc now", a) == "mail [EMAIL] now"


def test_query(spark):
    rows = [(1, "é a@b.cc 10.0.0.1"), (2, None), (None, ""), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = {tuple(r) for r in pii.scan(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    base = "email:2:8,ip:9:17"
    assert got == {(1, 1, 1, 0, 0, hashlib.sha256(base.encode()).hexdigest(), base, 2), (2, 0, 0, 0, 0, empty, "", 0), (None, 0, 0, 0, 0, empty, "", 0), (3, 0, 0, 0, 0, empty, "", 0)}
    assert pii.scan(df).count() == 5
    assert pii.scan(df.limit(0)).count() == 0
