import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from plume.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": None,  # ibans()
    "secret": r"[0-9a-f]{16,}",
}


def luhn(digits):
    values = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def ibans(text):
    """Leftmost first: a country, two digits, then as many as its length says,
    in a row or in groups of four."""
    at, country = 0, {c: n for n, cs in P.IBAN_LENGTHS.items() for c in cs.split()}
    while at < len(text):
        n = country.get(text[at:at + 2])
        if n and re.match("[0-9]{2}", text[at + 2:]) and not (at and re.match("[A-Z0-9]", text[at - 1])):
            compact = text[at:at + n]
            if re.fullmatch("[A-Z0-9]+", compact) and len(compact) == n:
                yield at, at + n
                at += n
                continue
            size = n + (n - 1) // 4
            printed = text[at:at + size]
            groups = printed.split(" ")
            if len(printed) == size and all(re.fullmatch("[A-Z0-9]+", g) for g in groups) and \
                    [len(g) for g in groups] == [4] * (n // 4) + [n % 4] * (n % 4 > 0):
                yield at, at + size
                at += size
                continue
        at += 1


def find(kind, text):
    found = list(ibans(text)) if kind == "iban" else [m.span() for m in re.finditer(PLAIN[kind], text)]
    for i, (begin, end) in enumerate(found):
        value = text[begin:end]
        digits = re.sub("[^0-9]", "", value)
        last, after = found[i - 1][1] if i else 0, found[i + 1][0] if i + 1 < len(found) else len(text)
        near = text[max(last, begin - 24):begin].lower() + "\n" + text[end:min(after, end + 24)].lower()
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
            continue
        if kind == "phone" and not 9 <= len(digits) <= 15:
            continue
        plain = value.replace(" ", "")
        if kind == "iban" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
            continue
        if kind == "secret" and not any(w in near for w in ("password", "token", "secret", "key")):
            continue
        yield begin, end


def brute(rows):
    out = []
    for d, text in rows:
        spans = {k: list(find(k, text or "")) for k in PLAIN}
        said = lambda kinds: ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])
        base = ["email", "ip", "card", "phone"]
        out.append((d, *(len(spans[k]) for k in base), hashlib.sha256(said(base).encode()).hexdigest(), said(PLAIN)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    bits = ["a@b.c", "x.y+z@m-1.example.com", "_", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0255.0.0.1", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "4111111111111112", "+1 (988) 555-2485", "+", "+49", "é", "🙂", " ", "1", "12345678901234",
            "DE89370400440532013000", "GB82WEST12345698765432", "DE89370400440532013001", "password=", 'token = "',
            "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "NO9386011117947", "DE", "AND", " is my password",
            "b7db7aa4a5fcc78305", "deadbeefdeadbeef", "-", "(", ")", "card ", "\n", "A"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14))) if i % 9 else None) for i in range(400)]
    long = ["a" * 2000, "1" * 2000, "1 " * 1000, "+1" + " " * 2000, "a.b@" * 300, "1." * 1000, "x@y.z " * 200, "AB12" * 500, ""]
    return rows + list(enumerate(long, 5000)) + rows[:3] + [(None, "a@b.c")]


def test_every_account_number_and_named_secret_is_found(spark):
    r = random.Random(8)
    rows, want = [], []
    for n, countries in P.IBAN_LENGTHS.items():
        for country in countries.split():
            body = "".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n - 4))
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            compact = f"{country}{check:02d}{body}"
            printed = " ".join(compact[i:i + 4] for i in range(0, n, 4))
            for text, value in ((f"pay to {compact}.", compact), (f"{compact}AND more", compact), (f"to {printed} now", printed),
                                (f"({printed})", printed)):
                rows.append((len(rows), text))
                want.append(f"iban:{text.index(value)}:{text.index(value) + len(value)}")
    for word in ("password", "token", "secret", "key"):
        for text in (f"the {word} is 0123456789abcdef0123", f"0123456789abcdef0123 is my {word}", f"0123456789abcdef0123 ({word.upper()})"):
            rows.append((len(rows), text))
            want.append(f"secret:{text.index('0123')}:{text.index('0123') + 20}")
    rows.append((len(rows), "commit 0123456789abcdef0123 was merged"))
    want.append("")
    found = {x.doc_id: x.spans.split(",") for x in P.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [t for (d, t), w in zip(rows, want) if w not in found[d]] == []


def test_digest_equals_plain_patterns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))
    assert rows_of(P.digest(df)) == brute(rows)
    assert P.digest(df.limit(0)).count() == 0


def test_patterns_are_linear(spark):
    long = ["a" * 300_000, "1" * 200_000, "1 " * 100_000, "+1" + " " * 200_000, "a.b" * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert [r.spans for r in P.digest(df).orderBy("doc_id").collect()] == [""] * 5


def test_mask_replaces_every_span(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    expected = []
    for d, text in rows:
        out, at = [], 0
        for a, b, k in sorted((a, -b, k) for k in PLAIN for a, b in find(k, text or "")):
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, -b)
        expected.append((d, None if text is None else "".join(out) + text[at:], 1))
    assert rows_of(P.mask(df)) == sorted(expected, key=str)
    plan = P.mask(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
