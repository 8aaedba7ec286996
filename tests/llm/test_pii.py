import random
import re

from fleetlens.llm import pii

SCHEMA = "doc_id long, text string, spans string, base int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute_force(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m.group())
    ]


def with_check_digit(head):
    return next(head + d for d in "0123456789" if luhn(head + d))


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return sorted(pii.personal_data(df).select("*", pii.listed(pii.F.col("base")).alias("b")).collect(), key=lambda r: r.doc_id)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(11)
    parts = [
        "1", "25", "255", "256", "0007", ".", ".", "..", "@", "a@b.c", "x_y@q-1.de", "+", "+1", " ", " ", "-", "(", ")", "é", "🙂", "\n",
        "10.0.0.1", "1.2.3.4.5", with_check_digit("411111111111111"), with_check_digit("37828224631000"), "4111 1111 1111 1111",
        "+49 (0) 171 123-456", "a.b@c.d_e@f.g", "@@", "%", "_",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "+1234567", "+12345678 9", "9" * 40, "1." * 50, "a@b" * 30, "a@b.c" * 30]
    for text, r in zip(texts, found(spark, texts), strict=True):
        assert r.b == ",".join(brute_force(text)), repr(text)
        assert all(text[s.start : s.end] == s.value for s in r.spans)
        assert {(s.kind, s.start) for s in r.base} <= {(s.kind, s.start) for s in r.spans}


def test_very_long_texts(spark):
    card = with_check_digit("411111111111111")
    local, domain = "a.b" * 100_000, "@c" + ".d" * 50_000
    expected = {
        "a" * 300_000: [], "1" * 300_000: [],
        "1." * 40_000: [f"ip:{8 * i}:{8 * i + 7}" for i in range(10_000)],
        local + domain: [f"email:0:{len(local + domain)}"],
        "+1 " * 100_000: [],
        f"é {card}, " * 3000: [f"card:{2 + 20 * i}:{18 + 20 * i}" for i in range(3000)],
    }
    for (text, base), r in zip(expected.items(), found(spark, list(expected)), strict=True):
        assert r.b == ",".join(base), text[:20]


def test_added_spans_need_a_checksum_or_context(spark):
    card = with_check_digit("411111111111111")
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    rows = found(spark, [
        f"paid {card} {card} today", f"paid {wrong} {wrong} today", "DE89 3704 0044 0532 0130 00 AND more", "GB82WEST12345698765432",
        "DE89 3704 0044 0532 0130 01", "xDE89370400440532013000", "call 555-123-4567", "part 555-123-4567", "SSN 123-45-6789",
        "no 123-45-6789", "social security 666-45-6789", "0000 0000 0000 0000 0000", f"serial {card} {card}", "phone +1 555-123-4567",
    ])
    kinds = [[(s.kind, s.value) for s in r.spans] for r in rows]
    assert kinds[0] == [("card", card)] * 2 and rows[0].base == []
    assert kinds[1] == [] and kinds[2] == [("iban", "DE89 3704 0044 0532 0130 00")] and kinds[3][0][0] == "iban"
    assert kinds[4] == kinds[5] == []
    assert kinds[6] == [("phone", "555-123-4567")] and kinds[7] == []
    assert kinds[8] == [("ssn", "123-45-6789")] and kinds[9] == kinds[10] == kinds[11] == []
    assert kinds[12] == [("card", card)]  # a contrary word lowers the score of the number right beside it
    assert kinds[13] == [("phone", "+1 555-123-4567")]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co, ip 10.0.0.1!", "x", 1), (2, None, "x", 1), (3, "+49 171.10.0.0.1", "x", 1)], SCHEMA)
    spans = pii.personal_data(df)
    out = df.select("doc_id", "text").join(spans, "doc_id").select("doc_id", pii.redacted(pii.F.coalesce("text", pii.F.lit("")), pii.F.col("spans")))
    assert {r[0]: r[1] for r in out.collect()} == {1: "mail [email], ip [ip]!", 2: "", 3: "[phone]"}


def test_empty_table_and_repeated_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "a@b.c", "x", 1)] * 3, SCHEMA)
    assert [len(r.spans) for r in pii.personal_data(rows).collect()] == [1, 1, 1]
