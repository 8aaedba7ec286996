"""Personal data: patterns propose spans, validators confirm them, context words move the score.

Base kinds (email, ip, card, phone) are reported whenever their validator agrees.  Further
proposals - bank account numbers (iban), payment cards inside longer runs of digits, phone
numbers in national form, social security numbers (ssn) - are reported only if
their score, moved by words nearby, reaches ``THRESHOLD``.

Patterns are written so that a text costs time in proportion to its length: a run of
characters is entered at its start only, and quantifiers give nothing back where nothing
could follow.  Places come from the pieces of text between the matches; running totals of
their lengths are taken in blocks of about sqrt(n) matches.  Everything is an expression
over the row, so the operator is one scan without a shuffle.

The context of a span is up to ``NEAR`` characters on either side, not beyond the next match
of the same pattern.

Defined cases: a null or empty text has no spans; texts of any length are read whole; repeated
rows are judged alike; a null doc_id stays null; an empty table gives an empty result; columns
beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table

NEAR = 40
THRESHOLD = 50
WITH_CONTEXT = 30  # points for a word that speaks for the kind
AGAINST = 30  # points off for a word that speaks against personal data
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# fixed values: length of an account number by country (ISO 13616)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# fixed values: words near personal data in English, German, French and Spanish, and words against it
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write to",
    "ip": r"\bip\b|address|adresse|host|server|client|login",
    "card": "card|karte|carte|tarjeta|visa|mastercard|amex|credit|debit|payment|zahlung|paiement|pago",
    "phone": "phone|telefon|tel|call|mobil|fax|anruf|appel|llam|cell",
    "iban": "iban|account|konto|compte|cuenta|bank|banque|banco",
    "ssn": r"\bssn\b|social security|tax id|taxpayer",
}
CONTRARY = r"version|build|release|isbn|issn|order no|serial|checksum|part no|example only|sku"

_EMAIL_CHAR = "A-Za-z0-9._%+-"
# a card number by itself, or in four groups, wherever it lies in the digits
_CARD_INSIDE = r"[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}"
_NATIONAL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"


def _iban_pattern(group: str) -> str:
    return "|".join(
        rf"(?:{'|'.join(names.split())})[0-9]{{2}}{group}[\x20]?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()
    )


def prefix_sums(lengths: Column) -> Column:
    """The sum of the entries before each entry, in about n * sqrt(n) steps of tight loops."""
    n = F.size(lengths)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))),
                         lambda b: add(F.slice(lengths, b * width + 1, width)))
    # the array of block sums is made once and held as the value of an outer, one-entry array
    held = F.transform(F.array(blocks), lambda sums: F.transform(
        F.sequence(F.lit(0), F.size(sums) - 1), lambda b: add(F.slice(sums, F.lit(1), b))))
    return F.flatten(F.transform(held, lambda before: F.transform(
        lengths,
        lambda x, i: F.get(before, F.floor(i / width).cast("int"))
        + add(F.slice(lengths, F.floor(i / width).cast("int") * width + 1, F.pmod(i, width))),
    )))


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn sum."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, F.ascii(d) - 48).otherwise(
            (F.ascii(d) - 48) * 2 - F.when(d >= "5", 9).otherwise(0))),
        F.lit(0), lambda s, x: s + x,
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number without blanks passes the check of ISO 7064."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(
        c < "A", (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _counted(x: Column, low: int, high: int) -> Column:
    return F.length(_digits(x)).between(low, high)


def _same_digit(x: Column) -> Column:
    return _digits(x).rlike(r"^(.)\1*$")


def _proposals() -> dict[str, tuple]:
    """name -> (kind, base, points, pattern, cheap test of the text, validator(value, before, after))."""
    edge = lambda chars: lambda b, a: ~b.rlike(f"[{chars}]$") & ~a.rlike(f"^[{chars}]")
    own_digits, own_word, own_number = edge("0-9"), edge("A-Za-z0-9"), edge("A-Za-z0-9+-")
    return {
        "email": ("email", True, 60, rf"(?:\G|(?<![{_EMAIL_CHAR}]))[{_EMAIL_CHAR}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
                  lambda t: F.contains(t, F.lit("@")), lambda v, b, a: F.lit(True)),
        "ip": ("ip", True, 50, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
               lambda t: F.contains(t, F.lit(".")), lambda v, b, a: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": ("card", True, 60, r"[0-9](?:[\x20-]?[0-9])++", None, lambda v, b, a: _counted(v, 13, 19) & luhn(_digits(v))),
        "phone": ("phone", True, 60, r"\+[0-9][\x20().0-9-]+[0-9]",
                  lambda t: F.contains(t, F.lit("+")), lambda v, b, a: _counted(v, 9, 15)),
        "card_inside": ("card", False, 60, _CARD_INSIDE, None,
                        lambda v, b, a: own_digits(b, a) & _counted(v, 13, 19) & luhn(_digits(v)) & ~_same_digit(v)),
        "national": ("phone", False, 30, _NATIONAL, None, lambda v, b, a: own_number(b, a)),
        "iban": ("iban", False, 70, _iban_pattern("(?:"), None,
                 lambda v, b, a: own_word(b, a) & mod97(F.replace(v, F.lit(" "), F.lit("")))),
        "ssn": ("ssn", False, 30, _SSN, lambda t: F.contains(t, F.lit("-")),
                lambda v, b, a: own_number(b, a) & ~v.rlike("^(?:000|666|9)|-00-|-0000$")),
    }


def personal_data(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, spans and base of every document.

    ``spans`` is an array of structs in the order of ``KINDS``, then of start: kind, start,
    end (code points, end exclusive), score (0 to 100), value and is_base.  ``base`` holds the
    base spans alone.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    text, none = F.col("_text"), F.array().cast("array<string>")
    some = rows.withColumn("_some", F.col("_text").rlike("[0-9]"))
    offered = _proposals()

    def found(pattern, test, kind):
        able = F.lit(True) if kind == "email" else F.col("_some")
        able = able & test(text) if test else able
        return F.when(able, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)

    rows = some.select("doc_id", "_text", *[
        found(pattern, test, kind).alias(f"_m_{name}") for name, (kind, _, _, pattern, test, _) in offered.items()
    ])
    rows = rows.select("*", *[
        F.when(F.size(f"_m_{name}") > 0, F.split(text, pattern)).otherwise(none).alias(f"_g_{name}")
        for name, (_, _, _, pattern, _, _) in offered.items()
    ])

    def steps(name):
        """Before each match lie all earlier ones, each with the text before it."""
        gaps = F.col(f"_g_{name}")
        return F.transform(f"_m_{name}", lambda v, i: (F.length(v) + F.length(F.get(gaps, i))).cast("long")).alias(f"_l_{name}")

    # a step of its own, because expressions inside a lambda are worked out for every entry
    rows = rows.select("*", *[steps(name) for name in offered])
    rows = rows.select("*", *[
        F.when(F.size(f"_m_{name}") > 0, prefix_sums(F.col(f"_l_{name}"))).alias(f"_p_{name}") for name in offered
    ])

    def spans(name):
        kind, base, points, _, _, valid = offered[name]
        gaps, sums = F.col(f"_g_{name}"), F.col(f"_p_{name}")

        def span(v, i):
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
            start = F.get(sums, i) + F.length(before)
            # a match right behind another has the end of that one before it
            touch = F.when((F.length(before) == 0) & (i > 0), F.lit("0")).otherwise(F.right(before, F.lit(1)))
            follow = F.when((F.length(after) == 0) & (i < F.size(gaps) - 2), F.lit("0")).otherwise(F.left(after, F.lit(1)))
            score = (
                F.lit(points) + F.when(near.rlike(WORDS[kind]), WITH_CONTEXT).otherwise(0)
                - F.when(near.rlike(CONTRARY), AGAINST).otherwise(0)
            )
            return F.struct(
                F.lit(KINDS.index(kind)).alias("rank"), start.cast("long").alias("start"),
                (start + F.length(v)).cast("long").alias("end"), F.least(F.greatest(score, F.lit(0)), F.lit(100)).alias("score"),
                v.alias("value"), F.lit(base).alias("is_base"), valid(v, touch, follow).alias("ok"),
            )

        good = F.filter(F.transform(f"_m_{name}", span), lambda s: s["ok"] & (s["is_base"] | (s["score"] >= threshold)))
        return F.when(F.size(f"_m_{name}") > 0, good).otherwise(F.filter(F.transform(none, span), lambda s: F.lit(False)))

    rows = rows.select("doc_id", *[spans(name).alias(f"_s_{name}") for name in offered])
    rows = rows.select(
        "doc_id", "_s_email", "_s_ip", "_s_card", "_s_phone", "_s_iban", "_s_ssn",
        F.sort_array(F.concat("_s_card", "_s_card_inside")).alias("_cards"),
        F.sort_array(F.concat("_s_phone", "_s_national")).alias("_phones"),
    )

    def apart(name):
        """Without proposals that lie in a base span of their kind.

        A base span has at most 19 digits, so it holds at most one proposal, its neighbour in order.
        """
        order = F.col(name)
        hit = lambda s, o: F.coalesce(o["is_base"] & (o["start"] < s["end"]) & (s["start"] < o["end"]), F.lit(False))
        inside = lambda s, i: F.when(i > 0, hit(s, F.get(order, i - 1))).otherwise(False) | hit(s, F.get(order, i + 1))
        return F.filter(order, lambda s, i: s["is_base"] | ~inside(s, i))

    rows = rows.select(
        "doc_id",
        F.concat("_s_email", "_s_ip", "_s_card", "_s_phone").alias("_base"),
        F.concat("_s_email", "_s_ip", apart("_cards"), apart("_phones"), "_s_iban", "_s_ssn").alias("_whole"),
    )
    named = lambda xs: F.transform(xs, lambda s: F.struct(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1).alias("kind"),
        s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"),
        s["value"].alias("value"), s["is_base"].alias("is_base"),
    ))
    return rows.select("doc_id", named(F.col("_base")).alias("base"), named(F.col("_whole")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together.

    The name of a joined stretch is the kind of its first span.
    """
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # the stretch up to each span, cut at the furthest end so far
    state = F.aggregate(
        order,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(
                F.substr(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.concat(F.lit("["), x["kind"], F.lit("]"))
            )).alias("out"))
        ),
    )
    return F.concat(F.array_join(state["out"], ""), F.substr(text, state["at"].cast("int") + 1))


# the same in SQL: matches and the text between them as rows, places by a running total
def _sql_matches(name: str, kind: str, base: bool, points: int, pattern: str) -> str:
    return f"""
SELECT k, '{name}' AS name, '{kind}' AS kind, {KINDS.index(kind)} AS rnk, {base} AS is_base, {points} AS points, i, m[i] AS v, g[i] AS before, g[i + 1] AS after, len(m) AS n,
  sum(len(g[i])) OVER w + coalesce(sum(len(m[i])) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT k, m, g, unnest(range(1, len(m) + 1)) AS i FROM
  (SELECT k, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d))
WINDOW w AS (PARTITION BY k ORDER BY i)"""


_CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "card_inside": _CARD_INSIDE, "national": _NATIONAL, "iban": _iban_pattern("("), "ssn": _SSN,
}
_SQL_ROWS = " UNION ALL ".join(
    _sql_matches(name, kind, base, points, _CONTRACT[name]) for name, (kind, base, points, *_) in _proposals().items()
)
_SQL_WORDS = " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in WORDS.items())
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
c AS ({_SQL_ROWS}),
e AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(v, ' ', '') AS acc,
    CASE WHEN before = '' AND i > 1 THEN '0' ELSE right(before, 1) END AS b, CASE WHEN after = '' AND i < n THEN '0' ELSE left(after, 1) END AS a,
    lower(right(before, {NEAR}) || ' ' || left(after, {NEAR})) AS near FROM c),
f AS (SELECT *, list_sum(list_transform(range(1, len(digits) + 1), lambda p: CASE WHEN (len(digits) - p) % 2 = 0 THEN digits[p]::INT
      ELSE (2 * digits[p]::INT) // 10 + (2 * digits[p]::INT) % 10 END)) % 10 = 0 AS luhn,
    points + CASE WHEN regexp_matches(near, CASE kind {_SQL_WORDS} END) THEN {WITH_CONTEXT} ELSE 0 END
      - CASE WHEN regexp_matches(near, '{CONTRARY}') THEN {AGAINST} ELSE 0 END AS score,
    list_reduce(list_transform(string_split(acc[5:] || acc[1:4], ''), lambda x: ascii(x)), lambda s, x: CASE WHEN x < 65 THEN (s * 10 + x - 48) % 97 ELSE (s * 100 + x - 55) % 97 END, 0) AS rest FROM e),
s AS (SELECT k, name, kind, rnk, is_base, start, start + len(v) AS stop FROM f WHERE (is_base OR score >= {THRESHOLD}) AND CASE name
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: CASE WHEN len(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(try_cast(ltrim(x, '0') AS INT), 0) END)) <= 255
    WHEN 'card' THEN len(digits) BETWEEN 13 AND 19 AND luhn
    WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15
    WHEN 'card_inside' THEN luhn AND len(replace(digits, digits[1], '')) > 0 AND NOT regexp_matches(b || a, '[0-9]')
    WHEN 'national' THEN NOT regexp_matches(b || a, '[A-Za-z0-9+-]')
    WHEN 'iban' THEN rest = 1 AND NOT regexp_matches(b || a, '[A-Za-z0-9]')
    ELSE NOT regexp_matches(b || a, '[A-Za-z0-9+-]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') END),
o AS (SELECT * FROM s WHERE is_base OR NOT EXISTS (SELECT 1 FROM s t WHERE t.k = s.k AND t.kind = s.kind AND t.is_base AND t.start < s.stop AND s.start < t.stop)),
r AS (SELECT k, count(*) FILTER (is_base AND kind = 'email') AS e, count(*) FILTER (is_base AND kind = 'ip') AS i, count(*) FILTER (is_base AND kind = 'card') AS c,
    count(*) FILTER (is_base AND kind = 'phone') AS p, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rnk, start) FILTER (is_base) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rnk, start) AS spans FROM o GROUP BY k)
SELECT doc_id, coalesce(e, 0)::BIGINT AS n_email, coalesce(i, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(p, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (k)
"""


@query("op12_personal_data", OP12_SQL)
def op12_personal_data(spark, sf_dir):
    rows = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
