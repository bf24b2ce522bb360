"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds are a table of patterns. For every kind the matches of a text are found from left to right
without overlap; a match that fails the kind's validator is dropped and not tried again at another
place. Offsets are code points, the end exclusive; they follow from the lengths of the pieces between
the matches, so that no Python is needed.

Defined results: a null text is an empty one and has no spans; a row's other columns are kept and never
read, except that columns named ``spans`` or ``redacted`` are replaced; repeated rows are judged one by
one; an empty table gives an empty result; a span may lie inside a span of another kind (both are listed,
and redaction hides the union).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.text import let, whole

CONTEXT_CHARS = 48
BLOCK = 128
SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass the Luhn check (every second digit from the right is doubled)."""

    def total(digit: Column) -> Column:
        doubled = F.transform(
            digit, lambda d, i: F.when((F.size(digit) - i) % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))
        )
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0

    return let(F.transform(F.split(digits_of(match), ""), lambda c: F.ascii(c) - F.ascii(F.lit("0"))), total)


def mod_97(match: Column) -> Column:
    """Whether an account number passes the mod-97 check: country and check digits moved to the end, letters as 10..35."""
    compact = F.regexp_replace(match, "[ -]", "")

    def rest(c: Column) -> Column:
        moved = F.split(F.concat(F.substr(c, F.lit(5)), F.substring(c, 1, 4)), "")
        value = F.transform(moved, lambda x: F.when(x <= "9", F.ascii(x) - 48).otherwise(F.ascii(x) - 55))
        return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v) % 97) == 1

    return let(compact, rest)


def ip_parts(match: Column) -> Column:
    """Whether every part is at most 255, leading zeros allowed."""
    return F.forall(
        F.split(match, r"\."),
        lambda p: let(F.ltrim(p, F.lit("0")), lambda v: (F.char_length(v) < 3) | ((F.char_length(v) == 3) & (v <= "255"))),
    )


def phone_digits(match: Column) -> Column:
    return F.char_length(digits_of(match)).between(8, 15)


def mixed_characters(match: Column) -> Column:
    """Whether a value looks made by a machine: a digit, a letter, and at least eight different characters."""
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 8)


def always(match: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``needs`` is text without which there is no match (a cheap test before the pattern). ``score`` is the
    score without context; a word of ``near`` within CONTEXT_CHARS of the match adds 0.2, one of ``against``
    takes 0.3. ``least`` is the score below which a span is left out; 0 keeps all.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column] = always
    needs: str = ""
    score: float = 0.7
    near: tuple[str, ...] = field(default=())
    against: tuple[str, ...] = field(default=())
    least: float = 0.0


# Base kinds, fixed by the contract. The patterns match what the contract's match, written so that a long
# run of letters or digits costs linear time: a match can only start where a run of its first class starts
# or where the match before ended (\G). For cards, ([ -]?[0-9])+ always takes the whole run, so the test of
# 16 to 19 digits is part of the pattern and other numbers never become matches.
EMAIL_HEAD = r"[A-Za-z0-9._%+-]"
BASE_KINDS = (
    Kind(
        "email", rf"(?:(?<!{EMAIL_HEAD})|\G){EMAIL_HEAD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        needs="@", score=0.9, near=("mail", "contact", "write"), against=("example.invalid",),
    ),
    Kind(
        "ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ip_parts,
        needs=".", score=0.7, near=("ip", "server", "host", "address"), against=("version", "release"),
    ),
    Kind(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", luhn,
        score=0.8, near=("card", "visa", "credit", "payment"), against=("isbn", "serial"),
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits,
        needs="+", score=0.7, near=("phone", "tel", "call", "mobile", "fax"), against=("score",),
    ),
)
#: What the method adds to the base kinds: account numbers with mod-97, national numbers only beside a word that says so, and secrets.
ADDED_KINDS = (
    Kind(
        "iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod_97,
        score=0.9, near=("iban", "account", "bank"),
    ),
    Kind(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        needs="-", score=0.4, near=("ssn", "social", "security"), against=("part", "order"), least=0.5,
    ),
    # secrets: values of 20 characters or more that are assigned to a name which says so, keys known by their form, key blocks
    Kind(
        "secret", r"(?<=[=:]\x20{0,2}[\x22']?|Bearer\x20)[A-Za-z0-9_+-]{20,}+={0,2}", mixed_characters, score=0.4,
        near=(
            "token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "client_secret",
            "access_token", "auth_token", "secret_key", "authorization", "bearer", "credential", "credentials",
        ),
        against=("checksum", "sha256", "sha1", "md5", "fingerprint", "digest", "commit"), least=0.5,
    ),
    Kind(
        "key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9_-])",
        score=0.9,
    ),
    Kind(
        "pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", needs="PRIVATE KEY-----", score=0.9,
    ),
)
KINDS = BASE_KINDS + ADDED_KINDS


def _offsets(gaps: Column, matches: Column) -> Column:
    """Start of each match: the lengths of all gaps up to it and of all matches before it.

    Running sums by blocks, so that thousands of matches in one text stay cheap.
    """
    steps = F.transform(
        matches, lambda m, i: F.char_length(F.get(gaps, i)) + F.when(i > 0, F.char_length(F.get(matches, i - 1))).otherwise(F.lit(0))
    )

    def add(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, n: a + n)

    def running(step: Column) -> Column:
        n_blocks = F.ceil(F.size(step) / BLOCK).cast("int")
        totals = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: add(F.slice(step, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(totals, lambda t: F.transform(t, lambda _, b: F.when(b > 0, add(F.slice(t, F.lit(1), b))).otherwise(F.lit(0))))
        return let(
            before,
            lambda base: F.transform(
                step,
                lambda _, i: F.get(base, (i / BLOCK).cast("int")) + add(F.slice(step, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
            ),
        )

    return let(steps, running)


def _score(kind: Kind, body: Column, start: Column, end: Column) -> Column:
    """The kind's score, adjusted by the lower-case words just before and after the match."""
    score = F.lit(kind.score)
    if not kind.near and not kind.against:
        return score
    around = F.lower(
        F.concat(
            F.substring(body, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))),
            F.lit(" "),
            F.substring(body, end + 1, F.lit(CONTEXT_CHARS)),
        )
    )

    def adjusted(text: Column) -> Column:
        value = score
        for found, change in ((kind.near, 0.2), (kind.against, -0.3)):
            if found:
                value = value + F.when(text.rlike(r"\b(?:" + "|".join(w.replace(".", r"\.") for w in found) + r")\b"), F.lit(change)).otherwise(F.lit(0.0))
        return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 3)

    return let(around, adjusted)


def spans_of(kind: Kind, body: Column) -> Column:
    """The confirmed spans of one kind in a text that is not null."""
    none = F.array().cast(SPAN)

    def confirmed(matches: Column) -> Column:
        def placed(start: Column) -> Column:
            found = F.filter(
                F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(start, i).alias("s"))), lambda x: kind.valid(x["m"])
            )
            spans = F.transform(
                found,
                lambda x: F.struct(
                    F.lit(kind.name).alias("kind"),
                    x["s"].alias("start"),
                    (x["s"] + F.char_length(x["m"])).alias("end"),
                    x["m"].alias("text"),
                    _score(kind, body, x["s"], x["s"] + F.char_length(x["m"])).cast("double").alias("score"),
                ),
            )
            return F.filter(spans, lambda x: x["score"] >= kind.least) if kind.least else spans

        valid_any = F.exists(matches, lambda m: kind.valid(m))
        return F.when(
            valid_any, let(_offsets(F.split(body, kind.pattern, -1), matches), placed)
        ).otherwise(none)

    wanted = F.contains(body, F.lit(kind.needs)) if kind.needs else F.lit(True)
    matches = F.when(wanted & body.rlike(kind.pattern), F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0)))
    return F.coalesce(let(matches, lambda m: F.when(m.isNotNull(), confirmed(m))), none)


def spans(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``spans``: all spans by kind in the order of ``kinds``, then by start."""
    found = let(whole(F.col(f"`{text}`")), lambda body: F.concat(*[spans_of(k, body) for k in kinds]))
    return docs.withColumn("spans", found)


def listed(found: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each maximal run covered by spans replaced by the names of its kinds, e.g. ``[EMAIL]``.

    A null text stays null.
    """
    flat = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.upper(s["kind"]).alias("k"))))
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"), F.lit("").alias("kinds")
    )

    def put(state: Column, span: Column) -> Column:
        # spans come by start; one that begins before the end of the run is part of the run
        return F.when(
            (state["kinds"] != "") & (span["s"] < state["at"]),
            F.struct(
                F.concat(F.slice(state["parts"], 1, F.size(state["parts"]) - 1), F.array(F.concat(F.lit("["), state["kinds"], F.lit("+"), span["k"], F.lit("]")))).alias("parts"),
                F.greatest(state["at"], span["e"]).alias("at"),
                F.concat(state["kinds"], F.lit("+"), span["k"]).alias("kinds"),
            ),
        ).otherwise(
            F.struct(
                F.concat(
                    state["parts"],
                    F.array(F.substring(text, state["at"] + 1, span["s"] - state["at"]), F.concat(F.lit("["), span["k"], F.lit("]"))),
                ).alias("parts"),
                span["e"].alias("at"),
                span["k"].alias("kinds"),
            )
        )

    def joined(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substr(text, state["at"] + 1))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(flat, start, put, joined))


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``spans`` and ``redacted``."""
    found = spans(docs, text, kinds)
    return found.withColumn("redacted", redacted(F.col(f"`{text}`").cast("string"), F.col("spans")))
