"""Personal data: patterns propose spans, checksums confirm them, context scores them.

All of it is DataFrame expressions.  The patterns are written so that Java's matcher neither
backtracks nor recurses over long runs: possessive repeats where nothing that follows could
need a character back, and starts only where a run begins or the last match ended (``\\G``).
They match what the plain patterns beside them match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import id_text

#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Score from which a span of a kind that isn't a base kind is reported.
LEAST_SCORE = 0.6
#: What a context word nearby adds, and what a contrary one takes off.
BOOST, PENALTY = 0.35, 0.3
CONTRARY = r"\b(version|build|example|sample|test|isbn|order|invoice|page|section)\b"

#: Characters of an IBAN after its first four, by country.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK|FI|FK|FO|GL|NL|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|MN|XK",
    17: "CH|HR|LI|LV", 18: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|OM|SO|TL",
    20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "LY|PT|ST", 22: "IS|TR",
    23: "BI|DJ|FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}

_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*map(F.lit, _DOUBLED))

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.get(doubled, digit)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes the mod-97 check."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        letter = code >= 65
        return (rest * F.when(letter, 100).otherwise(10) + code - F.when(letter, 55).otherwise(48)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _four_bytes(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda x: F.ltrim(x, F.lit("0")))
    small = lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, F.concat(F.lit("0"), x)).cast("int") <= 255)
    return F.forall(parts, small)


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _iban(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)


def _iban_pattern() -> str:
    """A place where an IBAN may start; what it would be is the group.

    Its length is its country's, so that it can't run into the next word; other countries
    take the longest run.  Proposals may overlap: a wrong one hides none that follows.
    """
    sizes = [*((own, n) for n, own in IBAN_REST.items())]
    known = "|".join(own for own, _ in sizes)
    all_ = [(own, f"{{{n}}}") for own, n in sizes] + [(f"(?!{known})[A-Z]{{2}}", "{11,30}")]
    each = "|".join(rf"(?:{own})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){n}" for own, n in all_)
    return rf"(?<![A-Za-z0-9])(?=((?:{each})(?![A-Za-z0-9])))"


def _always(match: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``needs`` are patterns without which no text can hold it.

    With ``ahead`` the pattern matches only places, and its group is what starts there.
    """

    name: str
    pattern: str
    needs: tuple[str, ...]
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = field(default=True)
    ahead: bool = field(default=False)


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        ("@",),
        _always,
        0.9,
        r"\b(e-?mail|mail|contact|write|address)\b",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        (r"[0-9]\.[0-9]",),
        _four_bytes,
        0.6,
        r"\b(ip|host|server|addr|address|ping)\b",
    ),
    # [0-9]([\x20-]?[0-9])+
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        ("[0-9][0-9 -]",),
        _card,
        0.7,
        r"\b(card|credit|debit|visa|mastercard|payment|pay)\b",
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        (r"\+[0-9]",),
        lambda m: F.length(_digits(m)).between(10, 15),
        0.6,
        r"\b(phone|tel|telephone|call|mobile|cell|fax)\b",
    ),
    Kind(
        "iban",
        _iban_pattern(),
        ("[A-Z]{2}[0-9]{2}",),
        _iban,
        0.9,
        r"\b(iban|account|bank|konto|transfer)\b",
        base=False,
        ahead=True,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        ("[0-9]-[0-9]",),
        _always,
        0.4,
        r"\b(ssn|social|security|tax)\b",
        base=False,
    ),
)
SPAN = "struct<start: int, order: int, stop: int, score: double>"


def _matches(text: Column, kind: Kind, order: int) -> Column:
    """Spans of one kind.  Places come from the lengths of matches and of what lies between."""
    # With a blank in front, a place is never at the start, where split would leave it out.
    searched = F.concat(F.lit(" "), text) if kind.ahead else text
    between = F.split(searched, kind.pattern, -1)
    found = F.regexp_extract_all(searched, F.lit(kind.pattern), F.lit(int(kind.ahead)))
    both = F.zip_with(
        between, found, lambda gap, match: F.struct(F.char_length(gap).alias("gap"), match.alias("match"))
    )
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            stop.alias("stop"),
            F.lit(kind.score).alias("score"),
        )
        valid = x["match"].isNotNull() & kind.valid(x["match"])
        if kind.ahead:  # a place inside the last span starts no other
            valid = valid & (start >= F.coalesce(F.get(state["spans"], F.size(state["spans"]) - 1)["stop"], F.lit(0)))
        spans = F.when(valid, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start if kind.ahead else stop).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(-1 if kind.ahead else 0).alias("at"), none.alias("spans"))
    spans = F.aggregate(both, start, step, lambda state: state["spans"])
    needed = F.lit(True)
    for pattern in kind.needs:
        needed = needed & text.rlike(pattern)
    return F.when(needed, spans).otherwise(none)


def _scored(text: Column, span: Column) -> Column:
    """The span with its score after a look at the text around it."""
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substr(text, first + 1, span["start"] - first)
    near = F.lower(F.concat(before, F.lit(" "), F.substr(text, span["stop"] + 1, F.lit(CONTEXT))))
    words = F.get(F.array(*[F.lit(k.context) for k in KINDS]), span["order"])
    shift = F.when(F.regexp_like(near, words), BOOST).otherwise(0.0)
    shift = shift - F.when(near.rlike(CONTRARY), PENALTY).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), span["score"] + shift))
    return F.struct(
        span["start"].alias("start"),
        span["order"].alias("order"),
        span["stop"].alias("stop"),
        F.round(score, 4).alias("score"),
    )


def find_personal_data(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id and ``spans`` (start, order, stop, score) of each row of ``docs``.

    Places are code points, ends exclusive; ``order`` is the kind's place in ``KINDS``.  Spans
    of base kinds are reported whatever their score, others from ``least_score``.  Spans are
    sorted by start, then kind; those of different kinds may overlap.  A null text is empty;
    rows are independent, so repeated rows and ids do no harm; other columns are ignored; an
    empty table gives no rows.
    """
    texts = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    spans = F.concat(*[_matches(text, kind, order) for order, kind in enumerate(KINDS)])
    base = F.array(*[F.lit(o) for o, kind in enumerate(KINDS) if kind.base])
    scored = F.transform("spans", lambda s: _scored(text, s))
    kept = F.filter(scored, lambda s: F.array_contains(base, s["order"]) | (s["score"] >= least_score))
    return texts.withColumn("spans", spans).select("doc_id", F.array_sort(kept).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["stop"])),
        ",",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: personal data in the documents table."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda o: F.size(F.filter("spans", lambda s: s["order"] == o)).cast("long")
    base = [o for o, kind in enumerate(KINDS) if kind.base]
    return found.select(
        "doc_id",
        *[count(o).alias(f"n_{KINDS[o].name}") for o in base],
        F.sha2(_joined(F.filter("spans", lambda s: s["order"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
