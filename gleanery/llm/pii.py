"""Personal data by regular expressions, checksums and context words, in Spark SQL alone.

A regular expression proposes spans, a validator (Luhn, mod-97, number ranges) confirms
them, and words close by raise a span's score. Patterns use possessive loops and start
where a run starts (or the last match ended), so their time is linear in the text and
they need no deep stack; what they match is the same as without.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "secret"]
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.3
KEEP_FROM = 0.5  # added spans need this score; base spans always stay

_LOCAL = r"A-Za-z0-9._%+-"
_LABEL = r"A-Za-z0-9-"


def _from(run: str) -> str:
    """Where a run of these characters starts, or the last match ended within one."""
    return rf"(?:\G|(?<![{run}]))"


PATTERNS = {
    "email": rf"{_from(_LOCAL)}[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": rf"{_from('0-9')}[0-9]++(?:\.[0-9]++){{3}}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}"
            r"|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"[A-Za-z0-9_-]{20,}+",
}
# Score of a confirmed span, and the words that raise it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "secret": 0.3}
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|write|courriel|correo",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "iban": "iban|account|bank|bic|swift|konto|compte|cuenta",
    "secret": "token|secret|key|password|passwd|credential|bearer|auth",
}
_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"
_WALK = f"struct<at:bigint,out:array<{_SPAN}>>"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 when divided by 97."""
    moved = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c <= "9", (a * 10 + c.cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def _iban(match: Column) -> Column:
    """The account number in a match: all of it, or all but a last short group; else null."""
    shorter = F.regexp_replace(match, r"\x20[A-Z0-9]{1,3}$", "")

    def valid(x: Column) -> Column:
        return _mod97(F.replace(x, F.lit(" "), F.lit("")))

    return F.when(valid(match), match).when(valid(shorter), shorter)


def _confirmed(kind: str, match: Column) -> Column:
    """The confirmed part of a match, or null."""
    if kind == "ip":
        return F.when(match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), match)
    if kind == "card":
        digits = F.regexp_replace(match, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19) & _luhn(digits), match)
    if kind == "phone":
        return F.when(F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15), match)
    if kind == "iban":
        return _iban(match)
    if kind == "secret":
        return F.when(match.rlike("[0-9]") & match.rlike("[A-Za-z]"), match)
    return match


def _score(kind: str, match: Column, around: Column) -> Column:
    near = F.lower(around).rlike(rf"(?<![a-z])(?:{CONTEXT_WORDS[kind]})s?(?![a-z])")
    base = F.lit(BASE_SCORE[kind])
    if kind == "secret":
        base = F.when(match.rlike("^AKIA[A-Z0-9]{16}$"), 0.9).otherwise(base)
    return F.least(F.lit(1.0), base + F.when(near, CONTEXT_BONUS).otherwise(0.0))


def _spans(kind: str, found: Column, pieces: Column) -> Column:
    """Confirmed spans of one kind, from its matches and the text between them."""

    def step(walk: Column, i: Column) -> Column:
        match = F.get(found, i)
        start = walk["at"] + F.length(F.get(pieces, i))
        good = _confirmed(kind, match)
        around = F.concat(
            F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)), F.lit(" "),
            F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS)),
        )
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"),
            (start + F.length(good)).alias("end"), _score(kind, match, around).alias("score"),
        )
        keep = good.isNotNull()
        if kind in ADDED_KINDS:
            keep = keep & (_score(kind, match, around) >= KEEP_FROM)
        return F.struct(
            (start + F.length(match)).alias("at"),
            F.when(keep, F.concat(walk["out"], F.array(span))).otherwise(walk["out"]).alias("out"),
        ).cast(_WALK)

    nothing = F.array().cast(f"array<{_SPAN}>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out")).cast(_WALK)
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step)
    return F.when(F.size(found) > 0, walked["out"]).otherwise(nothing)


def with_spans(docs: DataFrame, text: str, to: str) -> DataFrame:
    """The rows with a column of all spans, by kind as listed and then by start.

    Starts count code points from 0 and ends are exclusive. A null text has no spans.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({
        f"{to}_{kind}": F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        for kind, pattern in PATTERNS.items()
    })
    parted = found.withColumns({
        f"{to}_{kind}_rest": F.when(F.size(f"{to}_{kind}") > 0, F.split(clean, pattern, -1))
        for kind, pattern in PATTERNS.items()
    })
    spans = F.concat(*[
        _spans(kind, F.col(f"{to}_{kind}"), F.col(f"{to}_{kind}_rest")) for kind in KINDS
    ])
    made = [f"{to}_{kind}{end}" for kind in KINDS for end in ("", "_rest")]
    return parted.withColumn(to, spans).drop(*made)


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _of(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, a count per base kind, ``base_sha256`` of the base
    spans, ``spans`` (all, as kind:start:end) and ``max_score`` (null without spans).
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = F.col("found")
    return with_spans(narrow, "text", "found").select(
        "doc_id",
        *[F.size(_of(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_listed(_of(spans, *BASE_KINDS)), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"),
    )


def _merged(spans: Column) -> Column:
    """Spans by start; those that overlap become one, of the kind that starts first."""
    ordered = F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                  s["kind"].alias("kind"))))
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(last["start"].alias("start"),
                          F.greatest(last["end"], s["end"]).alias("end"),
                          last["kind"].alias("kind"))
        overlap = (F.size(out) > 0) & (last["end"] > s["start"])
        return F.when(
            overlap, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        ).otherwise(F.concat(out, F.array(s))).cast(kind)

    return F.when(F.size(spans) > 0, F.aggregate(ordered, F.array().cast(kind), step))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with every span of the text replaced by its kind: ``[EMAIL]``."""
    taken = "_gl_pii"
    spans, merged = F.col(taken), F.col(f"{taken}_merged")
    source = F.col(text)
    parts = F.transform(
        merged,
        lambda s, i: F.concat(
            F.substr(
                source,
                (F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0) + 1).cast("int"),
                (s["start"] - F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0)).cast("int"),
            ),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        ),
    )
    tail = F.substr(source, (F.element_at(merged, -1)["end"] + 1).cast("int"))
    clean = F.when(merged.isNull(), source).otherwise(F.concat(F.array_join(parts, ""), tail))
    marked = with_spans(docs, text, taken).withColumn(f"{taken}_merged", _merged(spans))
    return marked.withColumn(text, clean).select(*docs.columns)
