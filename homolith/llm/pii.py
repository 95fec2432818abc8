"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

# The patterns of the contract. Possessive quantifiers and the guards in front of a run of characters
# leave the leftmost matches as they are and keep long runs from being tried again at each of their characters.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ -][A-Z0-9]{4}){2,7}+(?:[ -][A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
}
#: A text without this has no match; far cheaper to look for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
#: Words near a span that make it likelier, by kind.
CONTEXT = {"email": "mail|contact|write|courriel|correo", "ip": "ip|host|server|address|login", "card": "card|visa|credit|karte|carte|tarjeta|pay", "phone": "call|phone|tel|mobile|fax|contact", "iban": "iban|account|bank|konto|compte|cuenta"}
#: Score of a span that its check confirms; what a context word adds; how many characters before a span count as near,
#: as far as the kind's match before it.
CONFIRMED, CONTEXT_ADDS, NEAR = 0.8, 0.2, 40
#: Matches, or spans, that are folded at once.
BLOCK = 512


def digits(s):
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d):
    """Whether a string of digits passes Luhn."""
    doubled = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(F.filter(doubled, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(s):
    """Whether an IBAN's remainder is 1, blanks and hyphens left out: letters count 10 to 35, its first four characters come last."""
    s = F.regexp_replace(s, "[ -]", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.instr(F.lit(letters), c) + 9)
    step = lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, s):
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return s.rlike(f"^{part}(?<=[0-9])(?:\\.{part}(?<=[0-9])){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(s)).between(12, 19), luhn(digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    if kind == "iban":
        return mod97(s)
    return F.lit(True)


def let(value, f):
    """f(value), with the value computed once however often f's lambdas name it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(blocks, value, join, first):
    """For each block what `join` makes of the values of the blocks before it, from `first` on."""
    step = lambda acc, b: F.struct(join(acc["at"], value(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(blocks, F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])


def in_blocks(rows):
    """An array as arrays of BLOCK elements; one at least, which may be empty."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(rows) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))


SPANS = "array<struct<start:bigint,end:bigint,near:boolean>>"


def kind_spans(text, kind: str):
    """Array of (start, end, near) of a kind's confirmed matches, in code points; near: a context word shortly before.

    The gaps between matches and the matches in turn add up to positions: within blocks, then over the blocks' lengths, so
    that nothing grows by one match at a time over a whole text."""
    pattern = PATTERNS[kind]
    near = lambda g: F.lower(F.right(g, F.lit(NEAR))).rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})")
    part = lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n"), confirmed(kind, m).alias("ok"), near(g).alias("near"))
    none = F.array().cast(SPANS)

    def add(acc, p):
        begin = acc["at"] + p["g"]
        one = F.struct(begin.alias("start"), (begin + p["n"]).alias("end"), p["near"].alias("near"))
        return F.struct((begin + p["n"]).alias("at"), F.when(p["ok"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def placed(blocks):
        starts = running(blocks, lambda b: b["at"], lambda x, y: x + y, F.lit(0).cast("long"))
        moved = lambda b, o: F.transform(b["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["near"].alias("near")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    pairs = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, part))
    found = let(pairs, lambda p: let(F.transform(in_blocks(p), lambda b: F.aggregate(b, start, add)), placed))
    has = text.rlike("[0-9]{2}|[0-9][ -][0-9]") if kind == "card" else text.rlike("[A-Z]{2}[0-9]{2}[ -]?[A-Z0-9]{4}") if kind == "iban" else F.contains(text, F.lit(NEEDS[kind]))
    return F.when(has, found).otherwise(none)


KINDS = ("email", "ip", "card", "phone", "iban")


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the text (null: empty) and the spans, an array of (start, rank, end, kind, score) by start, then kind; and the
    names of these columns, which docs has no others of."""
    whole, spans, *kinds = fresh(docs, "__pii_text", "__pii_spans", *[f"__pii_{k}" for k in KINDS])
    df = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({c: kind_spans(F.col(whole), k) for c, k in zip(kinds, KINDS, strict=True)})

    def scored(column, kind, rank):
        score = lambda s: F.lit(CONFIRMED) + F.when(s["near"], CONTEXT_ADDS).otherwise(0.0)
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score(s).alias("score")))

    df = df.withColumn(spans, F.array_sort(F.concat(*[scored(c, k, i) for i, (c, k) in enumerate(zip(kinds, KINDS, strict=True))])))
    return df.drop(*kinds), whole, spans


def named(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256, spans, n_iban and top_score (null without spans).

    A null or empty text has no spans; repeated rows each get theirs; other columns are not read. The kinds of the
    contract are the base; IBANs that pass mod-97, compact or in groups of four, come beside them. An empty table gives an
    empty result.
    """
    df, _, spans = with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = named(F.filter(spans, lambda s: s["kind"] != "iban"))
    top = F.array_max(F.transform(spans, lambda s: s["score"])).alias("top_score")
    return df.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(base, 256).alias("base_sha256"), named(F.col(spans)).alias("spans"), count("iban"), top)


def replaced(whole, spans):
    """The text with each span replaced by its kind in brackets. Spans are taken in blocks; a block's text is cut out of the
    whole text once, and begins where the blocks before it end."""
    piece = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def block(rows, at):
        end = F.greatest(F.coalesce(F.array_max(F.transform(rows, lambda s: s["end"])), at), at)

        def inner(own):
            def add(acc, s):
                apart = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece(own, acc["at"] - at, s["start"] - at), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))
                over = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
                return F.when(s["start"] >= acc["at"], apart).otherwise(over)

            return F.aggregate(rows, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), add, lambda acc: F.array_join(acc["out"], ""))

        return let(piece(whole, at, end), inner)

    last = lambda b: F.coalesce(F.array_max(F.transform(b, lambda s: s["end"])), F.lit(0).cast("long"))

    def joined(blocks):
        starts = running(blocks, last, lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
        rest = F.substr(whole, (F.array_max(F.transform(blocks, last)) + 1).cast("int"))
        return F.concat(F.array_join(F.zip_with(blocks, starts, block), ""), rest)

    return let(spans, lambda s: let(in_blocks(s), joined))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; spans that overlap become one, of the first kind.

    Columns stay as they are, but for the text and, where there is one, its length. A null text stays null.
    """
    df, whole, spans = with_spans(docs, text)
    (new,) = fresh(df, "__pii_new")
    df = df.withColumn(new, F.when(F.size(spans) > 0, replaced(F.col(whole), F.col(spans))).otherwise(F.col(text)))
    out = [F.col(new).alias(c) if c == text else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == length and text in docs.columns else F.col(c) for c in docs.columns]
    return df.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
