"""Personal data by weak supervision, with DataFrame functions only.

Candidates are what the base patterns find, what they find but reject, and what
looser patterns find.  Five labelers vote on each: the pattern, a validity check,
a gazetteer, the words before it and its edges.  The votes are counted by pattern
of votes; expectation-maximisation over these counts estimates how reliable each
labeler is and how likely each vote pattern is personal data; a logistic span
classifier is trained on that.  The counts are a table of at most 4 kinds x 3
origins x 3^5 votes, so the model is fitted on the driver from all candidates of
all documents.  Base spans always stay; the classifier decides on the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")
#: Origins of a candidate.
BASE, FAILED, LOOSE = 0, 1, 2

LOCAL = "[A-Za-z0-9._%+-]"
#: A dot between label characters is replaced by this one before mails are sought, so
#: that no group repeats: Java walks repeated groups by recursion.
DOT = "\ue000"
MAIL = f"(?:(?<!LOCAL)|\\G)LOCAL++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++".replace("LOCAL", LOCAL.replace("._", f"._{DOT}"))
#: For texts that hold the replacement character itself.
MAIL_PLAIN = f"(?:(?<!{LOCAL})|\\G){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
#: Equal to the contract's patterns, but each run is entered once.
PATTERNS = {
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?[(\[]at[)\]][\x20]?[A-Za-z0-9-]++(?:[\x20]?(?:[(\[]dot[)\]]|\.)[\x20]?[A-Za-z0-9-]++){1,4}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?<![0-9][\x20])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[\x20.-][0-9])",
}
TOP_DOMAINS = "com org net edu gov int info biz io eu de fr es it nl uk us ca ch at be pl pt se dk no fi ie ru jp cn in br mx au".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt", "write to"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "móvil", "telefon", "téléphone"),
}
AGAINST = ("version", "isbn", "invoice", "order no", "serial", "chapter", "release")
CONTEXT_CHARS = 40
#: Code points in a block of a text.
BLOCK = 256
#: Beyond the end of any text.
FAR = 2**31 - 1

SPAN = "struct<kind:int,start:int,end:int,value:string,origin:int>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    marks = F.split(F.reverse(digits), "")
    # Every second digit from the right is doubled; (2 d) div 10 + (2 d) mod 10.
    worth = F.transform(marks, lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") * 2 / 10).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def octets_fit(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def passes(kind: str, value: Column) -> Column:
    """The base rule on a match of the base pattern."""
    if kind == "ip":
        return octets_fit(value)
    if kind == "card":
        return luhn(only_digits(value))
    if kind == "phone":
        return F.length(only_digits(value)).between(8, 15)
    return F.lit(True)


def scan(values: Column, combine, back: bool = False) -> Column:
    """At each place, ``combine`` of all values up to it (``back``: from it on).

    By doubling, so it takes n log n steps: an aggregate that appends to an array
    copies the array for each element.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def double(done, r):
        away = F.pow(F.lit(2), r).cast("int")

        def step(v, i):
            other = F.get(done, i + away if back else i - away)
            return F.when(other.isNull(), v).otherwise(combine(v, other))

        return F.transform(done, step)

    return F.aggregate(rounds, values, double)


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, so that a place deep in it is reached without walking there."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def excerpt(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text that was cut into ``blocks``."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substring(joined, start - first * BLOCK + 1, end - start)


def located(values: Column, pieces: Column, kind: int, origin: int) -> Column:
    """Matches and the pieces before them as spans in code points."""
    ends = scan(F.zip_with(values, F.slice(pieces, F.lit(1), F.size(values)), lambda v, p: F.length(p) + F.length(v)), lambda a, b: a + b)

    def span(value, end):
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), F.lit(origin).alias("origin"))

    return F.zip_with(values, ends, span)


def nothing(kind: str = "string") -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def with_matches(df: DataFrame, source: str, pattern: str, may: Column, kind: int, origin: int, out: str) -> DataFrame:
    """Adds ``out``: the spans of a pattern in column ``source`` of the rows where ``may`` holds."""
    df = df.withColumn("_v", F.when(may, F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).otherwise(nothing()))
    df = df.withColumn("_p", F.when(F.size("_v") > 0, F.split(source, pattern, -1)).otherwise(nothing()))
    return df.withColumn(out, F.when(F.size("_v") > 0, located(F.col("_v"), F.col("_p"), kind, origin)).otherwise(nothing(SPAN))).drop("_v", "_p")


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``base`` and ``others`` (arrays of spans with votes) to a frame that has ``text``."""
    text = F.col("text")
    at = F.contains(text, F.lit("@"))
    df = df.withColumn("_dotted", F.when(at, F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)))
    plain = F.contains(text, F.lit(DOT))
    df = with_matches(df, "_dotted", MAIL, at & ~plain, 0, BASE, "_m0")
    df = with_matches(df, "text", MAIL_PLAIN, at & plain, 0, BASE, "_m0p").drop("_dotted")
    mails = F.transform(F.concat("_m0", "_m0p"), lambda s: s.withField("value", F.translate(s["value"], DOT, ".")))
    df = df.withColumn("_b0", mails).drop("_m0", "_m0p")
    may = {"ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    for k, kind in enumerate(KINDS[1:], 1):
        df = with_matches(df, "text", PATTERNS[kind], may[kind], k, BASE, f"_b{k}")
    loose = {
        "email": F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), "ip": F.contains(text, F.lit(":")), "card": may["card"],
        "phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    }
    for k, kind in enumerate(KINDS):
        df = with_matches(df, "text", LOOSE_PATTERNS[kind], loose[kind], k, LOOSE, f"_l{k}")

    def meets(kind: str, wanted: bool):
        return lambda s: passes(kind, s["value"]) == F.lit(wanted)

    good = [F.filter(f"_b{k}", meets(kind, True)) for k, kind in enumerate(KINDS)]
    bad = [F.transform(F.filter(f"_b{k}", meets(kind, False)), lambda s: s.withField("origin", F.lit(FAILED))) for k, kind in enumerate(KINDS)]
    df = df.withColumn("_good", F.concat(*good)).withColumn("_rest", F.concat(*bad, *[F.col(f"_l{k}") for k in range(4)]))
    df = df.drop(*[f"_{x}{k}" for x in "bl" for k in range(4)])
    # In order of their starts, a span overlaps a base one if one that starts no later ends after its start, or one that
    # starts no earlier starts before its end.
    tagged = lambda spans, good: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(good).alias("good"), s.alias("span")))
    df = df.withColumn("_all", F.when(F.size("_rest") > 0, F.sort_array(F.concat(tagged("_good", True), tagged("_rest", False)))).otherwise(tagged(nothing(SPAN), False)))
    ends = scan(F.transform("_all", lambda s: F.when(s["good"], s["end"]).otherwise(F.lit(0))), F.greatest)
    starts = scan(F.transform("_all", lambda s: F.when(s["good"], s["start"]).otherwise(F.lit(FAR))), F.least, back=True)
    df = df.withColumn("_ends", ends).withColumn("_starts", starts)
    apart = F.filter(F.arrays_zip("_all", "_ends", "_starts"), lambda x: ~x["_all"]["good"] & (x["_ends"] <= x["_all"]["start"]) & (x["_starts"] >= x["_all"]["end"]))
    df = df.withColumn("_rest", F.transform(apart, lambda x: x["_all"]["span"])).drop("_all", "_ends", "_starts")
    any_span = (F.size("_good") > 0) | (F.size("_rest") > 0)
    df = df.withColumn("_blocks", F.when(any_span, blocks_of(text)).otherwise(nothing()))
    return df.withColumn("base", F.transform("_good", voted)).withColumn("others", F.transform("_rest", voted)).drop("_good", "_rest", "_blocks")


def voted(span: Column) -> Column:
    """The span with its five votes: 1 for personal data, -1 against, 0 for none; needs ``_blocks``."""
    kind, value, origin, blocks = span["kind"], span["value"], span["origin"], F.col("_blocks")
    digits = only_digits(value)
    bare = F.lower(F.regexp_replace(value, r"[\x20()\[\]]", ""))
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    sign = lambda condition: F.when(condition, yes).otherwise(no)
    check = (
        F.when(kind == 0, sign(bare.rlike("[a-z]{2,}$")))
        .when(kind == 1, sign((origin == LOOSE) | octets_fit(value)))
        .when(kind == 2, sign(luhn(digits)))
        .otherwise(F.when(F.length(digits).between(10, 15), yes).when(F.length(digits).between(8, 9), none).otherwise(no))
    )
    gazetteer = (
        F.when(kind == 0, F.when(F.regexp_extract(bare, "([a-z]+)$", 1).isin(TOP_DOMAINS), yes).otherwise(none))
        .when(kind == 1, F.when(origin == LOOSE, none).otherwise(sign(F.coalesce(F.split(value, r"\.")[0].try_cast("int"), F.lit(999)).between(1, 223))))
        .when(kind == 2, F.when(digits.rlike(ISSUERS), yes).otherwise(none))
        .otherwise(F.when(origin == LOOSE, none).otherwise(sign(value.rlike(COUNTRY_CODES))))
    )
    before = F.lower(excerpt(blocks, F.greatest(F.lit(0), span["start"] - CONTEXT_CHARS), span["start"]))
    said = F.lit(False)
    for k, kind_name in enumerate(KINDS):
        said = F.when(kind == k, before.rlike(r"(?<!\p{L})(?:" + "|".join(CONTEXT[kind_name]) + ")")).otherwise(said)
    context = F.when(before.rlike("|".join(AGAINST)), no).when(said, yes).otherwise(none)
    around = F.concat(excerpt(blocks, F.greatest(F.lit(0), span["start"] - 1), span["start"]), excerpt(blocks, span["end"], span["end"] + 1))
    edges = F.when(around.rlike(r"[\p{L}\p{N}]"), no).otherwise(yes)
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), origin.alias("origin"),
        F.array(F.when(origin == BASE, yes).otherwise(none), check, gazetteer, context, edges).alias("votes"),
    )


@dataclass
class SpanModel:
    """Log odds of a candidate: bias by kind and origin, and a weight for each labeler's vote (-1, 0, 1)."""

    kinds: list[float]
    origins: list[float]
    votes: list[list[float]]
    reliability: dict

    def odds(self, span: Column) -> Column:
        pick = lambda numbers, at: F.element_at(F.array(*map(F.lit, numbers)), at + 1)
        total = pick(self.kinds, span["kind"]) + pick(self.origins, span["origin"])
        for i, weights in enumerate(self.votes):
            total = total + pick(weights, F.element_at(span["votes"], i + 1) + 1)
        return total


def fit(candidates: DataFrame, rounds: int = 50, steps: int = 400) -> SpanModel:
    """EM and the classifier, from the counts of (kind, origin, votes) over all candidates."""
    spans = candidates.select(F.explode(F.concat("base", "others")).alias("s")).groupBy("s.kind", "s.origin", "s.votes").agg(F.count("*").alias("n"))
    rows = [(r["kind"], r["origin"], tuple(r["votes"]), r["n"]) for r in sorted(spans.collect(), key=lambda r: (r["kind"], r["origin"], r["votes"]))]
    n_votes = len(LABELERS)
    belief = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, _, v, _ in rows]
    prior, table = [0.5] * 4, []
    for _ in range(rounds if rows else 0):
        table = []
        for i in range(n_votes):
            counts = [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]
            for (_, _, v, n), q in zip(rows, belief):
                counts[1][v[i] + 1] += n * q
                counts[0][v[i] + 1] += n * (1 - q)
            # A labeler is at least as likely to say yes to personal data as to anything else, so the classes keep their meaning.
            shares = [[c / sum(row) for c in row] for row in counts]
            table.append(shares if shares[1][2] >= shares[0][2] else [[sum(x) / 2 for x in zip(*shares)]] * 2)
        for k in range(4):
            mass = [(n, q) for (kind, _, _, n), q in zip(rows, belief) if kind == k]
            prior[k] = (1 + sum(n * q for n, q in mass)) / (2 + sum(n for n, _ in mass))
        fresh = []
        for kind, _, v, _ in rows:
            yes = math.log(prior[kind]) + sum(math.log(table[i][1][v[i] + 1]) for i in range(n_votes))
            no = math.log(1 - prior[kind]) + sum(math.log(table[i][0][v[i] + 1]) for i in range(n_votes))
            fresh.append(1 / (1 + math.exp(max(-500.0, min(500.0, no - yes)))))
        belief = fresh
    model = SpanModel([0.0] * 4, [0.0] * 3, [[0.0] * 3 for _ in LABELERS], {n: t for n, t in zip(LABELERS, table)})
    total = sum(n for *_, n in rows) or 1
    for _ in range(steps):
        slope_k, slope_o, slope_v = [0.0] * 4, [0.0] * 3, [[0.0] * 3 for _ in LABELERS]
        for (kind, origin, v, n), q in zip(rows, belief):
            odds = model.kinds[kind] + model.origins[origin] + sum(model.votes[i][v[i] + 1] for i in range(n_votes))
            gap = (q - 1 / (1 + math.exp(max(-500.0, min(500.0, -odds))))) * math.sqrt(n / total)
            slope_k[kind] += gap
            slope_o[origin] += gap
            for i in range(n_votes):
                slope_v[i][v[i] + 1] += gap
        move = lambda old, slope: [0.999 * w + 0.5 * s for w, s in zip(old, slope)]
        model.kinds, model.origins = move(model.kinds, slope_k), move(model.origins, slope_o)
        model.votes = [move(w, s) for w, s in zip(model.votes, slope_v)]
    return model


def with_spans(docs: DataFrame, text_col: str, model: SpanModel | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``), ``text`` (null as empty), ``base`` and ``added`` spans."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_candidates(rows)
    model = model or fit(found)
    return found.withColumn("added", F.filter("others", lambda s: model.odds(s) > 0)).drop("others")


def listing(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of a document), ``base`` and ``spans``: arrays of (kind, start, end, origin, votes).

    Offsets are code points, the end exclusive.  Null and empty texts have no spans.
    Each row stands for itself: repeated rows and null ids stay, and columns of any
    name stay inside ``row``.
    """
    found = with_spans(docs, text_col)
    return found.select("row", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are replaced as one.

    Texts without a span stay as they are, null ones too.  ``chars_col``, if there, becomes the new length.
    """
    found = with_spans(docs, text_col)
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("spans", spans)
    found = found.withColumn("_blocks", F.when(F.size("spans") > 0, blocks_of(F.col("text"))).otherwise(nothing()))
    found = found.withColumn("_ends", scan(F.transform("spans", lambda s: s["end"]), F.greatest))
    name = lambda s: F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit(">"))
    done = F.transform("_ends", lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get("_ends", i - 1)))
    found = found.withColumn("_parts", F.zip_with("spans", done, lambda s, at: F.when(s["start"] >= at, F.concat(excerpt(F.col("_blocks"), at, s["start"]), name(s))).otherwise(F.lit(""))))
    tail = excerpt(F.col("_blocks"), F.get("_ends", F.size("_ends") - 1), F.length("text"))
    out = found.withColumn("clean", F.when(F.size("spans") > 0, F.concat(F.array_join("_parts", ""), tail)).otherwise(F.col("row")[text_col]))
    columns = [F.col("clean").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    result = out.select(*columns)
    if chars_col in docs.columns:
        result = result.withColumn(chars_col, F.coalesce(F.length(text_col), F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return result
