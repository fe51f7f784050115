"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from patterns: the four base kinds and looser ones (addresses spelled out,
phone numbers without a plus, social security numbers, bank accounts).  Four labelers vote +1, 0
or -1 on each candidate: its form (checks such as Luhn), gazetteers (domains, networks, card
issuers, country codes), its context (words to the left) and its shape (repeated or serial digits).
Expectation-maximisation estimates each labeler's reliability for each kind from the counts of
vote patterns over all documents; the posteriors are soft labels for the final span classifier,
a naive Bayes model over the spans' features.  Base findings always stay; other candidates are
added where the classifier finds them likelier than not and no base finding overlaps them.

Documents are scanned once: candidates with votes and features go to a table in the shared folder.
What comes to the driver is a table of counts whose size is bounded by the numbers of kinds, votes
and feature values, whatever the number of documents.

Positions need no code of our own: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) give starts as running sums of lengths, in code points.

Defined results: a null text is empty; a text without findings has empty spans and the digest of the
empty string; repeated rows and null ids keep their rows; a table without rows gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import support

# The base kinds in their order and their patterns.  The lookbehinds and possessive
# quantifiers change no match; they keep the scan linear in runs that lead to none.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Looser candidates: (kind, name, pattern).
LOOSE = (
    ("email", "spelled", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}"),
    ("phone", "local", r"(?<![0-9+().-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    ("ssn", "dashed", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", "spaced", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
KINDS = (*BASE, "ssn", "iban")

# Gazetteers and context words.
DOMAINS = "com net org edu gov mil int info biz io dev app ai eu de fr es it nl be at ch pl se no dk fi pt cz gr ie uk us ca au nz br mx ar jp cn in kr ru za".split()
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6011|65|35)"
RESERVED_NETS = r"^0*(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."
IBAN_COUNTRIES = "AD AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO RS SE SI SK SM TR".split()
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|reach|correo|courriel|mailto",
    "ip": r"(?i)\bip\b|address|host|server|client|network|login",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|telefon|t[eé]l[eé]fono",
    "ssn": r"(?i)ssn|social security|tax id",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"(?i)version|isbn|issue|order|invoice|figure|chapter|serial|model|part no|release"


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once: inside lambdas Spark would evaluate it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


EMPTY = "array<struct<kind:string,name:string,start:int,stop:int,match:string,before:string>>"


def candidates(text: Column, kind: str, name: str, pattern: str) -> Column:
    """Array of struct(kind, name, start, stop, match, before) of a pattern's matches, leftmost and not overlapping."""
    empty = F.array().cast(EMPTY)

    def length(x: Column) -> Column:
        return F.length(x["piece"]) + F.length(x["match"])

    def run(chunk: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["piece"])
            end = begin + F.length(x["match"])
            row = F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), begin.alias("start"), end.alias("stop"), x["match"].alias("match"), F.substring(x["piece"], -48, 48).alias("before"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], row).alias("out"))

        return F.aggregate(chunk, F.struct(base.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def summed(chunks: Column) -> Column:
        # Running sums in two levels, so that n matches cost n * sqrt(n) and not n * n.
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + length(x)))
        bases = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return F.flatten(F.zip_with(chunks, bases, lambda c, base: run(F.coalesce(c, F.array().cast("array<struct<piece:string,match:string>>")), base)))

    def chunked(rows: Column) -> Column:
        many = F.ceil(F.sqrt(F.size(rows))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), many), lambda k: F.slice(rows, k * many + 1, many)), summed)

    def placed(matches: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        rows = F.zip_with(pieces, matches, lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")))
        return F.when(F.size(matches) > 0, let(rows, chunked)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    number = F.reverse(digits(match))
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(number, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def is_base(c: Column) -> Column:
    """Whether a candidate is a base finding."""
    n = F.length(digits(c["match"]))
    right = (
        F.when(c["kind"] == "email", F.lit(True))
        .when(c["kind"] == "ip", c["match"].rlike(IP_VALID))
        .when(c["kind"] == "card", (n >= 13) & (n <= 19) & luhn(c["match"]))
        .when(c["kind"] == "phone", (n >= 9) & (n <= 15))
    )
    return F.when(c["name"] == "base", right).otherwise(F.lit(False))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelled(c: Column) -> Column:
    """The candidate with its votes and features."""
    kind, m, plain = c["kind"], c["match"], digits(c["match"])
    base = is_base(c)
    ssn_bad = m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    form = F.when(c["name"] == "base", vote(base, ~base)).when(kind == "ssn", vote(~ssn_bad, ssn_bad)).when(kind == "phone", vote(plain.rlike("^[2-9][0-9]{2}[2-9]"), plain.rlike("^[01]"))).when(kind == "iban", vote((F.length(F.regexp_replace(m, " ", "")) >= 15), F.length(F.regexp_replace(m, " ", "")) > 34)).otherwise(0)
    domain = F.lower(F.regexp_extract(m, r"([A-Za-z0-9]+)[\])]?$", 1))
    gazetteer = (
        F.when(kind == "email", vote(domain.isin(DOMAINS), F.length(domain) > 12))
        .when(kind == "ip", vote(~m.rlike(RESERVED_NETS), m.rlike(RESERVED_NETS)))
        .when(kind == "card", vote(plain.rlike(ISSUERS), plain.rlike("^[079]")))
        .when((kind == "phone") & (c["name"] == "base"), vote(m.rlike(COUNTRY_CODES), m.rlike(r"^\+0")))
        .when(kind == "iban", vote(F.substring(m, 1, 2).isin(IBAN_COUNTRIES), ~F.substring(m, 1, 2).isin(IBAN_COUNTRIES)))
        .otherwise(0)
    )
    said = F.lit(False)
    for k, words in CONTEXT.items():
        said = F.when(kind == k, c["before"].rlike(words)).otherwise(said)
    context = vote(said, c["before"].rlike(AGAINST))
    shape = vote(F.lit(False), plain.rlike(r"([0-9])\1{6}|0123456|1234567|7654321"))
    size = F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).otherwise(2)
    split_up = m.rlike("[ ().-]").cast("int")
    border = F.when(c["before"].rlike(r"[\s\"'(:=<]$"), 0).when(F.length(c["before"]) == 0, 1).otherwise(2)
    return F.struct(kind.alias("kind"), c["name"].alias("name"), c["start"].alias("start"), c["stop"].alias("stop"), base.alias("base"), form.alias("form"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), size.alias("size"), split_up.alias("split_up"), border.alias("border"))


LABELERS = ("form", "gazetteer", "context", "shape")
FEATURES = ("name", "gazetteer", "context", "shape", "size", "split_up", "border")


def em(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """P(true | votes) of one kind's vote patterns: two classes, labelers independent given the class.

    Starts from the share of positive votes; every estimate has pseudo-counts, so no chance is 0 or 1.
    """
    posterior = {votes: (1.0 + sum(v > 0 for v in votes)) / (2.0 + sum(v != 0 for v in votes)) for votes in counts}
    for _ in range(rounds):
        mass = [1.0, 1.0]
        chance = [[defaultdict(lambda: 0.5) for _ in LABELERS] for _ in range(2)]
        for votes, n in counts.items():
            for truth, p in ((1, posterior[votes]), (0, 1 - posterior[votes])):
                mass[truth] += n * p
                for j, v in enumerate(votes):
                    chance[truth][j][v] += n * p
        for j in range(len(LABELERS)):  # a labeler is taken to be better than chance
            chance[1][j][1] += 2.0
            chance[0][j][-1] += 2.0
        whole = [[sum(chance[t][j][v] for v in (-1, 0, 1)) for j in range(len(LABELERS))] for t in range(2)]
        moved = 0.0
        for votes in counts:
            logs = [math.log(mass[t]) + sum(math.log(chance[t][j][v] / whole[t][j]) for j, v in enumerate(votes)) for t in range(2)]
            p = 1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1]))))
            moved = max(moved, abs(p - posterior[votes]))
            posterior[votes] = p
        if moved < 1e-9:
            break
    return posterior


def train(rows: list) -> dict[str, dict[str, float]]:
    """Log odds by kind: of the kind itself (''), and of each 'feature=value'; from counts by votes and features."""
    by_kind: dict = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_kind[r["kind"]][tuple(r[x] for x in LABELERS)] += r["n"]
    soft = {kind: em(counts) for kind, counts in by_kind.items()}
    model = {}
    for kind in soft:
        mass, seen = [1.0, 1.0], [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
        values = defaultdict(set)
        for r in (r for r in rows if r["kind"] == kind):
            p = soft[kind][tuple(r[x] for x in LABELERS)]
            for truth, share in ((1, p), (0, 1 - p)):
                mass[truth] += r["n"] * share
                for f in FEATURES:
                    seen[truth][f"{f}={r[f]}"] += r["n"] * share
                    values[f].add(r[f])
        model[kind] = {"": math.log(mass[1] / mass[0])}
        for f, found in values.items():
            for v in found:
                k = f"{f}={v}"
                model[kind][k] = math.log(seen[1][k] / (mass[1] + len(found))) - math.log(seen[0][k] / (mass[0] + len(found)))
    return model


def log_odds(c: Column, model: dict[str, dict[str, float]]) -> Column:
    out = F.lit(-1.0)
    for kind, weights in model.items():
        total = F.lit(weights[""])
        for f in FEATURES:
            part = F.lit(0.0)
            for k, w in weights.items():
                if k.startswith(f + "="):
                    value = k.partition("=")[2]
                    part = F.when(c[f].cast("string") == value, F.lit(w)).otherwise(part)
            total = total + part
        out = F.when(c["kind"] == kind, total).otherwise(out)
    return out


def rendered(spans: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), spans["kind"])
    return F.struct(place.alias("place"), spans["start"].alias("start"), spans["stop"].alias("stop"), spans["kind"].alias("kind"))


def joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, rendered))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts of base findings by kind, the digest of base spans and all spans, for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    arrays = {f"c_{k}": candidates(F.col("text"), k, "base", PATTERNS[k]) for k in BASE}
    arrays |= {f"c_{k}_{name}": candidates(F.col("text"), k, name, p) for k, name, p in LOOSE}
    rows = rows.withColumns(arrays).select("doc_id", F.concat(*arrays).alias("found"))
    rows = support.table(rows.select("doc_id", F.transform("found", labelled).alias("found")), "pii")
    c = F.explode("found").alias("c")
    columns = list(dict.fromkeys((*LABELERS, *FEATURES)))
    counts = rows.select(c).groupBy("c.kind", *[F.col(f"c.{x}") for x in columns]).agg(F.count(F.lit(1)).alias("n"))
    model = train(counts.orderBy("kind", *columns).collect())
    base = F.filter("found", lambda s: s["base"])
    likely = F.filter("found", lambda s: ~s["base"] & (log_odds(s, model) > 0) & ~((s["name"] == "base") & (s["form"] == -1)))
    added = F.filter("likely", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    rows = rows.withColumns({"base": base, "likely": likely}).withColumn("all", F.concat("base", added))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *[counted(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
