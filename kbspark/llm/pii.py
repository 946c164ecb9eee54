"""PII by weak supervision, in DataFrame functions throughout.

1. Expressions propose candidate spans: those of the base rule, and wider ones (national phone and identity
   numbers, account numbers, titled names). Offsets come from the lengths of what lies between matches.
2. Four labelers vote on each candidate, +1, -1 or 0: regex (the strict rule of its kind), gazetteer (lists
   of domains, issuers, countries, given names), context (words before it) and shape (its grouping).
3. Counts of vote patterns are summed by Spark (a pattern table has at most kinds x 3^4 x lengths rows, so it
   is small whatever the input); expectation-maximisation over that table estimates the reliability of every
   labeler in both classes and the share of true spans of every kind.
4. A logistic regression learns the posteriors from kind, votes and length; its weights become a column
   expression that decides about candidates. Spans of the base rule stay in any case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.stages import settle

KINDS = ("email", "ip", "card", "phone", "national", "identity", "account", "name")
BASE = 4  # of KINDS; the base rule's

# The base rule's expressions. Possessive loops and look-behinds keep them linear: a match can only begin
# where its first run of characters does, or where the match before ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = r"(?<![0-9A-Za-z+.-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?:Mrs|Mr|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?)(?![0-9A-Za-z-])"

# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "io", "ai", "app", "dev", "info", "biz", "de", "fr", "es", "it", "nl", "be", "at", "ch", "pt", "pl", "se", "no", "dk", "fi", "ie", "uk", "eu", "us", "ca", "mx", "br", "ar", "cl", "co", "jp", "cn", "in", "kr", "au", "nz", "za", "ru", "ua", "tr", "gr", "cz", "hu", "ro", "example", "test")
NO_DOMAINS = ("png", "jpg", "gif", "svg", "js", "css", "py", "java", "html", "txt", "json", "xml", "md", "local", "localhost", "invalid")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-9])"
GIVEN = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul", "Steven", "Andrew", "George", "Kevin", "Brian", "Edward", "Peter", "Henry", "Jack", "Frank", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Lisa", "Nancy", "Anna", "Emma", "Laura", "Julia", "Alice", "Jane", "Helen", "Emily",
    "Hans", "Klaus", "Jürgen", "Stefan", "Andreas", "Wolfgang", "Heinz", "Petra", "Sabine", "Monika", "Ursula", "Heike", "Jean", "Pierre", "Michel", "Philippe", "Claude", "Jacques", "Louis", "Marie", "Claire", "Sophie", "Camille", "Nathalie", "José", "Jose", "Carlos", "Juan", "Luis", "Antonio", "Manuel", "Pedro", "Miguel", "Maria", "María", "Carmen", "Ana", "Lucia", "Lucía", "Elena",
)
NO_NAMES = ("The", "This", "That", "President", "Minister", "Director", "Chairman", "Speaker", "Who", "Right", "Wrong", "Big", "Evil", "Robot")
CONTEXT = {
    "email": "mail|contact|write|reach|address",
    "ip": "ip|server|host|address|login|from|connect",
    "card": "card|visa|master|amex|credit|payment|pay|cc",
    "phone": "phone|tel|call|mobile|fax|cell|contact|whatsapp",
    "national": "phone|tel|call|mobile|fax|cell|contact",
    "identity": "ssn|social|security|identity|tax",
    "account": "iban|account|bank|transfer",
    "name": "patient|customer|signed|dear|contact|by",
}
AGAINST = "version|isbn|issn|order|invoice|serial|sku|build|release|chapter|page|http"


def _found(pattern: str) -> tuple[Column, Column]:
    text = F.col("text")
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


BLOCK = 256  # matches whose places are summed at once


def _located(found: Column, between: Column) -> Column:
    """Structs start, end, s (the match), before (up to 40 characters). Places are running sums of lengths, by blocks of
    matches and then over blocks, so that texts with very many matches take little more than linear time."""
    kind = "array<struct<start:int,end:int,s:string,before:string>>"
    empty = F.array().cast(kind)

    def grow(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s"), F.right(x["gap"], F.lit(40)).alias("before")))).alias("out"))

    def local(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), grow)

    def moved(x: Column, by: Column) -> Column:
        return F.transform(x["out"], lambda y: F.struct((y["start"] + by).alias("start"), (y["end"] + by).alias("end"), y["s"].alias("s"), y["before"].alias("before")))

    def joined(locals_: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(locals_, first, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(locals_, bases, moved))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda s, g: F.struct(s.alias("s"), g.alias("gap")))
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: local(F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x is made once
    return F.when(F.size(found) > 0, bound(pairs, lambda p: bound(blocks(p), joined))).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _strict(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    d = _digits(s)
    if kind == "card":
        return F.length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "national":
        return s.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]")
    if kind == "identity":
        return ~s.rlike("^(?:000|666|9)") & ~s.rlike("-00-") & ~s.rlike("-0000$")
    if kind == "account":  # remainder 1 modulo 97 after moving four characters and writing letters as numbers
        moved = F.regexp_replace(s, " ", "")
        moved = F.concat(F.substr(moved, F.lit(5)), F.substring(moved, 1, 4))
        code = lambda r, c: (F.when(F.ascii(c) >= 65, r * 100 + F.ascii(c) - 55).otherwise(r * 10 + F.ascii(c) - 48)) % 97
        return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), code) == 1
    return s.rlike(r"^(?:Mrs|Mr|Ms|Dr|Prof)\.? [A-Z][a-z]{2,}")


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0).cast("int")


def _votes(kind: str, x: Column) -> dict[str, Column]:
    s, before = x["s"], F.lower(x["before"])
    d = _digits(s)
    gazetteer = {
        "email": _vote(F.lower(F.regexp_extract(s, r"\.([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), F.lower(F.regexp_extract(s, r"\.([A-Za-z0-9-]+)$", 1)).isin(*NO_DOMAINS)),
        "ip": _vote(~s.rlike(r"^(?:0|127|255)\."), s.rlike(r"^(?:0|255)\.")),
        "card": _vote(d.rlike(ISSUERS)),
        "phone": _vote(F.regexp_replace(s, "[^+0-9]", "").rlike(COUNTRIES)),
        "national": _vote(d.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)"), d.rlike("^(?:[01]|.11)")),
        "identity": _vote(d.rlike("^(?!000|666|9)[0-7]"), d.rlike("^(?:000|666|9)|^123456789$|^([0-9])\\1*$")),
        "account": _vote(s.rlike("^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)")),
        "name": _vote(s.rlike(rf" (?:{'|'.join(GIVEN)})\b"), s.rlike(rf" (?:{'|'.join(NO_NAMES)})\b")),
    }[kind]
    shape = {
        "email": _vote(~s.rlike(r"^[.-]|\.\.|-\."), s.rlike(r"^[.-]|\.\.")),
        "ip": _vote(~s.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(s.rlike("^(?:[0-9]{12,19}|(?:[0-9]{4}[ -]){3,4}[0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")),
        "phone": _vote(s.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$")),
        "national": _vote(s.rlike(r"^(?:\([0-9]{3}\) |[0-9]{3}([.-]))[0-9]{3}[.-][0-9]{4}$"), s.rlike(r"^[0-9]{3}\)|^\([0-9]{3}[^)]")),
        "identity": _vote(~s.rlike("-00-|-0000$"), s.rlike("-00-|-0000$")),
        "account": _vote(F.length(F.regexp_replace(s, " ", "")).between(15, 34)),
        "name": _vote(s.rlike(r"\.? [A-Z][a-z]+ [A-Z]"), s.rlike(r" [A-Z][a-z]?$")),
    }[kind]
    context = _vote(before.rlike(rf"\b(?:{CONTEXT[kind]})\w*\W*(?:\w+\W+)?$"), before.rlike(rf"\b(?:{AGAINST})\w*\W*(?:\w+\W+)?$"))
    return {"regex": _vote(_strict(kind, s)), "gazetteer": gazetteer, "context": context, "shape": shape}


LABELERS = ("regex", "gazetteer", "context", "shape")
#: Chances of a right and of a wrong vote from which expectation-maximisation starts: strict rules err least.
START = {"regex": (0.85, 0.03), "gazetteer": (0.5, 0.2), "context": (0.4, 0.1), "shape": (0.5, 0.2)}
_CANDIDATE = "array<struct<start:int,kind:int,end:int,base:boolean,regex:int,gazetteer:int,context:int,shape:int,size:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the candidates of every row with their votes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gate = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    digit = F.col("text").rlike("[0-9]")
    sets = []
    for kind, pattern in PATTERNS.items():
        found, between = _found(pattern)
        sets.append((kind, gate.get(kind, digit), found, between))
    found, between = _found(WIDE)
    sets.append(("wide", digit | F.col("text").rlike(r"\b(?:Mrs|Mr|Ms|Dr|Prof)\b"), found, between))
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "text", *[F.when(g, f).otherwise(none).alias(f"f_{k}") for k, g, f, _ in sets])
    rows = rows.select("doc_id", *[F.when(F.size(f"f_{k}") > 0, b).otherwise(none).alias(f"b_{k}") for k, _, _, b in sets], *[f"f_{k}" for k, *_ in sets])
    rows = rows.select("doc_id", *[_located(F.col(f"f_{k}"), F.col(f"b_{k}")).alias(k) for k, *_ in sets])

    def judged(kind: str, x: Column, base: bool) -> Column:
        votes = _votes(kind, x)
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), ((votes["regex"] == 1) if base else F.lit(False)).alias("base"), *[votes[v].alias(v) for v in LABELERS], F.least(F.length(x["s"]) / 4, F.lit(7)).cast("int").alias("size")
        )

    def wide(x: Column) -> Column:
        s = x["s"]
        return F.when(s.rlike("^[0-9]{3}-[0-9]{2}-"), judged("identity", x, False)).when(s.rlike("^[(0-9]"), judged("national", x, False)).when(s.rlike("^[A-Z]{2}[0-9]"), judged("account", x, False)).otherwise(judged("name", x, False))

    own = lambda kind: lambda x: judged(kind, x, True)
    parts = [F.transform(k, own(k)) for k in PATTERNS] + [F.transform("wide", wide)]
    return rows.select("doc_id", F.concat(*[p.cast(_CANDIDATE) for p in parts]).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], steps: int = 30) -> tuple[dict, dict]:
    """({kind: share}, {(labeler, class, vote): probability}) by expectation-maximisation over counted vote patterns."""
    kinds = {k for k, _, _ in patterns}
    share = dict.fromkeys(kinds, 0.5)
    chance = {(i, c, v): (1 - sum(START[name]) if v == 0 else START[name][(v == 1) != (c == 1)]) for i, name in enumerate(LABELERS) for c in (0, 1) for v in (-1, 0, 1)}
    for _ in range(steps):
        n = dict.fromkeys(chance, 0.5)
        true, total = dict.fromkeys(kinds, 1.0), dict.fromkeys(kinds, 2.0)
        for k, votes, count in patterns:
            p = posterior(share[k], chance, votes)
            for i, v in enumerate(votes):
                n[i, 1, v] += count * p
                n[i, 0, v] += count * (1 - p)
            true[k] += count * p
            total[k] += count
        share = {k: true[k] / total[k] for k in kinds}
        chance = {(i, c, v): n[i, c, v] / sum(n[i, c, w] for w in (-1, 0, 1)) for i, c, v in chance}
        for i in range(len(LABELERS)):  # a labeler is taken to be no worse than chance
            for v in (-1, 1):
                if (chance[i, 1, v] - chance[i, 0, v]) * v < 0:
                    chance[i, 1, v] = chance[i, 0, v] = (chance[i, 1, v] + chance[i, 0, v]) / 2
    return share, chance


def posterior(share: float, chance: dict, votes: tuple[int, ...]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(chance[i, 1, v] / chance[i, 0, v]) for i, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _features(kind: Column, votes: list[Column], size: Column) -> list[Column]:
    return [(kind == k).cast("double") for k in range(len(KINDS))] + [(v == w).cast("double") for v in votes for w in (1, -1)] + [size.cast("double") / 7]


def train(spans: DataFrame):
    """A function (span struct) -> probability as a column, from (spans) of all documents."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = spans.sparkSession
    each = spans.select(F.explode("spans").alias("x")).select("x.*")
    counted = each.groupBy("kind", *LABELERS, "size").agg(F.count("*").alias("n")).collect()  # a bounded pattern table
    if not counted:
        return lambda x: F.lit(0.0)
    patterns = [(r["kind"], tuple(r[v] for v in LABELERS), float(r["n"])) for r in counted]
    share, chance = reliabilities(patterns)
    soft = [(r["kind"], *votes, r["size"], label, n * (p if label else 1 - p)) for r, (k, votes, n) in zip(counted, patterns, strict=True) for p in [posterior(share[k], chance, votes)] for label in (0, 1)]
    rows = spark.createDataFrame(soft, f"kind int, {', '.join(f'{v} int' for v in LABELERS)}, size int, label int, weight double")
    features = _features(F.col("kind"), [F.col(v) for v in LABELERS], F.col("size"))
    rows = rows.select("label", "weight", *[f.alias(f"x{i}") for i, f in enumerate(features)])
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(rows).coalesce(1)
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40, standardization=False).fit(rows)
    weights, bias = [float(w) for w in model.coefficients], float(model.intercept)

    def probability(x: Column) -> Column:
        total = F.lit(bias)
        for w, f in zip(weights, _features(x["kind"], [x[v] for v in LABELERS], x["size"]), strict=True):
            total = total + w * f
        return 1 / (1 + F.exp(-total))

    return probability


def _below(numbers: str, limit: Column) -> Column:
    """How many of an ascending array column are below limit, by binary search."""
    n = F.size(numbers)
    step = lambda at, k: F.when((at + k <= n) & (F.get(numbers, F.least(at + k, n) - 1) < limit), at + k).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), step)


def find_pii(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of docs(doc_id, text).

    Spans of the base rule stay. A wider candidate, or one of the base kinds that fails its rule, is added if
    the classifier gives it ``least`` and no span of the base rule overlaps it; no labeler has a veto. A null text
    is empty: no span, and the hash of nothing. Repeated rows, and rows with a null id, give a row each; other
    columns are ignored.
    """
    found = settle(candidates(docs), "pii-candidates")
    probability = train(found.select("spans"))
    base = F.filter("spans", lambda x: x["base"])
    found = found.withColumn("own", base)
    found = found.withColumns({"starts": F.sort_array(F.transform("own", lambda b: b["start"])), "ends": F.sort_array(F.transform("own", lambda b: b["end"]))})
    # spans that begin before x ends and did not end before x begins overlap it
    more = F.filter("spans", lambda x: (~x["base"]) & (probability(x) >= least) & (_below("starts", x["end"]) == _below("ends", x["start"] + 1)))
    found = found.withColumn("more", more)
    names = F.array(*[F.lit(k) for k in KINDS])
    key = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    write = lambda spans: F.array_join(F.transform(F.sort_array(F.transform(spans, key)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("own", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(write(F.col("own")), 256).alias("base_sha256"), write(F.concat("own", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"))
