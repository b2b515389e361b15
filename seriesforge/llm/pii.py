"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; labelers vote on each (does its strict form hold, does
a gazetteer know a part of it, does the text before it speak for or against it,
is it a word of its own). Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is for each kind of span, without
labels, and a logistic classifier of votes and shape is trained on the resulting
probabilities. Spans that meet the strict rules always stay; the classifier
adds others.

Spans are found in one pass over the whole texts and staged as small rows. Only
counts of vote patterns, bounded by kinds, votes and shape classes, reach the
driver. Nothing is shuffled but those counts, combined per task first. The
patterns are possessive and anchored, so their time is linear in the text.

Defined results: a null text counts as empty; a document without spans has zero
counts, an empty span list and the hash of the empty string; null and repeated
ids are returned as they are, one row for each; an empty table gives an empty
result; further columns, whatever their names, are ignored (``masked`` keeps
them, and masks every row by its own text).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import staged, table

#: Positions are summed up in blocks of so many spans.
BLOCK = 128
ROUNDS = 50
THRESHOLD = 0.5

# (kind, quick test, pattern). The first four are the base kinds. (?:\G|(?<!x)) lets a match begin where a
# run of such characters begins or the last match ended; other places in the run would end the same way.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email_spelled", r"[\[(](?:at|AT)[\])]", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]++)++"),
    ("phone_local", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"(?<![0-9.(-])(?<!\+[0-9]{1,3} ?)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    ("person", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.? \p{Lu}", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?"),
)
KINDS = tuple(k for k, _, _ in PATTERNS)
BASE = KINDS[:4]

# Gazetteers: fixed values.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|it|nl|eu|ch|at|be|pt|mx|ar|us|ca)$"
CALLING_CODES = r"^\+ ?(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|351|352|353|358|420|421)(?![0-9])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
RESERVED_IP = r"^(?:0|127|255)\."
GIVEN_NAMES = (
    r"(?i)\b(?:adam|alan|albert|alejandro|alex|alice|amy|ana|andrea|andreas|andrew|angela|anna|anne|anthony|antoine|antonio|barbara|ben|brian|camille|carlos|carmen|catherine|charles|"
    r"chloe|christian|christine|claire|claudia|daniel|david|deborah|diana|diego|dirk|donald|edward|elena|elizabeth|emily|emma|eric|eva|fernando|francisco|françois|frank|gary|george|"
    r"hannah|hans|heike|heinz|helen|henri|henry|ines|isabel|jacques|james|jan|jane|javier|jean|jennifer|jessica|joan|joe|john|jorge|jose|josé|joseph|juan|julia|julie|jürgen|karen|karl|"
    r"kevin|klaus|laura|léa|linda|lisa|louis|lucia|luis|lukas|manuel|marc|margaret|maria|maría|marie|mark|martin|mary|matthew|michael|michel|miguel|monika|nancy|nathalie|nicole|olivier|"
    r"pablo|patricia|paul|pedro|peter|philippe|pierre|rachel|ralf|raquel|rebecca|richard|robert|ronald|rosa|ruth|sabine|samuel|sandra|sara|sarah|sergio|sofia|sophie|stefan|stephen|steven|"
    r"susan|susanne|teresa|thomas|ursula|uwe|victor|walter|werner|william|wolfgang|yves)\b"
)
SPEAKS_FOR = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|credit|payment|host|address|ssn|iban|account|name|write to|signed|kontakt|telefon|correo|courriel)\W{0,4}(?:\w+\W{1,3}){0,2}$"
SPEAKS_AGAINST = r"(?i)(?:version|release|isbn|doi|order|invoice|token|secret|commit|sha|checksum|page|figure|section|build|part no)\W{0,6}$"


def _spans(text: Column, quick: str, pattern: str, of: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """``of(match, start, end, text before, text after)`` for every match; positions in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("g"), F.get(gaps, i + 1).alias("after")))

    def place(x: Column) -> Column:
        zero = F.lit(0).cast("long")
        total = lambda a, c: a + F.char_length(c["g"]) + F.char_length(c["m"])
        # Sums of blocks, then sums of the blocks before, then positions inside a block.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, total))

        def inside(b: Column, k: Column) -> Column:
            base = F.aggregate(F.slice(sums, F.lit(1), k), zero, lambda a, c: a + c)

            def one(c: Column, i: Column) -> Column:
                start = base + F.aggregate(F.slice(b, F.lit(1), i), zero, total) + F.char_length(c["g"])
                return of(c["m"], start, start + F.char_length(c["m"]), c["g"], c["after"])

            return F.transform(b, one)

        return F.flatten(F.transform(blocks, inside))

    # The inner array is bound once, as the single element of an array, so the patterns run once.
    bound = F.transform(F.array(both), lambda x: F.when(F.size(x) > 0, place(x)))
    return F.when(text.rlike(quick), F.get(bound, F.lit(0)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum holds: every second digit from the right is doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _iban(m: Column) -> Column:
    """Whether the number, its first four characters last and letters as 10 to 35, leaves 1 when divided by 97."""
    turned = F.concat(F.substring(m, F.lit(5), F.char_length(m)), F.left(m, F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), rest * 10 + c.try_cast("int")).otherwise(rest * 100 + F.ascii(c) - 55)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _strict(kind: str, m: Column) -> Column:
    """Whether the match holds the rule of its kind; of the base kinds, the base rule."""
    n = F.char_length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "email_spelled":
        return m.rlike(r"(?:[\])] ?|\.)[A-Za-z]{2,10}$")
    if kind == "phone_local":
        return m.rlike(r"^(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}[ .-])[2-9][0-9]{2}")
    if kind == "national_id":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return _iban(m)
    return m.rlike(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$")  # a title and two names


def _known(kind: str, m: Column) -> Column:
    """The gazetteers' vote."""
    yes = {
        "email": m.rlike(DOMAINS),
        "email_spelled": m.rlike(r"(?i)(?:dot[\])] ?|\.)(?:com|org|net|edu|de|fr|es|uk)$"),
        "ip": ~m.rlike(RESERVED_IP),
        "card": _digits(m).rlike(ISSUERS) & F.char_length(_digits(m)).between(15, 19),
        "phone": m.rlike(CALLING_CODES),
        "phone_local": m.rlike(r"^\(?[2-9]"),
        "national_id": ~m.rlike(r"^(?:123-45-6789|078-05-1120|219-09-9999)$|^([0-9])\1\1-"),
        "iban": m.rlike(r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"),
        "person": m.rlike(GIVEN_NAMES),
    }[kind]
    no = {"person": 0, "email": -1}.get(kind, -1)
    return F.when(yes, 1).otherwise(no)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the spans that any pattern proposes, with votes and shape."""
    text = F.col("whole")

    def described(kind: int) -> Callable[[Column, Column, Column, Column, Column], Column]:
        def of(m: Column, start: Column, end: Column, before: Column, after: Column) -> Column:
            name = KINDS[kind]
            near = F.right(before, F.lit(40))
            holds = _strict(name, m)
            alone = ~(F.right(before, F.lit(1)).rlike(r"[\p{L}0-9]") | F.left(after, F.lit(1)).rlike(r"[\p{L}0-9]"))
            return F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                end.alias("end"),
                (holds & F.lit(name in BASE)).alias("base"),
                F.when(holds, 1).otherwise(-1).alias("v0"),
                _known(name, m).alias("v1"),
                F.when(near.rlike(SPEAKS_AGAINST), -1).when(near.rlike(SPEAKS_FOR), 1).otherwise(0).alias("v2"),
                F.when(alone, 1).otherwise(-1).alias("v3"),
                F.least(F.lit(4), F.floor(F.char_length(m) / 6)).cast("int").alias("size"),
                F.floor(3 * F.char_length(_digits(m)) / F.char_length(m)).cast("int").alias("digits"),
            )

        return of

    # A long run of digits is no card at all; only matches near a card's length are put to the vote.
    spans = []
    for k, (name, quick, pattern) in enumerate(PATTERNS):
        found = _spans(text, quick, pattern, described(k))
        spans.append(F.coalesce(F.filter(found, lambda s: s["size"] >= 2) if name == "card" else found, F.array()))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole")).select("doc_id", F.concat(*spans).alias("spans"))


VOTES = ("v0", "v1", "v2", "v3")


def reliabilities(kind: np.ndarray, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that each vote pattern marks personal data, by expectation-maximisation per kind."""
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    for k in np.unique(kind):
        own = kind == k
        v, n, q = votes[own] + 1, counts[own], p[own]
        for _ in range(ROUNDS):
            prior = (n @ q + 2) / (n.sum() + 3)  # proposals are more often right than not
            log_odds = np.full(len(q), np.log(prior / (1 - prior)))
            for j in range(v.shape[1]):
                yes = np.bincount(v[:, j], n * q, 3) + [0.5, 1, 2]
                no = np.bincount(v[:, j], n * (1 - q), 3) + [2, 1, 0.5]
                log_odds += np.log(yes / yes.sum())[v[:, j]] - np.log(no / no.sum())[v[:, j]]
            q = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        p[own] = q
    return p


def classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps on aggregated rows, lightly regularised."""
    w, n = np.zeros(features.shape[1]), counts / max(counts.sum(), 1)
    ridge = 1e-3 * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (n * (p - target)) + ridge @ w
        w -= np.linalg.solve((features.T * (n * np.maximum(p * (1 - p), 1e-4))) @ features + ridge, gradient)
    return w


def _row(kind: int, votes: tuple[int, ...], size: int, digits: int) -> list[float]:
    one_hot = [float(kind == k) for k in range(len(KINDS))]
    signs = [float(v == s) for v in votes for s in (-1, 1)]
    return one_hot + signs + [float(size == i) for i in range(1, 5)] + [float(digits == i) for i in range(1, 4)]


def trained(spans: DataFrame) -> dict[tuple[int, ...], float]:
    """Score of each (kind, votes, size, digits): the classifier over every row that can occur here."""
    shape = ("kind", *VOTES, "size", "digits")
    rows = spans.select(F.explode("spans").alias("s")).groupBy(*(F.col(f"s.{c}").alias(c) for c in shape)).agg(F.count("*").alias("n")).orderBy(*shape).collect()
    if not rows:
        return {}
    kind, votes = np.array([r["kind"] for r in rows]), np.array([[r[v] for v in VOTES] for r in rows])
    counts = np.array([r["n"] for r in rows], float)
    # Reliabilities look at votes alone; equal patterns share them whatever their shape.
    target = reliabilities(kind, votes, counts)
    features = np.array([_row(r["kind"], tuple(r[v] for v in VOTES), r["size"], r["digits"]) for r in rows])
    score = 1 / (1 + np.exp(-features @ classifier(features, target, counts)))
    return {tuple(r[c] for c in shape): float(s) for r, s in zip(rows, score, strict=True)}


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: kind, start, end, base, of base spans and of those the classifier adds."""
    found = staged(candidates(docs))
    added = [k for k, s in trained(found).items() if s >= THRESHOLD]
    code = lambda s: F.concat_ws("/", s["kind"], *(s[v] for v in VOTES), s["size"], s["digits"])
    keep = F.split(F.lit(",".join("/".join(map(str, k)) for k in sorted(added))), ",")  # bounded by kinds, votes and shapes
    chosen = F.filter("spans", lambda s: s["base"] | F.array_contains(keep, code(s)))
    return found.select("doc_id", F.array_sort(F.transform(chosen, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))).alias("spans"))


def masked(docs: DataFrame, marker: str = "[{}]") -> DataFrame:
    """The documents with every span replaced by its kind; overlapping spans give way to the first. Spans are found once for each text."""
    key = F.sha2(docs["text"].cast("binary"), 256)
    spans = personal_spans(docs.select(key.alias("doc_id"), "text").where("doc_id is not null").dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("_span_id"), F.col("spans").alias("_spans"))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(marker.format(k)) for k in KINDS))
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def cut(a: Column, s: Column) -> Column:
        head = F.substring(docs["text"], (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["text"], head, F.get(names, s["kind"])).alias("text"), s["end"].alias("at")))

    joined = docs.join(spans, key == F.col("_span_id"), "left").withColumn("_cut", F.aggregate(ordered, empty, cut))
    tail = F.substring(docs["text"], (F.col("_cut.at") + 1).cast("int"), F.char_length(docs["text"]))
    return joined.withColumn("text", F.when(F.size("_spans") > 0, F.concat("_cut.text", tail)).otherwise(docs["text"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return personal_spans(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
