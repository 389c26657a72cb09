"""Personal data: candidate spans scored by gradient-boosted trees, on top of fixed formats.

Only DataFrame functions run on the data. What the fixed formats find is masked; in the rest of a text,
high-recall generators, one for each kind, propose spans that may overlap: addresses whose at sign or
dots are spaced, bracketed or written out, dotted addresses, cards and phone numbers with other
separators or without a plus. Each candidate has format features (digits, groups, separators, Luhn sum,
octets) and context features (neighbouring characters, words that announce such data).

The generators' repeats end where the formats' standards do: 64 octets before an at sign hold at most 31 dots, 255 after it
126, and 15 digits of a phone number with two separators each take 43 characters.

The trees learn without labels. Every span of a fixed format is written in each of some other ways
(``VARIANTS``), in its own context: positives. Beside them stand spoilt copies (``SPOILT``: a wrong Luhn sum, a
part above 255, too few digits, no dot): negatives. So that a kind of which a table has few spans is learned as well,
``PRIMER`` adds made-up sentences with plain spans of each kind, whatever the table. A negative, too, is each
candidate of the texts, unless undoing the disguise gives a valid address, dotted address, card or
phone number with a country's prefix; those are left out of training. One aggregate counts each combination of features by label, separately for
two halves of the documents, so what is learned from is bounded by the features' values however large
the table is. Shallow trees are boosted on the counts of one half; the other half sets each kind's
threshold, the lowest score above which at least ``PRECISION`` of the examples are positives. A
candidate that reaches its kind's threshold is added.

Defined results: null and empty texts have no spans; an empty table gives no rows; texts are scanned whole; repeated rows repeat their spans; extra
columns are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, text_of
from .spans import MASK, bare, bound, joined, locate, masked, those

KINDS = ("email", "ip", "card", "phone")
# Fixed formats. A match starts where no earlier start could differ, so that runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# Generators, each for a kind. Nothing starts or ends beside a masked character.
_EDGE = rf"(?<![0-9A-Za-z{MASK}])"
_STOP = rf"(?![0-9A-Za-z{MASK}])"
_AT = r"(?:\x20?@\x20?|\x20?[\[({<]\x20?(?i:at)\x20?[\])}>]\x20?|\x20(?i:at)\x20|_(?i:at)_)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:(?i:dot)|\.)\x20?[\])}>]\x20?|\x20(?i:dot)\x20|_(?i:dot)_|\x20?\.\x20?)"
_WORD = r"[\p{L}\p{N}%+-]+?"
GENERATORS = (
    rf"(?<![\p{{L}}\p{{N}}._%+{MASK}-]){_WORD}(?:{_DOT}{_WORD}){{0,31}}?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{1,126}}{_STOP}",
    rf"{_EDGE}[0-9]{{1,4}}(?:(?:{_DOT}|[,:_-])[0-9]{{1,4}}){{3}}{_STOP}",
    rf"{_EDGE}[0-9]{{3,6}}(?:[\x20._/\xa0-]{{0,3}}[0-9]{{3,7}}){{2,5}}{_STOP}",
    rf"{_EDGE}(?:\+\x20)?[(]?[0-9][\x20()./0-9\xa0-]{{5,43}}[0-9]{_STOP}",
)
GUARDS = (r"@|(?i:\bat\b|_at_)", r"[0-9]", r"[0-9]{3}", r"[0-9]")
# Words that announce a kind just before it.
ANNOUNCED = tuple(rf"(?i)(?:{words})\W{{0,4}}\w{{0,12}}\W{{0,3}}$" for words in ("mail|contact|write|reach|address", "ip|host|addr|server|node", "card|visa|pay|account|credit", "tel|phone|call|fax|mobil|contact|reach"))

PRECISION = 0.95
ROUNDS, RATE, LEAST = 24, 0.4, 5.0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(back)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def good_ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.rlike(OCTET))


def good_card(hit: Column) -> Column:
    return F.when(F.length(_digits(hit)).between(16, 19), luhn(_digits(hit))).otherwise(False)


def good_phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(8, 15)


@dataclass(frozen=True)
class Feature:
    """A feature of a candidate with values from 0 to ``size - 1``."""

    name: str
    size: int
    value: object = field(compare=False)


def _bucket(n: Column, *edges: int) -> Column:
    return reduce(lambda a, e: a + F.when(n >= e, 1).otherwise(0), edges, F.lit(0))


def _side(c: Column) -> Column:
    """0 nothing or blank, 1 sign, 2 letter or digit."""
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^(?U)\w$"), 2).otherwise(1)


def _chosen(*cases: tuple[str, int]):
    """The number of the first pattern that a candidate has, or 0."""
    return lambda s: reduce(lambda rest, case: F.when(s["hit"].rlike(case[0]), case[1]).otherwise(rest), reversed(cases), F.lit(0))


def _octets(hit: Column) -> Column:
    return F.forall(F.filter(F.split(hit, "[^0-9]+"), lambda p: p != ""), lambda p: p.rlike(OCTET))


FEATURES = (
    Feature("digits", 7, lambda s: _bucket(F.length(_digits(s["hit"])), 4, 7, 8, 10, 13, 16)),
    Feature("groups", 6, lambda s: _bucket(F.size(F.split(s["hit"], "[^0-9A-Za-z]+")), 2, 3, 4, 5, 6)),
    Feature("at", 5, _chosen((r"[\[({<]\x20?(?i:at)\x20?[\])}>]", 3), (r"[\x20_](?i:at)[\x20_]", 4), (r"\x20@|@\x20", 2), ("@", 1))),
    Feature("dot", 4, _chosen((r"(?i)[^a-z]dot[^a-z]", 2), (r"\x20\.|\.\x20|[\[({<]\x20?\.", 3), (r"\.", 1))),
    Feature("tail", 3, _chosen((r"[^A-Za-z][A-Za-z]{2,6}$", 2), ("[A-Za-z]$", 1))),
    Feature("joint", 5, _chosen((r"^[0-9]+$", 0), (r"^[0-9 ]+$", 1), (r"^[0-9.]+$", 2), (r"^[0-9-]+$", 3), ("^", 4))),
    Feature("lead", 4, _chosen((r"^[(]", 1), (r"^\+", 2), ("^00", 3))),
    Feature("luhn", 2, lambda s: F.when(F.length(_digits(s["hit"])).between(16, 19), luhn(_digits(s["hit"])).cast("int")).otherwise(0)),
    Feature("octets", 2, lambda s: F.when(_octets(s["hit"]), 1).otherwise(0)),
    Feature("left", 3, lambda s: _side(F.right(s["before"], F.lit(1)))),
    Feature("right", 3, lambda s: _side(F.left(s["after"], F.lit(1)))),
    Feature("announced", 2, lambda s: F.when(reduce(lambda rest, k: F.when(s["kind"] == k, s["before"].rlike(ANNOUNCED[k])).otherwise(rest), range(len(KINDS)), F.lit(False)), 1).otherwise(0)),
)


def _undone(hit: Column) -> Column:
    """An address without its disguise."""
    return F.regexp_replace(F.regexp_replace(hit, _AT, "@"), _DOT, ".")


def _valid(kind: int, hit: Column) -> Column:
    """Whether a candidate is of its kind once the disguise is undone; a phone number only if it has a country's prefix."""
    if kind == 0:
        # "one at home. The" is a sentence; an at sign, a bracket or a written dot isn't.
        return _undone(hit).rlike(f"^{EMAIL}$") & hit.rlike(r"(?i)@|[\[({<]|[^a-z]dot[^a-z]")
    if kind == 1:
        return _octets(hit) & (F.size(F.split(hit, "[^0-9]+")) == 4)
    return good_card(hit) if kind == 2 else hit.rlike(r"^(?:00|\+)") & good_phone(hit)


def _respelt(at: str, dot: str):
    return lambda hit: F.regexp_replace(F.regexp_replace(hit, "@", at), r"\.", dot)


def _joined_by(mark: str):
    return lambda hit: F.regexp_replace(F.regexp_replace(_digits(hit), "([0-9]{4})(?=[0-9]{3})", f"$1{mark}"), r"[^0-9]+$", "")


# Other ways to write a span of each kind, and ways to spoil one.
VARIANTS = (
    (_respelt(" (at) ", " (dot) "), _respelt(" [at] ", "."), _respelt(" at ", " dot "), _respelt(" @ ", "."), _respelt("[at]", "[dot]"), _respelt("_at_", "_dot_"), _respelt("{at}", " . ")),
    (_respelt("@", "[.]"), _respelt("@", " . "), _respelt("@", " dot "), _respelt("@", "(.)"), _respelt("@", "[dot]")),
    (_joined_by("."), _joined_by("_"), _joined_by("  "), _joined_by(" - "), _joined_by("/")),
    (lambda h: F.concat(F.lit("00"), F.substr(h, F.lit(2))), lambda h: F.concat(F.lit("+ "), F.substr(h, F.lit(2))), lambda h: F.substr(h, F.lit(2)), lambda h: F.regexp_replace(F.substr(h, F.lit(2)), "[ -]", "/")),
)
SPOILT = (
    (_respelt(" at ", " "), _respelt(" @ ", " "), lambda h: F.regexp_replace(_undone(h), "@", " . ")),
    tuple(lambda h, dot=dot: F.concat(F.lit("3"), F.regexp_replace(F.regexp_replace(h, r"^[0-9]+", "99"), r"\.", dot)) for dot in ("[.]", " . ", ".", ",")),
    tuple(lambda h, mark=mark: _joined_by(mark)(F.concat(F.left(_digits(h), F.length(_digits(h)) - 1), ((F.right(_digits(h), F.lit(1)).cast("int") + 1) % 10).cast("string"))) for mark in (".", "_", "  ")),
    (lambda h: F.left(_digits(h), F.lit(7)), lambda h: F.regexp_replace(F.left(_digits(h), F.lit(8)), "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")),
)


# Made-up sentences with a plain span of each kind; k is a number.
PRIMER_ROWS = 48
PRIMER = (
    ("write to ", lambda k: F.concat(F.lit("user"), k, F.lit(".name@mail"), k % 7, F.lit(".example.org")), " today"),
    ("the server ", lambda k: F.concat_ws(".", F.lit("10"), k % 256, (k * 7) % 256, (k * 13) % 256), ", as before"),
    ("card ", lambda k: F.get(F.array(*map(F.lit, ("4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "6011 0000 0000 0004", "3530111333300000"))), k % 5), " was used"),
    ("call ", lambda k: F.concat(F.lit("+4"), k % 10, F.lit(" "), 200 + k, F.lit(" "), 5550 + k, F.lit(" "), 10 + k), " or later"),
    ("number ", lambda k: F.get(F.array(*map(F.lit, ("4111.1111.1111.1111", "4111.1111.1111.1112", "5500_0000_0000_0005", "00076871991019", "0054994038693466"))), k % 5), " is on it"),
    ("it has ", lambda k: F.concat(k, F.lit("."), k % 9, F.lit(" parts at home. The "), k % 7, F.lit(" others, page "), 100 + k), " too"),
)


def primer(spark) -> DataFrame:
    """doc_id, text: ``PRIMER_ROWS`` sentences of each kind, a fixed number."""
    k = F.col("id").cast("int")
    texts = F.array(*[F.concat(F.lit(before), made(k), F.lit(after)) for before, made, after in PRIMER])
    return spark.range(0, PRIMER_ROWS, 1, 1).select((-1 - F.col("id")).alias("doc_id"), F.explode(texts).alias("text"))


def candidates(docs: DataFrame, *further: str) -> DataFrame:
    """doc_id, base (kind, start, stop), all (candidates with features, a label and the weight 1; rewritten spans with weights below 0, which add up to -1 for each span) for (doc_id, text)."""
    df = docs.select("doc_id", text_of().alias("text"), *further)
    patterns = {"email": (EMAIL, None), "ip": (IP, good_ip), "card": (CARD, good_card), "phone": (PHONE, good_phone)}
    guards = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for name, (pattern, good) in patterns.items():
        df = locate(df, name, pattern, guards.get(name))
        if good is not None:
            df = df.withColumn(name, those(name, good))
    df = bound(df, *patterns)
    df = df.withColumn("left_", F.col("text"))
    for name, (pattern, good) in patterns.items():
        df = bound(df.withColumn("left_", F.when(F.size(name) > 0, masked(F.col("left_"), pattern, good)).otherwise(F.col("left_"))), "left_")
    near = [f"near_{name}" for name in KINDS]
    for name, pattern, guard in zip(near, GENERATORS, GUARDS, strict=True):
        df = locate(df, name, pattern, F.col("left_").rlike(guard), text="left_")

    def example(kind: int, span: Column, hit: Column, label: Column, weight: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"), hit.alias("hit"), span["before"].alias("before"), span["after"].alias("after"), label.cast("int").alias("label"), F.lit(weight).alias("weight"))

    def natural(name: str, kind: int) -> Column:
        return F.transform(name, lambda s: example(kind, s, s["hit"], F.when(_valid(kind, s["hit"]), F.lit(None)).otherwise(0), 1.0))

    def rewritten(name: str, kind: int, ways: tuple, label: int) -> Column:
        return F.flatten(F.transform(name, lambda s: F.array(*[example(kind, s, way(s["hit"]), F.lit(label), -1.0 / len(ways[kind])) for way in ways[kind]])))

    found = [natural(name, k) for k, name in enumerate(near)]
    made = [rewritten(name, k, ways, label) for ways, label in ((VARIANTS, 1), (SPOILT, 0)) for k, name in enumerate(KINDS)]
    base = F.concat(*[bare(F.col(name), k) for k, name in enumerate(KINDS)])
    df = bound(df.select("doc_id", base.alias("base"), F.concat(*found, *made).alias("all"), *further), "all")
    # Features once, for all kinds.
    described = F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["label"].alias("label"), s["weight"].alias("weight"), *[f.value(s).cast("int").alias(f.name) for f in FEATURES]))
    return df.select("doc_id", "base", described.alias("all"), *further)


@dataclass
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, and a threshold for each kind."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    limits: dict[int, float] = field(default_factory=dict)

    def margin(self, value) -> float | Column:
        """The score before the logistic link; ``value(name)`` gives a number or a column."""

        def walk(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            name, edge, low, high = tree
            return F.when(value(name) <= edge, walk(low)).otherwise(walk(high))

        return reduce(lambda a, t: a + walk(t), self.trees, F.lit(self.start))

    def margin_of(self, row: dict) -> float:
        total = self.start
        for tree in self.trees:
            while not isinstance(tree, float):
                name, edge, low, high = tree
                tree = low if row[name] <= edge else high
            total += tree
        return total


def _grow(cells: list[dict], depth: int) -> tuple | float:
    """A tree on gradients g and curvatures h, by the gain of exact splits."""
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    leaf = RATE * g / (h + 1.0)
    if not depth:
        return leaf
    best = None
    for name, size in [("kind", len(KINDS)), *((f.name, f.size) for f in FEATURES)]:
        sums = [[0.0, 0.0] for _ in range(size)]
        for c in cells:
            sums[c[name]][0] += c["g"]
            sums[c[name]][1] += c["h"]
        low_g = low_h = 0.0
        for edge in range(size - 1):
            low_g, low_h = low_g + sums[edge][0], low_h + sums[edge][1]
            if min(low_h, h - low_h) <= 1e-9:
                continue
            gain = low_g**2 / (low_h + 1) + (g - low_g) ** 2 / (h - low_h + 1) - g**2 / (h + 1)
            if best is None or gain > best[0] + 1e-12:
                best = gain, name, edge
    if best is None or best[0] < 1e-6:
        return leaf
    _, name, edge = best
    return name, edge, _grow([c for c in cells if c[name] <= edge], depth - 1), _grow([c for c in cells if c[name] > edge], depth - 1)


def train(near: DataFrame) -> Model:
    """Boosts on the counts of all examples; their table has one row for each combination of features."""
    names = ["kind", *(f.name for f in FEATURES)]
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    flat = near.select(half.alias("half"), F.explode("all").alias("c")).select("half", "c.*").where("label IS NOT NULL")
    # All ways to write a span count as one; in 420ths, so that sums don't depend on their order.
    many = F.round(F.abs("weight") * 420).cast("long")
    of = lambda k, what: F.sum(F.when(F.col("half") == k, what).otherwise(0))
    rows = flat.groupBy(*names).agg(of(0, many).alias("n0"), of(0, many * F.col("label")).alias("y0"), of(1, many).alias("n1"), of(1, many * F.col("label")).alias("y1")).collect()  # bounded by the features' values
    cells = sorted((r.asDict() | {k: r[k] / 420 for k in ("n0", "y0", "n1", "y1")} for r in rows), key=lambda c: [c[n] for n in names])
    n, y = sum(c["n0"] for c in cells), sum(c["y0"] for c in cells)
    if not n:
        return Model()
    model = Model(start=math.log((y + 1) / (n - y + 1)))
    learn = [c | {"m": model.start} for c in cells if c["n0"]]
    for _ in range(ROUNDS):
        for c in learn:
            p = 1 / (1 + math.exp(-c["m"]))
            c["g"], c["h"] = c["y0"] - c["n0"] * p, c["n0"] * p * (1 - p)
        tree = _grow(learn, 3)
        model.trees.append(tree)
        one = Model(trees=[tree])
        for c in learn:
            c["m"] += one.margin_of(c)
    for kind in range(len(KINDS)):
        held = sorted(((model.margin_of(c), c["n1"], c["y1"]) for c in cells if c["kind"] == kind and c["n1"]), reverse=True)
        seen = right = 0
        for k, (m, many, yes) in enumerate(held):
            seen, right = seen + many, right + yes
            last = k + 1 == len(held) or held[k + 1][0] < m
            if last and right >= LEAST and (right + 1) / (seen + 2) >= PRECISION:
                model.limits[kind] = m
    return model


def select(near: DataFrame, model: Model) -> DataFrame:
    """Adds ``spans``: the base, and the candidates whose score reaches the threshold of their kind."""

    def wanted(c: Column) -> Column:
        if not model.limits:
            return F.lit(False)
        limits = F.array(*[F.lit(model.limits.get(k, math.inf) - 1e-9) for k in range(len(KINDS))])
        return model.margin(lambda name: c[name]) >= F.get(limits, c["kind"])

    added = F.transform(F.filter("all", lambda c: (c["weight"] > 0) & wanted(c)), lambda c: F.struct(c["kind"], c["start"], c["stop"]))
    return near.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans (kind, start, stop) for every row of ``docs`` (doc_id, text); learns from all of them."""
    keep = Tables(docs.sparkSession)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # The primer goes through the same plan, told apart by a flag.
    both = held.withColumn("primer", F.lit(False)).unionByName(primer(docs.sparkSession).withColumn("primer", F.lit(True)))
    near = keep(candidates(both, "primer"), "near")
    found = keep(select(near.where("NOT primer"), train(near)), "spans")
    keep.drop("near")
    return found


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[n(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"),
    )
