"""Secret scans: fixed formats, and sliding-window Shannon entropy over candidate strings.

Everything is DataFrame functions. What the formats find is masked, one format after another, and
candidates are the unbroken runs of ``RUN`` token characters or more of what is left, so each part of
a run that a format cuts is a candidate of its own. For each, a window of ``WINDOW`` characters slides
along; the counts of its characters change by one character in and one out, and so does the sum of
c * log2(c), from which the window's entropy follows. The counts lie ``PACKED`` to a number, ``BITS``
bits each, so that a step costs the same however long the run is. Windows that touch something on the allow-list
(placeholders, alphabets, paths of lower-case words) aren't scored, all others are: the allow-list
cuts a part into pieces. The limit depends on the piece's character class: hexadecimal, digits and
letters, or the base-64 alphabet; pieces without a digit, which may be words, have higher limits of their own, by
whether their letters are of one case. A part with a window above the limit is a secret as a whole.

Defined results: null and empty texts have no spans; texts are scanned whole, whatever their length;
repeated rows repeat their spans; extra columns are dropped by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .spans import bare, bound, joined, locate, masked, those

KINDS = ("assign", "access", "hex", "entropy")
# Fixed formats.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]++"
FORMATS = (
    (ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6),
    (ACCESS, lambda h: F.length(h) >= 20),
    (HEX, lambda h: F.length(h) >= 24),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

RUN, WINDOW = 20, 20
MASKS = "\x01\x02\x03\x04\x05\x06"
HEX_ALPHABET = "0123456789abcdef"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LIMITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7, "case": 3.9, "letters": 4.0}  # bits a character
WORDS = r"(?i:example|placeholder|changeme|dummy|sample|lorem|x{6,}+|0{8,}+|1{8,}+|0123456|1234567|abcdefg)"
PATH = r"(?:^|(?<=/))[a-z]{2,}+(?:/[a-z]{2,}+(?=/|$))++/?"
ALLOWED = f"{WORDS}|{PATH}"

PACKED, BITS = 12, 5
PLOG = [n * math.log2(n) if n > 1 else 0.0 for n in range(WINDOW + 2)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def max_entropy(run: Column, alphabet: str) -> Column:
    """The largest entropy of a window of the run, in bits a character, from counts kept as it slides."""
    shift = lambda way, a, by: F.call_function(f"shift{way}", a, by)
    plog = lambda n: F.get(F.array(*[F.lit(x) for x in PLOG]), n)

    def slot(c: Column) -> Column:
        return _let(F.instr(F.lit(alphabet), c) - 1, lambda k: F.struct(F.floor(k / PACKED).cast("int").alias("word"), (k % PACKED * BITS).cast("int").alias("shift")))

    def step(slots: Column, state: Column, i: Column) -> Column:
        entering, leaving = F.get(slots, i), F.get(slots, i - WINDOW)  # null before the window is full
        many = lambda s: shift("right", F.get(state["counts"], s["word"]), s["shift"]).bitwiseAND(2**BITS - 1).cast("int")
        one = lambda s: shift("left", F.lit(1).cast("long"), s["shift"])
        n_in = many(entering)
        # The count that leaves is taken after the entering one has been added.
        n_out = many(leaving) + F.when(leaving == entering, 1).otherwise(0)
        grown = state["plogs"] - plog(n_in) + plog(n_in + 1)
        plogs = F.when(i >= WINDOW, grown - plog(n_out) + plog(n_out - 1)).otherwise(grown)
        moved = lambda v, j: v + F.when(j == entering["word"], one(entering)).otherwise(0) - F.when(j == leaving["word"], one(leaving)).otherwise(0)
        return _let(plogs, lambda p: F.struct(
            F.transform(state["counts"], moved).alias("counts"), p.alias("plogs"),
            F.when(i >= WINDOW - 1, F.greatest(state["best"], F.log2(F.lit(float(WINDOW))) - p / WINDOW)).otherwise(state["best"]).alias("best"),
        ))

    words = -(-len(alphabet) // PACKED)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("plogs"), F.lit(0.0).alias("best"))
    along = lambda slots: F.aggregate(F.sequence(F.lit(0), F.size(slots) - 1), zero, lambda state, i: step(slots, state, i), lambda s: s["best"])
    return _let(F.transform(F.split(run, ""), slot), along)


def _scored(piece: Column) -> Column:
    """Whether the entropy of a piece's windows exceeds the limit of its character class."""
    of_hex, of_alnum = piece.rlike("^[0-9a-f]+$"), piece.rlike("^[A-Za-z0-9]+$")
    of_words = F.when(piece.rlike("^(?:[^A-Z]+|[^a-z]+)$"), LIMITS["case"]).otherwise(LIMITS["letters"])
    limit = F.when(~piece.rlike("[0-9]"), of_words).when(of_alnum, LIMITS["alnum"]).otherwise(LIMITS["base64"])
    return F.when(of_hex & piece.rlike("[0-9]"), max_entropy(piece, HEX_ALPHABET) >= LIMITS["hex"]).otherwise(max_entropy(piece, ALPHABET) >= limit)


def is_secret(part: Column) -> Column:
    """Whether a window of a candidate that nothing on the allow-list touches has too much entropy."""
    pieces = F.filter(F.split(part, ALLOWED, -1), lambda p: F.char_length(p) >= WINDOW)
    return F.exists(pieces, _scored)


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``spans`` (kind, start, stop) to rows that have a text column named ``text``, without nulls."""
    df = locate(docs, "assign_", ASSIGN)
    df = locate(df, "access_", ACCESS, F.contains("text", F.lit("AKIA")))
    df = locate(df, "hex_", HEX, F.col("text").rlike("[0-9a-f]{24}"))
    base = F.concat(*[bare(those(name, wanted), k) for k, (name, (_, wanted)) in enumerate(zip(("assign_", "access_", "hex_"), FORMATS, strict=True))])
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["stop"]))), lambda s: F.struct(s["kind"], s["start"], s["stop"]))
    df = bound(df.withColumn("base", order(base)), "base")
    # Only a text that can have a candidate is masked.
    df = df.withColumn("left_", F.when(F.col("text").rlike(CANDIDATE), F.col("text")).otherwise(F.lit("")))
    for pattern, wanted in FORMATS:
        df = df.withColumn("left_", F.when(F.size("base") > 0, masked(F.col("left_"), pattern, wanted)).otherwise(F.col("left_")))
        df = bound(df, "left_")
    df = locate(df, "run_", CANDIDATE, text="left_")
    added = bare(F.filter("run_", lambda s: is_secret(s["hit"])), 3)
    df = df.withColumn("spans", F.when(F.size("run_") > 0, order(F.concat("base", added))).otherwise(F.col("base")))
    return bound(df, "spans").drop("assign_", "access_", "hex_", "left_", "run_")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans for every row of ``docs`` (doc_id, text)."""
    return with_spans(docs.select("doc_id", text_of().alias("text"))).select("doc_id", "base", "spans")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every found secret in ``text`` replaced; rows without one stay as they are.

    The spans that ``find`` gives are masked by a character that the text doesn't have, one of six; a
    text that has all six loses its runs of the last one to the mark too.
    """
    names = docs.columns
    mask = F.lit(MASKS[-1])
    for c in reversed(MASKS[:-1]):
        mask = F.when(~F.contains("text", F.lit(c)), F.lit(c)).otherwise(mask)
    df = docs.withColumn("__kept", F.struct(*names)).select(text_of().alias("text"), "__kept").withColumn("__mask", mask).withColumn("__left", F.col("text"))
    for pattern, wanted in (*FORMATS, (CANDIDATE, is_secret)):
        df = bound(df.withColumn("__left", masked(F.col("__left"), pattern, wanted, F.col("__mask"))), "__left")
    marked = F.regexp_replace("__left", F.concat("__mask", F.lit("+")), F.lit(mark.replace("\\", r"\\").replace("$", r"\$")))
    out = df.withColumn("__text", F.when(F.col("__left") != F.col("text"), marked).otherwise(F.col("__kept")["text"]))
    return out.select(*[F.col("__text").alias(n) if n == "text" else F.col("__kept")[n].alias(n) for n in names])


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"),
    )
