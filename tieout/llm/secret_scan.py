"""Secrets in whole texts, found by patterns and by the entropy of sliding windows. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The patterns of the base kinds. Group 2 of ASSIGN is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs AKIA[A-Z0-9]+ of 20 characters or more; a shorter run has no longer one inside
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

#: A candidate string is a maximal run of these.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits of a window, for candidates of hexadecimal digits alone and for others.
HEX_BITS, MIXED_BITS = 3.0, 3.8
#: A part with a capital: two small letters at least, or a short word. A word: such parts, small letters, capitals with
#: an ending, or one letter.
#: All repeats are possessive: java.util.regex backtracks into a group by recursion.
_H = r"[A-Z](?:[a-z]{2,}+|(?<=[ABDIMNOTU])[bdfmnopsty])"
_W = rf"(?:(?:[a-z]{{2,}}+)?+(?:{_H})++|[a-z]{{2,}}+|[A-Z]{{2,}}+[a-z]*+|[A-Za-z])"
#: Whole candidates, and whole spans, that are no secrets: numbers, UUIDs, dates and times, words joined by marks or
#: capitals (a date may stand before them), stand-ins. Nothing beside these may stand in the same string.
ALLOWED = (
    r"^[0-9_=+/-]+$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9TZ_+-]*$"
    rf"|^(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?=[/_=+-]))?[/_=+-]*+(?:{_W}[/_=+-]++)++{_W}?+[0-9]{{0,4}}+$"
    rf"|^(?:[a-z]{{2,}}+)?+(?:{_H})++[0-9]{{0,4}}+$"
    r"|(?i:^(?:example|sample|dummy|placeholder|changeme|redacted|0123456789|abcdefgh(?:ijklmnopqrstuvwxyz)?+|x{6,}+|(?<![a-z])(?:access|api|key|token|secret|password|value|your|my|test|id)(?![a-z])|[0-9]{1,4}(?![0-9])|[/_=+-])++$)"
)
#: Parts of a bit to which c * log2(c) is rounded, so that sums don't depend on their order.
SCALE = 1_000_000

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, matches: Column, gaps: Column, kind: int, keep=lambda i: F.lit(True)) -> Column:
    """Spans of matches, gaps being the text split at them; keep(i) tells whether the i-th counts."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc, i):
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(matches, i))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(i), F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda acc: acc["found"])
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPAN))


def _entropy_spans(word: Column, start: Column) -> Column:
    """Spans of word, a candidate that begins at start, where a window's entropy is high enough.

    counts holds how often each symbol is in the window, and sum the window's sum of c * log2(c). A step
    adds one symbol and takes one away: two counts change, and so do their two terms of the sum. The
    entropy of a full window is log2(WINDOW) - sum / WINDOW. The candidate is split once, and a step carries
    the counts, the sum, the open span and the closed ones, not the candidate; its symbols are
    at most 66, so the work grows with the candidate's length alone.
    """
    return let(F.split(word, ""), lambda chars: let(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("symbols"), word.rlike("^[0-9a-fA-F]+$").alias("hex")), lambda w: _walked(w, start)))


def _walked(w: Column, start: Column) -> Column:
    terms = F.array(*[F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(WINDOW + 2)])
    limits = [math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits)) for bits in (HEX_BITS, MIXED_BITS)]
    most = F.when(w["hex"], F.lit(limits[0])).otherwise(F.lit(limits[1])).cast("long")
    kind = F.when(w["hex"], KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_mixed")).cast("int")
    code = lambda c: (F.array_position(w["symbols"], c) - 1).cast("int")
    chars = w["chars"]
    none = F.lit(-1)
    # a step for each character: the code that comes, the one that goes and the place
    steps = F.transform(chars, lambda c, i: F.struct(code(c).alias("x"), F.when(i >= WINDOW, code(F.get(chars, i - WINDOW))).otherwise(none).alias("y"), i.alias("i")))
    zero = F.struct(F.transform(w["symbols"], lambda _: F.lit(0)).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("from"), none.alias("to"), F.array().cast(SPAN).alias("found"))
    span = lambda acc: F.struct(acc["from"].alias("start"), kind.alias("kind"), acc["to"].alias("end"))
    closed = lambda acc: F.when(acc["from"] >= 0, F.array_append(acc["found"], span(acc))).otherwise(acc["found"])

    def step(acc, s):
        x, y = s["x"], s["y"]
        come = F.get(acc["counts"], x)
        go = F.when(y >= 0, F.get(acc["counts"], y) + F.when(x == y, 1).otherwise(0)).otherwise(0)
        total = acc["sum"] + F.get(terms, come + 1) - F.get(terms, come) + F.when(go > 0, F.get(terms, go - 1) - F.get(terms, go)).otherwise(F.lit(0).cast("long"))
        counts = F.when(x == y, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: F.when(k == x, c + 1).when(k == y, c - 1).otherwise(c)))
        end = start + s["i"] + 1

        def with_total(t):
            fits = (s["i"] >= WINDOW - 1) & (t <= most)
            grows = fits & (acc["from"] >= 0) & (acc["to"] >= end - WINDOW)
            return F.struct(
                counts.alias("counts"), t.alias("sum"), F.when(fits & ~grows, end - WINDOW).otherwise(acc["from"]).alias("from"), F.when(fits, end).otherwise(acc["to"]).alias("to"),
                F.when(fits & ~grows, closed(acc)).otherwise(acc["found"]).alias("found"),
            )

        return let(total, with_total)

    return F.aggregate(steps, zero, step, closed)


def _left(span: Column, base: Column) -> Column:
    """What is left of span without the spans of base, which are sorted."""
    zero = F.struct(span["start"].alias("at"), F.array().cast(SPAN).alias("found"), span["end"].alias("end"), span["kind"].alias("kind"))

    def piece(acc, end):
        return F.when(acc["at"] < end, F.array_append(acc["found"], F.struct(acc["at"].alias("start"), acc["kind"].alias("kind"), end.alias("end")))).otherwise(acc["found"])

    def step(acc, b):
        found = piece(acc, F.least(b["start"], acc["end"]))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), found.alias("found"), acc["end"].alias("end"), acc["kind"].alias("kind"))

    return F.aggregate(base, zero, step, lambda acc: piece(acc, acc["end"]))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _base and _spans, arrays of (start, kind, end) in code points, sorted; every other column stays.

    _base are the leftmost non-overlapping matches of each base kind that are long enough; _spans adds
    what is left of the entropy spans without them. Neither a candidate nor a part that is left counts
    where all of it is allowed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = ("_assign", "_value", "_access", "_hex", "_words")
    df = docs.select(
        "*",
        F.regexp_extract_all(text, F.lit(ASSIGN), 0).alias("_assign"),
        F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(ACCESS), 0)).otherwise(F.array().cast("array<string>")).alias("_access"),
        F.regexp_extract_all(text, F.lit(HEX), 0).alias("_hex"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("_words"),
    )
    df = df.withColumn("_value", F.when(F.size("_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), 2)).otherwise(F.array().cast("array<string>")))

    def gaps(matches: str, pattern: str) -> Column:
        return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))

    df = df.select(
        "*",
        F.sort_array(
            F.concat(
                _spans(text, F.col("_assign"), gaps("_assign", ASSIGN), 0, lambda i: F.length(F.get("_value", i)) >= ASSIGN_VALUE),
                _spans(text, F.col("_access"), gaps("_access", ACCESS), 1),
                _spans(text, F.col("_hex"), gaps("_hex", HEX), 2),
            )
        ).alias("_base"),
        _spans(text, F.col("_words"), gaps("_words", CANDIDATE), 3).alias("_at"),
    )
    asked = F.filter(F.arrays_zip(F.col("_words").alias("word"), F.col("_at").alias("at")), lambda c: ~c["word"].rlike(ALLOWED))
    extra = F.flatten(F.transform(asked, lambda c: _entropy_spans(c["word"], c["at"]["start"])))
    left = F.when(F.size("_base") > 0, F.flatten(F.transform(extra, lambda s: _left(s, F.col("_base"))))).otherwise(extra)
    left = F.filter(left, lambda s: ~F.substr(text, s["start"] + 1, s["end"] - s["start"]).rlike(ALLOWED))
    extra = F.when(F.size("_words") > 0, left).otherwise(F.array().cast(SPAN))
    return df.withColumn("_spans", F.sort_array(F.concat(F.col("_base"), extra))).drop(*own, "_at")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): one row for each row of docs, no shuffle.

    n_* count the base spans of a kind. base_sha256 is of the base spans, spans lists all, each as
    kind:start:end by start and then kind, comma-joined, in code points with the end left out. A null or
    empty text has none; texts of any length are searched whole; repeated rows and null ids each keep
    their row; other columns are ignored; an empty table gives an empty result.
    """
    df = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return df.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """docs with each secret of its texts replaced by mark; overlapping spans become one mark.

    length_col, where there is such a column, follows the new text; rows without a secret stay as they
    are, null texts too. Every row and column stays.
    """
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        new = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    whole = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    df = with_spans(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text")))
    df = df.select("_row", "_spans", F.when(F.size("_spans") > 0, whole).alias("new"))
    row = F.col("_row").withField(f"`{text_col}`", F.col("new"))
    if length_col in docs.columns:
        row = row.withField(f"`{length_col}`", F.length("new").cast(docs.schema[length_col].dataType))
    return df.select(F.when(F.size("_spans") > 0, row).otherwise(F.col("_row")).alias("_row")).select("_row.*")
