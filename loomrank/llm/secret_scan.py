"""Secret scans in DataFrame functions only: base patterns, and sliding-window entropy over candidate strings.

Candidates are maximal runs of the Base64 and file-name alphabet of CANDIDATE characters or more that hold a digit.
Each belongs to a character class (hexadecimal or mixed), with its own alphabet and threshold. A window of WINDOW
characters slides over it; counts by character, packed into a few numbers, and the sum of n log2 n are kept up as one
character enters and one leaves, so a step costs the same at any position, and the largest entropy of a window decides. Candidates that an
allow-list pattern matches (UUIDs, runs of one or consecutive characters, URLs' path words, placeholders) are
suppressed, as are those that a base span already covers.

Spans are (kind, start, end) in code points, end exclusive. Positions come from searching each match in order from
the end of the one before: no pattern looks around, so the first place that holds the match's text is the match.

A text's spans are gathered and placed one after another, which takes time in proportion to the text's length times its
number of matches: nothing for prose, minutes for a text of megabytes that is all keys.

Cases: a null text counts as empty and has no spans; texts of any length are scanned whole; repeated rows and extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, whole_text

#: The base patterns, in the order that breaks ties of the start.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: The entropy scan: bits in a window of WINDOW characters from which a candidate of a class is a secret.
WINDOW, CANDIDATE = 20, 20
CANDIDATES = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 2.9), "mixed": (r".", 3.5)}

#: Allow list (fixed values): what looks random or long but is no secret.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9=/+_-]+$",
    r"(?i)example|placeholder|changeme|your[_-]?(api|key|token|secret)",
    r"(?i)0123456789|abcdefghij",
    r"^/?(([a-z]+[0-9]{0,4}|[0-9]+)[/_-])*([a-z]+[0-9]{0,4}|[0-9]+)/?$",
)
#: What every span holds: most texts are ruled out by one pass.
_TRACE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_=-]{20}"


def _spans(text: Column, matches: Column, kind: int, ok=None) -> Column:
    """Matches (in order, not overlapping) as (start, kind, end, text)."""

    def add(acc: Column, m: Column) -> Column:
        return let(
            _find(m, text, acc["end"]),
            lambda at: F.struct(
                (at + F.length(m)).alias("end"),
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("stop"), m.alias("s")
                        )
                    ),
                ).alias("found"),
            ),
        )

    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,s:string>>")
    out = F.aggregate(matches, F.struct(F.lit(0).alias("end"), empty.alias("found")), add, lambda a: a["found"])
    return F.filter(out, ok) if ok else out


def _find(m: Column, text: Column, start: Column) -> Column:
    """The first position (from 0) of m in text at or after start."""
    return F.call_function("locate", m, text, start + 1) - 1


def _codes(s: Column) -> Column:
    """A candidate's characters as numbers below 66."""
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.call_function("locate", F.substr(s, i, F.lit(1)), F.lit(alphabet)) - 1)


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of a window of s; counts go up and down by one a step.

    The counts of all characters are packed into a few numbers, so that a step changes two fields.
    """
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    width = window.bit_length()
    each = 63 // width
    slots = -(-67 // each)
    slot = lambda c: F.floor(c / each).cast("int")
    shift = lambda c: ((c % each) * width).cast("int")
    one_in = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    none = F.lit(0).cast("long")

    def step(codes: Column):
        def one(acc: Column, i: Column) -> Column:
            entering, leaving = F.get(codes, i), F.get(codes, i - window)

            def count(c: Column) -> Column:
                field = F.call_function("shiftright", F.get(acc["counts"], slot(c)), shift(c))
                return field.bitwiseAND((1 << width) - 1)

            moved = F.transform(
                acc["counts"],
                lambda n, k: n
                + F.when(k == slot(entering), one_in(entering)).otherwise(none)
                - F.when(k == slot(leaving), one_in(leaving)).otherwise(none),
            )
            n_in, n_out = count(entering), count(leaving)
            grown = (
                F.when(entering.eqNullSafe(leaving), F.lit(0.0))
                .when(leaving.isNull(), term(n_in + 1) - term(n_in))
                .otherwise(term(n_in + 1) - term(n_in) + term(n_out - 1) - term(n_out))
            )
            return let(
                acc["sum"] + grown,
                lambda total: F.struct(
                    moved.alias("counts"),
                    total.alias("sum"),
                    F.when(i < window - 1, acc["best"])
                    .otherwise(F.greatest(acc["best"], F.log2(F.lit(float(window))) - total / window))
                    .alias("best"),
                ),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            F.struct(F.array_repeat(none, slots).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")),
            one,
            lambda a: a["best"],
        )

    return let(_codes(s), step)


def _entropic(s: Column) -> Column:
    """Whether a candidate is a secret by its class's threshold and no allow-list pattern matches it."""
    out = F.lit(False)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    bits = max_window_entropy(s)
    decided = None
    for pattern, least in CLASSES.values():
        decided = F.when(s.rlike(pattern), bits >= least) if decided is None else decided.when(s.rlike(pattern), bits >= least)
    return F.when(~s.rlike("[0-9]") | ~s.rlike("[A-Za-z]") | allowed, out).otherwise(decided)


def secret_spans(text: Column) -> Column:
    """All spans of a text as array<struct<start, kind, stop, s>>, by start, then kind as in KINDS."""

    def scan(t: Column) -> Column:
        every = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        value = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 8
        base = F.concat(
            _spans(t, every(ASSIGN), 0, value), _spans(t, every(ACCESS), 1), _spans(t, every(HEX), 2)
        )

        def more(found: Column) -> Column:
            def new(x: Column) -> Column:
                inside = F.exists(found, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
                return F.when(inside, False).otherwise(_entropic(x["s"]))

            return F.sort_array(F.concat(found, _spans(t, every(CANDIDATES), 3, new)))

        return let(base, more)

    none = F.array().cast("array<struct<start:int,kind:int,stop:int,s:string>>")
    return F.when(text.rlike(_TRACE), let(text, scan)).otherwise(none)


def scan_secrets(docs: DataFrame, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """docs with its secrets' spans as array<struct<start, kind, stop, s>> (s: the text found)."""
    return docs.withColumn(into, secret_spans(whole_text(text_col)))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mask; overlapping spans become one. A text without spans stays as it is."""
    name = free_name(docs, "spans")
    spans = F.col(name)
    text = whole_text(text_col)

    def cut(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["end"]
        return F.struct(
            F.greatest(acc["end"], x["stop"]).alias("end"),
            F.when(fresh, F.concat(acc["out"], F.substr(text, acc["end"] + 1, x["start"] - acc["end"]), F.lit(mask)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    masked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit("").alias("out")),
        cut,
        lambda a: F.concat(a["out"], F.substr(text, a["end"] + 1, F.length(text))),
    )
    return (
        docs.withColumn(name, secret_spans(text))
        .withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(F.col(text_col)))
        .drop(name)
    )


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    kind = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"], x["stop"])), ","
    )
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(shown(F.filter("secret_spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        shown(F.col("secret_spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )
