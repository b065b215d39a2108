"""Secret scan with multipart credential linking.

Strong patterns (keyword assignments, access identifiers, long hex runs) are
reported wherever they occur.  Weak parts -- identifier-like words, random
looking tokens, endpoints -- mean little alone.  They are reported only when a
part of another kind lies within ``REACH`` code points in the same scope (a
block of text between blank lines): an interval join of the parts.

Positions come from built-in functions only: a text split at a pattern and the
pattern's matches interleave, so running lengths give every match's start.

Scale: texts are read once and not shuffled; only spans are.  The interval
join is an equi-join on ``(document, scope, bin)`` with the distance as the
residual, as a semi join, so no pairs are produced and a bin of ``REACH``
characters bounds the work per part.  A part stands in the bins it touches and
supports those up to one further on either side.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, table, text_or_empty

#: The contract's base patterns, in its order, and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Weak parts: an identifier, a secret-like token (20 or more characters with both digits and letters), an endpoint.
#: Runs have no longest length; possessive loops keep the scan linear.
WEAK = {
    "identifier": r"\b(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{16,}+\b",
    "material": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
    "endpoint": r"\b(?:https?|ftp|postgres|mysql|redis|amqp)://[^\s\"'<>]+",
}
REACH = 200
BASE = ("assign", "access", "hex")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(matches: Column, pieces: Column) -> Column:
    """Starts and ends of the matches, from the pieces of text between them.

    A fold that appends copies its list at every step.  So the lengths are cut
    into runs of about the root of their number: one fold places the runs, one
    for each run its matches, and no list is longer than such a run."""
    lengths = F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda x: F.struct(
        F.char_length(x["p"]).alias("p"), F.char_length(x["m"]).alias("m")))

    def after(at: Column, x: Column) -> Column:
        return at + x["p"] + F.coalesce(x["m"], F.lit(0))

    def runs(items: Column) -> Column:
        return _let(F.ceil(F.sqrt(F.size(items))).cast("int"), lambda width: F.transform(
            F.sequence(F.lit(1), F.size(items), width), lambda i: F.slice(items, i, width)))

    def within(run: Column, start: Column) -> Column:
        nothing = F.struct(start.alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))
        return F.aggregate(run, nothing, lambda acc, x: F.struct(
            after(acc["at"], x).alias("at"),
            F.when(x["m"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["p"]).alias("s"), after(acc["at"], x).alias("e"))))).alias("spans")))["spans"]

    def placed(cut: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(cut, nothing, lambda acc, run: F.struct(
            F.aggregate(run, acc["at"], after).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(cut, starts, within))

    return _let(lengths, lambda items: _let(runs(items), placed))


def _find(df: DataFrame, kind: str, pattern: str, may: Column | None = None) -> DataFrame:
    """Adds ``<kind>_m`` (the matches) and ``<kind>`` (their spans); ``may``:
    a cheap test that texts with a match pass."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    found = found if may is None else F.when(may, found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(f"{kind}_m", found)
    some = F.size(f"{kind}_m") > 0
    df = df.withColumn(f"{kind}_p", F.when(some, F.split("text", pattern, -1)))
    return df.withColumn(kind, F.when(some, _spans(F.col(f"{kind}_m"), F.col(f"{kind}_p")))
                         .otherwise(F.array().cast("array<struct<s:int,e:int>>"))).drop(f"{kind}_p")


def _value_length(match: Column) -> Column:
    """Length of an assignment's value: group 2 of its match."""
    return F.char_length(F.regexp_extract(match, ASSIGN, 2))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _ranked(kind: str, rank: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Secrets of every document.

    Input: ``doc_id, text`` (others are ignored).  Output, one row per input
    row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked``.
    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then kind (``assign, access, hex, identifier, material, endpoint``); an
    assignment's span is the whole match.  Weak parts that overlap a base span
    are left out of the result but support their neighbours.

    Null texts count as empty; texts without a match have empty spans and the
    hash of the empty string.  Repeated rows have equal results.  An empty
    table gives an empty result.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    df = _find(df, "assign", ASSIGN, F.col("text").rlike("(?i:passw|secret|token|api_?key)"))
    # Extraction yields the whole match; one whose value is short is dropped, after it has taken its place.
    df = df.withColumn("assign", F.transform(F.filter(F.arrays_zip("assign", "assign_m"),
                                                      lambda x: _value_length(x["assign_m"]) >= LEAST_VALUE), lambda x: x["assign"]))
    df = _find(df, "access", ACCESS, F.col("text").contains("AKIA"))
    df = _find(df, "hex", HEX)
    strong = F.size("assign") + F.size("access") + F.size("hex")
    df = _find(df, "identifier", WEAK["identifier"], F.col("text").rlike("[A-Z0-9]{16}"))
    df = _find(df, "material", WEAK["material"], F.col("text").rlike("[0-9]") & F.col("text").rlike("[A-Za-z0-9+/_-]{20}"))
    df = _find(df, "endpoint", WEAK["endpoint"], F.col("text").contains("://"))
    # A scope's number is the number of blank lines before it; the breaks' places are enough to tell.
    df = _find(df, "gap", r"\n[\x20\t]*\n", (F.size("identifier") + F.size("material") + F.size("endpoint") + strong) > 0)
    base = F.concat(*[_ranked(k, i, F.col(k)) for i, k in enumerate(BASE)])
    weak = F.concat(*[_ranked(k, i + len(BASE), F.col(k)) for i, k in enumerate(WEAK)])
    digest = stored(df.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), weak.alias("weak"),
        F.transform("gap", lambda x: x["s"]).alias("gaps")), "secrets-digest")

    def parts(column: str, kind: Column) -> DataFrame:
        return (digest.where(F.size("weak") > 0)
                .select("row", "gaps", F.explode(column).alias("x")).select("row", "x.*", kind.alias("part"),
                        F.size(F.filter("gaps", lambda g: g < F.col("x.s"))).alias("scope"))
                .withColumn("first", F.floor(F.col("s") / reach)).withColumn("last", F.floor(F.col("e") / reach)))

    # Each base span supports as the part it is: an access identifier, or secret material.
    weak_parts = parts("weak", F.col("x.kind"))
    base_parts = parts("base", F.when(F.col("x.kind") == "access", "identifier").otherwise("material"))
    support = (weak_parts.unionByName(base_parts)
               .select("row", "scope", "part", F.col("s").alias("os"), F.col("e").alias("oe"),
                       F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("bin")))
    # A part stands in every bin it touches, ends included, so any two within reach meet; the set below takes it once.
    weak_parts = weak_parts.withColumn("bin", F.explode(F.sequence("first", "last")))
    apart = F.greatest(F.col("a.s") - F.col("b.oe"), F.col("b.os") - F.col("a.e"))
    linked = weak_parts.alias("a").join(
        support.alias("b"),
        (F.col("a.row") == F.col("b.row")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.bin") == F.col("b.bin"))
        & (F.col("a.part") != F.col("b.part")) & (apart >= 0) & (apart <= reach), "left_semi")
    added = linked.groupBy("row").agg(F.collect_set(F.struct("s", "rank", "e", "kind")).alias("added"))
    nothing = F.array().cast("array<struct<s:int,rank:int,e:int,kind:string>>")
    added_new = F.filter(F.coalesce("added", nothing), lambda x: ~F.exists("base", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return (digest.drop("weak", "gaps").join(added, "row", "left").withColumn("added", added_new)
            .select("doc_id", *[count(k) for k in BASE],
                    F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                    _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_linked")))


def op9_secret_scan(spark, sf_dir):
    """Digest of :func:`find_secrets` over all documents."""
    return find_secrets(table(spark, sf_dir, "documents"))
