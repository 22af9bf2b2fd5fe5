"""Operator 6: personal data by base patterns and bootstrapped contextual extraction, DataFrame functions only.

Base. Emails, IP addresses, cards and phone numbers by regular expression, leftmost and without overlaps per kind, with
places in code points: splitting a text at a pattern gives the gaps between its matches, and the running lengths of gaps
and matches are the places. The expressions are written without nested backtracking and start only where a run of their
characters starts, so long runs cost linear time.

Bootstrapping. The base spans are seeds. Lexical patterns are the one and the two words before a span. Candidates are
number-like runs (at least 7 digits) and spelled-out addresses ("name at host dot org") outside all base spans. Patterns and
instances (digits, or letters of the address) form a graph. Each round gives a pattern, for each kind, the mean belief
of its distinct instances as its confidence, provided the beliefs in the kind (1 for seeds) sum to ``min_seeds``. Instances
of another kind or of a shape that the kind cannot have count in full against it, those not known yet by ``UNKNOWN``, so
up to half of a pattern's instances may be unseen. An instance gets the belief that patterns of at least ``threshold``
give it together, 1 - prod(1 - confidence). A candidate of a shape that the kind can have is added with its belief, which
it keeps, and counts in later rounds; these go on until none is added. Texts without such patterns keep their base spans
alone.

At scale: one scan finds spans and candidates; what follows works on rows for spans, not texts. Patterns such as "the" are
keys of partial aggregates, never collected groups. Beliefs are written between rounds, each of which adds an instance.

Null texts are empty: no spans. Repeated rows are rows of their own; they count once as instances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlink.llm.common import documents
from hitlink.session import materialize

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the kinds. They find what the plain forms in the comments find, from left to right.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 16 to 19 digits: whole runs of digits with single separators
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
NUMBER = r"(?<![A-Za-z0-9+.(])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![A-Za-z0-9])"
SPELLED = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: at | ?[(\[]at[)\]] ?)[A-Za-z0-9-]{1,63}"
           r"(?:(?: dot | ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9])")
UNKNOWN = 0.25  # what an instance without a kind, of a shape that the kind can have, counts against a pattern
CONTEXT = 60  # characters before a span that patterns are taken from
SPAN = "struct<start:int,end:int,value:string>"


def places(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, value) of all matches."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    none = F.lit(None).cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        start = (state["at"] + pair["gap"]).cast("int")
        end = (start + F.length(pair["hit"])).cast("int")
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(pairs, zero, step, lambda s: s["spans"])
    return F.when(text.rlike(hint), found).otherwise(F.coalesce(none, F.array().cast(f"array<{SPAN}>")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(c)

    def value(i: Column) -> Column:
        d = F.substring(c, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, spans, candidates): valid base spans as (kind, start, end, value, words) with kind the place in
    ``KINDS``, and candidates outside them (kind -1 for numbers, -2 for spelled-out addresses); ``words`` is the text before."""
    docs = documents(df, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")

    def tagged(spans: Column, kind: int) -> Column:
        first = lambda s: F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = lambda s: F.substring(text, first(s) + 1, s["start"] - first(s))
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                     s["value"].alias("value"), before(s).alias("words")))

    base = [F.filter(places(text, PATTERNS[k], HINTS[k]), _checker(k)) for k in KINDS]
    docs = docs.withColumn("spans", F.concat(*(tagged(b, i) for i, b in enumerate(base))))
    number = places(text, NUMBER, r"[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]")
    spelled = places(text, SPELLED, r"(?: at |[(\[]at[)\]])[\s\S]{1,80}(?: dot |[(\[]dot[)\]]|\.[A-Za-z])")
    other = F.concat(tagged(number, -1), tagged(spelled, -2))
    free = lambda c: ~F.exists("spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return docs.select("doc_id", "row", "spans", F.filter(other, free).alias("candidates"))


def _edges(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, instance, shape, patterns): spans and candidates with the words before them."""
    rows = found.select("row", F.explode(F.concat("spans", "candidates")).alias("s")).select("row", "s.*")
    words = F.filter(F.split(F.lower(F.trim(F.regexp_replace("words", r"\s+", " "))), " "), lambda w: w != "")
    n = F.size("before")
    last = F.element_at("before", -1)
    two = F.concat_ws(" ", F.element_at("before", -2), last)
    spelled = F.regexp_replace(F.regexp_replace(F.lower("value"), r" ?[(\[]?\bat\b[)\]]? ?", "@"), r" ?[(\[]?\bdot\b[)\]]? ?", ".")
    letters = (F.col("kind") == 0) | (F.col("kind") == -2)
    number = F.col("value").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    shape = F.when(letters, "letters").when(number, "dotted").otherwise("digits")
    return (rows.withColumn("before", words)
            .select("row", "kind", "start", "end", F.when(letters, spelled).otherwise(digits("value")).alias("instance"), shape.alias("shape"),
                    F.when(n >= 2, F.array(last, two)).when(n == 1, F.array(last)).otherwise(F.array().cast("array<string>")).alias("patterns")))


def bootstrap(edges: DataFrame, rounds: int | None = None, threshold: float = 0.8, min_seeds: int = 3) -> DataFrame:
    """(instance, shape, given): instances that are no seeds and that confident patterns vouch for; ``rounds`` at most, by
    default until none is added."""
    graph = materialize(edges.select(F.explode("patterns").alias("pattern"), "instance", "shape", "kind").distinct(), "pii_graph")
    nodes = graph.select("pattern", "instance", "shape").distinct()
    belief = graph.where("kind >= 0").select("instance", "shape", "kind").distinct().withColumn("belief", F.lit(1.0))
    added = belief.where(F.lit(False))
    size = nodes.groupBy("pattern").agg(F.count("*").alias("size"))
    digits_from = lambda low, high: (F.col("shape") == "digits") & F.length("instance").between(low, high)
    fits = [F.col("shape") == "letters", F.col("shape") == "dotted", digits_from(13, 19), digits_from(7, 15)]  # as KINDS
    suits = F.element_at(F.array(*fits), F.col("kind") + 1)
    number = 0
    while rounds is None or number < rounds:
        number += 1
        # Instances without a kind so far that could be of this one speak against it by a part only.
        unknown = (nodes.join(belief.select("instance", "shape").distinct(), ["instance", "shape"], "left_anti").groupBy("pattern")
                   .agg(F.array(*(F.sum(f.cast("long")) for f in fits)).alias("unknown")))
        possible = F.coalesce(F.element_at("unknown", F.col("kind") + 1), F.lit(0))
        scored = (nodes.join(belief, ["instance", "shape"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("held"))
                  .where(F.col("held") >= min_seeds).join(size, "pattern").join(unknown, "pattern", "left")
                  .select("pattern", "kind", (F.col("held") / (F.col("size") - (1 - UNKNOWN) * possible)).alias("confidence"))
                  .where(F.col("confidence") >= threshold))
        # A pattern in which everything is a seed stays short of certainty.
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-3)))
        given = (nodes.join(scored, "pattern").groupBy("instance", "shape", "kind").agg((1 - F.exp(F.sum(doubt))).alias("belief"))
                 .where(suits).join(belief.select("instance", "shape"), ["instance", "shape"], "left_anti"))
        found = materialize(given.groupBy("instance", "shape").agg(F.max(F.struct("belief", F.negative("kind").alias("k"))).alias("best"))
                            .select("instance", "shape", F.negative("best.k").alias("kind"), F.col("best.belief").alias("belief")), "pii_beliefs")
        if found.isEmpty():
            break
        belief, added = belief.unionByName(found), added.unionByName(found)
    return added.select("instance", "shape", F.col("kind").alias("given"))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, threshold: float = 0.8,
                  min_seeds: int = 3) -> DataFrame:
    """A row per row of ``df``: ``base`` and ``added`` arrays of (kind, start, end), kind the place in ``KINDS``, sorted."""
    found = materialize(scan(df, id_col, text_col), "pii_scan")
    edges = materialize(_edges(found), "pii_edges")
    new = bootstrap(edges, rounds, threshold, min_seeds)
    span = F.struct(F.col("given").alias("kind"), "start", "end")
    added = (edges.where("kind < 0").join(new, ["instance", "shape"]).groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("added")))
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return (found.select("doc_id", "row", F.array_sort(F.transform("spans", short)).alias("base")).join(added, "row", "left")
            .select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("added")))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    number = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *number, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
