"""Personal data by bootstrapped contextual extraction.

Strict patterns find the seeds: e-mail addresses, IPv4 addresses, card and phone
numbers.  Looser patterns find strings of similar form, which alone mean nothing:
words with one @, chains of digits, colon-separated hexadecimal groups.  Both are
mentions, and the two words before a mention are its context.

1. A lexical pattern is a context that stands before at least ``SUPPORT`` different
   seeds of one kind.
2. Spark counts how often each pattern's two words stand in all texts, whatever
   follows, and joins patterns and mentions into a graph of patterns and instances.
3. For at most ``ROUNDS`` rounds a pattern's confidence is the share of its places that hold
   accepted instances, and an instance is accepted if a pattern of confidence
   ``CONFIDENT`` or more holds it; accepted ones raise the confidence of other patterns.
4. Accepted instances are marked wherever they stand, in any context.

In prose, two words that precede some seeds precede far more ordinary words, so
such patterns stay below the bar and clean documents stay clean.

Everything is a DataFrame expression.  Places come from the lengths of the pieces
that a split leaves between matches.  The strict patterns are anchored where a
match can begin, so that a long run of letters or digits is read once.  Only
mentions are moved, never texts; copies of a mention are counted before they are
joined, so a context or instance that a third of all rows share is one row per task.

Defined cases: a missing text is empty and has no spans; equal rows get equal
results; rows without an id stay; places count code points, ends are exclusive;
spans of different kinds may overlap; added spans overlap neither a base
span nor an earlier loose mention of an accepted instance (of those that begin
together the longest stays); a context does not reach back over the previous
match of the same pattern; words are split at ASCII blanks and compared in lower
case; an empty table gives no rows; ``find_private`` passes all columns through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonelens.functions.skew import broadcast_if_small
from clonelens.llm.common import packed_row, table, whole_text
from clonelens.session import spread, staged

# Kinds in the order in which spans that begin together are listed.
EMAIL, IP, CARD, PHONE = "email", "ip", "card", "phone"
KINDS = (EMAIL, IP, CARD, PHONE)
SUPPORT = 3  # different seeds a pattern needs
CONFIDENT = 0.8
ROUNDS = 6
REACH = 80  # code points before a mention in which its two words are looked for
WORD_END = 24  # of a long context word only the end counts
_CHUNK = 256

_B = r"\x20\x09-\x0D"
# The strict patterns; possessive runs and the first group only save rereading, the matches are those of the plain form.
_LOCAL = r"[A-Za-z0-9._%+-]"
STRICT = {
    EMAIL: rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms, and the kinds an instance of the form may turn out to be.
LOOSE = {
    "word": rf"(?<![^{_B}\"'(<\[])[^{_B}@\"'(<\[]++@[^{_B}@]*[\p{{L}}\p{{N}}]",
    "chain": r"(?<![\p{L}\p{N}+._-])\(?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "groups": rf"(?<![^{_B}\"'(<\[])[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){{2,}}+(?![\p{{L}}\p{{N}}_])",
}
_MAY_BE = {"word": (EMAIL,), "chain": (CARD, PHONE), "groups": (IP,)}
_NEEDS = {EMAIL: "@", PHONE: "+", "word": "@", "groups": ":"}  # a text without this character has no match
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right: every second digit from the end is doubled."""

    def value(i: Column) -> Column:
        one = F.substring(digits, i, 1)
        doubled = (F.length(digits) - i) % 2 == 1
        return F.when(doubled, F.translate(one, "0123456789", "0246813579")).otherwise(one).cast("int")

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _sound(form: str, match: Column) -> Column:
    """The conditions beyond the pattern."""
    if form == IP:
        return F.forall(F.split(match["value"], r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    n = F.length(match["digits"])
    if form == CARD:
        return F.when(n.between(14, 19), luhn(match["digits"])).otherwise(False)
    if form == PHONE:
        return n.between(10, 15)
    if form == "chain":
        return n.between(7, 19)
    return F.lit(True)


def running_sums(sizes: Column) -> Column:
    """The sums of a long array's beginnings, chunk by chunk, so that no long array is copied per element."""

    def one_chunk(chunk: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.array().cast("array<bigint>").alias("out"))
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(chunk, start, add)["out"]

    last = F.floor((F.size(sizes) - 1) / F.lit(_CHUNK)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(sizes, i * _CHUNK + 1, F.lit(_CHUNK)))
    zero = F.lit(0).cast("bigint")
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    befores = F.concat(F.array(zero), one_chunk(totals, zero))
    flat = F.flatten(F.zip_with(chunks, F.slice(befores, 1, F.size(totals)), one_chunk))
    return F.when(F.size(sizes) > 0, flat).otherwise(F.array().cast("array<bigint>"))


def with_matches(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``rows`` with an array (start, end, value, digits, before) per pattern, from the left and not overlapping.

    ``before`` is the end of the text between the previous match and this one.
    """
    body = F.col(text)
    found, between, sizes, ends, out = {}, {}, {}, {}, {}
    for name, pattern in patterns.items():
        all_found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        if name in _NEEDS:
            all_found = F.when(body.contains(_NEEDS[name]), all_found).otherwise(F.array().cast("array<string>"))
        found[f"{name}__f"] = all_found
        f, b = F.col(f"{name}__f"), F.col(f"{name}__b")
        pieces = F.when(F.size(f) > 0, F.slice(F.split(body, pattern, -1), F.lit(1), F.size(f)))
        between[f"{name}__b"] = pieces.otherwise(F.array().cast("array<string>"))
        sizes[f"{name}__s"] = F.zip_with(f, b, lambda v, p: (F.length(v) + F.length(p)).cast("bigint"))
        ends[f"{name}__e"] = running_sums(F.col(f"{name}__s"))

        def match(pair: Column, end: Column) -> Column:
            value = pair["value"]
            return F.struct(
                (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"),
                F.regexp_replace(value, "[^0-9]", "").alias("digits"), F.right(pair["piece"], F.lit(REACH)).alias("before"),
            )

        pairs = F.zip_with(f, b, lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
        out[name] = F.zip_with(pairs, F.col(f"{name}__e"), match)
    for step in (found, between, sizes, ends, out):
        rows = rows.withColumns(step)
    return rows.drop(*found, *between, *sizes, *ends)


def _word(word: Column) -> Column:
    return F.lower(F.right(word, F.lit(WORD_END)))


def context(before: Column) -> Column:
    """The last two words as one string, null if there are not two or something else touches the mention."""
    window = F.regexp_replace(before, r"[\"'(<\[]*$", "")
    words = rf"(?:^|[{_B}])([^{_B}]+)[{_B}]+([^{_B}]+)[{_B}]+$"
    first, second = F.regexp_extract(window, words, 1), F.regexp_extract(window, words, 2)
    return F.when(first != "", F.concat_ws(" ", _word(first), _word(second)))


def _mention(kind: str, match: Column) -> Column:
    instance = F.lower(F.regexp_replace(match["value"], rf"[{_B}().-]+", ""))
    return F.struct(
        match["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), match["end"].alias("end"),
        instance.alias("value"), context(match["before"]).alias("context"),
    )


def _as_kind(matches: Column, form: str, kind: str) -> Column:
    return F.transform(F.filter(matches, lambda m: _sound(form, m)), lambda m: _mention(kind, m))


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(__row, __uid, base, loose): all rows as structs, with their strict and loose mentions.

    Both are arrays of (start, kind number, end, value, context) by start, then
    kind; ``loose`` holds one entry per kind a form may be and may overlap ``base``.
    """
    rows = spread(docs).select(packed_row(docs), whole_text(text).alias("__text"))
    rows = with_matches(rows, "__text", STRICT | LOOSE)
    base = [_as_kind(F.col(k), k, k) for k in KINDS]
    loose = [_as_kind(F.col(form), form, k) for form, kinds in _MAY_BE.items() for k in kinds]
    return rows.select(
        "__row", F.monotonically_increasing_id().alias("__uid"),
        F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*loose)).alias("loose"),
    )


def free_mentions(found: DataFrame) -> DataFrame:
    """(__uid, start, end, kind, value, context, seed): strict mentions, and loose ones that overlap none of them."""
    parts = [
        found.select("__uid", F.explode(name).alias("m")).select("__uid", "m.*", F.lit(name == "base").alias("seed"))
        for name in ("base", "loose")
    ]
    every = parts[0].unionByName(parts[1])
    one = Window.partitionBy("__uid")  # the mentions of one document
    earlier = one.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = one.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumns({
        "reached": F.max(F.when(F.col("seed"), F.col("end"))).over(earlier),
        "next": F.min(F.when(F.col("seed"), F.col("start"))).over(later),
    })
    hit = (F.coalesce("reached", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return every.filter(F.col("seed") | ~hit).drop("reached", "next")


# ---- the graph of patterns and instances ---------------------------------------------------


def graph(free: DataFrame) -> DataFrame:
    """(context, kind, value, seed, n): how often each instance stands in each context."""
    placed = free.filter("context is not null")
    return placed.groupBy("context", "kind", "value", "seed").agg(F.count(F.lit(1)).alias("n"))


def patterns(edges: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(context, kind): contexts of at least ``support`` different seeds of a kind."""
    seeds = edges.filter("seed").groupBy("context", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    return seeds.filter(F.col("seeds") >= support).select("context", "kind")


def places(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, places): how often the two words of each context stand in a row in the texts."""
    words = F.filter(F.split("text", rf"[{_B}]+"), lambda w: w != "")
    ends = F.transform(words, _word)
    pairs = F.zip_with(
        F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    every = texts.select(F.explode(pairs).alias("context"))
    small = broadcast_if_small(contexts.select("context").distinct())
    return every.join(small, "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("places"))


def accepted(edges: DataFrame, counts: DataFrame, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value): loose instances that patterns of enough confidence hold.

    ``edges`` (context, kind, value, seed, n) are those of patterns only, ``counts`` has their places.
    """
    taken = edges.filter("seed").select("kind", "value").distinct()
    size = taken.count()
    for _ in range(rounds):
        known = edges.join(taken, ["kind", "value"], "left_semi")
        held = known.groupBy("context", "kind").agg(F.sum("n").alias("held"))
        sure = held.join(counts, "context").filter(F.col("held") >= F.lit(confident) * F.col("places")).select("context", "kind")
        more = edges.join(sure, ["context", "kind"], "left_semi").select("kind", "value")
        taken = staged(taken.unionByName(more).distinct(), "private-taken")
        before, size = size, taken.count()
        if size == before:
            break
    return taken.join(edges.filter("seed").select("kind", "value").distinct(), ["kind", "value"], "left_anti")


def added_spans(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(__uid, more): loose mentions of accepted instances, per row that has any; ``found`` is staged."""
    free = staged(free_mentions(found), "private-free")
    edges = staged(graph(free), "private-edges")
    chosen = staged(patterns(edges), "private-patterns")
    inner = staged(edges.join(broadcast_if_small(chosen), ["context", "kind"], "left_semi"), "private-graph")
    none = found.limit(0).select("__uid", F.array().cast(_SPAN).alias("more"))
    if inner.filter("not seed").isEmpty():
        return none
    counts = staged(places(spread(docs).select(whole_text(text).alias("text")), chosen), "private-places")
    sure = staged(accepted(inner, counts), "private-accepted")
    if sure.isEmpty():
        return none
    met = free.filter("not seed").join(broadcast_if_small(sure), ["kind", "value"], "left_semi")
    order = Window.partitionBy("__uid").orderBy("start", F.desc("end"), "kind")  # the added mentions of one document
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = met.withColumn("reached", reached).filter(F.coalesce("reached", F.lit(0)) <= F.col("start"))
    spans = F.collect_list(F.struct("start", "kind", "end")).cast(_SPAN)
    return apart.groupBy("__uid").agg(spans.alias("more"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans (start, kind, end), comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """(__row, base, spans): every row as a struct, its base spans and all spans, as arrays (start, kind, end)."""
    found = staged(mentions(docs, text), "private-mentions")
    more = added_spans(docs, found, text)
    short = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    met = found.select("__row", "__uid", short.alias("base")).join(more, "__uid", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return met.select("__row", "base", every.alias("spans"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; the ``n_`` columns count base spans."""
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, F.lit(i)))).cast("bigint").alias(f"n_{kind}") for i, kind in enumerate(KINDS)
    ]
    return found.select(
        F.col("__row.doc_id").alias("doc_id"), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
