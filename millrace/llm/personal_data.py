"""Personal data: patterns of known kinds, and further identifiers that stand in the same contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# What each kind looks like. Possessive repeats and the look behind change no match; they keep the search
# linear on long runs of the same characters: a run is entered at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be worth a search.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?+[0-9]){15}", "phone": r"\+[0-9]"}
#: An address whose sign is written out, as in `jane(at)mail.org` or `jane [at] mail [dot] org`.
AT = r"[(\[{<](?i:at)[)\]}>]"
_DOT = r"(?:\.| ?[(\[{<](?i:dot)[)\]}>] ?)"
#: What may be an identifier of unseen form: groups of digits, a written-out address, or a run of such characters with a digit.
CANDIDATE = (
    r"(?:\G|(?<![A-Za-z0-9]))(?:"
    r"\(?[0-9]{2,}+(?:(?:\)?[ ./-]\(?|[()])[0-9]{2,}+)++(?![._/:-]*+[A-Za-z0-9])"
    rf"|(?<![._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?{AT} ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
    r"|(?=[A-Za-z._/:-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._/:-]*+)"
)
CANDIDATE_DIGITS = 5
#: Contexts are the last two words, and the last word alone, among so many characters before a span.
REACH = 60
ROUNDS = 3
#: Different known values that a context must hold, and the confidence that it needs.
MIN_SEEDS = 3
CONFIDENCE = 0.5
#: The same for contexts of one word, which stand before many things. They add only what has a form of the kind.
WIDE_SEEDS = 10
WIDE_CONFIDENCE = 0.7
#: A context of one word begins with this, which no word holds.
WIDE = "\t"
_SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
_BLOCK = 512


def running_sum(numbers: Column) -> Column:
    """Sums of an array of whole numbers up to each place, block by block: arrays grow by copying."""

    def sums(part: Column, at: Column) -> Column:
        first = F.array(at.cast("int"))
        return F.slice(F.aggregate(part, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 2, _BLOCK)

    count = F.ceil(F.size(numbers) / F.lit(_BLOCK)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(numbers, b * _BLOCK + 1, _BLOCK))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    ends = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    all_sums = F.flatten(F.zip_with(parts, F.slice(ends, 1, count), sums))
    return F.when(F.size(numbers) > 0, all_sums).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern, from left to right, with their places in code points and the `REACH` characters before
    them, earlier matches included. Each match has a character at least, so as many matches back are enough."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    before = F.slice(gaps, 1, F.size(values))
    ends = running_sum(F.zip_with(before, values, lambda g, v: F.length(g) + F.length(v)))
    right = lambda part: F.right(part, F.lit(REACH))
    pieces = F.zip_with(before, values, lambda g, v: right(F.concat(g, v)))
    # an array of one binds the pieces to a name: they are computed once, not for each match
    reach = F.transform(F.array(pieces), lambda p: F.transform(before, lambda g, i: right(F.concat(F.array_join(F.slice(p, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), ""), right(g)))))[0]
    whole = F.arrays_zip(ends.alias("end"), values.alias("value"), reach.alias("before"))
    return F.transform(
        whole,
        lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before")),
    ).cast(_SPAN)


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of all kinds, `(kind, start, end, value, before)`, by the kinds' order and then by place."""
    none = F.array().cast(_SPAN)

    def of(number: int, kind: str) -> Column:
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        found = F.filter(F.when(hint, spans(text, PATTERNS[kind])).otherwise(none), lambda s: holds(kind, s["value"]))
        return F.transform(found, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def candidate_spans(text: Column) -> Column:
    grouped = r"[0-9]{2}(?:\)?[ ./-]\(?|[()])[0-9]{2}"
    worth = text.rlike(f"(?:[0-9][A-Za-z._/:-]*+){{{CANDIDATE_DIGITS}}}") | text.rlike(grouped) | text.rlike(AT)
    found = F.when(worth, spans(text, CANDIDATE)).otherwise(F.array().cast(_SPAN))
    return F.filter(found, lambda s: (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= CANDIDATE_DIGITS) | s["value"].rlike(AT))


def contexts_of(before: Column) -> Column:
    """The lexical patterns of a place: the last two words before it, lower-cased, numbers alike, and the last word alone,
    marked by `WIDE`; none without a letter."""
    last = F.regexp_extract(F.lower(before), r"((?:[^ \t-\r]+[ \t-\r]+)?[^ \t-\r]+)[ \t-\r]*$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, "[ \\t-\\r]+", " "), "[0-9]+", "0")
    word = F.element_at(F.split(plain, " "), -1)
    letter = r"\p{L}"
    return F.array_compact(F.array(F.when(plain.rlike(letter), plain), F.when(word.rlike(letter), F.concat(F.lit(WIDE), word))))


def may_be(kind: Column, value: Column) -> Column:
    """Whether a value has a form in which its kind is written: only such are taken after a single word."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    no_letter = ~value.rlike(r"\p{L}")
    return (
        F.when(kind == 0, value.rlike(AT))
        .when(kind == 1, value.rlike(r"\A[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}\z"))
        .when(kind == 2, no_letter & digits.between(12, 19))
        .otherwise(no_letter & digits.between(CANDIDATE_DIGITS, 15))
    )


def learn_contexts(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """`(context, kind, score)` of the contexts that are sure, and `(value, kind, score)` of what they found.

    `seeds` has `(context, value, kind)` of known spans, `candidates` `(context, value)` of possible ones. Contexts and
    values are the two sides of a graph. In each round a context's score for a kind is the sum of its values' scores
    over the number of its values, less the more the fewer known values it has; a value's score is the chance that not
    all of its sure contexts err. Contexts of one word need `WIDE_SEEDS` and `WIDE_CONFIDENCE`, and speak only for values
    that `may_be` of the kind. Known values keep 1. Only distinct edges count, so a context or value that a third of
    all rows hold is one row for each partner; sums are combined before shuffles, and a round ends in a table.
    """
    sure = seeds.where("context is not null").distinct()
    edges = cut_lineage(sure.select("context", "value").unionByName(candidates.where("context is not null").select("context", "value")).distinct(), "edges")
    size = cut_lineage(edges.groupBy("context").agg(F.count("*").alias("n")), "contexts")
    known = seeds.select("value", "kind").distinct().withColumn("score", F.lit(1.0)).withColumn("seed", F.lit(1))
    scores = known = cut_lineage(known, "known")
    wide = F.col("context").startswith(WIDE)
    enough, least = F.when(wide, F.greatest(F.lit(min_seeds), F.lit(WIDE_SEEDS))).otherwise(min_seeds), F.when(wide, F.greatest(F.lit(confidence), F.lit(WIDE_CONFIDENCE))).otherwise(confidence)
    for _ in range(rounds):
        hits = edges.join(scores, "value").groupBy("context", "kind").agg(F.sum("score").alias("hits"), F.sum("seed").alias("seeds"))
        rated = hits.where(F.col("seeds") >= enough).join(size, "context")
        score = F.col("hits") / F.col("n") * (1 - 1 / (1.0 + F.col("seeds")))
        contexts = cut_lineage(rated.select("context", "kind", score.alias("score")).where(F.col("score") >= least), "contexts")
        missed = edges.join(contexts, "context").where(~wide | may_be(F.col("kind"), F.col("value"))).groupBy("value", "kind").agg(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))).alias("missed"))
        found = missed.join(known.select("value"), "value", "left_anti").select("value", "kind", (1 - F.exp("missed")).alias("score"), F.lit(0).alias("seed"))
        scores = cut_lineage(known.unionByName(found), "scores")
    return contexts, scores.where("seed = 0").select("value", "kind", "score")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """`(doc_id, text_hash, base, found)` of every row: the spans of the known kinds, and those that contexts added, both
    as arrays of `(kind, start, end, value)`, kinds numbered as in `KINDS`, places in code points, ends exclusive.

    Texts are read once; what is kept of them, the spans and the words before them, goes to a table. A candidate is
    taken if a sure context stands before it and its own score is sure as well; one that meets a known span is not.
    Of several kinds the surest is taken, then the first. Null texts are empty; repeated rows get the same spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    table = cut_lineage(rows.select("doc_id", "text_hash", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("rest")), "spans")
    seeds = table.select(F.explode("base").alias("s")).select(F.explode_outer(contexts_of(F.col("s.before"))).alias("context"), "s.value", "s.kind")
    rest = table.select("doc_id", "text_hash", "base", F.explode("rest").alias("s")).withColumn("context", F.explode(contexts_of(F.col("s.before"))))
    contexts, values = learn_contexts(seeds, rest.select("context", "s.value"), rounds, min_seeds, confidence)
    best = F.array_max(F.collect_list(F.struct(F.col("score"), (-F.col("kind")).alias("rank"))))  # of four kinds at most
    chosen = contexts.groupBy("context").agg(best.alias("c"))
    surely = values.where(F.col("score") >= confidence).select("value", "kind")
    formed = ~F.col("context").startswith(WIDE) | may_be(-F.col("c.rank"), F.col("s.value"))
    hit = rest.join(chosen, "context").where(formed).select("doc_id", "text_hash", "base", "s", (-F.col("c.rank")).alias("kind"), F.col("s.value").alias("value")).join(surely, ["value", "kind"])
    apart = ~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    span = F.struct("kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "value")
    added = hit.where(apart).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("found"))
    added = added.withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"})
    match = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return table.join(added, match, "left").select("doc_id", "text_hash", base.alias("base"), F.coalesce("found", none).alias("found"))


def written(found: Column) -> Column:
    """`kind:start:end` of spans, joined by commas, by the kinds' order and then by place."""
    places = F.array_sort(F.transform(found, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    name = lambda s: reduce(lambda c, k: c.when(s["kind"] == k, KINDS[k]), range(1, len(KINDS)), F.when(s["kind"] == 0, KINDS[0]))
    return F.array_join(F.transform(places, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
