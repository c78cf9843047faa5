"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities are the matches of four fixed patterns (email, ip, card, phone).  They are the
seeds of a bootstrap over the corpus:

* a candidate is a token with a digit or @ (with the number groups that follow it) that no base
  span covers;
* a lexical pattern is a kind with the word before an entity, lower-cased, or the start of the text;
  patterns of base entities are the first ones;
* in each round a pattern's confidence is the share of its distinct instances that are
  trusted entities of its kind, damped by log support; an unknown instance that the kind could have
  counts half against it, any other in full;
* the kind of a candidate comes from the trusted patterns before it.  Its score is the noisy-or
  of their confidences, each weighted by how usual the candidate's shape (letter, digit and mark classes
  with repeats folded) is among the trusted entities of the kind.  An unseen shape is evidence against,
  and no bar.  Candidates from ``ACCEPT`` on join the trusted instances and lend their patterns to
  the next round; rounds end when none is accepted.

Pattern-instance pairs are grouped and joined on narrow rows (text is read once and never
shuffled).  A frequent pattern or instance is counted before the shuffle, and joins have one
row per key on their small side, so a hot key can be split.

Work is linear in a text.  Places of matches are running sums over gaps and matches, taken in
blocks of ``STEP`` and then over the blocks; candidates meet base spans in one sweep over both, sorted.
The patterns are written so that no backtracking is possible where it could be quadratic or
deep: possessive runs, and starts only after a character that cannot belong to the run or
where the previous match ended.  This changes no leftmost match.

Defined cases: null text is empty and has no spans.  Rows are handled one by one, so repeated
rows have equal results (they are kept apart by a row number of the written spans).  Null ids
are kept.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracefold.session import materialize

TRUST, ACCEPT = 0.2, 0.5
MIN_SUPPORT = 3
STEP = 256

# Kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds are looked for only in texts that hold a character they need.
_NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": lambda t: t.contains("+")}
#: A token with a digit or an @, and number groups after single blanks.
_TOKEN = r"(?:(?<!\S)|\G)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9(][0-9().-]*+)*+"
#: Forms that an entity of a kind could have at all.
_DIGITS = r"(?:[^0-9]*+[0-9]){%s}[^0-9]*+"
_POSSIBLE = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[^0-9]*+[0-9]{1,3}(?:[^0-9]++[0-9]{1,3}){3}[^0-9]*+$",
    "card": "^" + _DIGITS % "12,19" + "$",
    "phone": "^" + _DIGITS % "7,15" + "$",
}
_EMPTY = "array<struct<start:int,kind:int,stop:int,hit:string,before:string>>"


def _prefixes(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running ``merge`` (sum or maximum) of an int array, in blocks and then over blocks."""

    def running(items: Column) -> Column:
        return F.aggregate(items, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(
            F.when(F.size(acc) == 0, x).otherwise(merge(F.element_at(acc, -1), x)).cast("int")
        )))

    def cut(items: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")),
            lambda b: running(F.slice(items, b * STEP + 1, F.lit(STEP))),
        )

    def joined(inner: Column, before: Column) -> Column:
        return F.flatten(F.transform(inner, lambda block, b: F.when(b == 0, block).otherwise(
            F.transform(block, lambda x: merge(F.get(before, b - 1), x).cast("int"))
        )))

    found = _bound(values, lambda items: _bound(cut(items), lambda inner: _bound(
        running(F.transform(inner, lambda x: F.element_at(x, -1))), lambda before: joined(inner, before)
    )))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<int>"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often and wherever ``use`` names it."""
    return F.aggregate(F.array(value), F.array().cast("array<int>"), lambda _, x: use(x))


def _split(text: Column, pattern: str) -> Column:
    """(gap, hit) of all matches: the text since the previous match, and the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())


def _last_word(gap: Column, otherwise: Column) -> Column:
    """The last word of a gap, lower-cased; ``otherwise`` if it has none."""
    trimmed = F.rtrim(F.translate(gap, "\t\n\x0b\x0c\r", "     "))
    return F.when(trimmed != "", F.lower(F.substring_index(trimmed, " ", -1))).otherwise(otherwise)


def _placed(parts: Column, stops: Column, kind: int) -> Column:
    """Matches with place, kind and the word before; ``stops``: running ends of the parts."""
    # Zipped, not looked up: an array named inside a lambda may be computed for every element.
    earlier = F.concat(F.array(F.lit("")), F.transform(parts, lambda x: F.lower(x["hit"])))
    rows = F.arrays_zip(parts.alias("part"), stops.alias("stop"), F.slice(earlier, 1, F.size(parts)).alias("earlier"))
    return F.transform(rows, lambda x: F.struct(
        (x["stop"] - F.length(x["part"]["hit"])).cast("int").alias("start"), F.lit(kind).alias("kind"),
        x["stop"].cast("int").alias("stop"), x["part"]["hit"].alias("hit"),
        _last_word(x["part"]["gap"], x["earlier"]).alias("before"),
    ))


def _sizes(parts: Column) -> Column:
    return F.transform(parts, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("int"))


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
    ).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(256) <= 255))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _trimmed(token: Column) -> Column:
    """A token without the marks around it."""
    lead = F.length(F.regexp_extract(token["hit"], r"^[^\p{L}\p{N}+(]*+", 0))
    size = F.length(F.regexp_extract(token["hit"], r"(?s)^.*[\p{L}\p{N})]", 0))
    start, stop = token["start"] + lead, token["start"] + size
    return F.struct(
        stop.cast("int").alias("at"), F.lit(0).alias("type"), start.cast("int").alias("start"), F.lit(-1).alias("kind"),
        stop.cast("int").alias("stop"), F.substring(token["hit"], lead + 1, size - lead).alias("hit"), token["before"].alias("before"),
    )


def shape(hit: Column) -> Column:
    """Folded character classes, so that entities of one kind look alike."""
    s = F.regexp_replace(hit, r"\p{L}+", "a")
    s = F.regexp_replace(s, "[0-9]+", "9")
    return F.regexp_replace(F.regexp_replace(s, r"[ .()-]+", "-"), r"(a9|9a)+", "w")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by start, then kind) and free (candidate tokens); narrow rows."""
    text, none = F.col("_text"), F.array().cast("array<struct<gap:string,hit:string>>")
    patterns = [(f"_p{i}", k, PATTERNS[k]) for i, k in enumerate(KINDS)]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    ).select(
        "doc_id", *[F.when(_NEEDS[k](text), _split(text, p)).otherwise(none).alias(c) for c, k, p in patterns],
        F.when(text.rlike("[0-9@]"), _split(text, _TOKEN)).otherwise(none).alias("_t"),
    )
    names = [*[c for c, _, _ in patterns], "_t"]
    rows = rows.select("doc_id", *names, *[_prefixes(_sizes(F.col(c)), lambda a, b: a + b).alias(f"{c}s") for c in names])

    def valid(kind: str) -> Callable[[Column], Column]:
        return lambda x: _valid(kind, x["hit"])

    base = F.flatten(F.array(*[
        F.filter(_placed(F.col(c), F.col(f"{c}s"), i), valid(k)) for i, (c, k, _) in enumerate(patterns)
    ]))
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), _placed(F.col("_t"), F.col("_ts"), -1).alias("_t"))
    # One sweep by place: a token is free when no base span that starts before its end ends after its start.
    spans = F.transform("base", lambda x: F.struct(
        x["start"].alias("at"), F.lit(1).alias("type"), x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"),
        x["hit"].alias("hit"), x["before"].alias("before"),
    ))
    tokens = F.filter(F.transform("_t", _trimmed), lambda x: x["stop"] > x["start"])
    rows = rows.select("doc_id", "base", F.array_sort(F.concat(spans, tokens)).alias("_e"))
    reach = _prefixes(F.transform("_e", lambda x: F.when(x["type"] == 1, x["stop"]).otherwise(0)), F.greatest)
    rows = rows.select("doc_id", "base", "_e", reach.alias("_r"))
    free = F.filter(F.arrays_zip(F.col("_e").alias("e"), F.col("_r").alias("r")), lambda x: (x["e"]["type"] == 0) & (x["r"] <= x["e"]["start"]))
    fields = ("start", "kind", "stop", "hit", "before")
    return rows.select("doc_id", "base", F.transform(free, lambda x: F.struct(*[x["e"][f].alias(f) for f in fields])).cast(_EMPTY).alias("free"))


def _possible(hit: Column) -> Column:
    """Kinds that a candidate could have."""
    listed = F.array(*[F.when(hit.rlike(_POSSIBLE[k]), F.lit(i)) for i, k in enumerate(KINDS)])
    return F.filter(listed, lambda k: k.isNotNull())


def discover(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(hit, kind) of accepted candidates.

    ``seeds``: kind, hit, before of base entities; ``candidates``: hit, before.  Scores run on
    distinct (pattern, instance) pairs.
    """
    keys = ["kind", "before"]
    trusted = materialize(seeds.select("kind", "hit", "before").distinct(), "pii-trusted")
    # Only candidates behind a word that stands before an entity can be reached.
    unknown = materialize(candidates.select("hit", "before").distinct().withColumn("possible", _possible(F.col("hit"))), "pii-candidates")
    accepted = materialize(trusted.select("kind", "hit").filter("false"), "pii-accepted")
    while True:
        known = trusted.unionByName(
            unknown.join(accepted, "hit").filter(F.array_contains("possible", F.col("kind"))).select("kind", "hit", "before")
        ).distinct()
        rest = unknown.join(accepted.select("hit").distinct(), "hit", "left_anti")
        good = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("good")).filter(F.col("good") >= MIN_SUPPORT)
        others = known.groupBy("before").agg(F.count(F.lit(1)).alias("entities"))
        against = rest.groupBy("before").agg(F.count(F.lit(1)).alias("n"), *[
            F.count_if(F.array_contains("possible", i)).alias(f"could_{i}") for i in range(len(KINDS))
        ])
        could = F.coalesce(*[F.when(F.col("kind") == i, F.col(f"could_{i}")) for i in range(len(KINDS))], F.lit(0))
        bad = F.coalesce("n", F.lit(0)) - could * 0.5 + F.col("entities") - F.col("good")
        patterns = good.join(others, "before").join(against, "before", "left").withColumn(
            "confidence", F.col("good") / (F.col("good") + bad) * (1 - 1 / (1 + F.log2(F.col("good").cast("double"))))
        ).filter(F.col("confidence") >= TRUST).select(*keys, "confidence")
        entities = known.select("kind", "hit").distinct()
        shapes = entities.groupBy("kind", shape(F.col("hit")).alias("shape")).agg(F.count(F.lit(1)).alias("alike"))
        sizes = entities.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"))
        pairs = rest.select("hit", "before", F.explode("possible").alias("kind"), shape(F.col("hit")).alias("shape"))
        usual = 0.8 + 0.2 * F.coalesce("alike", F.lit(0)) / F.col("entities")
        scores = pairs.join(patterns, keys).join(shapes, ["kind", "shape"], "left").join(sizes, "kind").groupBy("kind", "hit").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence") * usual))))).alias("score")
        ).filter(F.col("score") >= ACCEPT)
        # One kind per candidate: the best score, ties in the order of the kinds.
        fresh = materialize(scores.groupBy("hit").agg(
            F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"].alias("k")
        ).select((-F.col("k")).alias("kind"), "hit"), "pii-fresh")
        if fresh.isEmpty():
            return accepted
        accepted = materialize(accepted.unionByName(fresh), "pii-accepted")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, more: base spans and the spans the bootstrap adds; one row per input row."""
    rows = materialize(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    seeds = rows.select(F.explode("base").alias("s")).select("s.kind", "s.hit", "s.before")
    free = rows.select("row", F.explode("free").alias("s")).select("row", "s.start", "s.stop", "s.hit", "s.before")
    accepted = discover(seeds, free.select("hit", "before"))
    more = (
        free.join(accepted, "hit")
        .groupBy("row").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more"))
    )
    spans = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    return rows.join(more, "row", "left").select(
        "doc_id", spans.alias("base"), F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>")).alias("more")
    )


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")
    )), ",")
