"""Personal data: fixed shapes, and what turns up in the same contexts (DataFrame functions only).

Four kinds have a fixed shape: mail addresses, IP addresses, card numbers (with a valid check
digit) and international telephone numbers. They are the seeds. The words next to a seed are its
lexical patterns: the two words before it, and the word on either side of it (lower case, digit
runs as 0). Anything that looks like an identifier and stands in such a context is an instance of
the pattern: a number however it is grouped, or a name joined to a host by `@`, `[at]` or `(at)`.

The graph of patterns and instances is scored in rounds. A pattern's confidence in a kind is the
share of known values of that kind among all different values it was seen with (numbers of any
length included, one more counted so that it stays under 1); at least `LEAST_KNOWN` must be known
and the share must reach `PATTERN`. A value's score is the chance that one of its trusted patterns
is right; from `VALUE` on it is known too, and supports patterns in the next round. Values are
counted once however often they are copied. In the end every occurrence of a known value whose
shape suits its kind is a span of that kind, unless a base span overlaps it.

Offsets are code points, found without a window over texts: a text is split at the matches, and the
lengths of gaps and matches are summed up in blocks of `STEP`. Expressions are possessive and start
only where a match can start, so a text of one endless word takes linear time. Texts leave the
first scan only as offsets, values and the words around them.

Null texts are empty. Rows of equal doc_id and text get equal spans; a null doc_id is like any other.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from rankflow.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Different known values that a pattern needs.
LEAST_KNOWN = 3
PATTERN, VALUE = 0.7, 0.8
ROUNDS = 3
#: Lengths that are summed up one by one; longer lists are summed in blocks of them.
STEP = 256
#: Code points around a match in which its neighbouring words are looked for.
AROUND = 80

# The stated shapes. A look-behind (or the end of the last match, \G) takes the place of the starts
# that cannot succeed, possessive quantifiers that of the retries.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_SHAPES = {"email": (_EMAIL, "@"), "ip": (_IP, r"[0-9]\."), "card": (_CARD, "[0-9]"), "phone": (_PHONE, r"\+[0-9]")}
_AT = r"@|[\[(](?:at|AT)[\])]"
# What may be an identifier.
_MAILISH = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)*+"
)
_NUMBER = r"\+?\(?[0-9](?:[ ().\-/]{0,3}[0-9])*+"


def running(steps: str) -> Column:
    """Sums of a list column up to and with each entry. It has to be a column: lambdas evaluate an expression anew."""
    zero, n = F.lit(0).cast("long"), F.size(steps)

    def block(b: Column) -> Column:
        places = F.sequence(b * STEP, F.least((b + 1) * STEP, n) - 1)
        return F.transform(places, lambda j: F.get(steps, j).cast("long"))

    def upto(values: Column, before: Column) -> Column:
        grown = F.aggregate(values, F.array(before), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))
        return F.slice(grown, F.lit(2), F.size(values))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), block)
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, v: s + v))
    ahead = F.aggregate(totals, F.array(zero), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))
    sums = F.flatten(F.zip_with(blocks, F.slice(ahead, F.lit(1), F.size(ahead) - 1), upto))
    return F.when(n > 0, sums).otherwise(F.array().cast("array<bigint>"))


_HIT = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def hits(df: DataFrame, shape: str, needs: str, name: str) -> DataFrame:
    """Adds `name`: start, end, value and the text around each match of `shape` in `text`; few texts have what it `needs`."""
    found = F.when(F.col("text").rlike(needs), F.regexp_extract_all("text", F.lit(shape), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("_found", found)
    gap = lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(AROUND)).alias("left"), F.left(g, F.lit(AROUND)).alias("right"))
    out = out.withColumn("_gaps", F.when(F.size("_found") > 0, F.transform(F.split("text", shape, -1), gap)))
    out = out.withColumn("_steps", F.transform("_found", lambda m, i: F.get("_gaps", i)["n"] + F.length(m)))
    out = out.withColumn("_ends", running("_steps"))
    row = lambda m, i: F.struct(
        (F.get("_ends", i) - F.length(m)).alias("start"), F.get("_ends", i).alias("end"), m.alias("value"),
        F.get("_gaps", i)["left"].alias("left"), F.get("_gaps", i + 1)["right"].alias("right"),
    )
    none = F.array().cast(_HIT)
    return out.withColumn(name, F.when(F.size("_found") > 0, F.transform("_found", row)).otherwise(none)).drop("_found", "_gaps", "_steps", "_ends")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_parts(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(F.ltrim(p, F.lit("0")), F.lit(3))).cast("int") <= 255))


def luhn(number: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), lambda s, i: s + F.coalesce(worth(i), F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return small_parts(value)
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def suits(kind: str, value: Column) -> Column:
    """Whether a value found by its context may be of the kind."""
    n = F.length(digits(value))
    if kind == "email":
        return value.rlike(_AT)
    number = ~value.rlike("[A-Za-z]")
    if kind == "ip":
        return number & value.rlike(r"^[0-9]{1,4}(?:[.-][0-9]{1,4}){3,}$")
    return number & (n.between(12, 19) if kind == "card" else n.between(7, 15))


def scan(docs: DataFrame) -> DataFrame:
    """`_key`, `doc_id`, `base` (kind number, start, end, value and surroundings) and `rest` (what may be one)."""
    name = F.when(F.col("doc_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.sha2(F.concat(name, F.lit(":"), F.col("text")), 256))
    for kind, (shape, needs) in _SHAPES.items():
        rows = hits(rows, shape, needs, kind)
        rows = rows.withColumn(kind, F.filter(kind, functools.partial(lambda k, h: valid(k, h["value"]), kind)))
    rows = hits(rows, _MAILISH, _AT, "_mailish")
    rows = hits(rows, _NUMBER, "[0-9]", "_number")
    of_kind = lambda k, c: F.transform(c, lambda h: F.struct(F.lit(k).alias("k"), *[h[f].alias(f) for f in ("start", "end", "value", "left", "right")]))
    base = F.concat(*[of_kind(k, F.col(kind)) for k, kind in enumerate(KINDS)])
    rest = F.concat(of_kind(-1, F.col("_mailish")), of_kind(-1, F.col("_number")))
    return rows.select("_key", "doc_id", base.alias("base"), rest.alias("rest"))


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: both words before it, and the word on either side."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[0-9]+", "0")

    two, one = F.regexp_extract(left, r"(?<!\S)(\S++)\s++\S++\s*+$", 1), F.regexp_extract(left, r"(?<!\S)(\S++)\s*+$", 1)
    after = F.regexp_extract(right, r"^\s*+(\S++)", 1)
    return F.array_compact(
        F.array(
            F.when((two != "") & (one != ""), F.concat_ws(" ", plain(two), plain(one), F.lit("_"))),
            F.when((one != "") & (after != ""), F.concat_ws(" ", plain(one), F.lit("_"), plain(after))),
        )
    )


def spread_join(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join stored `rows` with `small` on `key`; a key with more than a thousandth of all rows is dealt out.

    At most a thousand keys can be that frequent, which bounds what is broadcast; only their rows of
    `small` are repeated.
    """
    most = max(10_000, rows.count() // 1000)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int"))
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")


def places_of(scanned: DataFrame) -> DataFrame:
    """One row for every different place: what base spans do not overlap, and the base spans themselves."""
    rows = scanned.select("_key", F.explode(F.concat("base", "rest")).alias("h")).select("_key", "h.*")
    once = rows.groupBy("_key", "start", "end", "k").agg(*[F.first(c).alias(c) for c in ("value", "left", "right")])
    # Both look back, one from either end: a frame that reaches forward would be summed up anew for each row.
    over = "OVER (PARTITION BY _key ORDER BY start{0}, IF(k >= 0, 0, 1){0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier, later = over.format(""), over.format(" DESC")
    beside = once.selectExpr("*", f"max(IF(k >= 0, end, NULL)) {earlier} AS _before", f"min(IF(k >= 0, start, NULL)) {later} AS _after")
    free = (F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))
    value = F.regexp_replace(F.lower("value"), r"[\s()\-/]", "")
    return beside.where((F.col("k") >= 0) | free).select(
        "_key", "start", "end", "k", F.col("value").alias("raw"), F.sha2(value, 256).alias("value"), patterns(F.col("left"), F.col("right")).alias("patterns")
    )


def discover(places: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(`value`, `k`) of the values that contexts gave away, and (`pattern`, `k`, `trust`) of the last round."""
    edges = stored(
        places.select(F.explode("patterns").alias("pattern"), "value", "raw", "k").groupBy("pattern", "value").agg(
            F.max("k").alias("seed"), F.first("raw").alias("raw")
        ),
        "edges",
    )
    open_edges = edges.where("seed < 0").select("pattern", "value", F.explode(F.array(*[
        F.when(suits(kind, F.col("raw")), F.lit(k)) for k, kind in enumerate(KINDS)
    ])).alias("k")).where("k IS NOT NULL")
    open_edges = stored(open_edges, "open-edges")
    seen = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = stored(places.where("k >= 0").select("value", "k").distinct(), "seeds")
    known, trusted = seeds, None
    for number in range(rounds):
        hit = spread_join(edges.select("pattern", "value"), known, "value", "pattern").groupBy("pattern", "k").agg(F.count(F.lit(1)).alias("hits"))
        trust = hit.where(F.col("hits") >= LEAST_KNOWN).join(seen, "pattern").withColumn("trust", F.col("hits") / (F.col("n") + 1))
        trusted = stored(trust.where(F.col("trust") >= PATTERN).select("pattern", "k", "trust"), "trusted")
        given = spread_join(open_edges.withColumnRenamed("k", "_k"), trusted, "pattern", "value").where("k = _k")
        score = given.groupBy("value", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")).where(F.col("score") >= VALUE)
        best = score.groupBy("value").agg(F.min(F.struct(-F.col("score"), F.col("k"))).alias("b")).select("value", "b.k")
        more = stored(best.join(seeds, "value", "left_anti"), f"known-{number}")
        before = 0 if number == 0 else known.count()
        known = seeds.unionAll(more)
        if number and known.count() == before or more.isEmpty():
            break
    return more, trusted


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id`, `base` and `more`: arrays of (start, k, end), `k` numbering `KINDS`; a row for each document."""
    scanned = stored(scan(docs), "scanned")
    places = stored(places_of(scanned.where("size(base) + size(rest) > 0")), "places")
    found, _ = discover(places, rounds)
    shape = functools.reduce(lambda a, b: a | b, [(F.col("_k") == k) & suits(kind, F.col("raw")) for k, kind in enumerate(KINDS)])
    extra = spread_join(places.where("k < 0").select("_key", "start", "end", "raw", "value"), found.withColumnRenamed("k", "_k"), "value", "_key").where(shape)
    per_text = extra.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", F.col("_k").alias("k"), "end"))).alias("more"))
    base = F.array_sort(F.transform("base", lambda h: F.struct(h["start"].alias("start"), h["k"].alias("k"), h["end"].alias("end"))))
    rows = scanned.select("_key", "doc_id", base.alias("base"), (F.size("rest") > 0).alias("_open"))
    # Rows without anything to find need no join, however many of them have one key.
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    joined = rows.where("_open").join(per_text, "_key", "left").withColumn("more", F.coalesce("more", none))
    plain = rows.where("NOT _open").withColumn("more", none)
    return joined.unionByName(plain).select("doc_id", "base", "more")


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the base spans, and all spans as text."""
    counts = [F.size(F.filter("base", functools.partial(lambda k, s: s["k"] == k, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_found"),
    )
