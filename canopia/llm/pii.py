"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Four fixed patterns give base spans; these are the seeds. The one or two words
before an identifier are its lexical patterns. Spark scores the bipartite graph
of patterns and instances in rounds: a pattern's confidence for a kind is the
share of its distinct instances that are of that kind (weighted by the
instances' scores), an unknown identifier's score is the mean confidence of its
patterns, and confident instances count in the next round, also for patterns that
have no seed of their own. Patterns of high confidence and support then mark the
unknown identifiers after them (any token with a digit or an at sign), if their
shape suits the kind. Base spans are never changed.

Texts are read once; positions, contexts and values are all that is kept.
Regular expressions have no repeated groups and start only where a run starts,
so no text overflows a stack or takes quadratic time. A character U+0001 in a
text is treated as U+0002, which no pattern names.

Defined results: null and empty texts have no spans; very long texts are read
whole, in time near their length; an identifier that equally confident patterns
mark as two kinds is of the later one by name; repeated rows each give a row with the same
spans; a row without doc_id keeps its base spans and gains none; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import cut, table

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances (by score) and share of them that make a pattern confident; scoring ends when no pattern's confidence moves by SETTLED, or after so many.
SUPPORT, CONFIDENCE, ROUNDS, SETTLED = 4.0, 0.6, 50, 0.01
#: The last two words of a text turned round, whatever their length.
LAST_WORDS = r"^\s*+\S*+\s*+\S*+"
#: Values that are folded one by one before blocks are joined.
BLOCK = 64

_MARK = "\x01"
_LOCAL = r"[A-Za-z0-9._%+\x01-]"
_LABEL = r"[A-Za-z0-9-]"
#: The contract's patterns on texts in which joining separators are marked (dots of a domain; separators in a number).
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Identifier-like tokens that may be of a kind unseen by the base patterns.
UNKNOWN = r"(?:(?<![A-Za-z0-9._:@+-])|\G)(?:[+(]?[0-9][0-9() ./-]{4,}(?<=[0-9])(?![A-Za-z0-9@:])|(?=[A-Za-z._:/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._:/-]{3,}(?<=[A-Za-z0-9])(?![A-Za-z0-9@]))"
UNKNOWN_AT = r"(?:(?<![A-Za-z0-9._%+@-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
SPAN = "array<struct<start:int,end:int,value:string,left:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op) -> Column:
    """Running results of an associative op over an array of longs.

    Blocks of BLOCK values are folded on their own, then shifted by what is
    before them, so the work is near the array's length and not its square.
    """
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.when(acc["last"].isNull(), x).otherwise(op(acc["last"], x))
        return F.struct(own.alias("last"), F.concat(acc["out"], F.array(own)).alias("out"))

    def fold(block: Column) -> Column:
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        return _let(
            fold(F.transform(blocks, lambda x: F.element_at(x, -1))),
            lambda upto: F.flatten(F.transform(blocks, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: op(F.element_at(upto, i), y))))),
        )

    def dealt(all_: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return _let(F.transform(number, lambda k: fold(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))), joined)

    return F.when(F.size(values) > 0, _let(values, dealt)).otherwise(F.array().cast("array<bigint>"))


def _found(text: Column, pattern: str, valid=None) -> Column:
    """Spans of the pattern's matches in text, from the lengths of the pieces between them; `valid` takes a match."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def spans(both: Column) -> Column:
        steps = F.transform(both["match"], lambda m, i: (F.length(m) + F.length(F.get(both["piece"], i))).cast("long"))
        ends = _running(steps, lambda x, y: x + y)
        # the words before, back to the last but one match: a place in a long text is far from its start
        lefts = F.transform(both["match"], lambda m, i: F.reverse(F.regexp_extract(F.reverse(F.concat(F.coalesce(F.get(both["match"], i - 1), F.lit("")), F.get(both["piece"], i))), LAST_WORDS, 0)))
        return F.zip_with(F.arrays_zip(ends.alias("e"), lefts.alias("l")), both["match"], lambda x, m: F.struct((x["e"] - F.length(m)).cast("int").alias("start"), x["e"].cast("int").alias("end"), m.alias("value"), x["l"].alias("left")))

    found = _let(F.struct(pieces.alias("piece"), matches.alias("match")), lambda both: F.when(F.size(both["match"]) > 0, spans(both)).otherwise(F.array().cast(SPAN)))
    return F.filter(found, lambda s: valid(s["value"])) if valid is not None else found


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = _digits(match)
    n = F.length(d)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * (F.lit(1) + (n - i) % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)


def _unmarked(text: Column) -> Column:
    return F.translate(text, _MARK, "\x02")


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with an array of spans for each kind, and `unknown`."""
    text = F.col("text")
    numbers = text.rlike("[0-9]")
    domain = F.regexp_replace(_unmarked(text), rf"(?<={_LABEL})\.(?={_LABEL})", _MARK)
    joined = F.regexp_replace(_unmarked(text), r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
    return docs.select(
        "doc_id",
        "text",
        _when(F.contains(text, F.lit("@")), _found(domain, EMAIL)).alias("email"),
        _when(numbers & F.contains(text, F.lit(".")), _found(text, IP, lambda m: m.rlike(OCTETS))).alias("ip"),
        _when(numbers, _found(joined, CARD, lambda m: (F.length(m) >= 16) & _luhn(m))).alias("card"),
        _when(F.contains(text, F.lit("+")), _found(text, PHONE, lambda m: F.length(_digits(m)).between(8, 15))).alias("phone"),
        F.concat(_when(numbers, _found(text, UNKNOWN)), _when(F.contains(text, F.lit("@")), _found(text, UNKNOWN_AT))).alias("unknown"),
    )


def _clear_of(spans: Column, known: Column) -> Column:
    """The spans that overlap none of the known ones.

    All are put in order, a known one at its start and a span at its end; a span
    is clear if no known end before it lies beyond its start.
    """
    events = F.array_sort(
        F.concat(
            F.transform(known, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("turn"), s["end"].cast("long").alias("top"), F.lit(None).cast(SPAN[6:-1]).alias("span"))),
            F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("turn"), F.lit(-1).cast("long").alias("top"), s.alias("span"))),
        )
    )

    def clear(ordered: Column) -> Column:
        tops = _running(F.transform(ordered, lambda e: e["top"]), lambda x, y: F.greatest(x, y))
        kept = F.filter(F.arrays_zip(ordered.alias("e"), tops.alias("t")), lambda x: x["e"]["span"].isNotNull() & (x["t"] <= x["e"]["span"]["start"]))
        return F.transform(kept, lambda x: x["e"]["span"])

    return F.when((F.size(spans) == 0) | (F.size(known) == 0), spans).otherwise(_let(events, clear))


def _with_context(spans: Column, kind: str | None) -> Column:
    """Spans with their kind, a hash of their value and the words before them, as normalised patterns."""

    def one(s: Column) -> Column:
        left = F.regexp_replace(F.lower(F.translate(s["left"], _MARK, " ")), "[0-9]+", "0")
        last = F.regexp_extract(left, r"(\S*\p{L}\S*)\s+$|(\S*\p{L}\S*[:=#(\"'])$", 0)
        two = F.regexp_extract(left, r"\S+\s+\S*\p{L}\S*\s+$|\S+\s+\S*\p{L}\S*[:=#(\"']$", 0)
        colons = F.length(s["value"]) - F.length(F.replace(s["value"], F.lit(":"), F.lit("")))
        shape = F.when(F.contains(s["value"], F.lit("@")), "at").when(colons >= 2, "colons").otherwise(F.length(_digits(s["value"])).cast("string"))
        contexts = F.filter(F.array(F.btrim(last), F.concat(F.lit("2 "), F.btrim(two))), lambda c: F.length(c) > 2)
        return F.struct(F.lit(kind).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value"), shape.alias("shape"), contexts.alias("contexts"))

    return F.transform(spans, one)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, base, unknown): spans with contexts, a row per row of docs; same tells texts of one doc_id apart."""
    found = base_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    known = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    free = found.withColumn("unknown", _clear_of(F.col("unknown"), known))
    return free.select("doc_id", F.xxhash64("text").alias("same"), F.concat(*[_with_context(F.col(k), k) for k in KINDS]).alias("base"), _with_context(F.col("unknown"), None).alias("unknown"))


def _suits(kind: Column, shape: Column) -> Column:
    """Whether an unknown identifier's shape (its number of digits, 'at', or 'colons') may be of the kind."""
    n = F.coalesce(shape.try_cast("int"), F.lit(0))
    return ((kind == "email") & (shape == "at")) | ((kind == "phone") & n.between(7, 15)) | ((kind == "card") & n.between(12, 19)) | ((kind == "ip") & ((shape == "colons") | n.between(4, 12)))


def patterns(found: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, conf) of the confident patterns after the rounds of scoring; found as from `occurrences`."""
    rows = found.select(F.explode(F.concat("base", "unknown")).alias("o")).select("o.value", "o.kind", "o.shape", F.explode("o.contexts").alias("context"))
    edges = cut(rows.groupBy("context", "value").agg(F.max("kind").alias("kind"), F.max("shape").alias("shape")))
    totals = edges.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= support)  # fewer never make a pattern
    seeds = edges.where("kind IS NOT NULL").groupBy("value").agg(F.max("kind").alias("of"), F.lit(1.0).alias("score"))
    totals, seeds = cut(totals), cut(seeds)
    scored, best = seeds, None
    for _ in range(rounds):
        before = best
        sums = edges.select("context", "value").join(scored, "value").groupBy("context", "of").agg(F.sum("score").alias("weight"))
        best = sums.join(totals, "context").withColumn("conf", F.col("weight") / F.col("n")).where((F.col("weight") >= support) & (F.col("conf") >= confidence))
        best = cut(best.select("context", F.col("of").alias("kind"), "conf"))
        if before is not None:
            moved = best.join(before.withColumnRenamed("conf", "was"), ["context", "kind"], "full").where(F.abs(F.coalesce("conf", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) >= SETTLED)
        if (best if before is None else moved).isEmpty():
            break
        known = best.select("context", F.col("kind").alias("of"), "conf")
        fresh = edges.where("kind IS NULL").select("context", "value", "shape").join(known, "context").where(_suits(F.col("of"), F.col("shape")))
        grown = fresh.groupBy("value", "of").agg(F.avg("conf").alias("score")).where(F.col("score") >= confidence)
        scored = cut(seeds.unionByName(grown.select("value", "of", "score")))
    return best


def discovered(found: DataFrame, best: DataFrame) -> DataFrame:
    """(doc_id, same, kind, start, end) of unknown identifiers that a confident pattern marks; the most confident kind wins."""
    rows = found.where("doc_id IS NOT NULL").select("doc_id", "same", F.explode("unknown").alias("o")).select("doc_id", "same", "o.start", "o.end", "o.shape", F.explode("o.contexts").alias("context"))
    marked = rows.join(best, "context").where(_suits(F.col("kind"), F.col("shape")))
    return marked.groupBy("doc_id", "same", "start", "end").agg(F.max(F.struct("conf", "kind"))["kind"].alias("kind"))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added), arrays of (kind, start, end), a row per row of docs."""
    found = cut(occurrences(docs, id_col, text_col))
    new = discovered(found, patterns(found)).groupBy(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    plain = found.select("doc_id", "same", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    joined = plain.join(cut(new), (F.col("doc_id") == F.col("_id")) & (F.col("same") == F.col("_same")), "left")
    return joined.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: personal data of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))
