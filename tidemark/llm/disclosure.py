"""Personal data: found by pattern, and sanitised by what nearby terms disclose about it.

Protected entities are the e-mail and IP addresses, payment cards and phone numbers in the texts (the base kinds).
Removing a mention isn't enough where the words around it give the entity away, so the corpus tells how much they
do. With p(e) the share of documents that mention entity e, p(t) the share with term t, and p(e, t) the share in which
t stands beside a mention of e, what t discloses about e is PMI(e; t) / IC(e), with
PMI = log p(e, t) / (p(e) p(t)) and IC = -log p(e): 0 if t says nothing about e, 1 if e always comes with t.
A term stands beside the mentions next to it, however far off: a mention's context goes on either side to the next match of its
kind or the end of the text, so every position of a text with a mention is looked at.
All three are counted over all documents. A pair that stands in fewer than MIN_SUPPORT different texts is no evidence,
however often those texts are copied.

In a document that mentions e, the terms beside the mention that disclose THRESHOLD or more are generalised
to their first three letters, if that prefix (counted like a term) discloses less; else to their first letter, if that does;
else they are removed. Of several entities the strictest treatment counts. Documents without a mention stay as they are.

Everything is Spark's own functions. Patterns are written so that each text is read in linear time
and without recursion: they match what the plain patterns match, but start only where a run
of their characters starts (or where the last match ended), and don't give characters back. Only texts with
a mention are shuffled; terms are counted in one pass over the texts, and aggregated before they are shuffled. What one document yields is gathered in one row.

Defined results: a null text counts as empty; a text without mentions has no spans (digest of the empty string); every row, also
one that repeats an id or has none, gets a row; an entity in every document has no information content and
nothing discloses it; an empty table gives no rows. Equal starts are listed in the order of KINDS. Other columns are ignored.
Rebuilding a text costs its length times its number of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, table

#: Kinds in the order in which equal starts are listed; ``term`` is what the disclosure adds.
KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
_LETTERS = r"[\p{L}\p{M}]++"

#: Code points on either side of a mention that are looked at: all of them; letters of the shortest term.
NEAR, MIN_LETTERS = 1 << 30, 3
#: Different texts in which a pair must stand; share of an entity's information from which a term is treated.
MIN_SUPPORT, THRESHOLD = 5, 0.8
#: Letters kept by the two generalisations.
PREFIXES = (3, 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)])
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                        lambda acc, i: acc + F.when(i % 2 == 0, F.get(doubled, value(i))).otherwise(value(i)))
    return total % 10 == 0


def _has(kind: int) -> Column:
    found = F.col("text").rlike(PATTERNS[kind])
    return F.contains("text", F.lit("@")) & found if kind == 0 else found


def _matches(kind: int) -> Column:
    """Every match of a kind with the length of the gap before it and the text on either side."""
    m, gaps = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)), F.split("text", PATTERNS[kind], -1)
    n = F.size(m)
    return F.when(_has(kind), F.arrays_zip(
        m.alias("match"), F.slice(F.transform(gaps, F.length), F.lit(1), n).alias("gap"),
        F.slice(gaps, F.lit(1), n).alias("left"), F.slice(gaps, F.lit(2), n).alias("right")))


def mentions(rows: DataFrame) -> DataFrame:
    """row, digest, kind, start, end, entity, left and right of every valid match; ``rows`` has row, digest and text."""
    by_kind = F.array(*[F.struct(F.lit(k).alias("kind"), _matches(k).alias("found")) for k in range(TERM)])
    raw = rows.select("row", "digest", F.inline(F.filter(by_kind, lambda x: F.size(x["found"]) > 0))) \
        .select("row", "digest", "kind", F.posexplode("found").alias("nth", "m")).select("row", "digest", "kind", "nth", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    raw = raw.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto)) \
        .withColumn("start", F.col("end") - F.length("match")).withColumn("digits", F.regexp_replace("match", "[^0-9]", ""))
    kind, size = F.col("kind"), F.length("digits")
    valid = F.when(kind == 1, F.col("match").rlike(_OCTETS)).when(kind == 2, luhn(F.col("digits"))) \
        .when(kind == 3, size.between(10, 15)).otherwise(True)
    value = F.when(kind == 0, F.lower("match")).when(kind == 1, F.col("match")).otherwise(F.col("digits"))
    return raw.where(valid).select("row", "digest", "kind", "start", "end", F.concat(kind.cast("string"), value).alias("entity"), "left", "right")


def beside(found: DataFrame) -> DataFrame:
    """row, digest, entity and each different term beside a mention."""
    words = F.transform(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(_LETTERS), F.lit(0)) for c in ("left", "right")])), F.lower)
    return found.select("row", "digest", "entity", F.explode(F.array_distinct(F.filter(words, lambda t: F.length(t) >= MIN_LETTERS))).alias("term"))


def placed(found: DataFrame) -> DataFrame:
    """row, entity, term and place (t_start, t_end) of every term beside a mention."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), at.alias("base"), F.col(c).alias("ctx"))
                      for k, (c, at) in enumerate((("left", F.col("start") - F.length("left")), ("right", F.col("end"))))])
    words, gaps = F.regexp_extract_all("ctx", F.lit(_LETTERS), F.lit(0)), F.split("ctx", _LETTERS, -1)
    each = found.select("row", "entity", "kind", "start", F.inline(sides)) \
        .select("row", "entity", "kind", "start", "side", "base", F.posexplode(
            F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(1), F.size(words)).alias("g"))).alias("nth", "x"))
    upto = Window.partitionBy("row", "kind", "start", "side").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("t_end", F.col("base") + F.sum(F.length("x.g") + F.length("x.w")).over(upto))
    return each.select("row", "entity", F.lower("x.w").alias("term"), (F.col("t_end") - F.length("x.w")).alias("t_start"), "t_end") \
        .where(F.length("term") >= MIN_LETTERS)


def _keys(terms: Column) -> Column:
    """Terms and their prefixes as counted keys: the number of letters kept (0: all) before the letters."""
    def cut(k: int) -> Column:
        return F.array_distinct(F.transform(terms, lambda t: F.concat(F.lit(str(k)), F.left(t, F.lit(k)))))

    return F.concat(F.transform(terms, lambda t: F.concat(F.lit("0"), t)), *[cut(k) for k in PREFIXES])


def document_counts(texts: DataFrame) -> DataFrame:
    """key and the number of documents with such a term, over all texts."""
    terms = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0))), lambda t: F.length(t) >= MIN_LETTERS)
    return texts.select(F.explode(_keys(terms)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_term"))


def _counted(pairs: DataFrame, *by: str) -> DataFrame:
    """Documents (n) and different texts (support) of each group; rows of one digest are one text."""
    each = pairs.select(*by, "digest", "row").distinct().groupBy(*by, "digest").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= MIN_SUPPORT)


def disclosures(near: DataFrame, found: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """entity, key and what the key discloses, of all pairs with support. ``near`` has entity, term, digest and row."""
    entities = _counted(found, "entity").select("entity", F.col("n").alias("n_entity"))
    pairs = near.join(entities.select("entity"), "entity", "left_semi") \
        .select("entity", "digest", "row", F.explode(_keys(F.array("term"))).alias("key"))
    pairs = _counted(pairs, "entity", "key").select("entity", "key", F.col("n").alias("n_pair"))
    content = -F.log2(F.col("n_entity") / n_docs)
    return pairs.join(document_counts(texts), "key").join(entities, "entity").select(
        "entity", "key", F.when(F.col("n_entity") < n_docs, 1 + F.log2(F.col("n_pair") / F.col("n_term")) / content)
        .otherwise(0.0).alias("disclosure"))


def treatments(told: DataFrame) -> DataFrame:
    """entity, term and level of the terms to treat: 1 and 2 are the generalisations, 3 is removal."""
    split = told.select("entity", "disclosure", F.substring("key", 1, 1).alias("cut"), F.expr("substring(key, 2)").alias("letters"))
    out = split.where((F.col("cut") == "0") & (F.col("disclosure") >= THRESHOLD)).select("entity", F.col("letters").alias("term"))
    for k in PREFIXES:
        out = out.withColumn("letters", F.left("term", F.lit(k))) \
            .join(split.where(F.col("cut") == str(k)).select("entity", "letters", F.col("disclosure").alias(f"d{k}")), ["entity", "letters"], "left") \
            .drop("letters")
    first, second = [F.coalesce(F.col(f"d{k}") < THRESHOLD, F.lit(False)) for k in PREFIXES]
    return out.select("entity", "term", F.when(first, 1).when(second, 2).otherwise(3).alias("level"))


def _sanitised() -> Column:
    """The text with every span replaced; of overlapping spans, the first one's replacement stands for both."""
    text = F.col("text")

    def add(acc: Column, s: Column) -> Column:
        kept = F.when(s["start"] > acc["upto"], F.substring(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int"))).otherwise("")
        prefix = F.substring(text, (s["start"] + 1).cast("int"), F.when(s["level"] == 1, PREFIXES[0]).otherwise(PREFIXES[1]))
        new = F.when(s["kind"] < TERM, F.concat(F.lit("["), F.upper(_name(s)), F.lit("]"))) \
            .when(s["level"] < 3, F.concat(prefix, F.lit("*"))).otherwise("[...]")
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"),
                        F.concat(acc["out"], kept, F.when(s["start"] >= acc["upto"], new).otherwise("")).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("upto"), F.lit("").alias("out"))
    return F.aggregate("spans", begin, add, lambda acc: F.concat(acc["out"], F.substring(text, (acc["upto"] + 1).cast("int"), F.length(text))))


def _name(s: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])


def sanitise(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """doc_id, the text sanitised, and its spans (start, kind, end, level), for every row.

    Places are code points of the given text, ends exclusive; kind is a place in KINDS; level is that of ``treatments``, 0 for base kinds.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    some = _has(0)
    for k in range(1, TERM):
        some = some | _has(k)
    rows = scratch.write(rows.withColumn("some", some), "rows")
    dirty = rows.where("some")
    found = scratch.write(mentions(dirty.withColumn("digest", F.md5("text"))), "mentions")
    told = scratch.write(disclosures(beside(found), found, rows, rows.count()), "told")
    treated = scratch.write(treatments(told), "treated")
    terms = placed(found.join(treated.select("entity"), "entity", "left_semi")).join(treated, ["entity", "term"]).groupBy("row", "t_start", "t_end").agg(F.max("level").alias("level")) \
        .select("row", F.struct(F.col("t_start").alias("start"), F.lit(TERM).alias("kind"), F.col("t_end").alias("end"), "level").alias("span"))
    base = found.select("row", F.struct("start", "kind", "end", F.lit(0).alias("level")).alias("span"))
    spans = base.unionByName(terms).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    kind = spans.schema["spans"].dataType.simpleString()
    none = F.expr(f"cast(array() as {kind})")
    out = dirty.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
    return out.select("doc_id", _sanitised().alias("text"), "spans") \
        .unionByName(rows.where("not some").select("doc_id", "text", none.alias("spans")))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s), s["start"], s["end"])), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, all spans, and the sanitised text's digest, of every document."""
    out = sanitise(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(TERM)],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < TERM)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count(TERM).alias("n_term"), F.sha2("text", 256).alias("sanitised_sha256"))
