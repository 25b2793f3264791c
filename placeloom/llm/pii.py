"""Personal data: pattern spans, and terms that disclose them; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind.  On top, corpus co-occurrence tells which
words of a text with protected values (emails, addresses, cards or phones) reveal them.  A value stands for
several entities: itself (numbers by their digits), what it shares with others (local part and domain, first
three bytes, issuer, number but its last seven digits), and its class.  With documents counted,
``PMI(term; entity) = log2(n_both * N / (n_value * n_term))`` and ``disclosure = PMI / log2(N / n_value)``, 1
when the term never appears elsewhere.  ``n_both`` and ``n_value`` count distinct texts, so copies alone
support nothing; ``n_term`` and ``N`` count all documents.  Terms with disclosure of at least ``threshold`` and
``n_both >= support`` for a value itself, ``group_support`` for the wider entities, become spans of kind
``term`` wherever they stand in the entity's texts, unless they touch a base span.

Entities that the same texts hold reveal alike, so they are counted as one; a text of many values gives no more
pairs of entity and term than it has different company to share them with.  Spans carry places, never lines or
texts, and are numbered in stretches of about the square root of their number, so a line of any length and any
number of values is read in near-linear time and space.

Null texts are empty, empty tables give empty results, equal rows get equal spans, extra columns are ignored (or,
by ``sanitise``, carried along), whatever their names.  Places are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (pattern, what a text must hold).  A start inside a run of first characters can match only where an earlier one can, unless a match ended there.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[0-9]|[\x20-][0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
}
#: Terms whose counts are joined by broadcast; with more, by a shuffle.
MOST_TERMS = 500_000
SPACE = "[\\x20\\x09-\\x0D]+"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.expr("0") + F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")).try_cast("int"), F.when(F.length(F.ltrim(p, F.lit("0"))) == 0, F.lit(0)).otherwise(F.lit(999))) <= 255))
    if kind == "phone":
        return n.between(9, 15)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _pairs(kind: str) -> Column:
    """Of column t: (match, what stands before it since the last one); null where no match can be."""
    pattern, may = KINDS[kind]
    between, found = F.split("t", pattern, -1), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    return F.when(may(F.col("t")), pairs)


def _spans(pairs: str, kind: str, rank: int) -> Column:
    """Spans (start, rank, end, value) of one kind from its column of pairs: lengths added up, stretch by stretch."""
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)")
    n = F.size(pairs)
    step = F.ceil(F.sqrt(n)).cast("int")
    stretches = F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1)
    part = lambda i: F.slice(pairs, i * step + 1, step)
    length = lambda a, x: a + F.length(x["b"]) + F.length(x["m"])
    sums = F.transform(stretches, lambda i: F.aggregate(part(i), F.lit(0), length))
    begins = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def walk(a, x):
        start = a["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    walked = F.flatten(F.zip_with(stretches, F.slice(begins, F.lit(1), F.size(stretches)), lambda i, at: F.aggregate(part(i), F.struct(at.alias("at"), empty.alias("out")), walk, lambda a: a["out"])))
    return F.when(n > 0, F.filter(walked, lambda s: _valid(kind, s["value"]))).otherwise(empty)


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, row_key, t, base (spans by start and kind) and the columns ``keep`` as _k0, _k1, ..."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("t"), *kept)
    paired = rows.select("*", *(_pairs(k).alias(f"p_{k}") for k in KINDS))
    each = paired.select("*", *(_spans(f"p_{k}", k, i).alias(f"s_{k}") for i, k in enumerate(KINDS)))
    return each.select("doc_id", F.xxhash64("doc_id", "t").alias("row_key"), "t", F.sort_array(F.concat(*(f"s_{k}" for k in KINDS))).alias("base"), *(f"_k{i}" for i in range(len(keep))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_TERMS + 1).count() <= MOST_TERMS else df


def _entities(kind: int, value: Column) -> Column:
    """What the values of a kind share with others: names of the value itself, in front of which stands 1, its groups and its class, 0.

    They are strings, as distinct ones of an array are told by hashing only then.
    """
    value, digits = F.lower(value), F.regexp_replace(value, "[^0-9]", "")
    name = lambda part, x: F.concat(F.lit(f"{int(part == 'value')}{list(KINDS)[kind]} {part} "), x)
    own, groups = {
        "email": (value, {"local": F.substring_index(value, "@", 1), "domain": F.substring_index(value, "@", -1)}),
        "ip": (value, {"net": F.substring_index(value, ".", 3)}),
        "card": (digits, {"issuer": F.substring(digits, 1, 6)}),
        "phone": (digits, {"prefix": F.substring(digits, F.lit(1), F.length(digits) - 7)}),
    }[list(KINDS)[kind]]
    wider = [name(g, x) for g, x in groups.items()] + [name("class", F.lit(""))]
    return F.array(name("value", own), *wider)


def find_pii(docs: DataFrame, support: int = 2, threshold: float = 0.9, group_support: int = 10) -> DataFrame:
    """Per row: doc_id, row_key, base (array of spans) and terms (array of (start, end))."""
    docs = docs.select("doc_id", "text")
    of_kind = lambda s: F.when(s["rank"] == 0, _entities(0, s["value"])).when(s["rank"] == 1, _entities(1, s["value"])).when(s["rank"] == 2, _entities(2, s["value"])).otherwise(_entities(3, s["value"]))
    private = F.size("base") > 0
    found = staged(base_spans(docs).select("doc_id", "row_key", F.when(private, F.xxhash64("t")).alias("text_key"), "base", F.when(private, F.col("t")).alias("t")))
    texts = staged(found.where(private).dropDuplicates(["text_key"]).select("text_key", "t", "base", F.array_distinct(F.flatten(F.transform("base", of_kind))).alias("entities")))
    total = docs.count()
    # Distinct texts per entity; entities of the same texts, told by two hashes of these, are one.
    held = texts.select("text_key", F.explode("entities").alias("entity")).withColumn("own", F.col("entity").startswith("1"))
    need = F.when(F.col("own"), support).otherwise(group_support)
    of_texts = (F.bit_xor(F.xxhash64("text_key")).alias("a"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("b"))
    known = held.groupBy("entity", "own").agg(F.count("*").alias("n_value"), *of_texts).where(F.col("n_value") >= need)
    known = staged(known.select("entity", "own", F.struct("n_value", "a", "b").alias("who"), "n_value"))
    held = staged(held.join(_small(known), ["entity", "own"]).groupBy("text_key", "who").agg(F.bool_or("own").alias("own"), F.first("n_value").alias("n_value")))
    judged = held.groupBy("text_key").agg(F.collect_list(F.struct("who", "own", "n_value")).alias("judged"))
    each = texts.select("text_key", "t").join(judged, "text_key").select(F.explode(F.array_distinct(F.array_remove(F.split("t", SPACE), ""))).alias("term"), "judged")
    both = each.select("term", F.explode("judged").alias("e")).select("term", "e.*").groupBy("who", "n_value", "term").agg(F.bool_or("own").alias("own"), F.count("*").alias("n_both"))
    both = staged(both.where(F.col("n_both") >= need))
    terms = _small(both.select("term").distinct())
    counts = docs.select(F.explode(F.array_distinct(F.array_remove(F.split("text", SPACE), ""))).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_value") * F.col("n_term")))
    risky = staged(both.join(counts, "term").where(pmi >= threshold * F.log2(F.lit(float(total)) / F.col("n_value"))).where(pmi > 0).select("who", "term"))
    # Places of the risky terms in their texts: running sums over words and the white space before them.
    flagged = held.join(_small(risky.select("who").distinct()), "who", "left_semi").groupBy("text_key").agg(F.collect_set("who").alias("flagged"))
    words = texts.select("text_key", "t").join(flagged, "text_key").select("text_key", "flagged", F.posexplode(F.arrays_zip(F.split("t", "[^\\x20\\x09-\\x0D]+", -1).alias("gap"), F.concat(F.regexp_extract_all("t", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.array(F.lit(""))).alias("word"))))
    words = words.select("text_key", "flagged", "pos", F.coalesce(F.length("col.gap"), F.lit(0)).alias("gap"), F.col("col.word").alias("term"))
    run = W.partitionBy("text_key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = words.withColumn("end", F.sum(F.col("gap") + F.length("term")).over(run))
    spans = placed.join(_small(risky), "term").where(F.array_contains("flagged", F.col("who"))).select("text_key", (F.col("end") - F.length("term")).cast("int").alias("start"), F.col("end").cast("int").alias("end")).distinct()
    # Those that touch no base span: none that begins at or before ends past their start, none that begins later does so before their end.
    told = texts.join(_small(flagged.select("text_key")), "text_key", "left_semi").select("text_key", F.explode("base").alias("b")).select("text_key", "b.start", "b.end", F.lit(True).alias("base"))
    order = lambda by: W.partitionBy("text_key").orderBy(by)
    met = spans.withColumn("base", F.lit(False)).unionByName(told).withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(order(F.asc("start")))).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(order(F.desc("start"))))
    spans = met.where("not base and coalesce(reach <= start, true) and coalesce(next >= end, true)")
    terms_of = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("terms"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    rows_of = found.where(private).select("row_key", "text_key").dropDuplicates(["row_key"]).join(terms_of, "text_key").select("row_key", "terms")
    return found.select("doc_id", "row_key", "base").join(rows_of, "row_key", "left").select("doc_id", "row_key", "base", F.coalesce("terms", none).alias("terms"))


def pii_report(docs: DataFrame, support: int = 2, threshold: float = 0.9) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    kinds = F.array(*map(F.lit, KINDS))
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end")))
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))), terms))
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return find_pii(docs, support, threshold).select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.size("terms").cast("long").alias("n_term"), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, support: int = 2, threshold: float = 0.9) -> DataFrame:
    """``docs`` with base spans generalised to their kind, as ``[EMAIL]``, and disclosing terms removed; where spans overlap, the first to start (the longest of those) stands."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = F.sort_array(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.get(kinds, s["rank"]).alias("label"))), F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit("").alias("label")))))
    found = find_pii(docs, support, threshold).where("size(base) > 0").dropDuplicates(["row_key"]).select("row_key", spans.alias("spans"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("row_key")).join(found, "row_key", "left")
    # What stays lies between the furthest end of the spans before and the next span.  Stretch by stretch: ends so far,
    # then the pieces (from, to, label), then their text, cut from that of the stretch.
    n = F.size("spans")
    step = F.ceil(F.sqrt(n)).cast("int")
    part = lambda c, i: F.slice(c, i * F.col("step") + 1, F.col("step"))
    keyed = keyed.withColumn("step", F.when(n > 0, step)).withColumn("stretches", F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / F.col("step")).cast("int") - 1)))
    furthest = F.transform("stretches", lambda i: F.array_max(F.transform(part(F.col("spans"), i), lambda s: -s["back"])))
    keyed = keyed.withColumn("reach", F.aggregate(furthest, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x)))))

    def walk(a, s):
        fresh = s["start"] >= a["at"]
        piece = F.array(F.struct(a["at"].alias("from"), s["start"].alias("to"), s["label"].alias("label")))
        return F.struct(F.greatest(a["at"], -s["back"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    empty = F.expr("cast(array() as array<struct<from:int,to:int,label:string>>)")
    walked = F.zip_with("stretches", F.slice("reach", F.lit(1), F.size("stretches")), lambda i, at: F.aggregate(part(F.col("spans"), i), F.struct(at.alias("at"), empty.alias("out")), walk, lambda a: a["out"]))
    keyed = keyed.withColumn("pieces", F.filter(walked, lambda p: F.size(p) > 0))
    text = F.col("row.text")
    whole = lambda p: F.struct(p.alias("p"), F.get(p, F.lit(0))["from"].alias("at"), F.substring(text, F.get(p, F.lit(0))["from"] + 1, F.element_at(p, -1)["to"] - F.get(p, F.lit(0))["from"]).alias("t"))
    keyed = keyed.withColumn("cut", F.transform("pieces", whole))
    said = F.transform("cut", lambda c: F.array_join(F.transform(c["p"], lambda x: F.concat(F.substring(c["t"], x["from"] - c["at"] + 1, x["to"] - x["from"]), x["label"])), ""))
    new = F.concat(F.array_join(said, ""), F.substring(text, F.element_at("reach", -1) + 1, F.length(text)))
    return keyed.select(F.col("row").withField("text", F.when(n > 0, new).otherwise(text)).alias("row")).select("row.*")
