r"""Personal data: base patterns, and words that give protected values away, by what the corpus says about them together.

Emails, addresses, card and phone numbers are found by patterns; their values
are the protected entities.  A word t near entities e discloses

    PMI(e; t) / IC(e) = 1 - log(c(t) / c(t, e)) / log(N / c(e))

of what there is to know about e: all of it if t occurs only near e, and none
if it occurs near e as often as elsewhere.  c counts documents; near is the
same piece of text between two values of a kind, REACH characters to either
side.  Words that disclose at least ``DISCLOSES`` of an entity, seen with it in
``LEAST_TEXTS`` different texts, are spans of their own.  In a sanitised text
values and words that disclose at least ``REMOVES`` go, other disclosing words
give way to their class.

Everything is DataFrame operations.  Places come from the pieces between
matches, summed in blocks, so that a text with very many matches stays cheap.
Texts take part in no shuffle: what is exchanged are words near entities, the
documents that such words occur in, and places.

Cases: null texts count as empty and have no span; repeated documents count
repeatedly in c and each get their row, but as one text in ``LEAST_TEXTS``;
rows that repeat an id with unlike texts are told apart by their texts; runs of
thousands of digits, labels or dots are matched without recursion and in linear
time; touching values are each found; a corpus without entities has base spans
alone, none; an empty table gives none; other columns are ignored by
``find_spans`` and stay in ``sanitised``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import bounded_broadcast, written

#: Share of an entity's information from which a word is a span, and from which it is removed.
DISCLOSES, REMOVES = 0.9, 0.97
#: Different texts in which a word must be near an entity; characters to either side that are near.
LEAST_TEXTS, REACH = 3, 80
#: Words that can be terms: letters, as many or more.
TERM = r"(?<!\p{L})\p{L}{4,}"
#: Rows of a block of running sums.
SUM_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A base kind: its pattern, what every text with a match contains, and which matches count."""

    name: str
    pattern: str
    hint: str

    def holds(self, match: Column) -> Column:
        digits = F.regexp_replace(match, "[^0-9]", "")
        if self.name == "ip":
            return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$")
        if self.name == "card":
            return F.length(digits).between(12, 19) & (luhn(digits) % 10 == 0)
        if self.name == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)


# The contract's patterns, with possessive repeats, which change no match: what follows a repeat is never part of it.
# A match begins where no earlier place could have begun it: behind another character, or where the last match ended.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "."),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
_NAMES = tuple(k.name for k in KINDS)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a text of digits, cut to 19."""
    d = F.reverse(F.substring(digits, 1, 19))
    each = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """Sums of an array of whole numbers before each of its places; in blocks, so that no long array is copied for each place."""
    zero = F.lit(0).cast("long")

    def up(values: Column, first: Column) -> Column:
        """The sums before each place, from ``first`` on, and that of all."""
        return F.aggregate(values, F.array(first), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def summed(s: Column) -> Column:
        count = F.floor((F.size(s) + SUM_BLOCK) / SUM_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(s, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
        firsts = lambda x: up(F.transform(x, lambda b: F.aggregate(b, zero, lambda a, y: a + y)), zero)
        each = let(blocks, lambda x: F.zip_with(x, F.slice(firsts(x), 1, F.size(x)), lambda b, first: F.slice(up(b, first), 1, F.size(b))))
        return F.flatten(each)

    return let(sizes, summed)


def placed(pieces: Column, matches: Column, near: bool = False) -> Column:
    """(start, end, value) of matches in code points, from the pieces around them; with ``near`` also their nearest characters, left and right."""
    between = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.slice(pieces, 2, F.size(matches)), lambda p, q: F.struct(F.length(p).cast("long").alias("p"), *([_end_of(p).alias("left"), _begin_of(q).alias("right")] if near else [])))
    both = F.zip_with(between, matches, lambda x, m: F.struct(x.alias("x"), F.length(m).cast("long").alias("m"), m.alias("value")))

    def at(all_: Column) -> Column:
        sums = running(F.transform(all_, lambda y: y.x.p + y.m))
        sides = lambda y: [y.x.left.alias("left"), y.x.right.alias("right")] if near else []
        return F.zip_with(sums, all_, lambda s, y: F.struct((s + y.x.p).alias("start"), (s + y.x.p + y.m).alias("end"), y.value.alias("value"), *sides(y)))

    return let(both, at)


def _base(documents: DataFrame) -> DataFrame:
    """``text`` (never null) with ``found_<kind>``: (start, end, value, left, right), the pieces' nearest characters among them."""
    d = documents
    for k in KINDS:
        text = F.when(F.contains("text", F.lit(k.hint)) if k.hint else F.col("text").rlike("[0-9]"), F.col("text"))
        d = d.withColumn("_m", F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)))
        d = d.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", k.pattern)))
        found = F.filter(placed(F.col("_p"), F.col("_m"), near=True), lambda x: k.holds(x.value))
        d = d.withColumn(f"found_{k.name}", F.when(F.size("_m") > 0, found)).drop("_m", "_p")
    return d


def _end_of(piece: Column) -> Column:
    """The last REACH characters, without a word that is cut off."""
    return F.when(F.length(piece) > REACH, F.regexp_replace(F.right(piece, F.lit(REACH)), r"^[^\x20\x09-\x0D]*+", "")).otherwise(piece)


def _begin_of(piece: Column) -> Column:
    return F.when(F.length(piece) > REACH, F.regexp_replace(F.left(piece, F.lit(REACH)), r"[^\x20\x09-\x0D]*+$", "")).otherwise(piece)


def _texts(documents: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return documents.select(*others, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def base_spans(documents: DataFrame, text_col: str = "text", *others: Column) -> DataFrame:
    """``others``, ``key`` (of the text) and per kind an array of (start, end, value, left, right)."""
    return _base(_texts(documents, text_col, *others)).withColumn("key", F.xxhash64("text"))


def words_of(text: Column) -> Column:
    """The distinct words of a text that can be terms, lower-cased, without those inside emails."""
    said = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, KINDS[0].pattern, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(said), F.lit(TERM), F.lit(0)))


def disclosing_terms(documents: DataFrame, text_col: str = "text", discloses: float = DISCLOSES, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(term, disclosure): words that disclose entities, with the largest share that they disclose of one."""
    based = base_spans(documents, text_col)
    one = lambda k: F.transform(f"found_{k.name}", lambda x: F.struct(F.concat(F.lit(f"{k.name}:"), F.lower(x.value)).alias("entity"), F.concat_ws(" ", x.left, x.right).alias("near")))
    none = F.array().cast("array<struct<entity:string,near:string>>")
    # Outer, so that Spark infers no filter, which would find everything twice.
    seen = based.select("key", F.explode_outer(F.concat(*[F.coalesce(one(k), none) for k in KINDS])).alias("x")).filter("x IS NOT NULL")
    # Documents with one text are one row with their number.
    near = seen.select("key", F.xxhash64("x.entity").alias("entity"), F.explode_outer(words_of(F.col("x.near"))).alias("term"))
    copies = based.select("key").groupBy("key").agg(F.count("*").alias("copies"))
    met = written(near.distinct(), "pii-near")
    if met.isEmpty():
        return met.select("term", F.lit(0.0).alias("disclosure")).limit(0)
    held = met.select("key").distinct()
    of_text = written(copies.join(held, "key", "left_semi"), "pii-copies")
    met = met.join(of_text, "key")
    entities = met.select("key", "entity", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("c_e"))
    pairs = met.filter("term IS NOT NULL").groupBy("entity", "term").agg(F.sum("copies").alias("c_te"), F.count("*").alias("texts")).filter(F.col("texts") >= least_texts)
    pairs = written(pairs.join(entities, "entity"), "pii-pairs")
    # Counted before they meet the pairs: a task sends each of its words once.
    counts = _texts(documents, text_col).select(F.explode_outer(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    n = F.lit(float(max(2, documents.count())))
    # A word near an email's cut-off rest may be counted near the entity but not in the text.
    share = 1 - F.log(F.greatest(F.col("c_t"), F.col("c_te")) / F.col("c_te")) / F.log(n / F.least(F.col("c_e"), n / 2))
    found = pairs.join(counts, "term").select("term", share.alias("disclosure")).filter(F.col("disclosure") >= discloses)
    return written(found.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")


def term_places(documents: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, terms): of each text that has disclosing words their (start, end, term, disclosure)."""
    texts = _texts(documents, text_col).withColumn("key", F.xxhash64("text"))
    wanted = bounded_broadcast(terms)
    holders = texts.select("key", F.explode_outer(words_of(F.col("text"))).alias("term")).join(wanted.select("term"), "term", "left_semi").select("key").distinct()
    holders = written(holders, "pii-holders")
    m = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    words = texts.join(bounded_broadcast(holders), "key", "left_semi").select("key", m.alias("m"), F.split("text", TERM).alias("p"))
    words = words.select("key", F.explode_outer(placed(F.col("p"), F.col("m"))).alias("x")).select("key", "x.start", "x.end", F.lower("x.value").alias("term"))
    hits = words.join(wanted, "term").select("key", F.struct("start", "end", "term", "disclosure").alias("x")).distinct()
    return hits.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("terms"))


def find_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Per document: its id, ``base`` and ``spans``: arrays of (start, order, end), order being the kind's place and 4 for terms; and ``terms``.

    ``terms`` (term, disclosure) are learned from the documents themselves if none are given.
    """
    based = base_spans(documents, text_col, F.col(f"`{id_col}`").alias("doc_id"))
    every = [F.transform(f"found_{k.name}", lambda x: F.struct(x.start.alias("start"), F.lit(i).alias("order"), x.end.alias("end"))) for i, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    based = based.select("doc_id", "key", F.array_sort(F.concat(*[F.coalesce(x, none) for x in every])).alias("base"))
    terms = disclosing_terms(documents, text_col) if terms is None else terms
    if terms.isEmpty():
        return based.withColumn("spans", F.col("base")).withColumn("terms", F.array().cast("array<struct<start:bigint,end:bigint,term:string,disclosure:double>>"))
    rows = based.join(bounded_broadcast(written(term_places(documents, terms, text_col), "pii-places")), "key", "left")
    # A word inside a base span is part of it.
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (t.start < b.end) & (b.start < t.end)))
    rows = rows.withColumn("terms", F.coalesce(apart, F.array().cast("array<struct<start:bigint,end:bigint,term:string,disclosure:double>>")))
    more = F.transform("terms", lambda t: F.struct(t.start.alias("start"), F.lit(len(KINDS)).alias("order"), t.end.alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", more)))


def sanitised(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, removes: float = REMOVES) -> DataFrame:
    """The documents with values replaced by ``[kind]``, words removed or, if they disclose less than ``removes``, replaced by their class.

    Of spans that overlap the first counts, of those with one start the longest.
    """
    found = find_spans(documents, id_col, text_col, terms).select("key", "spans", "terms").groupBy("key").agg(F.any_value("spans").alias("spans"), F.any_value("terms").alias("terms"))
    found = found.filter(F.size("spans") > 0)
    d = documents.withColumn("_key", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    d = d.join(bounded_broadcast(written(found.withColumnsRenamed({"key": "_key", "spans": "_spans", "terms": "_terms"}), "pii-spans")), "_key", "left")
    text = F.col(f"`{text_col}`")
    said = F.array(*[F.lit(f"[{k.name}]") for k in KINDS])
    word = lambda x: F.substring(text, (x.start + 1).cast("int"), (x.end - x.start).cast("int"))
    strong = lambda x: F.exists("_terms", lambda t: (t.start == x.start) & (t.disclosure >= removes))
    instead = lambda x: F.when(x.order < len(KINDS), F.get(said, x.order)).when(strong(x), "").otherwise(F.when(word(x).rlike(r"^\p{Lu}"), "[name]").otherwise("[word]"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.when(x.start < a.at, a).otherwise(F.struct(F.concat(a.parts, F.array(F.substring(text, (a.at + 1).cast("int"), (x.start - a.at).cast("int")), instead(x))).alias("parts"), x.end.alias("at")))
    order = F.array_sort("_spans", lambda x, y: F.when(x.start != y.start, F.sign(x.start - y.start)).otherwise(F.sign(y.end - x.end)).cast("int"))
    built = F.aggregate(order, start, step, lambda a: F.concat(F.array_join(a.parts, ""), F.substring(text, (a.at + 1).cast("int"), F.length(text))))
    return d.withColumn(text_col, F.when(F.col("_spans").isNotNull(), built).otherwise(text)).drop("_key", "_spans", "_terms").select(*[f"`{c}`" for c in documents.columns])


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(x) for x in (*_NAMES, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.order), x.start, x.end)), ",")


def op13_pii(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, the number of base spans of each kind, their digest and all spans as text."""
    d = find_spans(documents)
    n = [F.size(F.filter("base", lambda x: x.order == i)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    return d.select("doc_id", *n, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
