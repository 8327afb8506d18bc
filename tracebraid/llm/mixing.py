"""Mixing sources to target weights by a hypergeometric splitting tree.

Every source is permuted by a hash of its document ids and cut into blocks by
the hash's first digits.  A source's quota is a number of words: so many whole
passes over its blocks, then blocks in permuted order up to the last word; the
document at the end is cut there, so quotas are exact.  In blocks (units of the
hash's first two digits, once a pass) the quota is a number of tickets.

A binary tree divides the tickets among the output shards, from the top: a node
keeps a random half of its tickets on the left, so the counts by source are a
multivariate hypergeometric draw, and they add up exactly at every level.  A leaf
is a shard with its quota of each source.  The shards then draw: every source's
tickets are permuted anew, and each shard takes its quota of them in turn, so
draws are disjoint and complete.  What a document gives to the mix is the sum over
the tickets that shards have drawn.  Each shard is shuffled by a hash of its own.

Gathered in one place are only tables of sources and of tickets (at most 256 a
source and pass), and in each source the one block where its quota ends; there are so
many blocks that one holds about ``BLOCK_DOCS`` documents, whatever the size of the
corpus.  Everything is DataFrame operations.

Cases: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; a source without words has target 0; rows
with a null id are told apart by their texts; of rows with equal ids and sizes each
counts, in order of a hash of their texts, so reruns agree; an empty table gives
an empty mix; other columns are carried along by ``mixed_documents`` whatever
their names (but ``mix_shard``, which the shard's number replaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import bounded_broadcast, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is passed over at most so many times.
MOST_PASSES = 3
#: Hex digits of the hash that name a unit of the tree, and at least those that name a block; documents of a block, about.
UNIT_DIGITS, BLOCK_DIGITS, BLOCK_DOCS = 2, 3, 1024
#: Words of an output task, about.
SLICE_WORDS = 4_000_000
SEED = "mix-1"
#: Levels of the tree: 2 ** LEVELS output shards.
LEVELS = 3

WORD = "[^\\x20\\x09-\\x0D]+"


def document_sizes(documents: DataFrame, *others: Column) -> DataFrame:
    """doc_id, skey (the source, as a key that is never null and sorts null last), size, hash, like (of the text); and ``others``."""
    skey = F.when(F.col("source").isNull(), "~").otherwise(F.concat(F.lit("!"), "source"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), own).cast("binary"))
    return documents.select("doc_id", skey.alias("skey"), size.alias("size"), digest.alias("hash"), F.xxhash64("text").alias("like"), *others)


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: skey, source_size, target.

    Targets share the words of all sources by weight.  Sources are ordered by
    the level of the common share at which they reach their limit; those before
    the first level that suffices are at their limit, the others share the rest.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("skey")) - 1
    s = s.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(WEIGHTS)))))
    s = s.withColumn("limit", (MOST_PASSES * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole).cast("double") - before) / after)
    s = s.withColumn("share", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole))
    target = F.least("limit", F.coalesce(F.col("share") * F.col("weight"), F.col("limit")))
    return s.select("skey", "source_size", target.alias("target"))


def quotas(targets: DataFrame) -> DataFrame:
    """Adds ``passes`` (whole ones) and ``rest`` (words of a last pass)."""
    words = F.round("target").cast("long")
    q = targets.withColumn("passes", F.expr("coalesce(CAST(round(target) AS BIGINT) DIV nullif(source_size, 0), 0L)"))
    return q.withColumn("rest", words - F.col("passes") * F.col("source_size"))


def _order(name: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"{SEED}/{name}"), *columns).cast("binary"), 256)


def shard_quotas(tickets: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows of (skey, shard, quota): how many of a source's tickets (skey, unit, pass) each of ``2 ** levels`` shards gets."""
    node = tickets.select("skey", "unit", "pass", F.lit(0).cast("long").alias("shard"))
    for level in range(levels):
        place = F.row_number().over(Window.partitionBy("shard").orderBy(_order(str(level), "shard", "skey", "unit", "pass"), "skey", "unit", "pass"))
        count = F.count("*").over(Window.partitionBy("shard"))
        left = F.floor((count + F.pmod(F.col("shard"), F.lit(2))) / 2)
        node = node.withColumn("shard", 2 * F.col("shard") + F.when(place > left, 1).otherwise(0))
    return node.groupBy("skey", "shard").agg(F.count("*").alias("quota"))


def draw_tickets(tickets: DataFrame, quotas_of: DataFrame) -> DataFrame:
    """Each ticket with the shard that draws it: a source's tickets in a new random order, to the shards by their quotas."""
    of_source = Window.partitionBy("skey")
    end = F.sum("quota").over(of_source.orderBy("shard"))
    leaves = quotas_of.select("skey", "shard", (end - F.col("quota")).alias("first"), end.alias("end"))
    place = F.row_number().over(of_source.orderBy(_order("draw", "skey", "unit", "pass"), "unit", "pass")) - 1
    placed = tickets.withColumn("place", place)
    return placed.join(leaves, "skey").filter("place >= first AND place < end").select("skey", "unit", "pass", "shard")


def mix_plan(rows: DataFrame, levels: int = LEVELS, sizes: DataFrame | None = None) -> DataFrame:
    """Per row: its columns and source_size, target and ``draws``.

    ``rows`` come from ``document_sizes``; ``sizes``, by default the same, is
    what totals are taken from.

    A draw is a ticket that a shard has drawn: the pass, the shard and the words
    (all of the document's, or fewer in a source's last document).
    """
    sizes = rows if sizes is None else sizes
    targets = bounded_broadcast(written(quotas(source_targets(sizes)), "mix-targets"))
    n = sizes.count()
    digits = next(d for d in range(BLOCK_DIGITS, 33) if n <= BLOCK_DOCS * 16**d or d == 32)
    block, unit = F.substring("hash", 1, digits), F.substring("block", 1, UNIT_DIGITS)
    blocks = sizes.groupBy("skey", block.alias("block")).agg(F.sum("size").alias("words")).withColumn("unit", unit)
    # Running sums of units, then of a unit's blocks, so that no window holds all blocks of a source.
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda *by: F.coalesce(F.sum("words").over(up_to(*by)), F.lit(0))
    blocks = written(blocks, "mix-blocks")
    units = blocks.groupBy("skey", "unit").agg(F.sum("words").alias("words")).withColumn("from", running("skey", "unit")).drop("words")
    placed = blocks.withColumn("inside", running("skey", "unit", "block")).join(F.broadcast(units), ["skey", "unit"])
    placed = written(placed.select("skey", "block", "words", (F.col("from") + F.col("inside")).alias("before")), "mix-places")

    d = rows.withColumn("block", block).join(targets, "skey").join(bounded_broadcast(placed), ["skey", "block"])
    at_end = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    d = d.withColumn("at_end", at_end)
    within = Window.partitionBy("skey").orderBy("hash", "doc_id", "size", "like").rowsBetween(Window.unboundedPreceding, -1)
    inner = d.filter("at_end").withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    inner = inner.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.col("inside"))))
    outer = d.filter("NOT at_end").withColumn("extra", F.when(F.col("before") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(0))
    d = outer.drop("at_end").unionByName(inner.drop("at_end", "inside"))

    passes = F.explode(F.sequence(F.lit(1), F.lit(MOST_PASSES + 1)))
    tickets = units.join(targets, "skey").select("skey", "unit", "passes", passes.alias("pass"), "from", "rest")
    tickets = tickets.filter((F.col("pass") <= F.col("passes")) | ((F.col("pass") == F.col("passes") + 1) & (F.col("from") < F.col("rest"))))
    tickets = written(tickets.select("skey", "unit", "pass"), "mix-tickets")
    drawn = draw_tickets(tickets, shard_quotas(tickets, levels))
    drawn = drawn.groupBy("skey", "unit").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))

    d = d.withColumn("unit", unit).join(F.broadcast(written(drawn, "mix-drawn")), ["skey", "unit"], "left")
    words = lambda x: F.when(x["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("extra")).cast("long")
    draws = F.transform(F.coalesce("drawn", F.array().cast("array<struct<pass:int,shard:bigint>>")), lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), words(x).alias("words")))
    return d.select(*rows.columns, "source_size", "target", F.filter(draws, lambda x: x.words > 0).alias("draws"))


def mixed_documents(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The mix itself: the documents' rows, repeated and cut as planned, shard by shard, each shard shuffled.

    The columns are those of ``documents`` and ``mix_shard``.
    """
    names = [c for c in documents.columns if c != "mix_shard"]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    sizes = written(document_sizes(documents), "mix-sizes")
    words = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slices = max(1, -(-int(words) // (SLICE_WORDS << levels)))
    plan = mix_plan(document_sizes(documents, row), levels, sizes=sizes)
    drawn = plan.select("row", "hash", "like", F.col("size"), F.explode("draws").alias("draw"))
    drawn = drawn.withColumn("local", F.sha2(F.concat_ws("/", F.lit(SEED), "hash", "draw.pass").cast("binary"), 256))
    # A task is a slice of a shard; their number follows the mix's size.
    drawn = drawn.withColumn("slice", F.pmod(F.xxhash64("local"), F.lit(slices)))
    drawn = drawn.repartition(max(16, slices << levels), "draw.shard", "slice").sortWithinPartitions("draw.shard", "slice", "local", "like")
    # The first words of a text: it is cut where a word ends.
    pieces = F.split("row.text", "(?<=[^ \\t-\\r])(?=[ \\t-\\r])")
    text = F.when(F.col("draw.words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("draw.words").cast("int")), "")).otherwise(F.col("row.text"))
    kept = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names]
    return drawn.select(*kept, F.col("draw.shard").alias("mix_shard"))


def op6_mixing(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, its number of draws and their shards by pass."""
    sizes = written(document_sizes(documents), "mix-sizes")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x.words)
    shards = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["pass"], x["shard"])), ",")
    return mix_plan(sizes).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("draws").cast("long").alias("n_draws"), shards.alias("shards"))


def _halved(level: int) -> str:
    """One level of the tree in SQL."""
    return f"""SELECT skey, unit, pass, 2 * shard + CASE WHEN place > (n + shard % 2) // 2 THEN 1 ELSE 0 END AS shard FROM (
    SELECT *, count(*) OVER (PARTITION BY shard) AS n, row_number() OVER (PARTITION BY shard
      ORDER BY sha256(concat_ws('|', '{SEED}/{level}', shard, skey, unit, pass)), skey, unit, pass) AS place FROM node{level})"""


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '~' ELSE '!' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS hash
  FROM documents),
sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight,
    (3 * source_size)::DOUBLE AS lim FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
shares AS (
  SELECT *, max(CASE WHEN level * weight <= lim THEN level END) OVER () AS share FROM levels),
targets AS (
  SELECT skey, source_size, least(lim, coalesce(share * weight, lim)) AS target FROM shares),
quotas AS (
  SELECT *, round(target)::BIGINT - passes * source_size AS rest FROM (
    SELECT *, coalesce(round(target)::BIGINT // nullif(source_size, 0), 0)::BIGINT AS passes FROM targets)),
placed AS (
  SELECT d.*, row_number() OVER () AS row_id, substr(hash, 1, {UNIT_DIGITS}) AS unit, source_size, target, passes, rest,
    coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY hash, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN quotas USING (skey)),
units AS (SELECT skey, unit, min(before) AS start, any_value(passes) AS passes, any_value(rest) AS rest FROM placed GROUP BY skey, unit),
tickets AS (
  SELECT skey, unit, pass FROM units, range(1, {MOST_PASSES + 2}) r(pass) WHERE pass <= passes OR (pass = passes + 1 AND start < rest)),
node0 AS (SELECT *, 0::BIGINT AS shard FROM tickets),
{",".join(f"node{k + 1} AS ({_halved(k)})" for k in range(LEVELS))},
leaves AS (
  SELECT skey, shard, sum(quota) OVER (PARTITION BY skey ORDER BY shard) - quota AS first, sum(quota) OVER (PARTITION BY skey ORDER BY shard) AS stop
  FROM (SELECT skey, shard, count(*) AS quota FROM node{LEVELS} GROUP BY skey, shard)),
permuted AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY sha256(concat_ws('|', '{SEED}/draw', skey, unit, pass)), unit, pass) - 1 AS place FROM tickets),
drawn AS (
  SELECT p.skey, unit, pass, shard FROM permuted p JOIN leaves l ON p.skey = l.skey AND place >= first AND place < stop),
draws AS (
  SELECT row_id, pass, shard, CASE WHEN pass <= passes THEN size ELSE greatest(0, least(size, rest - before)) END AS words
  FROM placed JOIN drawn USING (skey, unit)),
taken AS (
  SELECT row_id, sum(words) AS taken, count(*) AS n_draws, string_agg(pass || ':' || shard, ',' ORDER BY pass) AS shards
  FROM draws WHERE words > 0 GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_draws, 0)::BIGINT AS n_draws, coalesce(shards, '') AS shards
FROM placed LEFT JOIN taken USING (row_id)
"""
