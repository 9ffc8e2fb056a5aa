"""Temperature mixing of sources, realised as budgeted block permutations.

Only DataFrame and SQL expressions: the exponent is bisected inside one
expression over the (source, tokens) array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, keyed, landed, table

#: Halvings of [0, 1] when the exponent is bisected; it is then rounded to 9 places.
STEPS = 40
#: A block has no more documents than this, on average, however few their tokens.
BLOCK_ROWS = 1 << 16


def _exponent_sql(max_repeats: float, target_entropy: float | None, budget_tokens: int | None) -> str:
    """SQL over `shares` (array of p > 0) and `total`: the least exponent in [0, 1] that meets both bounds."""
    z = "aggregate(shares, 0D, (s, p) -> s + power(p, mid))"
    top, low = "aggregate(shares, 0D, (s, p) -> greatest(s, power(p, mid - 1)))", "aggregate(shares, 1e300, (s, p) -> least(s, power(p, mid - 1)))"
    repeats = f"{top} / {low}" if budget_tokens is None else f"{float(budget_tokens)!r}D / total * {top} / {z}"
    ok = f"{repeats} <= {float(max_repeats)!r}D"
    if target_entropy is not None:
        entropy = f"ln({z}) - mid * aggregate(shares, 0D, (s, p) -> s + power(p, mid) * ln(p)) / {z}"
        ok += f" AND {entropy} <= {float(target_entropy)!r}D * ln(size(shares)) + 1e-12"
    test = f"transform(array((a.lo + a.hi) / 2), mid -> {ok})[0]"
    halve = f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (a, i) -> IF({test}, named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2), named_struct('lo', (a.lo + a.hi) / 2, 'hi', a.hi)))"
    zero = f"transform(array(0D), mid -> {ok})[0]"
    return f"IF({zero}, 0D, round({halve}.hi, 9))"


def mixing_weights(df: DataFrame, max_repeats: float = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = 1 << 20, max_sources: int = 1_000_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per source of df (key, n_tokens): tokens, weight, budget, epochs and rest of the mix.

    The (source, tokens) pairs meet in one row, since the exponent depends on all of
    them; more than max_sources of them raise an error. That also bounds the broadcast.
    """
    sums = df.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    one = sums.agg(F.sort_array(F.collect_list(F.struct("key", "tokens", "docs"))).alias("s"))
    one = one.withColumn("s", F.expr(f"IF(size(s) <= {max_sources}, s, raise_error('too many sources to mix'))"))
    one = one.withColumn("total", F.expr("aggregate(s, 0L, (a, x) -> a + x.tokens)")).withColumn("shares", F.expr("transform(filter(s, x -> x.tokens > 0), x -> x.tokens / cast(total AS double))"))
    one = one.withColumn("exponent", F.expr(_exponent_sql(max_repeats, target_entropy, budget_tokens)))
    one = one.withColumn("z", F.expr("aggregate(shares, 0D, (a, p) -> a + power(p, exponent))"))
    if budget_tokens is None:  # the least budget by which each source is read whole once
        budget = "aggregate(shares, 0D, (a, p) -> greatest(a, total * power(p, 1 - exponent) * z))"
        tokens = "greatest(tokens, cast(round(budget * weight) AS bigint))"
    else:
        budget, tokens = f"{float(budget_tokens)!r}D", f"least(cast(round(budget * weight) AS bigint), cast(floor({float(max_repeats)!r}D * tokens) AS bigint))"
    one = one.withColumn("budget", F.expr(budget)).select("total", "exponent", "z", "budget", F.explode("s").alias("s")).select("total", "exponent", "z", "budget", "s.*")
    one = one.withColumn("weight", F.expr("IF(tokens > 0, power(tokens / cast(total AS double), exponent) / z, 0D)")).withColumn("budget_tokens", F.expr(f"IF(tokens > 0, {tokens}, 0L)"))
    return one.select(
        "key", "tokens", "docs", "exponent", "weight", "budget_tokens",
        F.expr("CASE WHEN tokens > 0 THEN budget_tokens div tokens ELSE 1L END").alias("full_epochs"),
        F.expr("CASE WHEN tokens > 0 THEN budget_tokens % tokens ELSE 0L END").alias("rest_tokens"),
        F.expr(f"greatest(1L, cast(ceil(tokens / {float(block_tokens)!r}D) AS bigint), cast(ceil(docs / {float(block_rows)!r}D) AS bigint))").alias("n_blocks"),
    )


def _hash(*parts: str) -> str:
    """32 bits of an MD5, as bigint: the same in any engine."""
    return f"cast(conv(substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8), 16, 10) AS bigint)"


def mix(df: DataFrame, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_repeats: float = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = 1 << 20, seed: int = 0, more: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents of a mix, a row for each time that one is read.

    A source with share p of all tokens (words) gets weight p**t / sum(p**t). The
    exponent t is the least in [0, 1] whose entropy is at most target_entropy (a
    fraction of the largest possible) and by which no source is read more than
    max_repeats times; both by bisection. budget_tokens None takes the least budget
    that reads every document at least once, so nothing is dropped; a given budget
    may leave out documents of heavy sources, which is what it asks for.

    Each source's documents are hashed into blocks of about block_tokens, or block_rows if those are fewer: by id and
    content, and where several rows have both in common, by their numbers, so that no block holds all of those. An epoch
    is a permutation of the blocks, and of the documents of a block; whole epochs
    take all, the last one takes documents from the front until the budget is met.
    Windows run within a block, or over one row per block, never over a source.

    Returns doc_id, source, epoch, block, n_tokens, start (the token of the
    source's stream at which it begins), and the columns of `more`, which also settle ties of
    the order. Defined cases: a null source is a source of its own; a
    null or empty text has no tokens, is read with its block, and a source of
    only such texts is read once; rows that repeat an id are read as often as
    they occur; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df if "_row" in more else keyed(df)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.md5(text).alias("content"), *dict.fromkeys(("_row", *more)))
    # The texts are read once; what follows reads these few columns.
    rows = landed(rows.withColumns({"key": F.expr("coalesce(concat('s', source), 'n')"), "same": F.xxhash64("source", "doc_id", "content"), "salt": F.pmod(F.hash("_row"), F.lit(256))}), "mix")
    # Rows of one source, id and content are numbered, by salt and within it; as they are alike, it doesn't matter which one has which number.
    groups = rows.groupBy("same", "salt").agg(F.count("*").alias("m"))
    groups = groups.selectExpr("same", "salt", "sum(m) OVER (PARTITION BY same) AS times", "sum(m) OVER (PARTITION BY same ORDER BY salt) - m AS before").where("times > 1")
    rows = rows.join(groups, ["same", "salt"], "left").withColumn("turn", F.expr("before + row_number() OVER (PARTITION BY same, salt ORDER BY _row) - 1")).drop("same", "salt", "times", "before")
    name = "concat_ws(':', cast(doc_id AS string), content, cast(turn AS string))"
    weights = mixing_weights(rows, max_repeats, target_entropy, budget_tokens, block_tokens, block_rows=block_rows)
    rows = rows.join(F.broadcast(weights), "key").withColumn("block", F.expr(f"pmod({_hash(repr(f'{seed}b'), name)}, n_blocks)"))
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, full_epochs - IF(rest_tokens > 0, 0L, 1L))")) if budget_tokens is None else F.explode(F.expr("IF(full_epochs = 0 AND rest_tokens = 0, array(), sequence(0L, full_epochs - IF(rest_tokens > 0, 0L, 1L)))")))
    rows = rows.withColumn("doc_order", F.expr(_hash(repr(f"{seed}d"), "cast(epoch AS string)", name)))
    blocks = rows.groupBy("key", "epoch", "block").agg(F.sum("n_tokens").alias("block_n")).withColumn("block_order", F.expr(_hash(repr(f"{seed}p"), "cast(epoch AS string)", "cast(block AS string)")))
    # The running sum over a source's blocks goes by two levels, so no task takes all blocks of a source.
    blocks = blocks.withColumn("part", F.expr("block_order div 4194304"))
    parts = blocks.groupBy("key", "epoch", "part").agg(F.sum("block_n").alias("part_n"))
    parts = parts.select("key", "epoch", "part", F.expr("coalesce(sum(part_n) OVER (PARTITION BY key, epoch ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("part_start"))
    within = F.expr("coalesce(sum(block_n) OVER (PARTITION BY key, epoch, part ORDER BY block_order, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
    blocks = blocks.withColumn("within", within).join(parts, ["key", "epoch", "part"]).select("key", "epoch", "block", F.expr("part_start + within").alias("block_start"))
    rows = rows.withColumn("in_block", F.expr(f"coalesce(sum(n_tokens) OVER (PARTITION BY key, epoch, block ORDER BY {', '.join(('doc_order', 'doc_id', 'content', 'turn', *more))} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    rows = rows.join(blocks, ["key", "epoch", "block"]).withColumn("in_epoch", F.expr("block_start + in_block"))
    return rows.where("epoch < full_epochs OR in_epoch < rest_tokens").select("doc_id", "source", "epoch", "block", "n_tokens", F.expr("epoch * tokens + in_epoch").alias("start"), *more)


def mixed_documents(df: DataFrame, **kwargs) -> DataFrame:
    """df with each row as often as mix() reads it, whatever its id; columns as they were."""
    rows = keyed(df)
    reads = mix(rows, more=("_row",), **kwargs).groupBy("_row").agg(F.max("epoch").alias("_last"))
    return rows.join(reads, "_row").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_last")))).select(*df.columns)


#: Production parameters of op4: no source more than 2.5 times, most even otherwise.
PARAMS = {"max_repeats": 2.5, "target_entropy": 0.999, "block_tokens": 1 << 18, "seed": 17}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: mix() of documents by PARAMS."""
    return mix(table(spark, sf_dir, "documents"), **PARAMS)


SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, md5(coalesce(text, '')) AS content,
         CASE WHEN count(*) OVER (PARTITION BY source, doc_id, text) > 1 THEN row_number() OVER (PARTITION BY source, doc_id, text) - 1 END AS turn,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS n_tokens
  FROM documents
), s AS (SELECT key, sum(n_tokens)::bigint AS tokens, count(*) AS docs FROM r GROUP BY key),
o AS (SELECT sum(tokens)::double AS total FROM s),
q AS (SELECT list(tokens / total ORDER BY key) AS ps FROM s, o WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, -1.0::double, 1.0::double
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT i, lo, hi, mid,
           list_max(list_transform(ps, lambda p: pow(p, mid - 1))) / list_min(list_transform(ps, lambda p: pow(p, mid - 1))) <= 2.5
           AND ln(list_sum(list_transform(ps, lambda p: pow(p, mid))))
               - mid * list_sum(list_transform(ps, lambda p: pow(p, mid) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, mid)))
               <= 0.999 * ln(len(ps)) + 1e-12 AS ok
    FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN 0.0 ELSE (greatest(lo, 0.0) + hi) / 2 END AS mid, ps FROM b, q WHERE i < 41 AND hi > 0)
  )
), t AS (SELECT round(arg_min(hi, -i), 9) AS exponent FROM b),
z AS (SELECT exponent, list_sum(list_transform(ps, lambda p: pow(p, exponent))) AS z FROM t, q),
w AS (
  SELECT key, tokens, docs, exponent, z, total, tokens / total AS p,
         max(total * pow(tokens / total, 1 - exponent) * z) FILTER (WHERE tokens > 0) OVER () AS budget
  FROM s, o, z
), v AS (
  SELECT key, tokens, greatest(1, ceil(tokens / 262144.0), ceil(docs / 65536.0))::bigint AS n_blocks,
         CASE WHEN tokens > 0 THEN greatest(tokens, round(budget * (pow(p, exponent) / z))::bigint) ELSE 0 END AS bt
  FROM w
), u AS (
  SELECT *, CASE WHEN tokens > 0 THEN bt // tokens ELSE 1 END AS full_epochs, CASE WHEN tokens > 0 THEN bt % tokens ELSE 0 END AS rest FROM v
), x AS (
  SELECT doc_id, source, content, turn, r.key, n_tokens, tokens, full_epochs, rest,
         ('0x' || substr(md5('17b|' || concat_ws(':', doc_id, content, turn)), 1, 8))::bigint % n_blocks AS block,
         unnest(range(0, full_epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch
  FROM r JOIN u ON r.key = u.key
), y AS (
  SELECT *, coalesce(sum(n_tokens) OVER (
    PARTITION BY key, epoch
    ORDER BY ('0x' || substr(md5('17p|' || epoch || '|' || block), 1, 8))::bigint, block,
             ('0x' || substr(md5('17d|' || epoch || '|' || concat_ws(':', doc_id, content, turn)), 1, 8))::bigint, doc_id, content
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS in_epoch
  FROM x
)
SELECT doc_id, source, epoch, block, n_tokens, (epoch * tokens + in_epoch)::bigint AS start
FROM y WHERE epoch < full_epochs OR in_epoch < rest
"""
