"""Mixing sources to target weights with DataFrame functions only.

Targets are water levels: a source gets ``level * weight`` words, but never more than ``limit``
times its size; the level is raised until all targets sum to ``share`` times all words. A
document appears ``floor(rate)`` times plus one copy drawn with the fraction as probability,
where ``rate`` is target / size of its source. The draw is a hash of ``doc_id`` and of a seed;
every source takes the one of ``SEEDS`` seeds whose words come nearest to its target.

Defined results: a null text has size 0; null is a source of its own, last in the order; a
source without words has target 0 and its documents are taken 0 times; rows that repeat a
``doc_id`` share its draw; an empty table gives no rows; other columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tables import fresh, numbered, words_in, written

WEIGHTS = (3, 1, 2)  # repeating, over the sources in code point order
SHARE = 1.5
LIMIT = 2.0
SEEDS = 64
RANGE = 2**32


def draw(doc_id: Column, seed) -> Column:
    """Uniform number in [0, 1) from two halves of the MD5 of ``doc_id`` and the seed."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    start, step = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.pmod(start + step * seed, F.lit(RANGE)) / F.lit(float(RANGE))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums, "rank", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(
        ranked.select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(limit)).alias("most"),
        ),
        "sources",
    )
    # each round shares what the full sources leave; one row comes back per round
    level, full = 0.0, None
    while True:
        is_full = F.col("most") <= F.lit(level) * F.col("weight") if full else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(is_full, F.col("most"))).alias("given"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
        ).first()
        now = (row["given"] or 0.0, row["open"] or 0.0)
        if now == full or not now[1]:
            break
        full = now
        level = ((row["words"] or 0) * share - now[0]) / now[1]
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seeds: int = SEEDS) -> DataFrame:
    """(source, source_size, target, times, chance, seed) of rows (doc_id, source, size)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = written(
        source_targets(sized, weights, share, limit)
        .withColumn("times", F.floor(rate))
        .withColumn("chance", rate - F.floor(rate)),
        "goals",
    )
    joined = join_source(sized, "source", goals)
    sums = joined.groupBy("source").agg(
        *[F.sum(F.when(draw(F.col("doc_id"), j) < F.col("chance"), F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(seeds)]
    )
    chosen = join_source(goals, "source", sums)
    off = [
        F.struct(F.abs(F.col("times") * F.col("source_size") + F.col(f"s{j}") - F.col("target")).alias("off"), F.lit(j).alias("seed"))
        for j in range(seeds)
    ]
    best = F.array_min(F.array(*off)).getField("seed") if seeds > 1 else F.lit(0)
    return written(chosen.select("source", "source_size", "target", "times", "chance", best.alias("seed")), "rates")


def join_source(df: DataFrame, column: str, right: DataFrame) -> DataFrame:
    """Brings a table with one row per source to the rows; Spark broadcasts it if its measured
    size is small and else splits the hot sources of a sort-merge join."""
    own = right.withColumnRenamed("source", "_of_source")
    return df.join(own, df[column].eqNullSafe(own["_of_source"])).drop("_of_source")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))


def copies(doc_id: Column) -> Column:
    return (F.col("times") + (draw(doc_id, F.col("seed")) < F.col("chance")).cast("long")).cast("long")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: how many of its words the mix takes."""
    sized = written(sizes(docs), "sized")
    out = join_source(sized, "source", rates(sized, **options))
    taken = copies(F.col("doc_id"))
    return out.select("doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of ``docs``."""
    own = rates(written(sizes(docs), "sized"), **options).select(
        "source", F.struct("times", "chance", "seed").alias(mark := fresh(docs, "_rate"))
    )
    joined = join_source(docs, "source", own)
    rate = F.col(mark)
    drawn = draw(docs["doc_id"], rate["seed"]) < rate["chance"]
    times = (rate["times"] + drawn.cast("long")).cast("int")
    each = fresh(joined, "_copy")
    return joined.withColumn(each, F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
         source_size * 2.0::DOUBLE AS most FROM sums
), filled AS (
  SELECT *, sum(most) OVER w AS given, sum(weight) OVER w AS used, sum(weight) OVER () AS weights, sum(source_size) OVER () AS words
  FROM ranked WINDOW w AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), level AS (
  -- the water level is the largest level that any set of the fullest sources leaves to the others
  SELECT greatest(max(words * 1.5::DOUBLE / weights),
                  max(CASE WHEN weights - used > 0 THEN (words * 1.5::DOUBLE - given) / (weights - used) END)) AS level FROM filled
), goals AS (
  SELECT source, source_size, least(most, level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(most, level * weight) / source_size ELSE 0.0::DOUBLE END AS rate
  FROM ranked, level
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS a,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 8) AS BIGINT) AS b FROM sized
), tried AS (
  SELECT g.source, j, sum(CASE WHEN ((a + b * j) % {RANGE}) / {float(RANGE)}::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) AS extra
  FROM hashed h JOIN goals g ON h.source IS NOT DISTINCT FROM g.source, range({SEEDS}) t(j) GROUP BY ALL
), chosen AS (
  SELECT g.*, j FROM goals g JOIN tried t ON g.source IS NOT DISTINCT FROM t.source
  QUALIFY row_number() OVER (PARTITION BY g.source ORDER BY abs(floor(rate) * source_size + extra - target), j) = 1
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT h.*, g.source_size, g.target,
             CAST(floor(rate) AS BIGINT) + CAST(((a + b * j) % {RANGE}) / {float(RANGE)}::DOUBLE < rate - floor(rate) AS BIGINT) AS copies
      FROM hashed h JOIN chosen g ON h.source IS NOT DISTINCT FROM g.source)
"""
