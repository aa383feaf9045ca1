"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.common import WORD_PATTERN, discard, fresh, materialize, table, text_or_empty


def target_sizes(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds target to (source, source_size): `share` of all sizes split by weight, none above `most` times its source.

    Sharing the excess again and again ends at a water level: a source has its weight times the level or its limit,
    whichever is less. In the order of limit by weight, the level follows from the sums over the sources before.
    The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    weighed = sources.withColumn("weight", weight).withColumn("limit", limit).withColumn("bound", F.col("limit") / F.col("weight"))
    total = sources.agg((F.sum("source_size") * F.lit(float(share))).alias("total"))
    ranked = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before = weighed.withColumn("full", F.coalesce(F.sum("limit").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    before = before.withColumn("open", F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    levels = before.join(total).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    found = levels.filter(F.col("level") <= F.col("bound")).agg(F.min(F.struct("bound", "level")).alias("f")).select("f.level")
    level = weighed.join(found)
    target = F.when(F.col("level").isNull() | (F.col("weight") * F.col("level") >= F.col("limit")), F.col("limit")).otherwise(F.col("weight") * F.col("level"))
    return level.select("source", "source_size", target.alias("target"))


def solve_rates(masses: DataFrame, targets: DataFrame, most: float, rounds: int = 80, close: float = 1e-13) -> DataFrame:
    """(source, target, dual): Newton's method on the convex dual of the token constraints.

    Among all document rates under which a source's documents have its target of words, and none a rate above `most`, those
    nearest to the priors in relative entropy are prior * exp(dual * size), cut at `most`: every document is tilted by its
    own size. The gradient of the dual is the words taken less the target; its curvature, the sum of rate * size ** 2 over
    documents below the limit. Both are sums over documents, made anew each round where `masses` lies: it has
    (source, size, prior, rows), a row for all documents that are alike. What is handed on has a row a source. Steps are
    Newton's on the logarithm of the words taken; one that leaves the bracket around the solution is replaced by its middle.
    A source whose target is all it can give has the dual null: each of its documents has the rate `most`.
    """
    with_words = masses.filter("size > 0")
    bounds = with_words.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("size") * F.col("rows")).cast("double").alias("words"), F.min("size").alias("least"), F.min("prior").alias("low"), F.max("prior").alias("high"))
    met = targets.join(bounds, targets["source"].eqNullSafe(bounds["of"]))
    full = F.col("target") >= F.col("words") * F.lit(float(most)) * (1 - 1e-15)
    # At `lo` less than the target is taken, at `hi` all that can be.
    lo = F.least(F.lit(0.0), F.log(F.col("target") / (F.col("words") * F.col("high"))) / F.col("least"))
    hi = F.greatest(F.lit(0.0), F.log(F.lit(float(most)) / F.col("low")) / F.col("least"))
    state = materialize(met.filter(~full & (F.col("target") > 0)).select("source", "target", lo.alias("lo"), hi.alias("hi"), F.lit(0.0).alias("dual")), "dual")
    for _ in range(rounds):
        tilted = F.col("prior") * F.exp(F.col("dual") * F.col("size"))
        words = F.col("rows") * F.col("size") * F.least(tilted, F.lit(float(most)))
        at = state.join(with_words.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        sums = at.groupBy("source", "target", "lo", "hi", "dual").agg(F.sum(words).alias("taken"), F.sum(F.when(tilted < most, words * F.col("size")).otherwise(0.0)).alias("curve"))
        lo, hi = F.when(F.col("taken") < F.col("target"), F.col("dual")).otherwise(F.col("lo")), F.when(F.col("taken") < F.col("target"), F.col("hi")).otherwise(F.col("dual"))
        step = F.col("dual") + F.log(F.col("target") / F.col("taken")) * F.col("taken") / F.nullif(F.col("curve"), F.lit(0.0))
        off = F.abs(F.col("target") - F.col("taken")) / F.col("target")
        moved = sums.select("source", "target", lo.alias("lo"), hi.alias("hi"), F.when(off > close, step).otherwise(F.col("dual")).alias("dual"), off.alias("off"))
        inside = (F.col("off") <= close) | ((F.col("dual") > F.col("lo")) & (F.col("dual") < F.col("hi")))
        last, state = state, materialize(moved.withColumn("dual", F.when(inside, F.col("dual")).otherwise((F.col("lo") + F.col("hi")) / 2)), "dual")
        discard(last)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= close:
            break
    return state.select("source", "target", "dual").unionAll(met.filter(full).select("source", "target", F.lit(None).cast("double")))


def exchange(sizes: list[int], numbers: list[int], copies: list[int], rest: int, most: int) -> tuple[int | None, int | None]:
    """The places of a group to get a copy more and of one to get a copy less, None for none, that leave the least of `rest`
    thousandths of a word; of equally good ones the smaller sizes."""
    more = {0: None} | {s: i for i, (s, n, c) in enumerate(zip(sizes, numbers, copies, strict=True)) if s and c < most * n}
    less = {0: None} | {s: i for i, (s, c) in enumerate(zip(sizes, copies, strict=True)) if s and c}
    down = sorted(less)
    best = min(
        (abs(rest - 1000 * (up - down[at])), up, down[at])
        for up in sorted(more)
        for k in [bisect_left(down, up - rest / 1000)]
        for at in range(max(0, k - 1), min(len(down), k + 2))
    )
    return more[best[1]], less[best[2]]


def whole_copies(groups: DataFrame, most: int) -> DataFrame:
    """(source, size, prior, rows, first, copies): how many copies all documents of a source, size and prior get together.

    A source's groups are gone through from the largest size down; each gets the whole number nearest to its documents
    times their rate, more or less what rounding the groups before has left of words. So what rounding a large document
    adds or takes is made up by the smaller ones, and the error in the end is that of the smallest; one copy more of a size
    and one less of another then take off most of that. Words are counted in thousandths, as whole numbers. `groups` has a row for each source, size and prior, and a task holds those of one
    source: its distinct sizes, whatever the number of documents.
    """

    def run(rows):
        rows = rows.sort_values(["size", "prior"], ascending=False)
        rest, out = 0, []
        for size, number, ideal in zip(rows["size"].tolist(), rows["rows"].tolist(), rows["ideal"].tolist(), strict=True):
            copies = max(0, min(most * number, (2 * (ideal + rest) + 1000 * size) // (2000 * size))) if size else 0
            rest += ideal - 1000 * copies * size
            out.append(copies)
        more, less = exchange(rows["size"].tolist(), rows["rows"].tolist(), out, rest, most)
        for at, change in ((more, 1), (less, -1)):
            if at is not None:
                out[at] += change
        return rows[["source", "size", "prior", "rows", "first"]].assign(copies=out)

    return groups.groupBy("source").applyInPandas(run, "source string, size long, prior double, rows long, first long, copies long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prior_col: str | None = None, with_mark: bool = False) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, rate, copies, taken.

    Size is the number of words. `solve_rates` gives every document its rate, from its prior (of `prior_col`, above 0; 1
    without) and its size; `whole_copies` makes them whole, and the copies of a group are spread evenly over its documents
    in order of id. The place of a document in that order comes from the number in each partition before it, so a source
    that holds most rows is spread over partitions like any other.

    Defined results: null and blank texts have the size 0 and take 0 words; a null source is a source, the last in order;
    a source without words has the target 0; null ids come before all; a prior that is null or not above 0 is 1; repeated
    rows are rounded one by one; other columns are not read; very long texts count whole; an empty table gives an empty
    result.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD_PATTERN)).cast("long")
    mark = F.unhex(F.sha2(text_or_empty(text_col), 256)) if with_mark else F.lit(None).cast("binary")
    given = F.lit(None) if prior_col is None else F.col(prior_col)
    prior = F.when(given > 0, given).otherwise(1.0).cast("double")
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("doc"), mark.alias("mark"), F.col(source_col).cast("string").alias("source"), size.alias("size"), prior.alias("prior")), "sizes")
    masses = materialize(sized.groupBy("source", "size", "prior").agg(F.count("*").alias("rows")), "masses")
    totals = masses.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = materialize(target_sizes(totals, weights, share, most), "targets")
    duals = solve_rates(masses, targets, most).select(F.col("source").alias("of"), "dual", F.lit(True).alias("some"))
    solved = targets.join(duals, targets["source"].eqNullSafe(duals["of"]), "left").drop("of").withColumnRenamed("source", "of")
    placed = materialize(ranked(sized), "placed")
    groups = placed.groupBy("source", "size", "prior").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    groups = groups.join(solved, groups["source"].eqNullSafe(solved["of"])).drop("of")
    tilted = F.least(F.col("prior") * F.exp(F.col("dual") * F.col("size")), F.lit(float(most)))
    rate = F.when((F.col("size") == 0) | F.col("some").isNull(), 0.0).when(F.col("dual").isNull(), float(most)).otherwise(tilted)
    groups = materialize(groups.withColumn("rate", rate).withColumn("ideal", F.round(F.col("rate") * F.col("rows") * F.col("size") * 1000).cast("long")), "groups")
    copies = whole_copies(groups.select("source", "size", "prior", "rows", "first", "ideal"), most)
    same = lambda a, b: a["source"].eqNullSafe(b["_source"]) & (a["size"] == b["_size"]) & (a["prior"] == b["_prior"])
    named = lambda df: df.withColumnsRenamed({"source": "_source", "size": "_size", "prior": "_prior"})
    told = named(copies)
    shares = groups.select("source", "size", "prior", "source_size", "target", "rate").join(told, same(groups, told)).select("source", "size", "prior", "source_size", "target", "rate", "rows", "first", "copies")
    told = named(shares)
    number = F.expr("cast(((place - first + 1) * copies) div rows - ((place - first) * copies) div rows as int)")
    out = placed.join(told, same(placed, told))
    out = out.select(F.col("doc").alias(id_col), "size", "source_size", "target", F.round("rate", 6).alias("rate"), number.alias("copies"), *(["mark"] if with_mark else []))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as many times as `mix` says, with all their columns.

    Rows find their copies by id and SHA-256 of the text; rows that repeat both share what they get, the first ones a copy
    more where it doesn't come out even.
    """
    shares = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, with_mark=True, **options)
    own, mark, copies, rows, place, copy = fresh(docs, "_mix_id", "_mix_mark", "_mix_copies", "_mix_rows", "_mix_place", "_mix_copy")
    shares = shares.groupBy(F.col(id_col).alias(own), F.col("mark").alias(mark)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0)
    found = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.unhex(F.sha2(text_or_empty(text_col), 256)) == F.col(mark))
    joined = docs.join(shares, found)
    once = joined.filter(F.col(rows) == 1).withColumn(place, F.lit(1))
    again = joined.filter(F.col(rows) > 1).withColumn(place, F.row_number().over(Window.partitionBy(own, mark).orderBy(F.lit(0))))
    number = F.floor(F.col(copies) / F.col(rows)).cast("int") + (F.col(place) <= F.col(copies) % F.col(rows)).cast("int")
    each = once.unionByName(again).withColumn(copies, number).filter(F.col(copies) > 0)
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def ranked(sized: DataFrame) -> DataFrame:
    """Adds place: the number, from 1, of the row among its source's by size, prior and id, by prefix sums over partitions."""
    order = ["source", "size", "prior", "doc"]
    dealt = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    window = Window.partitionBy("part", "source").orderBy("size", "prior", "doc")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("source", "part").agg(F.count("*").alias("rows"))
    before = sums.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    local = dealt.withColumn("local", F.row_number().over(window))
    found = local.join(before, (local["part"] == before["part"]) & local["source"].eqNullSafe(before["source"]))
    return found.select(local["doc"], local["mark"], local["source"], "size", "prior", (F.col("local") + F.col("before")).alias("place"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), b AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM w
), l AS (
  SELECT min_by(level, bound) AS level FROM (
    SELECT ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - full_) / open_ AS level, cap / weight AS bound FROM b) WHERE level <= bound
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR weight * level >= cap THEN cap ELSE weight * level END AS target FROM w, l
), g AS (
  SELECT d.source, d.size, count(*) AS n, any_value(target) AS target, any_value(s.source_size) AS source_size,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC) AS k
  FROM d JOIN t s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.source, d.size
), e AS (
  SELECT source, target, least(0, ln(target / source_size) / min(size)) AS lo, ln(2.0::DOUBLE) / min(size) AS hi, 0 AS it
  FROM g WHERE size > 0 AND target > 0 AND target < 2 * source_size GROUP BY source, target, source_size
  UNION ALL
  SELECT e.source, e.target,
    CASE WHEN sum(n * size * least(exp((lo + hi) / 2 * size), 2)) < e.target THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN sum(n * size * least(exp((lo + hi) / 2 * size), 2)) < e.target THEN hi ELSE (lo + hi) / 2 END, it + 1
  FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source WHERE it < 100 GROUP BY e.source, e.target, lo, hi, it
), i AS (
  SELECT g.*, CASE WHEN size = 0 OR g.target = 0 THEN 0 WHEN lo IS NULL THEN 2.0::DOUBLE ELSE least(exp((lo + hi) / 2 * size), 2) END AS rate
  FROM g LEFT JOIN (SELECT * FROM e WHERE it = 100) e ON e.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source, size ORDER BY doc_id NULLS FIRST) AS place FROM d
), r AS (
  SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS n, CAST(0 AS HUGEINT) AS m, CAST(0 AS HUGEINT) AS rest, 0.0::DOUBLE AS rate FROM t
  UNION ALL
  SELECT source, k, size, n, m, rest + ideal - 1000 * m * size, rate FROM (
    SELECT g.source, g.k, g.size, g.n, r.rest, g.ideal, g.rate,
      CASE WHEN g.size = 0 THEN 0 ELSE greatest(0, least(2 * g.n, CAST(floor((2 * (g.ideal + r.rest) + 1000 * g.size) / (2000 * g.size)) AS HUGEINT))) END AS m
    FROM r JOIN (SELECT *, CAST(round(rate * n * size * 1000) AS HUGEINT) AS ideal FROM i) g ON g.source IS NOT DISTINCT FROM r.source AND g.k = r.k + 1)
), f AS (
  SELECT source, arg_max(rest, k) AS rest FROM r GROUP BY source
), a AS (
  SELECT source, size FROM r WHERE k > 0 AND size > 0 AND m < 2 * n UNION ALL SELECT source, 0 FROM t
), z AS (
  SELECT source, size FROM r WHERE k > 0 AND size > 0 AND m > 0 UNION ALL SELECT source, 0 FROM t
), x AS (
  SELECT f.source, a.size AS up, z.size AS down FROM f JOIN a ON a.source IS NOT DISTINCT FROM f.source JOIN z ON z.source IS NOT DISTINCT FROM f.source
  QUALIFY row_number() OVER (PARTITION BY f.source ORDER BY abs(f.rest - 1000 * (a.size - z.size)), a.size, z.size) = 1
), v AS (
  SELECT r.source, r.k, r.size, r.n, r.rate, r.m + CASE WHEN r.size > 0 AND r.size = x.up THEN 1 ELSE 0 END - CASE WHEN r.size > 0 AND r.size = x.down THEN 1 ELSE 0 END AS m
  FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source WHERE r.k > 0
)
SELECT doc_id, p.size, source_size, target, round(rate, 6) AS rate, CAST(p.place * m // n - (p.place - 1) * m // n AS INTEGER) AS copies,
  CAST((p.place * m // n - (p.place - 1) * m // n) * p.size AS BIGINT) AS taken
FROM p JOIN v ON p.source IS NOT DISTINCT FROM v.source AND p.size = v.size
JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
