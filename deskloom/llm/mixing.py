"""Operator 5, mixing sources to target weights: Poisson replication.

A source's rate is its target share of the bytes divided by its present share. Each document's
number of copies inverts the Poisson distribution of that mean at a number hashed from the seed and
its id, so it needs no state and is the same in every run and on every executor. Copies are then
dealt out anew over all partitions in a hashed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import col, documents, partitions, text_of

SEED = 20240
#: Without weights, a source's target weight is its bytes to this power.
TEMPERATURE = 0.5
#: A larger mean is the sum of equal parts, each with a hashed number of its own.
LARGEST_MEAN = 500.0
#: Up to so many numbers the tables of sums are broadcast; beyond, they are joined by a shuffle.
MOST_NUMBERS = 4_000_000


def _hashed(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of an MD5 as a long."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def rates(df: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict | None = None, epochs: float = 1.0) -> DataFrame:
    """``src, bytes, rate`` per source over all documents; the null source is one of its own."""
    sizes = df.groupBy(col(source_col).alias("src")).agg(F.sum(F.octet_length(text_of(text_col)) + 1).cast("long").alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE))
    else:
        given = [F.when(F.col("src").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()]
        weight = F.coalesce(*given, F.lit(0.0))
    weighted = sizes.withColumn("weight", weight)
    total = weighted.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b")).select(F.struct("w", "b").alias("t"))
    share = F.col("weight") / F.col("t.w")
    rate = F.coalesce(F.try_divide(share * F.col("t.b") * F.lit(float(epochs)), F.col("bytes")), F.lit(0.0))
    return weighted.withColumn("t", total.scalar()).select("src", "bytes", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def cumulative(mean: Column) -> Column:
    """The Poisson distribution's cumulative sums, as far as a double tells them from 1."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda s, k: F.struct((s.p * mean / k).alias("p"), F.array_append(s.c, F.element_at(s.c, -1) + s.p * mean / k).alias("c")),
        lambda s: s.c,
    )


def mix(
    df: DataFrame, weights: dict | None = None, epochs: float = 1.0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The input's rows, each as often as drawn, with ``copy`` (from 1) and ``order_key``, in a global random order.

    ``weights`` maps sources to target shares of the bytes (any scale; a source that is missing
    there has none); without it a source counts by the square root of its bytes. ``epochs`` is the
    target size as a multiple of the input's. Sizes are UTF-8 bytes plus 1, so empty and null texts
    count. The null source is a source like any other. Draws depend on the id only: repeated rows
    and rows with a null id are drawn alike. An empty table gives an empty result. All columns are
    kept; input columns named ``copy`` or ``order_key``, in any case, are replaced.
    """
    spark = df.sparkSession
    table = rates(df, source_col, text_col, weights, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    table = table.withColumn("parts", parts).withColumn("sums", cumulative(F.col("rate") / F.col("parts")))
    packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(id_col).alias("id"), col(source_col).alias("source"))
    side = table.select("src", "parts", "sums")
    numbers = table.agg(F.sum(F.size("sums"))).first()[0] or 0
    drawn = packed.join(F.broadcast(side) if numbers <= MOST_NUMBERS else side, F.col("source").eqNullSafe(F.col("src")))
    number = lambda part: (_hashed(13, F.col("id"), part) + 0.5) / float(1 << 52)
    times = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + F.size(F.filter("sums", lambda c: c < number(part)))
    )
    copies = drawn.select("row", "id", times.alias("times")).where("times > 0").select(
        "row", "id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")
    )
    keyed = copies.withColumn("order_key", _hashed(15, F.col("id"), F.lit("copy"), F.col("copy")))
    dealt = keyed.repartition(partitions(spark), "order_key").sortWithinPartitions("order_key")
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in ("copy", "order_key")]
    return dealt.select(*kept, "copy", "order_key")


def op5_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))


OP5_SQL = f"""
with recursive sizes as (
  select source as src, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as bytes from documents group by source),
rates as (
  select src, (pow(bytes::double, {TEMPERATURE}) / sum(pow(bytes::double, {TEMPERATURE})) over ()) * sum(bytes) over () * 1.0 / bytes as rate
  from sizes),
sums as (
  select src, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all
  select src, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from sums where k + 1 <= ceil(rate + 10 * sqrt(rate) + 30)),
cdf as (select src, list(c order by k) as c from sums group by src),
drawn as (
  select d.*, ((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null') || ':1'), 1, 13))::bigint + 0.5) / {float(1 << 52)}) as u
  from documents d),
times as (
  select d.*, len(list_filter(cdf.c, lambda x: x < d.u)) as times
  from drawn d join cdf on d.source is not distinct from cdf.src),
copies as (select * exclude (u, times), unnest(range(1, times + 1)) as copy from times)
select *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null') || ':copy:' || copy), 1, 15))::bigint as order_key
from copies
"""
